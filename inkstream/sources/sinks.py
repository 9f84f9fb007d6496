"""Sinks (K01-K07). Every write goes to the session's file system through Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_table(df: DataFrame, path: str, changed: int) -> str | None:
    """A new version of a table below ``path``, only if rows were added or updated; its folder, or None."""
    if changed <= 0:
        return None
    version = f"{path.rstrip('/')}/version={uuid.uuid4().hex}"
    df.write.parquet(version)
    return version


def save_week(df: DataFrame, path: str) -> None:
    """Rows of the weeks in ``df`` replace those weeks; other weeks stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week_label").parquet(path)


def save_report(df: DataFrame, path: str) -> None:
    """A report of one nested row as JSON."""
    df.write.mode("overwrite").json(path)


def patched(digest: DataFrame, **fields: str) -> DataFrame:
    """A document with some fields replaced; dots name nested ones."""
    for name, value in fields.items():
        top, _, rest = name.partition("__")
        digest = digest.withColumn(top, F.col(top).withField(rest.replace("__", "."), F.lit(value)) if rest else F.lit(value))
    return digest


def lines(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Rows as lines of fixed width; negative widths align right."""
    cells = [F.rpad(F.substring(F.col(c).cast("string"), 1, w), w, " ") if w > 0 else F.lpad(F.col(c).cast("string"), -w, " ") for c, w in widths.items()]
    return df.select(F.concat(*cells).alias("line"))


def exists(spark: SparkSession, path: str) -> bool:
    """True if a path is there, by Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none if it is not there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
