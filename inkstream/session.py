"""Session helpers that hold for every operator."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
import zipfile
from collections import UserList

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_one_machine(spark: SparkSession) -> bool:
    """True where driver and tasks share one machine's folders and search path."""
    return re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset and all runs on one machine (tests) a folder
    of that machine is chosen, once for a session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not on_one_machine(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="inkstream-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


class _Written(UserList):
    """The folders of one thread's work, so that what runs beside it is not touched by ``release``."""

    def __init__(self):
        self.own = threading.local()

    @property
    def data(self) -> list[str]:
        return self.own.__dict__.setdefault("paths", [])

    def __getitem__(self, i):
        return self.data[i]


_written = _Written()


def materialise(df: DataFrame, name: str, compression: str | None = None, wide: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors.

    ``wide`` rows are of some MB each and stand in row groups by themselves: Parquet looks at the size of a group only once
    it has a hundred rows, and its reader holds a group's rows at once. Results may still read these tables, so they stay until ``discard`` or ``release``.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    alone = {"parquet.block.row.count.limit": "1", "parquet.enable.dictionary": "false"} if wide else {}
    df.write.options(**alone).parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._inkstream_table = path
    return out


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one, for files that a step writes by itself; ``release`` deletes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written() -> list[str]:
    """The folders that this thread's work got and nobody deleted yet, oldest first."""
    return list(_written)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders, by Hadoop's file systems."""
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        if path in _written:
            _written.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no later step reads, also after a lost executor."""
    for df in tables:
        if path := getattr(df, "_inkstream_table", None):
            delete(df.sparkSession, [path])


def release(spark: SparkSession, keep: list[str] = ()) -> int:
    """Delete all folders that this thread's work got, tables of ``materialise`` and others, but those in ``keep``; call it
    once the results that read them are written. Returns their number."""
    gone = [path for path in _written if path not in keep]
    delete(spark, gone)
    return len(gone)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def package_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Let executors import this package: a zip of it goes out once a session, unless all runs on this machine and its
    path has the package already."""
    root = package_root()
    if not os.path.isdir(root):  # the package itself came in a zip
        return
    if on_one_machine(spark) and (root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.path.samefile(os.getcwd(), root)):
        return
    if spark.conf.get("spark.inkstream.shipped", None):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="inkstream-zip-"), "inkstream.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "inkstream")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    spark.conf.set("spark.inkstream.shipped", "true")
