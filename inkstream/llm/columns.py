"""Names that cannot clash: callers' columns get working names by position, and their own ones back at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """A top-level column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def plain(docs: DataFrame, *needed: str) -> DataFrame:
    """``docs`` with the needed columns under these names and all others as c0, c1, ... by position.

    Names may hold dots or backticks, repeat, or be those of an operator's working columns; none of them is touched.
    ``.toDF(*docs.columns)`` gives them back. A needed name is looked up exactly first, then whatever its case.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    for want in needed:
        same = [i for i, c in enumerate(docs.columns) if c == want] or [i for i, c in enumerate(docs.columns) if c.lower() == want.lower()]
        if not same:
            raise ValueError(f"no column {want}")
        names[same[0]] = want
    return docs.toDF(*names)
