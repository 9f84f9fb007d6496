"""Names of two tables that contain each other (J16), by an inverted index over q-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.session import materialise

#: Characters of a gram; shorter names are looked up whole.
GRAM = 3


def _grams(x: Column, size: Column | int) -> Column:
    """The distinct substrings of a size; none if the text is shorter."""
    size = F.lit(size) if isinstance(size, int) else size
    places = F.when(F.length(x) >= size, F.sequence(F.lit(1), F.length(x) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substr(x, i, size)))


def contained(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """Pairs (part, whole) of two columns of names, where the part is a substring of the whole; each pair once.

    Every whole is listed under its substrings of one to ``GRAM`` characters. A part looks up one gram only, the one that
    fewest wholes have (itself, if it is shorter), and is then compared with those; a part with a gram that no whole has
    is dropped before. Null and empty names contain nothing and are in nothing.
    """
    part, whole = (df.toDF(name).where(F.length(name) > 0).distinct() for df, name in ((parts, "part"), (wholes, "whole")))
    listed = whole.select("whole", F.explode(F.concat(*[_grams(F.col("whole"), n) for n in range(1, GRAM + 1)])).alias("gram"))
    counts = materialise(listed.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "grams")
    asked = part.select("part", F.explode(_grams(F.col("part"), F.least(F.lit(GRAM), F.length("part")))).alias("gram")).join(counts, "gram", "left")
    rarest = asked.groupBy("part").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("missing"))
    return rarest.where("missing = 0").join(listed, "gram").where(F.contains("whole", "part")).select("part", "whole")


def name_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (left, right) of two columns of names, where one contains the other, whatever the case; each pair once."""
    a, b = left.toDF("left").distinct().withColumn("a", F.lower("left")), right.toDF("right").distinct().withColumn("b", F.lower("right"))
    inside = contained(a.select("a"), b.select("b")).toDF("a", "b")
    around = contained(b.select("b"), a.select("a")).toDF("b", "a").select("a", "b")
    return a.join(inside.union(around).distinct(), "a").join(b, "b").select("left", "right")
