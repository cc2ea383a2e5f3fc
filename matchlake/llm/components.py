"""Connected components of links between representatives, as DataFrame joins.

Large-star and small-star steps alternate: each turns every link towards the smallest neighbour, until all links are
stars around the smallest member. A hub with any number of links is only ever a group of a `min` and the hot key of a
join, both of which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Expects u > v in each link."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(u, v) with u <> v -> (id, component): each end of a link and the smallest id that it reaches.

    Ends that link with nothing do not occur. Repeated links and links in both directions count once. An empty table
    gives an empty table.
    """
    t = Tables(links.sparkSession, name)
    links = t.put(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "0")
    before, k = None, 0
    while True:
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before, k = mark, k + 1
        links = t.put(_small_star(_large_star(links)), str(k))
        t.drop(str(k - 1))
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
