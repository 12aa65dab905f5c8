"""Connected components of links between numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyframe.session import materialise


def _least_neighbours(links: DataFrame) -> DataFrame:
    """(a, b, m): every link from a with the least of a and its neighbours.

    The least is a grouped minimum that is joined back, so no neighbourhood is ever held in one place.
    """
    least = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
    return links.join(least, links["a"] == least["of"]).drop("of")


def components(links: DataFrame) -> DataFrame:
    """(a, b): each linked number with the least number it reaches, from links (a, b) of long numbers.

    Alternates two steps until nothing changes: every larger neighbour is linked to the least neighbour,
    then every smaller one is. Each round is written to the shared folder.
    """
    now, mark = materialise(links.where("a <> b").distinct(), "links"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least_neighbours(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        small = _least_neighbours(down)
        now = materialise(small.select("a", F.col("m").alias("b")).unionByName(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "links")
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            return now
        mark = tuple(found)
