"""Declared join paths and the checks around them.

No side is hinted: Spark broadcasts a dimension only while its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and merges, with adaptive
execution splitting oversized partitions of the fact side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.contract import RELATIONSHIPS


def enrich(left: DataFrame, right: DataFrame, relationship: str, columns: list[str], how: str | None = None) -> DataFrame:
    """Follow a declared many-to-one path, adding the named columns of the other side."""
    path = RELATIONSHIPS[relationship]
    return left.join(right.select(*path.keys, *columns), list(path.keys), how or path.how)


def related_totals(
    facts: DataFrame, dimension: DataFrame, keys: list[str], group: list[Column], sums: dict[str, Column], how: str = "left",
) -> DataFrame:
    """Sum facts by dimension attributes, combining per join key before the join.

    The facts shrink to one row per key map-side, so a key holding a large share of the rows
    crosses the shuffle as one partial row per task; the join reuses the grouping's partitioning.
    """
    per_key = facts.groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    joined = per_key.join(dimension, keys, how)
    return joined.groupBy(*group).agg(*[F.sum(name).alias(name) for name in sums])


def with_activity(entities: DataFrame, activity: DataFrame, key: str) -> DataFrame:
    """Entities that have at least one activity row (EXISTS); each entity once.

    Activity is reduced to its keys before the shuffle, so a very active entity costs one row per task.
    """
    return entities.join(activity.select(key).distinct(), key, "left_semi")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def owner_mismatches(facts: DataFrame, cards: DataFrame) -> DataFrame:
    """``(card_id, client_id, owner_id, fact_rows)`` where the fact names another owner than the card.

    Joined on the card alone; joining on the owner too would hide exactly these rows.
    """
    per_pair = facts.groupBy("card_id", "client_id").agg(F.count(F.lit(1)).alias("fact_rows"))
    owners = cards.select("card_id", F.col("client_id").alias("owner_id"))
    return per_pair.join(owners, "card_id").where(~F.col("client_id").eqNullSafe(F.col("owner_id")))


def fanout(facts: DataFrame, dimension: DataFrame, keys: list[str]) -> DataFrame:
    """``(fact_rows, joined_rows, multiplied_keys)`` of a left join, without performing it row by row."""
    left = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("facts"))
    right = dimension.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"))
    return left.join(right, keys, "left").agg(
        F.coalesce(F.sum("facts"), F.lit(0)).alias("fact_rows"),
        F.coalesce(F.sum(F.col("facts") * F.coalesce("matches", F.lit(1))), F.lit(0)).alias("joined_rows"),
        F.count_if(F.col("matches") > 1).alias("multiplied_keys"),
    )
