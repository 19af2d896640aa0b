"""Chains of causes: an extension, as no reader of the ledger's model follows causation ids.

Every event points at its cause. Pointers jump: each round an event points at where its
pointer's target points, so a chain of a million events takes twenty rounds and no round
holds more than one row an event. What is still on its way after more rounds than the
number of events allows leads into a circle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamledger.session import scratch


def chains(events: DataFrame, id_col: str = "id", cause_col: str = "causation_id") -> DataFrame:
    """One row per id: root, the first event of its chain, and depth, the events between (0 for a root). Both are null where the chain leads into a circle.

    A cause that is null, or no id among the events, makes its event a root. Of events that repeat an id the one with the smallest cause counts (nulls last); null ids are left out.
    """
    spark = events.sparkSession
    rows = events.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(cause_col).alias("cause"))
    rows = _stored(rows, scratch(spark, "causes"))
    known = rows.select(F.col("id").alias("cause"), F.lit(True).alias("known"))
    start = rows.where("cause is not null").join(known, "cause", "left").unionByName(rows.where("cause is null").withColumn("known", F.lit(None).cast("boolean"))).select("id", F.when(F.col("known"), F.col("cause")).alias("next"), F.when(F.col("known"), 1).otherwise(0).cast("bigint").alias("depth"))
    # next: where the pointer stands, null once it stands at the root, which is kept then
    at = _stored(start.select("id", "next", "depth", F.when(F.col("next").isNull(), F.col("id")).alias("root")), scratch(spark, "chains"))
    # only pointers on their way are joined: the rest have no `next`, and nulls of one join key all fall to one task
    n, seen = at.count(), 1
    while seen <= n and not at.where("next is not null").isEmpty():
        there = at.select(F.col("id").alias("next"), F.col("next").alias("further"), F.col("depth").alias("more"), F.col("root").alias("found"))
        step = at.where("next is not null").join(there, "next")
        step = step.select("id", F.col("further").alias("next"), (F.col("depth") + F.col("more")).alias("depth"), F.coalesce("root", "found").alias("root"))
        at = _stored(at.where("next is null").unionByName(step), scratch(spark, "chains"))
        seen *= 2
    return at.select("id", "root", F.when(F.col("root").isNotNull(), F.col("depth")).alias("depth"))


def _stored(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
