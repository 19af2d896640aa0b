"""First copies by id and gap-free sequence numbers, per subscription.

A subscription's order is total, but numbering it must not take one task: rows are
numbered within blocks of arrivals, and the small table of block sizes gives each
block its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Arrivals in a block.
BLOCK = 1 << 16


def first_copies(rows: DataFrame) -> DataFrame:
    """Of rows with one (subscription, id), the one that arrived first."""
    order = Window.partitionBy("subscription", "id").orderBy("arrival")
    return rows.withColumn("copy", F.row_number().over(order)).where("copy = 1").drop("copy")


def event_key() -> Column:
    """Subscription and id in one text; names have no spaces."""
    return F.concat("subscription", F.lit(" "), "id")


def unseen(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows whose (subscription, id) the ledger does not hold. By the key, where the ledger has one: its buckets are not shuffled."""
    if "key" in ledger.columns:
        return rows.withColumn("key", event_key()).join(ledger.select("key"), "key", "left_anti").drop("key")
    return rows.join(ledger.select("subscription", "id"), ["subscription", "id"], "left_anti")


def placed_in_time(rows: DataFrame) -> DataFrame:
    """rows, none of which may lack a subscription or an arrival: a row without has no place, and would be lost."""
    gone = F.when(F.col("subscription").isNull(), "subscription").when(F.col("arrival").isNull(), "arrival")
    stop = F.raise_error(F.concat(F.lit("a row has no "), gone))
    held = lambda name: F.when(gone.isNotNull(), stop.cast(rows.schema[name].dataType)).otherwise(F.col(name)).alias(name)
    return rows.withColumns({name: held(name) for name in ("subscription", "arrival")})  # in both, as a join may drop nulls of either first


def numbered(rows: DataFrame, last: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """rows with seq: 1, 2, ... per subscription in order of arrival (ties by id), after `last` (subscription, seq). A row without subscription or arrival is an error."""
    blocks = placed_in_time(rows).withColumn("block", F.floor(F.col("arrival") / block))
    sizes = blocks.groupBy("subscription", "block").count()
    before = Window.partitionBy("subscription").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("subscription", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    if last is not None:
        offsets = offsets.join(last.select("subscription", F.col("seq").alias("last")), "subscription", "left").select("subscription", "block", (F.col("offset") + F.coalesce("last", F.lit(0))).alias("offset"))
    within = Window.partitionBy("subscription", "block").orderBy("arrival", "id")
    placed = blocks.withColumn("place", F.row_number().over(within)).join(offsets, ["subscription", "block"])
    return placed.withColumn("seq", (F.col("offset") + F.col("place")).cast("bigint")).drop("block", "place", "offset")


def appended(incoming: DataFrame, ledger: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """What an append adds to the ledger: first copies of unseen ids, numbered on."""
    rows = first_copies(incoming)
    if ledger is None:
        return numbered(rows, block=block)
    last = ledger.groupBy("subscription").agg(F.max("seq").alias("seq"))
    return numbered(unseen(rows, ledger), last, block)


def stored_at(incoming: DataFrame, ledger: DataFrame) -> DataFrame:
    """The seq under which each incoming (subscription, id) is stored, null if it is not."""
    if "key" in ledger.columns:
        return incoming.withColumn("key", event_key()).join(ledger.select("key", "seq"), "key", "left").drop("key")
    return incoming.join(ledger.select("subscription", "id", "seq"), ["subscription", "id"], "left")


def gaps(ledger: DataFrame, block: int = BLOCK) -> DataFrame:
    """Where a subscription's numbers do not run 1, 2, 3, ...: the number before (0 at the start) and the one found. Blocks of numbers are looked at by themselves; the first of each follows the last of the block before."""
    rows = ledger.select("subscription", "seq", F.floor(F.col("seq") / block).alias("block"))
    last = rows.groupBy("subscription", "block").agg(F.max("seq").alias("last"))
    edges = last.select("subscription", "block", F.coalesce(F.lag("last").over(Window.partitionBy("subscription").orderBy("block")), F.lit(0)).alias("edge"))
    within = rows.withColumn("before", F.lag("seq").over(Window.partitionBy("subscription", "block").orderBy("seq")))
    odd = within.where(F.col("before").isNull() | (F.col("seq") != F.col("before") + 1)).join(edges, ["subscription", "block"])
    return odd.select("subscription", "seq", F.coalesce("before", "edge").alias("before")).where(F.col("seq") != F.col("before") + 1)
