"""A bounded drain of a backlog as DataFrames: what it consumes, stores and skips."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamledger.functions.wire import parse_payloads
from streamledger.operators.pages import check_bound
from streamledger.operators.sequencing import first_copies, placed_in_time, unseen

MAX_REASON = 200


@dataclass
class Drained:
    """parsed: the messages taken, in order, with what was wrong with them; stored: new ledger rows; records: the valid messages taken, redelivered ones too, with the seq under which each is stored; skipped: topic and reason of malformed ones, which count as consumed."""

    parsed: DataFrame
    stored: DataFrame
    records: DataFrame
    skipped: DataFrame


def reason() -> Column:
    """What was wrong with a payload, in at most 200 characters."""
    told = F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(": "), e["message"])), "; ")
    return F.substring(told, 1, MAX_REASON)


def drain(messages: DataFrame, ledger: DataFrame, max: int = 100) -> Drained:
    """Takes the oldest max messages (subscription, arrival, topic, payload) of the backlog; equal arrivals are taken by subscription, topic and payload.

    The backlog is read once: what was taken, at most max rows, is held by the driver from then on, and the ledger is asked for these ids and their subscriptions' last numbers only.
    """
    check_bound(max)
    spark = messages.sparkSession
    taken = parse_payloads(placed_in_time(messages).orderBy("arrival", "subscription", "topic", "payload").limit(max))
    parsed = spark.createDataFrame(taken.collect(), taken.schema)
    good = parsed.where(F.size("errors") == 0).select("subscription", "arrival", "event.*")
    wanted = F.broadcast(good.select("subscription", "id").distinct())
    held = ledger.select("subscription", "id", "seq")
    known = held.join(wanted, ["subscription", "id"], "left_semi")
    known = spark.createDataFrame(known.collect(), known.schema)
    last = held.join(F.broadcast(good.select("subscription").distinct()), "subscription", "left_semi").groupBy("subscription").agg(F.max("seq").alias("last"))
    place = F.row_number().over(Window.partitionBy("subscription").orderBy("arrival", "id"))
    new = unseen(first_copies(good), known).join(F.broadcast(last), "subscription", "left")
    stored = new.withColumn("seq", (place + F.coalesce("last", F.lit(0))).cast("bigint")).drop("last")
    stored = spark.createDataFrame(stored.collect(), stored.schema)
    records = good.join(known.unionByName(stored.select("subscription", "id", "seq")), ["subscription", "id"])
    skipped = parsed.where(F.size("errors") > 0).select("topic", reason().alias("reason"))
    return Drained(parsed, stored, records, skipped)


def summary(drained: Drained, since: int = 0, max: int = 100) -> DataFrame:
    """One row: consumed, stored, skipped, cursor (the largest seq of the records, at least since) and has_more (the drain stopped at max)."""
    bit = lambda x: F.lit(x).cast("int")
    none = F.lit(None).cast("bigint").alias("seq")
    told = drained.parsed.select(bit(1).alias("consumed"), bit(0).alias("stored"), (F.size("errors") > 0).cast("int").alias("skipped"), none)
    told = told.unionByName(drained.stored.select(bit(0).alias("consumed"), bit(1).alias("stored"), bit(0).alias("skipped"), none))
    told = told.unionByName(drained.records.select(bit(0).alias("consumed"), bit(0).alias("stored"), bit(0).alias("skipped"), "seq"))
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name)
    one = told.agg(total("consumed"), total("stored"), total("skipped"), F.greatest(F.lit(since).cast("bigint"), F.max("seq")).alias("cursor"))
    return one.withColumn("has_more", F.col("consumed") >= max)
