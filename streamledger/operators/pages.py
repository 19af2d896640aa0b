"""Bounded reads of the ledger: pages after a cursor, newest first, point lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamledger.errors import InvalidBound

DEFAULT_MAX = 100


def check_bound(n: object, what: str = "max", least: int = 1) -> int:
    """A whole number of at least `least`, checked before any job runs."""
    if isinstance(n, bool) or not isinstance(n, int) or n < least:
        raise InvalidBound(f"{what} must be a whole number of {least} or more, not {n!r}")
    return n


def page_after(ledger: DataFrame, subscription: str, since: int = 0, max: int = DEFAULT_MAX) -> DataFrame:
    """Records of a subscription with seq above since, oldest first, at most max."""
    check_bound(max)
    check_bound(since, "since", 0)
    return ledger.where((F.col("subscription") == subscription) & (F.col("seq") > since)).orderBy("seq").limit(max)


def page_summary(ledger: DataFrame, subscription: str, since: int = 0, max: int = DEFAULT_MAX) -> DataFrame:
    """One row: n, cursor (since itself for an empty page) and has_more, which is exact."""
    page = page_after(ledger, subscription, since, max).select("seq", F.lit(True).alias("paged"))
    last = ledger.where(F.col("subscription") == subscription).agg(F.max("seq").alias("seq")).withColumn("paged", F.lit(False))
    cursor = F.coalesce(F.max(F.when(F.col("paged"), F.col("seq"))), F.lit(since).cast("bigint"))
    return page.unionByName(last).agg(F.count_if("paged").alias("n"), cursor.alias("cursor"), F.coalesce(F.max("seq") > cursor, F.lit(False)).alias("has_more"))


def newest(ledger: DataFrame, type: str | None = None, max: int = DEFAULT_MAX) -> DataFrame:
    """Newest first, each event once: by recorded_at, subscription and seq, falling. Every subscription gives its last max records by seq only."""
    check_bound(max)
    rows = ledger if type is None else ledger.where(F.col("type") == type)
    own = Window.partitionBy("subscription").orderBy(F.desc("seq"))
    order = [F.desc("recorded_at"), F.desc("subscription"), F.desc("seq")]
    top = rows.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= max).drop("rank")
    once = top.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("rank = 1").drop("rank")
    return once.orderBy(*order).limit(max)


def by_id(ledger: DataFrame, id: str) -> DataFrame:
    """The record of an event in the first subscription by name that holds it."""
    return ledger.where(F.col("id") == id).orderBy("subscription").limit(1)


def subscriptions(ledger: DataFrame) -> DataFrame:
    return ledger.select("subscription").distinct().orderBy("subscription")


def history_then(page: DataFrame, drained: DataFrame) -> DataFrame:
    """A history page and what a drain brought, oldest first: an ordinal keeps the order that a union does not."""
    own = lambda df, half: df.withColumn("half", F.lit(half))
    return own(page, 0).unionByName(own(drained, 1), allowMissingColumns=True).orderBy("half", "seq")
