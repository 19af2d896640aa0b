"""A ledger in one call each, at the place named by STREAMLEDGER_ROOT or the default one unless a root is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from streamledger.cli import default_root
from streamledger.operators.ledger import Ledger, LedgerBackend
from streamledger.operators.pages import DEFAULT_MAX


def open_store(spark: SparkSession, root: str | None = None, backend: LedgerBackend | None = None) -> Ledger:
    return Ledger(spark, root or default_root(), backend)


def append(events: DataFrame, batch: str, root: str | None = None) -> bool:
    """Stores valid envelopes (subscription, arrival and the envelope's columns) as a named batch, once. False if it was stored before."""
    return open_store(events.sparkSession, root).append(events, batch)


def read(spark: SparkSession, subscription: str, since: int = 0, max: int = DEFAULT_MAX, root: str | None = None) -> DataFrame:
    return open_store(spark, root).read(subscription, since, max)


def get(spark: SparkSession, id: str, root: str | None = None) -> DataFrame:
    return open_store(spark, root).get(id)


def list_events(spark: SparkSession, type: str | None = None, max: int = DEFAULT_MAX, root: str | None = None) -> DataFrame:
    return open_store(spark, root).list(type, max)
