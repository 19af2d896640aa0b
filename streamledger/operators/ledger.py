"""The append-only ledger over Parquet: append, read, get, list, subscriptions, and a check of what is stored."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from streamledger.errors import CorruptLedger, InvalidName
from streamledger.functions.times import now
from streamledger.functions.rules import NOT_JSON
from streamledger.functions.wire import parse_records, to_wire_json, typed_problems
from streamledger.operators import pages, sequencing
from streamledger.schema import FIELDS, STORE_FORMAT_VERSION
from streamledger.sources.committed import set_for
from streamledger.sources.ledger_table import LedgerTable

NAME = re.compile(r"[a-z0-9][a-z0-9._-]{0,63}")


def check_name(name: object) -> str:
    """A name that is safe as a folder's; the registry asks for more."""
    if not isinstance(name, str) or not NAME.fullmatch(name):
        raise InvalidName(f"no valid subscription name: {name!r}")
    return name


class LedgerBackend(Protocol):
    """What stands behind a ledger: the rows, their ids and last numbers, and appending a named batch of them once."""

    def read(self) -> DataFrame: ...

    def seen(self, within: tuple[str, str] | None = None) -> DataFrame: ...

    def last(self) -> list[Row]: ...

    def ends(self, per: dict[str, int], last: dict[str, int]) -> DataFrame: ...

    def holds(self, batch: str) -> bool: ...

    def append(self, rows: DataFrame, batch: str, sort: tuple[str, ...] = (), guard: Callable[[], None] | None = None) -> bool: ...


#: Up to so many subscriptions, the newest records are read from the ends of their logs; beyond, all are ranked.
TAILS = 1000


def record_problem() -> Column:
    """Why a stored record can't be right, null if nothing: its format, number or envelope."""
    return F.when(~F.col("store_format_version").eqNullSafe(F.lit(STORE_FORMAT_VERSION)), "unknown store format").when(F.coalesce(F.col("seq") < 1, F.lit(True)), "number below 1").when(F.size(typed_problems()) > 0, "invalid envelope")


def verified(rows: DataFrame, after: int | None = None) -> DataFrame:
    """rows, each of which is an error if it is no valid record. after: they are to be a subscription's numbers from there on, without a hole."""
    why = record_problem()
    if after is not None:
        place = F.row_number().over(Window.partitionBy("subscription").orderBy("seq"))
        rows = rows.withColumn("place", place)
        why = F.coalesce(why, F.when(F.col("seq") != F.col("place") + after, "hole before it"))
    told = F.concat(F.lit("corrupt record "), F.coalesce("subscription", F.lit("")), F.lit(" "), F.coalesce(F.col("seq").cast("string"), F.lit("without a number")), F.lit(": "), why)
    return rows.where(F.when(why.isNotNull(), F.raise_error(told).cast("boolean")).otherwise(True)).drop("place")


class Ledger:
    """Reads are lazy DataFrames; appends are jobs. Bounds and names are checked before either. What is read is verified in the same job: a corrupt record is an error that names it, never skipped."""

    def __init__(self, spark: SparkSession, root: str, backend: LedgerBackend | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.backend = backend or LedgerTable(spark, f"{self.root}/ledger")

    def rows(self) -> DataFrame:
        return self.backend.read()

    def append(self, events: DataFrame, batch: str, within: tuple[str, str] | None = None, guard: Callable[[], None] | None = None) -> bool:
        """Stores valid envelopes (subscription, arrival and the envelope's columns); known ids stay as they are. False if the batch was stored before. within: the least and the largest id among the events, if they are known; guard is called before the batch counts."""
        if self.backend.holds(batch):
            return False
        stop = F.raise_error(F.concat(F.lit("invalid envelope "), F.coalesce("id", F.lit("without id")))).cast("boolean")
        checked = events.where(F.when(F.size(typed_problems()) > 0, stop).otherwise(True))
        last = self.spark.createDataFrame([(r["subscription"], r["seq"]) for r in self.backend.last()], "subscription string, seq bigint")
        new = sequencing.numbered(sequencing.unseen(sequencing.first_copies(checked), self.backend.seen(within)), last)
        new = new.withColumns({"recorded_at": now(), "store_format_version": F.lit(STORE_FORMAT_VERSION)})
        # Else Spark writes out a filter on n columns that were renamed in 2^n forms, which took half a minute for each append.
        with set_for(events.sparkSession, spark__sql__constraintPropagation__enabled="false"):
            return self.backend.append(new, batch, ("subscription", "seq"), guard)

    def read(self, subscription: str, since: int = 0, max: int = pages.DEFAULT_MAX) -> DataFrame:
        return verified(pages.page_after(self.rows(), check_name(subscription), since, max), since)

    def page(self, subscription: str, since: int = 0, max: int = pages.DEFAULT_MAX) -> DataFrame:
        return pages.page_summary(self.rows(), check_name(subscription), since, max)

    def get(self, id: str) -> DataFrame:
        """Row groups whose bloom filter rules the id out are not read."""
        return verified(pages.by_id(self.rows(), id))

    def list(self, type: str | None = None, max: int = pages.DEFAULT_MAX) -> DataFrame:
        """Newest first. Read from the ends of the subscriptions' logs, further back where these hold too few of the type, so that what is read does not grow with history."""
        pages.check_bound(max)
        last = {r["subscription"]: r["seq"] for r in self.backend.last()}
        if len(last) > TAILS:
            return verified(pages.newest(self.rows(), type, max))
        per, short = dict.fromkeys(last, max), set(last)
        while type is not None:
            short = {s for s in short if last[s] > per[s]}
            if not short:
                break
            held = self.backend.ends({s: per[s] for s in short}, last).where(F.col("type") == type).groupBy("subscription").count()
            short -= {r["subscription"] for r in held.collect() if r["count"] >= max}
            per |= {s: per[s] * 8 for s in short}
        return verified(pages.newest(self.backend.ends(per, last), type, max))

    def subscriptions(self) -> DataFrame:
        return pages.subscriptions(self.rows())

    def stored_at(self, events: DataFrame, within: tuple[str, str] | None = None) -> DataFrame:
        """The seq of each (subscription, id), null if it is not stored. within: the least and the largest id among them, if they are known."""
        return sequencing.stored_at(events, self.backend.seen(within))

    def problems(self) -> DataFrame:
        """Records that can't be right: unknown format, number below 1, invalid fields, or a hole in the numbers."""
        rows = self.rows()
        wrong = rows.withColumn("why", record_problem()).where(F.col("why").isNotNull()).select("subscription", "seq", "why")
        return wrong.unionByName(sequencing.gaps(rows).select("subscription", "seq", F.lit("hole before it").alias("why")))

    def verify(self) -> None:
        first = self.problems().limit(1).collect()
        if first:
            raise CorruptLedger(f"{first[0]['subscription']} {first[0]['seq']}: {first[0]['why']}", f"restore {self.root}")


def stored_lines(rows: DataFrame) -> DataFrame:
    """Ledger rows in their stored form, a JSON line each."""
    head = F.to_json(F.struct(F.col("store_format_version").alias("storeFormatVersion"), "seq", "subscription", F.col("recorded_at").alias("recordedAt")))
    return rows.select("subscription", "seq", F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(',"event":'), to_wire_json(), F.lit("}")).alias("value"))


def import_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stored records from JSON lines (seq, subscription, recordedAt, storeFormatVersion, event). A torn last line of a file is dropped; any other line that is no JSON, lacks a key, has another format, a number below 1 or an invalid envelope is an error naming its file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = parse_records(lines)
    last = lines.groupBy("file").agg(F.max("line").alias("last"))
    rows = rows.join(F.broadcast(last), "file").where(~F.col("record.problem").eqNullSafe(F.lit(NOT_JSON)) | (F.col("line") != F.col("last")))
    why = F.coalesce(F.col("record.problem"), F.when(F.size("errors") > 0, "invalid envelope"))
    stop = F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("corrupt record in "), F.col("file"), F.lit(": "), why)))
    return rows.select(F.coalesce(stop, F.col("record.seq")).alias("seq"), "record.recorded_at", F.lit(STORE_FORMAT_VERSION).alias("store_format_version"), *[F.col(f"event.{n}").alias(n) for n, _, _ in FIELDS], "record.subscription")
