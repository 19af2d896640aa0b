"""The ledger's table: rows by batch and subscription, and an index of stored ids in buckets.

Beside the rows stands a table of (key, subscription, id, seq), in buckets by the key, which
is subscription and id in one (two columns would not do: where one is a constant, Spark
joins by the other alone). What an append looks up joins it bucket by bucket, so stored
ids are never shuffled, however many there are; and as files of the index hold the ids of
one batch each, a lookup of ids within a range skips files outside it. The largest numbers come from footers.

Rows of the index count when their attempt does: an attempt has a file of its own until its
batch is committed, so what crashed attempts left is known by the files that are left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from streamledger.operators.sequencing import event_key
from streamledger.schema import LEDGER
from streamledger.sources.committed import CommittedTable

#: Buckets of a new ledger's index. Fixed once the ledger is there; choose it by the ids that are to come.
BUCKETS = 16
#: Rows of a subscription that one task writes.
FILE_ROWS = 1 << 20
INDEX = "key string, subscription string, id string, seq bigint, attempt string"


class LedgerTable(CommittedTable):
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        super().__init__(spark, root, LEDGER, ("subscription",), "id")
        self.wanted = buckets

    def index(self) -> str:
        """The index as a table of the session's catalog, over the files that are there."""
        self.files.create("buckets", str(self.wanted))
        buckets = int(self.files.read("buckets"))
        name = f"ledger_ids_{hashlib.md5(self.root.encode()).hexdigest()}"
        place = self.root.replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({INDEX}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{place}/ids'")
        return name

    def dead(self) -> list[str]:
        """Attempts that began and do not count."""
        held = lambda a: self.holds(b := a.rpartition(".")[0]) and self.files.read(f"batches/{b}") == a
        return [a for a in self.files.names("attempts") if not held(a)]

    def seen(self, within: tuple[str, str] | None = None) -> DataFrame:
        """Stored (key, subscription, id, seq); within: only ids from the first to the second are looked at."""
        name = self.index()
        self.spark.catalog.refreshTable(name)
        rows, dead = self.spark.table(name), self.dead()
        if dead:
            rows = rows.where(~F.col("attempt").isin(dead))
        if within is not None:
            rows = rows.where(F.col("id").between(*within))
        return rows.select("key", "subscription", "id", "seq")

    def last(self) -> list[Row]:
        """The last number of each subscription."""
        return self.largest("seq")

    def append(self, rows: DataFrame, batch: str, sort: tuple[str, ...] = ("subscription", "seq"), guard: Callable[[], None] | None = None) -> bool:
        """Whether the batch was new. First the rows, then the index, then the marker: a crash in between leaves an attempt that does not count. guard: called before the marker, to stop a writer that lost its right to write."""
        if self.holds(batch):
            return False
        n = 0
        while not self.files.create(f"attempts/{batch}.{n}", ""):
            n += 1
        attempt, name = f"{batch}.{n}", self.index()
        new = self.write(rows, batch, sort, (F.col("subscription"), F.floor(F.col("seq") / FILE_ROWS)))
        buckets = int(self.files.read("buckets"))
        ids = new.select(event_key().alias("key"), "subscription", "id", "seq", F.lit(attempt).alias("attempt"))
        ids.repartition(buckets, "key").write.insertInto(name)
        if guard is not None:
            guard()
        done = self.commit(batch, attempt)
        if done:
            self.files.delete(f"attempts/{attempt}")
        return done


    def ends(self, per: dict[str, int], last: dict[str, int]) -> DataFrame:
        """The rows of subscriptions whose numbers are among the last per[subscription]. Footers tell which folders have them; no other is listed or read."""
        cond = beyond({s: last[s] - n for s, n in per.items()})
        batches: dict[str, list[str]] = {}
        for r in self.largest("seq", cond, by_batch=True):
            batches.setdefault(r["subscription"], []).append(r["batch"])
        folders = any_of([(F.col("subscription") == s) & F.col("batch").isin(b) for s, b in batches.items()])
        return self.read().where(folders).where(cond)


def beyond(floors: dict[str, int]) -> Column:
    """Whether a row's number is above the floor of its subscription."""
    return any_of([(F.col("subscription") == s) & (F.col("seq") > n) for s, n in floors.items()])


def any_of(conditions: list[Column]) -> Column:
    """A balanced or, so that many conditions make no deep expression; false for none."""
    while len(conditions) > 1:
        conditions = [reduce(or_, conditions[k : k + 2]) for k in range(0, len(conditions), 2)]
    return conditions[0] if conditions else F.lit(False)
