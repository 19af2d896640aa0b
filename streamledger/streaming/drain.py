"""Bounded drains and watches over Structured Streaming: persist first, then commit the offset.

A drain is one `availableNow` run. Each micro-batch is parsed and stored under a
name made from the subscription, the incarnation of its checkpoint and the batch's
number before its offset is committed; a crash in between replays the batch, and the
ledger leaves a batch or an id that it holds as it is. Numbers begin anew with a
checkpoint that was lost or removed, and so does the incarnation, which lies in it.
A drain ends when it has taken `max` messages, when the backlog is empty, or when
its time is up. Drains that nobody looks at in between go together in one run, as a
message's number is that of its place among all, whichever drain takes it. Its lock is a lease that it renews: one that a crashed drain left behind
is taken over when it has run out. Who takes it gets the next number of the fence, and
a drain whose number is not the last can't make a batch count.
"""

from __future__ import annotations

import builtins
import contextlib
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from streamledger.errors import BrokerUnavailable, SubscriptionBusy
from streamledger.functions.wire import parse_payloads
from streamledger.operators.drains import reason
from streamledger.operators.ledger import Ledger
from streamledger.operators.pages import check_bound
from streamledger.operators.registry import Registry
from streamledger.sources import broker
from streamledger.sources.committed import Files

DEFAULT_TIMEOUT = 30.0


@dataclass
class DrainResult:
    """records: the ledger's rows of all valid messages taken, redelivered ones too, in order. stopped: max, or timeout where no more came in time. emptied: whether the backlog was seen to be empty."""

    subscription: str
    consumed: int = 0
    stored: int = 0
    cursor: int = 0
    has_more: bool = False
    stopped: str = "timeout"
    session_present: bool = False
    emptied: bool = True
    records: list[Row] = field(default_factory=list)
    skipped: list[dict] = field(default_factory=list)


#: Messages of drains that go together in one run.
TOGETHER = 1 << 20

#: Seconds that a drain's lock holds unless it is renewed, which a drain does several times within.
LEASE = 60.0


class Fence:
    """The right to drain a subscription, numbered: a later number ends it, whatever its holder believes."""

    def __init__(self, files: Files, name: str):
        self.files, self.name, self.number, self.own = files, name, 0, uuid.uuid4().hex
        self.lock, self.numbers = f"locks/{name}", f"fences/{name}"

    def last(self) -> int:
        return builtins.max([0, *map(int, self.files.names(self.numbers))])

    def take(self) -> None:
        """Takes the next number, which only one can create, if no lease holds."""
        before = self.last()
        if self.files.exists(self.lock):
            told = self.files.read(self.lock).split()
            if not told or float(told[0]) >= time.time():
                raise SubscriptionBusy(f"{self.name} is being drained")
        if not self.files.create(f"{self.numbers}/{before + 1:012d}", self.own):
            raise SubscriptionBusy(f"{self.name} is being drained")
        self.number = before + 1
        self.check()
        self.renew()
        for old in self.files.names(self.numbers):
            if int(old) < self.number:
                self.files.delete(f"{self.numbers}/{old}")

    def check(self) -> None:
        """An error once another drain has taken over: what this one has under way must not count."""
        if self.last() != self.number or self.files.read(f"{self.numbers}/{self.number:012d}") != self.own:
            raise SubscriptionBusy(f"another drain of {self.name} has taken over")

    def renew(self) -> None:
        self.files.replace(self.lock, f"{time.time() + LEASE} {self.own}")

    def give_back(self) -> None:
        if self.files.exists(self.lock) and self.files.read(self.lock).endswith(self.own):
            self.files.delete(self.lock)


@contextlib.contextmanager
def only_drainer(files: Files, name: str, timeout: float | None = None) -> Iterator[Fence]:
    """One drain of a subscription at a time; its lease is renewed while it runs."""
    fence, done = Fence(files, name), threading.Event()
    fence.take()

    def keep() -> None:
        while not done.wait(LEASE / 4):
            with contextlib.suppress(Exception):  # the fence is what counts
                if fence.last() == fence.number:
                    fence.renew()

    keeper = threading.Thread(target=keep, daemon=True)
    keeper.start()
    try:
        yield fence
    finally:
        done.set()
        keeper.join()
        fence.give_back()


def incarnation(files: Files, name: str) -> str:
    """What tells this checkpoint from others of the same subscription, before and after."""
    place = f"checkpoints/{name}/incarnation"
    files.create(place, uuid.uuid4().hex)
    return files.read(place)


def summed(ledger: Ledger, subscription: str, good: DataFrame, within: tuple[str, str], name: str) -> tuple[int, int]:
    """How many rows a batch has in the ledger, and the largest seq of the records of its messages, redelivered ones too."""
    new = ledger.rows().where((F.col("subscription") == subscription) & (F.col("batch") == name)).agg(F.count("*").alias("n"), F.max("seq").alias("last")).first()
    if new["n"]:  # numbered after all that were there
        return new["n"], new["last"]
    return 0, ledger.stored_at(good.select("subscription", "id"), within).agg(F.max("seq")).first()[0] or 0


def store_batch(ledger: Ledger, subscription: str, own: str, result: DrainResult, fence: Fence, keep: bool = True):
    """A foreachBatch function: valid messages go to the ledger, malformed ones are told and count as consumed. It fails before anything counts once another drain has taken over. keep: whether the result gets the records; else only their numbers."""

    def store(batch: DataFrame, number: int) -> None:
        parsed = parse_payloads(batch).persist()  # at most max rows, as all that is collected here
        try:
            told = parsed.where(F.size("errors") > 0).orderBy("arrival").select("topic", reason().alias("reason")).collect()
            good = parsed.where(F.size("errors") == 0).select(F.lit(subscription).alias("subscription"), "arrival", "event.*")
            name = f"{subscription}-{own}-{number:012d}"
            ids = good.agg(F.min("id"), F.max("id")).first()
            records, stored = [], 0
            if ids[0] is not None:
                ledger.append(good, name, (ids[0], ids[1]), fence.check)
            if ids[0] is not None and not keep:
                stored, last = summed(ledger, subscription, good, (ids[0], ids[1]), name)
                result.cursor = builtins.max(result.cursor, last)
            elif ids[0] is not None:
                held = ledger.rows().where((F.col("subscription") == subscription) & F.col("id").between(ids[0], ids[1]))
                records = held.join(F.broadcast(good.select("id", "arrival")), "id").orderBy("arrival").collect()
                stored = len({r["seq"] for r in records if r["batch"] == name})
            fence.check()
            result.stored += stored
            result.consumed += parsed.count()
            result.records += records
            result.skipped += [r.asDict() for r in told]
        finally:
            parsed.unpersist()

    return store


def drain_subscription(spark: SparkSession, root: str, name: str, since: int = 0, max: int = 100, timeout: float = DEFAULT_TIMEOUT, max_queued: int | None = None) -> DrainResult:
    """Moves at most max messages of a subscription's backlog into the ledger. The cursor is the largest seq of its records, or since. max_queued: so many messages the queue holds; those that came while it was full are dropped."""
    return _drain(spark, root, name, since, max, timeout, max_queued)


def _drain(spark: SparkSession, root: str, name: str, since: int, max: int, timeout: float, max_queued: int | None, keep: bool = True) -> DrainResult:
    check_bound(max)
    if max_queued is not None:
        check_bound(max_queued, "max_queued")
    check_bound(since, "since", 0)
    sub = Registry(spark, root).require(name)
    ledger, files = Ledger(spark, root), Files(spark, root)
    checkpoint = f"{root.rstrip('/')}/checkpoints/{name}"
    result = DrainResult(name, session_present=files.exists(f"checkpoints/{name}"))
    created = int(files.read(f"created/{name}")) if files.exists(f"created/{name}") else 0
    broker.register(spark)
    options = {"path": f"{root.rstrip('/')}/broker", "filter": sub.filter, "created": created, "max": max, "name": name}
    if max_queued is not None:
        options["max_queued"] = max_queued
    with only_drainer(files, name) as fence:
        stream = spark.readStream.format("event_backlog").options(**options).load()
        store = store_batch(ledger, name, incarnation(files, name), result, fence, keep)
        run = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            if not run.awaitTermination(timeout):
                result.emptied = False
                while run.isActive and run.status["isTriggerActive"]:  # a batch that has begun is stored and committed
                    run.awaitTermination(1)
                run.stop()
        except Exception as e:
            raise BrokerUnavailable(f"the drain of {name} failed: {e}") from e
    result.cursor = builtins.max([since, result.cursor, *(r["seq"] for r in result.records)])
    result.has_more = result.consumed >= max
    if result.has_more:
        result.stopped, result.emptied = "max", False
    return result


def drain_all(spark: SparkSession, root: str, name: str, max: int = 1000, timeout: float = DEFAULT_TIMEOUT, max_queued: int | None = None) -> DrainResult:
    """Bounded drains until the backlog is empty; what they did together. One run takes what as many whole drains would that have TOGETHER messages, one drain at least."""
    check_bound(max)
    total, drains = DrainResult(name), builtins.max(1, TOGETHER // max)
    while True:
        result = _drain(spark, root, name, 0, drains * max, timeout, max_queued, keep=False)
        total.consumed, total.stored, total.skipped = total.consumed + result.consumed, total.stored + result.stored, total.skipped + result.skipped
        total.cursor, total.stopped = builtins.max(total.cursor, result.cursor), result.stopped
        if result.emptied:
            return total
        if not result.consumed:
            raise BrokerUnavailable(f"a drain of {name} took nothing in {timeout} s")


def add_subscription(spark: SparkSession, root: str, name: str, pattern: str, owner: str | None = None):
    """The point from which messages are captured is noted first, the record second."""
    files = Files(spark, root)
    registry = Registry(spark, root)
    if registry.get(name) is None:
        files.delete(f"created/{name}")
        files.create(f"created/{name}", str(broker.Broker(spark, root).last_arrival()))
    return registry.add(name, pattern, owner)


def remove_subscription(spark: SparkSession, root: str, name: str, force: bool = False):
    """Drops the checkpoint, then the record, while no drain runs; force drops the record where the checkpoint can't go or a drain holds it, which then fails before it stores any more."""
    files, registry = Files(spark, root), Registry(spark, root)
    found = registry.require(name)
    if force:
        files.delete(f"locks/{name}")
    with only_drainer(files, name):
        try:
            for place in ("checkpoints", "created", "broker/dropped"):
                files.delete(f"{place}/{name}")
        except Exception:
            if not force:
                raise
        registry.remove(name)
    return found


def watch(spark: SparkSession, root: str, name: str, since: int = 0, max: int = 100, timeout: float = DEFAULT_TIMEOUT, distinct: bool = False) -> tuple[list[Row], dict]:
    """History after the cursor, and where that is short of max, the records of a drain; max rows at most. An event that was delivered again comes again, unless distinct keeps each id once."""
    ledger = Ledger(spark, root)
    Registry(spark, root).require(name)
    page = ledger.page(name, since, max).first()
    rows = ledger.read(name, since, max).collect()
    told = {"served_from": "history", "cursor": page["cursor"], "has_more": page["has_more"], "session_present": None, "consumed": 0, "skipped": [], "stopped": "max"}
    if len(rows) < max:
        drained = drain_subscription(spark, root, name, page["cursor"], max - len(rows), timeout)
        told = {"served_from": "history+broker" if rows else "broker", "cursor": drained.cursor, "has_more": drained.has_more, "session_present": drained.session_present, "consumed": drained.consumed, "skipped": drained.skipped, "stopped": drained.stopped}
        rows += drained.records
    if distinct:
        rows = list({r["id"]: r for r in reversed(rows)}.values())[::-1]
    return rows, told


def emit(spark: SparkSession, root: str, envelopes: DataFrame, order: str = "time_order") -> int:
    """Publishes envelope rows as messages on their types' topics, in the order of a column; returns how many arrived."""
    from streamledger.functions.topics import type_to_topic
    from streamledger.functions.wire import to_wire_json

    rows = envelopes.select(type_to_topic(F.col("type")).alias("topic"), to_wire_json().alias("payload"), F.col(order).alias("order"))
    return broker.Broker(spark, root).publish(rows, "order")
