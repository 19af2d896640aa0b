"""Keyed state in streams: sequence numbers without a table to look at, and liveness of producers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from streamledger.operators.sequencing import placed_in_time

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


#: Rows that a keyed state hands on at once.
TOLD_ROWS = 10_000
#: Buckets that ids or producers are dealt to; fixed for a checkpoint.
BUCKETS = 256


def _packed(keys: pa.Array) -> bytes:
    """Texts as one value of a state."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, pa.schema([("key", pa.string())]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(pa.record_batch([keys], ["key"]))
    return out.getvalue().to_pybytes()


def _unpacked(value: bytes) -> pa.ChunkedArray:
    return pa.ipc.open_stream(value).read_all()["key"]


class FirstCopies(StatefulProcessor):
    """Lets the first copy of each id of a subscription through; ids are kept for good, as a repeat may come at any time.

    A key is a bucket of ids, so that a subscription is never one task. Its state has a value for each trigger, all new ids in one, as a call for each id would go to the JVM and back. What is let through is a row for each subscription, as arrays.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "keys binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(rows).sort_values(["arrival"], kind="stable").drop_duplicates("key")
        keys, known = pa.array(came["key"], pa.string()), np.zeros(len(came), bool)
        for (value,) in self.seen.get() if self.seen.exists() else ():
            known |= pc.is_in(keys, value_set=_unpacked(value)).to_numpy(zero_copy_only=False)
        new = came[~known]
        if len(new):
            self.seen.appendValue((_packed(pa.array(new["key"], pa.string())),))
            told = [(subscription, part["arrival"].to_numpy(), part["id"].to_numpy()) for subscription, part in new.groupby("subscription", sort=False)]
            yield pd.DataFrame(told, columns=["subscription", "arrivals", "ids"])

    def close(self) -> None:
        pass


class Sequencer(StatefulProcessor):
    """Numbers a subscription's ids 1, 2, ... in order of arrival (ties by id), over any number of triggers. Of a trigger's ids it takes arrays, which are sorted as a whole; its state is the last number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else 0
        parts = [part[["arrivals", "ids"]] for part in rows]
        arrivals, ids = (np.concatenate([x for part in parts for x in part[name]]) for name in ("arrivals", "ids"))
        order = np.argsort(arrivals, kind="stable")
        if (np.diff(arrivals[order]) == 0).any():
            order = pd.DataFrame({"arrival": arrivals, "id": ids}).sort_values(["arrival", "id"]).index.to_numpy()
        for at in range(0, len(order), TOLD_ROWS):
            some = order[at : at + TOLD_ROWS]
            yield pd.DataFrame({"subscription": key[0], "seq": last + 1 + at + np.arange(len(some)), "id": ids[some]})
        self.last.update((last + len(order),))

    def close(self) -> None:
        pass


def sequenced(rows: DataFrame) -> DataFrame:
    """A stream of (subscription, arrival, id) to (subscription, seq, id), ids once each. A row without subscription or arrival is an error."""
    # no name has a space, and no id is not the empty one
    whole = placed_in_time(rows).select("subscription", "arrival", "id", F.concat("subscription", F.coalesce(F.concat(F.lit(" "), "id"), F.lit(""))).alias("key"))
    buckets = whole.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS))).groupBy("bucket")
    firsts = buckets.transformWithStateInPandas(statefulProcessor=FirstCopies(), outputStructType="subscription string, arrivals array<bigint>, ids array<string>", outputMode="Append", timeMode="None")
    return firsts.groupBy("subscription").transformWithStateInPandas(statefulProcessor=Sequencer(), outputStructType="subscription string, seq bigint, id string", outputMode="Append", timeMode="None")


class BoundedQueue(StatefulProcessor):
    """A queue that holds at most `bound` messages: while it is full, later ones are dropped as they come. Rows with kind `taken` say that so many (n) of the oldest were drained, which makes room.

    The state is the queue itself, oldest first, over any number of triggers; rows of a trigger are taken in order of arrival. Each message is told once, with whether it was kept.
    """

    def __init__(self, bound: int):
        self.bound = bound

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getListState("queue", "arrival bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        queue = [x[0] for x in self.queue.get()] if self.queue.exists() else []
        came = pd.concat([part[["arrival", "id", "kind", "n"]] for part in rows]).sort_values(["arrival", "id"], ignore_index=True)
        arrivals, taken, kept = came["arrival"].to_numpy(), (came["kind"] == "taken").to_numpy(), np.zeros(len(came), bool)
        start = 0
        for end in [*np.flatnonzero(taken), len(came)]:  # messages between two drains: the first have room
            full = min(end, start + max(0, self.bound - len(queue)))
            kept[start:full] = True
            queue += arrivals[start:full].tolist()
            if end < len(came):
                del queue[: max(0, int(came["n"][end]))]
            start = end + 1
        if queue:
            self.queue.put([(x,) for x in queue])
        else:
            self.queue.clear()
        told = came.assign(subscription=key[0], kept=kept).loc[~taken, ["subscription", "arrival", "id", "kept"]]
        for at in range(0, len(told), TOLD_ROWS):
            yield told.iloc[at : at + TOLD_ROWS]

    def close(self) -> None:
        pass


def queued(rows: DataFrame, bound: int) -> DataFrame:
    """A stream of (subscription, arrival, id, kind, n) to its messages (subscription, arrival, id, kept)."""
    return rows.groupBy("subscription").transformWithStateInPandas(statefulProcessor=BoundedQueue(bound), outputStructType="subscription string, arrival bigint, id string, kept boolean", outputMode="Append", timeMode="None")


class Liveness(StatefulProcessor):
    """A producer is online from its first message on and lost when none came for a while; each change is told once, with the millisecond at which it happened.

    By event time a producer is lost `timeout_ms` after its last message, once the watermark has passed that; by processing time, once the clock has.

    A key is a bucket of producers, as calls for a key cost milliseconds, whatever it holds: its state is when each of its producers that are online is due, and it has one timer, at the first of these.
    """

    def __init__(self, timeout_ms: int, event_time: bool = False):
        self.timeout_ms, self.event_time = timeout_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getListState("due", "producer string, timer bigint")

    def _keep(self, due: dict[str | None, int], timer: int | None) -> None:
        """The state from now on; timer: the one that is set."""
        first = min(due.values(), default=None)
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is not None and timer != first:
            self.handle.registerTimer(first)
        if due:
            self.due.put(list(due.items()))
        else:
            self.due.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due = dict(self.due.get()) if self.due.exists() else {}
        timer, heard, told = min(due.values(), default=None), {}, []
        for part in rows:
            if self.event_time:
                for producer, at in zip(part["producer"].tolist(), part["at"].astype("int64").tolist(), strict=True):
                    heard.setdefault(producer, []).append(at)
            else:
                heard |= dict.fromkeys(part["producer"].unique().tolist(), ())
        for producer, times in heard.items():
            end = due.get(producer)
            for at in sorted(times or [timerValues.getCurrentProcessingTimeInMs()]):
                if end is not None and at > end:
                    told.append((producer, "lost", end))
                    end = None
                if end is None:
                    told.append((producer, "online", at))
                    end = at
                end = max(end, at + self.timeout_ms)
            due[producer] = end
        self._keep(due, timer)
        yield pd.DataFrame(told, columns=["producer", "state", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All of the bucket that are due by now; Spark takes the timer that expired away."""
        due = dict(self.due.get()) if self.due.exists() else {}
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        told = [(producer, "lost", end) for producer, end in due.items() if end < now or end <= expiredTimerInfo.getExpiryTimeInMs()]
        for producer, _, _ in told:
            del due[producer]
        self._keep(due, None)
        yield pd.DataFrame(told, columns=["producer", "state", "at"])

    def close(self) -> None:
        pass


CHANGES = "producer string, state string, at bigint"


def _bucket() -> Column:
    return F.pmod(F.xxhash64("producer"), F.lit(BUCKETS)).alias("bucket")


def liveness(messages: DataFrame, timeout_ms: int) -> DataFrame:
    """A stream with a `producer` column to its changes of state, by processing time."""
    return messages.select("producer", _bucket()).groupBy("bucket").transformWithStateInPandas(statefulProcessor=Liveness(timeout_ms), outputStructType=CHANGES, outputMode="Append", timeMode="ProcessingTime")


def availability(messages: DataFrame, timeout_ms: int, delay: str = "0 seconds") -> DataFrame:
    """A stream of (producer, ts) to its changes of state by event time; messages later than the delay behind the newest are not counted."""
    rows = messages.select(_bucket(), "producer", "ts", F.unix_millis("ts").alias("at")).withWatermark("ts", delay)
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Liveness(timeout_ms, True), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


def last_seen(messages: DataFrame, now: int, timeout: int) -> DataFrame:
    """The batch form over (producer, at): when each was last heard and whether that is within the timeout."""
    return messages.groupBy("producer").agg(F.max("at").alias("at")).withColumn("online", F.lit(now) - F.col("at") <= timeout)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """One run over what has come in, appended to Parquet files."""
    use_rocksdb(stream.sparkSession)
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def run_through(stream: DataFrame, path: str, checkpoint: str, steps: Iterable[Callable[[], object]]) -> None:
    """One run that takes what each step brings before the next step, appended to Parquet files. Its query is planned and its states are opened once, which cost seconds and 4 MB of disk for each state of a partition."""
    use_rocksdb(stream.sparkSession)
    run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
    try:
        for step in steps:
            step()
            run.processAllAvailable()
    finally:
        run.stop()
