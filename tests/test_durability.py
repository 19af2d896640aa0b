"""What is looked up, read, verified and fenced: the index of ids, bloom filters, ends of logs, corrupt records, publishers and drains at the same time."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from streamledger import errors
from streamledger.cli import main
from streamledger.operators import chains, sequencing
from streamledger.operators.ledger import Ledger
from streamledger.plans import adapter
from streamledger.schema import ENVELOPE
from streamledger.sources import broker
from streamledger.sources.broker import BacklogReader, Broker
from streamledger.sources.ledger_table import LedgerTable
from streamledger.plans.queries import _in_order, _pieces
from streamledger.streaming import drain, stateful

from .conftest import SF


def incoming(spark, n, first=1, sub="s"):
    rows = adapter.envelopes(adapter.events(spark, SF)).where(f"arrival >= {first} and arrival < {first + n}")
    return rows.withColumn("subscription", F.lit(sub))


def rows_scanned(df):
    """Rows that came out of the scan when df, a plan without a shuffle, was collected."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# The index of ids


def test_stored_ids_are_not_shuffled(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ledger.append(incoming(spark, 50), "b0")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        told = plan(sequencing.unseen(incoming(spark, 80), ledger.backend.seen()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    join = told[told.index("SortMergeJoin") :]
    assert "LeftAnti" in join and "Bucketed: true" in join and join.count("Exchange hashpartitioning") == 1
    assert join.index("Exchange hashpartitioning") < join.index("events.parquet") < join.index("Bucketed: true")  # it is the events' side


def test_lookups_skip_what_is_out_of_range(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    for k in range(4):
        ledger.append(incoming(spark, 100, 1 + 100 * k), f"b{k}")
    low, high = (incoming(spark, 5, 301).agg(f("id")).first()[0] for f in (F.min, F.max))
    assert rows_scanned(ledger.backend.seen((low, high)).select("seq")) <= 100 < ledger.backend.seen().count() == 400
    assert ledger.append(incoming(spark, 5, 301), "again", (low, high)) and ledger.rows().count() == 400
    found, missing = (ledger.rows().where(F.col("id") == x).select("seq") for x in (low, "evt_none"))
    assert 0 < rows_scanned(found) <= 100 and rows_scanned(missing) == 0  # by bloom filters: "evt_none" lies outside no range only by chance
    between = ledger.rows().where(F.col("id") == low[:-1] + "x").select("seq")
    assert rows_scanned(between) == 0 and ledger.get(low).first()["seq"] == 301


def test_crashed_attempts_do_not_count(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ledger.append(incoming(spark, 5), "b0")

    def stop():
        raise RuntimeError("crash")

    with pytest.raises(RuntimeError):
        ledger.append(incoming(spark, 9), "b1", guard=stop)
    assert ledger.rows().count() == 5 and ledger.backend.seen().count() == 5 and ledger.backend.dead() == ["b1.0"]
    assert {r["subscription"]: r["seq"] for r in ledger.backend.last()} == {"s": 5}
    assert ledger.append(incoming(spark, 12), "b1") and not ledger.append(incoming(spark, 12), "b1")
    assert [r["seq"] for r in ledger.read("s").collect()] == list(range(1, 13)) and ledger.backend.seen().count() == 12
    other = Ledger(spark.newSession(), str(tmp_path))  # another session has no table of that name yet
    assert other.backend.seen().count() == 12 and other.append(incoming(spark, 13), "b2") and other.rows().count() == 13
    assert Ledger(spark, str(tmp_path)).backend.seen().count() == 13


def test_marker_without_cleaning_up_counts(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ledger.append(incoming(spark, 5), "b0")
    ledger.backend.files.create("attempts/b0.0", "")  # a crash right after the marker
    assert ledger.backend.dead() == [] and ledger.backend.seen().count() == 5


# Reads


def test_newest_come_from_the_ends(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    for k in range(6):
        ledger.append(incoming(spark, 100, 1 + 100 * k), f"b{k}")
        ledger.append(incoming(spark, 20, 1 + 20 * k, "t"), f"c{k}")
    want = [tuple(r) for r in ledger.rows().select("subscription", "seq").collect()]
    assert len(want) == 720
    got = ledger.list(max=10)
    assert [(r["subscription"], r["seq"]) for r in got.collect()][0][1] in (600, 120) and got.count() == 10
    last = {r["subscription"]: r["seq"] for r in ledger.backend.last()}
    assert last == {"s": 600, "t": 120}
    assert rows_scanned(ledger.backend.ends({"s": 10, "t": 10}, last).select("seq")) <= 120  # one batch of each
    for kind in [r[0] for r in ledger.rows().select("type").distinct().limit(3).collect()]:
        typed = ledger.rows().where(F.col("type") == kind)
        mine = [r["id"] for r in ledger.list(kind, 7).collect()]
        from streamledger.operators import pages

        assert mine == [r["id"] for r in pages.newest(typed, max=7).collect()]
    assert ledger.list("no.such").count() == 0 and Ledger(spark, str(tmp_path / "none")).list().count() == 0


@pytest.mark.parametrize(("column", "value", "why"), [("store_format_version", "9", "unknown store format"), ("type", "Bad", "invalid envelope"), ("time", None, "invalid envelope"), ("seq", 7, "hole before it")])
def test_corrupt_records_stop_a_read(spark, tmp_path, column, value, why):
    ledger = Ledger(spark, str(tmp_path))
    good = sequencing.appended(incoming(spark, 5)).withColumns({"recorded_at": F.lit("x"), "store_format_version": F.lit("1")})
    kind = good.schema[column].dataType
    broken = good.withColumn(column, F.when(F.col("seq") == 4, F.lit(value).cast(kind)).otherwise(F.col(column)))
    ledger.backend.append(broken, "b0")
    told = rf"corrupt record s {7 if column == 'seq' else 4}: {why}"
    assert ledger.read("s", max=3).count() == 3  # what is not read is not judged
    with pytest.raises(Exception, match="hole before it" if column == "seq" else told):
        ledger.read("s").collect()
    if column != "seq":
        with pytest.raises(Exception, match=told):
            ledger.list().collect()
        with pytest.raises(Exception, match=told):
            ledger.get(broken.where("seq = 4").first()["id"]).collect()


# Order, publishers, drains


def test_rows_without_a_place_are_errors(spark, tmp_path):
    rows = incoming(spark, 6).withColumn("arrival", F.when(F.col("arrival") != 3, F.col("arrival")))
    with pytest.raises(Exception, match="a row has no arrival"):
        Ledger(spark, str(tmp_path)).append(rows, "b0")
    with pytest.raises(Exception, match="a row has no subscription"):
        sequencing.numbered(incoming(spark, 6).withColumn("subscription", F.when(F.col("arrival") != 3, "s"))).collect()
    with pytest.raises(Exception, match="a row has no arrival"):
        drain.emit(spark, str(tmp_path), rows, "arrival")
    assert Broker(spark, str(tmp_path)).messages().count() == 0


def test_publishers_at_the_same_time_lose_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    drain.add_subscription(spark, root, "clicks", "click.*")
    clicks = adapter.envelopes(adapter.events(spark, SF)).where("type rlike '^click[.][^.]+$'").orderBy("arrival").limit(12).collect()
    halves = [spark.createDataFrame(clicks[k::2], adapter.envelopes(adapter.events(spark, SF)).schema) for k in range(2)]
    gate, write = threading.Barrier(2, timeout=120), broker.CommittedTable.write

    def together(self, *args, **kwargs):
        out = write(self, *args, **kwargs)
        gate.wait()  # both have written before either is published
        return out

    monkeypatch.setattr(broker.CommittedTable, "write", together)
    threads = [threading.Thread(target=drain.emit, args=(spark, root, h, "arrival")) for h in halves]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    monkeypatch.undo()
    assert [r["arrival"] for r in Broker(spark, root).messages().orderBy("arrival").collect()] == list(range(1, 13))
    first = drain.drain_subscription(spark, root, "clicks", max=5, timeout=120)
    rest = drain.drain_all(spark, root, "clicks", max=5, timeout=120)
    assert first.stored + rest.stored == 12 and Ledger(spark, root).rows().select("id").distinct().count() == 12


def test_drains_without_a_caller_between_go_together(spark, tmp_path, monkeypatch):
    """A run takes as many whole drains as it may, one at least; what they did together is as before, also where all of it comes again."""
    root, rows = str(tmp_path), adapter.envelopes(adapter.events(spark, SF)).where("type rlike '^click[.][^.]+$'").orderBy("arrival").limit(50)
    ids = [r["id"] for r in rows.collect()]
    monkeypatch.setattr(drain, "TOGETHER", 25)
    drain.add_subscription(spark, root, "clicks", "click.*")
    drain.emit(spark, root, rows, "arrival")
    total, ledger = drain.drain_all(spark, root, "clicks", max=10, timeout=120), Ledger(spark, root)
    assert (total.consumed, total.stored, total.cursor, total.has_more, total.records) == (50, 50, 50, False, [])
    assert len(ledger.backend.batches()) == 3 and [(r["seq"], r["id"]) for r in ledger.rows().orderBy("seq").collect()] == list(enumerate(ids, 1))
    drain.Files(spark, root).delete("checkpoints/clicks")
    again = drain.drain_all(spark, root, "clicks", max=30, timeout=120)
    assert (again.consumed, again.stored, again.cursor) == (50, 0, 50) and ledger.rows().count() == 50


def test_an_append_plans_no_renamed_forms_of_its_check(spark, tmp_path):
    """A filter on columns that a struct gives has a form for each subset of them, if Spark is let."""
    seen = []

    class Watching(LedgerTable):
        def append(self, rows, *args):
            seen.append(rows._jdf.queryExecution().optimizedPlan().constraints().size())
            return super().append(rows, *args)

    rows = adapter.envelopes(adapter.events(spark, SF)).limit(5)
    events = rows.select(F.lit("s").alias("subscription"), "arrival", F.struct(*ENVELOPE.names).alias("event")).select("subscription", "arrival", "event.*")
    ledger = Ledger(spark, str(tmp_path), Watching(spark, f"{tmp_path}/ledger"))
    assert ledger.append(events, "b") and ledger.rows().count() == 5 and seen[0] < 100


def test_claims_that_stay_empty_are_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(broker, "PATIENCE", 0.2)
    b = Broker(spark, str(tmp_path))
    b.files.create("batches/000000000001", "")
    with pytest.raises(errors.BrokerUnavailable, match="incomplete"):
        b.last_arrival()
    assert list(BacklogReader({"path": b.root, "filter": "events/+"}).claims(0)) == []


@pytest.mark.parametrize("options", [{"max": "0"}, {"max": "x"}, {"created": "-1"}, {"max": "1.5"}, {"filter": "events/#"}, {"filter": ""}])
def test_options_are_checked(options):
    with pytest.raises(errors.InvalidBound):
        BacklogReader({"path": "/x", "filter": "events/+"} | options)


def test_the_fence_lets_one_win(spark, tmp_path):
    files = drain.Files(spark, str(tmp_path))
    files.create("locks/a", "5.0 crashed")
    waiting = [drain.Fence(files, "a") for _ in range(4)]
    last, won, lost = waiting[0].last(), [], []
    for f in waiting:  # all have seen the stale lock before any takes over
        f.last = lambda f=f, seen=[]: seen.append(1) or (last if len(seen) == 1 else type(f).last(f))
    for f in waiting:
        try:
            f.take()
            won.append(f)
        except errors.SubscriptionBusy:
            lost.append(f)
    assert len(won) == 1 and len(lost) == 3
    files.replace("locks/a", "5.0 slow")  # it stopped for long, and its lease ran out
    with drain.only_drainer(files, "a") as newer, pytest.raises(errors.SubscriptionBusy, match="taken over"):
        assert newer.number == won[0].number + 1
        won[0].check()


def test_what_was_taken_over_stores_nothing(spark, tmp_path):
    files, ledger = drain.Files(spark, str(tmp_path)), Ledger(spark, str(tmp_path))
    with drain.only_drainer(files, "s") as slow:
        files.replace("locks/s", "5.0 slow")
        with drain.only_drainer(files, "s"):
            pass
        with pytest.raises(errors.SubscriptionBusy):
            ledger.append(incoming(spark, 3), "b0", guard=slow.check)
    assert ledger.rows().count() == 0 and ledger.append(incoming(spark, 3), "b0")


def test_no_removal_while_a_drain_runs(spark, tmp_path):
    root = str(tmp_path)
    drain.add_subscription(spark, root, "worker", "task.*")
    with drain.only_drainer(drain.Files(spark, root), "worker") as held:
        with pytest.raises(errors.SubscriptionBusy):
            drain.remove_subscription(spark, root, "worker")
        drain.remove_subscription(spark, root, "worker", force=True)
        with pytest.raises(errors.SubscriptionBusy):
            held.check()


def test_a_full_queue_drops_what_comes(spark, tmp_path):
    """Ten fit; room comes with a drain, for what is emitted after it."""
    root, rows = str(tmp_path), adapter.envelopes(adapter.events(spark, SF)).where("type rlike '^click[.][^.]+$'").orderBy("arrival")
    ids = [r["id"] for r in rows.limit(40).collect()]
    some = lambda a, b: rows.where(F.col("id").isin(ids[a:b]))
    run = lambda n: [r["id"] for r in drain.drain_subscription(spark, root, "clicks", max=n, timeout=120, max_queued=10).records]
    drain.add_subscription(spark, root, "clicks", "click.*")
    drain.emit(spark, root, some(0, 8), "arrival")
    drain.emit(spark, root, some(8, 16), "arrival")
    assert run(4) == ids[:4]  # ten were in, six were dropped, six are left
    drain.emit(spark, root, some(16, 30), "arrival")
    assert run(8) == ids[4:10] + ids[16:18]  # four more had room
    assert run(50) == ids[18:20] and run(50) == []
    drain.emit(spark, root, some(30, 33), "arrival")
    assert run(50) == ids[30:33]


# State


def test_a_queue_over_triggers(spark, tmp_path):
    steps = [[(k, "message", 0) for k in range(1, 6)], [(6, "message", 0), (7, "taken", 2), (8, "message", 0), (9, "message", 0), (10, "message", 0)], [(11, "taken", 99), (12, "message", 0)]]
    for rows in steps:
        spark.createDataFrame([("q", a, f"i{a}", kind, n) for a, kind, n in rows], "subscription string, arrival bigint, id string, kind string, n bigint").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("subscription string, arrival bigint, id string, kind string, n bigint").parquet(f"{tmp_path}/in")
        stateful.run_once(stateful.queued(stream, 4), f"{tmp_path}/out", f"{tmp_path}/state")
    kept = {r["arrival"] for r in spark.read.parquet(f"{tmp_path}/out").where("kept").collect()}
    assert kept == {1, 2, 3, 4, 8, 9, 12}


def test_producers_come_and_go(spark, tmp_path):
    steps = [[("a", 0), ("b", 1), ("a", 5)], [("a", 100), ("c", 103)], [("b", 104)]]
    for rows in steps:
        spark.createDataFrame(rows, "producer string, s bigint").select("producer", F.timestamp_seconds(F.col("s") + 1000).alias("ts")).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("producer string, ts timestamp").parquet(f"{tmp_path}/in")
        stateful.run_once(stateful.availability(stream, 20_000), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted((r["at"] // 1000 - 1000, r["producer"], r["state"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, "a", "online"), (1, "b", "online"), (21, "b", "lost"), (25, "a", "lost"), (100, "a", "online"), (103, "c", "online"), (104, "b", "online")]


def test_liveness_by_the_clock(spark, tmp_path):
    """A producer comes online with its message and is lost a second later, although nothing more comes in."""
    stateful.use_rocksdb(spark)
    spark.createDataFrame([("a",), ("a",)], "producer string").write.parquet(f"{tmp_path}/in")
    stream = stateful.liveness(spark.readStream.schema("producer string").parquet(f"{tmp_path}/in"), 1000)
    run = stream.writeStream.format("memory").queryName("heard").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(processingTime="1 second").start()
    try:
        until = time.monotonic() + 120
        while spark.table("heard").count() < 2 and time.monotonic() < until:
            time.sleep(1)
    finally:
        run.stop()
    (first, second) = spark.table("heard").orderBy("at").collect()
    assert (first["state"], second["state"]) == ("online", "lost") and second["at"] - first["at"] == 1000


def test_state_is_kept_by_buckets_of_producers(spark, tmp_path):
    """Calls for a key cost milliseconds whatever it holds, so keys must not grow with producers: 3,000 of them have BUCKETS rows of state at most."""
    for second in (0, 100):
        rows = spark.range(3000).where("id % 2 = 0" if second else "true").select(F.concat(F.lit("p"), "id").alias("producer"), F.timestamp_seconds(F.lit(second) + 1000).alias("ts"))
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        stateful.run_once(stateful.availability(spark.readStream.schema("producer string, ts timestamp").parquet(f"{tmp_path}/in"), 20_000), f"{tmp_path}/out", f"{tmp_path}/state")
    counts = {(r["state"], r["at"]): r["count"] for r in spark.read.parquet(f"{tmp_path}/out").groupBy("state", "at").count().collect()}
    assert counts == {("online", 1_000_000): 3000, ("lost", 1_020_000): 3000, ("online", 1_100_000): 1500}
    keys = spark.read.format("statestore").option("stateVarName", "due").option("flattenCollectionTypes", "true").load(f"{tmp_path}/state").select("key").distinct().count()
    assert 0 < keys <= 256


def numbered_over_triggers(spark, tmp_path, steps):
    """What the sequencer tells of rows (subscription, arrival, id) that come in steps."""
    for rows in steps:
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("subscription string, arrival bigint, id string").parquet(f"{tmp_path}/in")
        stateful.run_once(stateful.sequenced(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    return [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("subscription", "seq", "id").orderBy("subscription", "seq").collect()]


def test_numbers_over_triggers(spark, tmp_path):
    """Repeats within a trigger and in later ones, equal arrivals, ids that are null, empty or hold a space, and an id of two subscriptions; rows are in no order."""
    steps = [[("s", 9, "z"), ("s", 3, "b"), ("s", 3, "a"), ("t", 1, "a"), ("s", 4, "a"), ("s", 5, None), ("s", 6, "")], [("s", 12, "b c"), ("s", 11, "b"), ("s", 10, None), ("t", 20, "z"), ("s", 7, "late")], [("s", 30, "z"), ("s", 31, ""), ("u", 1, "a"), ("s", 29, "end")]]
    got = numbered_over_triggers(spark, tmp_path, [spark.createDataFrame(rows, "subscription string, arrival bigint, id string") for rows in steps])
    want = {"s": ["a", "b", None, "", "z", "late", "b c", "end"], "t": ["a", "z"], "u": ["a"]}
    assert got == [(s, k, x) for s, ids in want.items() for k, x in enumerate(ids, 1)]


def test_one_run_takes_step_after_step(spark, tmp_path):
    """Each step's rows are a trigger of their own, in one run of the query."""
    rows = [spark.createDataFrame([("s", 10 * k + n, f"e{(10 * k + n) % 15}") for n in range(10)], "subscription string, arrival bigint, id string") for k in range(3)]
    stream = stateful.sequenced(spark.readStream.schema(rows[0].schema).parquet(f"{tmp_path}/in/*"))
    for k in range(3):
        rows[k].write.parquet(f"{tmp_path}/pieces/{k}")
    (tmp_path / "in").mkdir()
    stateful.run_through(stream, f"{tmp_path}/out", f"{tmp_path}/state", [lambda k=k: (tmp_path / f"pieces/{k}").rename(tmp_path / f"in/{k}") for k in range(3)])
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()] == [("s", k + 1, f"e{k}") for k in range(15)]
    assert len([p for p in (tmp_path / "state/commits").iterdir() if p.name.isdigit()]) == 3


def test_ids_are_kept_by_buckets(spark, tmp_path):
    """A call for each id goes to the JVM and back, and a subscription may have all rows: ids are dealt to buckets, and a bucket's state has a value for each trigger that brought new ones."""
    ids = spark.range(6000).select(F.lit("s").alias("subscription"), F.col("id").alias("arrival"), F.concat(F.lit("e"), F.col("id") % 4000).alias("id"))
    got = numbered_over_triggers(spark, tmp_path, [ids.where("arrival < 3000"), ids.where("arrival >= 3000")])
    assert got == [("s", k, f"e{k - 1}") for k in range(1, 4001)]
    held = spark.read.format("statestore").option("operatorId", 1).option("stateVarName", "seen").option("flattenCollectionTypes", "true").load(f"{tmp_path}/state")
    assert 100 < held.select("key").distinct().count() <= 256 and held.count() <= 512


def test_rows_without_a_place_stop_the_sequencer(spark, tmp_path):
    with pytest.raises(Exception, match="a row has no arrival"):
        numbered_over_triggers(spark, tmp_path, [spark.createDataFrame([("s", None, "a")], "subscription string, arrival bigint, id string")])


def test_more_triggers_for_more_rows(spark, tmp_path, monkeypatch):
    """A trigger holds about so many rows, however many there are; together the triggers have them all, in order."""
    sizes, rows = [], spark.range(1000).select((F.col("id") * 3).alias("arrival"))
    _in_order(rows, f"file://{tmp_path}/q/in", "arrival", 2, lambda path: sizes.append(spark.read.parquet(path).agg(F.count("*"), F.max("arrival")).first()), 100)
    assert [n for n, _ in sizes] == [100 * k for k in range(1, 11)] and [last for _, last in sizes] == [300 * k - 3 for k in range(1, 11)]


def test_triggers_by_the_rows_of_one_key(spark, tmp_path):
    """Where a trigger must be small for the sake of each key's rows, the others' do not count."""
    rows = spark.range(1000).select(F.col("id").alias("arrival"), F.when(F.col("id") % 5 < 2, "a").otherwise("b").alias("key"))
    assert _pieces(rows, f"file://{tmp_path}/q/in", "arrival", 2, 100, "key") == 6
    counts = [spark.read.parquet(f"file://{tmp_path}/q/in-pieces/piece={k}").count() for k in range(6)]
    assert sum(counts) == 1000 and max(counts) <= 170


def test_finished_chains_are_not_joined(spark, monkeypatch):
    """Events that stand at their root have no next: none of a round's joins takes nulls, which would all fall to one task."""
    seen = []
    monkeypatch.setattr(chains, "_stored", lambda rows, path, f=chains._stored: (seen.append(rows._jdf.queryExecution().optimizedPlan().toString()), f(rows, path))[1])
    rows = [(f"n{k}", f"n{k - 1}" if k % 5 else None) for k in range(50)]
    assert chains.chains(spark.createDataFrame(rows, "id string, causation_id string")).where("depth = 4").count() == 10
    assert len(seen) > 2 and not any("Join LeftOuter" in plan for plan in seen[2:])


def test_chains_of_causes(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "z"), ("z", "x"), ("in", "x"), ("self", "self"), ("lost", "no such"), ("e", "lost"), ("d", "c"), (None, "a"), ("two", None), ("two", "b")]
    rows += [(f"n{k}", f"n{k - 1}" if k else None) for k in range(300)]
    got = {r["id"]: (r["root"], r["depth"]) for r in chains.chains(spark.createDataFrame(rows, "id string, causation_id string")).collect()}
    assert got["a"] == ("a", 0) and got["d"] == ("a", 3) and got["n299"] == ("n0", 299) and got["e"] == ("lost", 1) and got["two"] == ("a", 2)
    assert all(got[k] == (None, None) for k in ("x", "y", "z", "in", "self")) and len(got) == 312
    assert chains.chains(spark.createDataFrame([], "id string, causation_id string")).count() == 0


# Command line


def test_emit_reads_data(spark, tmp_path, capsys):
    root = str(tmp_path / "root")
    run = lambda *a: (main(["--root", root, *a, "--json"], spark), capsys.readouterr())
    code, out = run("emit", "task.done")
    assert code == 0 and json.loads(out.out)["event"]["data"] == {}
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "list.json").write_text("[1]")
    (tmp_path / "latin.json").write_bytes(b'{"a":"\xe9"}')
    for name in ("none.json", "bad.json", "latin.json"):
        code, out = run("emit", "task.done", "--data", str(tmp_path / name))
        assert code == 1 and json.loads(out.err)["error"] == "UnreadableInput"
    code, out = run("emit", "task.done", "--data", str(tmp_path / "list.json"))
    assert code == 1 and json.loads(out.err)["errors"][0]["code"] == "not_an_object"
    assert Broker(spark, root).messages().count() == 1
