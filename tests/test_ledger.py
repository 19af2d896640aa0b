"""Appending, reading, and what is durable across crashes."""

import json

import pytest
from pyspark.sql import functions as F

from streamledger import errors, history
from streamledger.cli import address, main
from streamledger.functions.wire import parse_payloads
from streamledger.operators import backlog, pages, sequencing
from streamledger.operators.ledger import Ledger, import_lines
from streamledger.operators.registry import NAME as REGISTERED
from streamledger.operators.ledger import NAME as STORED
from streamledger.plans import adapter
from streamledger.schema import ENVELOPE
from streamledger.streaming import drain, stateful

from .conftest import SF


def incoming(spark, n, first=1, sub="s"):
    rows = adapter.envelopes(adapter.events(spark, SF)).where(f"arrival >= {first} and arrival < {first + n}")
    return rows.withColumn("subscription", F.lit(sub))


def test_append_numbers_and_dedupes(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    assert ledger.append(incoming(spark, 10), "b0") and not ledger.append(incoming(spark, 20), "b0")
    assert ledger.append(incoming(spark, 12, 5), "b1")
    assert ledger.append(incoming(spark, 3, sub="other"), "b2")
    rows = [r["seq"] for r in ledger.read("s").collect()]
    assert rows == list(range(1, 17))
    assert [r["subscription"] for r in ledger.subscriptions().collect()] == ["other", "s"]
    assert ledger.problems().count() == 0
    assert ledger.get(ledger.read("s", max=1).first()["id"]).first()["subscription"] == "other"
    assert ledger.stored_at(incoming(spark, 2).select("subscription", "id")).agg(F.max("seq")).first()[0] == 2


def test_one_call_each(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("STREAMLEDGER_ROOT", str(tmp_path / "default"))
    assert history.append(incoming(spark, 6), "b0") and not history.append(incoming(spark, 6), "b0")
    assert history.append(incoming(spark, 2), "b0", root=str(tmp_path / "other"))
    rows = history.read(spark, "s", since=2, max=3).orderBy("seq").collect()
    assert [r["seq"] for r in rows] == [3, 4, 5]
    assert history.get(spark, rows[0]["id"]).count() == 1 and history.get(spark, rows[0]["id"], root=str(tmp_path / "other")).count() == 0
    assert history.list_events(spark, max=4).count() == 4
    assert history.open_store(spark).root == str(tmp_path / "default")


def test_half_written_batch_stays_unseen(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ledger.append(incoming(spark, 5), "b0")
    new = sequencing.appended(incoming(spark, 9), ledger.rows()).withColumns({"recorded_at": F.lit("x"), "store_format_version": F.lit("1")})
    new.limit(2).drop("arrival", "ts").write.partitionBy("subscription").parquet(f"{tmp_path}/ledger/data/batch=b1")  # a crash before the marker
    assert ledger.rows().count() == 5
    assert ledger.append(incoming(spark, 9), "b1")
    assert [r["seq"] for r in ledger.read("s").collect()] == list(range(1, 10))


def test_invalid_rows_and_corrupt_records_are_errors(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    with pytest.raises(Exception, match="invalid envelope"):
        ledger.append(incoming(spark, 3).withColumn("type", F.lit("Bad Type")), "b0")
    assert ledger.rows().count() == 0
    good = sequencing.appended(incoming(spark, 4)).withColumns({"recorded_at": F.lit("x"), "store_format_version": F.when(F.col("seq") == 2, "9").otherwise("1")})
    ledger.backend.append(good.where("seq != 3"), "b1")
    assert sorted(r["why"] for r in ledger.problems().collect()) == ["hole before it", "unknown store format"]
    with pytest.raises(errors.CorruptLedger):
        ledger.verify()


def test_numbering_across_blocks(spark):
    rows = spark.range(500).select(F.lit("s").alias("subscription"), F.concat(F.lit("i"), F.col("id")).alias("id"), (F.col("id") * 3).alias("arrival"))
    got = sequencing.numbered(rows, block=7).where((F.col("arrival") / 3 + 1) != F.col("seq"))
    assert got.count() == 0 and sequencing.numbered(rows.limit(0)).count() == 0


def test_pages(spark):
    rows = adapter.ledger(spark, SF).cache()
    assert pages.page_summary(rows, "clicks", 10**9).first().asDict() == {"n": 0, "cursor": 10**9, "has_more": False}
    n = rows.where("subscription = 'clicks'").count()
    assert pages.page_summary(rows, "clicks", 0, n).first().asDict() == {"n": n, "cursor": n, "has_more": False}
    assert pages.page_summary(rows, "clicks", 0, n - 1).first()["has_more"]
    top = [r["id"] for r in pages.newest(rows, max=30).collect()]
    assert len(top) == len(set(top)) == 30 and top == sorted(top, reverse=True)
    for bad in (0, -1, True, "5", 1.0):
        with pytest.raises(errors.InvalidBound):
            pages.page_after(rows, "clicks", 0, bad)
    with pytest.raises(errors.InvalidBound):
        pages.page_after(rows, "clicks", -1)


def test_names():
    for bad in ("../escape", "a/b", "", ".", "..", "UPPER", "with space", "-leading", "x" * 65, "a\n"):
        assert not STORED.fullmatch(bad) and not REGISTERED.fullmatch(bad)
    assert STORED.fullmatch("a..b") and not REGISTERED.fullmatch("a..b")
    assert address("h:1") == ("h", 1) and address("h") == ("h", 1883)
    for bad in ("h:x", "h:", ":1", "h:70000"):
        with pytest.raises(errors.InvalidAddress):
            address(bad)


def test_backlog(spark):
    rows = spark.range(1, 34).select(F.lit("s").alias("subscription"), F.col("id").alias("arrival"), F.concat(F.lit("events/"), F.col("id") % 2).alias("topic"), F.when(F.col("id") == 33, "").otherwise(F.col("id").cast("string")).alias("payload"), F.lit(True).alias("retain"), (F.col("id") % 3).cast("int").alias("qos"))
    assert sorted(r["arrival"] for r in backlog.kept_on_overflow(rows, 20).collect()) == list(range(1, 21))
    assert [(r["topic"], r["payload"]) for r in backlog.retained(rows).collect()] == [("events/0", "32")]
    assert backlog.captured(rows, F.lit(30)).count() == 2


def test_drain_and_cli(spark, tmp_path, capsys):
    root = str(tmp_path)
    run = lambda *a: (main(["--root", root, *a], spark), capsys.readouterr())
    assert run("sub", "add", "worker", "task.*")[0] == 0
    code, out = run("sub", "add", "worker", "task.*", "--json")
    assert code == 1 and json.loads(out.err)["error"] == "SubscriptionExists"
    assert run("sub", "add", "bad", "a/#")[0] == 1
    data = tmp_path / "d.json"
    data.write_text('{"n": 1}')
    for _ in range(3):
        assert run("emit", "task.done", "--data", str(data))[0] == 0
    assert run("emit", "Task.Done", "--data", str(data))[0] == 1
    from streamledger.sources.broker import Broker

    Broker(spark, root).publish(spark.createDataFrame([("events/task/x", "{bad", 0)], "topic string, payload string, k int"), "k")
    first = drain.drain_subscription(spark, root, "worker", max=2)
    assert (first.consumed, first.stored, first.cursor, first.has_more) == (2, 2, 2, True)
    code, out = run("watch", "worker", "--json", "--timeout", "120")
    got = json.loads(out.out)
    assert code == 0 and [r["seq"] for r in got["records"]] == [1, 2, 3] and len(got["skipped"]) == 1
    again = drain.drain_subscription(spark, root, "worker")
    assert (again.consumed, again.stored, again.cursor, again.stopped) == (0, 0, 0, "timeout")  # nothing taken: the cursor is the caller's own
    assert drain.drain_subscription(spark, root, "worker", since=2).cursor == 2
    assert (got["cursor"], got["consumed"], got["stopped"], got["sessionPresent"]) == (3, 2, "timeout", True)
    id_ = got["records"][0]["event"]["id"]
    assert run("get", id_)[0] == 0 and run("get", "evt_none")[0] == 1
    assert json.loads(run("list", "--json", "--max", "2")[1].out)["events"][0]["seq"] == 3
    assert run("list", "--max", "0")[0] == 1 and run("watch", "nobody")[0] == 1
    assert run("sub", "show", "worker")[0] == 0 and run("sub", "remove", "worker")[0] == 0 and run("sub", "list")[1].out.strip() == ""


def test_events_survive_lost_checkpoints_and_new_subscriptions(spark, tmp_path):
    root, rows = str(tmp_path), adapter.envelopes(adapter.events(spark, SF)).where("type rlike '^click[.][^.]+$'")
    first, second = rows.orderBy("arrival").limit(4), rows.orderBy(F.desc("arrival")).limit(3)
    files = drain.Files(spark, root)
    drain.add_subscription(spark, root, "clicks", "click.*")
    drain.emit(spark, root, first, "arrival")
    one = drain.drain_subscription(spark, root, "clicks", timeout=120)
    assert (one.consumed, one.stored, one.cursor, [r["seq"] for r in one.records]) == (4, 4, 4, [1, 2, 3, 4])
    # The checkpoint is lost: messages come again, nothing is stored twice, and each is told with its number.
    files.delete("checkpoints/clicks")
    again = drain.drain_subscription(spark, root, "clicks", timeout=120)
    assert (again.consumed, again.stored, again.cursor, [r["seq"] for r in again.records], again.session_present) == (4, 0, 4, [1, 2, 3, 4], False)
    # Removed and added again: what is published from then on is stored.
    drain.remove_subscription(spark, root, "clicks")
    drain.add_subscription(spark, root, "clicks", "click.*")
    drain.emit(spark, root, second, "arrival")
    new = drain.drain_subscription(spark, root, "clicks", timeout=120)
    assert (new.consumed, new.stored, new.cursor) == (3, 3, 7) and drain.Ledger(spark, root).rows().count() == 7


def test_stale_locks_are_taken_over(spark, tmp_path):
    files = drain.Files(spark, str(tmp_path))
    with drain.only_drainer(files, "a", 10), pytest.raises(errors.SubscriptionBusy), drain.only_drainer(files, "a", 10):
        pass
    files.create("locks/a", "5.0 crashed")
    with drain.only_drainer(files, "a", 10):
        assert files.exists("locks/a")
    assert not files.exists("locks/a")


def test_wrong_calls_are_the_callers(capsys):
    for call in (["nothing"], ["watch"], ["sub", "add", "x"]):
        with pytest.raises(SystemExit) as stopped:
            main(call)
        assert stopped.value.code == 1 and "error" in capsys.readouterr().err


def test_gaps_across_blocks(spark):
    held = [1, 2, 4, 5, 8, 9, 10, 20, 21]
    rows = spark.createDataFrame([("s", k) for k in held] + [("t", 3)], "subscription string, seq bigint")
    for block in (1, 3, 4, 1000):
        assert {tuple(r) for r in sequencing.gaps(rows, block).collect()} == {("s", 4, 2), ("s", 8, 5), ("s", 20, 10), ("t", 3, 0)}


def test_reads_prune_and_push_down(spark):
    rows = adapter.stored(spark, SF)
    plan = pages.page_after(rows, "clicks", 40)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(seq,40)" in plan and "PartitionFilters: [isnotnull(subscription" in plan and "clicks" in plan
    assert "EqualTo(id,x)" in pages.by_id(rows, "x")._jdf.queryExecution().executedPlan().toString()


def test_repeated_drains_take_the_whole_backlog(spark, tmp_path):
    from pyspark.sql.datasource import InputPartition

    from streamledger.sources.broker import BacklogReader

    root, rows = str(tmp_path), adapter.envelopes(adapter.events(spark, SF))
    drain.add_subscription(spark, root, "clicks", "click.*")
    drain.emit(spark, root, rows.where("arrival <= 600"), "arrival")
    drain.emit(spark, root, rows.where("arrival > 600"), "arrival")
    reader = BacklogReader({"path": f"{root}/broker", "filter": "events/click/+", "max": "70"})
    parts = reader.partitions({"arrival": 0}, {"arrival": 10**9})
    assert len(parts) >= 2 and all(isinstance(p, InputPartition) for p in parts)  # tasks read, not the driver
    want = [r["id"] for r in rows.where("type rlike '^click[.][^.]+$'").orderBy("arrival").collect()]
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == len(want) > 140
    total = drain.drain_all(spark, root, "clicks", max=70, timeout=120)
    assert (total.consumed, total.stored, total.cursor, total.has_more) == (len(want), len(want), len(want), False)
    assert [(r["seq"], r["id"]) for r in drain.Ledger(spark, root).rows().orderBy("seq").collect()] == list(enumerate(want, 1))


def test_stream_sequence_equals_batch(spark, tmp_path):
    stateful.use_rocksdb(spark)
    rows = adapter.matched(spark, SF).where("subscription in ('clicks', 'retries')").select("subscription", "arrival", "id")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = stateful.sequenced(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.format("memory").queryName("numbered").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = adapter.ledger(spark, SF).where("subscription in ('clicks', 'retries')").select("subscription", "seq", "id")
    assert spark.table("numbered").exceptAll(want).count() == 0 and spark.table("numbered").count() == want.count()


def test_import_lines(spark, tmp_path):
    event = {"id": "e1", "type": "a.b", "source": "x:y", "time": "2026-01-01T00:00:00Z", "schemaVersion": "1", "data": {}}
    line = lambda n, e: json.dumps({"storeFormatVersion": "1", "seq": n, "subscription": "s", "recordedAt": "t", "event": e})
    f = tmp_path / "s.jsonl"
    f.write_text(line(1, event) + "\n" + line(2, event | {"id": "e2"}) + "\n" + '{"storeFormat')
    assert sorted((r["seq"], r["id"]) for r in import_lines(spark, str(f)).collect()) == [(1, "e1"), (2, "e2")]
    good = json.loads(line(2, event))
    bad = ['{"storeFormat', line(0, event), line("x", event), line(2, event | {"type": "A"}), *(json.dumps({k: v for k, v in good.items() if k != gone}) for gone in good), json.dumps(good | {"storeFormatVersion": "9"})]
    bad += [json.dumps(good | {"seq": x}) for x in ("2", True, 2.0, 1 << 63)] + ["[1]", line(2, event | {"data": {"x": float("nan")}})]
    for text in bad:
        f.write_text(text + "\n" + line(2, event) + "\n")
        with pytest.raises(Exception, match="corrupt record"):
            import_lines(spark, str(f)).collect()


def test_import_keeps_what_the_line_says(spark, tmp_path):
    odd = '{"id":"gone","id":"e1","type":"a.b","source":"x:y","time":"2026-01-01T00:00:00Z","schemaVersion":"1","data":{"n":123456789012345678901234567890,"x":1.0,"s":"a\\u00e9\\/","x":2.50}}'
    f = tmp_path / "s.jsonl"
    f.write_text('{"storeFormatVersion":"1","seq":1,"subscription":"s","recordedAt":"t","event":' + odd + "}\n" + '{"storeFormatVersion":"1","seq":2,"subscription":"s","recordedAt":"t","event":' + odd.replace("e1", "e2") + "}")
    rows = import_lines(spark, str(f)).orderBy("seq")
    want = parse_payloads(spark.createDataFrame([(odd,)], "payload string")).select("event.data").first()["data"]
    assert [(r["seq"], r["id"], r["data"]) for r in rows.collect()] == [(1, "e1", want), (2, "e2", want)]
    assert "123456789012345678901234567890" in want and set(rows.columns) == {"seq", "recorded_at", "store_format_version", "subscription", *ENVELOPE.names}


def test_liveness_batch_form(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 9), ("b", 2)], "producer string, at bigint")
    assert {r["producer"]: r["online"] for r in stateful.last_seen(rows, 10, 3).collect()} == {"a": True, "b": False}


def test_a_range_of_numbers_is_no_single_task(spark, tmp_path):
    """Rows of one subscription that a task would hold are dealt to several once they are more than adaptive execution's advised size."""
    from streamledger.sources.committed import set_for
    from streamledger.sources.ledger_table import LedgerTable

    k = F.col("id")
    event = {n: F.lit(None).cast("string") for n in LedgerTable(spark, f"file://{tmp_path}/none").schema.names}
    rows = spark.range(0, 40_000, 1, 8).select(*[(F.lit("s") if n == "subscription" else (k + 1) if n == "seq" else F.sha2(k.cast("string"), 256) if n in ("id", "data") else c).alias(n) for n, c in event.items()])
    with set_for(spark, spark__sql__adaptive__advisoryPartitionSizeInBytes="256k"):
        LedgerTable(spark, f"file://{tmp_path}/l").append(rows, "b")
    got = LedgerTable(spark, f"file://{tmp_path}/l").read()
    assert got.select(F.input_file_name()).distinct().count() > 2
    assert got.agg(F.count("*"), F.countDistinct("seq"), F.max("seq")).first()[:] == (40_000, 40_000, 40_000)


def test_imported_lines_are_not_shuffled(spark, tmp_path):
    """Lines meet the ends of their files, a row each, by a broadcast, whatever the threshold: parsed records of all files are not sorted."""
    from streamledger.operators.ledger import import_lines
    from streamledger.sources.committed import set_for

    spark.createDataFrame([('{"storeFormatVersion":"1","se',)], "value string").write.text(f"{tmp_path}/lines")
    with set_for(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        rows = import_lines(spark, f"{tmp_path}/lines")
        assert rows.count() == 0 and "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
