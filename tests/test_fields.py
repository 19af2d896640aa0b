"""Accept and reject tables of the field rules and of whole payloads."""

import json

import pytest
from pyspark.sql import functions as F

from streamledger.errors import ERROR_CODES
from streamledger.functions import fields, ids, times, topics, wire

GOOD = {"id": "evt_1", "type": "task.requested", "source": "agent://builder", "time": "2026-07-23T15:00:00Z", "schemaVersion": "1", "data": {"a": 1}}
TRACE = "00-4bf92f3577b34da6a3ce929d0e0e4736-00f067aa0ba902b7-01"
TIMES = {"": "empty", "2026-07-23": "malformed", "2026-07-23T15:00:00": "malformed", "2026-07-23 15:00:00Z": "malformed", "2026-13-01T00:00:00Z": "malformed", "2026-01-01T25:00:00Z": "malformed", "2026-02-29T00:00:00Z": "malformed", "0000-01-01T00:00:00Z": "malformed", "2026-01-01T00:00:00+02:00": "not_utc", "2026-01-01T00:00:00-05:00": "not_utc", "2026-01-01T00:00:00Z\n": "malformed", "2026-01-01T00:00:00Z": None, "2026-01-01t00:00:00z": None, "2026-01-01T00:00:00.123456789Z": None, "2026-01-01T00:00:00+00:00": None, "2024-02-29T00:00:00-00:00": None}
TYPES = {"": "empty", "Task": "malformed", "a b": "malformed", "a..b": "malformed", ".a": "malformed", "a.": "malformed", "a/b": "malformed", "a\n": "malformed", "a" * 200: "too_long", "a.b-c_d.9": None, "single": None}
SOURCES = {"": "empty", "builder": "malformed", "/a/b": "malformed", "a b://x": "malformed", "agent://" + "x" * 600: "too_long", "agent://x": None, "urn:x": None, "https://x/y": None}
VERSIONS = {"": "empty", "v1": "malformed", "1.": "malformed", "١": "malformed", "1" * 33: "too_long", "1": None, "1.3": None}
TRACES = {"": "empty", TRACE[:-3]: "malformed", TRACE.upper(): "malformed", f"ff{TRACE[2:]}": "malformed", f"00-{'0' * 32}-00f067aa0ba902b7-01": "malformed", f"{TRACE[:36]}{'0' * 16}-01": "malformed", TRACE: None}


@pytest.mark.parametrize("rule, table", [(times.time_problem, TIMES), (topics.type_problem, TYPES), (fields.source_problem, SOURCES), (fields.schema_version_problem, VERSIONS), (fields.traceparent_problem, TRACES)])
def test_rules(spark, rule, table):
    rows = spark.createDataFrame([(v, c) for v, c in table.items()], "value string, code string").select("value", "code", rule(F.col("value")).alias("got")).collect()
    assert {r["value"]: r["got"] for r in rows} == table


PAYLOADS = [
    (json.dumps(GOOD), ""),
    ("{nope", "envelope:not_json"),
    (json.dumps(GOOD) + " trailing", "envelope:not_json"),
    ("", "envelope:not_json"),
    (None, "envelope:not_json"),
    ("[1]", "envelope:not_an_object"),
    (json.dumps({"event_type": 1, "runID": 2}), "event_type:unknown_field,runID:unknown_field,id:missing,type:missing,source:missing,time:missing,schemaVersion:missing,data:missing"),
    (json.dumps(GOOD | {"correlationId": None, "traceparent": None}), ""),
    (json.dumps(GOOD | {"time": None, "data": None}), "time:not_a_string,data:not_an_object"),
    (json.dumps(GOOD | {"deliveryAttempt": 0}), "deliveryAttempt:out_of_range"),
    (json.dumps(GOOD | {"deliveryAttempt": True}), "deliveryAttempt:not_an_integer"),
    (json.dumps(GOOD | {"deliveryAttempt": 1.0}), "deliveryAttempt:not_an_integer"),
    (json.dumps(GOOD | {"deliveryAttempt": 10**40}), ""),
    (json.dumps(GOOD | {"id": 7, "producer": "a b"}), "id:not_a_string,producer:malformed"),
    (json.dumps(GOOD | {"data": {"outer": {"items": [1, {"bad": float("nan")}]}}}), "data.outer.items[1].bad:malformed"),
    (json.dumps(GOOD | {"data": [1]}), "data:not_an_object"),
    (json.dumps(GOOD)[:-1] + ', "id": "evt_2"}', ""),
]


def test_payloads(spark):
    rows = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(PAYLOADS)], "k int, payload string")
    got = {r["k"]: r for r in wire.parse_payloads(rows).collect()}
    assert [",".join(f"{e['field']}:{e['code']}" for e in got[k]["errors"]) for k in range(len(PAYLOADS))] == [c for _, c in PAYLOADS]
    assert all(e["code"] in ERROR_CODES for r in got.values() for e in r["errors"])
    assert got[0]["event"]["data"] == '{"a":1}' and got[len(PAYLOADS) - 1]["event"]["id"] == "evt_2"
    assert "runId" in [e["message"] for e in got[6]["errors"]][1]


def test_nesting(spark):
    deep = lambda n: {} if n == 0 else {"k": deep(n - 1)}
    rows = spark.createDataFrame([(n, json.dumps(GOOD | {"data": deep(n)})) for n in (31, 32, 80)], "n int, payload string")
    got = {r["n"]: [e["code"] for e in r["errors"]] for r in wire.parse_payloads(rows).collect()}
    assert got == {31: [], 32: ["too_deep"], 80: ["too_deep"]}


def test_typed_and_raw_agree(spark):
    raw = spark.createDataFrame([(json.dumps(GOOD | {"type": t, "source": s}),) for t in TYPES for s in SOURCES], "payload string")
    parsed = wire.parse_payloads(raw).select(F.get_json_object("payload", "$.type").alias("type"), F.get_json_object("payload", "$.source").alias("source"), "errors")
    none = F.lit(None).cast("string")
    cols = {"id": F.lit("x"), "time": F.lit(GOOD["time"]), "schema_version": F.lit("1"), "data": F.lit("{}"), "delivery_attempt": F.lit(None).cast("bigint"), **dict.fromkeys(["correlation_id", "causation_id", "run_id", "traceparent", "producer"], none)}
    codes = lambda c: F.transform(c, lambda e: F.concat(e["field"], F.lit(":"), e["code"]))
    assert parsed.withColumn("typed", wire.typed_problems(cols)).where(codes("errors") != codes("typed")).count() == 0


def test_wire_round_trip(spark):
    rows = spark.createDataFrame([(json.dumps(GOOD | {"deliveryAttempt": 3, "runId": "r", "data": {"z": None, "a": 2.0, "n": 10**30}}),)], "payload string")
    once = wire.parse_payloads(rows).select("event.*")
    again = wire.parse_payloads(once.select(wire.to_wire_json().alias("payload"))).select("event.*")
    assert once.collect() == again.collect()
    assert json.loads(once.select(wire.to_wire_json().alias("w")).first()["w"])["data"] == {"z": None, "a": 2.0, "n": 10**30}


def test_ids(spark):
    row = spark.range(3).select(ids.new_ids().alias("id")).collect()
    assert len({r["id"] for r in row}) == 3 and all(len(r["id"]) == 30 for r in row)
    one = spark.sql("select timestamp_millis(1234567890123) as ts").select(ids.ulid_millis(ids.ulid_time(F.col("ts"))).alias("m"), ids.ulid_millis(F.lit("U")).alias("bad")).first()
    assert one["m"] == 1234567890123 and one["bad"] is None
