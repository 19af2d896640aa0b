"""Single events and columns have one set of rules: every code, in both."""

import json
import random

import pytest
from pyspark.sql import functions as F

from streamledger.errors import ERROR_CODES, InvalidEnvelope
from streamledger.functions import topics
from streamledger.functions.envelope import Envelope, new_id
from streamledger.functions.fields import RULES
from streamledger.functions.rules import problems_of, take_apart, text_code
from streamledger.functions.wire import parse_payloads

GOOD = {"id": "e1", "type": "a.b", "source": "x:y", "time": "2026-01-01T00:00:00Z", "schemaVersion": "1", "data": {"n": 1}}
VALUES = {
    "id": ["a", "", "x" * 128, "x" * 129, "a b", "-a", "é", "a\n", 5, None, True, "A0._:+/=@-"],
    "type": ["a", "", "a.b-c_d", "A.b", "a..b", ".a", "a." * 80, "a.b\n", None, []],
    "source": ["x:", "", "x:y z", "1x:y", "x:\u00a0", "x:\u2028y", "x" * 511 + ":", "x" * 512 + ":", None, 1.5],
    "time": ["", "2026-01-01T00:00:00Z", "2026-02-30T00:00:00Z", "2026-01-01t00:00:00.1234567z", "2026-01-01T00:00:00+02:00", "2026-01-01T00:00:00-00:00", "2026-01-01T24:00:00Z", "2026-01-01T00:00:60Z", "0000-01-01T00:00:00Z", "0001-01-01T00:00:00Z", "2026-01-01T00:00:00+99:00", "2026-01-01T00:00:00+10:60", "2026-01-01 00:00:00Z", "٢٠٢٦-01-01T00:00:00Z", None, 7],
    "schemaVersion": ["1", "1.0", "", "1.", "v1", "1" * 33, "١", None, 1],
    "correlationId": ["c", "", "c c", None, {}],
    "traceparent": ["00-4bf92f3577b34da6a3ce929d0e0e4736-00f067aa0ba902b7-01", "ff-4bf92f3577b34da6a3ce929d0e0e4736-00f067aa0ba902b7-01", "00-" + "0" * 32 + "-00f067aa0ba902b7-01", "", "x" * 200, None],
    "deliveryAttempt": [1, 0, -3, 1.0, True, "1", None, 10**30],
    "data": [{}, {"a": [1, {"b": None}]}, [], None, "x", 1],
    "run_id": ["r"], "RUNID": [1], "else": [None], "causation-id": ["c"],
}


def payloads(n, seed):
    draw = random.Random(seed)
    out = ["", "{", "[1]", "null", '"x"', '{"id":"a","id":"b"}', json.dumps(GOOD)[:-1] + ',"data":{"x":NaN,"y":[1,Infinity]}}', json.dumps(GOOD | {"data": json.loads('{"a":' * 40 + "1" + "}" * 40)})]
    for _ in range(n):
        whole = dict(GOOD)
        for _ in range(draw.randint(0, 4)):
            key = draw.choice(list(VALUES))
            whole[key] = draw.choice(VALUES[key])
        for _ in range(draw.choice([0, 0, 1, 2])):
            whole.pop(draw.choice(list(GOOD)), None)
        keys = list(whole)
        draw.shuffle(keys)
        out.append(json.dumps({k: whole[k] for k in keys}, ensure_ascii=draw.random() < 0.5))
    return out


def test_columns_and_single_events_agree(spark):
    texts = payloads(1500, 1)
    rows = parse_payloads(spark.createDataFrame(list(enumerate(texts)), "n int, payload string")).select("n", "errors").collect()
    columns = {r["n"]: [(e["field"], e["code"], e["message"]) for e in r["errors"]] for r in rows}
    alone = {k: [(p.field, p.code, p.message) for p in problems_of(take_apart(t))] for k, t in enumerate(texts)}
    assert columns == alone
    codes = {c for p in alone.values() for _, c, _ in p}
    # one code is of patterns, one of values that no JSON text has
    assert codes | {"reserved_mqtt_char", "unsupported_type"} == set(ERROR_CODES)
    assert spark.range(1).select(topics.pattern_problems(F.lit("a.#"))).first()[0] == ["reserved_mqtt_char"]
    for k, t in enumerate(texts):
        if columns[k]:
            with pytest.raises(InvalidEnvelope) as stopped:
                Envelope.from_json(t)
            assert [(e.field, e.code, e.message) for e in stopped.value.errors] == columns[k]
        else:
            back = Envelope.from_json(Envelope.from_json(t).to_json())
            assert back == Envelope.from_json(t) and back.problems() == []


def test_column_rules_are_the_plain_ones(spark):
    """Each rule over typed columns gives the code that the plain one gives."""
    draw = random.Random(3)
    names = {"schema_version": "schemaVersion", "correlation_id": "id", "causation_id": "id", "run_id": "id", "producer": "id"}
    for name in RULES:
        if name == "delivery_attempt":
            continue
        values = [v for v in VALUES[names.get(name, name)] if isinstance(v, str)]
        for v in values[:]:
            for _ in range(15):
                at = draw.randint(0, len(v))
                values.append(v[:at] + draw.choice(["", "a", "0", ".", "..", "-", " ", "\n", "\r", "Z", "é", "\u00a0", "\u2028", "\u0085", "\x1c", "+", "/", "#"]) + v[at + draw.randint(0, 2) :])
        rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", RULES[name](F.col("v")).alias("code")).collect()
        assert [(r["v"], r["code"]) for r in rows if r["code"] != text_code(name, r["v"])] == [], name


def test_made_events():
    one = Envelope.new("task.done", "app://x", {"a": [1]}, producer="p")
    assert one.to_dict() == {"id": one.id, "type": "task.done", "source": "app://x", "time": one.time, "schemaVersion": "1", "producer": "p", "data": {"a": [1]}}
    assert Envelope.from_dict(one.to_dict()) == one and hash(one) == hash(Envelope.from_dict(one.to_dict() | {"data": {}}))
    assert len({new_id() for _ in range(1000)}) == 1000 and len(one.id) == len("evt_") + 26
    with pytest.raises(InvalidEnvelope) as stopped:
        Envelope.new("Bad", "no scheme", {"a": {1, 2}, "b": float("nan"), 3: 4, "c": [object()]})
    assert [(e.field, e.code) for e in stopped.value.errors] == [("type", "malformed"), ("source", "malformed"), ("data.a", "unsupported_type"), ("data.b", "malformed"), ("data", "unsupported_type"), ("data.c[0]", "unsupported_type")]
    for bad, code in ((None, "not_an_object"), ([], "not_an_object"), ("x", "not_an_object")):
        with pytest.raises(InvalidEnvelope) as stopped:
            Envelope.from_dict(bad)
        assert stopped.value.errors[0].code == code
