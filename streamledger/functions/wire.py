"""The wire form: payloads to typed fields with every problem in one pass, and envelopes to JSON.

One Arrow step reads and judges payloads (see `rules`) and gives typed fields; all rules
on fields are columns of `fields` too, for typed rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamledger.functions.fields import MESSAGES, RULES
from streamledger.functions.rules import fields_apart, problems_of, record_apart, take_apart
from streamledger.schema import ENVELOPE, ERRORS, FIELDS

EVENT = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in ENVELOPE.fields) + ">"
JUDGED = f"event {EVENT}, errors {ERRORS}"
RECORD = f"problem string, seq bigint, subscription string, recorded_at string, {JUDGED}"

_EVENT = pa.struct([(n, pa.int64() if n == "delivery_attempt" else pa.string()) for n, _, _ in FIELDS])
_ERRORS = pa.list_(pa.struct([("field", pa.string()), ("code", pa.string()), ("message", pa.string())]))
_JUDGED = pa.struct([("event", _EVENT), ("errors", _ERRORS)])
_RECORD = pa.struct([("problem", pa.string()), ("seq", pa.int64()), ("subscription", pa.string()), ("recorded_at", pa.string()), ("event", _EVENT), ("errors", _ERRORS)])
#: The largest whole number that a column holds.
LARGEST = (1 << 63) - 1


def judged(apart: dict) -> dict:
    """A payload taken apart as its typed fields, none if it is invalid, and its problems. A delivery attempt beyond a column's range is left out."""
    errors = [vars(p) for p in problems_of(apart)]
    if errors:
        return {"event": None, "errors": errors}
    texts = apart["texts"]
    event = {n: texts.get(w) for n, w, _ in FIELDS}
    attempt = event["delivery_attempt"]
    event["delivery_attempt"] = int(attempt) if attempt is not None and int(attempt) <= LARGEST else None
    return {"event": event, "errors": []}


def _payloads(payloads: pa.Array) -> pa.Array:
    return pa.array([judged(take_apart(p)) for p in payloads.to_pylist()], _JUDGED)


def _records(lines: pa.Array) -> pa.Array:
    found = (record_apart(x) for x in lines.to_pylist())
    return pa.array([r if r["problem"] else r | judged(r["event"]) for r in found], _RECORD)


def problem(field: Column, code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    return F.when(code.isNotNull(), F.struct(field.alias("field"), code.alias("code"), table[code].alias("message")))


def parse_payloads(messages: DataFrame, payload_col: str = "payload") -> DataFrame:
    """messages with `event` (the envelope's fields as a struct, null if invalid) and `errors`."""
    out = messages.withColumn("judged", F.arrow_udf(_payloads, JUDGED)(F.col(payload_col)))
    return out.withColumns({"event": F.col("judged.event"), "errors": F.col("judged.errors")}).drop("judged")


def parse_records(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Stored lines with `record` (problem, seq, subscription, recorded_at), and `event` and `errors` of the event inside, read from the line itself."""
    out = lines.withColumn("record", F.arrow_udf(_records, RECORD)(F.col(line_col)))
    return out.withColumns({"event": F.col("record.event"), "errors": F.col("record.errors"), "record": F.col("record").dropFields("event", "errors")})


def typed_problems(columns: dict[str, Column] | None = None) -> Column:
    """All problems of a typed row: a null is an absent field, data is taken as checked."""
    col = lambda name: (columns or {}).get(name, F.col(name))
    gone = [problem(F.lit(wire), F.when(col(name).isNull(), "missing")) for name, wire, required in FIELDS if required]
    wrong = [problem(F.lit(wire), RULES[name](col(name))) for name, wire, _ in FIELDS if name in RULES]
    return F.filter(F.array(*gone, *wrong), lambda p: p.isNotNull())


def wire_struct() -> Column:
    """Envelope columns under their wire names; data is parsed, so that it nests."""
    return F.struct(*[(F.parse_json(F.col(name)) if name == "data" else F.col(name)).alias(wire) for name, wire, _ in FIELDS])


def to_wire_json() -> Column:
    """Compact JSON of the envelope columns: absent fields are left out, data goes out as it is stored."""
    head = F.to_json(F.struct(*[F.col(name).alias(wire) for name, wire, _ in FIELDS if name != "data"]))
    return F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(',"data":'), F.col("data"), F.lit("}"))
