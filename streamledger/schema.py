"""Schemas of envelopes, messages, ledger records and subscriptions."""

from __future__ import annotations

from pyspark.sql import types as T

#: Column of a field, its wire name, and whether an event must have it; in wire order.
FIELDS = [
    ("id", "id", True),
    ("type", "type", True),
    ("source", "source", True),
    ("time", "time", True),
    ("schema_version", "schemaVersion", True),
    ("correlation_id", "correlationId", False),
    ("causation_id", "causationId", False),
    ("run_id", "runId", False),
    ("traceparent", "traceparent", False),
    ("producer", "producer", False),
    ("delivery_attempt", "deliveryAttempt", False),
    ("data", "data", True),
]
WIRE_NAMES = [wire for _, wire, _ in FIELDS]

ENVELOPE = T.StructType([T.StructField(name, T.LongType() if name == "delivery_attempt" else T.StringType()) for name, _, _ in FIELDS])

MESSAGE = "arrival bigint, topic string, payload string, mid int, qos int, retain boolean, dup boolean"

STORE_FORMAT_VERSION, REGISTRY_FORMAT_VERSION = "1", "1"

#: The ledger's table; subscription is its partition column, always read as text.
LEDGER = T.StructType([T.StructField("seq", T.LongType()), T.StructField("recorded_at", T.StringType()), T.StructField("store_format_version", T.StringType()), *ENVELOPE.fields, T.StructField("batch", T.StringType()), T.StructField("subscription", T.StringType())])

SUBSCRIPTION = T.StructType([T.StructField(n, T.StringType()) for n in ("registryFormatVersion", "name", "pattern", "filter", "owner", "clientId", "created")])

ERRORS = "array<struct<field:string,code:string,message:string>>"
