"""Field rules of the envelope as columns: each gives a code, null if the value is valid. Grammars end at the end of the text, not before a last line break."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from streamledger.functions.times import time_problem
from streamledger.functions.topics import MAX_TYPE, TYPE, text_problem, type_problem

#: Grammars of the envelope's fields, and white space that no source may have.
IDENTIFIER = r"\A[A-Za-z0-9][A-Za-z0-9._:+/=@-]*\z"
SCHEMA_VERSION = r"\A[0-9]+(\.[0-9]+)*\z"
SOURCE = r"\A[A-Za-z][A-Za-z0-9+.-]*:"
TRACEPARENT = r"\A(?!ff)[0-9a-f]{2}-(?!0{32})[0-9a-f]{32}-(?!0{16})[0-9a-f]{16}-[0-9a-f]{2}\z"
WHITE_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"

#: Length and grammar of each field with text; None for no limit. Columns and single events take their rules from here.
TEXTS: dict[str, tuple[int | None, str]] = {
    "id": (128, IDENTIFIER),
    "type": (MAX_TYPE, TYPE),
    "source": (512, SOURCE),
    "schema_version": (32, SCHEMA_VERSION),
    "correlation_id": (128, IDENTIFIER),
    "causation_id": (128, IDENTIFIER),
    "run_id": (128, IDENTIFIER),
    "traceparent": (None, TRACEPARENT),
    "producer": (128, IDENTIFIER),
}


def identifier_problem(value: Column) -> Column:
    return text_problem(value, *TEXTS["id"])


def source_problem(value: Column) -> Column:
    return F.coalesce(text_problem(value, *TEXTS["source"]), F.when(value.rlike(WHITE_SPACE), "malformed"))


def schema_version_problem(value: Column) -> Column:
    return text_problem(value, *TEXTS["schema_version"])


def traceparent_problem(value: Column) -> Column:
    return text_problem(value, *TEXTS["traceparent"])


def delivery_attempt_problem(value: Column) -> Column:
    return F.when(value < 1, "out_of_range")


#: The rule of each field that has text or, for delivery_attempt, a whole number.
RULES = {
    "id": identifier_problem,
    "type": type_problem,
    "source": source_problem,
    "time": time_problem,
    "schema_version": schema_version_problem,
    "correlation_id": identifier_problem,
    "causation_id": identifier_problem,
    "run_id": identifier_problem,
    "traceparent": traceparent_problem,
    "producer": identifier_problem,
    "delivery_attempt": delivery_attempt_problem,
}

#: What a code says to the sender.
MESSAGES = {
    "missing": "is required",
    "unknown_field": "is not part of an envelope; producers' own values belong in data",
    "not_an_object": "must be a JSON object",
    "not_json": "is not valid JSON",
    "not_a_string": "must be a string",
    "not_an_integer": "must be an integer",
    "empty": "must not be empty",
    "too_long": "is too long",
    "too_deep": "nests deeper than 32 levels",
    "malformed": "does not have the form that this field asks for",
    "not_utc": "must be in UTC",
    "out_of_range": "must be 1 or greater",
    "unsupported_type": "is not a JSON value",
}
