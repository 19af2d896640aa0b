"""RFC 3339 times in UTC, kept as text and checked as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})\z"
FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def format_time(ts: Column) -> Column:
    return F.date_format(ts, FORMAT)


def now() -> Column:
    return format_time(F.current_timestamp())


def _offset(value: Column) -> Column:
    return F.regexp_extract(value, r"([+-][0-9]{2}:[0-9]{2})\z", 1)


def parse_time(value: Column) -> Column:
    """The instant, to the microsecond, of a valid time; null for others."""
    clock = F.regexp_extract(F.upper(value), r"\A([0-9-]{10}T[0-9:]{8}(\.[0-9]{1,6})?)", 1)
    return F.when(time_problem(value).isNull(), F.try_to_timestamp(F.concat(clock, F.lit("Z"))))


def time_problem(value: Column) -> Column:
    """Code of what is wrong: empty, malformed (shape, or no real date and time) or not_utc; null if nothing."""
    clock = F.regexp_extract(value, r"\A([0-9-]{10})[Tt]([0-9:]{8})", 0)
    real = F.try_to_timestamp(F.concat(F.upper(clock), F.lit("Z"))).isNotNull() & (F.substring(value, 1, 4) > "0000")
    hours, minutes = F.substring(_offset(value), 2, 2).cast("int"), F.substring(_offset(value), 5, 2).cast("int")
    offset_real = (_offset(value) == "") | ((hours < 24) & (minutes < 60))
    return (
        F.when(value == "", "empty")
        .when(~value.rlike(SHAPE), "malformed")
        .when(~(real & offset_real), "malformed")
        .when((_offset(value) != "") & ((hours != 0) | (minutes != 0)), "not_utc")
    )
