"""Types, topics, patterns and filters as columns.

A type `task.requested` has the topic `events/task/requested`; a pattern is a
type in which `*` stands for exactly one segment. `topic_matches` takes any MQTT
filter, including `#` and filters that no pattern gives.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "events/"
MAX_TYPE = 128
TYPE = r"\A[a-z0-9]+([._-][a-z0-9]+)*\z"


def text_problem(value: Column, limit: int | None, grammar: str) -> Column:
    """Code of what is wrong with a text, null if nothing: empty, too_long or malformed."""
    long = F.lit(False) if limit is None else F.char_length(value) > limit
    return F.when(value == "", "empty").when(long, "too_long").when(~value.rlike(grammar), "malformed")


def type_problem(value: Column) -> Column:
    return text_problem(value, MAX_TYPE, TYPE)


def type_to_topic(value: Column) -> Column:
    """The topic of a valid type, null for others."""
    return F.when(type_problem(value).isNull(), F.concat(F.lit(PREFIX), F.replace(value, F.lit("."), F.lit("/"))))


def topic_problem(topic: Column) -> Column:
    """Topics outside the lane, with empty levels, or whose levels make no valid type."""
    rest = F.substring(topic, len(PREFIX) + 1, 1 << 30)
    lane = F.when(topic == "", "empty").when(~in_lane(topic), "malformed")
    levels = F.when(F.exists(F.split(rest, "/", -1), lambda x: x == ""), "malformed")
    return F.coalesce(lane, levels, type_problem(F.replace(rest, F.lit("/"), F.lit("."))))


def topic_to_type(topic: Column) -> Column:
    """The type of a valid topic of the lane, null for others."""
    return F.when(topic_problem(topic).isNull(), F.replace(F.substring(topic, len(PREFIX) + 1, 1 << 30), F.lit("/"), F.lit(".")))


def in_lane(topic: Column) -> Column:
    return topic.startswith(PREFIX)


def pattern_problems(pattern: Column) -> Column:
    """Codes of everything wrong with a pattern: raw filter characters alone, or a code for each bad segment in order."""
    each = F.transform(F.split(pattern, r"\.", -1), lambda s: F.when(s != "*", type_problem(s)))
    segments = F.filter(each, lambda c: c.isNotNull())
    return F.when(pattern == "", F.array(F.lit("empty"))).when(pattern.rlike("[#+/]"), F.array(F.lit("reserved_mqtt_char"))).otherwise(segments)


def pattern_to_filter(pattern: Column) -> Column:
    """The filter of a valid pattern, null for others."""
    levels = F.transform(F.split(pattern, r"\.", -1), lambda s: F.when(s == "*", "+").otherwise(s))
    return F.when(F.size(pattern_problems(pattern)) == 0, F.concat(F.lit(PREFIX), F.array_join(levels, "/")))


def levels(path: Column) -> Column:
    return F.split(path, "/", -1)


def topic_matches(filter_: Column, topic: Column) -> Column:
    """Whether an MQTT filter matches a topic: + is one level (also an empty one), a closing # is what is left, none included."""
    want, have = levels(filter_), levels(topic)
    hash_at = F.array_position(want, F.lit("#"))
    n = F.when(hash_at > 0, hash_at - 1).otherwise(F.size(want)).cast("int")
    numbered = F.transform(F.slice(want, 1, n), lambda x, k: F.struct(x.alias("want"), k.alias("at")))
    fits = F.forall(numbered, lambda x: (x["want"] == "+") | x["want"].eqNullSafe(F.get(have, x["at"])))
    size = F.when(hash_at > 0, (hash_at == F.size(want)) & (F.size(have) >= n)).otherwise(F.size(have) == n)
    return size & fits
