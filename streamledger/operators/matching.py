"""Fan-out of events to subscriptions whose filter matches their topic, through an index of filters.

A filter's shape says which of its levels are wildcards, and whether it ends in `#`. A
topic and a shape have one filter in common at most: the topic's own levels, with `+`
where the shape has a wildcard. So every distinct topic is turned into the filters that
could match it, one for each shape in use that is as long (or, with `#`, no longer), and
these meet the subscriptions' filters in a hash join. What is looked at grows with topics
times shapes, not with topics times subscriptions: 100,000 subscriptions on one device
each have one shape. Nothing is tested after the join.

Null topics and filters, and filters with a `#` that is not last, match nothing. A
subscription that repeats gives its events again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from streamledger.functions.topics import levels, pattern_to_filter

#: Up to so many subscriptions, and thus shapes, are broadcast; beyond, both sides shuffle.
BROADCAST_SUBSCRIPTIONS = 100_000
#: Up to so many shapes are columns of their own, which compile; more are joined.
SHAPE_COLUMNS = 64


def compiled(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions (name, pattern) with their filter; invalid patterns are an error."""
    bad = F.raise_error(F.concat(F.lit("invalid pattern: "), F.coalesce("pattern", F.lit("null"))))
    return subscriptions.withColumn("filter", F.coalesce(pattern_to_filter(F.col("pattern")), bad))


def shape(filter_: Column) -> Column:
    """A character for each level: * for one wildcard, - for a literal, # for an open end."""
    return F.array_join(F.transform(levels(filter_), lambda x: F.when(x == "+", "*").when(x == "#", "#").otherwise("-")), "")


def filter_for(path: Column, shape_: Column) -> Column:
    """The one filter of a shape that can match a topic, given by its levels."""
    at = lambda x, k: F.when(F.substring(shape_, k + 1, F.lit(1)) == "*", "+").otherwise(x)
    closed = F.transform(path, at)
    n = F.length(shape_) - 1
    opened = F.concat(F.transform(F.slice(path, F.lit(1), n), at), F.array(F.lit("#")))
    return F.array_join(F.when(shape_.endswith("#"), opened).otherwise(closed), "/")


def shapes_of(subscriptions: DataFrame) -> DataFrame:
    """The shapes in use: shape, probe_open, and probe_n, the number of levels that it fixes. A # that is not last matches nothing."""
    used = subscriptions.where(F.col("filter").isNotNull()).select(shape(F.col("filter")).alias("shape")).distinct().where(~F.col("shape").rlike("#."))
    open_ = F.col("shape").endswith("#")
    return used.select("shape", open_.alias("probe_open"), (F.length("shape") - F.when(open_, 1).otherwise(0)).alias("probe_n"))


def probes(rows: DataFrame, shapes: DataFrame, any_open: bool, topic_col: str = "topic") -> DataFrame:
    """rows with shape and filter: one row for each filter that could match its topic, which is one for each shape that fits the topic's length."""
    n = F.size(levels(F.col(topic_col)))
    at = F.array(F.struct(F.lit(False).alias("probe_open"), n.alias("probe_n")))
    if any_open:
        at = F.concat(at, F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(F.lit(True).alias("probe_open"), k.alias("probe_n"))))
    met = rows.withColumn("probe", F.explode(at)).select(*rows.columns, "probe.*").join(shapes, ["probe_open", "probe_n"])
    return met.withColumn("filter", filter_for(levels(F.col(topic_col)), F.col("shape"))).drop("probe_open", "probe_n")


def probed(rows: DataFrame, shapes: list[Row], topic_col: str = "topic") -> DataFrame:
    """What `probes` gives, for shapes that the driver has: each is a column."""
    path = F.col("probe_path")

    def probe(s: Row) -> Column:
        at = [F.lit("+") if c == "*" else F.get(path, F.lit(k)) for k, c in enumerate(s["shape"][: s["probe_n"]])]
        fits = F.size(path) >= s["probe_n"] if s["probe_open"] else F.size(path) == s["probe_n"]
        return F.when(fits, F.struct(F.lit(s["shape"]).alias("shape"), F.concat_ws("/", *at, *([F.lit("#")] if s["probe_open"] else [])).alias("filter")))

    met = rows.withColumn("probe_path", levels(F.col(topic_col))).withColumn("probe", F.explode(F.array(*map(probe, shapes))))
    return met.where(F.col("probe").isNotNull()).select(*rows.columns, "probe.*")


def fan_out(events: DataFrame, subscriptions: DataFrame, topic_col: str = "topic", broadcast: bool | None = None) -> DataFrame:
    """A row for every (event, subscription: name, filter) with a matching filter; any filter, also with #.

    Up to BROADCAST_SUBSCRIPTIONS of them are broadcast and events are not shuffled. Beyond, distinct topics meet the filters, and events the subscriptions of their topic.
    """
    indexed = subscriptions.select(F.col("name").alias("subscription"), "filter", shape(F.col("filter")).alias("shape"))
    shapes = shapes_of(subscriptions)
    if broadcast is None:
        broadcast = indexed.limit(BROADCAST_SUBSCRIPTIONS + 1).count() <= BROADCAST_SUBSCRIPTIONS
    used = shapes.limit(SHAPE_COLUMNS + 1).collect()
    known = events.where(F.col(topic_col).isNotNull())
    if broadcast and 0 < len(used) <= SHAPE_COLUMNS:
        return probed(known, used, topic_col).join(F.broadcast(indexed), ["filter", "shape"]).drop("filter", "shape")
    any_open = not shapes.where("probe_open").isEmpty()
    if broadcast:
        return probes(known, F.broadcast(shapes), any_open, topic_col).join(F.broadcast(indexed), ["filter", "shape"]).drop("filter", "shape")
    pairs = probes(known.select(topic_col).distinct(), shapes, any_open, topic_col).join(indexed, ["filter", "shape"]).select(topic_col, "subscription")
    return events.join(pairs, topic_col)
