"""The index of filters against the plain rule, and at scale."""

import pytest
from pyspark.sql import functions as F

from streamledger.functions.topics import topic_matches
from streamledger.operators.matching import compiled, fan_out, probed, probes, shapes_of

TOPICS = ["events/a", "events/a/b", "events/a/b/c", "events/b/a", "events//b", "events", "", "/", "a+b/c", "events/+/b", "events/#", "x/y/z/w", None]
FILTERS = ["#", "events/#", "events/+/+", "events/+", "+/a/+", "events/#/b", "events/a/b", "events/a/#", "+", "+/+", "", "events//b", "events/+/b", "events/a/b/#", "+/#", None]


@pytest.mark.parametrize("broadcast", [True, False])
def test_index_gives_what_the_rule_gives(spark, broadcast):
    events = spark.createDataFrame([(k, t) for k, t in enumerate(TOPICS * 2)], "n int, topic string")
    subs = spark.createDataFrame([(f"s{k}", f) for k, f in enumerate([*FILTERS, "events/+"])], "name string, filter string")
    got = sorted((r["n"], r["subscription"]) for r in fan_out(events, subs, broadcast=broadcast).collect())
    pairs = events.crossJoin(subs).where(topic_matches(F.col("filter"), F.col("topic")))
    assert got == sorted((r["n"], r["name"]) for r in pairs.collect()) and len(got) > 60
    assert set(fan_out(events, subs, broadcast=broadcast).columns) == {"n", "topic", "subscription"}
    assert fan_out(events.limit(0), subs, broadcast=broadcast).count() == 0 and fan_out(events, subs.limit(0), broadcast=broadcast).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_a_hundred_thousand_patterns(spark, broadcast):
    """Rows looked at are events times shapes, and rows out are what they should be."""
    k = F.col("id")
    patterns = spark.range(100_000).select(F.concat(F.lit("s"), k).alias("name"), F.when(k % 2 == 0, F.concat(F.lit("*.dev"), k, F.lit(".*"))).otherwise(F.concat(F.lit("read.dev"), k, F.lit(".k"), k % 10)).alias("pattern"))
    subs = compiled(patterns)
    events = spark.range(1_000_000).select(k, F.concat(F.lit("events/"), F.when(k % 3 == 0, "read").otherwise("write"), F.lit("/dev"), k % 200_000, F.lit("/k"), k % 7).alias("topic"))
    shapes = shapes_of(subs)
    assert {r["shape"] for r in shapes.collect()} == {"-*-*", "----"}
    assert probes(events, shapes, False).count() == 2 * 1_000_000
    device = F.col("id") % 200_000
    want = events.where((device < 100_000) & ((device % 2 == 0) | ((F.col("id") % 3 == 0) & (F.col("id") % 7 == device % 10)))).count()
    assert fan_out(events, subs, broadcast=broadcast).count() == want > 250_000


def test_no_pattern_is_dropped_silently(spark):
    with pytest.raises(Exception, match="invalid pattern: A.b"):
        compiled(spark.createDataFrame([("s", "A.b")], "name string, pattern string")).collect()


def test_shapes_as_columns_or_joined(spark, monkeypatch):
    """A handful of shapes are columns, without interpreted lambdas; more are joined. Both give the same."""
    events = spark.createDataFrame([(k, t) for k, t in enumerate(TOPICS)], "n int, topic string")
    subs = spark.createDataFrame([(f"s{k}", f) for k, f in enumerate(FILTERS)], "name string, filter string")
    assert "lambda" not in probed(events, shapes_of(subs).collect())._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r["n"], r["subscription"]) for r in fan_out(events, subs).collect())
    monkeypatch.setattr("streamledger.operators.matching.SHAPE_COLUMNS", 2)
    assert got == sorted((r["n"], r["subscription"]) for r in fan_out(events, subs).collect())
