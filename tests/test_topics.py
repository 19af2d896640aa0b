"""Topics, patterns and filters."""

from pyspark.sql import functions as F

from streamledger.functions import topics
from streamledger.operators.matching import compiled, fan_out

MATCHES = [
    ("events/+/+", "events/task/done", True),
    ("events/+", "events/task/done", False),
    ("events/+", "events/", True),
    ("events/task/#", "events/task", True),
    ("events/task/#", "events/task/a/b", True),
    ("#", "events/a", True),
    ("events/#/done", "events/task/done", False),
    ("sensors/#", "events/task", False),
    ("events/a.b", "events/a.b", True),
    ("events/a.b", "events/axb", False),
    ("events/a", "events/a/b", False),
    ("events/a/+", "events/a", False),
    ("+/a", "/a", True),
]


def test_matches(spark):
    rows = spark.createDataFrame(MATCHES, "filter string, topic string, want boolean")
    assert rows.where(topics.topic_matches(F.col("filter"), F.col("topic")) != F.col("want")).collect() == []


def test_round_trip_and_lane(spark):
    rows = spark.createDataFrame([("task.requested",), ("a",), ("a.b-c_d.9",)], "type string")
    topic = topics.type_to_topic(F.col("type"))
    assert rows.where(topics.topic_to_type(topic) != F.col("type")).count() == 0
    bad = spark.createDataFrame([(t,) for t in ("", "events", "events/", "events//a", "sensors/a", "events/A", "events/a/", "task")], "topic string")
    assert bad.where(topics.topic_to_type(F.col("topic")).isNotNull() | topics.topic_problem(F.col("topic")).isNull()).count() == 0


def test_patterns_stay_in_the_lane(spark):
    patterns = ["*", "a.*", "#", "+", "a/b", "a.#", "../x", "a.*b", "*.*.*", "", "a."]
    rows = spark.createDataFrame([(p,) for p in patterns], "pattern string").select("pattern", topics.pattern_to_filter(F.col("pattern")).alias("f"), topics.pattern_problems(F.col("pattern")).alias("c")).collect()
    got = {r["pattern"]: (r["f"], list(r["c"])) for r in rows}
    assert got["*"] == ("events/+", []) and got["a.*"] == ("events/a/+", []) and got["*.*.*"] == ("events/+/+/+", [])
    assert got["#"] == got["+"] == got["a/b"] == got["a.#"] == (None, ["reserved_mqtt_char"])
    assert got[""] == (None, ["empty"]) and got["a."] == (None, ["empty"]) and got["a.*b"] == (None, ["malformed"])


def test_fan_out_joins_on_levels(spark):
    events = spark.createDataFrame([(1, "events/a/b"), (2, "events/a"), (3, "events/c/b")], "n int, topic string")
    subs = compiled(spark.createDataFrame([("s1", "a.*"), ("s2", "*"), ("s3", "*.b")], "name string, pattern string"))
    for broadcast in (True, False):
        rows = fan_out(events, subs, broadcast=broadcast)
        assert sorted((r["n"], r["subscription"]) for r in rows.collect()) == [(1, "s1"), (1, "s3"), (2, "s2"), (3, "s3")]
    plan = fan_out(events, subs, broadcast=True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
