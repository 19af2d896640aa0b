"""The query catalogue: every operator over the given tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamledger.functions import fields, ids, times, topics, wire
from streamledger.operators import backlog, chains, drains, pages, sequencing
from streamledger.operators.ledger import NAME as STORED
from streamledger.operators.ledger import Ledger, import_lines, record_problem, stored_lines
from streamledger.operators.matching import fan_out
from streamledger.operators.registry import NAME as REGISTERED
from streamledger.operators.registry import Registry, named_well
from streamledger.plans import adapter
from streamledger.plans.adapter import with_envelopes, with_ledger
from streamledger.session import scratch
from streamledger.sources.committed import Files
from streamledger.streaming import drain as streams
from streamledger.streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.envelopes(adapter.events(spark, sf_dir))


# Scalar functions and projections


@query(with_envelopes("SELECT id, type, source, time, schema_version AS \"schemaVersion\", correlation_id AS \"correlationId\", data FROM envelopes"))
def wire_projection(spark, sf_dir):
    return _envelopes(spark, sf_dir).select("id", "type", "source", "time", F.col("schema_version").alias("schemaVersion"), F.col("correlation_id").alias("correlationId"), "data")


@query(with_envelopes("SELECT id, time, epoch_us(ts) AS micros FROM envelopes"))
def time_format(spark, sf_dir):
    return _envelopes(spark, sf_dir).select("id", times.format_time(F.col("ts")).alias("time"), F.unix_micros(times.parse_time(F.col("time"))).alias("micros"))


@query(with_envelopes("""SELECT id, '{"id":"' || id || '","type":"' || type || '","source":"' || source || '","time":"' || time || '","schemaVersion":"1.0","correlationId":"' || correlation_id || '","data":' || data || '}' AS wire FROM envelopes"""))
def wire_json(spark, sf_dir):
    return _envelopes(spark, sf_dir).select("id", wire.to_wire_json().alias("wire"))


@query(with_envelopes("SELECT id, 'events/' || replace(type, '.', '/') AS topic FROM envelopes"))
def type_to_topic(spark, sf_dir):
    return _envelopes(spark, sf_dir).select("id", topics.type_to_topic(F.col("type")).alias("topic"))


#: Topics of the events, and by their ids some that lie outside the lane or are malformed.
TOPICS_SQL = "CASE arrival % 7 WHEN 1 THEN 'sensors/' || type WHEN 2 THEN 'events/' || replace(type, '.', '//') WHEN 3 THEN 'events/' || upper(type) ELSE 'events/' || replace(type, '.', '/') END"


@query(with_envelopes(f"SELECT id, topic, CASE WHEN arrival % 7 NOT IN (1, 2, 3) THEN type END AS type, CASE WHEN arrival % 7 IN (1, 2, 3) THEN 'malformed' END AS code FROM (SELECT *, {TOPICS_SQL} AS topic FROM envelopes)"))
def topic_to_type(spark, sf_dir):
    rows = _envelopes(spark, sf_dir).withColumn("topic", F.expr(TOPICS_SQL))
    return rows.select("id", "topic", topics.topic_to_type(F.col("topic")).alias("type"), topics.topic_problem(F.col("topic")).alias("code"))


#: Patterns made of the events' types: good ones, and by the arrival such as can't be compiled.
PATTERN_SQL = "CASE arrival % 9 WHEN 1 THEN '*.' || split_part(type, '.', 2) WHEN 2 THEN split_part(type, '.', 1) || '.#' WHEN 3 THEN upper(type) WHEN 4 THEN replace(type, '.', '..') WHEN 5 THEN '.' || type WHEN 6 THEN type || '*' WHEN 7 THEN 'events/' || type WHEN 8 THEN '' ELSE type || '.*' END"


@query(with_envelopes(f"""SELECT id, pattern, CASE WHEN arrival % 9 IN (0, 1) THEN 'events/' || replace(replace(pattern, '*', '+'), '.', '/') END AS filter,
CASE arrival % 9 WHEN 2 THEN 'reserved_mqtt_char' WHEN 3 THEN array_to_string(list_transform(string_split(type, '.'), lambda x: 'malformed'), ',') WHEN 4 THEN array_to_string(list_transform(string_split(type, '.')[2:], lambda x: 'empty'), ',') WHEN 5 THEN 'empty' WHEN 6 THEN 'malformed' WHEN 7 THEN 'reserved_mqtt_char' WHEN 8 THEN 'empty' ELSE '' END AS codes FROM (SELECT *, {PATTERN_SQL} AS pattern FROM envelopes)"""))
def pattern_to_filter(spark, sf_dir):
    rows = _envelopes(spark, sf_dir).withColumn("pattern", F.expr(PATTERN_SQL))
    return rows.select("id", "pattern", topics.pattern_to_filter(F.col("pattern")).alias("filter"), F.array_join(topics.pattern_problems(F.col("pattern")), ",").alias("codes"))


FILTERS = ["#", "events/#", "events/+/+", "events/click/#", "sensors/#", "events/+", "+/click/high", "events/#/high", "events/click/high"]


@query(with_envelopes(f"""SELECT f AS filter, topic, CASE WHEN f LIKE '%#/%' THEN false ELSE regexp_full_match(topic, CASE WHEN f = '#' THEN '.*' WHEN f LIKE '%/#' THEN replace(f[:-3], '+', '[^/]*') || '(/.*)?' ELSE replace(f, '+', '[^/]*') END) END AS matches
FROM (SELECT DISTINCT 'events/' || replace(type, '.', '/') AS topic FROM envelopes UNION ALL SELECT 'events' UNION ALL SELECT 'events//high'), (SELECT unnest({FILTERS}) AS f)"""))
def filter_match(spark, sf_dir):
    named = _envelopes(spark, sf_dir).select(topics.type_to_topic(F.col("type")).alias("topic")).distinct()
    rows = named.unionByName(spark.createDataFrame([("events",), ("events//high",)], "topic string"))
    rows = rows.withColumn("filter", F.explode(F.array(*map(F.lit, FILTERS))))
    return rows.select("filter", "topic", topics.topic_matches(F.col("filter"), F.col("topic")).alias("matches"))


@query(with_envelopes("SELECT id, subscription, arrival FROM matched"))
def subscription_fanout(spark, sf_dir):
    return adapter.matched(spark, sf_dir).select("id", "subscription", "arrival")


@query(f"""WITH devices AS (SELECT event_id, event_type AS t1, CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS t2, 'u' || user_id AS t3, 'k' || (event_id % 50) AS t4 FROM events),
subs AS (SELECT event_type || '-u' || user_id AS subscription, string_split({adapter.DEVICE_PATTERN}, '.') AS p FROM (SELECT DISTINCT event_type, user_id FROM events))
SELECT event_id, subscription FROM devices JOIN subs ON p[1] IN ('*', t1) AND p[2] IN ('*', t2) AND p[3] IN ('*', t3) AND p[4] IN ('*', t4)""")
def wildcard_index_join(spark, sf_dir):
    """Events meet a pattern for every user and event type through the index of filters; topics are made distinct first, as beyond the bound for a broadcast."""
    raw = adapter.events(spark, sf_dir)
    return fan_out(adapter.device_events(raw), adapter.device_subscriptions(raw), broadcast=False).select("event_id", "subscription")


@query(with_envelopes(f"SELECT topic LIKE 'events/%' AS in_lane, count(*) AS n FROM (SELECT {TOPICS_SQL} AS topic FROM envelopes) GROUP BY 1"))
def lane_exclusion(spark, sf_dir):
    rows = _envelopes(spark, sf_dir).select(F.expr(TOPICS_SQL).alias("topic"))
    return rows.groupBy(topics.in_lane(F.col("topic")).alias("in_lane")).agg(F.count("*").alias("n"))


ULID_SQL = " || ".join(f"substr('{ids.DIGITS}', ((epoch_us(ts) // 1000 >> {5 * k}) & 31)::INT + 1, 1)" for k in reversed(range(10)))


@query(with_envelopes(f"SELECT id, {ULID_SQL} AS ulid FROM envelopes"))
def ulid_time_encode(spark, sf_dir):
    return _envelopes(spark, sf_dir).select("id", ids.ulid_time(F.col("ts")).alias("ulid"))


@query(with_envelopes("SELECT id, epoch_us(ts) // 1000 AS millis FROM envelopes"))
def ulid_time_decode(spark, sf_dir):
    return _envelopes(spark, sf_dir).select("id", ids.ulid_millis(ids.ulid_time(F.col("ts"))).alias("millis"))


# Field checks: values broken by rules on the arrival

BROKEN = {
    "validate_id": (fields.identifier_problem, "CASE arrival % 6 WHEN 1 THEN '' WHEN 2 THEN 'a b' WHEN 3 THEN repeat('x', 129) WHEN 4 THEN '-' || id WHEN 5 THEN id || chr(10) ELSE id END", "CASE arrival % 6 WHEN 1 THEN 'empty' WHEN 2 THEN 'malformed' WHEN 3 THEN 'too_long' WHEN 4 THEN 'malformed' WHEN 5 THEN 'malformed' END"),
    "validate_type": (topics.type_problem, "CASE arrival % 6 WHEN 1 THEN '' WHEN 2 THEN upper(type) WHEN 3 THEN repeat('a', 200) WHEN 4 THEN replace(type, '.', '..') WHEN 5 THEN '.' || type ELSE type END", "CASE arrival % 6 WHEN 1 THEN 'empty' WHEN 2 THEN 'malformed' WHEN 3 THEN 'too_long' WHEN 4 THEN 'malformed' WHEN 5 THEN 'malformed' END"),
    "validate_source": (fields.source_problem, "CASE arrival % 5 WHEN 1 THEN '' WHEN 2 THEN '/user/1' WHEN 3 THEN source || repeat('x', 600) WHEN 4 THEN source || ' x' ELSE source END", "CASE arrival % 5 WHEN 1 THEN 'empty' WHEN 2 THEN 'malformed' WHEN 3 THEN 'too_long' WHEN 4 THEN 'malformed' END"),
    "validate_time": (times.time_problem, "CASE arrival % 9 WHEN 1 THEN '' WHEN 2 THEN substr(time, 1, 10) WHEN 3 THEN replace(time, 'Z', '+02:00') WHEN 4 THEN replace(time, 'T', ' ') WHEN 5 THEN '2026-13-01T00:00:00Z' WHEN 6 THEN '2026-02-29T00:00:00Z' WHEN 7 THEN replace(replace(time, 'T', 't'), 'Z', 'z') WHEN 8 THEN replace(time, 'Z', '-00:00') ELSE time END", "CASE arrival % 9 WHEN 1 THEN 'empty' WHEN 3 THEN 'not_utc' WHEN 7 THEN NULL WHEN 8 THEN NULL WHEN 0 THEN NULL ELSE 'malformed' END"),
    "validate_schema_version": (fields.schema_version_problem, "CASE arrival % 5 WHEN 1 THEN '' WHEN 2 THEN 'v1' WHEN 3 THEN repeat('1', 33) WHEN 4 THEN '1.' ELSE schema_version END", "CASE arrival % 5 WHEN 1 THEN 'empty' WHEN 2 THEN 'malformed' WHEN 3 THEN 'too_long' WHEN 4 THEN 'malformed' END"),
    "validate_traceparent": (fields.traceparent_problem, "CASE arrival % 7 WHEN 1 THEN '' WHEN 2 THEN '00-' || repeat('0', 32) || '-00f067aa0ba902b7-01' WHEN 3 THEN 'ff-4bf92f3577b34da6a3ce929d0e0e4736-00f067aa0ba902b7-01' WHEN 4 THEN '00-4BF92F3577B34DA6A3CE929D0E0E4736-00f067aa0ba902b7-01' WHEN 5 THEN '00-4bf92f3577b34da6a3ce929d0e0e4736-0000000000000000-01' WHEN 6 THEN '00-4bf92f3577b34da6a3ce929d0e0e4736-00f067aa0ba902b7' ELSE '00-4bf92f3577b34da6a3ce929d0e0e4736-00f067aa0ba902b7-01' END", "CASE arrival % 7 WHEN 1 THEN 'empty' WHEN 0 THEN NULL ELSE 'malformed' END"),
    "validate_delivery_attempt": (fields.delivery_attempt_problem, "arrival % 4 - 1", "CASE WHEN arrival % 4 < 2 THEN 'out_of_range' END"),
}


def _field_query(name: str) -> None:
    rule, value, code = BROKEN[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _envelopes(spark, sf_dir).withColumn("value", F.expr(value))
        return rows.select("id", rule(F.col("value")).alias("code"))

    QUERIES[name], SQL[name] = run, with_envelopes(f"SELECT id, {code} AS code FROM envelopes")


for _name in BROKEN:
    _field_query(_name)

#: Payloads of the deliveries; by arrival, some are no JSON, no object, lack a field, have a null or an unknown one.
PAYLOAD_SQL = """CASE event_id % 17 WHEN 3 THEN '{"broken' WHEN 5 THEN '[1]' WHEN 7 THEN replace(good, '"schemaVersion":"1.0",', '') WHEN 9 THEN replace(good, '"time":"', '"time":null,"run_id":"') WHEN 11 THEN replace(good, '"source":"app://', '"source":"app ') ELSE good END"""
CODES_SQL = "CASE event_id % 17 WHEN 3 THEN 'envelope:not_json' WHEN 5 THEN 'envelope:not_an_object' WHEN 7 THEN 'schemaVersion:missing' WHEN 9 THEN 'run_id:unknown_field,time:not_a_string' WHEN 11 THEN 'source:malformed' ELSE '' END"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries with payloads: subscription, arrival, topic, payload, qos, retain."""
    rows = adapter.matched(spark, sf_dir).withColumn("good", wire.to_wire_json()).withColumn("event_id", F.floor(F.col("arrival") / 4) - F.when(F.col("delivery_attempt") == 2, 5).otherwise(0))
    return rows.select("subscription", "arrival", "topic", "event_id", F.expr(PAYLOAD_SQL).alias("payload"), F.pmod("arrival", F.lit(3)).cast("int").alias("qos"))


MESSAGES_SQL = """, messages AS (SELECT *, substr(id, 5)::BIGINT AS event_id, arrival % 3 AS qos FROM matched)"""


@query(with_envelopes(f"{MESSAGES_SQL} SELECT subscription, arrival, {CODES_SQL} AS codes FROM messages"))
def validate_errors_all(spark, sf_dir):
    parsed = wire.parse_payloads(_messages(spark, sf_dir))
    return parsed.select("subscription", "arrival", F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(":"), e["code"])), ",").alias("codes"))


@query(with_envelopes(f"{MESSAGES_SQL} SELECT subscription, count(*) FILTER ({CODES_SQL} = '') AS valid, count(*) FILTER ({CODES_SQL} <> '') AS skipped FROM messages GROUP BY subscription"))
def valid_skipped_split(spark, sf_dir):
    parsed = wire.parse_payloads(_messages(spark, sf_dir))
    return parsed.groupBy("subscription").agg(F.count_if(F.size("errors") == 0).alias("valid"), F.count_if(F.size("errors") > 0).alias("skipped"))


@query(with_envelopes(f"{MESSAGES_SQL} SELECT split_part(unnest(string_split({CODES_SQL}, ',')), ':', 2) AS code, count(*) AS n FROM messages WHERE {CODES_SQL} <> '' GROUP BY 1"))
def skip_reasons(spark, sf_dir):
    parsed = wire.parse_payloads(_messages(spark, sf_dir))
    return parsed.select(F.explode("errors").alias("e")).groupBy(F.col("e.code").alias("code")).agg(F.count("*").alias("n"))


# The ledger


@query(with_ledger("SELECT subscription, seq, id, delivery_attempt FROM ledger"))
def append_dedupe_seq(spark, sf_dir):
    return adapter.ledger(spark, sf_dir).select("subscription", "seq", "id", "delivery_attempt")


@query(with_ledger("SELECT subscription, count(*) AS n, max(seq) AS last FROM ledger GROUP BY subscription"))
def append_idempotent(spark, sf_dir):
    """The same deliveries appended a second time add nothing."""
    once = adapter.stored(spark, sf_dir)
    again = sequencing.unseen(adapter.matched(spark, sf_dir).select("subscription", "id", F.lit(0).cast("bigint").alias("seq")), adapter.stored_ledger(spark, sf_dir).backend.seen())
    return once.select("subscription", "seq").unionByName(again.select("subscription", "seq")).groupBy("subscription").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


@query(with_ledger("SELECT id, count(*) AS copies, count(DISTINCT subscription) AS subscriptions FROM ledger GROUP BY id"))
def dedupe_scoped_to_sub(spark, sf_dir):
    return adapter.ledger(spark, sf_dir).groupBy("id").agg(F.count("*").alias("copies"), F.countDistinct("subscription").alias("subscriptions"))


@query(with_envelopes("SELECT id, row_number() OVER (ORDER BY arrival DESC) AS seq FROM envelopes"))
def same_ms_append_order(spark, sf_dir):
    """One time for all, ids against the order of arrival: numbers follow arrival."""
    rows = _envelopes(spark, sf_dir).select(F.lit("s").alias("subscription"), "id", (-F.col("arrival")).alias("arrival"))
    return sequencing.numbered(rows, block=1000).select("id", "seq")


@query(with_ledger("SELECT a.subscription, a.id, l.seq FROM (SELECT DISTINCT subscription, id FROM matched WHERE delivery_attempt = 2) a LEFT JOIN ledger l USING (subscription, id)"))
def append_returns_seq(spark, sf_dir):
    """Redelivered events give the numbers under which they are stored."""
    again = adapter.matched(spark, sf_dir).where("delivery_attempt = 2").select("subscription", "id").distinct()
    return adapter.stored_ledger(spark, sf_dir).stored_at(again).select("subscription", "id", "seq")


@query(with_ledger("SELECT subscription, seq, id FROM ledger"))
def append_in_batches(spark, sf_dir):
    """Three appends through the ledger, each looking its ids up in the bucketed index: redelivered events find their first copies in earlier batches."""
    ledger, rows = Ledger(spark, scratch(spark, "appends")), adapter.matched(spark, sf_dir)
    third = (rows.agg(F.max("arrival")).first()[0] or 0) // 3 + 1
    for k in range(3):
        ledger.append(rows.where(F.floor(F.col("arrival") / third) == k), f"b{k}")
    return ledger.rows().select("subscription", "seq", "id")


@query(with_ledger("SELECT seq, id FROM ledger WHERE subscription = 'clicks' AND seq > 40 ORDER BY seq LIMIT 100"))
def read_since_page(spark, sf_dir):
    return pages.page_after(adapter.stored(spark, sf_dir), "clicks", 40).select("seq", "id")


@query(with_ledger("SELECT seq, id FROM ledger WHERE subscription = 'clicks' AND seq > (SELECT max(seq) - 7 FROM ledger WHERE subscription = 'clicks') ORDER BY seq LIMIT 100"))
def read_last_page(spark, sf_dir):
    rows = adapter.stored(spark, sf_dir)
    last = rows.where("subscription = 'clicks'").agg(F.max("seq")).first()[0] or 0
    return pages.page_after(rows, "clicks", max(0, last - 7)).select("seq", "id")


@query("SELECT 0::BIGINT AS n, 1000000000::BIGINT AS cursor, false AS has_more")
def read_past_end(spark, sf_dir):
    return pages.page_summary(adapter.ledger(spark, sf_dir), "clicks", 1_000_000_000)


@query(with_ledger("SELECT least(25, count(*)) AS n, least(35, max(seq)) AS cursor, max(seq) > 35 AS has_more FROM ledger WHERE subscription = 'clicks' AND seq > 10"))
def page_summary(spark, sf_dir):
    return pages.page_summary(adapter.stored(spark, sf_dir), "clicks", 10, 25)


@query(with_ledger("SELECT id, subscription, seq, type FROM ledger WHERE id = (SELECT min(id) FROM ledger) ORDER BY subscription LIMIT 1"))
def get_by_id(spark, sf_dir):
    rows = adapter.stored(spark, sf_dir)
    first = rows.agg(F.min("id")).first()[0]
    return pages.by_id(rows, first or "").select("id", "subscription", "seq", "type")


LIST_SQL = """, top AS (SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY subscription ORDER BY seq DESC) <= {n}),
once AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC, subscription DESC, seq DESC) = 1)
SELECT id, type, subscription, seq FROM once ORDER BY recorded_at DESC, subscription DESC, seq DESC LIMIT {n}"""


@query(with_ledger(LIST_SQL.format(src="ledger", n=100)))
def list_newest(spark, sf_dir):
    return pages.newest(adapter.stored(spark, sf_dir)).select("id", "type", "subscription", "seq")


@query(with_ledger(", typed AS (SELECT * FROM ledger WHERE type = 'click.high')" + LIST_SQL.format(src="typed", n=20)))
def list_by_type(spark, sf_dir):
    return pages.newest(adapter.stored(spark, sf_dir), "click.high", 20).select("id", "type", "subscription", "seq")


@query(with_ledger(LIST_SQL.format(src="ledger", n=7) .replace("SELECT id, type, subscription, seq FROM", "SELECT id, count(*) OVER (PARTITION BY id) AS copies FROM")))
def list_distinct_events(spark, sf_dir):
    rows = pages.newest(adapter.stored(spark, sf_dir), max=7)
    return rows.join(rows.groupBy("id").agg(F.count("*").alias("copies")), "id").select("id", "copies")


@query(with_ledger(LIST_SQL.format(src="ledger", n=50)))
def ledger_list(spark, sf_dir):
    """Newest first by the ledger itself: from the ends of the logs, verified."""
    return adapter.stored_ledger(spark, sf_dir).list(max=50).select("id", "type", "subscription", "seq")


@query(with_ledger(", typed AS (SELECT * FROM ledger WHERE type = (SELECT min(type) FROM ledger))" + LIST_SQL.format(src="typed", n=30)))
def ledger_list_type(spark, sf_dir):
    """A type may be rare: it is looked for further and further back."""
    ledger = adapter.stored_ledger(spark, sf_dir)
    kind = ledger.rows().agg(F.min("type")).first()[0]
    return ledger.list(kind or "none", 30).select("id", "type", "subscription", "seq")


@query(with_ledger("SELECT seq, id FROM ledger WHERE subscription = 'retries' AND seq > 20 ORDER BY seq LIMIT 60"))
def ledger_read(spark, sf_dir):
    return adapter.stored_ledger(spark, sf_dir).read("retries", 20, 60).select("seq", "id")


@query(with_ledger("SELECT id, subscription, seq FROM ledger WHERE id = (SELECT max(id) FROM ledger) ORDER BY subscription LIMIT 1"))
def ledger_get(spark, sf_dir):
    """A lookup that skips the row groups whose bloom filters rule the id out."""
    ledger = adapter.stored_ledger(spark, sf_dir)
    last = ledger.rows().agg(F.max("id")).first()[0]
    return ledger.get(last or "").select("id", "subscription", "seq")


@query(with_ledger("SELECT subscription, max(seq) AS seq FROM ledger GROUP BY subscription"))
def ledger_heads(spark, sf_dir):
    """The last number of each subscription, from the footers of the files."""
    return spark.createDataFrame([tuple(r) for r in adapter.stored_ledger(spark, sf_dir).backend.last()], "subscription string, seq bigint")


#: Ledger rows that are broken by their numbers.
BROKEN_SQL = "CASE WHEN seq % 50 = 3 THEN 'unknown store format' WHEN seq % 50 = 7 THEN 'number below 1' WHEN seq % 50 IN (11, 12) THEN 'invalid envelope' END"


@query(with_ledger(f"SELECT subscription, why, count(*) AS n FROM (SELECT subscription, {BROKEN_SQL} AS why FROM ledger) WHERE why IS NOT NULL GROUP BY ALL"))
def corrupt_records(spark, sf_dir):
    """What is wrong with each broken record of a ledger."""
    rows, bad = adapter.stored(spark, sf_dir), F.col("seq") % 50
    broken = rows.select("*", bad.alias("bad")).withColumns({"store_format_version": F.when(bad == 3, "9").otherwise(F.col("store_format_version")), "type": F.when(bad == 11, F.upper("type")).otherwise(F.col("type")), "source": F.when(bad != 12, F.col("source"))})
    broken = broken.withColumn("seq", F.when(F.col("bad") == 7, -F.col("seq")).otherwise(F.col("seq")))
    return broken.withColumn("why", record_problem()).where("why is not null").groupBy("subscription", "why").agg(F.count("*").alias("n"))


@query(with_ledger("SELECT subscription, seq, id FROM ledger"))
def import_torn_tail(spark, sf_dir):
    """Exported records are imported again; a torn last line in every file is dropped, and nothing else."""
    root, ledger = scratch(spark, "lines"), adapter.stored_ledger(spark, sf_dir)
    lines = stored_lines(ledger.rows()).withColumn("piece", F.floor(F.col("seq") / (1 << 16)))
    pieces = sum(r["seq"] // (1 << 16) + 1 for r in ledger.backend.last())  # a task a piece or so, however many there are
    torn = lines.groupBy("subscription", "piece").agg(F.max("seq").alias("seq")).withColumn("value", F.lit('{"storeFormatVersion":"1","se'))
    files = lines.withColumn("torn", F.lit(0)).unionByName(torn.withColumn("torn", F.lit(1)))
    files = files.repartition(max(1, pieces), "subscription", "piece").sortWithinPartitions("subscription", "piece", "seq", "torn")
    files.select("subscription", "piece", "value").write.partitionBy("subscription", "piece").text(root)
    return import_lines(spark, root).select("subscription", "seq", "id")


@query(with_ledger("SELECT DISTINCT subscription FROM ledger ORDER BY subscription"))
def subscriptions_sorted(spark, sf_dir):
    return pages.subscriptions(adapter.ledger(spark, sf_dir))


@query(with_ledger("SELECT subscription, seq, seq AS before FROM ledger WHERE false"))
def ledger_gap_check(spark, sf_dir):
    return sequencing.gaps(adapter.stored(spark, sf_dir))


@query(with_ledger("SELECT subscription, seq, seq - 2 AS before FROM ledger WHERE seq % 100 = 1 AND seq > 1"))
def ledger_gap_found(spark, sf_dir):
    """With every number divisible by 100 taken out, the check finds each hole."""
    return sequencing.gaps(adapter.stored(spark, sf_dir).where("seq % 100 != 0"))


# Backlogs and drains


@query(with_envelopes("SELECT subscription, count(*) AS kept, max(arrival) AS last FROM (SELECT * FROM matched QUALIFY row_number() OVER (PARTITION BY subscription ORDER BY arrival) <= 1000) GROUP BY subscription"))
def backlog_overflow(spark, sf_dir):
    kept = backlog.kept_on_overflow(adapter.matched(spark, sf_dir))
    return kept.groupBy("subscription").agg(F.count("*").alias("kept"), F.max("arrival").alias("last"))


@query(with_envelopes(f"{MESSAGES_SQL} SELECT subscription, count(*) AS n FROM messages WHERE qos >= 1 GROUP BY subscription"))
def qos_capture(spark, sf_dir):
    return backlog.captured(_messages(spark, sf_dir), F.lit(-1)).groupBy("subscription").agg(F.count("*").alias("n"))


@query(with_envelopes(f"{MESSAGES_SQL} SELECT subscription, min(arrival) AS first, count(*) AS n FROM messages WHERE qos >= 1 AND arrival > 2000 GROUP BY subscription"))
def capture_boundary(spark, sf_dir):
    rows = backlog.captured(_messages(spark, sf_dir), F.lit(2000))
    return rows.groupBy("subscription").agg(F.min("arrival").alias("first"), F.count("*").alias("n"))


@query(with_envelopes("SELECT 'events/' || replace(type, '.', '/') AS topic, arg_max(data, arrival) AS payload, max(arrival) AS arrival FROM envelopes GROUP BY 1"))
def retained_last_value(spark, sf_dir):
    rows = _envelopes(spark, sf_dir).select(topics.type_to_topic(F.col("type")).alias("topic"), F.col("data").alias("payload"), "arrival", F.lit(True).alias("retain"))
    return backlog.retained(rows)


@query(with_envelopes("SELECT * FROM (SELECT 'events/' || replace(type, '.', '/') AS topic, arg_max(CASE WHEN arrival % 3 = 0 THEN '' ELSE data END, arrival) AS payload, max(arrival) AS arrival FROM envelopes GROUP BY 1) WHERE payload <> ''"))
def retained_cleared(spark, sf_dir):
    payload = F.when(F.col("arrival") % 3 == 0, "").otherwise(F.col("data"))
    rows = _envelopes(spark, sf_dir).select(topics.type_to_topic(F.col("type")).alias("topic"), payload.alias("payload"), "arrival", F.lit(True).alias("retain"))
    return backlog.retained(rows)


@query(with_envelopes("SELECT id, arrival, row_number() OVER (PARTITION BY id ORDER BY arrival) AS delivery_attempt FROM deliveries"))
def redelivery_ordinal(spark, sf_dir):
    rows = adapter.deliveries(adapter.events(spark, sf_dir)).select("id", "arrival")
    return backlog.with_attempt(rows).select("id", "arrival", "delivery_attempt")


#: A drain of the subscription `retries` after its first 40 arrivals were stored: each valid message taken gives a record, a known id that of its first copy.
DRAIN_SQL = MESSAGES_SQL + f""", queue AS (SELECT *, {CODES_SQL} AS codes FROM messages WHERE subscription = 'retries'),
taken AS (SELECT * FROM queue ORDER BY arrival LIMIT 150),
before AS (SELECT id, row_number() OVER (ORDER BY arrival) AS seq FROM (SELECT * FROM (SELECT * FROM queue ORDER BY arrival LIMIT 40) WHERE codes = '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival) = 1)),
added AS (SELECT id, (SELECT count(*) FROM before) + row_number() OVER (ORDER BY arrival) AS seq FROM (SELECT * FROM taken WHERE codes = '' AND id NOT IN (SELECT id FROM before) QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival) = 1)),
records AS (SELECT t.arrival, t.id, k.seq FROM taken t JOIN (SELECT * FROM before UNION ALL SELECT * FROM added) k USING (id) WHERE t.codes = '')"""


def _drained(spark: SparkSession, sf_dir: str) -> tuple[drains.Drained, DataFrame]:
    queue = _messages(spark, sf_dir).where("subscription = 'retries'").select("subscription", "arrival", "topic", "payload")
    head = queue.orderBy("arrival", "subscription", "topic", "payload").limit(150)  # both drains begin with the oldest, so the backlog is read once
    queue = spark.createDataFrame(head.collect(), head.schema)
    none = spark.createDataFrame([], "subscription string, id string, seq bigint")
    before = drains.drain(queue, none, 40).stored
    return drains.drain(queue, before, 150), before


@query(with_envelopes(f"{DRAIN_SQL} SELECT arrival, id, seq FROM records"))
def drain_batch(spark, sf_dir):
    return _drained(spark, sf_dir)[0].records.select("arrival", "id", "seq")


@query(with_envelopes(f"{DRAIN_SQL} SELECT (SELECT count(*) FROM taken) AS consumed, (SELECT count(*) FROM added) AS stored, (SELECT count(*) FROM taken WHERE codes <> '') AS skipped, coalesce((SELECT max(seq) FROM records), 0)::BIGINT AS cursor, (SELECT count(*) FROM taken) >= 150 AS has_more"))
def drain_summary(spark, sf_dir):
    return drains.summary(_drained(spark, sf_dir)[0], 0, 150)


@query(with_ledger("SELECT seq, id, 'history' AS half FROM ledger WHERE subscription = 'all-plain' ORDER BY seq LIMIT 100"))
def watch_history_only(spark, sf_dir):
    """A full page needs no drain."""
    return pages.page_after(adapter.ledger(spark, sf_dir), "all-plain").select("seq", "id", F.lit("history").alias("half"))


@query(with_envelopes(f"{DRAIN_SQL} SELECT seq, id, 0 AS half FROM before WHERE seq > 10 UNION ALL SELECT seq, id, 1 FROM records"))
def watch_history_plus_broker(spark, sf_dir):
    drained, before = _drained(spark, sf_dir)
    page = pages.page_after(before, "retries", 10).select("seq", "id")
    return pages.history_then(page, drained.records.select("seq", "id")).select("seq", "id", "half")


@query(with_ledger("SELECT correlation_id, count(*) AS n, min(seq) AS first, max(seq) AS last FROM ledger WHERE subscription = 'all-plain' GROUP BY correlation_id"))
def correlation_rollup(spark, sf_dir):
    """An extension: events of one correlation in a subscription."""
    rows = adapter.ledger(spark, sf_dir).where("subscription = 'all-plain'")
    return rows.groupBy("correlation_id").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


@query(with_ledger("""SELECT subscription, seq, '{"storeFormatVersion":"1","seq":' || seq || ',"subscription":"' || subscription || '","recordedAt":"' || recorded_at || '","event":{"id":"' || id || '","type":"' || type || '","source":"' || source || '","time":"' || time || '","schemaVersion":"1.0","correlationId":"' || correlation_id || '","deliveryAttempt":' || delivery_attempt || ',"data":' || data || '}}' AS value FROM ledger"""))
def record_projection(spark, sf_dir):
    """Ledger rows in their stored form."""
    return stored_lines(adapter.ledger(spark, sf_dir).withColumn("store_format_version", F.lit("1")))


#: Causes made of the events: a user's event follows the user's event before, but for every fifth, which begins a chain; the first of each eleventh user follows the user's last, in a circle.
CAUSES_SQL = """, caused AS (SELECT id, correlation_id, arrival, CASE WHEN arrival % 5 = 0 THEN NULL
  WHEN lag(id) OVER w IS NULL AND split_part(correlation_id, '_', 2)::INT % 11 = 0 THEN last_value(id) OVER (PARTITION BY correlation_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  ELSE lag(id) OVER w END AS cause FROM envelopes WINDOW w AS (PARTITION BY correlation_id ORDER BY arrival))"""


@query("WITH RECURSIVE" + with_envelopes(f"""{CAUSES_SQL},
walk AS (SELECT id, id AS root, 0::BIGINT AS depth FROM caused WHERE cause IS NULL UNION ALL SELECT c.id, w.root, w.depth + 1 FROM walk w JOIN caused c ON c.cause = w.id)
SELECT c.id, root, depth FROM caused c LEFT JOIN walk USING (id)""").removeprefix("WITH"))
def causation_chains(spark, sf_dir):
    """An extension: the root of each event's chain of causes, and how far away it is; null in circles."""
    own = Window.partitionBy("correlation_id")
    before = F.lag("id").over(own.orderBy("arrival"))
    last = F.max_by("id", "arrival").over(own)
    circle = F.split_part("correlation_id", F.lit("_"), F.lit(2)).cast("int") % 11 == 0
    cause = F.when(F.col("arrival") % 5 == 0, None).when(before.isNull() & circle, last).otherwise(before)
    return chains.chains(_envelopes(spark, sf_dir).withColumn("causation_id", cause))


#: Names made of the events' types, and by the arrival such as no subscription may have.
NAME_SQL = "CASE arrival % 8 WHEN 1 THEN upper(type) WHEN 2 THEN replace(type, '.', '..') WHEN 3 THEN '-' || type WHEN 4 THEN type || '/x' WHEN 5 THEN '' WHEN 6 THEN type || repeat('x', 64) WHEN 7 THEN type || chr(10) ELSE type || '_1-2' END"


@query(with_envelopes("SELECT id, arrival % 8 = 0 AS registered, arrival % 8 IN (0, 2) AS stored FROM envelopes"))
def name_check(spark, sf_dir):
    """Names that the registry takes, and those that the ledger takes, which may have two dots in a row."""
    rows = _envelopes(spark, sf_dir).withColumn("name", F.expr(NAME_SQL))
    return rows.select("id", named_well(F.col("name"), REGISTERED).alias("registered"), named_well(F.col("name"), STORED).alias("stored"))


@query(with_envelopes("SELECT event_type AS name, event_type || '.*' AS pattern, 'events/' || event_type || '/+' AS filter, 'streamledger-' || event_type AS \"clientId\", CASE WHEN event_type = 'click' THEN 'ops' ELSE 'streamledger-' || event_type END AS owner FROM (SELECT DISTINCT event_type FROM events) WHERE event_type <> 'view' ORDER BY 1"))
def registry_scan(spark, sf_dir):
    """A subscription for each type of event, put once, one of them removed; the rest by name."""
    registry = Registry(spark, scratch(spark, "registry"))
    for r in adapter.events(spark, sf_dir).select("event_type").distinct().collect():  # types of events: few
        registry.add(r[0], f"{r[0]}.*", "ops" if r[0] == "click" else None)
    if registry.get("view"):
        registry.remove("view")
    return registry.frame().select("name", "pattern", "filter", "clientId", "owner")


#: Payloads whose data is broken inside, and whose keys are misspelt.
DEEP_SQL = """CASE arrival % 6 WHEN 1 THEN '{"a":[1,{"b":NaN}]}' WHEN 2 THEN '{"x":' || repeat('[', 32) || '1' || repeat(']', 32) || '}' WHEN 3 THEN '{"x":' || repeat('[', 31) || '1' || repeat(']', 31) || '}' WHEN 4 THEN '{"n":-Infinity,"m":[NaN,NaN]}' ELSE data END"""


@query(with_envelopes("SELECT id, CASE arrival % 6 WHEN 1 THEN 'data.a[1].b:malformed' WHEN 2 THEN 'data.x' || repeat('[0]', 31) || ':too_deep' WHEN 4 THEN 'data.n:malformed,data.m[0]:malformed,data.m[1]:malformed' ELSE '' END AS found FROM envelopes"))
def deep_data_check(spark, sf_dir):
    """Problems inside data with their paths."""
    rows = _envelopes(spark, sf_dir).withColumn("data", F.expr(DEEP_SQL))
    parsed = wire.parse_payloads(rows.select(F.col("id").alias("event"), wire.to_wire_json().alias("payload")).withColumnRenamed("event", "key"))
    return parsed.select(F.col("key").alias("id"), F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(":"), e["code"])), ",").alias("found"))


@query(with_envelopes("SELECT id, CASE arrival % 4 WHEN 1 THEN 'run_id: is not part of an envelope; did you mean runId?' WHEN 2 THEN 'SCHEMA-VERSION: is not part of an envelope; did you mean schemaVersion?' WHEN 3 THEN left('k' || repeat('x', 300) || ': is not part of an envelope; producers'' own values belong in data', 200) ELSE '' END AS reason FROM envelopes"))
def skip_reason_texts(spark, sf_dir):
    """Misspelt keys are told with the name that was meant; reasons have at most 200 characters."""
    extra = F.when(F.col("arrival") % 4 == 1, '"run_id":1').when(F.col("arrival") % 4 == 2, '"SCHEMA-VERSION":1').when(F.col("arrival") % 4 == 3, F.concat(F.lit('"k'), F.repeat(F.lit("x"), 300), F.lit('":1')))
    payload = wire.to_wire_json()
    rows = _envelopes(spark, sf_dir).select(F.col("id").alias("key"), F.when(extra.isNull(), payload).otherwise(F.concat(F.lit("{"), extra, F.lit(","), F.substring(payload, 2, 1 << 30))).alias("payload"))
    return wire.parse_payloads(rows).select(F.col("key").alias("id"), drains.reason().alias("reason"))


@query(with_envelopes("SELECT count(*) AS n, count(*) AS distinct_ids, 30 AS chars FROM envelopes"))
def minted_ids(spark, sf_dir):
    """A fresh id for each event: all differ, and have the form of one."""
    root = scratch(spark, "minted")
    _envelopes(spark, sf_dir).select(ids.new_ids().alias("id")).write.parquet(root)
    rows = spark.read.parquet(root).where(fields.identifier_problem(F.col("id")).isNull())
    return rows.agg(F.count("*").alias("n"), F.countDistinct("id").alias("distinct_ids"), F.max(F.length("id")).alias("chars"))


# Streams


#: A trigger's rows, where one key may have them all.
TRIGGER_ROWS = 1 << 20


def _pieces(rows: DataFrame, root: str, by: str, parts: int, most: int | None = None, key: str | None = None) -> int:
    """Writes rows in pieces by a number or time, a folder each; returns how many. most: about so many rows in a piece, of which there are more then; with key, so many of any one key."""
    each = rows.groupBy(*[key] if key else []).agg(F.min(by).cast("double").alias("low"), F.max(by).cast("double").alias("high"), F.count("*").alias("n"))
    edges = each.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("n").alias("n")).first()
    if edges["low"] is None:
        rows.write.parquet(f"{root}-pieces/piece=0")
        return 1
    parts = max(parts, -(-edges["n"] // most)) if most else parts
    piece = F.least(F.floor((F.col(by).cast("double") - edges["low"]) * parts / max(edges["high"] - edges["low"], 1e-9)), F.lit(parts - 1))
    rows.withColumn("piece", piece).write.partitionBy("piece").parquet(f"{root}-pieces")
    return parts


def _in_order(rows: DataFrame, root: str, by: str, parts: int, run: Callable[[str], None], most: int | None = None) -> None:
    """Each piece of the rows is run over before the next is there."""
    parts = _pieces(rows, root, by, parts, most)
    files = Files(rows.sparkSession, root.rpartition("/")[0])
    whole = root.rpartition("/")[2]
    for k in range(parts):
        for name in files.names(f"{whole}-pieces/piece={k}"):
            files.move(f"{whole}-pieces/piece={k}/{name}", f"{whole}/{k}-{name}")
        run(root)


@query(with_ledger("SELECT subscription, seq, id FROM ledger"))
def stream_seq_state(spark, sf_dir):
    """Numbers from keyed state, over several triggers, equal those of the batch form."""
    root = scratch(spark, "sequencer")
    rows = adapter.matched(spark, sf_dir).select("subscription", "arrival", "id")
    parts, files = _pieces(rows, f"{root}/in", "arrival", 3, TRIGGER_ROWS, "subscription"), Files(spark, root)
    # a piece comes as a folder that gets its name at once, so that no trigger has a part of it
    steps = [lambda k=k: files.move(f"in-pieces/piece={k}", f"in/{k}") for k in range(parts) if files.exists(f"in-pieces/piece={k}")]
    stateful.run_through(stateful.sequenced(spark.readStream.schema(rows.schema).parquet(f"{root}/in/*")), f"{root}/out", f"{root}/state", steps)
    return spark.read.schema("subscription string, seq bigint, id string").parquet(f"{root}/out")


QUEUED = "subscription string, arrival bigint, id string, kind string, n bigint"


def _kept(spark: SparkSession, rows: DataFrame, parts: int) -> DataFrame:
    root = scratch(spark, "queue")

    def run(path: str) -> None:
        stateful.run_once(stateful.queued(spark.readStream.schema(QUEUED).parquet(path), backlog.MAX_QUEUED), f"{root}/out", f"{root}/state")

    _in_order(rows, f"{root}/in", "arrival", parts, run, TRIGGER_ROWS)
    return spark.read.schema("subscription string, arrival bigint, id string, kept boolean").parquet(f"{root}/out").where("kept")


def _to_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.matched(spark, sf_dir).select("subscription", "arrival", "id", F.lit("message").alias("kind"), F.lit(0).cast("bigint").alias("n"))


@query(with_envelopes("SELECT subscription, count(*) AS kept, max(arrival) AS last FROM (SELECT * FROM matched QUALIFY row_number() OVER (PARTITION BY subscription ORDER BY arrival) <= 1000) GROUP BY subscription"))
def stream_backlog_overflow(spark, sf_dir):
    """A queue in keyed state keeps its oldest messages over several triggers."""
    kept = _kept(spark, _to_queue(spark, sf_dir), 4)
    return kept.groupBy("subscription").agg(F.count("*").alias("kept"), F.max("arrival").alias("last"))


@query(with_envelopes("SELECT subscription, count(*) AS kept, max(arrival) AS last FROM (SELECT *, arrival // 8000 AS turn FROM matched QUALIFY row_number() OVER (PARTITION BY subscription, arrival // 8000 ORDER BY arrival) <= 1000) GROUP BY subscription"))
def stream_backlog_drained(spark, sf_dir):
    """The same with drains between: every 8000 arrivals the queue is emptied, and has room again."""
    rows = _to_queue(spark, sf_dir)
    turns = rows.select("subscription", F.floor(F.col("arrival") / 8000).alias("turn")).distinct()
    taken = turns.select("subscription", (F.col("turn") * 8000).alias("arrival"), F.lit("").alias("id"), F.lit("taken").alias("kind"), F.lit(backlog.MAX_QUEUED).cast("bigint").alias("n"))
    kept = _kept(spark, rows.unionByName(taken), 3)
    return kept.groupBy("subscription").agg(F.count("*").alias("kept"), F.max("arrival").alias("last"))


DAY_MS = 86_400_000


@query(f"""WITH heard AS (SELECT 'u' || user_id AS producer, epoch_us(ts) // 1000 AS "at" FROM events),
gaps AS (SELECT *, lag("at") OVER w AS before, lead("at") OVER w AS next FROM heard WINDOW w AS (PARTITION BY producer ORDER BY "at"))
SELECT producer, 'online' AS state, "at" FROM gaps WHERE before IS NULL OR "at" - before > {DAY_MS}
UNION ALL SELECT producer, 'lost' AS state, "at" + {DAY_MS} AS "at" FROM gaps WHERE coalesce(next, (SELECT max("at") FROM heard)) - "at" > {DAY_MS}""")
def availability_changes(spark, sf_dir):
    """Producers come online with a message and are lost a day after their last, by timers on event time over several triggers."""
    root = scratch(spark, "availability")
    rows = adapter.events(spark, sf_dir).select(F.concat(F.lit("u"), "user_id").alias("producer"), F.col("ts").cast("timestamp").alias("ts"))

    def run(path: str) -> None:
        stateful.run_once(stateful.availability(spark.readStream.schema(rows.schema).parquet(path), DAY_MS), f"{root}/out", f"{root}/state")

    _in_order(rows, f"{root}/in", "ts", 3, run)
    return spark.read.schema(stateful.CHANGES).parquet(f"{root}/out")


def _published(spark: SparkSession, events: DataFrame) -> str:
    """The root of a new ledger whose broker holds these events for the subscription `clicks`."""
    root = scratch(spark, "drain")
    streams.add_subscription(spark, root, "clicks", "click.*")
    streams.emit(spark, root, events, "arrival")
    return root


def _ledger_ids(spark: SparkSession, root: str) -> DataFrame:
    return Ledger(spark, root).rows().select("subscription", "seq", "id")


CLICKS_SQL = "SELECT 'clicks' AS subscription, row_number() OVER (ORDER BY arrival) AS seq, id FROM envelopes WHERE regexp_full_match(type, 'click\\.[^.]+')"


@query(with_envelopes(CLICKS_SQL))
def stream_drain_whole(spark, sf_dir):
    """The whole table is emitted, and bounded drains run until the backlog is empty."""
    root = _published(spark, _envelopes(spark, sf_dir))
    streams.drain_all(spark, root, "clicks", max=1000, timeout=600)
    return _ledger_ids(spark, root)


@query(with_envelopes(f"SELECT * FROM ({CLICKS_SQL}) WHERE seq <= 1000"))
def stream_drain_available_now(spark, sf_dir):
    """The whole table is emitted; one bounded drain takes the oldest messages of the backlog."""
    root = _published(spark, _envelopes(spark, sf_dir))
    streams.drain_subscription(spark, root, "clicks", max=1000, timeout=600)
    return _ledger_ids(spark, root)


@query(with_envelopes(f"SELECT * FROM ({CLICKS_SQL}) WHERE seq <= {backlog.MAX_QUEUED}"))
def stream_drain_bounded(spark, sf_dir):
    """The whole table is emitted while nobody drains: the bounded queue has the oldest messages, and drains find no others."""
    root = _published(spark, _envelopes(spark, sf_dir))
    streams.drain_all(spark, root, "clicks", max=600, timeout=600, max_queued=backlog.MAX_QUEUED)
    return _ledger_ids(spark, root)


@query(with_envelopes(f"SELECT * FROM ({CLICKS_SQL}) WHERE seq BETWEEN 11 AND 70"))
def stream_watch(spark, sf_dir):
    """The whole table is emitted and 30 messages are drained; a watch gives the history after 10, and the rest of its 60 rows by a drain."""
    root = _published(spark, _envelopes(spark, sf_dir))
    streams.drain_subscription(spark, root, "clicks", max=30, timeout=600)
    rows, _ = streams.watch(spark, root, "clicks", since=10, max=60, timeout=600)
    return spark.createDataFrame([(r["subscription"], r["seq"], r["id"]) for r in rows], "subscription string, seq bigint, id string")


@query(with_envelopes(f"SELECT * FROM ({CLICKS_SQL}) WHERE seq <= 60"))
def stream_resubscribed(spark, sf_dir):
    """A checkpoint is lost between two drains: messages come again, and nothing is stored twice."""
    root = _published(spark, _envelopes(spark, sf_dir))
    for bound in (40, 60):
        Files(spark, root).delete("checkpoints/clicks")
        streams.drain_subscription(spark, root, "clicks", max=bound, timeout=600)
    return _ledger_ids(spark, root)


@query(with_envelopes(f"SELECT * FROM ({CLICKS_SQL}) WHERE seq <= 25"))
def stream_resume(spark, sf_dir):
    """The whole table is emitted; a second drain goes on where the first stopped."""
    root = _published(spark, _envelopes(spark, sf_dir))
    for bound in (10, 15):
        streams.drain_subscription(spark, root, "clicks", max=bound, timeout=600)
    return _ledger_ids(spark, root)
