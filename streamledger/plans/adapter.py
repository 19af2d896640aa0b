"""The plain `events` table as envelopes, deliveries and subscriptions, in DataFrame form and in SQL.

Redeliveries (ids divisible by 10 arrive twice) and broken payloads (ids divisible
by 17) follow from the ids, so both forms give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamledger.functions.times import format_time
from streamledger.functions.topics import type_to_topic
from streamledger.operators.ledger import Ledger
from streamledger.operators.matching import compiled, fan_out
from streamledger.operators.sequencing import appended
from streamledger.schema import STORE_FORMAT_VERSION
from streamledger.session import scratch

#: Name and pattern of the subscriptions that the queries use.
SUBSCRIPTIONS = [("all-plain", "*.*"), ("clicks", "click.*"), ("high-retries", "*.high.retry"), ("purchases-low", "purchase.low"), ("retries", "*.*.retry")]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def envelopes(raw: DataFrame) -> DataFrame:
    """arrival, ts and the envelope's columns; ts is the instant in UTC."""
    kind = F.concat("event_type", F.when(F.col("value") >= 50, ".high").otherwise(".low"), F.when(F.col("user_id") % 5 == 0, ".retry").otherwise(""))
    none: Column = F.lit(None).cast("string")
    ts = F.col("ts").cast("timestamp")
    return raw.select(
        F.col("event_id").alias("arrival"),
        ts.alias("ts"),
        F.concat(F.lit("evt_"), F.lpad(F.col("event_id").cast("string"), 26, "0")).alias("id"),
        kind.alias("type"),
        F.concat(F.lit("app://user/"), F.col("user_id").cast("string")).alias("source"),
        format_time(ts).alias("time"),
        F.lit("1.0").alias("schema_version"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("correlation_id"),
        none.alias("causation_id"),
        none.alias("run_id"),
        none.alias("traceparent"),
        none.alias("producer"),
        F.lit(None).cast("bigint").alias("delivery_attempt"),
        F.col("props").alias("data"),
    )


def subscriptions(spark: SparkSession) -> DataFrame:
    return compiled(spark.createDataFrame(SUBSCRIPTIONS, "name string, pattern string"))


def deliveries(raw: DataFrame) -> DataFrame:
    """Envelopes as they arrive: every id once, those divisible by 10 again a little later."""
    once = envelopes(raw)
    first = once.withColumns({"arrival": F.col("arrival") * 4, "delivery_attempt": F.lit(1).cast("bigint")})
    again = once.where("arrival % 10 = 0").withColumns({"arrival": F.col("arrival") * 4 + 21, "delivery_attempt": F.lit(2).cast("bigint")})
    return first.unionByName(again).withColumn("topic", type_to_topic(F.col("type")))


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fan_out(deliveries(events(spark, sf_dir)), subscriptions(spark))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the deliveries leave in an empty ledger. recorded_at is the event's time: results must not hang on the clock."""
    return appended(matched(spark, sf_dir)).withColumn("recorded_at", F.col("time"))


#: Ledgers that this process has written, by application and folder of the tables.
WRITTEN: dict[tuple[str, str], str] = {}


def stored_ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    """The same ledger, written once for each session and data folder, as its readers have it."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in WRITTEN:
        root = scratch(spark, "ledger")
        rows = ledger(spark, sf_dir).withColumn("store_format_version", F.lit(STORE_FORMAT_VERSION))
        Ledger(spark, root).backend.append(rows, "all", ("subscription", "seq"))
        WRITTEN[key] = root
    return Ledger(spark, WRITTEN[key])


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its rows: filters on the subscription prune folders, others reach the scan."""
    return stored_ledger(spark, sf_dir).rows()


def device_events(raw: DataFrame) -> DataFrame:
    """id and topic of the events with types of four segments, the last two a user and one of fifty channels."""
    kind = F.when(F.col("value") >= 50, "high").otherwise("low")
    segments = F.concat_ws("/", F.lit("events"), "event_type", kind, F.concat(F.lit("u"), "user_id"), F.concat(F.lit("k"), F.col("event_id") % 50))
    return raw.select("event_id", segments.alias("topic"))


#: A pattern for every user and event type, in four shapes.
DEVICE_PATTERN = "CASE user_id % 4 WHEN 0 THEN event_type || '.*.u' || user_id || '.*' WHEN 1 THEN '*.high.u' || user_id || '.*' WHEN 2 THEN '*.*.u' || user_id || '.k' || (user_id % 50) ELSE event_type || '.low.u' || user_id || '.k' || (user_id % 50) END"


def device_subscriptions(raw: DataFrame) -> DataFrame:
    pairs = raw.select("event_type", "user_id").distinct()
    return compiled(pairs.select(F.concat("event_type", F.lit("-u"), "user_id").alias("name"), F.expr(DEVICE_PATTERN).alias("pattern")))


ENVELOPES_SQL = """
envelopes AS (SELECT event_id AS arrival, ts, 'evt_' || lpad(event_id::VARCHAR, 26, '0') AS id,
  event_type || CASE WHEN value >= 50 THEN '.high' ELSE '.low' END || CASE WHEN user_id % 5 = 0 THEN '.retry' ELSE '' END AS type,
  'app://user/' || user_id AS source, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS time, '1.0' AS schema_version,
  'user_' || user_id AS correlation_id, props AS data FROM events)"""

SUBSCRIPTIONS_SQL = "subs AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in SUBSCRIPTIONS) + ") AS t(subscription, pattern))"

DELIVERIES_SQL = """
deliveries AS (SELECT * REPLACE (arrival * 4 AS arrival), 1 AS delivery_attempt, 'events/' || replace(type, '.', '/') AS topic FROM envelopes
  UNION ALL SELECT * REPLACE (arrival * 4 + 21 AS arrival), 2 AS delivery_attempt, 'events/' || replace(type, '.', '/') AS topic FROM envelopes WHERE arrival % 10 = 0)"""

MATCHED_SQL = """
matched AS (SELECT d.*, s.subscription FROM deliveries d JOIN subs s
  ON regexp_full_match(d.type, replace(replace(s.pattern, '.', '\\.'), '*', '[^.]+')))"""

#: Numbers come after copies are gone, so they are a step of their own.
LEDGER_SQL = """
firsts AS (SELECT * FROM matched QUALIFY row_number() OVER (PARTITION BY subscription, id ORDER BY arrival) = 1),
ledger AS (SELECT *, row_number() OVER (PARTITION BY subscription ORDER BY arrival) AS seq, time AS recorded_at FROM firsts)"""


def with_ledger(query: str) -> str:
    return f"WITH {', '.join([ENVELOPES_SQL, SUBSCRIPTIONS_SQL, DELIVERIES_SQL, MATCHED_SQL, LEDGER_SQL])} {query}"


def with_envelopes(query: str) -> str:
    return f"WITH {ENVELOPES_SQL}, {SUBSCRIPTIONS_SQL}, {DELIVERIES_SQL}, {MATCHED_SQL} {query}"
