"""What a broker keeps for a subscription before it is drained: bounds, quality of service, capture times, retained values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_QUEUED = 1000


def kept_on_overflow(messages: DataFrame, bound: int = MAX_QUEUED, by: str = "subscription") -> DataFrame:
    """The oldest `bound` messages of each queue: later ones are dropped as they come."""
    order = Window.partitionBy(by).orderBy("arrival")
    return messages.withColumn("place", F.row_number().over(order)).where(F.col("place") <= bound).drop("place")


def captured(messages: DataFrame, created: Column) -> DataFrame:
    """Messages that a durable subscription holds: published at quality 1 or 2, after it was created."""
    return messages.where((F.col("qos") >= 1) & (F.col("arrival") > created))


def retained(messages: DataFrame) -> DataFrame:
    """The last retained payload of each topic; an empty one clears the topic."""
    last = messages.where("retain").groupBy("topic").agg(F.max_by("payload", "arrival").alias("payload"), F.max("arrival").alias("arrival"))
    return last.where(F.col("payload") != "")


def with_attempt(messages: DataFrame) -> DataFrame:
    """Messages with their delivery attempt: how often their id arrived so far."""
    return messages.withColumn("delivery_attempt", F.row_number().over(Window.partitionBy("id").orderBy("arrival")).cast("bigint"))
