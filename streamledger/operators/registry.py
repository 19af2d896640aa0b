"""Durable subscriptions: one small file each, created once, never overwritten."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamledger.errors import CorruptRegistry, FieldProblem, InvalidName, InvalidTopic, SubscriptionExists, UnknownSubscription
from streamledger.functions.topics import pattern_problems, pattern_to_filter
from streamledger.schema import REGISTRY_FORMAT_VERSION, SUBSCRIPTION
from streamledger.sources.committed import Files

#: Client ids are the name behind this, so different names never share a session.
CLIENT_PREFIX = "streamledger-"
NAME = re.compile(r"(?!.*\.\.)[a-z0-9][a-z0-9._-]{0,63}")


def check_registered_name(name: object) -> str:
    """Stricter than the ledger's names: no two dots in a row."""
    if not isinstance(name, str) or not NAME.fullmatch(name):
        raise InvalidName(f"no valid subscription name: {name!r}")
    return name


def named_well(name: Column, grammar: re.Pattern[str] = NAME) -> Column:
    """The same check for many names."""
    return F.coalesce(name.rlike(rf"\A(?:{grammar.pattern})\z"), F.lit(False))


@dataclass(frozen=True)
class Subscription:
    name: str
    pattern: str
    filter: str
    owner: str
    clientId: str
    created: str
    registryFormatVersion: str = REGISTRY_FORMAT_VERSION


class Registry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, f"{root.rstrip('/')}/subscriptions"
        self.files = Files(spark, self.root)

    def add(self, name: str, pattern: str, owner: str | None = None) -> Subscription:
        check_registered_name(name)
        row = self.spark.range(1).select(pattern_problems(F.lit(pattern)).alias("codes"), pattern_to_filter(F.lit(pattern)).alias("filter")).first()
        if row["codes"]:
            raise InvalidTopic([FieldProblem("pattern", c, pattern) for c in row["codes"]])
        client = CLIENT_PREFIX + name
        created = datetime.now(UTC).isoformat(timespec="microseconds").replace("+00:00", "Z")
        made = Subscription(name, pattern, row["filter"], owner or client, client, created)
        if not self.files.create(f"{name}.json", json.dumps(asdict(made))):
            raise SubscriptionExists(f"subscription {name} exists")
        return made

    def _load(self, name: str) -> Subscription:
        try:
            found = Subscription(**json.loads(self.files.read(f"{name}.json")))
            good = found.name == name and found.registryFormatVersion == REGISTRY_FORMAT_VERSION and all(isinstance(v, str) for v in asdict(found).values())
        except (ValueError, TypeError) as e:
            raise CorruptRegistry(f"{self.root}/{name}.json can't be read: {e}") from e
        if not good:
            raise CorruptRegistry(f"{self.root}/{name}.json holds no subscription {name} of format {REGISTRY_FORMAT_VERSION}")
        return found

    def get(self, name: str) -> Subscription | None:
        check_registered_name(name)
        return self._load(name) if self.files.exists(f"{name}.json") else None

    def require(self, name: str) -> Subscription:
        found = self.get(name)
        if found is None:
            raise UnknownSubscription(f"no subscription {name}")
        return found

    def names(self) -> list[str]:
        return [n.removesuffix(".json") for n in self.files.names("") if n.endswith(".json")]

    def list(self) -> list[Subscription]:
        return [self._load(n) for n in self.names()]

    def remove(self, name: str) -> Subscription:
        found = self.require(name)
        self.files.delete(f"{name}.json")
        return found

    def frame(self) -> DataFrame:
        """All subscriptions as a DataFrame, by name."""
        if not self.names():
            return self.spark.createDataFrame([], SUBSCRIPTION)
        return self.spark.read.schema(SUBSCRIPTION).json(f"{self.root}/*.json", multiLine=True).orderBy("name")
