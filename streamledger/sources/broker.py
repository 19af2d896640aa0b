"""A durable broker in files: published messages in order of arrival, and each subscription's backlog as a streaming source.

The source `event_backlog` hands a subscription's messages to Structured
Streaming: one read takes at most `max` of them, after the offset that the
checkpoint holds, and a commit notes how far the subscription was drained. With
`availableNow` one run is one bounded drain. Where a broker is remote, its client
takes the place of `BacklogReader.captured`; the rest stays. With `max_queued` a
subscription's queue is bounded: what came while it was full is dropped for good.

Any number of publishers may write at once. A batch is written under a name of its own and
is published by its claim of the next number, which only one publisher can create;
what a claim says (folder, arrivals before it, messages) gives its messages their
arrivals, so that a drain which has passed an arrival has seen all before it.
"""

from __future__ import annotations

import bisect
import json
import posixpath
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from streamledger.errors import BrokerUnavailable, InvalidBound
from streamledger.functions.topics import in_lane
from streamledger.operators.backlog import retained
from streamledger.operators.sequencing import numbered
from streamledger.sources.committed import CommittedTable

MESSAGES = T.StructType([T.StructField("arrival", T.LongType()), T.StructField("topic", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("qos", T.IntegerType()), T.StructField("retain", T.BooleanType()), T.StructField("batch", T.StringType())])

#: What the source hands out, and how many rows of a file are looked at at once.
READ = pa.schema([("arrival", pa.int64()), ("topic", pa.string()), ("payload", pa.string()), ("qos", pa.int32()), ("retain", pa.bool_())])
ROWS = 1 << 14


#: Seconds that a claim which another publisher is just writing is waited for.
PATIENCE = 10.0


@dataclass(frozen=True)
class Claim:
    """A published batch: its folder, the arrivals before it, and how many messages it has."""

    batch: str
    base: int
    count: int

    @property
    def last(self) -> int:
        return self.base + self.count

    @classmethod
    def parse(cls, text: str) -> Claim | None:
        parts = text.split()
        return cls(parts[0], int(parts[1]), int(parts[2])) if len(parts) == 3 and text.endswith("\n") else None

    def text(self) -> str:
        return f"{self.batch} {self.base} {self.count}\n"


class Broker:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, f"{root.rstrip('/')}/broker"
        self.table = CommittedTable(spark, self.root, MESSAGES)
        self.files = self.table.files

    def claim(self, number: int) -> Claim:
        """The claim of a number that is taken. One that stays empty is an error, as its messages would be lost by going on."""
        name, until = f"batches/{number:012d}", time.monotonic() + PATIENCE
        while (found := Claim.parse(self.files.read(name))) is None:
            if time.monotonic() > until:
                raise BrokerUnavailable(f"{self.root}/{name} is incomplete", "remove it if its publisher is gone; its messages were not published")
            time.sleep(0.05)
        return found

    def claims(self) -> list[Claim]:
        return [self.claim(int(n)) for n in self.table.batches()]

    def messages(self) -> DataFrame:
        """All messages with their arrivals, 1, 2, 3, ..."""
        claims = self.claims()
        if not claims:
            return self.spark.createDataFrame([], self.table.schema)
        bases = self.spark.createDataFrame([(c.batch, c.base) for c in claims], "batch string, base bigint")
        rows = self.spark.read.schema(self.table.schema).parquet(f"{self.root}/data").join(F.broadcast(bases), "batch")
        return rows.withColumn("arrival", F.col("arrival") + F.col("base")).select(*self.table.schema.names)

    def last_arrival(self) -> int:
        names = self.table.batches()
        return self.claim(int(names[-1])).last if names else 0

    def publish(self, messages: DataFrame, order: str, qos: int = 1, retain: bool = False) -> int:
        """Appends messages (topic, payload; qos and retain if they have them) in the order of a column, in which none may be null; returns how many arrived."""
        for name, value in (("qos", qos), ("retain", retain)):
            if name not in messages.columns:
                messages = messages.withColumn(name, F.lit(value))
        rows = messages.withColumns({"subscription": F.lit(""), "id": F.concat("topic", F.lit(" "), "payload"), "arrival": F.col(order).cast("bigint")})
        batch = uuid.uuid4().hex
        count = self.table.write(numbered(rows).withColumn("arrival", F.col("seq")), batch, ("arrival",)).count()
        while True:
            names = self.table.batches()
            number, base = (int(names[-1]) + 1, self.claim(int(names[-1])).last) if names else (1, 0)
            if self.files.create(f"batches/{number:012d}", Claim(batch, base, count).text()):
                return count

    def retained(self) -> DataFrame:
        return retained(self.messages())

    def lane(self) -> DataFrame:
        return self.messages().where(in_lane(F.col("topic")))


def whole_option(options: dict, name: str, default: int, least: int) -> int:
    """A whole number among a source's options; anything else is an error before a message is read."""
    text = str(options.get(name, default))
    if not re.fullmatch(r"[0-9]+", text) or int(text) < least:
        raise InvalidBound(f"{name} must be a whole number of {least} or more, not {text!r}")
    return int(text)


def matches(filter_: str, topic: str) -> bool:
    """The rule of topic_matches for filters of subscriptions, which have no #: as many levels, each the same or +."""
    want, have = filter_.split("/"), topic.split("/")
    return len(want) == len(have) and all(w in ("+", h) for w, h in zip(want, have, strict=True))


@dataclass
class Group(InputPartition):
    """A row group of a batch's file, the arrivals before the batch, and the arrivals that are wanted; one task reads it."""

    file: str
    group: int
    base: int
    after: int
    upto: int


class BacklogReader(DataSourceStreamReader):
    """The driver finds where the next `max` messages end, from arrivals and topics alone and a piece at a time; tasks read the messages."""

    def __init__(self, options: dict):
        self.root, self.filter = options["path"].rstrip("/"), options["filter"]
        self.created, self.max = whole_option(options, "created", 0, 0), whole_option(options, "max", 100, 1)
        self.bound = whole_option(options, "max_queued", 0, 1) if "max_queued" in options else None
        self.name = options.get("name", "")
        if not self.filter or "#" in self.filter:
            raise InvalidBound(f"filter: no filter of a subscription: {self.filter!r}")
        self.after: int | None = None

    def files(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith(("/", "file:")) else (pafs.LocalFileSystem(), self.root)

    def initialOffset(self) -> dict:
        return {"arrival": self.created}

    def claims(self, after: int) -> Iterator[Claim]:
        """Claims with arrivals beyond `after`, in order. One that is just being written ends them: it comes with the next read."""
        fs, root = self.files()
        marks = fs.get_file_info(pafs.FileSelector(posixpath.join(root, "batches"), allow_not_found=True))
        names = sorted(m.path for m in marks if m.is_file and not posixpath.basename(m.path).startswith("."))

        def claim(path: str) -> Claim | None:
            with fs.open_input_file(path) as f:
                return Claim.parse(f.read().decode())

        first = bisect.bisect_right(names, after, key=lambda p: c.last if (c := claim(p)) else 1 << 62)
        for path in names[first:]:
            found = claim(path)
            if found is None:
                return
            yield found

    def groups(self, after: int, upto: int | None = None) -> Iterator[Group]:
        """Row groups with arrivals in (after, upto] in order of arrival; batches are looked at only when they are needed."""
        fs, root = self.files()
        for claim in self.claims(after):
            if upto is not None and claim.base >= upto:
                return
            found = []
            for f in fs.get_file_info(pafs.FileSelector(posixpath.join(root, "data", f"batch={claim.batch}"), allow_not_found=True)):
                if f.is_file and f.path.endswith(".parquet") and not posixpath.basename(f.path).startswith((".", "_")):
                    with fs.open_input_file(f.path) as file:
                        meta = pq.ParquetFile(file).metadata
                    column = meta.schema.to_arrow_schema().get_field_index("arrival")
                    for k in range(meta.num_row_groups):
                        if meta.row_group(k).num_rows:
                            held = meta.row_group(k).column(column).statistics  # Spark always writes them for a bigint
                            found.append((held.min + claim.base, held.max + claim.base, f.path, k))
            found.sort()
            yield from (Group(file, k, claim.base, after, -1 if upto is None else upto) for least, most, file, k in found if most > after and (upto is None or least <= upto))

    def captured(self, group: Group, columns: list[str]) -> Iterator[pa.Table]:
        """The subscription's messages of a row group in order of arrival (the order in which they are written)."""
        with self.files()[0].open_input_file(group.file) as file:
            for batch in pq.ParquetFile(file).iter_batches(ROWS, [group.group], [*dict.fromkeys([*columns, "arrival", "topic", "qos"])]):
                rows = pa.Table.from_batches([batch])
                rows = rows.set_column(rows.column_names.index("arrival"), "arrival", pc.add(rows["arrival"], group.base))
                keep = pc.and_(pc.greater(rows["arrival"], group.after), pc.greater_equal(rows["qos"], 1))
                if group.upto >= 0:
                    keep = pc.and_(keep, pc.less_equal(rows["arrival"], group.upto))
                rows = rows.filter(keep)
                for low, high in self.dropped():
                    rows = rows.filter(pc.or_(pc.less_equal(rows["arrival"], low), pc.greater(rows["arrival"], high)))
                topics = [t for t in pc.unique(rows["topic"]).to_pylist() if t is not None and matches(self.filter, t)]
                yield rows.filter(pc.is_in(rows["topic"], pa.array(topics, pa.string()))).select(columns)

    def dropped(self) -> list[tuple[int, int]]:
        """Ranges of arrivals (from, upto] that the full queue of this subscription did not take."""
        if self.bound is None:
            return []
        fs, root = self.files()
        if fs.get_file_info(place := posixpath.join(root, "dropped", self.name)).type == pafs.FileType.NotFound:
            return []
        with fs.open_input_file(place) as f:
            return [tuple(r) for r in json.loads(f.read())]

    def drop(self, low: int, high: int) -> None:
        """Notes one more range, by a file that takes the old one's place as a whole."""
        ranges = [*self.dropped(), (low, high)]
        fs, root = self.files()
        place = posixpath.join(root, "dropped", self.name)
        fs.create_dir(posixpath.dirname(place), recursive=True)
        with fs.open_output_stream(f"{place}.new") as f:
            f.write(json.dumps(ranges).encode())
        fs.move(f"{place}.new", place)

    def overflow(self, after: int) -> None:
        """Drops what came while the queue was full: of the messages after an arrival the oldest `bound` are in it, all others that are there by now were dropped as they came."""
        left, last = self.bound, after
        for group in self.groups(after):
            for rows in self.captured(group, ["arrival"]):
                if rows.num_rows > left:
                    edge = rows["arrival"][left - 1].as_py() if left else last
                    self.drop(edge, [c.last for c in self.claims(after)][-1])
                    return
                if rows.num_rows:
                    left, last = left - rows.num_rows, rows["arrival"][-1].as_py()

    def latestOffset(self) -> dict:
        after = self.created if self.after is None else self.after
        if self.bound is not None:
            self.overflow(after)
        last, left = after, self.max
        for group in self.groups(after):
            for rows in self.captured(group, ["arrival"]):
                if rows.num_rows:
                    last = rows["arrival"][min(left, rows.num_rows) - 1].as_py()
                    left -= rows.num_rows
                if left <= 0:
                    return {"arrival": last}
        return {"arrival": last}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        """On a restart Spark asks for the batch planned last or for the empty range after it, so this is where the next batch begins."""
        self.after = end["arrival"]
        return list(self.groups(start["arrival"], end["arrival"])) if start["arrival"] < end["arrival"] else []

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        for rows in self.captured(partition, READ.names):
            yield from rows.cast(READ).to_batches()

    def commit(self, end: dict) -> None:
        """Offsets live in the checkpoint; a remote broker's messages up to here would be acknowledged now."""


class BacklogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_backlog"

    def schema(self) -> str:
        return "arrival bigint, topic string, payload string, qos int, retain boolean"

    def streamReader(self, schema: T.StructType) -> BacklogReader:
        return BacklogReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BacklogSource)
