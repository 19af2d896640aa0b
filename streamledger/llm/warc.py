"""WARC archives as a Python data source (operator 4).

`spark.read.format("warc")` and `df.write.format("warc")`, after `register`.
Archives are gzipped record by record. Each gzip member carries its own length in
an extra field, so a reader inflates the first bytes of a record, parses its WARC
and HTTP headers, tests the pushed predicates on them, and seeks to the next
record without inflating the payload of an unwanted one; members of other
writers, which lack the field, are inflated through. A schema without the payload
column skips all payloads.

Reading plans whole files into partitions of about `partition_bytes`; the writer
begins a new file every `file_bytes`, so files stay small enough for that. A
finished write leaves a manifest of its files, by which files of failed or
repeated tasks stay unread; folders without manifests are read whole.

Records of equal payloads are stored once: the one with the smallest id is the
response, the others are revisits that name it. A null html counts as empty.
Equal ids with equal payloads are each a response; a null id is greater than any
other (nulls alone: each is a response). A null url is stored as empty, and control
characters in urls are percent-encoded. Empty tables give an archive without files.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from streamledger.llm.common import shared_dir, table

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, payload_length bigint, refers_to string, payload binary"
PARTITION_BYTES, FILE_BYTES = 32 << 20, 64 << 20
#: Fixed values of the formats.
MEMBER = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"
EXTRA = struct.Struct("<H2sHII")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns that are headers: predicates on them are tested before a payload is touched.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member that states its length and that of its content."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    total = len(MEMBER) + EXTRA.size + len(body) + 8
    return MEMBER + EXTRA.pack(EXTRA.size - 2, b"sl", 8, total, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str, date: str, digest: str, length: int, refers_to: str | None, payload: bytes | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    body = http if kind == "revisit" else http + (payload or b"")
    clean = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in uri)
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def value_of(headers: dict[str, str], column: str) -> str | None:
    v = headers.get(HEADERS[column])
    if v is None:
        return None
    return v.removeprefix("sha1:") if column == "payload_digest" else v.strip("<>") if column in ("record_id", "refers_to") else v


class Members:
    """Records of a gzipped file one after the other: headers first, the rest on demand."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at = f, size, 0

    def __iter__(self) -> Iterator[tuple[dict[str, str], object]]:
        while self.at < self.size:
            self.f.seek(self.at)
            head = self.f.read(8192)
            stated = self._stated(head)
            z, data, fed = zlib.decompressobj(31), b"", head
            data = z.decompress(fed)
            while b"\r\n\r\n" not in data and not z.eof:
                fed = self.f.read(8192)
                if not fed:
                    raise ValueError(f"the archive ends within a record at {self.at}")
                data += z.decompress(fed)
            warc, _, rest = data.partition(b"\r\n\r\n")
            state = {"done": False}

            def body(z=z, rest=rest, state=state, start=self.at, stated=stated):
                parts = [rest]
                while not z.eof:
                    more = self.f.read(1 << 20)
                    if not more:
                        raise ValueError(f"the archive ends within a record at {start}")
                    parts.append(z.decompress(more))
                state["done"] = True
                self.at = start + stated if stated else self.f.tell() - len(z.unused_data)
                return b"".join(parts)

            yield parse_headers(warc), body
            if not state["done"]:
                if stated:
                    self.at += stated
                else:
                    while not z.eof:
                        more = self.f.read(1 << 20)
                        if not more:
                            raise ValueError(f"the archive ends within a record at {self.at}")
                        z.decompress(more)
                    self.at = self.f.tell() - len(z.unused_data)

    @staticmethod
    def _stated(head: bytes) -> int:
        if head[:4] != MEMBER[:4] or len(head) < len(MEMBER) + EXTRA.size:
            return 0
        _, tag, n, total, _ = EXTRA.unpack_from(head, len(MEMBER))
        return total if tag == b"sl" and n == 8 else 0


@dataclass
class Files(InputPartition):
    paths: list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.uri, self.columns = options["path"], schema.fieldNames()
        self.limit = int(options.get("partition_bytes", PARTITION_BYTES))
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, StringStartsWith)) and len(f.attribute) == 1 else None
            if name not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            else:
                self.tests.append((name, "in", tuple(f.value)) if isinstance(f, In) else (name, "starts", (f.value,)))

    def partitions(self) -> list[Files]:
        fs, root = place(self.uri)
        found = [x for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.is_file]
        listed = set()
        for x in found:
            if posixpath.basename(x.path).startswith("manifest-"):
                with fs.open_input_stream(x.path) as f:
                    listed.update(json.loads(f.read()))
        files = sorted(((x.path, x.size) for x in found if x.path.endswith(".warc.gz") and (not listed or posixpath.basename(x.path) in listed)), key=lambda x: (-x[1], x[0]))
        bins: list[list] = []
        for path, size in files:  # in falling order, so a bin that is full stays so
            if bins and bins[-1][0] + size <= self.limit:
                bins[-1][0] += size
                bins[-1][1].append(path)
            else:
                bins.append([size, [path]])
        return [Files(paths) for _, paths in bins] or [Files([])]

    def wanted(self, headers: dict[str, str]) -> bool:
        for name, how, values in self.tests:
            v = value_of(headers, name)
            if v is None or (v not in values if how == "in" else not v.startswith(values)):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = place(self.uri)
        rows, held = [], 0
        for path in partition.paths:
            size = fs.get_file_info(path).size
            with fs.open_input_file(path) as f:
                for headers, body in Members(f, size):
                    if not self.wanted(headers):
                        continue
                    row = {c: value_of(headers, c) for c in HEADERS}
                    if "payload" in self.columns or "payload_length" in self.columns:
                        http, _, payload = body().partition(b"\r\n\r\n")
                        row["payload_length"] = int(parse_headers(http).get("content-length", 0))
                        row["payload"] = payload[:-4] if row["record_type"] == "response" else None
                    rows.append(row)
                    held += len(row.get("payload") or b"") + 500
                    if held > 8 << 20:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload": pa.binary(), "payload_length": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds.get(c, pa.string())) for c in self.columns], names=self.columns)


@dataclass
class Written(WriterCommitMessage):
    names: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.uri, self.level = options["path"], int(options.get("level", 6))
        self.limit = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = place(self.uri)
        fs.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None or size >= self.limit:
                    if out:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(posixpath.join(root, names[-1]), compression=None), 0
                data = member(record(r["record_type"], r["record_id"], r["target_uri"] or "", r["date"], r["payload_digest"], r["payload_length"], r["refers_to"], r["payload"]), self.level)
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        fs, root = place(self.uri)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(posixpath.join(root, f"manifest-{uuid.uuid4().hex}")) as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages: list) -> None:
        fs, root = place(self.uri)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(posixpath.join(root, name))


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits make four base32 digits."""
    own, rfc = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = [F.lpad(F.conv(F.substring(F.sha1(data), 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*digits), own, rfc)


def records_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """Rows for the writer: a page whose payload (of at least least_bytes bytes) a page with a smaller id has too is a revisit of the smallest such."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), payload.alias("payload")).withColumns({"payload_digest": base32_sha1(F.col("payload")), "payload_length": F.length("payload").cast("bigint")})
    first = rows.where(F.col("payload_length") >= least_bytes).groupBy("payload_digest", "payload_length").agg(F.min("id").alias("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    rows = rows.join(first, ["payload_digest", "payload_length"], "left")
    return rows.select(F.when(again, "revisit").otherwise("response").alias("record_type"), name("id").alias("record_id"), "target_uri", F.lit(date).alias("date"), "payload_digest", "payload_length", F.when(again, name("first")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = f"{shared_dir(spark)}/llm/warc-{uuid.uuid4().hex}"
    records_of(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    full = spark.read.format("warc").load(path).where("record_type = 'response'")
    bare = spark.read.format("warc").schema(SCHEMA.replace(", payload binary", "")).load(path).where("record_type = 'revisit'")
    read = full.select("record_type", "record_id", "refers_to", F.length("payload").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    again = bare.select("record_type", "record_id", "refers_to", F.col("payload_length").alias("payload_bytes"), "payload_digest")
    return read.unionByName(again).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


BASE32_SQL = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))

OP4_SQL = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT h, payload_bytes, min(page_id) AS first FROM p GROUP BY ALL)
SELECT page_id, payload_bytes, {BASE32_SQL} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h, payload_bytes)
"""
