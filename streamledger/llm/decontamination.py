"""Benchmark decontamination with one Aho-Corasick automaton (operator 5).

Texts are normalised byte-wise: A-Z become lower case, ASCII other than digits
and letters separates words, everything above ASCII belongs to words. A window
is `width` consecutive words of an item; an item of fewer words is one window.
Every word of the items gets a letter, and all windows form one automaton over letters;
one scan of a document's words, spelt in these letters, reports every window that occurs
in it. Matches are word ranges, and word ranges map back to character spans of the original.

Benchmarks are small next to a corpus, but their size is checked: items of about
`shard_chars` characters go into one automaton (and one broadcast), which takes
some 110 bytes a character and is built once in a worker. A larger benchmark is
dealt into that many shards, each brought to the driver by itself and scanned in its
own pass, and the shards' word ranges are merged by document.

Null, empty and wordless texts have no words and no hits; an item without
words has no windows; repeated items and repeated documents are each reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from streamledger.llm.common import FORGET, mapped, materialise, table, with_id

WIDTH = 10
SHARD_CHARS = 2_000_000
#: Byte to byte: A-Z to a-z; digits, a-z and all bytes of non-ASCII characters stay; the rest separates.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def windows_of(words: list[bytes], width: int) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]


def letter(k: int) -> str:
    """A character for each number from 0 on; surrogates are left out, and the first character stands for words that no item has."""
    return chr(k + 1 if k + 1 < 0xD800 else k + 1 + 0x800)


class Windows:
    """The automaton of all windows, with a letter for each word of the items: what it takes grows with words, not characters."""

    def __init__(self, items: list[tuple[object, str | None]], width: int):
        self.letters: dict[bytes, str] = {}
        held: dict[str, dict] = {}
        for item, text in items:
            words = words_of(text)
            for w in words:
                if w not in self.letters:
                    self.letters[w] = letter(len(self.letters))
            whole = self.spelt(words)
            for k in range(max(1, len(words) - width + 1) if words else 0):
                held.setdefault(whole[k : k + width], {})[item] = None
        self.sizes, self.ids = [len(w) for w in held], [tuple(x) for x in held.values()]
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, w in enumerate(held):
            self.auto.add_word(w, k)
        self.auto.make_automaton()

    def spelt(self, words: list[bytes]) -> str:
        """Words as letters, one each."""
        return "".join(map(self.letters.get, words, repeat("\0")))


def automaton_of(items: list[tuple[object, str | None]], width: int = WIDTH) -> Windows | None:
    """The windows of items; None without any."""
    windows = Windows(items, width)
    return windows if windows.sizes else None


def scan(words: list[bytes], windows: Windows | None) -> tuple[list[tuple[int, int]], list]:
    """Merged ranges [from, to) of hit words, and the ids of the items with occurring windows."""
    if windows is None or not words:
        return [], []
    ranges: list[list[int]] = []
    items: dict = {}
    for last, k in windows.auto.iter(windows.spelt(words)):
        items.update(dict.fromkeys(windows.ids[k]))
        end, start = last + 1, last + 1 - windows.sizes[k]
        while ranges and ranges[-1][0] >= start:
            ranges.pop()
        if ranges and ranges[-1][1] >= start:
            ranges[-1][1] = end
        else:
            ranges.append([start, end])
    return [(a, b) for a, b in ranges], list(items)


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character spans of the original text for ranges of words."""
    if not ranges:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    folded = raw.translate(FOLD)
    starts, ends, at = [], [], 0
    for w in folded.split():
        at = folded.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    chars = lambda k: len(raw[:k].decode("utf-8", "surrogatepass"))
    return [(chars(starts[a]), chars(ends[b - 1])) for a, b in ranges]


def shards_of(benchmark: DataFrame, id_col: str, text_col: str, shard_chars: int) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of about shard_chars characters, brought to the driver one block at a time."""
    cols = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).distinct()
    chars = cols.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-chars // shard_chars))
    for k in range(n):
        part = cols if n == 1 else cols.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r["item"], r["text"]) for r in part.collect()]


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, shard_chars: int = SHARD_CHARS, spans: bool = True) -> DataFrame:
    """One row per document: its id, n_words, n_hit, items (array, ascending as text), spans (original characters) and contaminated."""
    spark = documents.sparkSession
    item_type = benchmark.schema[item_col].dataType.simpleString()
    arrow_type = to_arrow_type(benchmark.schema[item_col].dataType)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shards = (spark.sparkContext.broadcast(items) for items in shards_of(benchmark, item_col, item_text_col, shard_chars))
    first, second = next(shards), next(shards, None)
    rest = f"n_words bigint, n_hit bigint, items array<{item_type}>, spans array<struct<start:bigint,end:bigint>>"
    schema = with_id(documents.schema[id_col].dataType, rest)
    if second is None:
        out = mapped(docs, _scanner(first, arrow_type, width, spans), schema)
    else:
        keyed = docs.withColumn("row", F.monotonically_increasing_id())
        keyed = materialise(keyed, "decontamination")
        parts = None
        for items in chain([first, second], shards):
            one = mapped(keyed, _scanner(items, arrow_type, width, spans, ranges=True), T.StructType([*T.StructType.fromDDL("row bigint, ranges array<struct<start:bigint,end:bigint>>").fields, *schema.fields]))
            parts = one if parts is None else parts.unionByName(one)
        out = _merge(parts)
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", F.array_sort(F.col("items"), lambda a, b: F.when(a.cast("string") < b.cast("string"), -1).when(a.cast("string") > b.cast("string"), 1).otherwise(0)).alias("items"), "spans", (F.col("n_hit") > 0).alias("contaminated"))


def _merge(parts: DataFrame) -> DataFrame:
    """Shards' rows of a document in one: union of word ranges and items; as many rows as there are shards meet, never more."""
    g = parts.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("ranges"))).alias("r"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    start = F.struct(F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("end"))
    step = lambda acc, r: F.struct((acc["hit"] + F.greatest(F.lit(0), r["end"] - F.greatest(acc["end"], r["start"]))).alias("hit"), F.greatest(acc["end"], r["end"]).alias("end"))
    return g.select("id", "n_words", F.aggregate("r", start, step)["hit"].alias("n_hit"), "items", "spans")


#: The items of which a worker built an automaton last, and that automaton.
BUILT: list = []
FORGET[__name__] = BUILT.clear


def built(items: list, width: int) -> Windows | None:
    """The automaton of broadcast items, built once in a worker."""
    if not BUILT or BUILT[0] is not items or BUILT[1] != width:
        BUILT[:] = [items, width, automaton_of(items, width)]
    return BUILT[2]


def _scanner(items, item_type: pa.DataType, width: int, spans: bool, ranges: bool = False):
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = built(items.value, width)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n_words, n_hit, found, where, ran = [], [], [], [], []
            for text in texts:
                words = words_of(text)
                hit, ids = scan(words, auto)
                n_words.append(len(words))
                n_hit.append(sum(b - a for a, b in hit))
                found.append(ids)
                ran.append([{"start": a, "end": b} for a, b in hit])
                where.append([{"start": a, "end": b} for a, b in original_spans(text, hit)] if spans else [])
            cols = [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(item_type)), pa.array(where, pair)]
            names = ["id", "n_words", "n_hit", "items", "spans"]
            if ranges:
                cols = [batch.column("row"), pa.array(ran, pair), *cols]
                names = ["row", "ranges", *names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spans=False)
    ids = F.concat_ws(",", F.transform("items", lambda x: x.cast("string")))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")


WORDS_SQL = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5_SQL = f"""
WITH items AS (SELECT item_id, {WORDS_SQL.format('text')} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS n, array_to_string(list_slice(w, k, k + least(len(w), {WIDTH}) - 1), ' ') AS win
         FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WIDTH} + 1) + 1)) AS k FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents),
spots AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS win
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, s.n, item_id FROM spots s JOIN wins USING (win)),
counts AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN counts USING (doc_id) LEFT JOIN found USING (doc_id)
"""
