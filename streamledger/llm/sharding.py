"""Sharding by bytes, in DataFrame functions only (operator 11): a minimax contiguous partition.

Documents of equal text are one atomic group. Groups are ordered by the MD5 of their
text; a binary search finds the smallest capacity with which a greedy pass over the
ordered group sizes fills at most so many shards, and the cuts are where that pass
makes them. A group that alone sets the capacity gets a shard to itself, and the
search goes on over the rest with one shard less, so that one large group does not
leave other shards empty.

Groups may be billions, so the search looks at cells: ranges of MD5 prefixes with
their sums. Cutting at cell borders only, and cutting anywhere inside a cell, bound the
capacity and every cut from both sides. Cells between the bounds of a cut are split by
one more digit, until both bounds agree: the result is the one of the search over all
groups. A pass brings a few thousand sums to the driver, whatever the input's size.

Sizes are UTF-8 bytes of the text plus 8. A null text counts as an empty one, with
which it forms one group. Slots count the documents of a shard from 0, in order of the
MD5 of their id (a fixed shuffle), then id (nulls first) and text; rows that repeat an
id and text are each a document with a slot of its own. Fewer groups than shards leave
shards empty; an empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamledger.llm.common import discard, materialise, table

SHARDS = 24
#: Bytes that a document takes besides its text.
OVERHEAD = 8
#: Hex digits of the first cells, and of the blocks of a shard in which slots are counted.
FIRST_DIGITS, BLOCK_DIGITS = 3, 3


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (the group: MD5 of the text), size and crc of each document."""
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("id"), F.md5(data).alias("key"), (F.octet_length(data) + OVERHEAD).cast("bigint").alias("size"), F.crc32(data).alias("crc"))


class Cells:
    """Ordered ranges of groups: where each begins, sums up to there, and whether it is a single group."""

    def __init__(self, found: dict[str, tuple[int, int]], alone: list[tuple[str, int]]):
        """found: prefix of a range to (sum of sizes, number of groups); alone: groups (key, size) that have shards of their own."""
        starts = sorted(found)
        sums, counts = [found[s][0] for s in starts], [found[s][1] for s in starts]
        for key, size in alone:
            at = bisect_right(starts, key) - 1
            sums[at], counts[at] = sums[at] - size, counts[at] - 1
        self.starts = [s for s, n in zip(starts, counts, strict=True) if n]
        self.single = [n == 1 for n in counts if n]
        self.before = [0, *accumulate(s for s, n in zip(sums, counts, strict=True) if n)]
        self.total = self.before[-1]

    def at_borders(self, capacity: int, shards: int) -> list[int]:
        """Greedy ends of shards, as sums, where only borders of cells are cut: never beyond the true ones."""
        ends, at = [], 0
        for _ in range(shards):
            at = self.before[bisect_right(self.before, at + capacity) - 1]
            ends.append(at)
        return ends

    def anywhere(self, capacity: int, shards: int) -> list[int]:
        """Greedy ends where cells of several groups can be cut anywhere: never before the true ones."""
        ends, at = [], 0
        for _ in range(shards):
            at = min(at + capacity, self.total)
            cell = bisect_right(self.before, at) - 1
            if at < self.total and self.single[cell]:
                at = self.before[cell]
            ends.append(at)
        return ends

    def least(self, ends, low: int, shards: int) -> int:
        """The smallest capacity of at least low with which these ends reach the total."""
        high = max(low, self.total)
        while low < high:
            mid = (low + high) // 2
            if ends(mid, shards)[-1] == self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def between(self, first: int, last: int) -> list[str]:
        """Cells of several groups that touch the sums from first to last."""
        return [self.starts[k] for k in range(bisect_right(self.before, first) - 1, min(bisect_right(self.before, last), len(self.starts))) if not self.single[k]]


def summed(groups: DataFrame, digits: int, within: list[str] | None = None) -> dict[str, tuple[int, int]]:
    """Sum and number of groups for each prefix of so many digits, within prefixes of one digit less or everywhere."""
    rows = groups if within is None else groups.where(F.substring("key", 1, digits - 1).isin(within))
    cells = rows.groupBy(F.substring("key", 1, digits).alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    return {r["cell"]: (r["size"], r["n"]) for r in cells.collect()}


def partition(groups: DataFrame, shards: int = SHARDS) -> tuple[list[str], list[str]]:
    """Keys of the groups that have shards of their own (shards 0, 1, ...), and where each later shard but the first begins: the least key or prefix in it.

    groups: key (32 hex digits, each once) and size, above 0.
    """
    largest = [(r["key"], r["size"]) for r in groups.orderBy(F.desc("size"), "key").limit(shards).collect()]
    found = summed(groups, FIRST_DIGITS)
    alone: list[tuple[str, int]] = []
    while len(alone) < min(len(largest), shards - 1):
        cells, left, most = Cells(found, alone), shards - len(alone), largest[len(alone)][1]
        low, high = cells.least(cells.anywhere, most, left), cells.least(cells.at_borders, most, left)
        if high == most:  # no capacity is smaller than a group
            alone.append(largest[len(alone)])
            continue
        first, last = cells.at_borders(low, left), cells.anywhere(high, left)
        if low == high and first == last:
            return [k for k, _ in alone], [cells.starts[bisect_right(cells.before, x) - 1] for x in first if x < cells.total]
        split = sorted({c for a, b in zip(first, last, strict=True) for c in cells.between(a, b)})
        for digits in sorted({len(c) for c in split}):
            for c in (own := [c for c in split if len(c) == digits]):
                del found[c]
            found |= summed(groups, digits + 1, own)
    return [k for k, _ in alone], []


def shard_of(key: Column, alone: list[str], begins: list[str]) -> Column:
    after = reduce(lambda n, b: n + F.when(key >= b, 1).otherwise(0), begins, F.lit(len(alone)))
    return reduce(lambda other, k: F.when(key == k[1], k[0]).otherwise(other), list(enumerate(alone))[::-1], after).cast("int")


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, crc (of the text's bytes), shard and slot."""
    if shards < 1:
        raise ValueError(f"shards: {shards}")
    rows = sized(docs, id_col, text_col)
    groups = materialise(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    alone, begins = partition(groups, shards)
    discard(groups)
    text = F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")
    placed = rows.select("id", "key", "size", "crc", shard_of(F.col("key"), alone, begins).alias("shard"), F.md5(text).alias("at"))
    placed = materialise(placed.groupBy("shard", "at", "id", "key", "size", "crc").agg(F.count("*").alias("n")), "shard-placed")
    block = F.substring("at", 1, BLOCK_DIGITS).alias("block")
    counts = placed.groupBy("shard", block).agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "block").orderBy("at", "id", "key").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("block", block).withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets, ["shard", "block"])
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("copy")
    return rows.select("id", "size", "crc", "shard", "offset", "first", copies).select("id", "size", "crc", "shard", (F.col("offset") + F.col("first") + F.col("copy")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, text_col: str = "text") -> None:
    """Writes whole rows as Parquet, a folder per shard (the column must not be there already); several tasks write a shard."""
    groups = materialise(sized(docs, text_col, text_col).groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    alone, begins = partition(groups, shards)
    discard(groups)
    key = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    docs.withColumn("shard", shard_of(key, alone, begins)).write.partitionBy("shard").parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 of a list of bytes in SQL, by a table of its 256 steps (polynomial 0xEDB88320).
CRC_TABLE_SQL = "(SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n::BIGINT)) AS steps)"
CRC_SQL = "xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8), 4294967295))"

#: Greedy ends over prefix sums p: from s to the last sum within s + cap, so many times.
_ENDS = "list_reduce(range(shards), lambda e, _: list_max(list_filter(p, lambda x: x <= e + {cap})), 0::BIGINT)"

OP11_SQL = f"""
WITH RECURSIVE sized AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS key, (octet_length(encode(coalesce(text, ''))) + {OVERHEAD})::BIGINT AS size FROM documents),
groups AS (SELECT key, sum(size)::BIGINT AS size FROM sized GROUP BY key),
ranked AS (SELECT *, row_number() OVER (ORDER BY size DESC, key) AS rank FROM groups),
held AS (SELECT list(size ORDER BY rank) AS sizes FROM ranked),
-- so many of the largest groups have shards of their own: for each number, the prefix sums of the rest, and the search for its capacity
alone AS (SELECT unnest(range(least({SHARDS}, (SELECT count(*) FROM groups)))) AS n),
sums AS (SELECT n, key, sum(size) OVER (PARTITION BY n ORDER BY key)::BIGINT AS upto FROM alone JOIN ranked ON rank > n),
rest AS (SELECT n, [0::BIGINT] || list(upto ORDER BY key) AS p, max(upto) AS total, {SHARDS} - n AS shards, (SELECT sizes[n + 1] FROM held) AS most FROM sums GROUP BY n),
search AS (SELECT n, most AS low, greatest(most, total) AS high FROM rest
  UNION ALL SELECT n, CASE WHEN reached THEN low ELSE mid + 1 END, CASE WHEN reached THEN mid ELSE high END
  FROM (SELECT n, low, high, (low + high) // 2 AS mid, {_ENDS.format(cap="((low + high) // 2)")} = total AS reached FROM search JOIN rest USING (n) WHERE low < high)),
capacity AS (SELECT n, low AS cap, low > most OR n = {SHARDS} - 1 AS ends FROM search JOIN rest USING (n) WHERE low = high),
chosen AS (SELECT n, cap FROM capacity WHERE ends ORDER BY n LIMIT 1),
cuts AS (SELECT 0 AS step, 0::BIGINT AS edge UNION ALL SELECT step + 1, list_max(list_filter(p, lambda x: x <= edge + cap)) FROM cuts, chosen JOIN rest USING (n) WHERE step < shards),
placed AS (SELECT key, CASE WHEN rank <= coalesce((SELECT n FROM chosen), {SHARDS}) THEN rank - 1 ELSE (SELECT n FROM chosen) + (SELECT count(*) FROM cuts, sums WHERE step > 0 AND sums.n = (SELECT n FROM chosen) AND sums.key = ranked.key AND sums.upto > cuts.edge) END AS shard FROM ranked)
SELECT doc_id, size, {CRC_SQL.format(text="text")} AS text_crc32, 'bytes' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, key) - 1 AS slot, NULL::INT AS grown_shard
FROM sized JOIN placed USING (key), {CRC_TABLE_SQL}
"""
