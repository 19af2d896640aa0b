"""Hard-negative mining by bit-sliced integer products (operator 12).

Vectors are whole numbers, floor(SCALE * x) of each component. A row's components are
taken as bit planes, the most significant (the sign's) first. The product with an anchor
is summed up plane by plane; what the planes still to come can add lies between the sums
of the anchor's negative and positive components, times the largest rest, so each score
has an interval that halves with every plane. A candidate goes as soon as its interval
can't qualify any more: for positives, when its upper end is below the k-th best score so
far; for negatives, when it lies outside all windows, or below the k-th best within them.
While most candidates are left, a plane is one matrix product; then only the pairs that
are left go on. Scores of those that stay are exact.

Anchors are a query set against all rows: about ANCHORS of them at a time go with the tasks
that read all rows, so that neither depends on the number of anchors. Tasks give the best
they have of each anchor, and a window by anchor takes the first of these.

Rows without an id or label, without a vector, or with a null or non-finite component take
no part. Shorter vectors count as padded with zeros. Rows of an anchor's own id are neither
its positives nor its negatives; other rows that repeat an id are rows of their own. Rows
of one id that are equal are one anchor, others are anchors of their own. Equal scores go
by the smaller id. Fewer positives or negatives than asked for: all of them. An anchor
without positives, and an empty table, give no rows. Products that 64 bits can't hold are
an error. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamledger.llm.common import discard, mapped, materialise, record, shared_dir, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score between which a negative's lies.
LOW, HIGH = 30, 90
#: About so many anchors go with a pass over all rows.
ANCHORS = 1024
#: Rows and anchors in one matrix product, and the share of pairs below which pairs go on by themselves.
ROWS, TILE, SPARSE = 2048, 256, 0.1
#: Pairs looked at together, which bounds memory.
PAIRS = 1 << 17


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", anchor: Column | None = None, scale: int = SCALE) -> DataFrame:
    """Rows that take part: id, label, whole (components) and anchor."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), x.alias("x"), (F.lit(False) if anchor is None else F.coalesce(anchor, F.lit(False))).alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    return rows.select("id", "label", F.transform("x", lambda v: F.floor(v * scale).cast("bigint")).alias("whole"), "anchor")


# In a task


class Anchors:
    """Anchors as a matrix, with the sums that bound what planes can still add."""

    def __init__(self, rows: list[tuple[int, int, list[int]]], width: int, bits: int):
        self.ids, self.labels = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        whole = np.zeros((len(rows), width), np.int64)
        for k, (_, _, x) in enumerate(rows):
            whole[k, : len(x)] = x
        self.bits = bits
        exact = np.abs(whole).sum(1).max(initial=0) < 1 << 24
        self.whole, self.matrix = whole, whole.astype(np.float32 if exact else np.float64)
        self.below, self.above = np.minimum(whole, 0).sum(1), np.maximum(whole, 0).sum(1)

    def planes(self, rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Place, weight and bits of each plane of rows, most significant first: two's complement."""
        for m in range(self.bits - 1, -1, -1):
            yield m, (-1 if m == self.bits - 1 else 1) << m, (rows >> m) & 1

    def candidates(self, mine: np.ndarray, rows: np.ndarray, fits: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of the pairs that fit whose score lies within [least, most] of its anchor. mine: which anchors; fits: a mask of pairs or None."""
        sums = np.zeros((len(mine), len(rows)), np.int64)
        below, above = self.below[mine], self.above[mine]
        at = None
        for m, weight, plane in self.planes(rows):
            rest = (1 << m) - 1
            if at is None:
                sums += weight * (self.matrix[mine] @ plane.T.astype(self.matrix.dtype)).astype(np.int64)
                alive = (sums >= (least - rest * above)[:, None]) & (sums <= (most - rest * below)[:, None])
                if m == 0 or alive.mean() < SPARSE:
                    a, r = np.nonzero(alive & fits)
                    at, score = (a, r), sums[a, r]
            elif len(at[0]):
                a, r = at
                for k in range(0, len(a), PAIRS):
                    some = slice(k, k + PAIRS)
                    score[some] += weight * np.einsum("ij,ij->i", self.whole[mine[a[some]]], plane[r[some]])
                keep = (score >= least[a] - rest * above[a]) & (score <= most[a] - rest * below[a])
                at, score = (a[keep], r[keep]), score[keep]
        return mine[at[0]], at[1], score


class Best:
    """The first k of each key so far, by falling score and rising id."""

    def __init__(self, keys: int, k: int):
        self.k, self.keys, self.scores, self.ids = k, *(np.zeros(0, np.int64) for _ in range(3))
        self.worst = np.full(keys, np.iinfo(np.int64).min)  # the k-th best score, once there are k

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        keys, scores, ids = np.concatenate([self.keys, keys]), np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores, keys))
        keys, scores, ids = keys[order], scores[order], ids[order]
        place = np.arange(len(keys)) - np.searchsorted(keys, keys)
        full = place == self.k - 1
        self.worst[keys[full]] = scores[full]
        keep = place < self.k
        self.keys, self.scores, self.ids = keys[keep], scores[keep], ids[keep]


FOUND = pa.schema([("anchor", pa.int32()), ("window", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])
FOUND_SQL = "anchor int, window int, score bigint, id bigint"


def matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and components of about ROWS rows at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            lists = part.column("whole")
            whole = np.zeros((part.num_rows, width), np.int64)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            whole[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            yield part.column("id").to_numpy(), part.column("label").to_numpy(), whole


def positives(anchors: Anchors, width: int, k: int):
    """A mapInArrow function: the task's first k rows of each anchor's label."""
    top = np.iinfo(np.int64).max >> 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(anchors.ids), k)
        for ids, labels, whole in matrices(batches, width):
            for label in np.intersect1d(anchors.labels, labels):
                own = np.flatnonzero(labels == label)
                every = np.flatnonzero(anchors.labels == label)
                for j in range(0, len(every), TILE):
                    mine = every[j : j + TILE]
                    fits = anchors.ids[mine][:, None] != ids[own]
                    a, r, score = anchors.candidates(mine, whole[own], fits, np.maximum(best.worst[mine], -top), np.full(len(mine), top))
                    best.add(a, score, ids[own][r])
        yield record(FOUND, best.keys.astype(np.int32), np.zeros(len(best.keys), np.int32), best.scores, best.ids)

    return find


def negatives(anchors: Anchors, width: int, windows: np.ndarray, k: int):
    """A mapInArrow function: the task's first k rows of other labels in each window. windows: [least, most] of each anchor's positives, in order of anchor and positive; least above most for none."""
    per = windows.shape[1]
    everywhere = np.iinfo(np.int64).max >> 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(anchors.ids) * per, k)
        for ids, labels, whole in matrices(batches, width):
            for j in range(0, len(anchors.ids), TILE):
                mine = np.arange(j, min(j + TILE, len(anchors.ids)))
                least = np.maximum(windows[mine, :, 0], best.worst.reshape(-1, per)[mine])
                none = windows[mine, :, 0] > windows[mine, :, 1]
                floor, ceiling = np.where(none, everywhere, least).min(1), np.where(none, -everywhere, windows[mine, :, 1]).max(1)
                fits = anchors.labels[mine][:, None] != labels
                a, r, score = anchors.candidates(mine, whole, fits & (anchors.ids[mine][:, None] != ids), floor, ceiling)
                for w in range(per):
                    within = (score >= least[a - j, w]) & (score <= windows[a, w, 1])
                    best.add(a[within] * per + w, score[within], ids[r[within]])
        yield record(FOUND, (best.keys // per).astype(np.int32), (best.keys % per).astype(np.int32), best.scores, best.ids)

    return find


# Over all rows


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and window, with their rank from 1."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, anchors_at_once: int = ANCHORS) -> DataFrame:
    """vectors as `quantised` gives them, to anchor_id, positive_id, rank, negative_id, positive_score and negative_score."""
    spark = vectors.sparkSession
    rows = materialise(vectors, "vectors")
    size = F.transform("whole", F.abs)
    stats = rows.agg(F.max(F.array_max(size)).alias("largest"), F.max(F.size("whole")).alias("width"), F.count_if("anchor").alias("anchors")).first()
    largest, width = stats["largest"] or 0, stats["width"] or 0
    if width * (largest + 1) ** 2 >= 1 << 62:
        raise ValueError(f"products of {width} components up to {largest} do not fit 64 bits")
    bits = int(largest).bit_length() + 1
    blocks = -(-stats["anchors"] // anchors_at_once)
    out = f"{shared_dir(spark)}/llm/negatives-{rows.stored_at.rpartition('-')[2]}"
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], schema).write.parquet(out)
    for block in range(blocks):
        chosen = rows.where(F.col("anchor") & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)).select("id", "label", "whole").collect()
        listed = sorted({(r["id"], r["label"], tuple(r["whole"])) for r in chosen})
        if not listed:
            continue
        anchors = Anchors(listed, width, bits)
        near = first_of(mapped(rows.select("id", "label", "whole"), positives(anchors, width, n_positives), FOUND_SQL), n_positives).collect()
        windows = np.tile(np.array([1, 0], np.int64), (len(listed), n_positives, 1))
        for r in near:
            windows[r["anchor"], r["rank"] - 1] = -(-low * r["score"] // 100), high * r["score"] // 100
        found = first_of(mapped(rows.select("id", "label", "whole"), negatives(anchors, width, windows, n_negatives), FOUND_SQL), n_negatives)
        told = spark.createDataFrame([(r["anchor"], r["rank"] - 1, listed[r["anchor"]][0], r["id"], r["score"]) for r in near], "anchor int, window int, anchor_id bigint, positive_id bigint, positive_score bigint")
        found.join(F.broadcast(told), ["anchor", "window"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
    discard(rows)
    return spark.read.schema(schema).parquet(out)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = quantised(table(spark, sf_dir, "embeddings"), label=label, anchor=F.col("vec_id") % 100 == 0)
    return hard_negatives(rows)


OP12_SQL = f"""
WITH valid AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM valid a JOIN valid b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other))::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
