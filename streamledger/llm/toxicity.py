"""Toxicity by multiple-instance learning (operator 6).

A text is a bag of sentences, of which only the whole has a label. Each sentence
has a logistic score over its distinct words and their stems; noisy-or combines
them: a text is toxic unless all its sentences are clean. The gradient of the
bag's likelihood trains the sentence model, which then also locates the sentences
that made a text toxic.

Training uses a bounded sample: at most `per_class` labelled documents of each class
with `SAMPLE_CHARS` characters together, none over `LONGEST`, drawn by a hash of id and
text among the rows that may be learned from. Long texts belong in it: a model that
never saw many clean sentences in a row takes long texts for toxic.

Null and empty texts have no sentences and score 0. Labels that are null or neither
0 nor 1, and null ids, are not learned from; an id labelled both ways is learned
from both ways, and one that repeats with other texts from each of them. Without
both classes every score is 0. Rows that repeat are each scored; extra columns are
ignored. Nothing but the text is looked at in scoring.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamledger.llm.common import bucket_of, mapped, table, unit_hash, with_id

PER_CLASS, SAMPLE_CHARS, LONGEST = 2500, 20_000_000, 200_000
SLOTS, WORD_CACHE = 1 << 18, 400_000
#: Texts that score so much are predicted to be toxic.
TOXIC = 0.5
EPOCHS, BATCH, RATE, PRIOR, BIAS = 30, 64, 0.1, 0.2, -6.0
#: Words and stems of fewer sampled documents teach nothing: else chance words of toxic documents share the weight.
MIN_DOCS = 3
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"[^\W_]+")


def word_slots(word: str) -> list[int]:
    """The word itself and its first 4 and 5 letters: inflections of a stem share them."""
    names = [f"w{word}", *(f"p{word[:k]}" for k in (4, 5) if len(word) >= k)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & (SLOTS - 1) for x in names]


def sentences_of(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and distinct lower-case words of each sentence that has a word."""
    for m in SENTENCE.finditer(text):
        words = set(WORD.findall(m.group().lower()))
        if words:
            yield m.start(), m.end(), words


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [[[s for w in sorted(words) for s in word_slots(w)] for _, _, words in sentences_of(text or "")] for text in batch.column("text").to_pylist()]
        slots, sizes = [[s for x in bag for s in x] for bag in bags], [[len(x) for x in bag] for bag in bags]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("draw"), pa.array(slots, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))], names=["label", "draw", "slots", "sizes"])


def _common(bags: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The bags without slots of fewer than MIN_DOCS bags."""
    docs = np.zeros(SLOTS, np.int64)
    for _, slots, _ in bags:
        docs[np.unique(slots)] += 1
    out = []
    for y, slots, sizes in bags:
        keep = docs[slots] >= MIN_DOCS
        out.append((y, slots[keep], np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))))
    return out


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> np.ndarray:
    """bags: (label, slots of all sentences, number of slots of each). Returns the slots' weights and, last, the bias."""
    w = np.zeros(SLOTS + 1)
    w[-1] = BIAS
    bags = [b for b in bags if len(b[2])]
    if len({y for y, _, _ in bags}) < 2:
        w[-1] = -np.inf
        return w
    bags = _common(bags)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    rng, step = np.random.default_rng(seed), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            held = [bags[k] for k in order[at : at + BATCH]]
            y = np.array([b[0] for b in held], float)
            slots = np.concatenate([b[1] for b in held])
            sizes = np.concatenate([b[2] for b in held])
            bag = np.repeat(np.arange(len(held)), [len(b[2]) for b in held])
            sentence = np.repeat(np.arange(len(sizes)), sizes)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(sentence, w[slots], len(sizes)) + w[-1], -30, 30)))
            clean = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-9)), len(held))  # log of the probability that all are clean
            q = np.exp(clean)
            pull = np.where(y > 0, -q / np.maximum(1 - q, 1e-6), 1.0)
            g = pull[bag] * p
            grad = np.append(np.bincount(slots, g[sentence], SLOTS), g.sum()) / len(held)
            grad[:-1] += PRIOR / len(bags) * w[:-1]
            step += 1
            m1 += 0.1 * (grad - m1)
            m2 += 0.001 * (grad * grad - m2)
            w -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return w


class Scorer:
    def __init__(self, weights: np.ndarray):
        self.weights, self.bias, self.kept = weights, float(weights[-1]), {}

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """Start, end and logit of each sentence."""
        kept, out = self.kept, []
        if len(kept) > WORD_CACHE:
            kept.clear()
        for a, b, words in sentences_of(text or ""):
            z = self.bias
            for w in words:
                v = kept.get(w)
                if v is None:
                    v = kept[w] = float(self.weights[word_slots(w)].sum())
                z += v
            out.append((a, b, z))
        return out

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        """Noisy-or over the sentences, and those that are more likely toxic than not; of a text that is so by many weak ones, the strongest (all, if several are)."""
        found = self.sentences(text)
        if not found:
            return 0.0, []
        z = np.array([x for _, _, x in found])
        order = np.sort(z)  # sums do not hang on the order of words or sentences
        score = float(-np.expm1(-np.logaddexp(0.0, order).sum()))
        score = round(min(1.0, max(0.0, score)), 12)
        least = min(0.0, z.max()) if score >= TOXIC else 0.0
        return score, [{"start": a, "end": b, "score": float(1 / (1 + np.exp(-min(x, 700.0))))} for a, b, x in found if x >= least]


def train(documents: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> np.ndarray:
    """Weights from a bounded sample of the labelled rows where `learn` holds (a condition on id_col)."""
    known = labels.where(learn & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return fit([])
    # About twice as many as needed pass the hash of their ids, and of their texts the first by another hash are taken.
    share = F.when(F.col("label") == 1, 2 * per_class / counts[1]).otherwise(2 * per_class / counts[0])
    drawn = known.where(unit_hash(F.col("id"), "toxicity") < share)
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= LONGEST)
    rows = texts.join(F.broadcast(drawn), "id").withColumn("draw", F.xxhash64("id", "text", F.lit("toxicity")))
    order = Window.partitionBy("label").orderBy("draw")
    first = rows.withColumns({"rank": F.row_number().over(order), "chars": F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    first = first.where((F.col("rank") <= per_class) & (F.col("chars") <= SAMPLE_CHARS))
    bags = mapped(first.select("text", "label", "draw"), _bags, "label int, draw bigint, slots array<int>, sizes array<int>").toArrow()
    columns = {name: bags.column(name).combine_chunks() for name in bags.column_names}
    held = [(columns["draw"][k].as_py(), columns["label"][k].as_py(), columns["slots"][k].values.to_numpy(), columns["sizes"][k].values.to_numpy()) for k in range(len(bags))]
    return fit([(label, slots, sizes) for _, label, slots, sizes in sorted(held, key=lambda x: (x[0], x[1], len(x[2])))])


def score_toxicity(documents: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, score and offending (start, end and score of sentences)."""
    held = documents.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            found = [scorer.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s for s, _ in found], pa.float64()), pa.array([o for _, o in found], span)], names=["id", "score", "offending"])

    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = mapped(docs, run, with_id(docs.schema["id"].dataType, "score double, offending array<struct<start:bigint,end:bigint,score:double>>"))
    return out.withColumnRenamed("id", id_col)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, held_out = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), bucket_of(F.col("doc_id"), 5) == 0
    out = score_toxicity(docs, train(docs, labels, ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "offending")
