"""Language identification of code-switched text by a linear-chain CRF (operator 8).

Words are runs of letters. Each gets affix, character n-gram and lexicon features;
learned transitions connect neighbouring words, and forward-backward gives every
word a distribution over languages. A text's language is the one with the largest
sum over its words (ties: the first by name), its score that sum's share.

Training uses a bounded sample: `per_language` documents of each language, drawn
by a hash of id and text among the rows that may be learned from, so that rows
that repeat an id, or have none, are drawn each by itself. Executors take what is
needed from them: of one half the distinct words, whose counts by language give
the lexicons; of the other `PIECES` runs of words from all over each text. Document
labels hold for all words of a text; half of the training sequences join pieces of
different texts, so that transitions learn both to stay and to switch.

A run of more than `RUN` letters (as in scripts without spaces) is cut into
consecutive words, so that all its letters count. Null texts and texts without a
letter are `und` with score 0. Languages are the non-null values of the label
column, however many. Rows that repeat are each predicted; extra columns are
ignored; without rows to learn from every text is `und`. Nothing but the text is
looked at in prediction.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamledger.llm import crf
from streamledger.llm.common import FORGET, bucket_of, discard, mapped, materialise, slices, table, unit_hash, with_id

PER_LANGUAGE, PIECES, PIECE_WORDS, RUN = 400, 6, 12, 40
#: Parts of words and scores of words (numbers, not rows) that a task keeps.
SLOTS, PART_CACHE, SCORE_CACHE = 1 << 16, 50_000, 2_000_000
#: A word names a language if so many documents of the sample hold it, and this share of them in that language; the most frequent of each are kept.
LEXICON_COUNT, LEXICON_SHARE, LEXICON_WORDS = 3, 0.9, 20_000
UND = "und"
WORD = re.compile(rf"[^\W\d_]{{1,{RUN}}}")


@dataclass
class Model:
    chain: crf.Crf
    lexicon: dict[str, str]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Slots(dict):
    """Parts of words of one kind to their slots, computed once; bounded, as there are few short parts."""

    def __init__(self, kind: str):
        self.kind = kind

    def __missing__(self, part: str) -> int:
        slot = zlib.crc32((self.kind + part).encode("utf-8", "surrogatepass")) & (SLOTS - 1)
        if len(self) < PART_CACHE:
            self[part] = slot
        return slot


PREFIX, SUFFIX, GRAM, LEXICON = Slots("p"), Slots("s"), Slots("g"), Slots("l")


def _forget() -> None:
    for kept in (PREFIX, SUFFIX, GRAM, LEXICON):
        kept.clear()


FORGET[__name__] = _forget


def features(word: str, lexicon: dict[str, str]) -> list[int]:
    """Slots of a word: bias, itself, prefixes and suffixes of 1 to 4 letters, letter trigrams, and the language that its lexicon entry names."""
    edged = f"<{word}>"
    n = min(5, len(word) + 1)
    slots = [0, zlib.crc32(word.encode("utf-8", "surrogatepass")) & (SLOTS - 1)]
    slots += [PREFIX[word[:k]] for k in range(1, n)]
    slots += [SUFFIX[word[-k:]] for k in range(1, n)]
    slots += [GRAM[edged[k : k + 3]] for k in range(len(edged) - 2)]
    if word in lexicon:
        slots.append(LEXICON[lexicon[word]])
    return slots


def pieces_of(words: list[str], seed: int) -> list[list[str]]:
    """PIECES runs of words from all over a text."""
    rng = np.random.default_rng(seed)
    return [words[at : at + PIECE_WORDS] for at in sorted(rng.integers(0, max(1, len(words) - PIECE_WORDS + 1), PIECES))] if words else []


def fit(pieces: list[tuple[list[str], str]], lexicon: dict[str, str], seed: int = 7) -> Model:
    """pieces: (words, language)."""
    rng = np.random.default_rng(seed)
    pieces = sorted(p for p in pieces if p[0])
    labels = sorted({lang for _, lang in pieces})
    number = {x: k for k, x in enumerate(labels)}
    order = rng.permutation(len(pieces))
    sequences = []
    for k in order[::2]:
        other = pieces[int(rng.integers(len(pieces)))]
        for chain in ([pieces[k]], [pieces[k], other]):
            sequences.append(([np.array(features(w, lexicon), np.int32) for ws, _ in chain for w in ws], [number[lang] for ws, lang in chain for _ in ws]))
    if not sequences:
        return Model(crf.Crf([UND], np.zeros((SLOTS, 1)), np.zeros((1, 1)), np.zeros(1)), {})
    return Model(crf.train(sequences, labels, SLOTS, epochs=4), lexicon)


class Rows(dict):
    """Words to their row numbers; a new word gets the next row and waits in `fresh` for its scores. Without a letter: -1."""

    def __init__(self):
        self.used, self.fresh = 0, []

    def __missing__(self, word: str) -> int:
        if not any(map(str.isalpha, word)):
            self[word] = -1
            return -1
        k = self[word] = self.used
        self.used += 1
        self.fresh.append(word)
        return k


class Tagger:
    """Scores of words are computed once and kept, in bounded memory."""

    def __init__(self, model: Model):
        self.model, self.index = model, Rows()
        self.rows = np.empty((1 << 14, len(model.chain.labels)))

    def _score_fresh(self) -> None:
        fresh, used = self.index.fresh, self.index.used
        while used > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        for a in range(0, len(fresh), 4096):
            slots = [features(w, self.model.lexicon) for w in fresh[a : a + 4096]]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in slots])])
            at = used - len(fresh) + a
            self.rows[at : at + len(slots)] = crf.scores_of(self.model.chain.weights, np.array([s for x in slots for s in x], np.int64), offsets)
        fresh.clear()

    def tag(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """For each text the row numbers of its words, and the posteriors of all words one after the other."""
        if self.index.used * len(self.model.chain.labels) > SCORE_CACHE:
            self.index = Rows()
        row, found = self.index.__getitem__, []
        for text in texts:
            at = np.array(list(map(row, words_of(text))), np.int64)
            found.append(at[at >= 0] if len(at) and at.min() < 0 else at)
        self._score_fresh()
        lengths = np.array([len(x) for x in found], np.int64)
        flat = np.concatenate(found) if found else np.empty(0, np.int64)
        return found, crf.posteriors(self.model.chain, self.rows[flat], lengths[lengths > 0])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found, post = self.tag(texts)
        labels, names, shares, at = self.model.chain.labels, [], [], 0
        for x in found:
            if not len(x):
                names.append(UND)
                shares.append(0.0)
                continue
            total = post[at : at + len(x)].sum(axis=0)
            at += len(x)
            best = int(total.argmax())
            names.append(labels[best])
            shares.append(round(float(min(1.0, total[best] / len(x))), 9))
        return names, shares


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sampled texts to their distinct words (one half) or to pieces (the other)."""
    for batch in batches:
        for text, lang, draw in zip(*(batch.column(k).to_pylist() for k in ("text", "lang", "draw")), strict=True):
            words = words_of(text)
            lexical = draw & 1 == 0
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([sorted(set(words)) if lexical else []], pa.list_(pa.string())), pa.array([[] if lexical else pieces_of(words, draw & 0x7FFFFFFF)], pa.list_(pa.list_(pa.string())))], names=["lang", "words", "pieces"])


def train(documents: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from a bounded sample of the rows where `learn` holds and the language is known."""
    known = documents.where(learn & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return fit([], {})
    # About twice as many as needed pass the hash, and of these the first are taken.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], 2 * per_language / r["count"])])
    drawn = known.withColumn("draw", F.xxhash64("id", "text", F.lit("language"))).where(unit_hash(F.col("draw"), "language") < share[F.col("lang")])
    first = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("rank") <= per_language)
    # Halves follow the rank, so that both have rows wherever there are two.
    first = first.select("text", "lang", (F.shiftleft(F.col("draw"), 1) + F.when((F.col("rank") > 1) & (F.col("rank") % 2 == 1), 0).otherwise(1)).alias("draw"))
    sample = materialise(mapped(first, _samples, "lang string, words array<string>, pieces array<array<string>>"), "language-sample")
    by_lang = sample.select("lang", F.explode("words").alias("word")).groupBy("word", "lang").count()
    total = by_lang.groupBy("word").agg(F.max_by("lang", F.struct("count", "lang")).alias("lang"), F.max("count").alias("most"), F.sum("count").alias("all"))
    named = total.where((F.col("most") >= LEXICON_COUNT) & (F.col("most") >= LEXICON_SHARE * F.col("all")))
    named = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("most"), "word"))).where(F.col("rank") <= LEXICON_WORDS)
    lexicon = {r["word"]: r["lang"] for r in named.select("word", "lang").collect()}
    pieces = [(r["piece"], r["lang"]) for r in sample.select("lang", F.explode("pieces").alias("piece")).collect()]
    discard(sample)
    return fit(pieces, lexicon)


def identify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, lang_pred and score."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(held.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                names, shares = tagger.predict(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(names, pa.string()), pa.array(shares, pa.float64())], names=["id", "lang_pred", "score"])

    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = mapped(docs, run, with_id(docs.schema["id"].dataType, "lang_pred string, score double"))
    return out.withColumnRenamed("id", id_col)


def code_switches(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words with their most likely language: id, position, word, lang, probability."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(held.value)
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text").to_pylist()
            for k, text in enumerate(texts):
                words = [w for w in words_of(text) if any(map(str.isalpha, w))]
                _, post = tagger.tag([text])
                best = post.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([ids[k].as_py()] * len(words), ids.type), pa.array(range(len(words)), pa.int64()), pa.array(words, pa.string()), pa.array([held.value.chain.labels[x] for x in best], pa.string()), pa.array(post[np.arange(len(best)), best], pa.float64())], names=["id", "position", "word", "lang", "probability"])

    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = mapped(docs, run, with_id(docs.schema["id"].dataType, "position bigint, word string, lang string, probability double"))
    return out.withColumnRenamed("id", id_col)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), bucket_of(F.col("doc_id"), 3) == 1
    out = identify(docs, train(docs, ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
