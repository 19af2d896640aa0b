"""A corpus pipeline in five stages: language ID, toxicity, near duplicates, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage
before it kept, and returns a DataFrame; all but the last return the columns of
documents. Texts are whole, however long; columns besides doc_id, text and lang are
handed on untouched, whatever their names; empty tables give empty tables.

Null and empty texts are in no language and go in the first stage; the others keep
them. Documents without an id pass the near-duplicate stage untouched, and rows
that repeat an id stay or go together there; ties are settled by the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamledger.llm import bpe, decontamination, jaccard, langid, toxicity
from streamledger.llm.common import bucket_of, discard, materialise, named, table

#: A text in which no language holds this share of the words is in no language.
MIN_LANGUAGE_SHARE = 0.35
#: Near duplicates: words in a shingle, and the similarity as a fraction.
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)
TOXIC = 0.5


def _rows(docs: DataFrame) -> DataFrame:
    """Whole rows as one column beside their text, so that a mapped operator hands them on without a join."""
    return docs.select(F.struct(*map(named, docs.columns)).alias("row"), F.col("text"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without letters, or in which no language prevails, go."""
    model = langid.train(docs, bucket_of(F.col("doc_id"), 3) != 1)
    tagged = langid.identify(_rows(docs), model, id_col="row")
    return tagged.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_LANGUAGE_SHARE)).select("row.*")


def toxic_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier clean than toxic."""
    weights = toxicity.train(docs, table(spark, sf_dir, "labels"), bucket_of(F.col("doc_id"), 5) != 0)
    return toxicity.score_toxicity(_rows(docs), weights, id_col="row").where(F.col("score") < TOXIC).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the smallest id and, where this id stands on several texts, of these that with the smallest hash. Rows are told apart by id and text."""
    placed = jaccard.placed_rows(docs, width=SHINGLE_WORDS, threshold=SIMILARITY)
    gone = materialise(placed.where(~F.col("stays")).select(F.col("id").alias("gone"), F.col("text_hash").alias("gone_hash")).distinct(), "near-duplicates")
    rows = _rows(docs).select("row", F.col("row.doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))
    same = F.col("id").eqNullSafe(F.col("gone")) & (F.col("text_hash") == F.col("gone_hash"))
    return rows.join(jaccard.fitting(gone, jaccard.BROADCAST_IDS), same, "left_anti").select("row.*")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    scanned = decontamination.decontaminate(_rows(docs), table(spark, sf_dir, "benchmark"), id_col="row", spans=False)
    return scanned.where(~F.col("contaminated")).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left, as counts and digests, and the digest of the text they decode to."""
    import public_tokenizers

    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic_content),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("bpe", encoded),
]

#: Learned decisions of the first two stages can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
