"""The pipeline against plain versions of its stages, each on its own input."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from streamledger.llm import bpe, langid, toxicity
from streamledger.llm.common import materialise, table

from .test_methods import brute_components, brute_hits

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in cp.STAGES:
        after = materialise(stage(spark, docs, SF), f"test-{name}")
        out.append((rows_of(docs), rows_of(after), docs, after))
        docs = after
    return out


def test_contract(stages):
    assert [n for n, _ in cp.STAGES] == ["language_id", "toxicity", "near_duplicates", "decontamination", "bpe"]
    for _, _, before, after in stages[:-1]:
        assert before.columns == after.columns


def test_language_stage(stages):
    before, after, docs, _ = stages[0]
    model = langid.train(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
    tagger = langid.Tagger(model)
    want = set()
    for k, r in before.items():
        (name,), (share,) = tagger.predict([r["text"]])
        if name != "und" and share >= cp.MIN_LANGUAGE_SHARE:
            want.add(k)
    assert set(after) == want and len(want) > 0.98 * len(before)


def test_toxic_stage(spark, stages):
    before, after, docs, _ = stages[1]
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    weights = toxicity.train(docs, table(spark, SF, "labels"), F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    scorer = toxicity.Scorer(weights.astype("float32"))
    assert set(after) == {k for k, r in before.items() if scorer.score(r["text"])[0] < 0.5}
    learned = [k for k in before if labels.get(k) == 0 and zlib.crc32(str(k).encode()) % 5]
    assert sum(k in after for k in learned) > 0.97 * len(learned)


def test_near_duplicate_stage(stages):
    before, after, _, _ = stages[2]
    found = brute_components([(k, r["text"]) for k, r in before.items()], 5, 80, 100)
    assert set(after) == {k for k, (_, part) in found.items() if part == k}


def test_benchmark_stage(spark, stages):
    before, after, _, _ = stages[3]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    assert set(after) == {k for k, r in before.items() if brute_hits(r["text"], items)[1] == 0}


def test_encoding_stage(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after, _, _ = stages[4]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(after) == set(before)
    assert all(after[k]["n_tokens"] == len(t.encode(r["text"] or "", add_special_tokens=False).ids) for k, r in before.items())
    assert bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.json")).encode("") == b""


def test_edges(spark):
    rows = spark.createDataFrame([(None, "keep me without an id please", "en", None, 1), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c d e f g", "en", "s", 9), (3, "a b c d e f g", "en", "s", 9), (4, "a b c d e f g", "en", "s", 9)], "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("part", F.lit(1))
    kept = cp.near_duplicates(spark, rows, SF)
    assert kept.columns == rows.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 3]
    assert cp.benchmark_free(spark, rows, SF).count() == 6 and cp.benchmark_free(spark, rows.limit(0), SF).count() == 0
    assert {r["doc_id"] for r in cp.language_id(spark, rows, SF).collect()} <= {None, 3, 4}
    assert cp.encoded(spark, rows, SF).count() == 6


def test_rows_with_any_columns(spark):
    """Columns named like those the stages use inside, with dots and quotes in them, come out as they went in."""
    text = "the quick brown fox jumps over the lazy dog near the river bank today"
    other = "an altogether different text about the weather in the mountains this week"
    rows = [(1, text), (2, text), (2, other), (3, other + " again"), (None, text), (None, None), (4, ""), (5, "w " * 60_000)]
    odd = ("gone", "a.b", "row", "id", "text_hash", "gone_hash", "x`y", "stays", "n", "set")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text")})
    docs = docs.select("*", *[F.lit(c).alias(c) for c in odd])
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and all(r[c] == c for r in out.collect() for c in odd)
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = sorted(((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in cp.near_duplicates(spark, docs, SF).collect()))
    # (2, other) is alone although id 2 stands on a copy as well; the copy without an id goes
    assert kept == [(0, ""), (1, "the q"), (2, "an al"), (4, ""), (5, "w w w")]


def test_one_of_two_texts_of_one_id_stays(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(7, text), (7, text + " more"), (8, text), (8, text)], "doc_id bigint, text string")
    assert [r["doc_id"] for r in cp.near_duplicates(spark, docs, SF).collect()] == [7]
