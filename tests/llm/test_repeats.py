"""Repeated rows, weak sentences and unfinished tags."""

import time

import numpy as np
from pyspark.sql import functions as F

from streamledger.llm import html_extraction, jaccard, toxicity
from streamledger.llm.common import materialise


def test_repeated_rows_cost_one_set(spark):
    """Two linked texts, each ten thousand times under one id: one set each, and one link."""
    text = " ".join(f"w{k}" for k in range(80))
    docs = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(2).alias("doc_id"), F.when(F.col("id") % 2 == 0, text).otherwise(text + " end").alias("text")).repartition(8)
    got = jaccard.ngram_jaccard_components(docs)
    assert {tuple(r) for r in got.groupBy("doc_id", "n_shingles", "component_id").count().collect()} == {(1, 77, 1, 10_000), (2, 78, 1, 10_000)}


def test_sets_are_taken_once(spark):
    rows = spark.createDataFrame([(1, [1, 2]), (1, [1, 2]), (2, [3])], "set bigint, tokens array<bigint>").repartition(3)
    out = jaccard.once(materialise(rows, "test-sets"))
    assert sorted(r["set"] for r in out.collect()) == [1, 2]


def test_a_toxic_text_always_has_a_sentence():
    weights = np.zeros(toxicity.SLOTS + 1, np.float32)
    scorer = toxicity.Scorer(weights)
    scorer.bias = -1.0
    score, offending = scorer.score("One here. Two here. Three here. Four here.")
    assert score > 0.5 and len(offending) == 4
    scorer.bias = -9.0
    assert scorer.score("One here. Two here.")[1] == []


def test_end_tags_without_an_end_are_linear():
    took = []
    for n in (20_000, 80_000):
        page = "<p>text</p><script>" + "</script " * n
        began = time.perf_counter()
        assert [b.text for b in html_extraction.leaf_blocks(page)] == ["text"]
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 0.5
    assert [b.text for b in html_extraction.leaf_blocks("<p>a</p><script>x</script junk>y<p>b</p>")] == ["a", "y", "b"]


def test_benchmark_of_megabytes_is_one_automaton(spark):
    """Two million characters of items: one pass, about a hundred bytes a character, hits where they are."""
    import random

    from streamledger.llm import decontamination

    draw = random.Random(4)
    vocabulary = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 9))) for _ in range(20_000)]
    items = [(k, " ".join(draw.choices(vocabulary, k=120))) for k in range(2500)]
    frame = spark.createDataFrame(items, "item_id int, text string")
    assert len(list(decontamination.shards_of(frame, "item_id", "text", decontamination.SHARD_CHARS))) == 1
    windows = decontamination.automaton_of(items)
    assert len(windows.letters) < 20_001 and all(n == 10 for n in windows.sizes)
    words = items[7][1].encode().split()
    text = [b"before", *words[5:17], b"after", *words[40:49], b"no", *words[100:120]]
    assert decontamination.scan(text, windows) == ([(1, 13), (24, 44)], [7])
    assert decontamination.letter(0xD7FE) == "퟿" and decontamination.letter(0xD7FF) == ""


def test_workers_forget_what_other_operators_keep(spark):
    """A worker that turns to another operator holds no vocabulary, automaton or parts of words of the one before."""
    from streamledger.llm import bpe, common, decontamination, langid

    decontamination.BUILT[:] = [[], 10, None]
    langid.PREFIX["a"]
    common.turned_to(langid.__name__)
    assert decontamination.BUILT == [] and langid.PREFIX
    decontamination.BUILT[:] = [[], 10, None]
    common.turned_to(bpe.__name__)
    assert decontamination.BUILT == [] and not langid.PREFIX
