"""Nulls, empty and very long texts, ties, repeats, empty tables, and extra columns with clashing names, for every operator."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from streamledger.llm import bpe, chat, decontamination, html_extraction, jaccard, langid, licences, media, toxicity, warc
from streamledger.llm.registry import QUERIES

LONG = " ".join(f"word{k % 977}" for k in range(40_000)) + ". "
ROWS = [(1, "Same words in this text here.", "en", "a"), (2, "Same words in this text here.", "en", "b"), (3, "", "en", None), (4, None, None, None), (None, "no id at all in this row", "en", "x"), (5, LONG, "en", "y"), (5, LONG, "en", "y"), (6, " \n\t ", "de", "z"), (7, "123 456 ...", None, "z"), (8, "x" * 100_000, "fr", "z")]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string")
    clash = {c: F.lit("clash") for c in ("id", "row", "n", "set", "score", "ids", "decoded", "items", "data", "media", "label", "draw", "part", "seq")}
    return base.withColumns(clash).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows_of(df):
    return sorted(df.collect(), key=lambda r: (r[0] is None, r[0] or 0))


def test_licences(docs, none):
    got = rows_of(licences.scan_licences(docs))
    assert len(got) == len(ROWS) and all(r["licences"] == [] for r in got)
    assert licences.scan_licences(none).count() == 0


def test_media(docs, none):
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"), "media")
    got = rows_of(media.media_columns(rows, "doc_id", "data"))
    assert len(got) == len(ROWS)
    assert [r["payload_bytes"] for r in got[:4]] == [576] * 4 and got[2]["n_bytes"] == 0
    assert got[0]["media"] == got[1]["media"] and got[0]["fingerprint"] == got[1]["fingerprint"]
    assert media.media_columns(rows.limit(0), "doc_id", "data").count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(10, "words in this TEXT"), (9, "words, in this text"), (11, None), (12, ""), (10, "words in this TEXT")], "item_id bigint, text string")
    got = rows_of(decontamination.decontaminate(docs, items))
    assert len(got) == len(ROWS)
    assert (got[0]["n_words"], got[0]["n_hit"], got[0]["items"], got[0]["contaminated"]) == (6, 4, [10, 9], True)
    text = ROWS[0][1]
    assert [text[s["start"] : s["end"]] for s in got[0]["spans"]] == ["words in this text"]
    assert [r["n_words"] for r in got[2:4]] == [0, 0] and not got[2]["contaminated"]
    assert decontamination.decontaminate(none, items).count() == 0
    assert not any(r["contaminated"] for r in decontamination.decontaminate(docs, items.limit(0)).collect())


def test_bpe(docs, none):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = rows_of(bpe.encode_decode(docs, path))
    want = [r[1] or "" for r in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0))]
    assert [r["decoded"] for r in got] == want and got[2]["n_tokens"] == 0
    assert bpe.encode_decode(none, path).count() == 0


def test_jaccard(docs, none):
    got = rows_of(jaccard.ngram_jaccard_components(docs))
    assert [(r["doc_id"], r["component_id"]) for r in got] == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (5, 5), (6, 6), (7, 7), (8, 8), (None, None)]
    assert [r["n_shingles"] for r in got][:4] == [3, 3, 0, 0]
    assert jaccard.ngram_jaccard_components(none).count() == 0


def test_langid(docs, none):
    model = langid.train(docs, F.lit(True))
    got = rows_of(langid.identify(docs, model))
    assert [r["lang_pred"] for r in got][2:4] == ["und", "und"] and got[7]["lang_pred"] == "und" and got[7]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(none, langid.train(none, F.lit(True))).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.train(none, F.lit(True))).collect()} == {"und"}


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, None), (None, 1), (99, 1)], "doc_id bigint, toxic int")
    for train_on in (labels, labels.limit(0)):
        got = rows_of(toxicity.score_toxicity(docs, toxicity.train(docs, train_on, F.lit(True))))
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got) and got[2]["score"] == got[3]["score"] == 0
    assert toxicity.score_toxicity(none, toxicity.fit([])).count() == 0


def test_html(spark):
    pages = [(1, "u", "<article><p>one &amp; two<p>three"), (2, None, None), (3, "u", ""), (None, "u", "<article><p>x</p></article>"), (4, "u", "<div>" * 3000 + "deep"), (4, "u", "<a href='"), (5, "u", "a < b <" + "<b>" * 10)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumns({"id": F.lit(0), "text": F.lit("clash")})
    got = rows_of(html_extraction.extract_main_text(frame))
    assert len(got) == len(pages) and got[0]["text"] == "one & two\nthree" and got[1]["text"] == got[2]["text"] == "" and got[-1]["text"] == "x"
    assert html_extraction.extract_main_text(frame.limit(0)).count() == 0


def test_html_drops_nothing_else():
    blocks = lambda page: [b.text for b in html_extraction.leaf_blocks(page)]
    for name in ("svg-icon", "title-bar", "template-card", "style-guide", "math-field", "object-view"):
        assert blocks(f"<article><{name} a='b'>x</{name}><p>one<p>two</article>") == ["x", "one", "two"]
    assert blocks("<div><svg><path d='m'>skip</div><p>one") == ["one"]
    assert blocks("<article><p>a <svg><path> <span>b</span> c<p>one") == ["a b c", "one"]
    assert blocks("<article><object data='x'><p>one<p>two") == ["one", "two"] and blocks("<div><template><li>skip</div><p>one") == ["one"]
    assert blocks("<article><p>so <math><mi>x</mi></math> holds<p>two") == ["so x holds", "two"] and blocks("<p>so <math><mi>x<p>two") == ["so x", "two"]
    assert blocks("<p>a <svg><title>t</title><svg></svg><text>no</text><foreignObject><p>no</p></foreignObject></svg> b") == ["a b"]
    assert blocks("<p>a <template><p>no</p></div><template></template>no</template> b") == ["a b"] and blocks("<p>a</p><script>no</script x><p>b<script>no") == ["a", "b"]


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, None, None, "x"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, 0, "assistant", "n"), (2, 0, "user", "only")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"conv": F.lit(1), "start": F.lit(2), "turns": F.lit(3), "replies": F.lit(4)})
    got = {r["conv"]: r for r in chat.read_back(chat.expand(chat.format_turns(frame))).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("", "x"), ("user", ""), ("assistant", "a"), ("assistant", "a")]
    assert got[1]["trained"] == ["a", "a"] and got[None]["trained"] == ["n"] and got[2]["trained"] == []
    assert chat.read_back(chat.expand(chat.format_turns(frame.limit(0)))).count() == 0


def test_warc(spark, tmp_path):
    warc.register(spark)
    pages = [(2, "u", "same"), (1, "a b\nc", "same"), (3, None, None), (4, "u", ""), (None, "u", "same"), (5, "u", LONG)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumns({"id": F.lit(0), "first": F.lit(1)})
    for k, f in enumerate((frame, frame.limit(0))):
        warc.records_of(f).write.format("warc").mode("append").save(f"{tmp_path}/w{k}")
    got = {r["record_id"]: r for r in spark.read.format("warc").load(f"{tmp_path}/w0").collect()}
    assert got["urn:page:1"]["record_type"] == "response" and got["urn:page:1"]["payload"] == b"same" and got["urn:page:1"]["target_uri"] == "a%20b%0Ac"
    assert got["urn:page:2"]["refers_to"] == "urn:page:1" == got["urn:page:null"]["refers_to"] and got["urn:page:2"]["payload_length"] == 4
    assert got["urn:page:3"]["payload"] == b"" and got["urn:page:4"]["refers_to"] == "urn:page:3" and got["urn:page:5"]["payload"] == LONG.encode()
    assert spark.read.format("warc").load(f"{tmp_path}/w1").count() == 0


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_many_languages_repeated_ids_and_long_words(spark):
    r = random.Random(4)
    word = lambda k: "".join(r.choice("aeiou") + chr(97 + (k + r.randint(0, 2)) % 26) for _ in range(3)) + chr(0x3B1 + k % 24) + chr(0x430 + k // 4)
    rows = [(None if k % 2 else 7, " ".join(word(k) for _ in range(12)), f"l{k:03d}") for k in range(80) for _ in range(3)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    assert len(model.chain.labels) == 80  # no cap, and rows without an id or with one id are drawn each by itself
    words = langid.words_of("x" * 1000 + "y" * 3)
    assert "".join(words) == "x" * 1000 + "yyy" and max(map(len, words)) == langid.RUN
