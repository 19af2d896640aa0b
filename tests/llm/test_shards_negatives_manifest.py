"""Operators 11 to 13 against plain versions, and what they do with odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamledger.llm import hard_negatives, merkle, sharding

LONG = "word " * 40_000
ROWS = [(1, "same words", "en", "a"), (2, "same words", "en", "b"), (3, "", "en", None), (4, None, None, None), (None, "no id", "en", "x"), (5, LONG, "en", "y"), (5, LONG, "en", "y"), (6, "É\n", "de", "z"), (7, "ABC", None, "z"), (None, "no id", "fr", "z")]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    return base.withColumns({c: F.lit("clash") for c in ("id", "key", "size", "crc", "shard", "slot", "at", "n", "tree", "leaf", "claimed", "pos", "block", "digest")}).repartition(3)


# 11


def plain_partition(sizes, shards):
    """Sizes in order of key, to shard by key: the search over every group."""

    def ends(rest, cap, left):
        out, at = [], 0
        for _ in range(left):
            held = 0
            while at < len(rest) and held + rest[at][1] <= cap:
                held, at = held + rest[at][1], at + 1
            out.append(at)
        return out

    largest = sorted(sizes, key=lambda x: (-sizes[x], x))
    for n in range(min(shards, len(largest))):
        rest, left, most = sorted((k, v) for k, v in sizes.items() if k not in largest[:n]), shards - n, sizes[largest[n]]
        low, high = most, sum(v for _, v in rest)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if ends(rest, mid, left)[-1] == len(rest) else (mid + 1, high)
        if low > most or left == 1:
            out = {k: i for i, k in enumerate(largest[:n])}
            return out | {k: n + sum(at >= e for e in ends(rest, low, left)) for at, (k, _) in enumerate(rest)}
    return {k: i for i, k in enumerate(largest)}


@pytest.mark.parametrize(("seed", "shards", "kind"), [(1, 5, "even"), (2, 24, "even"), (3, 7, "hot"), (4, 24, "steep"), (5, 1, "even"), (6, 40, "few"), (7, 3, "equal")])
def test_partition_is_the_search_over_all_groups(spark, monkeypatch, seed, shards, kind):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", 1)  # so that cells are split several times
    draw = random.Random(seed)
    n = 20 if kind == "few" else 1500
    size = {"even": lambda: draw.randint(8, 60), "hot": lambda: draw.randint(8, 60), "steep": lambda: int(8 + draw.paretovariate(0.7)), "few": lambda: draw.randint(8, 999), "equal": lambda: 10}[kind]
    sizes = {hashlib.md5(f"{seed} {k}".encode()).hexdigest(): size() for k in range(n)}
    if kind == "hot":
        sizes[min(sizes)], sizes[max(sizes)] = 40_000, 25_000
    alone, begins = sharding.partition(spark.createDataFrame(list(sizes.items()), "key string, size bigint"), shards)
    want = plain_partition(sizes, shards)
    got = {k: alone.index(k) if k in alone else len(alone) + sum(k >= b for b in begins) for k in sizes}
    assert got == want
    if kind == "hot":
        assert len(alone) == 2 and len(set(got.values())) == shards  # large groups leave no shard empty


def test_shards_of_odd_rows(docs):
    got = sharding.shard_documents(docs, 3).collect()
    assert len(got) == len(ROWS)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= {0, 1, 2}
    at = lambda doc_id: {r["shard"] for r in got if r["id"] == doc_id}
    assert at(1) == at(2) and at(3) == at(4) and len(at(None)) == 1 and at(5) == {0}
    crc = {(r["id"], r["size"], r["crc"]) for r in got}
    assert crc == {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS}
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="shards"):
        sharding.shard_documents(docs, 0)


def test_written_shards_hold_every_row(spark, docs, tmp_path):
    sharding.write_shards(docs.drop("shard"), f"{tmp_path}/out", 3)
    back = spark.read.parquet(f"{tmp_path}/out")
    want = {(r["id"], r["shard"]) for r in sharding.shard_documents(docs, 3).collect()}
    assert back.count() == len(ROWS) and {(r["doc_id"], r["shard"]) for r in back.collect()} == want


def test_sharding_runs_no_python(spark):
    plan = sharding.op11_sharding(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapPartitions", "ExistingRDD"))


# 12


def plain_negatives(rows, n_positives=5, n_negatives=10):
    good = [(i, y, [int(np.floor(256 * np.float64(x))) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, y, v in good:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, z) for j, z, w in good if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:n_positives]:
            fit = [(-t, k) for t, k, z in scored if z != y and 30 * -s <= 100 * -t <= 90 * -s][:n_negatives]
            out += [(i, j, rank, k, -s, t) for rank, (t, k) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "spread", "at_once"), [(1, 0.2, 1024), (2, 0.2, 2), (3, 0.005, 3), (4, 900.0, 1024)])
def test_negatives_are_those_of_all_products(spark, monkeypatch, seed, spread, at_once):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, spread, (4, 12))
    rows = [(int(k), int(y), [float(x) for x in centres[y] + draw.normal(0, spread, 12)]) for k, y in enumerate(draw.integers(0, 4, 900))]
    rows[5:8] = [(5, None, rows[5][2]), (6, 1, None), (7, 1, [float("nan")] * 12)]
    rows[8:10] = [(8, 2, [None] + rows[8][2][1:]), (9, 3, [float("inf")] + rows[9][2][1:])]
    rows += [(901, y, v) for _, y, v in rows[50:90]] + [(902, 1, [])]  # one id on many rows, and no components
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "whole", "anchor", "score", "window", "x")}).repartition(5)
    got = hard_negatives.hard_negatives(hard_negatives.quantised(frame, anchor=F.col("vec_id") % 100 == 0), anchors_at_once=at_once)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == plain_negatives(rows)


def test_planes_drop_candidates_early():
    """Few pairs come to the last planes, and none that qualifies is lost."""
    draw = np.random.default_rng(0)
    rows = draw.integers(-60, 60, (3000, 64))
    rows[:40] = rows[0] + draw.integers(-9, 9, (40, 64))
    anchors = hard_negatives.Anchors([(0, 0, rows[0].tolist())], 64, 8)
    floor = np.array([60_000])
    seen = []
    each = anchors.planes

    def counted(x):
        for m, w, plane in each(x):
            seen.append(m)
            yield m, w, plane

    anchors.planes = counted
    a, r, score = anchors.candidates(np.array([0]), rows, np.ones((1, 3000), bool), floor, np.array([1 << 40]))
    want = rows @ rows[0]
    assert set(r) == set(np.flatnonzero(want >= 60_000)) and (score == want[r]).all() and seen == list(range(7, -1, -1))
    m, rest = 3, 7
    upper = ((rows >> m) << m) @ rows[0] + rest * np.maximum(rows[0], 0).sum()
    assert (upper >= 60_000).mean() < 0.05  # after five of eight planes


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id bigint, label int, embedding array<float>")
    assert hard_negatives.hard_negatives(hard_negatives.quantised(none, anchor=F.col("vec_id") % 100 == 0)).count() == 0
    alone = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0]), (0, 1, [1.0])], "vec_id bigint, label int, embedding array<float>")
    assert hard_negatives.hard_negatives(hard_negatives.quantised(alone, anchor=F.col("vec_id") % 100 == 0)).count() == 0
    huge = spark.createDataFrame([(0, 1, [1e30]), (1, 1, [1e30])], "vec_id bigint, label int, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.hard_negatives(hard_negatives.quantised(huge))


# 13


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_leaf(r):
    return digest(*("-" if r[f] is None else f"{len(str(r[f]).encode())}:{r[f]}" for f in merkle.FIELDS))


def plain_tree(nodes):
    """Root, and the siblings of each leaf level by level as (left, right)."""
    beside, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(places):
            run = p // 8 * 8
            beside[k].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + 8])))
        nodes, places = [digest(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)], [p // 8 for p in places]
    return nodes[0], beside


def plain_manifest(rows):
    trees = defaultdict(list)
    for r in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]) if r["text"] is not None else None
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        trees[r["lang"]].append(((r["doc_id"] is not None, r["doc_id"] or 0), plain_leaf(r), plain_leaf(r.asDict() | {"text": low}) if hit else plain_leaf(r), r["doc_id"]))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    done = {t: (sorted(trees[t]), *plain_tree([x[1] for x in sorted(trees[t])])) for t in order}
    root, above = plain_tree([done[t][1] for t in order])
    out = []
    for t, over in zip(order, above, strict=True):
        leaves, subroot, beside = done[t]
        for (_, leaf, claimed, doc_id), path in zip(leaves, beside, strict=True):
            at = claimed
            for left, right in path + over:
                at = digest(left, at, right)
            out.append((doc_id, leaf, subroot, root, digest(*(x + y for x, y in path + over)), at, at == root))
    return sorted(out, key=str)


def told(rows, depth):
    leaf = merkle.leaf_of([F.col(f) for f in merkle.FIELDS])
    claimed = merkle.leaf_of([merkle.tampered(rows) if f == "text" else F.col(f) for f in merkle.FIELDS])
    got = merkle.manifest(rows.select(F.col("doc_id").alias("id"), F.col("lang").alias("tree"), leaf.alias("leaf"), claimed.alias("claimed")), depth)
    return sorted((tuple(r) for r in got.select("id", "leaf", "subroot", "root", "proof", "folded", "verified").collect()), key=str)


@pytest.mark.parametrize(("sizes", "depth"), [({"a": 1}, 4), ({"a": 8, "b": 9}, 4), ({None: 3, "": 1, "b": 700, "é": 65}, 1), ({"a": 64, "z": 520}, 2), ({f"t{k}": 1 + k % 3 for k in range(70)}, 1), ({"a": 4200, "b": 5}, 4)])
def test_manifest_is_that_of_plain_trees(spark, sizes, depth):
    rows = [(k * 7 % 100_003, f"Text {k}" if k % 5 else None, tree, "S") for tree, n in sizes.items() for k in range(n)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint")).repartition(4)
    want = plain_manifest(frame.collect())
    assert told(frame, depth) == want and (len(rows) < 5 or {r[-1] for r in want} == {True, False})


def test_manifest_of_odd_rows(docs):
    got = told(docs, 4)
    assert got == plain_manifest(docs.collect()) and len(got) == len(ROWS)
    assert told(docs.limit(0), 4) == []
