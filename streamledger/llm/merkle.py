"""A Merkle manifest of a dataset: a digest for every row, a tree for every partition, one root (operator 13).

A leaf is the SHA-256, in hex, of a row's fields (`-` for null, else UTF-8 byte count,
`:` and value). The leaves of a tree ascend by id; every FANOUT consecutive nodes (at the
end fewer, even one) become the SHA-256 of their hex digits, until one is left, the
subroot. Subroots in order of their trees give the root in the same way.

Digests are made in the JVM, so texts do not go to Python. Rows are sorted by range, and
their ranks follow from the sizes of the ranges. Aligned blocks of 8^4 leaves are numpy
matrices of 64 hex digits a row: a level is a reshape by the fanout and a hash of each
row, and siblings are slices found by index arithmetic. Block roots are the leaves of
the next stage, treated alike, so that a tree is never one task, however large. On the
way down each block gets what stands beside the path above it, and tells for each leaf
the digest of its proof and the root to which it folds.

Rows without a tree (null) have one of their own, before all others; trees are ordered
by their UTF-8 bytes. Rows without an id come first; rows that repeat an id ascend by
leaf, and each is a leaf. A single row is its own subroot and root, and its proof is the
digest of nothing. Empty tables give empty tables. Extra columns are ignored.
"""

from __future__ import annotations

import binascii
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamledger.llm.common import bucket_of, discard, mapped, materialise, table

FANOUT = 8
#: Levels of a block, which has FANOUT**LEVELS leaves at most.
LEVELS = 4
#: Hex digits of a digest.
DIGITS = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# Leaves


def leaf_of(fields: list[Column]) -> Column:
    """The digest of a row's fields, in hex."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def tree_key(tree: Column) -> Column:
    """A text that sorts as the trees do: null first, then by bytes."""
    return F.when(tree.isNull(), "").otherwise(F.concat(F.lit("="), tree.cast("string")))


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with pos, their rank in their tree from 0, and total, its size; and the sorted ranges, which are written once. A rank is the place in the range plus the sizes of the ranges before."""
    held = materialise(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")
    piece = F.shiftright("at", 33).alias("piece")
    runs = held.groupBy("tree", piece).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    one = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(one.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("tree", "piece", (before - F.col("first")).alias("shift"), F.sum("n").over(one).alias("total"))
    return held.withColumn("piece", piece).join(starts, ["tree", "piece"]).withColumn("pos", F.col("at") + F.col("shift")).drop("piece", "at", "shift"), held


# Blocks in numpy


def hexed(digests: bytes) -> np.ndarray:
    """Digests of 32 bytes as rows of 64 hex digits."""
    return np.frombuffer(binascii.hexlify(digests), np.uint8).reshape(-1, DIGITS)


def level_above(nodes: np.ndarray) -> np.ndarray:
    full = len(nodes) // FANOUT
    made = [sha256(row).digest() for row in np.ascontiguousarray(nodes[: full * FANOUT]).reshape(full, FANOUT * DIGITS)]
    if full * FANOUT < len(nodes):
        made.append(sha256(nodes[full * FANOUT :].tobytes()).digest())
    return hexed(b"".join(made))


def levels_of(leaves: np.ndarray, total: int, depth: int) -> list[np.ndarray]:
    """The levels of a block, leaves first: depth more where the tree has other blocks, else until one node is left."""
    levels = [leaves]
    while len(levels) <= depth if total > FANOUT**depth else len(levels[-1]) > 1:
        levels.append(level_above(levels[-1]))
    return levels


def beside(levels: list[bytes], k: int) -> list[tuple[bytes, bytes]]:
    """What stands left and right of the path from leaf k of a block to its root, level by level. levels: digits of all but the root."""
    out = []
    for nodes in levels:
        run = k // FANOUT * FANOUT
        out.append((nodes[run * DIGITS : k * DIGITS], nodes[(k + 1) * DIGITS : (run + FANOUT) * DIGITS]))
        k //= FANOUT
    return out


def folded(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        leaf = sha256(left + leaf + right).hexdigest().encode()
    return leaf


# Stages


def packed(nodes: DataFrame, name: str, depth: int) -> DataFrame:
    """Nodes (tree, pos, total, digest, id, claimed) as blocks: tree, block, total, ids, digests, claims (the same or other digests to fold, empty for none) and root."""
    ids = nodes.schema["id"].dataType
    schema = T.StructType([T.StructField("tree", T.StringType()), T.StructField("block", T.LongType()), T.StructField("total", T.LongType()), T.StructField("ids", T.ArrayType(ids)), T.StructField("digests", T.BinaryType()), T.StructField("claims", T.BinaryType()), T.StructField("root", T.BinaryType())])

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos").combine_chunks()
        own = b"".join(rows["digest"].to_pylist())
        root = levels_of(hexed(own), rows["total"][0].as_py(), depth)[-1].tobytes()
        cells = [key[0].as_py()], [key[1].as_py()], [rows["total"][0].as_py()], [rows["id"].to_pylist()], [own], [b"".join(rows["claimed"].drop_null().to_pylist())], [binascii.unhexlify(root)]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(rows["id"].type), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=schema.names)

    blocks = nodes.withColumn("block", F.floor(F.col("pos") / FANOUT**depth).cast("bigint"))
    return materialise(blocks.groupBy("tree", "block").applyInArrow(pack, schema), name)


def climbed(rows: DataFrame, order: list[str], name: str, depth: int) -> list[DataFrame]:
    """Blocks of rows (tree, digest, id, claimed) ranked in their trees, of their roots, and so on, until each tree has one block."""
    nodes, ranges = numbered(rows, order)
    stages = [packed(nodes, f"{name}-0", depth)]
    discard(ranges)
    while (stages[-1].agg(F.max("total")).first()[0] or 0) > FANOUT**depth:
        above = stages[-1].select("tree", F.col("block").alias("pos"), F.ceil(F.col("total") / FANOUT**depth).cast("bigint").alias("total"), F.col("root").alias("digest"), F.col("block").alias("id"), F.lit(None).cast("binary").alias("claimed"))
        stages.append(packed(above, f"{name}-{len(stages)}", depth))
    return stages


#: What stands beside the path above a block, and the subroot of its tree and the root.
ABOVE = "lefts array<binary>, rights array<binary>, subroot string, root_of_all string"
PATHS = "tree string, block bigint, " + ABOVE


def paths(blocks: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """For each node of the blocks what stands beside its path, down from `above` (one row per block): tree, block (its number among the nodes, which is the block below it)."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = [x.tobytes() for x in levels_of(hexed(row["digests"]), row["total"], depth)[:-1]]
                n, first = len(row["digests"]) // 32, row["block"] * FANOUT**depth
                steps = [beside(levels, k) for k in range(n)]
                lefts, rights = ([[s[side] for s in steps[k]] + row[name] for k in range(n)] for side, name in ((0, "lefts"), (1, "rights")))
                yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(lefts, pa.list_(pa.binary())), pa.array(rights, pa.list_(pa.binary())), pa.array([row["subroot"]] * n, pa.string()), pa.array([row["root_of_all"]] * n, pa.string())], names=["tree", "block", "lefts", "rights", "subroot", "root_of_all"])

    return mapped(blocks.select("tree", "block", "total", "digests").join(above, ["tree", "block"]), tell, PATHS)


def proven(blocks: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """For each leaf: id, leaf, subroot, root, proof (digest of what stands beside its path), folded (the root that its claimed digest leads to) and verified."""
    kind = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(n, T.StringType()) for n in ("leaf", "subroot", "root", "proof", "folded")), T.StructField("verified", T.BooleanType())])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            for at, row in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                leaves = hexed(row["digests"])
                claims = binascii.hexlify(row["claims"])
                levels = [x.tobytes() for x in levels_of(leaves, row["total"], depth)[:-1]]
                higher = list(zip(row["lefts"], row["rights"], strict=True))
                rest = b"".join(left + right for left, right in higher)
                root, n = row["root_of_all"], len(leaves)
                proofs, roots = [], []
                for k in range(n):
                    path = beside(levels, k)
                    proofs.append(sha256(b"".join(x for pair in path for x in pair) + rest).hexdigest())
                    roots.append(folded(claims[k * DIGITS : (k + 1) * DIGITS], path + higher).decode())
                leaf = pa.array([x.tobytes().decode() for x in leaves], pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(at, 1).flatten(), leaf, pa.array([row["subroot"]] * n, pa.string()), pa.array([root] * n, pa.string()), pa.array(proofs, pa.string()), pa.array(roots, pa.string()), pa.array([r == root for r in roots], pa.bool_())], names=schema.names)

    return mapped(blocks.select("tree", "block", "total", "ids", "digests", "claims").join(above, ["tree", "block"]), tell, schema)


def down(stages: list[DataFrame], above: DataFrame, depth: int) -> DataFrame:
    """What stands above each block of the first stage, from what stands above the last stage's."""
    for blocks in reversed(stages[1:]):
        above = paths(blocks, above, depth)
    return above


def manifest(rows: DataFrame, depth: int = LEVELS) -> DataFrame:
    """Rows (id, tree, leaf, claimed: hex digests; a null claim is the leaf itself) to id, leaf, subroot, root, proof, folded and verified."""
    leaves = rows.select("id", tree_key(F.col("tree")).alias("tree"), F.unhex("leaf").alias("digest"), F.unhex(F.coalesce("claimed", "leaf")).alias("claimed"))
    trees = climbed(leaves, ["id", "digest"], "merkle", depth)
    subroots = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("root").alias("digest"), F.lit(None).cast("binary").alias("claimed"))
    tops = climbed(subroots, ["id"], "merkle-top", depth)
    none = F.array().cast("array<binary>")
    root = F.lower(F.hex("root"))
    above = down(tops, tops[-1].select("tree", "block", none.alias("lefts"), none.alias("rights"), root.alias("subroot"), root.alias("root_of_all")), depth)
    # above has a row for each block of subroots; a subroot's own path is one step more, and stands above its tree's last block
    named = tops[0].select("block", F.posexplode("ids").alias("k", "tree")).select((F.col("block") * FANOUT**depth + F.col("k")).alias("number"), "tree")
    tree_paths = paths(tops[0], above, depth).select(F.col("block").alias("number"), "lefts", "rights", "root_of_all")
    own = trees[-1].select("tree", root.alias("subroot"))
    above = tree_paths.join(named, "number").join(own, "tree").select("tree", F.lit(0).cast("bigint").alias("block"), "lefts", "rights", "subroot", "root_of_all")
    return proven(trees[0], down(trees, above, depth), depth)


def tampered(docs: DataFrame) -> Column:
    """Where 3 divides the CRC of the decimal id, a copy of the text with A-Z in lower case; other texts are as they are."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id"), 3) == 0), low).otherwise(F.col("text"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = [F.col(f) for f in FIELDS]
    other = [tampered(docs) if f == "text" else F.col(f) for f in FIELDS]
    rows = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("tree"), leaf_of(own).alias("leaf"), leaf_of(other).alias("claimed"))
    out = manifest(rows)
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")


# The same in SQL: levels are spelled out, enough for 8^7 leaves of a tree and 8^3 trees


def _levels_sql(name: str, depth: int) -> list[str]:
    """Levels of the trees of {name}0 (tree, pos, n, digest), and the runs of nodes that are hashed together."""
    out = []
    for k in range(depth):
        out.append(f"{name}_runs{k} AS (SELECT tree, pos // {FANOUT} AS run, any_value(n) AS n, list(digest ORDER BY pos) AS ds FROM {name}{k} GROUP BY ALL)")
        out.append(f"{name}{k + 1} AS (SELECT tree, run AS pos, (n + {FANOUT - 1}) // {FANOUT} AS n, CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS digest FROM {name}_runs{k})")
    return out


def _fold_sql(name: str, k: int, rows: str) -> str:
    """One step up of rows (tree, pos, folded, proof): what stands left and right of the node at pos is put round it."""
    at = f"pos % {FANOUT}"
    left, right = f"array_to_string(ds[1:{at}], '')", f"array_to_string(ds[{at} + 2:], '')"
    return f"SELECT r.* REPLACE (pos // {FANOUT} AS pos, CASE WHEN n = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded, CASE WHEN n = 1 THEN proof ELSE proof || {left} || {right} END AS proof) FROM {rows} r JOIN {name}_runs{k} s ON s.tree = r.tree AND s.run = r.pos // {FANOUT}"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(({f})::VARCHAR)) || ':' || ({f})::VARCHAR, '-')" for f in [*FIELDS[:-1], text]) + ")"


def _sql(depth: int = 7, top: int = 3) -> str:
    from streamledger.llm.sharding import CRC_SQL, CRC_TABLE_SQL

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"leaves AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, {_leaf_sql('text')} AS digest, CASE WHEN {CRC_SQL.format(text='doc_id::VARCHAR')} % 3 = 0 THEN {_leaf_sql(low)} ELSE {_leaf_sql('text')} END AS claimed FROM documents, {CRC_TABLE_SQL})",
        "own0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves)",
        *_levels_sql("own", depth),
        f"top0 AS (SELECT '' AS tree, tree AS own, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM own{depth})",
        *_levels_sql("top", top),
        "up0 AS (SELECT doc_id, digest AS leaf, tree, pos, claimed AS folded, '' AS proof FROM own0)",
        *(f"up{k + 1} AS ({_fold_sql('own', k, f'up{k}')})" for k in range(depth)),
        f"over0 AS (SELECT u.doc_id, u.leaf, t.digest AS subroot, '' AS tree, t.pos AS pos, u.folded, u.proof FROM up{depth} u JOIN top0 t ON t.own = u.tree)",
        *(f"over{k + 1} AS ({_fold_sql('top', k, f'over{k}')})" for k in range(top)),
    ]
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM over{top}, (SELECT digest AS root FROM top{top})"


OP13_SQL = _sql()
