"""N-gram Jaccard join with a count-vector R-tree, exact, and its components (operator 10).

A document's set holds its distinct `width`-word shingles (a shorter text is one
shingle). Two sets A and B link when |A & B| >= t * |A | B|. The steps:

1. Each text becomes a sorted array of 64-bit shingle hashes. Equal sets share a
   fingerprint and are one class from here on, so copies cost nothing more.
2. Regions. Between random documents of one length the boxes of an R-tree over counts
   cover each other (the points lie closer together than nodes are wide), so one
   tree over all sets prunes nothing above its leaves. Sets are dealt out to regions
   first, by an exact rule: sets that link differ in at most D tokens, D following
   from t and the larger size. Tokens are hashed into G > D groups by ranges of
   their hashes; then at least G - D groups are equal, and a signature of each
   group's tokens brings the pair into one region. G depends on a band of sizes; a
   set signs for its own band and for each one above in which a partner may lie.
   Empty groups would meet everywhere; G has room for those that a set of the band
   leaves empty by chance, and only sets with more than that sign them (any linked
   pair then still has an equal group that both sign).
3. Trees. In each region an R-tree over the counts of `DIMS` groups of tokens gives the
   pairs: a node keeps the largest count of each coordinate and the smallest size
   below it; the sum over coordinates of min(query, node) bounds the overlap, and
   subtrees below the needed overlap are cut. Among the points left, parities of the
   counts of many more groups bound the difference. No pair reaches verification
   but through a tree.
4. Not all pairs of a region are told, but a spanning forest of them, nearest first:
   fewer than it has members, however alike they are. The first round has cells in
   place of regions: each set with the hub (the member of a bucket that meets others
   most often) with which it shares most buckets, so that copies are mostly one
   component after one comparison each. Verified edges give components by labels
   that spread and jump. Then come the regions whose members still lie in several
   components; a region of which an edge proved wrong and that has more pairs gives 64, then 4096, ...
   edge-disjoint forests, until all its pairs are given or lie within components.
   A region of more than `BLOCK` sets is cut into blocks: its largest component, which
   need not meet itself, is dealt out, and each two blocks of the rest meet in a
   group of their own.
5. Components of the edges give each document the smallest id reachable.

Verification compares 64-bit hashes of shingles; fingerprints of whole sets are 64 bits
as well and are not verified, so that among 10^9 different sets one false merger is
to be expected about once in 37 runs.

Null, empty and wordless texts have an empty set, link with nothing and are their
own component. Rows that repeat an id are placed by their own text each; a null id
links like any other but is nobody's smallest id (a component of null ids only has
a null one). Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamledger.llm.common import discard, mapped, materialise, named, slices, table, with_id

WIDTH, THRESHOLD = 4, (85, 100)
#: Coordinates of a point, entries of a tree node, words kept with their hash in a task.
DIMS, FANOUT, WORD_CACHE = 32, 16, 100_000
#: Points in a block of a large bucket or cell; and characters of the texts whose signatures or sets go out together.
BLOCK, SIGNED_CHARS = 1024, 500_000
#: Sets that a task remembers so as not to sign them again; forgetting costs repeats, not results.
SEEN = 50_000
#: Up to so many ids of candidate documents, pairs of sets, or sets in components are counted and broadcast to the rows they ask for; beyond, the joins shuffle.
BROADCAST_IDS = 1_000_000

P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordIndex(dict):
    """Words to their numbers; a new word's hash is noted once."""

    def __init__(self):
        self.hashes = []

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return k


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes; hashes of words are kept, in bounded memory."""

    def __init__(self, width: int):
        self.width, self.index, self.hashes = width, WordIndex(), np.empty(0, np.uint64)

    def words(self, text: str | None) -> list[bytes]:
        """A-Z in lower case, cut at the six ASCII white-space characters: exactly what these bytes methods do."""
        return text.encode("utf-8", "surrogatepass").lower().split() if text else []

    def hashed(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > WORD_CACHE:
            self.index, self.hashes = WordIndex(), np.empty(0, np.uint64)
        at = np.array(list(map(self.index.__getitem__, words)), np.int64)
        if self.index.hashes:
            first = len(self.index) - len(self.index.hashes)
            if len(self.index) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes[:first], np.empty(max(1 << 15, 2 * len(self.index)) - first, np.uint64)])
            self.hashes[first : len(self.index)] = self.index.hashes
            self.index.hashes.clear()
        return self.hashes[at]

    def shingles(self, text: str | None) -> np.ndarray:
        words = self.words(text)
        if not words:
            return np.empty(0, np.uint64)
        h = self.hashed(words)
        n = min(self.width, len(h))
        s = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            s *= P
            s += h[k : len(h) - n + 1 + k]
        s = mix(s)
        s.sort()
        return s[np.append(True, s[1:] != s[:-1])]


class Families:
    """Bands of set sizes: for each, the number of groups and how many of them may be empty without being signed."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low, self.shape = num, den, [1], []

    def _grow(self) -> None:
        low = self.low[-1]
        high = max(low, low * self.den * self.den // (self.num * self.num))
        differ = 2 * high * (self.den - self.num) // (self.den + self.num)
        # Tokens of the smallest set that may sign here leave so many groups empty, by chance hardly ever more.
        least, spare = self.num * low // self.den or 1, 0
        while differ and spare < least:
            groups = differ + 1 + spare
            empty = math.exp(-least / groups)
            if spare >= groups * empty + 2 * math.sqrt(groups * empty * (1 - empty)):
                break
            spare += 1 + spare // 16
        self.shape.append((differ + 1 + spare, spare) if differ else None)
        self.low.append(high + 1)

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(band, groups, spare) for every band in which a set of n tokens may be, or have its larger partner."""
        while len(self.shape) < 2 or self.den * n >= self.num * self.low[-1]:
            self._grow()
        return [(k, *shape) for k, shape in enumerate(self.shape) if shape and n < self.low[k + 1] and self.den * n >= self.num * self.low[k]]


def signatures(u: np.ndarray, families: Families) -> np.ndarray:
    out, body = [], mix(u + P)
    for band, groups, spare in families.of(len(u)):
        g = ((u >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        of, sums = g[starts], np.add.reduceat(body, starts)
        if groups - len(of) > spare:
            none = np.setdiff1d(np.arange(groups, dtype=np.uint64), of, assume_unique=True)
            of, sums = np.concatenate([of, none]), np.concatenate([sums, np.zeros(len(none), np.uint64)])
        out.append(mix(sums ^ mix(of + (np.uint64(band) << np.uint64(40)))))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def fingerprint(u: np.ndarray) -> int:
    return int(mix(np.array([np.add.reduce(mix(u ^ P)) + np.uint64(len(u))], np.uint64)).view(np.int64)[0])


def list_array(parts: list[np.ndarray | None], kind) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([0 if p is None else len(p) for p in parts], out=offsets[1:])
    values = np.concatenate([p for p in parts if p is not None] or [np.empty(0, np.int64)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def packed_counts(u: np.ndarray) -> bytes:
    """The point of a set: how many of its tokens fall in each of DIMS groups, as bytes or, where one is over 255, as 32-bit integers."""
    counts = np.bincount((u >> np.uint64(59)).astype(np.int64), minlength=DIMS)
    return counts.astype(np.uint8 if counts.max() <= 255 else np.uint32).tobytes()


def points_of(counts: list[bytes]) -> np.ndarray:
    out = np.empty((len(counts), DIMS), np.int64)
    wide = np.array([len(c) > DIMS for c in counts])
    for kind, rows in ((np.uint8, ~wide), (np.uint32, wide)):
        out[rows] = np.frombuffer(b"".join(c for c, w in zip(counts, rows, strict=True) if w), kind).reshape(-1, DIMS)
    return out


def sketch(u: np.ndarray) -> bytes:
    """Parities of the counts of about 2n to 4n groups, packed: the number of odd groups of A xor B is at most the number of tokens that differ."""
    bits = max(8, int(2 * len(u) - 1).bit_length())
    return np.packbits((np.bincount((u >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).astype(np.uint8)).tobytes()


def _profiles(width: int):
    """id, text to id, n, set: the size of the text's set and its fingerprint; text_hash finds the text again, as an id may stand on several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            n, key = [], []
            for text in batch.column("text").to_pylist():
                u = shingler.shingles(text)
                n.append(len(u))
                key.append(fingerprint(u) if len(u) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(key, pa.int64())], names=["id", "text_hash", "n", "set"])

    return run


def _signed(width: int, num: int, den: int):
    """Texts to rows (signature, set), once for each set in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, families, seen = Shingler(width), Families(num, den), set()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts, SIGNED_CHARS):
                keys, signed = [], []
                for text in texts[a:b]:
                    u = shingler.shingles(text)
                    f = fingerprint(u) if len(u) else None
                    if f is None or f in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(f)
                    keys.append(f)
                    signed.append(signatures(u, families).view(np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(signed)), pa.array(np.repeat(np.array(keys, np.int64), [len(x) for x in signed]))], names=["signature", "set"])

    return run


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (signature, set) in order to those whose signature has several sets, each once."""
    held = None  # the last row so far, and whether a row of its signature is out
    for batch in batches:
        s, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if held:
            s, f = np.append(held[0], s), np.append(held[1], f)
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (f[1:] != f[:-1])
        s, f = s[new], f[new]
        if not len(s):
            continue
        several = np.zeros(len(s), bool)
        several[1:] = s[1:] == s[:-1]
        several[:-1] |= several[1:]
        several[-1] |= bool(held and held[2] and s[-1] == held[0])
        out = several.copy()
        if held and held[2]:
            out[0] = False  # the held row went out with its predecessor
        held = (s[-1], f[-1], several[-1])
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(s[out]), pa.array(f[out])], names=["signature", "set"])


class CountTree:
    """An R-tree over count vectors, packed by sorting on size and on the heaviest coordinates: nodes keep largest counts and smallest sizes."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        self.order = np.lexsort((counts.argmax(axis=1), sizes))
        top, low = counts[self.order], sizes[self.order]
        self.levels = [(top, low)]
        while len(top) > FANOUT:
            cut = np.arange(0, len(top), FANOUT)
            top, low = np.maximum.reduceat(top, cut, axis=0), np.minimum.reduceat(low, cut)
            self.levels.append((top, low))

    def query(self, point: np.ndarray, size: int) -> np.ndarray:
        """Positions of the points whose overlap with this one may be large enough."""
        nodes = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low = self.levels[depth]
            bound = np.minimum(top[nodes], point).sum(axis=1)
            nodes = nodes[(self.den + self.num) * bound >= self.num * (size + low[nodes])]
            if not len(nodes):
                return nodes
            if depth:
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][1])]
        return self.order[nodes]


def folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches folded to width bytes (neighbouring groups merge), as rows of bytes."""
    rows = np.empty((len(sketches), width), np.uint8)
    for k, x in enumerate(sketches):
        bits = np.frombuffer(x, np.uint8)
        if len(bits) > width:
            bits = np.packbits(np.bitwise_xor.reduce(np.unpackbits(bits).reshape(width * 8, -1), axis=1))
        rows[k] = bits
    return rows


def leaf_pairs(group: np.ndarray, parts: np.ndarray, sizes: np.ndarray, points: np.ndarray, sketches: np.ndarray, num: int, den: int) -> list[tuple[int, int, int]]:
    """Trees of one leaf, many at a time: (tokens that differ at least, position, position) of the pairs of one group and different parts that pass both bounds."""
    found = []
    for step in range(1, FANOUT):
        a = np.flatnonzero((group[step:] == group[:-step]) & (parts[step:] != parts[:-step]))
        if not len(a) and not (group[step:] == group[:-step]).any():
            break
        b = a + step
        total = sizes[a] + sizes[b]
        need = -(-num * total // (num + den))
        ok = np.minimum(points[a], points[b]).sum(axis=1) >= need
        a, b, most = a[ok], b[ok], (total - 2 * need)[ok]
        for x, y, m in zip(a.tolist(), b.tolist(), most.tolist(), strict=True):
            pair = folded([sketches[x], sketches[y]], min(len(sketches[x]), len(sketches[y])))
            differ = int(np.bitwise_count(pair[0] ^ pair[1]).sum(dtype=np.int64))
            if differ <= m:
                found.append((differ, x, y))
    return found


def joined_pairs(tree: CountTree, parts: np.ndarray, sizes: np.ndarray, points: np.ndarray, sketches: list[bytes]) -> list[tuple[int, int, int]]:
    """The same for a tree of several leaves, joined with itself: leaves whose boxes can't meet are cut, of the others all points are compared."""
    num, den, order = tree.num, tree.den, tree.order
    words = folded(sketches, min(map(len, sketches)))
    top, low = tree.levels[1] if len(tree.levels) > 1 else (points.max(axis=0)[None], np.array([sizes.min()]))
    found = []
    for x in range(len(low)):
        near = x + np.flatnonzero((den + num) * np.minimum(top[x:], top[x]).sum(axis=1) >= num * (low[x] + low[x:]))
        own, others = order[x * FANOUT : (x + 1) * FANOUT], (near[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        others = others[others < len(order)]
        at, b = np.nonzero(parts[own][:, None] != parts[order[others]])
        ok = others[b] > x * FANOUT + at  # each pair once
        a, b = own[at[ok]], order[others[b[ok]]]
        total = sizes[a] + sizes[b]
        need = -(-num * total // (num + den))
        ok = np.minimum(points[a], points[b]).sum(axis=1) >= need
        a, b, most = a[ok], b[ok], (total - 2 * need)[ok]
        differ = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)
        ok = differ <= most
        found += zip(differ[ok].tolist(), a[ok].tolist(), b[ok].tolist(), strict=True)
    return found


def forests(parts: np.ndarray, pairs: list[tuple[int, int, int]], passes: int) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of positions, and whether some are left: each of `passes` forests takes, nearest first, those of the pairs left that join parts not joined in it before, fewer than there are parts.

    Parts joined in a forest are joined in all before it, so the first that can take a pair is found by halving.
    """
    roots: list[dict[int, int]] = [{}]
    out, more = [], False

    def find(root: dict[int, int], x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for _, a, b in sorted(pairs):
        p, q = int(parts[a]), int(parts[b])
        low, high = 0, len(roots)
        while low < high:
            mid = (low + high) // 2
            if find(roots[mid], p) == find(roots[mid], q):
                low = mid + 1
            else:
                high = mid
        if low == passes:
            more = True
            continue
        if low == len(roots):
            roots.append({})
        x, y = find(roots[low], p), find(roots[low], q)
        roots[low][max(x, y)] = min(x, y)
        out.append((a, b))
    return out, more


def tree_forest(tree: CountTree, parts: np.ndarray, sizes: np.ndarray, points: np.ndarray, sketches: list[bytes]) -> tuple[list[tuple[int, int]], bool]:
    """One forest without a list of all pairs: it grows a point at a time to the nearest, one tree query for each; and whether there may be pairs that it left out."""
    num, den, out, more = tree.num, tree.den, [], False
    words = folded(sketches, min(map(len, sketches)))
    far = np.int64(1) << 60
    key, source, left = np.full(len(parts), far), np.zeros(len(parts), np.int64), np.ones(len(parts), bool)
    for _ in range(len(parts)):
        x = int(np.where(left, key, far + 1).argmin())
        if 0 <= key[x] < far:
            out.append((int(source[x]), x))
        left[x] = False
        key[left & (parts == parts[x])] = -1  # parts are joined already, at no cost
        near = tree.query(points[x], sizes[x])
        near = near[left[near] & (parts[near] != parts[x])]
        if len(near):
            differ = np.bitwise_count(words[near] ^ words[x]).sum(axis=1, dtype=np.int64)
            total = sizes[near] + sizes[x]
            ok = differ <= total - 2 * -(-num * total // (num + den))
            near, differ = near[ok], differ[ok]
            more = more or bool((key[near] < far).any())  # such a pair closes a circle
            ok = differ < key[near]
            key[near[ok]], source[near[ok]] = differ[ok], x
    return out, more


def _trees(num: int, den: int, passes: int):
    """Rows (cell, i, j, set, part, n, counts, sketch) in order of the first three to (cell, a, b, more): pairs of sets of different parts, smaller first, that `passes` forests of each group take, and whether the group has more."""

    def close(rows: list) -> Iterator[pa.RecordBatch]:
        cell, i, j, f, p, n, c, sketches = rows
        new = np.concatenate(([True], (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(cell)))
        group = np.cumsum(new) - 1
        found: list[tuple[int, int, bool]] = []
        small = np.flatnonzero(lengths[group] <= FANOUT)
        if len(small):
            by_group: dict[int, list] = {}
            for differ, a, b in leaf_pairs(group[small], p[small], n[small], points_of(c[small].tolist()), sketches[small], num, den):
                by_group.setdefault(int(group[small[a]]), []).append((differ, int(small[a]), int(small[b])))
            for held in by_group.values():
                edges, more = forests(p, held, passes)
                found += [(a, b, more) for a, b in edges]
        for k in np.flatnonzero(lengths > FANOUT).tolist():
            x, y = int(starts[k]), int(starts[k] + lengths[k])
            if (p[x:y] != p[x]).any():
                args = p[x:y], n[x:y], points_of(c[x:y].tolist()), sketches[x:y].tolist()
                tree = CountTree(args[2], args[1], num, den)
                edges, more = tree_forest(tree, *args) if passes == 1 else forests(args[0], joined_pairs(tree, *args), passes)
                found += [(x + a, x + b, more) for a, b in edges]
        if found:
            a, b, more = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(cell[a]), pa.array(np.minimum(f[a], f[b])), pa.array(np.maximum(f[a], f[b])), pa.array(more.astype(bool))], names=["cell", "a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(k).to_numpy() for k in range(6)]
            for k in (6, 7):
                held = np.empty(batch.num_rows, object)
                held[:] = batch.column(k).to_pylist()
                rows.append(held)
            rest.append(rows)
            whole = [np.concatenate(x) for x in zip(*rest, strict=True)]
            going_on = (whole[0] == whole[0][-1]) & (whole[1] == whole[1][-1]) & (whole[2] == whole[2][-1])
            cut = int(going_on.argmax())  # where the group that may go on begins
            if cut:
                yield from close([x[:cut] for x in whole])
            rest = [[x[cut:] for x in whole]]
        if rest:
            yield from close(rest[0])

    return run


def _sets(width: int):
    """Rows (text, set) to (set, n, counts, sketch, tokens); a text of another set is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("set").to_pylist()
            for a, b in slices(texts, SIGNED_CHARS):
                found = [(k, u) for k, t in zip(keys[a:b], texts[a:b], strict=True) if len(u := shingler.shingles(t)) and fingerprint(u) == k]
                sets = [u for _, u in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in found], pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(packed_counts, sets)), pa.binary()), pa.array(list(map(sketch, sets)), pa.binary()), list_array([u.view(np.int64) for u in sets], pa.int64())],
                    names=["set", "n", "counts", "sketch", "tokens"],
                )

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Edges (a, b) to (node, part): part is the smallest node reachable. Labels spread along edges and jump along labels, so long chains take few rounds."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges")
    if both.isEmpty():
        return both.select(F.col("a").alias("node"), F.col("b").alias("part"))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("part"))
    labels = materialise(labels, f"{name}-0")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("part").alias("heard"))
        step = labels.join(heard, "node").select("node", F.col("part").alias("old"), F.least("part", "heard").alias("part"))
        jump = step.join(labels.select(F.col("node").alias("part"), F.col("part").alias("next")), "part").select("node", "old", F.least("part", "next").alias("part"))
        done = materialise(jump, name)
        labels = done.select("node", "part")
        if done.where("old != part").isEmpty():
            return labels


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, broadcast_pairs: int) -> DataFrame:
    """The pairs (a, b) whose sets link. Up to broadcast_pairs of them go to the sets, so that only sets in pairs shuffle; beyond, pairs and sets shuffle."""
    side = lambda key, name: sets.select(F.col("set").alias(key), F.col("tokens").alias(name))
    if pairs.count() <= broadcast_pairs:
        met = side("a", "ta").join(F.broadcast(pairs), "a").join(side("b", "tb").join(F.broadcast(pairs), "b"), ["a", "b"])
    else:
        met = pairs.join(side("b", "tb"), "b").join(side("a", "ta"), "a")
    met = met.select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("both"), (F.size("ta") + F.size("tb")).alias("total"))
    return met.where(F.col("both") * F.lit(num + den).cast("bigint") >= F.col("total") * F.lit(num).cast("bigint")).select("a", "b")


def fitting(df: DataFrame, limit: int) -> DataFrame:
    """df, a stored table, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= limit else df


def merged(parts: DataFrame, links: DataFrame, name: str, broadcast_parts: int) -> DataFrame:
    """Parts (node, part) with the parts of linked nodes joined; nodes without a part so far are their own."""
    near = fitting(parts, broadcast_parts)
    part = lambda col, as_: near.select(F.col("node").alias(col), F.col("part").alias(as_))
    bridges = links.join(part("a", "p"), "a", "left").join(part("b", "q"), "b", "left").select(F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b"))
    joined = components(bridges, name)
    wider = joined.select(F.col("node").alias("part"), F.col("part").alias("wider"))
    whole = parts.join(wider, "part", "left").select("node", F.coalesce("wider", "part").alias("part"))
    alone = joined.join(parts, "node", "left_anti").select("node", "part")
    return materialise(whole.unionByName(alone), f"{name}-parts")


def in_cells(best: DataFrame, block: int) -> DataFrame:
    """Rows (set, hub), a set's best hub, to (cell, i, j, set, part): the members of a hub's cell and the hub; a cell of more than `block` members is dealt out by their hashes, the hub to all."""
    sizes = best.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = best.join(sizes, "hub").select(F.col("hub").alias("cell"), F.pmod(F.xxhash64("set"), "blocks").cast("int").alias("i"), "set")
    hubs = sizes.select(F.col("hub").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.col("hub").alias("set"))
    return members.unionByName(hubs).select("cell", "i", F.lit(0).alias("j"), "set", F.col("set").alias("part"))


def in_blocks(rows: DataFrame, block: int, broadcast_ids: int) -> DataFrame:
    """Rows (cell, set, part), as stored, to (cell, i, j, set, part), so that each two sets of a cell and of different parts share a group (cell, i, j), which has about 2 * block rows at most.

    A cell of more than `block` rows is cut into blocks: those of its largest part,
    which need not meet each other, and those of the rest, which meet all.
    """
    parts = rows.groupBy("cell", "part").agg(F.count("*").alias("n"))
    cells = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max_by("part", F.struct("n", "part")).alias("big"), F.max("n").alias("most")).where(F.col("n") > block)
    large = materialise(cells.select("cell", "big", F.ceil((F.col("n") - F.col("most")) / block).cast("int").alias("rest"), F.ceil(F.col("most") / block).cast("int").alias("bigs")).where("rest > 0"), "large-cells")
    of = rows.join(fitting(large, broadcast_ids), "cell", "left")
    hash_ = lambda n: F.pmod(F.xxhash64("set"), F.col(n)).cast("int")
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    own, rests = hash_("rest"), F.sequence(F.lit(0), F.col("rest") - 1)
    with_rest = F.transform(F.filter(rests, lambda y: y != own), lambda y: pair(F.least(own, y), F.greatest(own, y)))
    with_big = F.transform(F.sequence(F.lit(0), F.col("bigs") - 1), lambda g: pair(own, F.col("rest") + g))
    to_rest = F.transform(rests, lambda x: pair(x, F.col("rest") + hash_("bigs")))
    at = F.when(F.col("rest").isNull(), F.array(pair(F.lit(0), F.lit(0)))).when(F.col("part") == F.col("big"), to_rest).otherwise(F.concat(with_rest, with_big))
    return of.select("cell", F.explode(at).alias("at"), "set", "part").select("cell", "at.i", "at.j", "set", "part")


def tree_pairs(grouped: DataFrame, points: DataFrame, num: int, den: int, passes: int, name: str) -> DataFrame:
    """Stored pairs (cell, a, b, more) that the trees of all groups (cell, i, j) let through."""
    rows = grouped.join(points, "set").select("cell", "i", "j", "set", "part", "n", "counts", "sketch")
    # The work goes by rows and not by bytes, so partitions must not be put together by their size.
    tasks = int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "set")
    return materialise(mapped(rows, _trees(num, den, passes), "cell bigint, a bigint, b bigint, more boolean"), name)


def once(sets: DataFrame) -> DataFrame:
    """Stored sets, each one time: rows that repeat an id and its text give a set again and again, and links among repeats would grow with their square."""
    again = materialise(sets.groupBy("set").agg(F.count("*").alias("n")).where("n > 1").select("set"), "repeated-sets")
    if again.isEmpty():
        discard(again)
        return sets
    one = sets.join(again, "set", "left_semi").dropDuplicates(["set"])
    out = materialise(sets.join(again, "set", "left_anti").unionByName(one), "sets")
    discard(sets, again)
    return out


def ngram_jaccard_links(docs: DataFrame, wanted: DataFrame, met: DataFrame, best: DataFrame, width: int, num: int, den: int, broadcast_ids: int, block: int) -> DataFrame:
    """Parts (node, part) of all sets that link: rounds of tree queries, verification and merging."""
    small = wanted.count() <= broadcast_ids
    same = docs["id"].eqNullSafe(wanted["first"]) & (docs["text_hash"] == wanted["hash"])
    fetched = docs.join(F.broadcast(wanted) if small else wanted, same).select("set", "text")
    sets = once(materialise(mapped(fetched, _sets(width), "set bigint, n bigint, counts binary, sketch binary, tokens array<bigint>"), "sets"))
    points = materialise(sets.select("set", "n", "counts", "sketch").dropDuplicates(["set"]), "points")

    found = tree_pairs(in_cells(best, block), points, num, den, 1, "cell-pairs")
    links = materialise(_verified(materialise(found.select("a", "b").distinct(), "cell-distinct"), sets, num, den, broadcast_ids), "cell-links")
    parts = components(links, "cells")
    open_, passes = None, 1
    while True:
        near = fitting(parts, broadcast_ids)
        part = lambda col, as_, near=near: near.select(F.col("node").alias(col), F.col("part").alias(as_))
        if open_ is None:
            of = met.join(part("set", "p"), "set", "left").join(part("hub", "q"), "hub", "left").where(F.coalesce("p", "set") != F.coalesce("q", "hub"))
            open_ = materialise(of.select("signature").distinct(), "open")
        rows = met.join(fitting(open_, broadcast_ids), "signature", "left_semi").join(part("set", "p"), "set", "left")
        rows = materialise(rows.select(F.col("signature").alias("cell"), "set", F.coalesce("p", "set").alias("part")), "open-rows")
        found = tree_pairs(in_blocks(rows, block, broadcast_ids), points, num, den, passes, "pairs")
        links = materialise(_verified(materialise(found.select("a", "b").distinct(), "distinct"), sets, num, den, broadcast_ids), "links")
        parts = merged(parts, links, "merged", broadcast_ids)
        # Done is a bucket that gave all it has, or whose pairs all lie within one part each by now; the others give more.
        near = fitting(parts, broadcast_ids)
        of = found.where("more").join(near.select(F.col("node").alias("a"), F.col("part").alias("p")), "a", "left").join(near.select(F.col("node").alias("b"), F.col("part").alias("q")), "b", "left")
        of = of.where(F.coalesce("p", "a") != F.coalesce("q", "b")).select("cell").distinct()
        open_ = materialise(of.select(F.col("cell").alias("signature")), "open")
        discard(rows, found)
        if open_.isEmpty():
            discard(points, sets)
            return parts
        passes *= 64


def placed_rows(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD, broadcast_ids: int = BROADCAST_IDS, block: int = BLOCK) -> DataFrame:
    """One row per document: id, text_hash (xxhash64 of the text), n (the size of its set), component (the smallest id that links reach), and stays: whether it is the document of its component that has this id and, of several such, the smallest hash."""
    num, den = threshold
    docs = documents.select(named(id_col).alias("id"), named(text_col).alias("text"), F.xxhash64(named(text_col)).alias("text_hash"))
    # Texts are cut into shingles three times (for all sizes, all signatures, the sets that meet): cheaper on disk than to store what all of them hold.
    profiles = materialise(mapped(docs, _profiles(width), with_id(docs.schema["id"].dataType, "text_hash bigint, n bigint, set bigint")), "profiles")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash"))
    classes = profiles.where("set is not null").groupBy("set").agg(least.alias("least")).select("set", "least", F.col("least.id").alias("first"), F.col("least.text_hash").alias("hash"))

    signed = mapped(docs.select("text"), _signed(width, num, den), "signature bigint, set bigint")
    pairs = materialise(mapped(signed.repartition("signature").sortWithinPartitions("signature", "set"), _meetings, "signature bigint, set bigint"), "meetings")
    # The hub of a bucket is the member that meets others most often: of copies with edits, the one they were made from.
    ranked = pairs.join(pairs.groupBy("set").agg(F.count("*").alias("degree")), "set")
    hubs = ranked.groupBy("signature").agg(F.max_by("set", F.struct("degree", "set")).alias("hub"))
    met = materialise(pairs.join(hubs, "signature"), "hubs")
    discard(pairs)
    best = met.where("set != hub").groupBy("set", "hub").count().groupBy("set").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))
    best = materialise(best, "best")
    wanted = materialise(classes.drop("least").join(met.select("set").distinct(), "set"), "wanted")
    parts = ngram_jaccard_links(docs, wanted, met, best, width, num, den, broadcast_ids, block)
    discard(met, best, wanted)

    grouped = classes.join(parts.withColumnRenamed("node", "set"), "set")
    smallest = grouped.groupBy("part").agg(F.min("least").alias("stay"))
    of = grouped.join(smallest, "part").select("set", "stay")
    of = materialise(classes.join(of, "set", "left").select("set", F.coalesce("stay", "least").alias("stay")), "placed")
    discard(parts)
    own = F.col("id").eqNullSafe(F.col("stay.id")) & (F.col("text_hash") == F.col("stay.text_hash"))
    known = profiles.where("set is not null").join(of, "set").select("id", "text_hash", "n", F.col("stay.id").alias("component"), own.alias("stays"))
    empty = profiles.where("set is null").select("id", "text_hash", "n", F.col("id").alias("component"), F.lit(True).alias("stays"))
    return known.unionByName(empty)


def ngram_jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD, broadcast_ids: int = BROADCAST_IDS, block: int = BLOCK) -> DataFrame:
    """One row per document: its id, n_shingles and component_id, the smallest id that links reach. threshold is a fraction (numerator, denominator)."""
    placed = placed_rows(documents, id_col, text_col, width, threshold, broadcast_ids, block)
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(list_slice(w, k, k + 3), ' '))) END AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
rare AS (SELECT t FROM tokens GROUP BY t HAVING count(*) > 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN rare USING (t) JOIN tokens b USING (t)
          WHERE a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""
