"""Exact BPE encoding by per-prefix dynamic programming, and decoding (operator 7).

A piece of text is encoded left to right. For every prefix there is exactly one
token that can end its encoding, so one token a prefix is all that is stored: a
suffix automaton over the vocabulary reports the tokens that end at a position,
and of these the one is right that is compatible with the token stored for what
stands before it. Two tokens are compatible when no merge crosses their border
before both are formed. Back-pointers (token lengths) then give the ids.

The work for a piece is linear in its length times the longest token, so a very
long word costs what its length says. Encoded pieces are kept in a bounded
cache, and so are answers on pairs.

Null and empty texts have no ids and decode to the empty text. Added tokens of
the vocabulary file (such as an end-of-text mark) are cut out of the text before
its pieces are formed, as the tokenizers library does by default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamledger.llm.common import FORGET, mapped, slices, table

#: Fixed value: the split pattern of byte-level BPE vocabularies.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
PIECE_CACHE = 150_000
PAIR_CACHE = 200_000
#: Longer pieces are not kept.
CACHED_CHARS = 64


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write the 256 bytes: printable ones stand for themselves, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Recent:
    """Answers in two halves: when the new one is full it takes the place of the old one, so what is asked for again and again stays."""

    __slots__ = ("half", "new", "old")

    def __init__(self, limit: int):
        self.half, self.new, self.old = limit // 2, {}, {}

    def older(self, key):
        """The answer in the old half, which is new again by that; None if there is none."""
        found = self.old.get(key)
        if found is not None:
            self.keep(key, found)
        return found

    def keep(self, key, answer) -> None:
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = answer


class Vocabulary:
    """Tokens are numbered by their merges: bytes first, then merge k makes token 256 + k. `ids` has the file's id of each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        raw = lambda token: bytes(letters[c] for c in token)
        spelled = {bytes([b]): b for b in range(256)}
        self.bytes: list[bytes] = [bytes([b]) for b in range(256)]
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.pairs: dict[int, int] = {}
        names: list[str] = [""] * 256
        for letter, b in letters.items():
            names[b] = letter
        for merge in merges:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = spelled[raw(left)], spelled[raw(right)]
            made = self.bytes[a] + self.bytes[b]
            token = spelled.setdefault(made, len(self.bytes))
            if token == len(self.bytes):
                self.bytes.append(made)
                self.halves.append((a, b))
                names.append(left + right)
            self.pairs[a << 32 | b] = token
        self.ids = [vocab[n] for n in names]
        self.packed = [i.to_bytes(4, "little") for i in self.ids]
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.text_of = {i: b for i, b in zip(self.ids, self.bytes, strict=True)} | {i: c.encode() for c, i in self.added.items()}
        self.suffixes = ahocorasick.Automaton()
        for token, b in enumerate(self.bytes):
            if token < 256 or self.compatible(*self.halves[token], made=token):
                self.suffixes.add_word(b.decode("latin-1"), token)
        self.suffixes.make_automaton()
        self.lengths = [len(b) for b in self.bytes]
        self.kept, self.borders = Recent(PIECE_CACHE), Recent(PAIR_CACHE)

    def compatible(self, a: int, b: int, made: int | None = None) -> bool:
        """Whether a and b stay apart when their bytes are encoded together (made: whether nothing earlier than that merge crosses)."""
        bound = len(self.bytes) if made is None else made
        while True:
            across = self.pairs.get(a << 32 | b)
            if across is not None and across < bound:
                return False
            # Go back in time: take apart whichever of the two was formed later, on its side of the border.
            if a > b:
                if a >= 256:
                    bound, a = a, self.halves[a][1]
                    continue
            elif b >= 256:
                bound, b = b + 1, self.halves[b][0]
                continue
            return True

    def encode_piece(self, piece: str) -> bytes:
        s = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        last = [-1] * (len(s) + 1)
        lengths, borders = self.lengths, self.borders
        for end, token in self.suffixes.iter(s):
            if last[end + 1] < 0:
                start = end + 1 - lengths[token]
                if start:
                    key = last[start] << 32 | token
                    fits = borders.new.get(key)
                    if fits is None:
                        fits = borders.older(key)
                        if fits is None:
                            fits = self.compatible(last[start], token)
                            borders.keep(key, fits)
                    if not fits:
                        continue
                last[end + 1] = token
        out, at = [], len(s)
        while at:
            out.append(self.packed[last[at]])
            at -= lengths[last[at]]
        return b"".join(reversed(out))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.split is None or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(self.added[p].to_bytes(4, "little") if k % 2 else self._plain(p) for k, p in enumerate(self.split.split(text)))

    def _plain(self, text: str) -> bytes:
        kept, out = self.kept, []
        for piece in PIECES.findall(text):
            ids = kept.new.get(piece)
            if ids is None:
                ids = kept.older(piece)
                if ids is None:
                    ids = self.encode_piece(piece)
                    if len(piece) <= CACHED_CHARS:
                        kept.keep(piece, ids)
            out.append(ids)
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.text_of.__getitem__, memoryview(packed).cast("I").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


FORGET[__name__] = vocabulary.cache_clear


def encode_decode(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """One row per document: its id, ids (binary: little-endian unsigned 32-bit integers), n_tokens, and decoded, the text that these ids give."""
    schema = pa.schema([("id", pa.null()), ("ids", pa.binary()), ("decoded", pa.string())])
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(tokenizer)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                ids = [v.encode(t) for t in texts[a:b]]
                text = [v.decode(x) for x in ids] if decode else [None] * len(ids)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(ids, pa.binary()), pa.array(text, pa.string())], names=schema.names)

    out = mapped(docs, run, f"id {documents.schema[id_col].dataType.simpleString()}, ids binary, decoded string")
    return out.select(F.col("id").alias(id_col), "ids", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), "decoded")


def op7_bpe_encoding(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    out = encode_decode(table(spark, sf_dir, "documents"), tokenizer)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
