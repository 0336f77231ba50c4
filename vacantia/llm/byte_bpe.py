"""Byte-level BPE from a rank file: encoding that reproduces the merges in linear time, and decoding.

Bytes are mapped to the characters of the same number (Latin-1), so pyahocorasick
finds the longest token at a position. A match is taken if it may stand next to
the token before it, that is, if the merges would not have joined or cut them
otherwise; else the next shorter token is tried, and where none fits the last
token is given back. Whether two tokens may be neighbours follows from their
last merges and is memoised. A position given up is never tried again, so the
work is linear in the text.

A piece (a match of the splitting pattern) that is a token itself is that token,
as in the public library. Defined results: null is the empty text; it has no ids
and decodes to no bytes; repeated rows each get a row; an empty table gives an
empty table; columns that aren't asked for are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import text_batches, tune_arrow

#: Pieces whose ids a worker remembers; then they become the earlier ones, of which those met again are taken over.
REMEMBERED = 250_000
#: Longer pieces are not remembered.
LONG_PIECE = 64
#: Pairs of tokens whose compatibility a worker remembers.
PAIRS = 500_000


@dataclass
class Vocabulary:
    """Tokens by rank, and the two tokens each was merged from (itself twice for what no merge makes or splits)."""

    tokens: list[bytes]
    ids: list[int]
    left: list[int]
    right: list[int]
    merged: list[bool]
    shorter: list[int]  # the longest token that is a proper beginning, or -1


def merge_order(piece: bytes, ranks: dict[bytes, int], stop: int = 1) -> list[bytes]:
    """Parts of a piece after merging the lowest-ranked neighbours first, until ``stop`` parts or no merge is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > stop:
        found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not found:
            break
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def read_vocabulary(path: str) -> Vocabulary:
    """The rank file: a line per token, its bytes in base64 and its rank."""
    ranks: dict[bytes, int] = {}
    with open(path, "rb") as file:
        for line in file:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    tokens = sorted(ranks, key=ranks.__getitem__)
    place = {t: i for i, t in enumerate(tokens)}
    left, right, merged = list(range(len(tokens))), list(range(len(tokens))), [True] * len(tokens)
    for i, token in enumerate(tokens):
        if len(token) > 1:
            parts = merge_order(token, ranks, stop=2)
            if len(parts) == 2 and parts[0] + parts[1] in ranks:
                left[i], right[i] = place[parts[0]], place[parts[1]]
            else:
                merged[i] = False  # a token that merges never make
    made = {t: i for t, i in place.items() if merged[i]}
    shorter = [next((made[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in made), -1) for t in tokens]
    return Vocabulary(tokens, [ranks[t] for t in tokens], left, right, merged, shorter)


class Codec:
    """Pieces (text) to their ids as little-endian 32-bit bytes, worked out when first met."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        v = vocabulary
        self.v = v
        self.whole = {t: i for i, t in enumerate(v.tokens)}
        self.length = [len(t) for t in v.tokens]
        self.widest = max(self.length, default=1)
        self.pair = {(v.left[i], v.right[i]): i for i, t in enumerate(v.tokens) if len(t) > 1 and v.merged[i]}
        self.auto = ahocorasick.Automaton()
        for i, t in enumerate(v.tokens):
            if v.merged[i]:
                self.auto.add_word(t.decode("latin-1"), i)
        self.auto.make_automaton()
        self.fits: dict[int, bool] = {}
        self.wide = len(v.tokens)
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.code = [struct.pack("<I", i) for i in v.ids]
        self.by_id = dict(zip(v.ids, v.tokens))

    def new(self, piece: str) -> bytes:
        """Ids of a piece that isn't known, or not any more."""
        out = self.earlier.get(piece)
        if out is None:
            data = piece.encode()
            at = self.whole.get(data)
            out = self.code[at] if at is not None else b"".join([self.code[i] for i in self.split(data)])
        if len(piece) <= LONG_PIECE:
            if len(self.known) >= REMEMBERED:
                self.earlier, self.known = self.known, {}
            self.known[piece] = out
        return out

    def compatible(self, first: int, second: int) -> bool:
        """Whether the merges leave these two tokens as neighbours."""
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        known = self.fits[first * self.wide + second] = self._stays(first, second)
        return known

    def _stays(self, a: int, b: int) -> bool:
        """Undo the merges of both sides, latest first: no pair across the border may merge before what follows it."""
        left, right, pair = self.v.left, self.v.right, self.pair
        before = len(left)  # merges of this rank and later happen after the border was last seen with a and b
        while True:
            joined = pair.get((a, b))
            if joined is not None and joined < before:
                return False
            a_splits, b_splits = right[a] != a, left[b] != b
            if not a_splits and not b_splits:
                return True
            # of two equal ranks the left one merges first, so the right side is undone first
            if a_splits and (not b_splits or a > b):
                before, a = a, right[a]
            else:
                before, b = b + 1, left[b]

    def split(self, data: bytes) -> list[int]:
        """Tokens of a piece, by places in the vocabulary."""
        text, size = data.decode("latin-1"), len(data)
        length, shorter, longest, fits, wide, widest = self.length, self.v.shorter, self.auto.iter_long, self.fits, self.wide, self.widest
        dead: set[int] = set()
        taken = []
        for _, token in longest(text):  # as long as the longest matches may stand side by side, nothing else is needed
            if taken:
                pair = taken[-1] * wide + token
                if not (fits[pair] if pair in fits else self.compatible(taken[-1], token)):
                    break
            taken.append(token)
        else:
            return taken
        last = taken[-1]
        at = sum([length[t] for t in taken])
        token = shorter[token]
        while True:
            if token < 0:
                dead.add(at)
                token = taken.pop()
                at -= length[token]
                last = taken[-1] if taken else -1
                token = shorter[token]
                continue
            end = at + length[token]
            if end not in dead:
                if last < 0:
                    ok = True
                else:
                    pair = last * wide + token
                    ok = fits[pair] if pair in fits else self.compatible(last, token)
                if ok:
                    taken.append(token)
                    if end == size:
                        return taken
                    at, last = end, token
                    token = next(longest(text[at : at + widest]))[1]  # no match is longer, and the rest is not looked at
                    continue
            token = shorter[token]

    def encode(self, pieces: list[str]) -> bytes:
        found = list(map(self.known.get, pieces))
        if None in found:
            for i, code in enumerate(found):
                if code is None:
                    found[i] = self.known.get(pieces[i]) or self.new(pieces[i])
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, Codec] = {}


def codec_of(key: str, vocabulary) -> Codec:
    """One codec a worker and vocabulary."""
    if key not in _codecs:
        _codecs[key] = Codec(vocabulary.value)
    return _codecs[key]


def splitter(pattern: str):
    r"""The pattern as the public library reads it: \s is Unicode white space."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def recoded(key: str, vocabulary, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, cut = codec_of(key, vocabulary), splitter(pattern)
        for batch in text_batches(batches):
            sizes, ids_digest, text_digest, ids = [], [], [], []
            for text in batch.column("text").to_pylist():
                code = codec.encode(cut.findall(text or ""))
                sizes.append(len(code) // 4)
                ids_digest.append(hashlib.sha256(code).hexdigest())
                text_digest.append(hashlib.sha256(codec.decode(code)).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(code, "<u4").astype(np.int32))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids_digest), pa.array(text_digest)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(columns, names=names)

    return run


def encoded(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every whole text.

    The file is read once on the driver, with the merges every token comes from;
    its size is that of the vocabulary. ``ids_sha256`` is over the ids as
    little-endian unsigned 32-bit integers, ``decoded_sha256`` over the bytes the
    ids decode to.
    """
    spark = tune_arrow(docs.sparkSession)
    shared = spark.sparkContext.broadcast(read_vocabulary(ranks_path))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(recoded(ranks_path, shared, pattern, with_ids), schema)


def decode_batches(key: str, vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(key, vocabulary)
        for batch in batches:
            texts = [codec.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    return run


def decoded(rows: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes) of every list of ids; null is the empty list."""
    shared = tune_arrow(rows.sparkSession).sparkContext.broadcast(read_vocabulary(ranks_path))
    out = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<bigint>").alias("ids"))
    kind = dict(out.dtypes)["doc_id"]
    return out.mapInArrow(decode_batches(ranks_path, shared), f"doc_id {kind}, bytes binary")
