"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so the Jaccard similarity of an item
and a whole document says little. Items are therefore put in classes by the
number of their word shingles, and every document is cut, per class, into
overlapping windows as long as twice the class's largest item. An item that lies
in a document lies in one window whole, and a containment threshold becomes a
Jaccard bound that holds for the class; the bound gives the number of minima at
which a miss is rarer than MISS. A window that shares a minimum with an item
makes the pair (document, item) a candidate, and candidates are verified by the
exact containment of the item's shingles, compared as words, in the document.

Words are lower-cased (A-Z) and cut at ASCII blanks; a shingle is five words; an
item of one to four words is one shingle of that many words and is compared with
the document's shingles of that width. Defined results: null or empty texts and
items match nothing; repeated rows are matched each; empty tables give an empty
table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import binaries, folded_words, minima, multipliers, ranked, shingle_hashes, text_batches, tune_arrow, word_hashes
from vacantia.session import settled

WIDTH = 5
#: Items whose shingle counts differ by at most this factor share a class.
CLASS_RATIO = 2.0
#: Probability that an item at the threshold shares no minimum with its window.
MISS = 1e-4
#: Items searched in one pass over the documents. The benchmark is taken in blocks of this many.
BLOCK_ITEMS = 20_000
#: Words of all items of a block at most, so that a block fits a worker.
BLOCK_WORDS = 4_000_000
SEED = 20_240_601
PAIR_SCHEMA = "doc_id bigint, item_id bigint, n_shared bigint, n_item bigint, containment double"


@dataclass
class Group:
    """Items of one width and size class, ready to be looked up."""

    width: int
    window: int
    factors: np.ndarray
    offsets: np.ndarray
    values: np.ndarray  # sorted minima of all permutations, mixed with the permutation's number
    owners: np.ndarray  # the item of each
    sieve: np.ndarray  # which low bits occur among the values


@dataclass
class Block:
    ids: list[int]
    shingles: list[set[tuple[bytes, ...]]]
    widths: list[int]
    groups: list[Group]


def item_shingles(text: bytes | None, width: int) -> set[tuple[bytes, ...]]:
    words = folded_words(text)
    size = min(width, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


def permutations_needed(least: int, window: int, threshold: float) -> int:
    """Minima at which an item of ``least`` shingles, contained to ``threshold``, is missed with probability MISS."""
    shared = threshold * least
    jaccard = shared / (window + least - shared)
    return max(8, math.ceil(math.log(MISS) / math.log1p(-min(jaccard, 0.999999))))


def build_block(rows: list[tuple[int, bytes | None]], threshold: float, width: int) -> Block:
    rows = [(i, text) for i, text in rows if i is not None and folded_words(text)]
    block = Block([i for i, _ in rows], [item_shingles(t, width) for _, t in rows], [min(width, len(folded_words(t))) for _, t in rows], [])
    classes: dict[tuple[int, int], list[int]] = {}
    for k, shingles in enumerate(block.shingles):
        size = int(math.log(len(shingles)) / math.log(CLASS_RATIO) + 1e-9)
        classes.setdefault((block.widths[k], size), []).append(k)
    for (w, _), members in sorted(classes.items()):
        hashes = [np.unique(shingle_hashes(word_hashes(folded_words(rows[k][1])), w)) for k in members]
        longest = max(len(folded_words(rows[k][1])) - w + 1 for k in members)
        window = 2 * longest
        factors, offsets = multipliers(permutations_needed(min(map(len, hashes)), window, threshold), SEED)
        starts = np.cumsum([0] + [len(h) for h in hashes[:-1]])
        found = tagged(minima(np.concatenate(hashes), starts, factors, offsets))
        owners = np.broadcast_to(np.array(members), found.shape).ravel()
        order = np.argsort(found.ravel(), kind="stable")
        values = found.ravel()[order]
        sieve = np.zeros(1 << max(12, (8 * len(values)).bit_length()), bool)
        sieve[values & np.uint64(len(sieve) - 1)] = True
        block.groups.append(Group(w, window, factors, offsets, values, owners[order], sieve))
    return block


def tagged(found: np.ndarray) -> np.ndarray:
    """Minima told apart by permutation, so that one sorted list serves all."""
    return found ^ (np.arange(len(found), dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93))


def window_minima(shingles: np.ndarray, lengths: np.ndarray, group: Group) -> tuple[np.ndarray, np.ndarray]:
    """Minima of the windows of several documents, and the document of each window.

    Windows of ``window`` shingles start at every half of one. The halves are
    reduced first and joined to windows pairwise, so no shingle is hashed twice.
    """
    half = group.window // 2
    halves = -(-lengths // half)
    doc = np.repeat(np.arange(len(lengths)), halves)
    first = np.cumsum(halves) - halves
    begin = np.cumsum(lengths) - lengths
    starts = begin[doc] + (np.arange(len(doc)) - first[doc]) * half
    low = minima(shingles, starts, group.factors, group.offsets)
    inner = doc[1:] == doc[:-1]
    joined = np.minimum(low[:, :-1], low[:, 1:])[:, inner]
    alone = halves[doc] == 1
    return np.concatenate([joined, low[:, alone]], axis=1), np.concatenate([doc[:-1][inner], doc[alone]])


def candidates(shingles: np.ndarray, lengths: np.ndarray, group: Group) -> set[tuple[int, int]]:
    """(document, item) pairs of which a window and the item share a minimum."""
    found, doc = window_minima(shingles, lengths, group)
    found = tagged(found)
    perm, window = np.nonzero(group.sieve[found & np.uint64(len(group.sieve) - 1)])
    found = found[perm, window]
    begin = np.searchsorted(group.values, found)
    end = np.searchsorted(group.values, found, side="right")
    pairs = set()
    for i in np.flatnonzero(end > begin).tolist():
        pairs.update((int(doc[window[i]]), k) for k in group.owners[begin[i] : end[i]].tolist())
    return pairs


def search(block, threshold: float):
    """Arrow function: documents in, verified (document, item) pairs out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.value
        for batch in text_batches(batches):
            ids = batch.column("doc_id").to_pylist()
            texts = binaries(batch.column("text"))
            words = [folded_words(t) for t in texts]
            hashes = [word_hashes(w) for w in words]
            pairs: set[tuple[int, int]] = set()
            for width in sorted({g.width for g in items.groups}):
                full = [d for d, h in enumerate(hashes) if len(h) >= width]
                if not full:
                    continue
                cut = [shingle_hashes(hashes[d], width) for d in full]
                lengths = np.array([len(c) for c in cut])
                joined = np.concatenate(cut)
                for group in items.groups:
                    if group.width == width:
                        pairs.update((full[d], k) for d, k in candidates(joined, lengths, group))
            rows = [[], [], [], [], []]
            own: dict[tuple[int, int], set] = {}
            for d, k in sorted(pairs):
                width = items.widths[k]
                if (d, width) not in own:
                    own = {(d, width): {tuple(words[d][i : i + width]) for i in range(len(words[d]) - width + 1)}}
                shared, size = len(items.shingles[k] & own[(d, width)]), len(items.shingles[k])
                if shared >= threshold * size - 1e-9:
                    for column, value in zip(rows, (ids[d], items.ids[k], shared, size, shared / size)):
                        column.append(value)
            kinds = [pa.int64()] * 4 + [pa.float64()]
            names = ["doc_id", "item_id", "n_shared", "n_item", "containment"]
            yield pa.record_batch([pa.array(r, k) for r, k in zip(rows, kinds)], names=names)

    return run


def contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = WIDTH,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for all pairs with containment of at least ``threshold``.

    The items are the stated queries and are taken in blocks of bounded size,
    one pass over the documents per block; only a block is sent to the
    executors. A document is handled whole inside its batch, and nothing is
    shuffled.
    """
    spark = tune_arrow(docs.sparkSession)
    stream = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    queries = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    out = spark.createDataFrame([], PAIR_SCHEMA)
    for rows in item_blocks(queries):
        block = build_block(rows, threshold, width)
        if block.groups:
            shared = spark.sparkContext.broadcast(block)  # at most BLOCK_ITEMS items or BLOCK_WORDS words and one item
            out = out.unionByName(stream.mapInArrow(search(shared, threshold), PAIR_SCHEMA))
    return out


def item_blocks(queries: DataFrame) -> Iterator[list[tuple[int, bytes | None]]]:
    """Distinct items in blocks of bounded rows and words."""
    distinct = queries.filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    words = F.size(F.split("text", r"\s+"))
    size = distinct.agg(F.count(F.lit(1)), F.sum(words)).first()
    if size[0] <= BLOCK_ITEMS and (size[1] or 0) <= BLOCK_WORDS:
        if size[0]:
            yield [(r[0], r[1].encode()) for r in distinct.collect()]
        return
    per_block = max(1, min(BLOCK_ITEMS, int(size[0] * BLOCK_WORDS / size[1])))
    order = [F.col("item_id"), F.col("text")]
    placed = settled(ranked(distinct, order, "_at").withColumn("_block", F.floor(F.col("_at") / per_block)), "items")
    for n in range(-(-size[0] // per_block)):
        yield [(r[0], r[1].encode()) for r in placed.filter(F.col("_block") == n).select("item_id", "text").collect()]
