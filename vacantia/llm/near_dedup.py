"""Near-duplicate documents by b-bit MinHash.

Every document is sketched once: MINIMA minima of its set of word shingles give
BANDS band keys, and the low BITS bits of the minima are packed into bit planes.
Documents that share a band key form a bucket; inside a bucket the similarity of
pairs is estimated from bit counts of the planes, corrected for bits that agree by
chance. Pairs whose estimate and sizes may reach the threshold are candidates, and
what candidates connect is a group. Only documents of groups are read again, and
their pairs are confirmed on the full sets.

Documents with the same words are one class with one representative before
anything is compared, and buckets with the same members are one bucket. A bucket is
cut into parts of about PART sketches, a group of candidates into blocks of BLOCK
documents, and both are worked off as pairs of these, so their size sets the number
of tasks and never the size of one; a task hands out links that span its connected
documents, not all pairs.

Words are lower-cased (A-Z) and cut at ASCII blanks. Defined results: a null or
empty text has no shingles and links with nothing; a text shorter than a shingle
is one shingle; rows that share a doc_id count as one document, so their classes
are joined; a null doc_id gets a null component and is kept; an empty table
gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import (
    binaries, components, folded_words, forest, minima, mixed, multipliers, ranked, root, shingle_hashes, shingle_set, text_batches,
    tune_arrow, word_hashes,
)
from vacantia.session import settled

WIDTH = 5
#: 24 bands of 4 rows miss a pair of similarity 0.85 with probability 2e-8, one of 0.8 with 4e-6.
BANDS, ROWS = 24, 4
MINIMA = BANDS * ROWS
BITS = 4
#: Standard errors an estimate may lie below the threshold before the pair is dropped.
MARGIN = 5.0
#: Documents of a block; a task holds the texts of two blocks.
BLOCK = 128
#: Sketches of a part of a bucket.
PART = 512
SEED = 7_001
SKETCH_SCHEMA = "doc_id bigint, class binary, n_shingles bigint, bands array<bigint>, planes binary"


def packed(low: np.ndarray) -> np.ndarray:
    """Bit planes of the low BITS bits of minima (documents, MINIMA): plane after plane, 8 minima a byte."""
    planes = [np.packbits((low >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1) for b in range(BITS)]
    return np.concatenate(planes, axis=1)


def estimated(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity estimates of all rows of ``left`` with all rows of ``right``, chance collisions taken out."""
    left, right = (np.ascontiguousarray(x).view(np.uint32) for x in (left, right))
    differ = np.zeros((len(left), len(right), MINIMA // 32), np.uint32)
    for b in range(BITS):
        cut = slice(b * MINIMA // 32, (b + 1) * MINIMA // 32)
        differ |= left[:, None, cut] ^ right[None, :, cut]
    equal = 1 - np.bitwise_count(differ).sum(axis=2, dtype=np.int64) / MINIMA
    chance = 0.5**BITS
    return (equal - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    """Estimates below this are MARGIN standard errors short of the threshold."""
    chance = 0.5**BITS
    equal = chance + (1 - chance) * threshold
    return threshold - MARGIN * math.sqrt(equal * (1 - equal) / MINIMA) / (1 - chance)


def word_digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def sketch(width: int):
    factors, offsets = multipliers(MINIMA, SEED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            words = [folded_words(t) for t in binaries(batch.column("text"))]
            sets = [np.unique(shingle_hashes(word_hashes(w), width)) for w in words]
            sizes = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(sizes)
            bands, planes = [[] for _ in sets], [b""] * len(sets)
            if len(some):
                starts = np.cumsum(sizes[some]) - sizes[some]
                low = mixed(minima(np.concatenate(sets), starts, factors, offsets)).T
                keys = np.zeros((len(some), BANDS), np.uint64)
                for r in range(ROWS):
                    keys = mixed(keys + low[:, r::ROWS])
                keys = mixed(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                rows = packed(low)
                for i, at in enumerate(some.tolist()):
                    bands[at], planes[at] = keys[i], rows[i].tobytes()
            classes = [word_digest(w) if w else None for w in words]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(classes, pa.binary()), pa.array(sizes), pa.array(bands, pa.list_(pa.int64())), pa.array(planes, pa.binary())],
                names=["doc_id", "class", "n_shingles", "bands", "planes"],
            )

    return run


def overlapping(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """100 * |intersection| >= percent * |union| for sorted distinct hashes."""
    both = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * both >= percent * (len(left) + len(right) - both)


def candidates(left: np.ndarray, right: np.ndarray, sizes_left: np.ndarray, sizes_right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of all rows of ``left`` with all of ``right``, and which pairs may reach the threshold by estimate and sizes."""
    guess = estimated(left, right)
    small = np.minimum(sizes_left[:, None], sizes_right[None, :])
    large = np.maximum(sizes_left[:, None], sizes_right[None, :])
    return guess, (guess >= least_estimate(percent / 100)) & (100 * small >= percent * large)


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a forest that spans what a symmetric matrix connects; every row is looked at once."""
    free, edges = np.ones(len(near), bool), []
    for start in np.flatnonzero(near.any(axis=1)).tolist():
        if not free[start]:
            continue
        free[start], todo = False, [start]
        while todo:
            at = todo.pop()
            new = np.flatnonzero(near[at] & free).tolist()
            free[new] = False
            edges.extend((at, k) for k in new)
            todo.extend(new)
    return edges


def part_links(ids: np.ndarray, side: np.ndarray, sizes: np.ndarray, planes: np.ndarray, same: bool, percent: int) -> list[tuple[int, int]]:
    """Links that span the candidates of a pair of parts of a bucket, or of one part with itself."""
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return []
    near = np.zeros((len(ids), len(ids)), bool)
    near[np.ix_(left, right)] = candidates(planes[left], planes[right], sizes[left], sizes[right], percent)[1]
    near |= near.T
    np.fill_diagonal(near, False)
    return [(int(ids[a]), int(ids[b])) for a, b in spanning(near)]


def bucket_links(percent: int):
    """Arrow function over rows sorted by bucket and pair of parts."""

    def finished(key: tuple, held: list[tuple]) -> list[tuple[int, int]]:
        ids, side, sizes, planes = (np.concatenate(x) for x in zip(*held))
        return part_links(ids, side, sizes, planes, key[1] == key[2], percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(n).to_numpy() for n in ("band", "x", "y")], axis=1)
            columns = [batch.column(n).to_numpy() for n in ("doc_id", "side", "n_shingles")]
            columns.append(np.frombuffer(b"".join(batch.column("planes").to_pylist()), np.uint8).reshape(batch.num_rows, -1))
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            links = []
            for a, b in zip(starts, starts[1:]):
                now = tuple(keys[a].tolist())
                if now != key:
                    links += finished(key, held) if held else []
                    key, held = now, []
                held.append(tuple(c[a:b] for c in columns))
            yield linked(links)
        yield linked(finished(key, held) if held else [])

    return run


def block_links(rows: list[tuple], percent: int, width: int) -> list[tuple[int, int]]:
    """Links that span the connected documents of a pair of blocks (or of one block with itself).

    ``rows`` holds (side, doc_id, n_shingles, planes, text). Candidates come by
    falling estimate, and a pair that is already connected is not confirmed again.
    """
    left = [i for i, r in enumerate(rows) if r[0] == 0]
    right = [i for i, r in enumerate(rows) if r[0] == 1] or left
    sizes = np.array([r[2] for r in rows])
    planes = np.array([np.frombuffer(r[3], np.uint8) for r in rows])
    guess, may = candidates(planes[left], planes[right], sizes[left], sizes[right], percent)
    if right is left:
        may = np.triu(may, 1)
    a, b = np.nonzero(may)
    order = np.argsort(-guess[a, b], kind="stable")
    parent, sets, links = list(range(len(rows))), {}, []
    for i, j in zip(np.array(left)[a[order]].tolist(), np.array(right)[b[order]].tolist()):
        x, y = root(parent, i), root(parent, j)
        if x == y:
            continue
        for k in (i, j):
            if k not in sets:
                sets[k] = shingle_set(rows[k][4], width)
        if overlapping(sets[i], sets[j], percent):
            parent[y] = x
            links.append((rows[i][1], rows[j][1]))
    return links


def confirm(percent: int, width: int):
    """Arrow function over rows sorted by the pair of blocks, the side and the doc_id.

    Of rows that share a doc_id only one with the words of the class is taken.
    """
    names = ("comp", "block_a", "block_b", "side", "doc_id", "n_shingles", "planes", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in names]
            for comp, x, y, *row, words, text in zip(*columns, binaries(batch.column("text"))):
                if (comp, x, y) != key:
                    yield linked(block_links(rows, percent, width)) if rows else linked([])
                    key, rows = (comp, x, y), []
                again = rows and rows[-1][:2] == tuple(row[:2])
                if not again and word_digest(folded_words(text)) == words:
                    rows.append((*row, text))
        yield linked(block_links(rows, percent, width)) if rows else linked([])

    return run


def linked(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def near_duplicates(
    docs: DataFrame, percent: int = 80, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents joined by chains of pairs with Jaccard similarity >= percent / 100.

    ``component_id`` is the smallest doc_id of the chain, ``kept`` marks it.
    """
    spark = tune_arrow(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = settled(rows.mapInArrow(sketch(width), SKETCH_SCHEMA), "sketches")
    with_id = sketches.filter("doc_id IS NOT NULL")

    classes = with_id.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("rep"))
    member = with_id.select("doc_id", "n_shingles", "class").distinct().join(classes, "class", "left")
    members = settled(member.select("doc_id", "n_shingles", "class", F.coalesce("rep", "doc_id").alias("rep")), "members")
    reps = with_id.join(members.filter("doc_id = rep AND class IS NOT NULL").select("doc_id", "class").distinct(), ["doc_id", "class"])
    reps = settled(reps.dropDuplicates(["class"]), "reps")

    groups = candidate_groups(reps, percent)
    links = confirmed_links(rows, reps.join(groups, reps.doc_id == groups.node).drop("node"), percent, width)
    same_id = members.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(links.unionByName(same_id), "near")
    found = members.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    out = found.join(roots, found.doc_id == roots.node, "left")
    by_id = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    spans = rows.select("doc_id").filter("doc_id IS NOT NULL").join(by_id, "doc_id")
    nulls = sketches.filter("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    result = spans.unionByName(nulls)
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def candidate_groups(reps: DataFrame, percent: int) -> DataFrame:
    """(node, component) of documents that are connected by candidates: a shared band key, and an estimate and sizes that may reach the threshold."""
    tagged = reps.select(F.xxhash64("class").alias("tag"), "doc_id", "n_shingles", "planes", "bands")
    keys = tagged.select("tag", F.explode("bands").alias("band"))
    sizes = keys.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.min("tag").alias("low"), F.max("tag").alias("high"), F.bit_xor(F.xxhash64("tag")).alias("mix"),
    )
    distinct = sizes.filter("n > 1").groupBy("n", "low", "high", "mix").agg(F.min("band").alias("band"))
    parts = F.ceil(F.col("n") / PART).cast("int")
    buckets = settled(distinct.select("band", parts.alias("parts")), "buckets")  # bare sides: AQE can split a hot band
    members = settled(keys.join(buckets, "band"), "members-of-buckets")
    rows = members.join(tagged.select("tag", "doc_id", "n_shingles", "planes"), "tag")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("tag", "band"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = [F.col("band"), F.least("part", "other").cast("bigint").alias("x"), F.greatest("part", "other").cast("bigint").alias("y")]
    sides = rows.select(*pair, F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"), "doc_id", "n_shingles", "planes")
    dealt = sides.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
    return components(dealt.mapInArrow(bucket_links(percent), "a bigint, b bigint"), "groups")


def confirmed_links(texts: DataFrame, grouped: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) inside the groups, confirmed on the full sets, enough to span what is connected."""
    order = [F.col("component"), F.col("n_shingles"), F.col("doc_id")]
    placed = ranked(grouped.select("component", "doc_id", "class", "n_shingles", "planes"), order, "at")
    first = settled(placed.groupBy("component").agg(F.min("at").alias("first")), "firsts")
    blocks = placed.join(first, "component").withColumn("block", F.floor((F.col("at") - F.col("first")) / BLOCK))
    blocks = settled(blocks.drop("at", "first"), "blocks")
    spans = blocks.groupBy("component", "block").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    a, b = spans.alias("a"), spans.alias("b")
    may = (F.col("a.component") == F.col("b.component")) & (F.col("a.block") <= F.col("b.block"))
    may &= 100 * F.col("a.high") >= percent * F.col("b.low")  # blocks lie in order of size
    pairs = a.join(b, may).select(
        F.col("a.component").alias("comp"), F.col("a.block").alias("block_a"), F.col("b.block").alias("block_b"),
    )
    sides = pairs.select("*", F.lit(0).alias("side"), F.col("block_a").alias("block")).unionByName(
        pairs.filter("block_a <> block_b").select("*", F.lit(1).alias("side"), F.col("block_b").alias("block"))
    )
    named = texts.join(blocks, "doc_id")
    work = named.join(sides, (F.col("component") == F.col("comp")) & (named.block == sides.block)).drop("block")
    key = [F.col("comp"), F.col("block_a"), F.col("block_b")]
    dealt = work.select(*key, "side", "doc_id", "n_shingles", "planes", "class", "text").repartition(*key)
    return dealt.sortWithinPartitions(*key, "side", "doc_id").mapInArrow(confirm(percent, width), "a bigint, b bigint")

