"""Helpers the corpus operators share: hashing of words, global ranks, connected components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.session import settled

#: Rows and bytes of an Arrow batch handed to Python; texts may be long, so batches are small.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "128",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}
#: Odd 64-bit multipliers, one per word position of a shingle (powers of the golden-ratio constant modulo 2^64).
_STEP = 0x9E3779B97F4A7C15
#: Bits of monotonically_increasing_id that number rows inside a partition.
_ROW_BITS = 33


def tune_arrow(spark: SparkSession) -> SparkSession:
    """Small Arrow batches for operators that hand whole texts to Python."""
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)
    return spark


def binaries(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding it."""
    return column.cast(pa.binary()).to_pylist()


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def folded_words(text: bytes | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, cut at the ASCII blanks x20 and x09-x0D."""
    return text.lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash per window of ``width`` words, in order of the text.

    A text of fewer words is one shingle, a text of none has none.
    """
    size = min(width, len(hashes))
    if size == 0:
        return hashes
    total = np.full(len(hashes) - size + 1, size, np.uint64)
    factor = 1
    for i in range(size):
        factor = factor * _STEP % (1 << 64)
        total += hashes[i : len(hashes) - size + 1 + i] * np.uint64(factor)
    return mixed(total)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(folded_words(text)), width))


def multipliers(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and offsets of ``count`` hash permutations; a longer list starts with a shorter one."""
    rng = np.random.default_rng(seed)
    drawn = rng.integers(0, 1 << 64, (count, 2), dtype=np.uint64)
    return drawn[:, 0] | np.uint64(1), drawn[:, 1]


def minima(shingles: np.ndarray, starts: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash minima, (permutations, sets); set i is shingles[starts[i]:starts[i + 1]], none is empty."""
    out = np.empty((len(factors), len(starts)), np.uint64)
    work = np.empty_like(shingles)
    for k in range(len(factors)):
        np.multiply(shingles, factors[k], out=work)
        np.add(work, offsets[k], out=work)
        out[k] = np.minimum.reduceat(work, starts)
    return out


def ranked(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Rows with their position 0..n-1 in the order, without one task that sees all rows.

    Rows are range-partitioned, sorted and numbered inside each partition and
    written once; the row counts of earlier partitions are added, one number a
    partition. Rows that tie get neighbouring positions in any order.
    """
    row = F.monotonically_increasing_id()
    cut = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", row), "ranked")
    part = F.shiftright("_row", _ROW_BITS)
    sizes = cut.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    out = cut.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # one row per partition of the write
    return out.withColumn(name, F.col("_before") + inside).drop("_part", "_row", "_before")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is the smallest node reachable.

    Alternates two rounds until nothing changes: every node hands its larger
    neighbours to its smallest neighbour, then its smaller ones. Each round is
    group minima (combined before the shuffle) and joins on the node. The minima are
    written before they are joined: Spark then broadcasts them if they are small, and
    else both sides come bare from their exchange, so AQE splits a hot node. The
    links stay in written tables and never reach the driver.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = settled(pairs, label)
    mark = _mark(state)
    while mark[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settled(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{label}-low")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settled(large.distinct(), f"{label}-large")
        least = settled(large.groupBy("u").agg(F.min("v").alias("m")), f"{label}-least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = settled(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), label)
        now = _mark(state)
        if now == mark:
            break
        mark = now
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return roots.unionByName(state.select(F.col("u").alias("node"), F.col("v").alias("component")))


def _mark(state: DataFrame) -> tuple[int, int]:
    row = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def forest(count: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges of ``left``-``right`` that join parts not yet joined, over nodes 0..count-1."""
    parent = list(range(count))
    kept = []
    for a, b in zip(left.tolist(), right.tolist()):
        x, y = root(parent, a), root(parent, b)
        if x != y:
            parent[y] = x
            kept.append((a, b))
    return kept


def root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def text_batches(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of text (at least one row each)."""
    for batch in batches:
        sizes = np.array([len(x or b"") for x in binaries(batch.column("text"))])
        start = used = 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and used + n > limit:
                yield batch.slice(start, i - start)
                start, used = i, 0
            used += n
        if batch.num_rows > start:
            yield batch.slice(start)
