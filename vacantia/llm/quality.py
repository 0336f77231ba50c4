"""Quality by importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k draw.

Words and marks of a text, alone and in pairs, are hashed to buckets. The raw
model is the bucket frequencies of all documents, the target model those of
texts labelled good, smoothed towards the raw ones. A document's log weight is
the sum of the log ratios of its n-grams over a temperature: n / LENGTH for n
n-grams, as if all documents had LENGTH of them, because with a small target the
plain sum (temperature 1) drops long clean documents of the rarer kinds. Adding
Gumbel noise to the log weights and keeping the k largest draws k documents without
replacement in proportion to their weights. k is the caller's number of rows or
share of them; by default the share of good ones among all labels and one standard
error of that share. The noise of a document follows from its id, so a run can be
repeated.

The target model is learned from at most ``sample`` good documents; the share,
the raw model, the weights and the draw cover all rows. Defined results: a text
without n-grams (null and empty ones too) has log weight 0; with no good label the
ratio is 1 everywhere, and without labels all rows are kept; of rows that tie in
draw, id and size any are kept, k in all; rows that share an id share their noise;
texts of any length are read whole; an empty table gives an empty table; ids are
whole numbers (a text id raises); other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import binaries, ranked, text_batches, tune_arrow
from vacantia.session import settled

BUCKETS = 1 << 14
#: Labelled good documents that are learned from at most.
SAMPLE = 20_000
#: N-grams a bucket gets on average before anything is counted.
SMOOTHING = 1.0
#: N-grams that every document's log weight is tempered to.
LENGTH = 200
SEED = 20
WEIGHT_SCHEMA = "doc_id bigint, row bigint, log_weight double, n_grams bigint"
#: A word, or a run of marks.
PARTS = re.compile(rb"[\w\x80-\xff]+|[^\w\s\x80-\xff]+")


@dataclass
class Ratio:
    """Log ratio of target to raw frequency of every bucket, and the share of documents to keep by the labels."""

    logs: np.ndarray
    share: float


def buckets(text: bytes | None) -> np.ndarray:
    """Buckets of the single parts and the pairs of parts of a text."""
    parts = PARTS.findall(text) if text else []
    one = np.fromiter(map(zlib.crc32, parts), np.uint32, len(parts)).astype(np.uint64)
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xD6E8FEB86659FD93)
    found = np.concatenate([one * np.uint64(0xBF58476D1CE4E5B9), two])
    return (found >> np.uint64(64 - 14)).astype(np.int64)


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of a whole task."""
    totals = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in binaries(batch.column("text")):
            totals += np.bincount(buckets(text), minlength=BUCKETS)
    some = np.flatnonzero(totals)
    yield pa.record_batch([pa.array(some), pa.array(totals[some])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Frequencies of all n-grams of all rows; BUCKETS numbers reach the driver."""
    rows = texts.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS)
    for bucket, n in rows:
        out[bucket] = n
    return out


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ratio:
    """Log ratios from all documents and a bounded sample of good ones (the smallest hashes of ids first), and the share of good labels."""
    tune_arrow(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.min("y").alias("y"))
    share, count_of = marks.agg(F.avg("y"), F.count("y")).first()
    good = settled(marks.filter("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id"), "labels")
    raw = bucket_counts(texts)
    target = bucket_counts(texts.join(F.broadcast(good), "doc_id").select("text"))  # at most ``sample`` ids
    if not target.any():
        return Ratio(np.zeros(BUCKETS), 1.0)
    return Ratio(log_ratios(target, raw), good_share(share, count_of))


def good_share(share: float, labels: int) -> float:
    """The share and one standard error."""
    return min(1.0, share + math.sqrt(share * (1 - share) / labels))


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target over raw frequency of every bucket."""
    share = (raw + 1) / (raw.sum() + BUCKETS)
    return np.log((target + SMOOTHING * BUCKETS * share) / (target.sum() + SMOOTHING * BUCKETS)) - np.log(share)


def weigh(ratio):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = ratio.value.logs
        for batch in text_batches(batches):
            found = [buckets(t) for t in binaries(batch.column("text"))]
            weights = [LENGTH * float(logs[b].mean()) if len(b) else 0.0 for b in found]
            sizes = [len(b) for b in found]
            yield pa.record_batch([batch.column("doc_id"), batch.column("row"), pa.array(weights, pa.float64()), pa.array(sizes, pa.int64())], names=["doc_id", "row", "log_weight", "n_grams"])

    return run


def gumbel(key: Column) -> Column:
    """Gumbel noise from a hash of the id."""
    low = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    return -F.log(-F.log((low + 0.5) / F.lit(float(16**13))))


def resampled(
    docs: DataFrame, ratio: Ratio, k: int | None = None, share: float | None = None, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """(doc_id, n_grams, log_weight, draw, rank, kept) of every row; ``kept`` marks the k largest draws.

    k is given, or ``share`` (the labels' own unless given) of all rows. ``row_col``
    names a column (long) that tells rows apart and comes back as ``row``. The
    position of a row comes from a range-partitioned sort of these narrow columns,
    so k may be any share of the table.
    """
    spark = tune_arrow(docs.sparkSession)
    shared = spark.sparkContext.broadcast(ratio)  # BUCKETS numbers
    row = F.col(row_col) if row_col else F.lit(None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.cast("long").alias("row"), F.col(text_col).alias("text"))
    weights = rows.mapInArrow(weigh(shared), WEIGHT_SCHEMA)
    drawn = settled(weights.withColumn("draw", F.col("log_weight") + gumbel(F.col("doc_id"))), "draws")
    if k is None:
        k = round(drawn.count() * (ratio.share if share is None else share))
    order = [F.col("draw").desc(), F.col("doc_id"), F.col("n_grams"), F.col("row")]
    columns = ["doc_id", *(["row"] if row_col else []), "n_grams", "log_weight", "draw", "rank"]
    return ranked(drawn, order, "rank").select(*columns, (F.col("rank") < k).alias("kept"))
