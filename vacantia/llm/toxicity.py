"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (bytes, with the blanks around it),
each hashed to a bucket with an embedding. A segment of words has the average of
its embeddings, and a linear softmax over it gives its toxicity. Embeddings and
softmax are trained jointly in numpy, so a misspelling that was never seen
shares the vectors of the n-grams it still has. A document is as toxic as its
most toxic segment; in training a toxic document shows only its currently most
toxic segment, other documents their most toxic one and a few more.

Learning takes a sample of the labelled rows: at most ``per_class`` toxic and
``clean_share`` times as many other documents, and of these whole texts, by the
hashes of their ids, until they have ``half_limit`` half segments (all three are
parameters of ``train``; a sample with very long texts has fewer of them). Scoring
takes every whole text, of any length. Letters are lower-cased (A-Z) and ASCII blanks cut words.
Defined results: a null or empty text scores as a segment without n-grams, that
is, by the bias alone; without any label, or with labels of one class only, the
score is the share of toxic labels (0 without labels); rows with a null label or
id are not learned from; repeated rows each get a row; an empty table gives an
empty table; other columns are not read, whatever their names.
"""


from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import binaries, mixed, text_batches, tune_arrow

LENGTHS = (3, 4, 5, 6)
BUCKETS = 1 << 18
DIMENSIONS = 8
#: Words of a segment.
SEGMENT = 2
EPOCHS = 12
RATE = 0.5
SEED = 5
PER_CLASS = 700
#: Documents without the label for each with it.
CLEAN_SHARE = 3
#: Half segments learned from at most; with the n-grams of a half it bounds the memory of learning.
HALF_LIMIT = 1_200_000
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Model:
    """Toxicity of an n-gram bucket as a difference of logits, and the bias."""

    weights: np.ndarray
    bias: float


def subwords(text: bytes | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket and word number of every n-gram of a text, and the number of words.

    Runs of blanks count as one blank; an n-gram may begin or end with the blank
    beside its word and has none inside.
    """
    data = np.frombuffer(b" " + b" ".join((text or b"").lower().split()) + b" ", np.uint8)
    blank = _BLANK[data]
    word = np.cumsum(blank) - 1
    words = max(0, int(word[-1]))
    values = _BYTE[data]
    buckets, owners = [], []
    for n in LENGTHS:
        count = len(data) - n + 1
        if count <= 0:
            continue
        code = np.zeros(count, np.uint64)
        for i in range(n):
            code = code * np.uint64(0x100000001B3) + values[i : i + count]
        inner = np.cumsum(np.concatenate([[0], blank]))
        holes = inner[n - 1 : n - 1 + count] - inner[1 : 1 + count]  # blanks strictly inside
        good = np.flatnonzero(holes == 0)
        buckets.append(mixed(code[good]) & np.uint64(BUCKETS - 1))
        owners.append(word[good + 1])  # a blank at the front belongs to the word after it
    if not buckets:
        return np.empty(0, np.int64), np.empty(0, np.int64), words
    return np.concatenate(buckets).astype(np.int64), np.minimum(np.concatenate(owners), max(0, words - 1)), words


def segment_means(values: np.ndarray, owners: np.ndarray, words: int) -> np.ndarray:
    """Mean value of the n-grams of each segment; segments overlap by half."""
    half = SEGMENT // 2
    halves = -(-words // half)
    total = np.bincount(owners // half, values, halves)
    count = np.bincount(owners // half, minlength=halves)
    if halves > 1:
        total, count = total[:-1] + total[1:], count[:-1] + count[1:]
    return total / np.maximum(count, 1)


def probability(logit: np.ndarray | float):
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def text_score(text: bytes | None, model: Model) -> float:
    buckets, owners, words = subwords(text)
    if not words:
        return float(probability(model.bias))
    return float(probability(segment_means(model.weights[buckets], owners, words).max() + model.bias))


def half_bags(rows: list[tuple[bytes | None, int]], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of all texts by half segments: the buckets, where each half begins (and the end), the first
    half of each text, and for each half the last half of the segment that begins there."""
    flat, ends, first, pair = [], [np.zeros(1, np.int64)], [], []
    half, used = SEGMENT // 2, 0
    for text, _ in rows:
        if used >= limit:
            break
        buckets, owners, words = subwords(text)
        first.append(used)
        halves = max(1, -(-words // half))
        order = np.argsort(owners, kind="stable")
        cuts = np.searchsorted(owners[order] // half, np.arange(halves + 1))
        flat.append(buckets[order].astype(np.int32) if words else np.zeros(1, np.int32))  # a text without words is bucket 0
        cuts[-1] = len(flat[-1])
        pair.append(np.minimum(np.arange(1, halves + 1), halves - 1) + used)
        ends.append(cuts[1:] + ends[-1][-1])
        used += halves
    joined, at = np.empty(sum(map(len, flat)), np.int32), 0
    for i, piece in enumerate(flat):
        joined[at : at + len(piece)] = piece
        at, flat[i] = at + len(piece), None  # given back at once, so the n-grams are held about once
    return joined, np.concatenate(ends), np.array(first), np.concatenate(pair)


def segment_guess(weights: np.ndarray, flat: np.ndarray, begin: np.ndarray, pair: np.ndarray, step: int = 20_000) -> np.ndarray:
    """Mean weight of the n-grams of every segment, some halves at a time."""
    sums = np.empty(len(pair))
    for i in range(0, len(pair), step):
        j = min(i + step, len(pair))
        sums[i:j] = np.add.reduceat(weights[flat[begin[i] : begin[j]]], begin[i:j] - begin[i])
    both = sums + np.where(pair > np.arange(len(pair)), sums[pair], 0.0)
    return both / (begin[pair + 1] - begin[:-1])


def fit(rows: list[tuple[bytes | None, int]], half_limit: int = HALF_LIMIT) -> Model:
    """Embeddings and softmax from (text, 0 or 1); texts come in a fixed order, so the result is the same every time."""
    labels = np.array([y for _, y in rows], np.int64)
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))) if 0 < share < 1 else (30.0 if share else -30.0))
    flat, begin, first, pair = half_bags(rows, half_limit)
    labels = labels[: len(first)]
    doc_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pair))))
    toxic = labels[doc_of] == 1
    rng = np.random.default_rng(SEED)

    # first guess of what is toxic in a toxic document: log odds of the documents an n-gram is in, in standard errors
    yes, no = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for d in range(len(first)):
        own = np.unique(flat[begin[first[d]] : begin[first[d + 1] if d + 1 < len(first) else len(pair)]])
        (yes if labels[d] else no)[own] += 1
    part = max(1, labels.sum()) / len(labels)
    yes, no = yes + part, no + (1 - part)
    weights = (np.log(yes / part) - np.log(no / (1 - part))) / np.sqrt(1 / yes + 1 / no)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (2, DIMENSIONS)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    grown, seen = np.zeros(BUCKETS, np.float32), np.full(2, 1e-6, np.float32)
    slope = np.full((2, DIMENSIONS), 1e-6, np.float32)
    for epoch in range(EPOCHS):
        guess = segment_guess(weights, flat, begin, pair)
        order = np.lexsort((-guess, doc_of))
        lead = order[np.concatenate([[True], np.diff(doc_of[order]) > 0])]
        extra = rng.choice(len(pair), min(len(pair), 2 * len(lead)), replace=False)
        chosen = np.concatenate([lead, extra[~toxic[extra]]])
        rng.shuffle(chosen)
        for start in range(0, len(chosen), 64):
            own = chosen[start : start + 64]
            ids = np.concatenate([flat[begin[i] : begin[pair[i] + 1]] for i in own])
            size = begin[pair[own] + 1] - begin[own]
            at = np.cumsum(size) - size
            mean = np.add.reduceat(table[ids], at) / size[:, None]
            logits = mean @ softmax.T + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), labels[doc_of[own]]] -= 1
            back = np.repeat(p @ softmax / size[:, None], size, axis=0)
            turn = p.T @ mean
            slope += turn * turn
            seen += (p.sum(0)) ** 2
            distinct, place = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(place, back[:, k], len(distinct)) for k in range(DIMENSIONS)], 1).astype(np.float32)
            grown[distinct] += (grad * grad).mean(1)
            table[distinct] -= RATE * grad / np.sqrt(grown[distinct] + 1e-8)[:, None]
            softmax -= RATE * 0.2 * turn / np.sqrt(slope)
            bias -= RATE * 0.2 * p.sum(0) / np.sqrt(seen)
        weights = table @ (softmax[1] - softmax[0])
    return Model(weights.astype(np.float32), float(bias[1] - bias[0]))


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS, clean_share: int = CLEAN_SHARE, half_limit: int = HALF_LIMIT,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """A model from at most ``per_class`` toxic and ``clean_share`` times as many other labelled documents, those with the smallest hash of their id.

    The sample is the only thing that comes to the driver; its bound does not
    grow with the tables. ``learn`` says which rows of ``docs`` may be used.
    """
    tune_arrow(docs.sparkSession)
    marks = labels.select(F.col("doc_id").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    marks = marks.filter("doc_id IS NOT NULL AND y IN (0, 1)").distinct()
    allowed = docs.filter(learn).select(F.col(id_col).alias("doc_id")).distinct()
    known = marks.join(allowed, "doc_id").withColumn("h", F.xxhash64("doc_id"))
    picked = known.filter("y = 0").orderBy("h", "doc_id").limit(clean_share * per_class).unionByName(known.filter("y = 1").orderBy("h", "doc_id").limit(per_class))
    sample = docs.filter(learn).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = sample.dropDuplicates(["doc_id", "y"]).select("h", "doc_id", "text", "y").collect()
    rows.sort(key=lambda r: (r["h"], r["doc_id"], r["y"]))
    return fit([((r["text"] or "").encode(), r["y"]) for r in rows], half_limit)


def scoring(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            scores = [text_score(t, model.value) for t in binaries(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every whole text."""
    shared = tune_arrow(docs.sparkSession).sparkContext.broadcast(model)  # BUCKETS numbers
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(scoring(shared), "doc_id bigint, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def column_score(model, text: Column) -> Column:
    """The score as a column, for filters that keep all other columns as they are."""

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([text_score(t.encode() if t is not None else None, model.value) for t in texts], dtype="float64")

    return F.pandas_udf(score, "double")(text)
