"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs. The vector of an n-gram binds the
letters' vectors, each permuted by its position (rolled, then multiplied
component by component). The n-gram vectors of a text are bundled (summed) to
its vector, those of all texts of a language to the language's prototype, and a
text gets the language whose prototype has the largest cosine with its vector.

Letters are lower-cased; every run of other characters is one blank, and a text
begins and ends with one. Defined results: a text without a letter (null and
empty ones too) is ``und`` with score 0; if nothing was learned, every text is
``und``; equal cosines go to the language first in alphabet; repeated rows each
get a row; an empty table gives an empty table; other columns are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import text_batches, tune_arrow

DIMENSIONS = 1024
N = 3
SEED = 11
#: N-gram vectors a worker keeps; beyond it the store is emptied and filled anew.
STORE = 1 << 15
_CODE_BITS = 21  # of a code point
UNKNOWN = "und"
COUNT_SCHEMA = "lang string, gram bigint, n bigint"
PART_SCHEMA = "lang string, parts array<double>"

_fold = np.zeros(1 << 16, np.int32)
_ready = False


def _table() -> np.ndarray:
    """Lower-cased letter of each code point of the basic plane, 0 for what is no letter."""
    global _ready
    if not _ready:
        for c in range(1 << 16):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                _fold[c] = ord(low) if len(low) == 1 else c
        _ready = True
    return _fold


def letters(text: str | None) -> np.ndarray:
    """Letters of a text as code points, runs of anything else as one 0, with a 0 at both ends."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    table = _table()
    low = table[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF).tolist():
        ch = chr(codes[i])
        low[i] = ord(ch.lower()[0]) if ch.isalpha() else 0
    low = np.concatenate([[0], low, [0]]).astype(np.int64)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 0) | (low[:-1] != 0)
    return low[keep]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their counts; none if it has no letter."""
    codes = letters(text)
    if len(codes) < N:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    packed = np.zeros(len(codes) - N + 1, np.int64)
    for i in range(N):
        packed = (packed << _CODE_BITS) | codes[i : len(codes) - N + 1 + i]
    return np.unique(packed, return_counts=True)


class Vectors:
    """Vectors of letters and n-grams, made when first met."""

    def __init__(self) -> None:
        self.letter: dict[int, np.ndarray] = {}
        self.at: dict[int, int] = {}
        self.rows = np.empty((1024, DIMENSIONS), np.float32)

    def of_letter(self, code: int) -> np.ndarray:
        if code not in self.letter:
            if len(self.letter) > STORE // 4:
                self.letter.clear()
            bits = np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, dtype=np.int8)
            self.letter[code] = (2 * bits - 1).astype(np.int8)
        return self.letter[code]

    def bound(self, gram: int) -> np.ndarray:
        out = np.ones(DIMENSIONS, np.int8)
        for i in range(N):
            code = gram >> (_CODE_BITS * (N - 1 - i)) & ((1 << _CODE_BITS) - 1)
            out = out * np.roll(self.of_letter(code), N - 1 - i)
        return out

    def __call__(self, found: np.ndarray) -> np.ndarray:
        """One row per n-gram."""
        if len(self.at) + len(found) > STORE:
            self.at.clear()
        if len(found) > STORE:
            return np.array([self.bound(g) for g in found.tolist()], np.float32)
        places = []
        for g in found.tolist():
            at = self.at.get(g)
            if at is None:
                at = self.at[g] = len(self.at)
                if at >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
                self.rows[at] = self.bound(g)
            places.append(at)
        return self.rows[places]


_vectors = Vectors()


def bundle(found: np.ndarray, counts: np.ndarray, step: int = 4096) -> np.ndarray:
    """Sum of the n-grams' vectors, in steps, so that any number of n-grams fits."""
    total = np.zeros(DIMENSIONS)
    for i in range(0, len(found), step):
        total += counts[i : i + step].astype(np.float32) @ _vectors(found[i : i + step])
    return total


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of each language, one row per batch, language and n-gram."""
    for batch in text_batches(batches, limit=4 << 20):
        by_lang: dict[str, list] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            by_lang.setdefault(lang, []).append(grams(text))
        for lang, found in by_lang.items():
            distinct, back = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
            sums = np.bincount(back, np.concatenate([c for _, c in found]), len(distinct)).astype(np.int64)
            yield pa.record_batch([pa.array([lang] * len(distinct), pa.string()), pa.array(distinct), pa.array(sums)], names=["lang", "gram", "n"])


def bundle_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A language's share of its prototype from the n-grams of this task."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        found, counts = batch.column("gram").to_numpy(), batch.column("n").to_numpy()
        for lang in set(langs.tolist()):
            own = langs == lang
            totals[lang] = totals.get(lang, 0) + bundle(found[own], counts[own])
    yield pa.record_batch([pa.array(list(totals), pa.string()), pa.array([list(t) for t in totals.values()], pa.list_(pa.float64()))], names=["lang", "parts"])


def prototypes(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototype of every language among the rows ``learn`` marks; all of their texts are counted.

    Counts are combined in Spark; what comes to the driver is one vector per
    language, so it grows with the languages and not with the documents.
    """
    tune_arrow(docs.sparkSession)
    rows = docs.filter(learn & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(count_grams, COUNT_SCHEMA).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    parts = counts.mapInArrow(bundle_parts, PART_SCHEMA)
    sums = parts.select("lang", F.posexplode("parts").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    vectors = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))  # DIMENSIONS numbers a group
    found = {r["lang"]: np.array(r["v"]) for r in vectors.collect()}
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(found.items()) if np.any(v)}


def predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = model.value
        for batch in text_batches(batches):
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                found, counts = grams(text)
                vector = bundle(found, counts) if len(found) and names else None
                if vector is None or not vector.any():
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosine = matrix @ (vector / np.linalg.norm(vector))
                best = int(np.argmax(cosine))
                langs.append(names[best])
                scores.append(float(min(1.0, max(0.0, cosine[best]))))
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.record_batch(
                [*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*[n for n in batch.schema.names if n != "text"], "lang_pred", "score"],
            )

    return run


def identified(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row by its whole text; score is the cosine, cut to 0..1."""
    spark = tune_arrow(docs.sparkSession)
    matrix = np.array(list(model.values())) if model else np.empty((0, DIMENSIONS))
    shared = spark.sparkContext.broadcast((list(model), matrix))  # DIMENSIONS numbers a language
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(predict(shared), "doc_id bigint, lang_pred string, score double")


def remainder(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; the folds of held-out rows are cut by it. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % of
