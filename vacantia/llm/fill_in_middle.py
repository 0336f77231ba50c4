"""Fill-in-the-middle form of whole texts, cut at word borders.

A text is a row of character classes: blank or not, together with the class of
the next character. A wavelet matrix over these classes answers how many
characters of a class stand before a place; the number of word ends before a
place is such a rank, and the place of a cut is found by bisection on ranks.
A row needs nothing but itself, so the work is one pass without a shuffle.

Defined results: a null text is the empty text; empty texts and texts that hold
one of the marks stay plain; equal rows get equal results; the draws of a row
without an id are those of the empty id; an empty table gives an empty table;
texts of any length are cut whole (their classes take a few bytes per character
of one text at a time); columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import tune_arrow

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Classes of a character: bit 1 is set for a blank (x20, x09-x0D), bit 0 if a blank or nothing follows.
WORD_END = 0b01
CLASS_BITS = 2


class Bits:
    """A bit vector that counts the ones before any place."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.pad(packed, (0, -len(packed) % 8 + 8)).view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.ones = int(self.before[-1])

    def rank(self, place: int) -> int:
        word, bit = divmod(place, 64)
        return int(self.before[word]) + (int(self.words[word]) & (1 << bit) - 1).bit_count()


class WaveletMatrix:
    """Ranks of small codes in a sequence; one bit vector per bit, the highest first."""

    def __init__(self, codes: np.ndarray, bits: int) -> None:
        self.size = len(codes)
        self.levels = []
        for b in reversed(range(bits)):
            ones = (codes >> b & 1).astype(bool)
            self.levels.append(Bits(ones))
            codes = np.concatenate((codes[~ones], codes[ones]))

    def rank(self, code: int, place: int) -> int:
        """How many of the first ``place`` codes are ``code``."""
        low, high = 0, place
        for depth, level in enumerate(self.levels, 1):
            if code >> (len(self.levels) - depth) & 1:
                zeros = self.size - level.ones
                low, high = zeros + level.rank(low), zeros + level.rank(high)
            else:
                low, high = low - level.rank(low), high - level.rank(high)
        return high - low

    def select(self, code: int, count: int) -> int:
        """The shortest beginning that holds ``count`` times ``code``, by bisection on ranks."""
        low, high = 0, self.size
        while low < high:
            middle = (low + high) // 2
            if self.rank(code, middle) < count:
                low = middle + 1
            else:
                high = middle
        return low


def classes(text: str) -> np.ndarray:
    """The class of every character."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    blank = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    follows = np.append(blank[1:], True)[: len(blank)]
    return blank.astype(np.uint8) << 1 | follows


class Cutter:
    """Where the units of one text end: a word with the blanks before it, or blanks that end the text."""

    def __init__(self, text: str) -> None:
        codes = classes(text)
        self.matrix = WaveletMatrix(codes, CLASS_BITS)
        self.words = self.matrix.rank(WORD_END, len(text))
        self.units = self.words + int(len(codes) > 0 and bool(codes[-1] >> 1))

    def place(self, count: int) -> int:
        """Characters of the first ``count`` units."""
        if count > self.words:
            return self.matrix.size
        return self.matrix.select(WORD_END, count)


def draws(doc_id: object, seed: int) -> list[int]:
    """Four 32-bit draws that a document's id decides."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: str, drawn: list[int], percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of prefix and middle, output) of one text."""
    cutter = Cutter(text)
    if not text or any(m in text for m in MARKS) or drawn[2] % 100 >= percent:
        return cutter.units, "plain", None, None, text
    first, last = sorted(d % (cutter.units + 1) for d in drawn[:2])
    start, end = cutter.place(first), cutter.place(last)
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    p, s, m = MARKS
    if drawn[3] % 100 < spm_percent:
        return cutter.units, "spm", start, end - start, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return cutter.units, "psm", start, end - start, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every text.

    ``percent`` of the texts are cut in three; ``spm_percent`` of these put the suffix first.
    """
    tune_arrow(docs.sparkSession)
    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = ["n", "form", "prefix_chars", "middle_chars", "output"]
        for batch in batches:
            found = [transform(t, draws(i, seed), percent, spm_percent) for i, t in zip(batch["_id"].to_pylist(), batch["text"].to_pylist())]
            columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from; plain outputs are texts, the others hold each mark once."""
    p, s, m = MARKS
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, m, -1)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
