"""A word and gram index of posting texts, kept by month.

``words`` holds (field, word, id, day) of every posting in a folder per month, sorted
by word inside a file, so that a lookup reads few row groups; ``grams`` holds the
three-letter grams of the distinct words. A phrase is looked up by its pieces
without blanks or wildcards: the words that hold a piece's grams and the piece,
then the postings of the rarest piece. These are read from the days they lie in,
and the phrase itself is tested on them, so the rows are those of a scan.

Postings may carry the names of their descriptions' texts. A text's words are then
rows of ``text_words`` (word, text), whose postings are in ``shown`` (text, id, day),
and a phrase is tested on the text before it meets postings. ``text`` is a hash of the
name: texts that share one are looked at and tested like others.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators.scale import parts_of
from vacantia.session import folders, settled

FIELDS = ("title", "description", "company", "location")
WORDS = "field string, word string, id bigint, day date, month date"
TEXT_WORDS = "word string, text bigint"
SHOWN = "text bigint, id bigint, day date"
GRAM = 3
#: Texts whose words one task sorts.
TEXTS_PER_PART = 10_000


def _vocabulary(name: str) -> Column:
    """The distinct words of a column, in one string."""
    return F.array_join(F.array_distinct(F.split(F.lower(F.coalesce(F.col(name), F.lit(""))), r"\s+")), " ")


def pieces(phrase: str, wildcards: str = "") -> list[str]:
    """What of a phrase must stand inside one word, if it is long enough for a gram."""
    return sorted({p for p in re.split(rf"[\s{re.escape(wildcards)}]+", phrase.lower(), flags=re.A) if len(p) >= GRAM})


class TextIndex:
    """The index at ``root``; postings of new days are added beside those there are.

    With ``texts`` (name, text; a row per name) the descriptions of postings are names.
    """

    def __init__(self, spark: SparkSession, root: str, texts: DataFrame | None = None):
        self.spark, self.root, self.texts = spark, root.rstrip("/"), texts

    def _in_hand(self, fields: tuple[str, ...] | list[str]) -> list[str]:
        return [f for f in fields if self.texts is None or f != "description"]

    def add(self, jobs: DataFrame) -> TextIndex:
        dated = jobs.withColumn("day", F.to_date("discovered_at"))
        said = [_vocabulary(f).alias(f) for f in self._in_hand(FIELDS)]
        texts = settled(dated.select("id", "day", *said).withColumn("month", F.trunc("day", "month")), "said")
        dealt = self.word_rows(texts.hint("rebalance", "month")).sortWithinPartitions("month", "field", "word", "id")
        dealt.write.mode("append").option("compression", "zstd").partitionBy("month").parquet(f"{self.root}/words")
        words = self.word_rows(texts).select("word")
        if self.texts is not None:
            words = words.unionByName(self._add_texts(dated.filter("description IS NOT NULL")))
        distinct = words.distinct()
        starts = F.sequence(F.lit(1), F.length("word") - (GRAM - 1))
        cut = F.when(F.length("word") >= GRAM, F.array_distinct(F.transform(starts, lambda p: F.substring(F.col("word"), p, F.lit(GRAM)))))
        # a word's grams are made where the distinct words are: each file is sorted, so a lookup reads few row groups of it
        grams = distinct.select(F.explode(cut).alias("gram"), "word").sortWithinPartitions("gram", "word")
        grams.write.mode("append").parquet(f"{self.root}/grams")
        return self

    def _add_texts(self, dated: DataFrame) -> DataFrame:
        """Index the texts that postings name, each once; gives the words of those that were not there yet."""
        shown = dated.select(F.xxhash64("description").alias("text"), "id", "day")
        known = self._by_text("shown", SHOWN).select("text")
        fresh = settled(shown.select("text").distinct().join(known, "text", "left_anti"), "fresh-texts")
        part = len(folders(self.spark, f"{self.root}/shown"))
        own = self.texts.select(F.xxhash64("name").alias("text"), _vocabulary("text").alias("words"))
        own = own.repartition(parts_of(fresh, TEXTS_PER_PART), "text").join(fresh, "text", "left_semi")
        rows = own.select(F.explode(F.split("words", " ")).alias("word"), "text").filter("word <> ''")
        written = f"{self.root}/text_words/{part}"
        rows.sortWithinPartitions("word", "text").write.mode("overwrite").option("compression", "zstd").parquet(written)
        shown.sortWithinPartitions("text").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/shown/{part}")
        return self.spark.read.schema(TEXT_WORDS).parquet(written).select("word")

    def _by_text(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{name}/{part}" for part in folders(self.spark, f"{self.root}/{name}")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def word_rows(texts: DataFrame) -> DataFrame:
        """A row per distinct word of a posting's fields; postings are dealt before, so no row per word is shuffled."""
        fields = [f for f in FIELDS if f in texts.columns]
        found = F.array(*[F.struct(F.lit(f).alias("field"), F.split(F.col(f), " ").alias("words")) for f in fields])
        rows = texts.select("id", "day", "month", F.explode(found).alias("f"))
        return rows.select("f.field", F.explode("f.words").alias("word"), "id", "day", "month").filter("word <> ''")

    def _holding(self, piece: str) -> DataFrame:
        """Words that hold a piece."""
        own = sorted({piece[i : i + GRAM] for i in range(len(piece) - GRAM + 1)})
        grams = self.spark.read.schema("gram string, word string").parquet(f"{self.root}/grams").filter(F.col("gram").isin(own))
        every = grams.groupBy("word").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(own))
        return every.filter(F.contains("word", F.lit(piece))).select("word")

    def _rarest(self, words: DataFrame, phrase_pieces: list[str]) -> DataFrame:
        """The rows of ``words`` that hold the rarest of the pieces."""
        holding = [self._holding(p).withColumn("piece", F.lit(p)) for p in phrase_pieces]
        every = holding[0]
        for other in holding[1:]:
            every = every.unionByName(other)
        rarest = phrase_pieces[0]
        if len(phrase_pieces) > 1:
            counts = {r.piece: r.n for r in words.join(every, "word").groupBy("piece").agg(F.count(F.lit(1)).alias("n")).collect()}
            rarest = min(phrase_pieces, key=lambda p: (counts.get(p, 0), p))  # a number for each piece of the phrase
        return words.join(every.filter(F.col("piece") == rarest).select("word"), "word", "left_semi")

    def _texts_holding(self, phrase_pieces: list[str]) -> DataFrame:
        return self._rarest(self._by_text("text_words", TEXT_WORDS), phrase_pieces).select("text").distinct()

    def candidates(self, phrase_pieces: list[str], fields: list[str]) -> DataFrame:
        """(id, day) of the postings that hold the rarest of the pieces in one of the fields."""
        words = self.spark.read.schema(WORDS).parquet(f"{self.root}/words").filter(F.col("field").isin(self._in_hand(fields)))
        hits = self._rarest(words, phrase_pieces).select("id", "day")
        if len(self._in_hand(fields)) < len(fields):
            shown = self._by_text("shown", SHOWN).join(self._texts_holding(phrase_pieces), "text", "left_semi")
            hits = hits.unionByName(shown.select("id", "day"))
        return hits.distinct()

    def told(self, jobs: DataFrame, test: Callable[[Column], Column], phrase: str, wildcards: str = "") -> tuple[DataFrame, Column]:
        """Postings, and whether their descriptions pass the test of a phrase; texts with names are tested once each."""
        if self.texts is None:
            return jobs, test(F.col("description"))
        found = pieces(phrase, wildcards)
        texts = self.texts.filter(test(F.col("text"))).select(F.col("name").alias("_told"))
        if found:
            texts = texts.join(self._texts_holding(found), F.xxhash64("_told") == F.col("text"), "left_semi")
        return jobs.join(texts, jobs["description"] == F.col("_told"), "left"), F.col("_told").isNotNull()

    def narrowed(self, jobs: DataFrame, phrase: str, fields: list[str], wildcards: str = "") -> DataFrame:
        """The postings that may match, read from the days they lie in; all of them if the phrase has no piece to look up."""
        found = pieces(phrase, wildcards)
        if not found:
            return jobs
        hits = self.candidates(found, fields).select(F.col("id").alias("_id"), F.col("day").alias("_day"))
        day = F.col("discovered_at_day") if "discovered_at_day" in jobs.columns else F.to_date("discovered_at")
        dated = jobs.join(hits, (jobs["id"] == F.col("_id")) & (day == F.col("_day")), "left_semi")
        undated = jobs.filter(day.isNull())
        return dated.unionByName(undated.join(hits.filter("_day IS NULL"), undated["id"] == F.col("_id"), "left_semi"))
