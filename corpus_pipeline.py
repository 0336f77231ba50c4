"""A training corpus from the documents table, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; its decisions take effect. All but the last return the columns of docs.
A stage that must tell rows apart writes them with a number each, so that rows
without an id, or with one that others have too, are judged by their own text.

Defined results: null and empty texts pass the filters as texts without words; a
row of equal rows is drawn, scored and dropped as each of the others, but for
near-duplicates, of which the one with the smallest id stays (rows without an id
come last); an empty table gives an empty table; texts of any length
are read whole; other columns stay as they are, whatever their names; ids are
whole numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import byte_bpe, decontamination, near_dedup, quality, toxicity
from vacantia.llm.common import tune_arrow
from vacantia.llm.queries import public_tokenizers
from vacantia.session import settled, tune


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written once, with a number of their own under a name that docs doesn't have."""
    name = "_row"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return settled(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def kept(rows: DataFrame, name: str, dropped: DataFrame) -> DataFrame:
    """Rows whose number is not in the one column of ``dropped``, without their numbers."""
    gone = dropped.toDF("_gone").distinct()
    return rows.join(gone, rows[name] == gone["_gone"], "left_anti").drop(name)


def by_row(rows: DataFrame, name: str) -> DataFrame:
    """Texts under the numbers of their rows."""
    return rows.select(F.col(name).alias("doc_id"), "text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, name = numbered(docs)
    drawn = quality.resampled(rows, quality.learned(rows, labels), row_col=name)
    return kept(rows, name, drawn.filter(~F.col("kept")).select("row"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = spark.sparkContext.broadcast(toxicity.train(docs, labels, F.lit(True)))  # a fixed number of buckets
    return docs.filter(toxicity.column_score(model, F.col("text")) < 0.5)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates (similarity 0.8 or more) the row with the smallest id stays."""
    rows, name = numbered(docs)
    found = near_dedup.near_duplicates(by_row(rows, name)).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    ids = rows.select(F.col(name).alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    place = F.struct(F.col("_id").isNull().alias("void"), "_id", "_row")
    # one row a group and task, so that a group of any size shrinks before the shuffle
    first = found.join(ids, "_row").groupBy("_group").agg(F.min(place).alias("first"))
    stay = first.select(F.col("first._row").alias("_stay"))
    return rows.join(stay, rows[name] == stay["_stay"], "left_semi").drop(name)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, name = numbered(docs)
    return kept(rows, name, decontamination.contaminated(by_row(rows, name), items).select("doc_id"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to."""
    public = public_tokenizers()
    return byte_bpe.encoded(docs, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", encoding_stage),
]

#: A trained classifier decides what goes on, which SQL can't express; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again."""
    tune_arrow(tune(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
