"""User documents and search recipes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import text

RECIPES = (
    "struct<recipes:array<struct<name:string,description:string,keywords:string,location:string,remote_only:boolean,"
    "job_type:string,experience_level:string,icon:string>>>"
)


#: A cell, quoted or bare, and what ends it. The repeats are possessive: they run in a loop, whatever the length of a cell.
CSV_CELL = r'("[^"]*+(?:""[^"]*+)*+"|[^,\r\n]*+)(,|\r\n|\n|\r|\z)'


def _csv_cells(content: Column) -> Column:
    """Whole CSV text of a document: cells joined by ``, ``, rows by newline, with the rows and the first row's cells.

    Quoted cells may hold commas, line breaks and doubled quotes. A quote inside
    a bare cell, or text after a closing quote, is kept as it stands.
    """
    cells, ends = (F.regexp_extract_all(content, F.lit(CSV_CELL), F.lit(n)) for n in (1, 2))
    # the pattern also matches the nothing after the last cell, unless that is an empty cell after a comma
    count = F.size(cells) - F.when(F.coalesce(F.get(ends, F.size(ends) - 2), F.lit(",")) == ",", 0).otherwise(1)
    pairs = F.slice(F.arrays_zip(cells.alias("c"), ends.alias("e")), 1, count)
    inner = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    plain = lambda c: text.py_strip(F.when(F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"')) & (F.length(c) > 1), inner(c)).otherwise(c))
    shown = lambda p, i: F.concat(plain(p["c"]), F.when(i == count - 1, "").when(p["e"] == ",", ", ").otherwise("\n"))
    breaks = F.filter(pairs, lambda p: p["e"] != ",")
    first = F.array_position(F.transform(pairs, lambda p: p["e"] != ","), True)
    empty = F.coalesce(content, F.lit("")) == ""
    blank = F.get(cells, F.lit(0)) == ""
    return F.struct(
        F.when(empty, "").otherwise(F.array_join(F.transform(pairs, shown), "")).alias("text"),
        F.when(empty, 0).otherwise(F.size(breaks)).cast("int").alias("row_count"),
        F.when(empty | ((first == 1) & blank), 0).otherwise(first).cast("int").alias("column_count"),
    )


def document_statistics(documents: DataFrame, content: str = "content") -> DataFrame:
    """Characters and words of plain text documents."""
    return documents.withColumn("char_count", F.length(F.coalesce(content, F.lit("")))).withColumn(
        "word_count", text.word_count(F.col(content))
    )


def csv_documents(documents: DataFrame, content: str = "content") -> DataFrame:
    """CSV documents to text, with rows, columns, characters and words."""
    read = documents.withColumn("_csv", _csv_cells(F.col(content)))
    flat = read.select("*", "_csv.*").drop("_csv")
    return document_statistics(flat, "text")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text files as documents, one row per file, decoded as UTF-8."""
    files = spark.read.format("binaryFile").load(path)
    kind = F.when(F.lower("path").endswith(".csv"), "text/csv").when(F.lower("path").endswith(".md"), "text/markdown")
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.coalesce(kind, F.lit("text/plain")).alias("content_type"),
        F.decode("content", "UTF-8").alias("content"),
    )


def recipes(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per recipe of ``{"recipes": [...]}`` texts."""
    return payloads.select(F.explode(F.from_json(payload, RECIPES)["recipes"]).alias("r")).select("r.*")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return recipes(spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload"))
