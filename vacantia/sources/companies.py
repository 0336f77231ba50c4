"""Company lists: CSV in and out, seed JSON, in-memory rows, several sources."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import text, urls
from vacantia.schemas import COMPANY_CSV, COMPANY_RECORD

# Columns of the CSV, the keys of a seed entry that are no metadata.
CSV_COLUMNS = ("Company Name", "Career Page URL", "Source", "Priority", "Notes")
SEED_KEYS = ("name", "career_page_url", "source", "priority", "has_crawl_results")
#: Any callable that yields company records can be a source.
RecordSource = Callable[[SparkSession], DataFrame]


def read_company_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of the company CSV, with the malformed line where there is one."""
    return (
        spark.read.schema(COMPANY_CSV + ", _malformed string")
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("columnNameOfCorruptRecord", "_malformed")
        .csv(path)
    )


def company_rows_from_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Raw rows from one CSV line per row."""
    ddl = ", ".join(f"`{c}` STRING" for c in CSV_COLUMNS)
    parsed = F.from_csv(F.col(line), ddl, {"escape": '"', "quote": '"'})
    return lines.withColumn("_r", parsed).select("*", *[F.col("_r")[c].alias(c) for c in CSV_COLUMNS]).drop("_r")


def parse_companies(rows: DataFrame) -> DataFrame:
    """Add name, URL, crawler type, config and the reject ``reason`` (NULL = accepted).

    Rows with a name and no URL at all carry the reason ``blank_url``, which the
    reject counts leave out.
    """
    raw_name, raw_url = F.col("Company Name"), F.col("Career Page URL")
    named = rows.withColumn("name", text.py_strip(raw_name)).withColumn("_found", urls.extract_url(text.py_strip(raw_url)))
    named = named.withColumn("career_page_url", F.coalesce("_found", urls.career_url_from_name(F.col("name")))).drop("_found")
    broken = F.col("_malformed").isNotNull() if "_malformed" in rows.columns else F.lit(False)
    reason = (
        F.when(broken, "parsing_error")
        .when(F.coalesce(raw_name, F.lit("")) == "", "empty_name")
        .when(F.coalesce(raw_url, F.lit("")) == "", "blank_url")
        .when(F.col("name") == "", "empty_name")
        .when(F.col("career_page_url").isNull(), "no_url")
        .when(~urls.valid_url(F.col("career_page_url")), "invalid_url")
    )
    parsed = named.withColumn("reason", reason)
    kind = urls.detect_crawler_type(F.col("career_page_url"))
    accepted = F.col("reason").isNull()
    parsed = parsed.withColumn("crawler_type", F.when(accepted, kind))
    config = urls.crawler_config(F.col("name"), F.col("career_page_url"), F.col("crawler_type"))
    return parsed.withColumn("crawler_config", F.when(accepted, config))


def accepted_companies(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).select("name", "career_page_url", "crawler_type", "crawler_config")


def rejected_companies(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull() & (F.col("reason") != "blank_url"))


def csv_rows(records: DataFrame, notes: Column | None = None) -> DataFrame:
    """The five CSV columns of company records."""
    note = F.try_element_at("metadata", F.lit("notes")) if notes is None else notes
    return records.select(
        F.col("name").alias("Company Name"),
        F.col("career_page_url").alias("Career Page URL"),
        F.col("source").alias("Source"),
        F.col("priority").alias("Priority"),
        F.coalesce(note, F.lit("")).alias("Notes"),
    )


def write_company_csv(records: DataFrame, path: str, notes: Column | None = None) -> None:
    csv_rows(records, notes).write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def seed_records(payloads: DataFrame, payload: str = "payload", source_name: str = "seed_file") -> DataFrame:
    """Company records from JSON lists of objects; unknown keys become metadata."""
    items = payloads.select(F.explode(F.from_json(payload, "array<map<string,string>>")).alias("m"))

    def value(key: str) -> Column:
        return F.try_element_at("m", F.lit(key))

    flag = F.lower(F.coalesce(value("has_crawl_results"), F.lit("")))
    source = F.coalesce(F.nullif(value("source"), F.lit("")), F.lit(source_name))
    return items.filter(value("name").isNotNull() & value("career_page_url").isNotNull()).select(
        text.py_strip(value("name")).alias("name"),
        text.py_strip(value("career_page_url")).alias("career_page_url"),
        source.alias("source"),
        F.coalesce(value("priority").try_cast("int"), F.lit(0)).alias("priority"),
        (~flag.isin("", "false", "0")).alias("has_crawl_results"),
        F.map_filter("m", lambda k, _: ~k.isin(*SEED_KEYS)).alias("metadata"),
    )


def read_seed_json(spark: SparkSession, path: str, source_name: str = "seed_file") -> DataFrame:
    return seed_records(spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload"), source_name=source_name)


def memory_records(spark: SparkSession, rows: Iterable[tuple], source_name: str | None = None) -> DataFrame:
    """Records given by the caller, mainly for tests."""
    return with_source(spark.createDataFrame(list(rows), COMPANY_RECORD), source_name)


def with_source(records: DataFrame, source_name: str | None) -> DataFrame:
    return records.withColumn("source", F.lit(source_name)) if source_name else records


def collect_records(parts: Sequence[DataFrame]) -> DataFrame:
    """All records of all sources; missing columns become NULL."""
    numbered = [p.withColumn("source_no", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def refresh_records(parts: Sequence[DataFrame], heuristic: Callable[[DataFrame], Column], cap: int | None = None) -> DataFrame:
    """Collect and verify, then cut to the caller's cap: the frame the CSV sink writes."""
    from vacantia.operators.filters import verified_records
    from vacantia.operators.ranking import capped_records

    return capped_records(verified_records(collect_records(parts), heuristic), cap)
