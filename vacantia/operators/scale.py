"""Shapes that stay whole when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.session import shared_dir

#: Expected ids per array when members of a group are shown as arrays.
PAGE_SIZE = 1000


def parts_of(df: DataFrame, rows: int) -> int:
    """Parts of about ``rows`` rows each, or as many as shuffles have if that is more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def keep_first(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column], count: int = 1) -> DataFrame:
    """The first ``count`` rows per key.

    ``row_number() <= count`` lets Spark cut every key to ``count`` rows in each
    map task before the shuffle, so a hot key sends count x tasks rows.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= count).drop("_rn")


def top_rows(df: DataFrame, order: Sequence[Column], limit: int | None) -> DataFrame:
    """Global order, cut to ``limit`` rows when the report has a limit."""
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)


def paged_ids(df: DataFrame, size: Column, id_col: str = "id") -> DataFrame:
    """Add ``page`` so that a page of a group holds about PAGE_SIZE members.

    ``size`` is the known member count of the row's group.
    """
    pages = F.ceil(size / F.lit(PAGE_SIZE))
    return df.withColumn("page", F.pmod(F.xxhash64(id_col), pages))


def salted_join(facts: DataFrame, keyed: DataFrame, on: Sequence[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Join many ``facts`` to one-row-per-key ``keyed`` with the key salted.

    Each ``keyed`` row is repeated ``salts`` times and facts pick a salt from
    their own content, so a hot key is spread over ``salts`` tasks.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in facts.columns]), F.lit(salts)).cast("int")
    left = facts.withColumn("_salt", salt)
    right = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def ordinals(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "ordinal", size: str | None = None) -> DataFrame:
    """Position 1..n of every row within its key, also for keys too big for a task.

    Rows are range-partitioned on (keys, order), which cuts a hot key into
    several chunks. The chunk number is fixed by a checkpoint, rows are counted
    per (key, chunk), and the counts of earlier chunks are added to the local
    position. ``size`` names an optional column with the row count of the key.
    """
    shared_dir(df.sparkSession)
    cut = (
        df.repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn("_chunk", F.spark_partition_id())
        .checkpoint()
    )
    counts = cut.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_chunk").alias("_c"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(by_key).alias("_size"),
    )
    same = F.col("_chunk") == F.col("_c")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    local = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order))
    out = cut.withColumn("_local", local).join(offsets, same)
    out = out.withColumn(name, F.col("_local") + F.col("_before"))
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_chunk", "_local", "_c", "_before", "_size", *[f"_k{i}" for i in range(len(keys))])
