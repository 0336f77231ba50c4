"""Shards by weighted rendezvous hashing of stable record keys.

Every record scores every shard from a hash of (key, shard) alone and goes to
the best, so a new shard takes records only into itself and a removed shard
hands out only its own. Built of column functions.

Law: ``key``. The key and the shards decide; equal texts under different keys
may part. Defined results: a null text has size 1 and checksum 0; a null key is
hashed as the text "null"; rows with one key share a shard; an empty table
gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import ranked

#: Hex digits of the digest that become a number; 52 bits fit a double exactly.
HEX_DIGITS = 13


def score(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1) from the hash of key and shard; the smallest wins."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")))
    u = (F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**HEX_DIGITS))
    return -F.ln(u) / F.lit(float(weight))


def shard_of(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a text key; a tie of scores goes to the lower shard number."""
    scored = [F.struct(score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in sorted(weights.items())]
    return F.array_min(F.array(*scored))["shard"]


def sharded(
    docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float], id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    ``weights`` gives the shards and their shares, ``grown`` those after one
    more is added. ``slot`` numbers the rows of a shard from 0 without a gap, in
    order of (doc_id, size, checksum). The numbering sorts narrow rows by range,
    so a shard is as many tasks as its rows need.
    """
    text, key = F.col(text_col), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        shard_of(key, weights).alias("shard"),
        shard_of(key, grown).alias("grown_shard"),
    )
    order = [F.col("shard"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    placed = ranked(rows, order, "_rank")
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))
    out = placed.join(F.broadcast(first), "shard")  # one row per shard, and the caller lists the shards
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_rank") - F.col("_first")).alias("slot"), "grown_shard",
    )
