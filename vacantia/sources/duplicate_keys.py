"""The duplicate keys of stored postings, kept beside them.

Every posting has its (tier, scope, k) rows in a table that is bucketed by these
columns. A batch is dealt to the same buckets and meets its candidates there, so
the stored side is neither normalised nor shuffled again. Changes are appended:
new keys as live rows, keys that a posting had before as dead ones; of the rows
of a key and posting the latest batch counts, and in one batch a live row. A batch
that is written twice leaves the same keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators import dedupe, scale

#: Postings a bucket has at the start; one posting has up to seven keys.
BUCKET_POSTINGS = 50_000
COLUMNS = "tier INT, scope BIGINT, k STRING, id BIGINT, discovered_at TIMESTAMP, batch INT, live BOOLEAN"
KEY = ["tier", "scope", "k"]


def buckets_for(stored: DataFrame) -> int:
    """Buckets of a key table, so that a task's keys don't grow with the table."""
    return scale.parts_of(stored.select("id"), BUCKET_POSTINGS)


class KeyTable:
    """Keys at ``path``, in ``buckets`` buckets; the number stays the same for the life of the table."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"duplicate_keys_{uuid.uuid4().hex}"
        # the catalog of a session may not outlive it, the files do: their names hold their buckets
        spark.sql(
            f"CREATE TABLE {self.name} ({COLUMNS}) USING parquet CLUSTERED BY ({', '.join(KEY)}) SORTED BY (tier) "
            f"INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def _append(self, keys: DataFrame, batch: int) -> None:
        rows = keys.select(*KEY, "id", "discovered_at", F.lit(batch).alias("batch"), "live").repartition(self.buckets, *KEY)
        rows.write.insertInto(self.name)

    def start(self, stored: DataFrame) -> KeyTable:
        """Keys of the postings there are."""
        self._append(dedupe.stored_keys(stored).withColumn("live", F.lit(True)), 0)
        return self

    def change(self, before: DataFrame, after: DataFrame, batch: int) -> None:
        """Keys of postings that are new or have changed; ``before`` holds what the changed ones were."""
        old = dedupe.stored_keys(before).withColumn("live", F.lit(False))
        self._append(old.unionByName(dedupe.stored_keys(after).withColumn("live", F.lit(True))), batch)

    def rows(self, before: int | None = None) -> DataFrame:
        """(tier, scope, k, id, discovered_at) of the keys that hold, or that held before a batch."""
        self.spark.catalog.refreshTable(self.name)
        found = self.spark.table(self.name)
        if before is not None:
            found = found.filter(F.col("batch") < before)
        last = found.groupBy(*KEY, "id").agg(F.max(F.struct("batch", "live", "discovered_at")).alias("last"))
        return last.filter("last.live").select(*KEY, "id", "last.discovered_at")

    def first_rows(self) -> DataFrame:
        """The keys as they were at the start: no change to look for."""
        return self.spark.table(self.name).filter("batch = 0").select(*KEY, "id", "discovered_at")
