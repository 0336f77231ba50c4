"""A table kept as a base plus the changes of each micro-batch.

Each batch writes only its changed rows into its own folder, and writing the
same batch again replaces that folder, so a retried batch has no double effect.
Readers take the latest row per key. Every FOLD_EVERY batches the state is
written as a new base beside the log, so a batch reads a bounded number of
earlier ones; a fold that was cut off has no success file and is written anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators.scale import keep_first
from vacantia.session import folders

#: Batches between two folds of a log.
FOLD_EVERY = 8


class ChangeLog:
    """Latest-row-per-key view over ``root/base`` and ``root/batch=N``."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: str):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        self.schema = schema

    def start(self, base: DataFrame) -> None:
        base.write.mode("overwrite").parquet(f"{self.root}/batch=-1")

    def write(self, changes: DataFrame, batch_id: int) -> None:
        changes.write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}")

    def rows(self, before: int | None = None) -> DataFrame:
        """All change rows, or those of the batches before one."""
        rows = self.spark.read.schema(f"{self.schema}, batch int").parquet(self.root)
        return rows if before is None else rows.filter(F.col("batch") < before)

    def current(self, before: int | None = None) -> DataFrame:
        """Base rows without a change, and the latest change per key; the state before a batch if one is given.

        The changes are small beside the base, so the base is filtered by their
        keys and not shuffled; folding keeps them small.
        """
        fold = max((n for n in self._folds() if before is None or n <= before), default=None)
        if before is not None and before - (fold or 0) >= FOLD_EVERY:
            self._state(before, fold).write.mode("overwrite").parquet(f"{self.root}-folds/{before}")
            fold = before
        return self._state(before, fold)

    def _folds(self) -> list[int]:
        return [int(name) for name in folders(self.spark, f"{self.root}-folds")]

    def _state(self, before: int | None, fold: int | None) -> DataFrame:
        rows = self.rows(before)
        changes = rows.filter(F.col("batch") >= (fold or 0))
        latest = keep_first(changes, self.keys, [F.col("batch").desc()]).drop("batch")
        if fold is None:
            base = rows.filter("batch < 0").drop("batch")
        else:
            base = self.spark.read.schema(self.schema).parquet(f"{self.root}-folds/{fold}")
        kept = base.join(changes.select(*self.keys), self.keys, "left_anti")
        return kept.select(*latest.columns).unionByName(latest)

    def compact(self, batch_id: int, target: str) -> "ChangeLog":
        """Write the state after a batch as the base of a new log."""
        fresh = ChangeLog(self.spark, target, self.keys, self.schema)
        fresh.start(self.current(batch_id + 1))
        return fresh


class PartialLog(ChangeLog):
    """Sums per key over all batches: each batch adds its own partial rows, of whatever age."""

    def _state(self, before: int | None, fold: int | None) -> DataFrame:
        rows = self.rows(before)
        parts = rows.filter(F.col("batch") >= (fold or -1)).drop("batch")
        if fold is not None:
            parts = parts.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.root}-folds/{fold}"))
        sums = [c for c in parts.columns if c not in self.keys]
        types = dict(parts.dtypes)
        return parts.groupBy(*self.keys).agg(*[F.sum(c).cast(types[c]).alias(c) for c in sums])
