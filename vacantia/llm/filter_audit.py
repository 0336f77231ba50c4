"""Audit of how corpus filters overlap, for every order they could run in.

Each document is reduced to a mask of the filters it fails. In an order, the
first failing filter removes it, so for a fixed step the orders in which that
happens are those that begin with filters it passes, followed by one it fails.
All orders with one beginning are an interval of lexicographic (Lehmer) ranks.
Counts per part and mask are added at the ends of these intervals, and one
prefix sum over the 120 ranks gives what every step of every order removes.

Only counts per (part, mask) meet the intervals: 32 masks and a fixed table of
ranks, whatever the number of documents.

Defined results: a null text is the empty text; a null source is part ""; equal
rows count one by one; a document without an id has no smaller ids and is none,
so it never fails E; a document counts as good or toxic if any of its labels says
so; an empty table gives no rows; texts of any length are read whole; columns
beyond doc_id, text and source are not read, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.operators.scale import salted_join
from vacantia.session import settled

FILTERS = "ABCDE"
#: Blanks between words: x20 and x09-x0D.
BLANKS = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n", "good", "toxic")


def own_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that a text decides alone."""
    words = F.split(F.btrim(text, F.lit(BLANKS)), r"[\x20\x09-\x0D]+")
    n = F.when(F.btrim(text, F.lit(BLANKS)) == "", 0).otherwise(F.size(words))
    distinct = F.when(n == 0, 0).otherwise(F.size(F.array_distinct(words)))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": n < 50,
        "B": 100 * distinct < 65 * n,
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def shuffled(keyed: DataFrame) -> DataFrame:
    """The one-row side of a salted join, kept out of the driver: the size of its files says nothing of its 16 copies in memory."""
    return keyed.hint("merge")


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): how many equal rows fail the filters in ``mask`` (bit i for filter i)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.when(failed, 1 << FILTERS.index(name)).otherwise(0) for name, failed in own_failures(F.col("text")).items()]
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    narrow = settled(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    firsts = narrow.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).filter("_first < _last")
    seen = salted_join(narrow, shuffled(settled(firsts.select("digest", "_first"), "audit-firsts")), ["digest"], "left")
    repeated = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))
    return seen.select("doc_id", "part", F.when(repeated, F.col("mask") + (1 << FILTERS.index("E"))).otherwise(F.col("mask")).alias("mask"), "n")


def intervals() -> list[tuple[int, int, int, int]]:
    """(mask, step, low, high): a document with this mask goes at this step in the orders of rank low to high - 1."""
    out = []
    for mask in range(1, 1 << len(FILTERS)):
        failed = [bool(mask >> i & 1) for i in range(len(FILTERS))]
        for step in range(1, len(FILTERS) + 1):
            for order in permutations(range(len(FILTERS)), step):
                if failed[order[-1]] and not any(failed[i] for i in order[:-1]):
                    low = lehmer(order)
                    out.append((mask, step, low, low + factorial(len(FILTERS) - step)))
    return out


def lehmer(order: tuple[int, ...]) -> int:
    """Rank of the first of all lexicographic permutations that begin with ``order``."""
    free = list(range(len(FILTERS)))
    rank = 0
    for i in order:
        rank += free.index(i) * factorial(len(free) - 1)
        free.remove(i)
    return rank


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, with what the step keeps, removes and costs."""
    spark = docs.sparkSession
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("_toxic"),
    )
    rows = salted_join(masked(docs), shuffled(settled(known, "audit-labels")), ["doc_id"], "left")
    cells = rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.col("n") * F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in COUNTS[1:]],
    )
    cells = settled(cells, "audit-cells")

    ends = [(m, s, at, sign) for m, s, low, high in intervals() for at, sign in ((low, 1), (high, -1))]
    ends = spark.createDataFrame(ends, "mask int, step int, rank int, sign int")  # a fixed table of the masks and ranks
    steps = cells.join(ends, "mask").groupBy("part", "step", "rank").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in COUNTS])

    orders = ["".join(p) for p in permutations(FILTERS)]
    grid = spark.createDataFrame([(r, s, o, o[s - 1]) for r, o in enumerate(orders) for s in range(1, len(FILTERS) + 1)], "rank int, step int, filter_order string, filter string")
    totals = [F.sum("n").alias("_all")]
    for i, f in enumerate(FILTERS):
        totals += [
            F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)).alias(f"_fails_{f}"),
            F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias(f"_only_{f}"),
        ]
    parts = cells.groupBy("part").agg(*totals)
    # every part has the same 600 rows: the orders and steps are laid out by an explode, not by a join
    layout = F.array(*[F.lit(r) for r in range(len(orders))])
    wide = parts.withColumn("rank", F.explode(layout)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    wide = wide.join(grid, ["rank", "step"]).join(steps, ["part", "step", "rank"], "left")

    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = wide.select("part", "rank", "step", "filter_order", "filter", *[c for c in parts.columns if c != "part"], *[F.sum(F.coalesce(c, F.lit(0))).over(along).alias(c) for c in COUNTS])
    inside = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    of_filter = lambda kind: F.coalesce(*[F.when(F.col("filter") == f, F.col(f"_{kind}_{f}")) for f in FILTERS])
    return summed.select(
        "part", "filter_order", "step", "filter",
        (F.col("_all") - F.sum("n").over(inside)).alias("kept"),
        F.col("n").alias("removed"),
        (of_filter("fails") - F.col("n")).alias("redundant"),
        of_filter("only").alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )
