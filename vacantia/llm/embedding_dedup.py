"""Near-duplicate embeddings by epsilon grid order join.

Unit vectors within cosine t lie within epsilon = sqrt(2 - 2 t). Their
coordinates on the leading principal directions are cut into grid cells as wide
as epsilon, and vectors are sorted by label and cells. The sorted sequence is cut
into blocks of BLOCK vectors with a bounding box each. Intervals of blocks are
joined recursively, FAN_OUT parts at a time: a pair of intervals with no label in
common or with boxes further apart than epsilon is skipped, for the distance in
some directions is never more than the whole distance. What is left are pairs of
blocks whose cosines are computed in double precision.

Equal vectors of a label are one class with one representative and a size, so
copies are counted, not compared. A pair of blocks hands out, per vector, the
number of links, and links that span what is connected, never all pairs.

The directions come from a sample of SAMPLE vectors; they decide what is skipped
and never what is found. Defined results: null, zero or non-finite vectors, and
vectors with a null label, link with nothing; vectors of different lengths don't
link; rows that share an id and a vector count as one; a null id links with
nothing and is kept with a null component; an empty table gives an empty table;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import components, forest, ranked, tune_arrow
from vacantia.session import settled

#: Leading directions whose grid cells give the order.
DIRECTIONS = 6
BLOCK = 256
FAN_OUT = 8
SAMPLE = 4096
UNIT_SCHEMA = "vec_id bigint, label string, class binary, width int, unit binary"


def unit_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of length 1 as bytes, and a digest that equal vectors share; null for those that can't link."""
    for batch in batches:
        labels = batch.column("label").to_pylist()
        classes, widths, units = [], [], []
        for vec_id, label, values in zip(batch.column("vec_id").to_pylist(), labels, batch.column("vector").to_pylist()):
            unit = None
            if vec_id is not None and label is not None and values and None not in values:
                x = np.array(values, np.float64)
                top = np.abs(x).max()
                if np.isfinite(x).all() and top > 0:
                    unit = x / top
                    unit = unit / np.linalg.norm(unit)
            classes.append(None if unit is None else hashlib.sha256(np.array(values, np.float64).tobytes()).digest())
            widths.append(None if unit is None else len(unit))
            units.append(None if unit is None else unit.tobytes())
        yield pa.record_batch(
            [batch.column("vec_id"), batch.column("label"), pa.array(classes, pa.binary()), pa.array(widths, pa.int32()), pa.array(units, pa.binary())],
            names=["vec_id", "label", "class", "width", "unit"],
        )


def principal_directions(sample: list[bytes], count: int = DIRECTIONS) -> np.ndarray:
    """Leading eigenvectors of the covariance, (width, count)."""
    x = np.array([np.frombuffer(b) for b in sample])
    _, vectors = np.linalg.eigh(np.cov(x.T).reshape(x.shape[1], x.shape[1]) if len(x) > 1 else np.eye(x.shape[1]))
    return vectors[:, ::-1][:, :count]


def placed(directions, epsilon: float):
    """Coordinates on the directions, for vectors as wide as those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_width = directions.value
        for batch in batches:
            points = []
            for width, unit in zip(batch.column("width").to_pylist(), batch.column("unit").to_pylist()):
                point = np.frombuffer(unit) @ by_width[width]
                points.append(np.pad(point, (0, DIRECTIONS - len(point))))
            points = np.array(points).reshape(-1, DIRECTIONS)
            cells = np.floor(points / epsilon).astype(np.int32)
            columns = [*(batch.column(n) for n in batch.schema.names), *(pa.array(cells[:, i]) for i in range(DIRECTIONS)), *(pa.array(points[:, i]) for i in range(DIRECTIONS))]
            names = [*batch.schema.names, *(f"c{i}" for i in range(DIRECTIONS)), *(f"p{i}" for i in range(DIRECTIONS))]
            yield pa.record_batch(columns, names=names)

    return run


def compare(threshold: float):
    """Arrow function: pairs of blocks in; links per vector (b null) and spanning links (n null) out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column("i")[row].as_py() == batch.column("j")[row].as_py()
                yield from block_pair(unpacked(batch, "left", row), unpacked(batch, "right", row), same, threshold)

    return run


def unpacked(batch: pa.RecordBatch, name: str, row: int) -> tuple[np.ndarray, np.ndarray, list, list[bytes]]:
    block = batch.column(name)[row].values
    return block.field("rep").to_numpy(), block.field("size").to_numpy(), block.field("label").to_pylist(), block.field("unit").to_pylist()


def block_pair(left, right, same: bool, threshold: float) -> Iterator[pa.RecordBatch]:
    names = sorted(set(zip(left[2], map(len, left[3]))) & set(zip(right[2], map(len, right[3]))))
    counts: dict[int, int] = {}
    edges: list[tuple[int, int]] = []
    for label, width in names:
        a = [k for k, (x, u) in enumerate(zip(left[2], left[3])) if x == label and len(u) == width]
        b = [k for k, (x, u) in enumerate(zip(right[2], right[3])) if x == label and len(u) == width]
        x = np.array([np.frombuffer(left[3][k]) for k in a])
        y = x if same else np.array([np.frombuffer(right[3][k]) for k in b])
        near = x @ y.T >= threshold
        if same:
            near = np.triu(near, 1)
        if not near.any():
            continue
        ids_a, ids_b = left[0][a], right[0][b]
        for ids, sizes in ((ids_a, near @ right[1][b]), (ids_b, left[1][a] @ near)):
            for k in np.flatnonzero(sizes).tolist():
                counts[int(ids[k])] = counts.get(int(ids[k]), 0) + int(sizes[k])
        p, q = np.nonzero(near)
        shift = 0 if same else len(a)
        both = np.concatenate([ids_a, ids_b])
        edges.extend((int(both[s]), int(both[t])) for s, t in forest(len(both), p, q + shift))
    yield pa.record_batch(
        [
            pa.array([*counts, *(e[0] for e in edges)], pa.int64()),
            pa.array([*[None] * len(counts), *(e[1] for e in edges)], pa.int64()),
            pa.array([*counts.values(), *[None] * len(edges)], pa.int64()),
        ],
        names=["a", "b", "n"],
    )


def near_embeddings(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links of equal label and cosine of at least ``threshold``."""
    spark = tune_arrow(vectors.sparkSession)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"),
    )
    units = settled(rows.mapInArrow(unit_vectors, UNIT_SCHEMA), "units")
    able = units.filter("class IS NOT NULL")
    member = able.select("vec_id", "label", "class").distinct()
    classes = member.groupBy("label", "class").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    classes = settled(classes, "classes")
    reps = able.join(classes, (able["class"] == classes["class"]) & (able.label == classes.label) & (able.vec_id == classes.rep))
    reps = reps.select("rep", able.label, able["class"], "size", "width", "unit").dropDuplicates(["rep", "class", "label"])

    found = settled(block_links(spark, reps, threshold), "links")
    roots = components(
        found.filter("b IS NOT NULL").select("a", "b").unionByName(
            member.join(classes, ["label", "class"]).filter("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
        ),
        "near",
    )
    others = found.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("others"))
    linked = classes.join(others, classes.rep == others.a, "left")
    by_class = linked.select("label", "class", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    per_vector = member.join(by_class, ["label", "class"]).groupBy("vec_id").agg(F.max("links").alias("links"))
    known = per_vector.join(roots, per_vector.vec_id == roots.node, "left").select("vec_id", "links", "component")
    out = units.select("vec_id").join(known, "vec_id", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def block_links(spark, reps: DataFrame, threshold: float) -> DataFrame:
    """Links between representatives: counts and spanning links of all pairs of blocks that aren't provably distant."""
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    reps = settled(reps, "reps")
    by_width = {}
    for (width,) in reps.select("width").distinct().collect():  # as many as there are vector lengths
        own = reps.filter(F.col("width") == width)
        sample = own.select("unit", F.xxhash64("class").alias("h")).orderBy("h").limit(SAMPLE).collect()
        by_width[width] = principal_directions([bytes(r["unit"]) for r in sample])
    directions = spark.sparkContext.broadcast(by_width)
    extra = "".join(f", c{i} int" for i in range(DIRECTIONS)) + "".join(f", p{i} double" for i in range(DIRECTIONS))
    schema = "rep bigint, label string, class binary, size bigint, width int, unit binary" + extra
    points = reps.mapInArrow(placed(directions, epsilon), schema)
    order = [F.col("label"), F.col("width"), *(F.col(f"c{i}") for i in range(DIRECTIONS)), F.col("rep")]
    inside = ranked(points, order, "at").withColumn("block", F.floor(F.col("at") / BLOCK))
    inside = settled(inside.drop("class", "width", *(f"c{i}" for i in range(DIRECTIONS))), "grid")
    pairs = near_blocks(inside, epsilon)
    packed = inside.groupBy("block").agg(F.collect_list(F.struct("rep", "size", "label", "unit")).alias("vectors"))  # BLOCK rows
    left = packed.select(F.col("block").alias("i"), F.col("vectors").alias("left"))
    right = packed.select(F.col("block").alias("j"), F.col("vectors").alias("right"))
    work = pairs.join(left, "i").join(right, "j")
    return work.mapInArrow(compare(threshold), "a bigint, b bigint, n bigint")


def near_blocks(inside: DataFrame, epsilon: float) -> DataFrame:
    """Pairs (i <= j) of blocks that may hold a link, by recursive halving of the interval pairs."""
    bounds = [f for i in range(DIRECTIONS) for f in (F.min(f"p{i}").alias(f"lo{i}"), F.max(f"p{i}").alias(f"hi{i}"))]
    bounds += [F.min("label").alias("first"), F.max("label").alias("last")]
    boxes = settled(inside.groupBy("block").agg(*bounds), "boxes")
    count = boxes.count()
    depth = max(0, math.ceil(math.log(max(count, 1)) / math.log(FAN_OUT) - 1e-9))
    again = [f for i in range(DIRECTIONS) for f in (F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}"))]
    again += [F.min("first").alias("first"), F.max("last").alias("last")]
    pairs = boxes.sparkSession.range(1).select(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    for level in range(depth - 1, -1, -1):
        part = boxes.groupBy(F.floor(F.col("block") / FAN_OUT**level).alias("part")).agg(*again)
        part = part.withColumn("whole", F.floor(F.col("part") / FAN_OUT))
        a = part.select(F.col("whole").alias("i"), *[F.col(c).alias(f"a_{c}") for c in part.columns if c != "whole"])
        b = part.select(F.col("whole").alias("j"), *[F.col(c).alias(f"b_{c}") for c in part.columns if c != "whole"])
        met = pairs.join(a, "i").join(b, "j").filter("a_part <= b_part AND a_first <= b_last AND b_first <= a_last")
        gaps = [F.greatest(F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}"), F.lit(0.0)) for i in range(DIRECTIONS)]
        near = met.filter(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]) <= epsilon * epsilon)
        pairs = near.select(F.col("a_part").alias("i"), F.col("b_part").alias("j"))
    return pairs
