"""Removal of byte strings that also start earlier, by distributed prefix doubling.

A window is a string of LENGTH bytes inside one text. Sorting every position by
the rank of its first h bytes, then by the pair of its rank and the rank h bytes
on, tells which windows are equal after a few rounds; positions whose rank is
unique can't be repeats and leave early. One row per byte and round would be many
times the size of the corpus, so the positions of a round are blocks of windows:

1. Every window points to its least 32-byte rank (the leftmost of equal ones).
   The windows that point to one place are a block, about one in 35 bytes.
2. What is left is cut, at distances from that place, into blocks of 8 windows.
3. What is left of these is single windows.

In each round a row is a position with two ranks: that of the bytes which all its
windows share (``core``: 32, then 93, then the first 50 of 100 bytes) and that of
the bytes which they cover (``hull``). Spark sorts the pairs with their places
over range partitions, so that a hot string spreads over as many tasks as it
needs. In that order:

* a core that occurs once leaves: none of its windows occurs twice;
* a hull that has occurred at an earlier place is past the threshold: all its
  windows are repeats, and copies of it need not be looked at again;
* the first place of a hull goes on to the next round if its core has another
  hull too. The earliest occurrence of every window is among these.

Ranks of 2h bytes are made from those of h bytes at offset h, as numbers of 64
bits that mean the same in every task; what is removed rests on pairs, 128 bits.

Order of places: doc_id, then the text's hash among documents that share an id,
then the offset. Defined results: a null text is the empty text; a text of less
than LENGTH bytes keeps everything; a null id counts as the largest; of rows that
share id and text one is the first and the others lose every window; an empty
table gives an empty table; texts of any length are read whole; ids are whole
numbers (a text id raises); columns beyond doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.common import binaries, mixed, tune_arrow
from vacantia.session import settled, work_path

#: Bytes of a window, of the first rank, and windows of a block in the second round.
LENGTH = 100
FIRST = 32
BLOCK = 8
#: Longest power of two that is ranked.
WIDE = 64
#: Starts within a window at which the first rank can stand.
SPREAD = LENGTH - FIRST + 1
#: Low bits that hold a place while least ranks are sought; the rest orders the ranks.
PLACE_BITS = np.uint64(31)
PLACE_MASK = np.uint64((1 << 31) - 1)
#: Bytes of text worked on at a time; one longer text is worked on alone.
SLICE = 1 << 17
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

KEY = "doc_id bigint, tie bigint"
RANKS = "core bigint, hull bigint"
PLACE = "start int, count int"


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The rank of two neighbouring strings from their ranks."""
    x = left * _A
    x += right
    x *= _B
    x ^= x >> np.uint64(29)
    return x


def doubled(data: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Ranks of the strings of 1, 2, 4, ... up to ``most`` bytes at every position that has as many bytes after it."""
    ranks = {1: mixed((data.astype(np.uint64) + np.uint64(1)) * _A)}
    size = 1
    while size * 2 <= most and size * 2 <= len(data):
        r = ranks[size]
        ranks[size * 2] = joined(r[:-size], r[size:])
        size *= 2
    return ranks


def ranks_of(ranks: dict[int, np.ndarray], start: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the strings of ``length`` bytes at the starts: two overlapping powers of two."""
    size = 1 << length.bit_length() - 1
    return joined(ranks[size][start], ranks[size][start + length - size])


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of every ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    rest = width - size
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def anchors(first: np.ndarray) -> np.ndarray:
    """For every window the position of its least first rank, the leftmost of equal ones."""
    keys = first & ~PLACE_MASK
    keys |= np.arange(len(first), dtype=np.uint64)
    keys = least(keys, SPREAD)
    keys &= PLACE_MASK
    return keys.view(np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of about SLICE bytes at a time, with the values of the column."""
    for batch in batches:
        texts = binaries(batch[column])
        start = used = 0
        for i, text in enumerate(texts):
            if i > start and used + len(text) > SLICE:
                yield batch.slice(start, i - start), texts[start:i]
                start, used = i, 0
            used += len(text)
        if texts[start:]:
            yield batch.slice(start), texts[start:]


def starts_of(texts: list[bytes]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 1: neighbouring windows with one least rank, as (core, hull, doc_id, tie, start, count, loose).

    ``loose`` marks rows in which the rank stands more than once, as in periodic
    text: their windows may repeat each other.
    """
    for batch, texts in slices(batches, "text"):
        begin = starts_of(texts)
        data = np.frombuffer(b"".join(texts), np.uint8)
        if len(data) < LENGTH:
            continue
        ranks = doubled(data, WIDE)
        at = anchors(ranks[FIRST])
        value = ranks[FIRST][at]
        change = np.empty(len(at), bool)
        change[0] = True
        np.not_equal(value[1:], value[:-1], out=change[1:])
        real = np.ones(len(at), bool)
        for first, after in zip(begin[:-1].tolist(), begin[1:].tolist()):  # windows that reach into the next text
            beyond = max(first, after - LENGTH + 1)
            real[beyond:after] = False
            change[beyond : beyond + 1] = change[after : after + 1] = True
        cut = np.flatnonzero(change)
        end = np.append(cut[1:], len(at))
        own = real[cut]
        cut, end = cut[own], end[own]
        if not len(cut):
            continue
        row = np.searchsorted(begin, cut, "right") - 1
        loose = (at[cut] != at[end - 1]) | (end - cut > SPREAD)
        size = end - cut + LENGTH - 1
        # three strings of 64 bytes cover up to 192; only loose rows can be longer
        near = np.minimum(size, 3 * WIDE) - WIDE
        hull = joined(joined(ranks[WIDE][cut], ranks[WIDE][cut + near // 2]), ranks[WIDE][cut + near])
        for i in np.flatnonzero(size > 3 * WIDE).tolist():
            hull[i] = xxhash.xxh3_64_intdigest(data[cut[i] : cut[i] + size[i]])
        hull = joined(hull, size.astype(np.uint64))
        own = row
        yield pa.RecordBatch.from_arrays(
            [signed(value[cut]), signed(hull), batch["doc_id"].take(pa.array(own)), batch["tie"].take(pa.array(own)), pa.array((cut - begin[own]).astype(np.int32)), pa.array((end - cut).astype(np.int32)), pa.array(loose)],
            ["core", "hull", "doc_id", "tie", "start", "count", "loose"],
        )


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 2: windows of a piece whose distances to their least rank fall into one block of distances.

    A row's place is the start of the whole block; its own windows begin ``skip`` later.
    """
    for batch, texts in slices(batches, "piece"):
        begin = starts_of(texts)
        data = np.frombuffer(b"".join(texts), np.uint8)
        ranks = doubled(data, WIDE)
        at = anchors(ranks[FIRST])
        place = np.arange(len(at))
        row = np.repeat(np.arange(len(texts)), np.diff(begin))[: len(at)]
        margin, count = batch["margin"].to_numpy()[row], batch["count"].to_numpy()[row]
        own = (place >= begin[row] + margin) & (place < begin[row] + margin + count)
        block = (at - place) // BLOCK
        change = (at[1:] != at[:-1]) | (block[1:] != block[:-1]) | (row[1:] != row[:-1]) | (own[1:] != own[:-1])
        cut = np.flatnonzero(np.concatenate(([True], change)))
        end = np.append(cut[1:], len(at))
        real = own[cut]
        cut, end = cut[real], end[real]
        r = row[cut]
        high = at[cut] - block[cut] * BLOCK  # the last window of the whole block, whose start all windows share
        low = high - BLOCK + 1
        core = ranks_of(ranks, high, LENGTH - BLOCK + 1)
        whole = (low >= begin[r]) & (high + LENGTH <= begin[r + 1])
        shift = begin[r] + margin[cut] - batch["start"].to_numpy()[r]  # from a place in the text to one in the data
        start = (low - shift).astype(np.int32)
        ids = [batch[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "tie")]
        # a block that reaches over the ends of its piece has a hull like no other
        alone = joined(joined(mixed(ids[0][r].view(np.uint64)), ids[1][r].view(np.uint64)), (cut - shift).astype(np.uint64))
        hull = np.where(whole, joined(ranks_of(ranks, np.where(whole, low, 0), LENGTH), ranks_of(ranks, np.where(whole, high, 0), LENGTH)), alone)
        yield pa.RecordBatch.from_arrays(
            [signed(core), signed(hull), batch["doc_id"].take(pa.array(r)), batch["tie"].take(pa.array(r)), pa.array(start), pa.array((end - cut).astype(np.int32)), pa.array((cut - low).astype(np.int32)), batch["start"].take(pa.array(r))],
            ["core", "hull", "doc_id", "tie", "start", "count", "skip", "home"],
        )


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 3: single windows with the ranks of their halves."""
    half = LENGTH // 2
    for batch, texts in slices(batches, "piece"):
        begin = starts_of(texts)
        ranks = doubled(np.frombuffer(b"".join(texts), np.uint8), half)
        wanted = batch["wanted"]
        sizes = wanted.value_lengths().to_numpy()
        r = np.repeat(np.arange(len(texts)), sizes)
        flat = wanted.flatten()
        first, count = (flat.field(k).to_numpy() for k in ("start", "count"))
        start = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        r = np.repeat(r, count)
        place = start - batch["start"].to_numpy()[r] + batch["margin"].to_numpy()[r] + begin[r]
        yield pa.RecordBatch.from_arrays(
            [signed(ranks_of(ranks, place, half)), signed(ranks_of(ranks, place + half, half)), batch["doc_id"].take(pa.array(r)), batch["tie"].take(pa.array(r)), pa.array(start.astype(np.int32)), pa.array(np.ones(len(r), np.int32))],
            ["core", "hull", "doc_id", "tie", "start", "count"],
        )


def reranked(rows: DataFrame, label: str) -> DataFrame:
    """Rows of a round that are repeats or open, with ``repeat`` true or false; the others have left.

    Range partitions are sorted by (core, hull, place). Only the first row of a
    partition and the first place of its last hull depend on other partitions;
    these few rows (at most two places a partition) are settled afterwards.
    """
    order = [F.col(c) for c in ("core", "hull", "doc_id", "tie", "start", "skip") if c in rows.columns]
    kept = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(verdicts(rows.columns), f"{_ddl(rows)}, verdict int"), label)
    sure = kept.filter(F.col("verdict") != EDGE).withColumn("repeat", F.col("verdict") == REPEAT)
    place = F.struct("doc_id", "tie", "start")
    edge = kept.filter(F.col("verdict") == EDGE)
    same = Window.partitionBy("core", "hull")
    edge = edge.withColumn("repeat", place > F.min(place).over(same))
    return sure.unionByName(edge).drop("verdict")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


GONE, OPEN, REPEAT, EDGE = -1, 0, 1, 2


def verdicts(columns: list[str]):
    """Reads one sorted partition and yields its repeats, open rows and edges.

    Only the first row of a batch's last hull is carried on: its verdict waits
    until the next hull is seen, or the partition ends and makes it an edge.
    Equal rows (of documents that share id and text) count once; rows that stand
    for other windows of the first place stay open.
    """
    extra = [c for c in ("skip",) if c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.RecordBatch | None = None
        several_before, begins = False, True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch if carry is None else pa.concat_batches([carry, batch])
            core, hull = table["core"].to_numpy(), table["hull"].to_numpy()
            places = [table[c].to_numpy() for c in ("doc_id", "tie", "start")]
            new_core = np.concatenate(([True], core[1:] != core[:-1]))
            new_hull = new_core | np.concatenate(([True], hull[1:] != hull[:-1]))
            parts = places + [table[c].to_numpy() for c in extra]
            new_row = new_hull | np.concatenate(([True], np.logical_or.reduce([p[1:] != p[:-1] for p in parts])))
            group, classes = np.cumsum(new_hull) - 1, np.cumsum(new_core) - 1
            several = (np.bincount(classes, weights=new_hull) > 1)[classes]
            several |= (classes == 0) & several_before
            if "loose" in columns:
                several |= table["loose"].to_numpy(zero_copy_only=False)
            head = np.flatnonzero(new_hull)[group]
            later = np.logical_or.reduce([p != p[head] for p in places])
            verdict = np.where(later, REPEAT, np.where(several | ~new_hull, OPEN, GONE))
            verdict[~new_row] = GONE
            if begins:
                verdict[0] = EDGE
            last = np.flatnonzero(new_hull)[-1]
            verdict[last] = GONE
            several_before = not new_core[last] or (classes[last] == 0 and several_before)
            begins = begins and group[last] == 0
            carry = table.slice(last, 1)
            keep = np.flatnonzero(verdict != GONE)
            yield marked(table.take(pa.array(keep)), verdict[keep])
        if carry is not None:
            yield marked(carry, np.array([EDGE]))

    def marked(table: pa.RecordBatch, verdict: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[table[c] for c in columns], pa.array(verdict.astype(np.int32))], [*columns, "verdict"])

    return run


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, so that their shuffles are small."""
    press = zstandard.ZstdCompressor()
    for batch in batches:
        small = pa.array([press.compress(t) for t in binaries(batch["text"])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tie"], batch["id"], small], ["doc_id", "tie", "id", "packed"])


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the open rows of every text, with the blocks at their ends."""
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        starts, counts, sizes = listed(batch["open"])
        own = np.repeat(np.arange(batch.num_rows), sizes)
        margins = np.minimum(starts, BLOCK - 1)
        ends = starts + counts + LENGTH + BLOCK - 2
        cut, text, of = [], b"", -1
        small = batch["packed"]
        for i, a, z in zip(own.tolist(), (starts - margins).tolist(), ends.tolist()):
            if i != of:
                text, of = expand.decompress(small[i].as_py()), i
            cut.append(text[a:z])
        own = pa.array(own)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"].take(own), batch["tie"].take(own), pa.array(starts), pa.array(counts), pa.array(margins.astype(np.int32)), pa.array(cut, pa.binary())],
            ["doc_id", "tie", "start", "count", "margin", "piece"],
        )


def listed(windows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and counts of all windows of a batch, and how many each row has."""
    sizes = windows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = windows.flatten()
    return flat.field("start").to_numpy(), flat.field("count").to_numpy(), sizes


def runs_of(windows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that the windows of each row cover: row, start and end."""
    starts, counts, sizes = listed(windows)
    row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) << 32
    first, after = row + starts, row + starts + counts + LENGTH - 1
    order = np.argsort(first, kind="stable")
    first, after = first[order], np.maximum.accumulate(after[order])
    new = np.concatenate(([True], first[1:] > after[:-1]))[: len(first)]
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(first))[: len(begin)] - 1
    first, after = first[begin], after[last]
    return first >> 32, first & 0xFFFFFFFF, after & 0xFFFFFFFF


def remainders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every text's removed runs and the bytes that stay."""
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        sizes, kept = [], []
        row, first, after = runs_of(batch["windows"])
        offsets = np.searchsorted(row, np.arange(batch.num_rows + 1))
        edges = np.stack([first, after], axis=1)
        for i, small in enumerate(batch["packed"]):
            text = expand.decompress(small.as_py())
            sizes.append(len(text))
            if offsets[i] < offsets[i + 1]:
                inner = [0, *edges[offsets[i] : offsets[i + 1]].ravel().tolist(), len(text)]
                text = b"".join([text[a:z] for a, z in zip(inner[::2], inner[1::2])])
            kept.append(text)
        span = pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array(after.astype(np.int32))], ["start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), span)
        yield pa.RecordBatch.from_arrays(
            [batch["id"], batch["copies"], pa.array(sizes, pa.int64()), spans, pa.array(kept, pa.binary())],
            ["doc_id", "copies", "n_bytes", "spans", "kept"],
        )


def written(df: DataFrame, label: str) -> DataFrame:
    """As ``settled``, in a smaller format."""
    path = work_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def repeats_removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the removed runs of every text and the bytes that stay."""
    spark = tune_arrow(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8192")  # narrow rows; texts are bounded by bytes
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"))
    place = F.coalesce(F.col("id"), F.lit((1 << 63) - 1)).alias("doc_id")
    shared_ids = not rows.select(place).groupBy("doc_id").count().filter("count > 1").isEmpty()
    tie = F.xxhash64("text", F.col("id").isNull()) if shared_ids else F.lit(0).cast("long")
    rows = rows.select(place, tie.alias("tie"), "id", "text")
    texts = rows.mapInArrow(packed, f"{KEY}, id bigint, packed binary")
    if shared_ids:
        texts = texts.groupBy("doc_id", "tie").agg(F.first("id").alias("id"), F.first("packed").alias("packed"), F.count(F.lit(1)).alias("copies"))
    else:
        texts = texts.withColumn("copies", F.lit(1).cast("long"))

    window = F.struct("start", "count")
    first = reranked(rows.select("doc_id", "tie", "text").mapInArrow(first_rows, f"{RANKS}, {KEY}, {PLACE}, loose boolean"), "suffix-first")
    still = written(first.filter("NOT repeat").groupBy("doc_id", "tie").agg(F.collect_list(window).alias("open")), "suffix-open")
    cut = written(texts.join(still.hint("merge"), ["doc_id", "tie"]).mapInArrow(pieces, f"{KEY}, {PLACE}, margin int, piece binary"), "suffix-pieces")

    second = reranked(cut.mapInArrow(block_rows, f"{RANKS}, {KEY}, {PLACE}, skip int, home int"), "suffix-second")
    second = second.withColumn("start", F.col("start") + F.col("skip"))
    wanted = second.filter("NOT repeat").groupBy("doc_id", "tie", F.col("home").alias("start")).agg(F.collect_list(window).alias("wanted"))
    chosen = cut.join(wanted.hint("merge"), ["doc_id", "tie", "start"])
    third = reranked(chosen.mapInArrow(window_rows, f"{RANKS}, {KEY}, {PLACE}"), "suffix-third")

    found = [r.filter("repeat").select("doc_id", "tie", window.alias("w")) for r in (first, second, third)]
    gone = found[0].unionByName(found[1]).unionByName(found[2]).groupBy("doc_id", "tie").agg(F.collect_list("w").alias("windows"))
    out = texts.join(written(gone, "suffix-gone").hint("merge"), ["doc_id", "tie"], "left")
    out = out.mapInArrow(remainders, "doc_id bigint, copies bigint, n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary")
    if not shared_ids:
        return out.drop("copies")
    # of rows that share id and text the first is as found, and the others hold nothing new
    again = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    whole = (F.col("_copy") > 1) & (F.col("n_bytes") >= LENGTH)
    everything = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    return again.select(
        "doc_id", "n_bytes", F.when(whole, everything).otherwise(F.col("spans")).alias("spans"),
        F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
