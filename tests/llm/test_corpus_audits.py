"""Filter audit, fill-in-the-middle and suffix dedup against plain Python."""

import hashlib
import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import plain, prose
from vacantia.llm import fill_in_middle, filter_audit, suffix_dedup

# filter audit


def failures(rows):
    """One set of failed filters per row (doc_id, text)."""
    least = {}
    for i, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = set()
        if len(w) < 50:
            bad.add("A")
        if 100 * len(set(w)) < 65 * len(w):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            bad.add("C")
        if re.search(r"[#$%&*|]", t):
            bad.add("D")
        if i is not None and least[t] < i:
            bad.add("E")
        out.append(bad)
    return out


def audit(rows, good, toxic):
    """rows: (doc_id, text, source)."""
    bad = failures([(i, t) for i, t, _ in rows])
    out = []
    for part in {s or "" for _, _, s in rows}:
        own = [(r[0], b) for r, b in zip(rows, bad) if (r[2] or "") == part]
        removed = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [i for i, b in left if f in b]
                left = [(i, b) for i, b in left if f not in b]
                removed[f] += len(gone)
                failing = sum(f in b for _, b in own)
                lines.append((part, "".join(order), step, f, len(left), len(gone), failing - len(gone), sum(b == {f} for _, b in own), sum(i in good for i in gone), sum(i in toxic for i in gone)))
        out += [(*line, removed[line[3]]) for line in lines]
    return sorted(out, key=repr)


def test_audit_equals_running_every_order(session, rows, none):
    rng = random.Random(3)
    table = [(i, t, rng.choice(["a", "b", None, ""])) for i, t in rows]
    table += [(200 + k, prose(rng, 60) + rng.choice(["", " $", " ABC" * 40, " word" * 60]), "c") for k in range(40)]
    table += [(300 + k, prose(random.Random(1), 70), "c") for k in range(5)]
    table += table[:3]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 400, 2)] + [(4, 1, None), (None, 1, 1), (6, None, 1), (6, 1, 0)]
    docs = session.createDataFrame([(i, t, s, 1, "x") for i, t, s in table], "doc_id bigint, text string, source string, mask int, part string")
    known = session.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    want = audit(table, {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None})
    assert plain(filter_audit.audited(docs, known)) == want
    assert filter_audit.audited(none.withColumn("source", none["lang"]), known).count() == 0
    assert filter_audit.audited(docs, known.limit(0)).count() == len(want)


def test_audit_sends_no_labels_and_digests_through_the_driver(session, monkeypatch):
    """The salted copies of labels and digests are shuffled, however small the files they are read from."""
    docs = session.createDataFrame([(i, prose(random.Random(i % 3), 60), "a") for i in range(12)], "doc_id bigint, text string, source string")
    known = session.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id bigint, quality int, toxic int")
    written, settled = {}, filter_audit.settled
    monkeypatch.setattr(filter_audit, "settled", lambda df, label="settled": written.setdefault(label, df) and settled(df, label))
    assert filter_audit.audited(docs, known).count() == 600
    plan = written["audit-cells"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and "BroadcastHashJoin" not in plan


def test_intervals_are_the_orders_in_which_a_step_removes():
    orders = list(itertools.permutations(range(5)))
    cover = {}
    for mask, step, low, high in filter_audit.intervals():
        for rank in range(low, high):
            assert (mask, rank) not in cover
            cover[mask, rank] = step
    for mask in range(1, 32):
        for rank, order in enumerate(orders):
            assert cover[mask, rank] == 1 + next(k for k, f in enumerate(order) if mask >> f & 1)


# fill in the middle


def middle(doc_id, text):
    """Plain form of the contract."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, n, "plain", None, None, text, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text)
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text)


def test_middles_equal_plain_python(session, rows, none):
    odd = [" a", "a ", " ", "\x0b\x0c", "a<", "<P>x", "S> b <", "ä b c\x1cd", "<S", "\x00 \x00", "😀 a\r\nb c"]
    table = list(rows) + [(1000 + k, odd[k % len(odd)] + odd[k // len(odd) % len(odd)]) for k in range(300)]
    docs = session.createDataFrame([(i, t, 1, "x") for i, t in table], "doc_id bigint, text string, n int, form string").repartition(4)
    made = fill_in_middle.fill_in_middle(docs)
    got = plain(made.withColumn("restored", fill_in_middle.restored(made["output"], made["form"])))
    assert got == sorted((middle(i, t) for i, t in table), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \t\né😀", max_size=200), st.integers(0, 250))
def test_units_and_places_of_any_text(text, count):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    cutter = fill_in_middle.Cutter(text)
    assert cutter.units == len(units)
    count = min(count, len(units))
    assert cutter.place(count) == len("".join(units[:count]))


# suffix dedup


def repeats(rows, length=100):
    """(doc_id, spans, kept) by a set of all windows seen so far."""
    seen = set()
    out = []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in order:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\x01" * length
            seen.add(w)
        spans = [m.span() for m in re.finditer(b"\x01+", bytes(gone))]
        out.append((i, len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in df.collect()), key=repr)


def corpus(seed):
    """Texts with shared passages of many lengths, periodic and repeated parts, and copies."""
    rng = random.Random(seed)
    passages = [prose(rng, rng.choice([12, 15, 17, 18, 20, 40, 100])) for _ in range(15)] + ["-" * 150, "ab" * 90, "x" * 99, "y" * 100, "z" * 101, "abc " * 120]
    out = []
    for i in range(120):
        parts = [rng.choice([prose(rng, rng.randrange(1, 30)), rng.choice(passages), rng.choice(passages)[rng.randrange(5) :]]) for _ in range(rng.randrange(0, 6))]
        out.append((i, rng.choice([" ", "", "é"]).join(parts)))
    base = out[5][1] + prose(rng, 100)
    for i in range(120, 150):
        b = list(base)
        for _ in range(i % 3):
            b[rng.randrange(len(b))] = "Q"
        out.append((i, "".join(b)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_equal_plain_python(session, seed):
    rows = corpus(seed)
    docs = session.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert found(suffix_dedup.repeats_removed(docs)) == repeats(rows)


def test_odd_rows(session, rows, docs, none):
    # rows that share an id but not the text go by hash: the texts here share no window unless they are equal
    assert found(suffix_dedup.repeats_removed(docs)) == repeats(rows)
    assert suffix_dedup.repeats_removed(none).count() == 0
    short = session.createDataFrame([(1, "x" * 99), (2, "x" * 99), (3, None)], "doc_id int, text string")
    assert all(r[2] == [] for r in found(suffix_dedup.repeats_removed(short)))


def test_a_hot_passage_over_many_partitions(session):
    """A passage in all documents spreads over range partitions and still leaves only its first copy."""
    rng = random.Random(9)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, 10) + " " + passage + " " + prose(rng, 10)) for i in range(400)]
    before = session.conf.get("spark.sql.shuffle.partitions"), session.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    session.conf.set("spark.sql.shuffle.partitions", "40")
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found(suffix_dedup.repeats_removed(session.createDataFrame(rows, "doc_id bigint, text string")))
    finally:
        session.conf.set("spark.sql.shuffle.partitions", before[0])
        session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == repeats(rows)


def test_repeats_of_a_given_table(session):
    """Blocks of neighbouring segments that start at one place each keep their own windows."""
    docs = session.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(suffix_dedup.repeats_removed(docs)) == repeats(rows)
