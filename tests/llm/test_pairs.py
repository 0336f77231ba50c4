"""Operators on pairs and groups against brute force."""

import random

import numpy as np

from tests.llm import brute
from tests.llm.conftest import plain, prose
from vacantia.llm import common, decontamination, embedding_dedup, near_dedup


def test_near_duplicates_match_brute_force(docs, rows, monkeypatch):
    for percent in (80, 85):
        assert plain(near_dedup.near_duplicates(docs, percent)) == brute.near_duplicates(rows, percent)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)  # groups over many blocks
    monkeypatch.setattr(near_dedup, "PART", 3)  # buckets over many parts
    assert plain(near_dedup.near_duplicates(docs, 85)) == brute.near_duplicates(rows, 85)


def test_near_duplicates_of_nothing(none, session):
    assert near_dedup.near_duplicates(none).count() == 0
    only_null = session.createDataFrame([(1, None), (2, None)], "doc_id bigint, text string")
    assert plain(near_dedup.near_duplicates(only_null)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_estimates_are_corrected_for_chance():
    rng = np.random.default_rng(1)
    factors, offsets = common.multipliers(near_dedup.MINIMA, near_dedup.SEED)
    left = common.mixed(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    for shared in (0, 2000, 3600):
        right = np.concatenate([left[:shared], common.mixed(rng.integers(0, 1 << 63, 4000 - shared, dtype=np.uint64))])
        low = [common.mixed(common.minima(s, np.array([0]), factors, offsets)).T for s in (left, right)]
        guess = near_dedup.estimated(near_dedup.packed(low[0]), near_dedup.packed(low[1]))[0, 0]
        assert abs(guess - shared / (8000 - shared)) < 0.2


def test_estimates_lose_no_pair_at_the_threshold():
    """Recall of estimate and sizes over pairs of similarity 0.85, and how many of similarity 0.5 go on."""
    rng = np.random.default_rng(4)
    factors, offsets = common.multipliers(near_dedup.MINIMA, near_dedup.SEED)
    passed = {0.85: 0, 0.5: 0}
    for similarity in passed:
        for _ in range(400):
            shared = round(2 * 200 * similarity / (1 + similarity))
            every = common.mixed(rng.integers(0, 1 << 63, 400 - shared, dtype=np.uint64))
            low = [common.mixed(common.minima(s, np.array([0]), factors, offsets)).T for s in (every[:200], every[-200:])]
            sizes = np.array([200])
            _, may = near_dedup.candidates(*(near_dedup.packed(x) for x in low), sizes, sizes, 85)
            passed[similarity] += bool(may[0, 0])
    assert passed[0.85] == 400 and passed[0.5] < 40


def test_loosely_alike_documents_form_no_group(session):
    """Documents that share a band key but no candidate pair are not read again."""
    rng = random.Random(9)
    base = prose(rng, 60, [f"w{i}" for i in range(5000)]).split()
    rows = []
    for i in range(200):
        words = list(base)
        for k in rng.sample(range(12), 9):
            words[5 * k] = f"d{i}x{k}"
        rows.append((i, " ".join(words)))
    docs = session.createDataFrame(rows, "doc_id bigint, text string")
    reps = docs.mapInArrow(near_dedup.sketch(5), near_dedup.SKETCH_SCHEMA)
    keys = reps.selectExpr("explode(bands) AS band").groupBy("band").count().filter("count > 1").count()
    assert keys > 0 and near_dedup.candidate_groups(reps, 85).count() == 0


def test_contamination_matches_brute_force(docs, rows, session):
    rng = random.Random(3)
    texts = {i: t for i, t in rows if t}
    long = texts[87].split()
    items = [(0, " ".join(long[20_000:20_040])), (1, " ".join(texts[45].split()[10:60])), (2, prose(rng, 25)), (3, None), (4, ""), (5, "one"),
             (6, "one two three four"), (7, " ".join(long[5:20]).upper()), (8, " ".join(long[100:140] + ["zz"])), (None, "one two"), (7, " ".join(long[5:20]).upper())]
    table = session.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    got = plain(decontamination.contaminated(docs, table))
    assert got == brute.contaminated(rows, [x for k, x in enumerate(items) if x not in items[:k]])
    assert {g[1] for g in got} >= {0, 1, 5, 6, 7, 8}


def test_contamination_in_blocks(docs, rows, session, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 2)
    items = [(k, t) for k, (_, t) in enumerate(rows[40:45])]
    table = session.createDataFrame(items, "item_id bigint, text string")
    assert plain(decontamination.contaminated(docs, table)) == brute.contaminated(rows, items)


def test_contamination_of_nothing(none, docs, session):
    items = session.createDataFrame([(1, "one two three four five six")], "item_id bigint, text string")
    assert decontamination.contaminated(none, items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0


def vectors():
    rng = np.random.default_rng(5)
    out, at = [], 0
    for label in (0, 1, None):
        for _ in range(6):
            centre = rng.normal(size=12)
            for _ in range(20):
                out.append((at, (centre + rng.normal(size=12) * rng.choice([0.03, 0.12])).tolist(), label))
                at += 1
    same = out[0][1]
    out += [(1000 + i, same, 0) for i in range(30)] + [(1100, [2 * x for x in same], 0), (1101, same, 1), (1102, same[:5], 0), (0, same, 0)]
    out += [(1200, None, 0), (1201, [], 0), (1202, [0.0] * 12, 0), (1203, [float("nan")] * 12, 0), (1204, [None] * 12, 0), (1205, [1e200] * 12, 0), (1206, [1e-200] * 12, 0), (None, same, 0)]
    return out


def test_near_embeddings_match_brute_force(session, monkeypatch):
    rows = vectors()
    table = session.createDataFrame([(*r, 0, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, rep int, block string")
    want = brute.near_embeddings(rows)
    assert plain(embedding_dedup.near_embeddings(table)) == want
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    monkeypatch.setattr(embedding_dedup, "FAN_OUT", 3)
    assert plain(embedding_dedup.near_embeddings(table)) == want
    assert embedding_dedup.near_embeddings(table.limit(0)).count() == 0


def test_distant_blocks_are_skipped(session):
    rng = np.random.default_rng(2)
    points = np.repeat(rng.normal(size=(8, 8)) * 10, 64, axis=0) + rng.normal(size=(512, 8)) * 0.01
    rows = [(i, 1, "a", p.tolist()) for i, p in enumerate(points)]
    names = ", ".join(f"p{i} double" for i in range(embedding_dedup.DIRECTIONS))
    inside = session.createDataFrame([(i, i // 32, a, *p[: embedding_dedup.DIRECTIONS]) for i, _, a, p in rows], f"rep bigint, block bigint, label string, {names}")
    pairs = plain(embedding_dedup.near_blocks(inside, 0.2))
    assert len(pairs) == 24 and all(a // 2 == b // 2 for a, b in pairs)


def test_components_of_long_chains(session):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 500), (7, 7)]
    found = dict(plain(common.components(session.createDataFrame(edges, "a bigint, b bigint"))))
    assert found == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}
