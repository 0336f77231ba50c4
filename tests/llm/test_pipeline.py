"""The pipeline's stages against plain Python, and as a whole."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import prose
from vacantia.llm import byte_bpe, quality, toxicity
from vacantia.llm.queries import public_tokenizers

#: The columns of documents, and some that clash with names used inside.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "_row", "_row_", "row", "kept", "_n", "component_id"]
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def world(session, rows, tmp_path_factory):
    """Tables of a small corpus: the odd rows of the other tests, junk, toxic texts and a benchmark passage."""
    rng = random.Random(11)
    texts = list(rows)
    quality_labels, toxic_labels = {}, {}
    for i in range(200, 500):
        words = prose(rng, 60).split()
        if i % 10 == 3:
            words = [w + "***" for w in words]
        if i % 10 == 7:
            words[rng.randrange(60)] = rng.choice(["wretched", "abysmal"])
        texts.append((i, " ".join(words)))
        if i % 2:
            quality_labels[i], toxic_labels[i] = int(i % 10 != 3), int(i % 10 == 7)
    item = prose(rng, 40)
    texts += [(600, prose(rng, 80) + " " + item + " " + prose(rng, 80)), (601, item), (None, prose(rng, 30) + " " + item), (5, item + " " + prose(rng, 9)), (None, "junk*** " * 60), (205, "junk*** " * 61)]
    root = str(tmp_path_factory.mktemp("world"))
    clash = "_row int, _row_ string, row int, kept boolean, _n string, component_id string"
    docs = session.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 1, True, "x", "x") for i, t in texts], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {clash}")
    docs.repartition(4).write.parquet(f"{root}/documents.parquet")
    session.createDataFrame([(i, quality_labels[i], toxic_labels[i]) for i in quality_labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    session.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, session.read.parquet(f"{root}/documents.parquet"), texts


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=repr)


def rows_of(df):
    return sorted(((r[0], r[1]) for r in df.select("doc_id", "text").collect()), key=repr)


def test_quality_stage_is_the_draw(world, session):
    """Counts, log ratios, weights, noise, k and ranks in plain Python."""
    root, docs, texts = world
    labels = {r.doc_id: r.quality for r in session.read.parquet(f"{root}/labels.parquet").collect()}
    raw, target = Counter(), Counter()
    for i, t in texts:
        parts = quality_parts(t)
        raw.update(parts)
        if labels.get(i) == 1:
            target.update(parts)
    size, n, m = quality.BUCKETS, sum(raw.values()), sum(target.values())
    share = lambda b: (raw[b] + 1) / (n + size)
    log = lambda b: math.log((target[b] + size * share(b)) / (m + size)) - math.log(share(b))
    weight = lambda t: 200 * sum(map(log, quality_parts(t))) / max(1, len(quality_parts(t)))
    noise = lambda i: -math.log(-math.log((int(hashlib.md5(f"20:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13))
    draws = sorted(((weight(t) + noise(i), i, t) for i, t in texts), key=lambda d: -d[0])
    good = sum(labels.values()) / len(labels)
    k = round(len(texts) * (good + math.sqrt(good * (1 - good) / len(labels))))
    want = sorted(((i, t) for _, i, t in draws[:k]), key=repr)
    out = STAGE["quality"](session, docs, root)
    assert out.columns == COLUMNS and rows_of(out) == want
    still = sorted(((weight(t), i, t) for i, t in texts), key=lambda d: -d[0])[:k]
    assert sorted(((i, t) for _, i, t in still), key=repr) != want  # the noise takes part
    junk = [(i, t) for i, t in texts if t and "***" in t]
    assert len([r for r in junk if r in want]) < 0.1 * len(junk)


def quality_parts(text):
    """Buckets of the parts of a text and their pairs, one by one."""
    parts = [zlib.crc32(p) for p in re.findall(rb"[\w\x80-\xff]+|[^\w\s\x80-\xff]+", (text or "").encode())]
    mixed = [p * 0xBF58476D1CE4E5B9 for p in parts] + [a * 0x9E3779B97F4A7C15 + b * 0xD6E8FEB86659FD93 for a, b in zip(parts, parts[1:])]
    return [(x % 2**64) >> 50 for x in mixed]


def test_toxicity_stage_scores_every_text(world, session):
    root, docs, texts = world
    model = toxicity.train(docs, session.read.parquet(f"{root}/labels.parquet"), F.lit(True))
    out = STAGE["toxicity"](session, docs, root)
    want = [i for i, t in texts if toxicity.text_score(t.encode() if t is not None else None, model) < 0.5]
    assert out.columns == COLUMNS and ids(out) == sorted(want, key=repr)
    assert all(not (set((t or "").split()) & {"wretched", "abysmal"}) for i, t in texts if i in set(want))


def test_near_dedup_stage_keeps_one_of_each_group(world, session):
    """Rows are told apart by their place, also those that share an id or have none."""
    root, docs, texts = world
    groups = {}
    for row, _, group, _ in brute.near_duplicates([(k, t) for k, (_, t) in enumerate(texts)], 80):
        groups.setdefault(group, []).append(row)
    first = [min((texts[k][0] is None, texts[k][0], texts[k][1] or "") if texts[k][0] is not None else (True, 0, "") for k in g) for g in groups.values()]
    out = STAGE["near_dedup"](session, docs, root)
    assert out.columns == COLUMNS and ids(out) == sorted((None if void else i for void, i, _ in first), key=repr)


def test_decontamination_stage_drops_test_passages(world, session):
    """A passage goes whether its row has an id or not, and takes no row of the same id with it."""
    root, docs, texts = world
    item = next(t for i, t in texts if i == 601)
    out = STAGE["decontamination"](session, docs, root)
    assert out.columns == COLUMNS and rows_of(out) == sorted(((i, t) for i, t in texts if item not in (t or "")), key=repr)


def test_the_whole_pipeline(world, session):
    root, docs, texts = world
    out = corpus_pipeline.run(session, root)
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(session, step, root)
    rows = step.select("doc_id", "text").collect()
    codec = byte_bpe.Codec(byte_bpe.read_vocabulary(public_tokenizers().path("byte_bpe_multi_50k.tiktoken")))
    cut = byte_bpe.splitter(public_tokenizers().PATTERN)
    want = sorted((r.doc_id, hashlib.sha256(codec.encode(cut.findall(r.text or ""))).hexdigest()) for r in rows if r.doc_id is not None)
    got = out.collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in got if r.doc_id is not None) == want
    assert all(hashlib.sha256(struct.pack(f"<{len(r.ids)}I", *r.ids)).hexdigest() == r.ids_sha256 and r.n_tokens == len(r.ids) for r in got)


def test_stages_of_empty_tables(world, session):
    root, docs, _ = world
    for name, stage in corpus_pipeline.STAGES:
        out = stage(session, docs.limit(0), root)
        assert out.count() == 0 and (name == "byte_bpe" or out.columns == COLUMNS)
