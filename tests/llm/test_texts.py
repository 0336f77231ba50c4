"""Operators on single texts against libraries and plain Python."""

import base64
import hashlib
import re
import struct
import zlib

import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.conftest import plain
from vacantia.llm import byte_bpe, html_extraction, language_id, quality, sharding, token_counts, toxicity
from vacantia.llm.queries import public_tokenizers
from vacantia.session import work_path

SF = "/root/testdata/sf0.01"
P = public_tokenizers()
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tables(session):
    return lambda name: session.read.parquet(f"{SF}/{name}.parquet")


# token counts


def test_token_counts_are_those_of_the_library(docs, rows, session):
    cache = work_path(session, "cache")
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for i, t in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    got = plain(token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), cache))
    assert got == sorted(want, key=repr)
    stored = session.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in rows})
    again = token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), cache)
    assert plain(again) == got and session.read.parquet(cache).count() == stored.count()  # hits only


def test_token_cache_keeps_tokenizers_apart(docs, none, session):
    cache = work_path(session, "cache")
    few = docs.limit(20)
    a = token_counts.token_counts(few, P.path("byte_bpe_50k.json"), cache)
    b = token_counts.token_counts(few, P.path("piece_bpe_32k.model"), cache)
    assert a.count() == b.count() == 20
    assert session.read.parquet(cache).select("tokenizer").distinct().count() == 2
    assert token_counts.token_counts(none, P.path("byte_bpe_50k.json"), cache).count() == 0


def test_a_count_stored_twice_counts_once(docs, session):
    cache = work_path(session, "cache")
    first = plain(token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), cache))
    stored = session.read.parquet(cache)
    twice = session.createDataFrame(stored.collect(), stored.schema)
    twice.write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert plain(token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), cache)) == first


# sharding


def best(key, weights):
    import math

    def score(s):
        u = (int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16.0**13
        return -math.log(u) / weights[s]

    return min(sorted(weights), key=lambda s: (score(s), s))


def test_shards_match_plain_python(docs, rows):
    old, new = dict.fromkeys(range(16), 1.0), dict.fromkeys(range(17), 1.0)
    got = sharding.sharded(docs, old, new).collect()
    assert len(got) == len(rows)
    data = {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows}
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == data
    slots = {}
    for r in got:
        key = "null" if r.doc_id is None else r.doc_id
        assert r.law == "key" and r.shard == best(key, old) and r.grown_shard == best(key, new)
        assert r.grown_shard in (r.shard, 16)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_set_the_shares(session, none):
    table = session.range(20_000).selectExpr("id AS doc_id", "'x' AS text")
    weights = {0: 1.0, 1: 2.0, 2: 5.0}
    counts = {r["shard"]: r["count"] for r in sharding.sharded(table, weights, {**weights, 3: 2.0}).groupBy("shard").count().collect()}
    assert all(abs(counts[s] / 20_000 - w / 8) < 0.015 for s, w in weights.items())
    moved = sharding.sharded(table, weights, {**weights, 3: 2.0}).filter("shard <> grown_shard")
    assert {r[0] for r in moved.select("grown_shard").distinct().collect()} == {3} and abs(moved.count() / 20_000 - 0.2) < 0.015
    assert sharding.sharded(none, weights, weights).count() == 0


# language


def test_languages_of_held_out_documents(tables, docs, none):
    model = language_id.prototypes(tables("documents"), language_id.remainder("doc_id", 4) != 2)
    assert sorted(model) == ["de", "en", "es", "fr"]
    found = language_id.identified(tables("documents"), model)
    held = found.join(tables("documents").select("doc_id", "lang"), "doc_id").filter(language_id.remainder("doc_id", 4) == 2)
    right, total = held.filter("lang = lang_pred").count(), held.count()
    assert right / total > 0.95
    mixed = {(r.doc_id, r.lang_pred, r.score) for r in language_id.identified(docs, model).collect()}
    assert {(80, "und", 0.0), (81, "und", 0.0), (82, "und", 0.0), (92, "und", 0.0), (None, "und", 0.0)} <= mixed
    assert all(0 <= m[2] <= 1 for m in mixed)
    assert language_id.identified(none, model).count() == 0
    assert {r.lang_pred for r in language_id.identified(docs, {}).collect()} == {"und"}
    assert language_id.prototypes(none, language_id.remainder("doc_id", 4) != 2) == {}


def test_position_matters_in_a_binding():
    vectors = language_id.Vectors()
    code = lambda s: sum(ord(c) << (21 * (2 - k)) for k, c in enumerate(s))
    a, b = vectors.bound(code("abc")).astype(int), vectors.bound(code("cba")).astype(int)
    assert abs(a @ b) < 150 and a @ a == language_id.DIMENSIONS


# html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookie-notice">We use cookies on this page and hope that you agree to all of them.</div>
<div class="wrap"><div class="story7"><h2>A title &amp; more</h2><p>First   paragraph, long enough to be read as prose, with a <a href="x">link</a> in it.<p>Second one<br>goes on, caf&eacute;.
<ul><li>one</li><li>two</ul><div class="ad-box">Buy</div><form><label>Mail</label><input></form><blockquote>Quoted words of somebody else here.</blockquote></div>
<aside><p>Aside text that is long enough to be prose but is not part of the story at all.</p></aside></div>
<section class="comments"><p>A reader comment that is long enough to be prose but is not part of the story.</p></section><footer>&copy; site</footer></body></html>"""
TEXT = "A title & more\n\nFirst paragraph, long enough to be read as prose, with a link in it.\n\nSecond one goes on, café.\n\none\n\ntwo\n\nQuoted words of somebody else here."


def test_main_text_of_a_page():
    assert html_extraction.page_text(html_extraction.parsed(PAGE), []) == TEXT


LONG = "Words of this story go on and on, as prose does in stories of this kind."


@pytest.mark.parametrize("page, text", [
    ("<article><p title=it's>First one.</p><p>Second isn't gone.</p></article>", "First one.\n\nSecond isn't gone."),
    (f"<article><p>one {LONG}</p></article><article>second</article>", f"one {LONG}\n\nsecond"),
    *[(f"<article><p>{LONG}</p><div class='{c}'><p>Inner.</p></div></article>", f"{LONG}\n\nInner.") for c in ("post-with-share", "search-results-article", "notice-board-story", "login-wall article-body", "related-work")],
    *[(f"<article><p>{LONG}</p><div class='{c}'><p>Inner.</p></div></article>", LONG) for c in ("comments", "cookie-notice", "ad-box", "related-posts", "newsletter-signup", "shareButtons")],
    *[(f"<div class='{c}'><p>{LONG}</p></div>", LONG) for c in ("comments", "notice", "post-with-share")],  # nothing else is there
    ("<p>a<!-- <p>no</p> --><!x>b</ y>c<a href=x>d</a>< e", "abcd< e"),
    ("<p>x<a b='>never closed", "x"), ("<p>x<br/ =>y", "x y"), ("<p title=a>b", "b"), ("", ""), ("<p></p>", ""),
])
def test_odd_pages(page, text):
    assert html_extraction.page_text(html_extraction.parsed(page), []) == text


def test_time_grows_with_the_length_of_a_page():
    import time

    for page in ("<a b=\"" * 150_000, "<div>" * 20_000 + "x", "<x-y>" * 20_000 + "</x-z>" * 20_000, "<p>a<article>" * 20_000 + "</section>" * 20_000, f"<p class='{'a' * 1_000_000}'>", "<p '=x" * 150_000):
        start = time.perf_counter()
        html_extraction.page_votes(html_extraction.parsed(page))
        assert time.perf_counter() - start < 5


def test_votes_and_winners_equal_plain_python(session, tables):
    pages = tables("pages").select("url", "html").collect()
    votes = {}
    for r in pages:
        host = re.match(r"[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)", (r.url or "").lower())
        host = host[1] if host else ""
        for p, v in html_extraction.page_votes(html_extraction.parsed(r.html or "")).items():
            votes.setdefault(host, {}).setdefault(p, []).append(v)
    rows = tables("pages").selectExpr("lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host", "html AS text")
    got = {r.host: r.winners for r in html_extraction.host_paths(rows).collect()}
    want = {}
    for host, paths in votes.items():
        sums = {p: round(sum(v), 6) for p, v in paths.items()}
        want[host] = sorted((p for p in sums if sums[p] >= 0.1 * max(sums.values())), key=lambda p: (-sums[p], p))
    assert got == want


def test_host_paths_win_over_a_misleading_page(session):
    odd = "<body><div class='story3'><p>Short.</p></div><div class='box'><p>" + "A promotion that has more text than the story of this page. " * 2 + "</p></div></body>"
    usual = "<body><div class='story{0}'><p>" + "The story of this page goes on and on, as stories do on this host. " * 8 + "</p></div><div class='box'><p><a href='/x'>A short promotion of something.</a></p></div></body>"
    pages = [(k, f"http://a.example/{k}", usual.format(k), "x") for k in range(6)] + [(10, "http://a.example/odd", odd.replace("Short.", "Short story, told in one sentence only, but the story it is."), "x")]
    pages += [(20, None, PAGE, "x"), (21, "http://b.example/", None, "x"), (22, "nonsense", "", "x"), (23, "http://c.example", "just words", "x"), (24, "http://c.example", "<div><p>cut off", "x"), (20, None, PAGE, "x")]
    table = session.createDataFrame(pages, "page_id bigint, url string, html string, host string")
    got = {r.page_id: r for r in html_extraction.main_texts(table).collect()}
    assert got[10].text == "Short story, told in one sentence only, but the story it is."
    assert got[20].text == TEXT and got[20].n_chars == len(TEXT) and got[20].url is None
    assert got[21].text == got[22].text == "" and got[21].n_chars == 0
    assert got[23].text == "just words" and got[24].text == "cut off"
    assert html_extraction.main_texts(table).count() == len(pages)
    assert html_extraction.main_texts(table.limit(0)).count() == 0


# byte-level BPE


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_library(docs, rows, library, none, session):
    got = plain(byte_bpe.encoded(docs, RANKS, P.PATTERN))
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert got == sorted(want, key=repr)
    back = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decoded(session.createDataFrame([(1, [5, 6]), (2, None), (3, library.encode_ordinary("häh?"))], "doc_id int, ids array<int>"), RANKS).collect()}
    assert back == {1: library.decode_bytes([5, 6]), 2: b"", 3: "häh?".encode()}
    assert byte_bpe.encoded(none, RANKS, P.PATTERN).count() == 0


def test_long_pieces_take_linear_time(library):
    """One piece of random letters leaves the path of longest matches at once; twice the length takes twice the time."""
    import random
    import time

    rng = random.Random(2)
    codec, took = byte_bpe.Codec(byte_bpe.read_vocabulary(RANKS)), {}
    codec.encode(["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(150_000))])  # the pairs are known from now on
    for n in (100_000, 400_000):
        piece = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        start = time.perf_counter()
        code = codec.encode([piece])
        took[n] = time.perf_counter() - start
        assert codec.decode(code) == piece.encode()
        if n == 100_000:
            ids = library.encode_ordinary(piece)
            assert code == struct.pack(f"<{len(ids)}I", *ids)
    assert took[400_000] < 8 * took[100_000]


def test_random_bytes_merge_alike(library):
    import random

    rng = random.Random(1)
    codec, cut = byte_bpe.Codec(byte_bpe.read_vocabulary(RANKS)), byte_bpe.splitter(P.PATTERN)
    pool = [*range(32, 127), 0x85, 0x1C, 0xA0, 9, 10, 13, 0xE9, 0x3B1, 0x5D0, 0x4E2D, 0x1F600, 0x2028, 0xBD, 0x660]
    for _ in range(2000):
        text = "".join(chr(rng.choice(pool)) for _ in range(rng.randrange(60)))
        ids = library.encode_ordinary(text)
        code = codec.encode(cut.findall(text))
        assert code == struct.pack(f"<{len(ids)}I", *ids) and codec.decode(code) == text.encode()


# classifiers


def test_quality_keeps_the_good_and_drops_the_bad(tables, docs, none, session):
    """Labels of two thirds are learned from, the draw is judged by the others."""
    fold = language_id.remainder("doc_id", 3)
    ratio = quality.learned(tables("documents"), tables("labels").filter(fold != 0))
    drawn = quality.resampled(tables("documents"), ratio).join(tables("labels").filter(fold == 0).distinct(), "doc_id")
    share = {r["quality"]: r["s"] for r in drawn.selectExpr("quality", "CAST(kept AS INT) AS k").groupBy("quality").agg({"k": "avg"}).toDF("quality", "s").collect()}
    assert share[1] > 0.95 and share[0] < 0.2
    assert quality.resampled(none, ratio).count() == 0
    empty = session.createDataFrame([], "doc_id bigint, quality int")
    flat = quality.learned(docs, empty)
    assert quality.resampled(docs, flat).filter("kept").count() == docs.count()
    assert quality.resampled(docs, flat, k=10).filter("kept").count() == 10
    assert quality.resampled(docs, ratio, share=0.5).filter("kept").count() == round(docs.count() / 2)
    assert quality.resampled(docs, ratio).filter("doc_id IN (80, 81)").filter("log_weight = 0").count() == 2


def test_draws_follow_the_weights(session):
    """Without replacement, the first of a draw falls on an item in proportion to its weight."""
    import math

    weights = {i: (3.0 if i % 4 == 0 else 1.0) for i in range(40_000)}
    rows = session.range(40_000).selectExpr("id AS doc_id").withColumn("g", quality.gumbel(quality.F.col("doc_id"))).collect()
    draw = sorted(((math.log(weights[r.doc_id]) + r.g, r.doc_id) for r in rows), reverse=True)[:2000]
    assert abs(sum(i % 4 == 0 for _, i in draw) / 2000 - 0.5) < 0.04


def test_misspellings_share_the_vectors_of_their_parts():
    import random

    from tests.llm.conftest import prose

    rng = random.Random(4)
    rows = []
    for k in range(300):
        words = prose(rng, 60).split()
        if k % 3 == 0:
            words[rng.randrange(60)] = rng.choice(["wretched", "abysmal"])
        rows.append((" ".join(words).encode(), int(k % 3 == 0)))
    model = toxicity.fit(rows)
    assert all(toxicity.text_score(t, model) > 0.5 for t in (b"kana wretched lomus", b"WRETCHEDD", b"so abysmall", b"wretchd"))
    assert toxicity.text_score(prose(rng, 5000).encode(), model) < 0.5


def test_toxicity_of_held_out_documents(tables, docs, none, session):
    fold = language_id.remainder("doc_id", 5)
    model = toxicity.train(tables("documents"), tables("labels"), fold != 0)
    held = toxicity.scored(tables("documents"), model).filter(fold == 0).join(tables("labels"), "doc_id")
    rows = held.select("toxic", "predicted").collect()
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(clean) / len(clean) < 0.05
    toxic = [r.predicted for r in rows if r.toxic == 1]
    assert sum(toxic) / len(toxic) > 0.6
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert scores[80] == scores[81] == scores[82] and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.scored(none, model).count() == 0
    flat = toxicity.train(docs, session.createDataFrame([], "doc_id bigint, toxic int"), fold != 0)
    assert {r.predicted for r in toxicity.scored(docs, flat).collect()} == {0}
