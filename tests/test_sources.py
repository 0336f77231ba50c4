"""Files in and out, and payload corner cases."""

import json

from pyspark.sql import functions as F

from vacantia.functions import dates
from vacantia.functions.payloads import match_response, strict_json
from vacantia.operators.filters import verified_records
from vacantia.operators.ranking import capped_records
from vacantia.sources import companies, documents, postings, tables


def one(spark, column, *values, kind="string"):
    rows = [(v,) for v in values]
    return [r[0] for r in spark.createDataFrame(rows, f"x {kind}").select(column).collect()]


def records(spark, count=2000):
    rows = [(f"Company {i:04d}", f"https://c{i}.com/careers", "test", i % 100, i % 10 == 0, {}) for i in range(count)]
    return companies.memory_records(spark, rows).withColumn("seq", F.monotonically_increasing_id())


def test_cap_keeps_1500_and_results_first(spark):
    kept = capped_records(records(spark), 1500).collect()
    assert len(kept) == 1500 and kept[0]["has_crawl_results"]
    keys = [(r["has_crawl_results"], r["priority"], r["name"].lower()) for r in kept]
    assert keys == sorted(keys, reverse=True)


def test_verifier_with_own_heuristic(spark):
    rows = [("Keep Co", "u", "s", 10, False, {}), ("Drop Co", "u", "s", 10, False, {}), ("Existing", "u", "s", 10, True, {})]
    kept = verified_records(companies.memory_records(spark, rows), lambda df: df["name"] == "Keep Co")
    assert {r["name"] for r in kept.collect()} == {"Keep Co", "Existing"}


def test_company_csv_round_trip(spark, tmp_path):
    rows = [("Acme, Inc", "https://a.com/careers", "s", 5, False, {"notes": 'say "hi"'}), ("B", "https://b.com/jobs", "s", 1, False, {})]
    path = str(tmp_path / "out")
    companies.write_company_csv(companies.memory_records(spark, rows), path)
    back = companies.read_company_csv(spark, path)
    got = {r["Company Name"]: r for r in back.collect()}
    assert got["Acme, Inc"]["Notes"] == 'say "hi"' and got["B"]["Notes"] is None
    parsed = {r["name"]: r for r in companies.accepted_companies(companies.parse_companies(back)).collect()}
    assert parsed["B"]["career_page_url"] == "https://b.com/jobs"


def test_company_csv_reasons(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(
        "Company Name,Career Page URL,Source,Priority,Notes\n"
        ",https://a.com,s,1,\nNo Url,,s,1,\nText,\"see https://t.com/careers, ok.\",s,1,\nBare,co.com/jobs,s,1,\n"
        "Local,http://localhost/x,s,1,\nBuilt (x) Inc.,ask us,s,1,\n"
    )
    got = {r["Company Name"]: (r["reason"], r["career_page_url"]) for r in companies.parse_companies(companies.read_company_csv(spark, str(path))).collect()}
    assert got[None][0] == "empty_name" and got["No Url"][0] == "blank_url" and got["Local"][0] == "invalid_url"
    assert got["Text"] == (None, "https://t.com/careers") and got["Bare"] == (None, "https://co.com/jobs")
    assert got["Built (x) Inc."] == (None, "https://www.built.com/careers")


def test_seed_json_and_recipes(spark, tmp_path):
    seed = tmp_path / "seed.json"
    seed.write_text(json.dumps([{"name": " A ", "career_page_url": "u", "priority": "7", "industry": "ai"}, {"name": "no url"}]))
    rows = companies.read_seed_json(spark, str(seed)).collect()
    assert [(r["name"], r["source"], r["priority"], r["metadata"]) for r in rows] == [("A", "seed_file", 7, {"industry": "ai"})]
    recipe = tmp_path / "recipes.json"
    recipe.write_text(json.dumps({"recipes": [{"name": "r", "keywords": "a, b", "remote_only": True, "location": None}]}))
    (row,) = documents.read_recipes(spark, str(recipe)).collect()
    assert (row["name"], row["remote_only"], row["location"]) == ("r", True, None)


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x, "y, z"\n1,2\n')
    (tmp_path / "b.txt").write_text("two words")
    read = documents.read_documents(spark, str(tmp_path))
    table = documents.csv_documents(read.filter("content_type = 'text/csv'")).first()
    assert table["row_count"] == 2 and table["text"].startswith("x, ")
    plain = documents.document_statistics(read.filter("content_type = 'text/plain'")).first()
    assert (plain["char_count"], plain["word_count"]) == (9, 2)


def test_strict_json_refuses_leftovers(spark):
    texts = ['{"a":1}', '{"a":1}}', '{"a":1} x', "[1,2]", "1,2", "", "{} ]", '"s"', None]
    got = one(spark, strict_json(F.col("x")).isNotNull(), *texts)
    assert got == [True, False, False, True, False, False, False, True, False]


def test_match_response_defaults(spark):
    texts = ['{"match_score": "80"}', '{"match_score": 70}', '{"recommended": false, "match_score": 90}', "[]", '{"match_score": "x"}', "{}"]
    got = one(spark, match_response(F.col("x")), *texts)
    assert [(r["match_score"], r["recommended"]) for r in got] == [(80, True), (70, True), (90, False), (50, False), (50, False), (50, False)]


def test_broken_payloads_give_no_rows(spark):
    bad = spark.createDataFrame([("c", "s", "https://x.com", p) for p in ('{"jobs": [', "<html>", "", '{"jobs": 5}', None)], "company string, slug string, career_url string, payload string")
    for read in (postings.greenhouse_postings, postings.lever_postings, postings.custom_json_postings, postings.jsonld_postings, postings.browser_postings, postings.response_postings, postings.feed_postings):
        assert read(bad).count() == 0


def test_jsonld_has_no_depth_limit(spark):
    deep = '{"@type":"JobPosting","title":"deep","url":"https://x.com/j"}'
    for _ in range(60):
        deep = '{"a":[' + deep + "]}"
    landed = spark.createDataFrame([("C", "https://x.com", deep)], "company string, career_url string, payload string")
    assert [r["title"] for r in postings.jsonld_postings(landed).collect()] == ["deep"]


def test_table_versions_stand_side_by_side(spark, tmp_path):
    first = tables.write_version(spark.range(3), str(tmp_path))
    second = tables.write_version(tables.scan(spark, first).filter("id > 0"), str(tmp_path))
    assert tables.scan(spark, first).count() == 3 and tables.scan(spark, second).count() == 2
    dated = spark.sql("SELECT 1L AS id, TIMESTAMP'2001-01-02 03:00:00' AS discovered_at")
    path = tables.write_version(dated, str(tmp_path), "jobs")
    assert spark.read.parquet(path).filter("discovered_at_day = DATE'2001-01-02'").count() == 1


def test_day_bounds_prune_folders(spark, tmp_path):
    days = spark.sql("SELECT id, TIMESTAMP'2001-01-01 12:00:00' + make_interval(0, 0, 0, CAST(id AS INT)) AS discovered_at, 50D AS ai_match_score FROM range(10)")
    stored = tables.scan(spark, tables.write_version(days, str(tmp_path), "jobs"))
    kept = dates.in_range(stored, "discovered_at", since=dates.plus(dates.ts("2001-01-09"), -3, "day"), before=dates.ts("2001-01-09 12:00:00"))
    assert sorted(r["id"] for r in kept.collect()) == [5, 6, 7]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(discovered_at_day" in plan


def test_markup_in_comments_scripts_and_values_is_no_markup(spark):
    from vacantia.sources import markup

    page = """<!-- <script type="application/ld+json">{"a":1}</script> --><p title=it's data-x="a > b" class='"'>Hi <b>you</b></p>
<script type='application/ld+json' id=x>{"t": "<p>"}</script><SCRIPT>var s = "<!-- </p>";</SCRIPT ><style>p > a {}</style><a href=x>there</a> 1 < 2<script type=application/ld+json>{</script ><a href="never closed>end"""
    row = spark.createDataFrame([(page,)], "html string").select(
        markup.visible_text(F.col("html")).alias("text"), markup.bare_markup(F.col("html")).alias("bare"), markup.script_bodies(F.col("html"), "application/ld+json").alias("bodies")
    ).first()
    assert row.text == "Hi you\nthere 1 < 2end" and row.bodies == ['{"t": "<p>"}', "{"]
    assert "<!--" not in row.bare and "var s" not in row.bare and "<p title=it's" in row.bare


def test_long_pages_and_cells_do_not_overflow(spark):
    from vacantia.sources import documents, markup

    long = "<p a='" + "x\"" * 500_000 + "'>" + "<i b>" * 200_000 + "<!--" + "-" * 500_000 + "--><script>" + "<" * 500_000 + "</script>end"
    cell = '"' + 'a""b' * 2_500_000 + '",2\n"' + "é" * 100_000 + '",3'
    row = spark.createDataFrame([(long, cell)], "html string, content string").select(
        markup.visible_text(F.col("html")).alias("text"), "content"
    )
    assert row.first().text == "end"
    out = documents.csv_documents(row.select("content")).select(F.length("text").alias("n"), "row_count", "column_count").first()
    assert (out.n, out.row_count, out.column_count) == (3 * 2_500_000 + 3 + 1 + 100_000 + 3, 2, 2)


def test_company_source_reads_only_the_sources_asked_for(spark, tmp_path):
    """A filter on the source leaves the other folders unread, whatever is in them."""
    from vacantia.sources.company_source import register

    register(spark)
    for source, names in (("linkedin", ["A", "B"]), ("indeed", ["C"])):
        (tmp_path / f"source={source}").mkdir()
        for n, name in enumerate(names):
            (tmp_path / f"source={source}" / f"{n:03}.json").write_text(json.dumps([{"name": name, "career_page_url": f"https://{name}.com", "priority": n}, {"name": None}, "x"]))
    frame = lambda: spark.read.format("company_payloads").option("path", str(tmp_path)).load()
    every = sorted((r.name, r.source, r.priority) for r in frame().collect())
    assert every == [("A", "linkedin", 0), ("B", "linkedin", 1), ("C", "indeed", 0)]
    assert frame().rdd.getNumPartitions() == 3
    (tmp_path / "source=indeed" / "zz.json").write_text("broken")
    one = frame().filter("source = 'linkedin' AND priority > 0")
    assert [r.name for r in one.collect()] == ["B"] and one.rdd.getNumPartitions() == 2
    assert frame().filter("source IN ('linkedin', 'indeed')").count() == 3  # a broken payload has no rows
    assert frame().filter("source = 'nobody'").count() == 0


def test_company_source_as_a_stream(spark, tmp_path):
    """Each run reads what has landed since its checkpoint."""
    from vacantia.sources.company_source import register

    register(spark)
    root = tmp_path / "payloads" / "source=seed"
    root.mkdir(parents=True)
    seen = []
    for n, names in enumerate((["A", "B"], ["C"], [])):
        if names:
            (root / f"{n:03}.json").write_text(json.dumps([{"name": x, "career_page_url": "u"} for x in names]))
        stream = spark.readStream.format("company_payloads").option("path", str(root.parent)).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
        seen.append(sorted(r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert seen == [["A", "B"], ["A", "B", "C"], ["A", "B", "C"]]
