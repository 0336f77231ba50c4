"""Finding stored duplicates of incoming postings and duplicates within a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import dates, text, urls
from vacantia.operators import scale
from vacantia.operators.joins import child_counts
from vacantia.operators.scale import keep_first, paged_ids, salted_join
from vacantia.session import settled

#: Days within which an equal external id of another company is the same posting.
CROSS_COMPANY_DAYS = 7
#: Measured size of the keys up to which a batch filters the stored postings.
SMALL_BATCH_BYTES = 32 * 1024 * 1024
#: Scope of keys that hold across companies.
ANY_COMPANY = -(2**63)
TIERS = (1, 2, 3, 4)


def _blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _key_rows(rows: DataFrame, keep: list[str], *entries: tuple[int, Column, Column]) -> DataFrame:
    """``keep`` columns with one ``tier, scope, k`` row per entry that has both."""
    made = F.array(*[F.struct(F.lit(t).alias("tier"), scope.alias("scope"), k.alias("k")) for t, scope, k in entries])
    return rows.select(*keep, F.inline(made)).filter(F.col("scope").isNotNull() & F.col("k").isNotNull())


def stored_keys(stored: DataFrame) -> DataFrame:
    """(tier, scope, k, id, discovered_at) rows under which stored postings are found, for every kind of asking."""
    # a projection of its own: inside the generator each use of a link or title would normalise it again
    named = stored.select(
        "id", "discovered_at", F.col("company_id").alias("k_company"),
        _blank_to_null(F.col("external_id")).alias("k_ext"),
        *[_blank_to_null(urls.normalize_url(F.col(c))).alias(f"k_{c}") for c in ("url", "source_url")],
        _blank_to_null(text.normalize_title(F.col("title"))).alias("k_title"),
    )
    company, any_scope, ext = F.col("k_company"), F.lit(ANY_COMPANY), F.col("k_ext")
    rows = _key_rows(
        named, ["id", "discovered_at"],
        (1, company, ext),
        *[(2, scope, F.col(f"k_{c}")) for c in ("url", "source_url") for scope in (company, any_scope)],
        (3, company, F.col("k_title")),
        (4, any_scope, ext),
    )
    return rows.select(F.col("tier").cast("int"), F.col("scope").cast("long"), "k", F.col("id").cast("long"), "discovered_at")


def _kept_hits(wanted: DataFrame, key: str, keys: DataFrame, as_of: str) -> DataFrame:
    """Asked keys with one kept id each: the smallest, in tier 4 the latest if it is recent.

    The tiers are joined apart, so that the many keys of the first three are a
    plain hash aggregate inside their buckets. Each join makes only the keys it
    asks for; the fourth needs neither links nor titles.
    """
    on = ["tier", "scope", "k"]
    horizon = dates.plus(dates.ts(as_of), -CROSS_COMPANY_DAYS, "day")
    found = keys.filter("tier < 4").groupBy(*on).agg(F.min("id").alias("id"))
    recent = keys.filter((F.col("tier") == 4) & (F.col("discovered_at") >= horizon))
    last = recent.groupBy(*on).agg(F.max(F.struct("discovered_at", (-F.col("id")).alias("neg"))).alias("last"))
    by_id = last.select(*on, (-F.col("last.neg")).alias("id"))
    first, fourth = _asked_keys(wanted, key, (1, 2, 3)), _asked_keys(wanted, key, (4,))
    return first.join(found, on).unionByName(fourth.join(by_id, on))


def find_duplicates(
    incoming: DataFrame, stored: DataFrame | None, as_of: str, key: str = "seq", settle: bool = True, keys: DataFrame | None = None
) -> DataFrame:
    """Per incoming row the first tier that finds a stored posting, and its id.

    Tiers: 1 external id and company; 2 normalised URL, within the company when
    it is known; 3 normalised title and company; 4 the latest posting with that
    external id, if it is at most 7 days old. Of several the smallest id counts.

    All tiers share one pass: both sides become (tier, scope, key) rows, stored
    rows are cut to one per key by a hash aggregate, so equal keys on both sides
    never multiply, and the hits of a row are folded by tier. A small batch first
    filters the stored rows to its own keys without shuffling them.
    ``settle=False`` when ``incoming`` is already a settled frame. ``keys`` brings
    the stored rows' keys from a kept table (``sources.duplicate_keys``); then
    ``stored`` is not read.
    """
    any_scope = F.lit(ANY_COMPANY)
    company = F.col("company_id")
    new_url = F.when(F.coalesce(F.col("url"), F.lit("")) != "", F.col("url")).otherwise(F.col("source_url"))
    wanted = incoming.select(
        F.col(key),
        company.alias("k_company"),
        _blank_to_null(F.col("external_id")).alias("k_ext"),
        _blank_to_null(urls.normalize_url(new_url)).alias("k_url"),
        _blank_to_null(text.normalize_title(F.col("title"))).alias("k_title"),
    )
    if settle:
        wanted = settled(wanted, "wanted")
    if keys is not None:
        return _folded_hits(wanted, key, _kept_hits(wanted, key, keys, as_of))
    # external ids are asked for twice; 96 covers the fixed part of the four key rows
    width = F.octet_length(F.concat_ws("", "k_ext", "k_ext", "k_url", "k_title")) + 96
    facts = wanted.agg(
        F.coalesce(F.sum(width), F.lit(0)).alias("bytes"), F.count_if(F.col("k_company").isNull()).alias("free")
    ).first()
    asked = _asked_keys(wanted, key)

    ext = _blank_to_null(F.col("external_id"))
    links = [_blank_to_null(urls.normalize_url(F.col(c))) for c in ("url", "source_url")]
    scopes = [company, any_scope] if facts["free"] else [company]
    offered = _key_rows(
        stored, ["id"],
        (1, company, ext),
        *[(2, scope, link) for link in links for scope in scopes],
        (3, company, _blank_to_null(text.normalize_title(F.col("title")))),
    )
    horizon = dates.plus(dates.ts(as_of), -CROSS_COMPANY_DAYS, "day")
    # the latest posting is recent only if it is among the recent ones
    recent = _key_rows(dates.in_range(stored, "discovered_at", since=horizon), ["id", "discovered_at"], (4, any_scope, ext))
    on = ["tier", "scope", "k"]
    if facts["bytes"] <= SMALL_BATCH_BYTES:
        keys = F.broadcast(asked.select(*on))
        offered, recent = offered.join(keys, on, "left_semi"), recent.join(keys, on, "left_semi")
    found = offered.groupBy(*on).agg(F.min("id").alias("id"))
    last = recent.groupBy(*on).agg(F.max(F.struct("discovered_at", (-F.col("id")).alias("neg"))).alias("last"))
    lookup = found.unionByName(last.select(*on, (-F.col("last.neg")).alias("id")))

    return _folded_hits(wanted, key, asked.join(lookup, on))


def _asked_keys(wanted: DataFrame, key: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """The keys of incoming rows, tier by tier."""
    any_scope = F.lit(ANY_COMPANY)
    entries = (
        (1, F.col("k_company"), F.col("k_ext")),
        (2, F.coalesce(F.col("k_company"), any_scope), F.col("k_url")),
        (3, F.col("k_company"), F.col("k_title")),
        (4, any_scope, F.col("k_ext")),
    )
    return _key_rows(wanted, [key], *[e for e in entries if e[0] in tiers])


def _folded_hits(wanted: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """Per incoming row the first tier with a hit, and the hit."""
    hits = found.select(key, "tier", "id")
    # one bare row per posting keeps those without a hit
    every = wanted.select(key, F.lit(None).cast("int").alias("tier"), F.lit(None).cast("bigint").alias("id"))
    out = hits.unionByName(every).groupBy(key).agg(*[F.min(F.when(F.col("tier") == n, F.col("id"))).alias(f"t{n}") for n in TIERS])
    tier = F.coalesce(*[F.when(F.col(f"t{n}").isNotNull(), n) for n in TIERS])
    return out.select(key, tier.alias("tier"), F.coalesce(*[F.col(f"t{n}") for n in TIERS]).alias("match_id"))


def duplicate_groups(jobs: DataFrame) -> DataFrame:
    """External ids used more than once, with their members.

    Members come as sorted arrays in pages of about 1000, so a group of any
    size is whole and no array grows with it; ``group_count`` is the full size.

    Only the counts of groups of more than a page meet the postings again, at most
    one row in PAGE_SIZE; the others are counted as they are collected.
    """
    filled = jobs.filter(F.col("external_id").isNotNull()).select("id", "external_id", "company_id")
    big = child_counts(filled, "external_id", "group_count").filter(F.col("group_count") > scale.PAGE_SIZE)
    # an id that a third of all postings share meets its count in many tasks
    members = salted_join(filled, settled(big.withColumnRenamed("_parent", "external_id"), "group-counts"), ["external_id"], "left")
    paged = paged_ids(members, F.coalesce("group_count", F.lit(1)))
    pairs = F.sort_array(F.collect_list(F.struct("id", "company_id")))
    grouped = paged.groupBy("external_id", "page").agg(pairs.alias("members"), F.max("group_count").alias("_big"))
    return (
        grouped.withColumn("group_count", F.coalesce("_big", F.size("members").cast("bigint")))
        .filter(F.col("group_count") > 1)
        .select(
            "external_id", "group_count", "page",
            F.col("members.id").alias("job_ids"), F.col("members.company_id").alias("company_ids"),
        )
    )


def duplicate_pairs(jobs: DataFrame) -> DataFrame:
    """(external id, company) pairs used more than once."""
    counted = jobs.groupBy("external_id", "company_id").agg(F.count(F.lit(1)).alias("count"))
    return counted.filter(F.col("count") > 1)


def dedupe_postings(postings: DataFrame, order: str, drop_empty: bool = False) -> DataFrame:
    """First posting per (URL, title), both lower and trimmed."""
    keyed = postings.withColumn("_u", F.lower(F.trim(F.coalesce(F.col("url"), F.lit(""))))).withColumn(
        "_t", F.lower(F.trim(F.coalesce(F.col("title"), F.lit(""))))
    )
    if drop_empty:
        keyed = keyed.filter((F.col("_u") != "") & (F.col("_t") != ""))
    return keep_first(keyed, ["_u", "_t"], [F.col(order)]).drop("_u", "_t")


def dedupe_by_id(postings: DataFrame, order: str, keys: tuple[str, ...] = ("external_id",)) -> DataFrame:
    return keep_first(postings, list(keys), [F.col(order)])


def dedupe_companies(records: DataFrame, order: str = "seq") -> DataFrame:
    """Highest priority per lower-case trimmed name (two or more characters)."""
    named = records.withColumn("_n", F.trim(F.lower("name"))).filter(F.length("_n") >= 2)
    return keep_first(named, ["_n"], [F.col("priority").desc(), F.col(order)]).drop("_n")
