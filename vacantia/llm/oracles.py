"""DuckDB text for the corpus queries that SQL can express."""

ORACLES: dict[str, str] = {}

#: Words of a text: A-Z lower-cased, cut at x20 and x09-x0D; no empty words.
WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

ORACLES["op3_decontamination"] = f"""
WITH item_words AS (SELECT item_id, {WORDS} AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: list_slice(w, i, i + least(5, len(w)) - 1))) AS g FROM item_words WHERE len(w) > 0),
sizes AS (SELECT item_id, k, count(*) AS n_item FROM items GROUP BY ALL),
doc_words AS (SELECT DISTINCT doc_id, {WORDS} AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1))) AS g FROM doc_words, (SELECT DISTINCT k FROM sizes) WHERE len(w) >= k),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM grams JOIN items USING (k, g) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM shared JOIN sizes USING (item_id) WHERE n_shared >= 0.8 * n_item - 1e-9"""

ORACLES["op4_near_dedup"] = f"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS} AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' '))) AS s FROM words WHERE len(w) > 0),
grams AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT d.doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sets s USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id"""

ORACLES["op8_embedding_dedup"] = """
WITH RECURSIVE able AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
 WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
 WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) END >= 0.98),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
JOIN (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) c ON c.vec_id = e.vec_id"""

#: CRC-32 of the UTF-8 bytes by its table of 256 entries, made from the polynomial.
ORACLES["op2_sharding"] = r"""
WITH RECURSIVE bits AS (SELECT n, n AS c, 0 AS k FROM range(256) t(n) UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY n) AS tab FROM bits WHERE k = 8),
raw AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
 list_filter(list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\1,', 'g'), ','), lambda h: CASE WHEN h <> '' THEN CAST('0x' || h AS BIGINT) END), lambda x: x IS NOT NULL) AS bytes FROM documents),
sums AS (SELECT doc_id, size, CASE WHEN len(bytes) = 0 THEN 0 ELSE xor(list_reduce(bytes, lambda a, x: xor(a // 256, tab[xor(a, x) % 256 + 1]), 4294967295), 4294967295) END AS text_crc32 FROM raw, crc),
scores AS (SELECT doc_id, shard, -ln((CAST('0x' || substr(md5(doc_id || ':' || shard), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS score FROM (SELECT DISTINCT doc_id FROM documents), range(17) t(shard)),
placed AS (SELECT doc_id, arg_min(shard, (score, shard)) FILTER (shard < 16) AS shard, arg_min(shard, (score, shard)) AS grown_shard FROM scores GROUP BY doc_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
 row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, CAST(grown_shard AS INT) AS grown_shard FROM sums JOIN placed USING (doc_id)"""

#: All orders of the filters, and for every mask the step at which each order removes it.
ORACLES["op11_filter_audit"] = r"""
WITH RECURSIVE orders(o) AS (SELECT '' UNION ALL SELECT o || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(o, f)),
texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM texts GROUP BY t),
fails AS (SELECT doc_id, part, concat(CASE WHEN len(w) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END,
 CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > first_id THEN 'E' END) AS m
 FROM texts JOIN firsts USING (t)),
marks AS (SELECT doc_id, max(CAST(coalesce(quality = 1, FALSE) AS INT)) AS good, max(CAST(coalesce(toxic = 1, FALSE) AS INT)) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, m, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM fails LEFT JOIN marks USING (doc_id) GROUP BY part, m),
steps AS (SELECT part, o, s, substr(o, s, 1) AS f, c.* EXCLUDE (part), CASE WHEN m = '' THEN 6 ELSE list_min(list_transform(string_split(m, ''), lambda x: strpos(o, x))) END AS gone
 FROM cells c, orders, range(1, 6) r(s) WHERE length(o) = 5),
lines AS (SELECT part, o AS filter_order, CAST(s AS INT) AS step, f AS filter, sum(CASE WHEN gone > s THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = s THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN contains(m, f) AND gone < s THEN n ELSE 0 END) AS redundant, sum(CASE WHEN m = f THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN gone = s THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = s THEN toxic ELSE 0 END) AS toxic_lost FROM steps GROUP BY part, o, s, f)
SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM lines"""

#: Tokens by the pattern itself, cut and joined as lists.
ORACLES["op12_fill_in_middle"] = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS d FROM texts),
cuts AS (SELECT doc_id, t, u, len(u) AS n, least(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS a, greatest(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT doc_id, t, n, form, coalesce(array_to_string(list_slice(u, 1, a), ''), '') AS p, coalesce(array_to_string(list_slice(u, a + 1, b), ''), '') AS m, coalesce(array_to_string(list_slice(u, b + 1, n), ''), '') AS s FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts"""

#: Every window of 100 bytes by its text; removed bytes are those within 100 of a window that has an earlier one.
ORACLES["op13_suffix_dedup"] = r"""
WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, p, substr(h, 1, 200) AS g FROM (SELECT doc_id, unnest(range(1, n - 98)) AS p, hex(array_slice(b, p, p + 99)) AS h FROM texts WHERE n >= 100)),
repeats AS (SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY md5(g) ORDER BY doc_id, p) > 1),
runs AS (SELECT doc_id, min(p) AS low, max(p) + 99 AS high FROM (SELECT doc_id, p, sum(CASE WHEN p <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
 FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM repeats)) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, list({'a': low, 'z': high} ORDER BY low) AS r, sum(high - low + 1) AS removed, count(*) AS spans FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, n, coalesce(removed, 0) AS removed, coalesce(spans, 0) AS spans, CASE WHEN r IS NULL THEN hex(b)
 ELSE array_to_string(list_transform(range(1, len(r) + 2), lambda i: hex(array_slice(b, CASE WHEN i = 1 THEN 1 ELSE r[i - 1].z + 1 END, CASE WHEN i > len(r) THEN n ELSE r[i].a - 1 END))), '') END AS rest FROM texts LEFT JOIN gaps USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept"""
