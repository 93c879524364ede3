"""Listings, names, JSON keys, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import json_walk
from brindle.functions import scalars as S
from brindle.functions.json_variant import leaf_rows
from brindle.operators import audit, normalize
from brindle.operators import profile as P
from brindle.plans.registry import query
from brindle.session import table
from brindle.sources import files

#: A URL without query and fragment, and its path below the host.
CLEAN = r"[?#].*$"
BELOW = r"^[a-z]+://[^/]+(/.*)?$"
PATH_SQL = f"regexp_extract(regexp_replace(url, '{CLEAN}', ''), '{BELOW}', 1)"


def pages(spark, sf: str) -> DataFrame:
    """page_id, url, path, length: pages as files."""
    path = F.regexp_extract(F.regexp_replace("url", CLEAN, ""), BELOW, 1)
    return table(spark, sf, "pages").select("page_id", "url", path.alias("path"), F.octet_length("html").cast("long").alias("length"))


@query(f"""SELECT lower(regexp_extract({PATH_SQL}, '\\.([A-Za-z0-9]+)$', 1)) AS extension, count(*) AS n, sum(strlen(html))::BIGINT AS bytes FROM pages GROUP BY 1""")
def listing_ext_counts(spark, sf):
    return P.extension_counts(pages(spark, sf))


@query("""SELECT page_id, CASE WHEN contains(url, '/en/') THEN '/en/' WHEN contains(url, '/fr/') THEN '/fr/' WHEN contains(url, '/de/') THEN '/de/' WHEN contains(url, '/es/') THEN '/es/' END AS species,
CASE WHEN contains(url, '//m.') THEN '//m.' WHEN contains(url, '//blog.') THEN '//blog.' END AS camera,
CASE WHEN contains(url, 'ref=') OR regexp_matches(url, '[/](8|9)[0-9]') THEN 'train' WHEN contains(url, 'utm_') OR regexp_matches(url, '[/](6|7)[0-9]') THEN 'val' END AS src_split,
coalesce(nullif(CASE WHEN contains(url, '//m.') THEN '//m.' WHEN contains(url, '//blog.') THEN '//blog.' END, ''), split_part(url, ':', 1)) AS preferred FROM pages""")
def path_axes(spark, sf):
    p = table(spark, sf, "pages")
    camera = S.axis("url", ("//m.", "//blog."))
    split = S.src_split("url", {"train": ("ref=", "[/](8|9)[0-9]"), "val": ("utm_", "[/](6|7)[0-9]")})
    return p.select("page_id", S.axis("url", ("/en/", "/fr/", "/de/", "/es/")).alias("species"), camera.alias("camera"), split.alias("src_split"), S.prefer(camera, F.split_part("url", F.lit(":"), F.lit(1))).alias("preferred"))


@query(f"""WITH p AS (SELECT list_filter(string_split({PATH_SQL}, '/'), lambda s: s <> '') AS a FROM pages),
s AS (SELECT (i - 1)::INT AS depth, a[i] AS value FROM p, unnest(range(1, len(a) + 1)) u(i)), g AS (SELECT depth, value, count(*) AS n FROM s GROUP BY ALL)
SELECT depth, value, n FROM g QUALIFY row_number() OVER (PARTITION BY depth ORDER BY n DESC, value) <= 15""")
def depth_segments_topk(spark, sf):
    return P.depth_segments(pages(spark, sf))


TOKENS = {"lang": ("/en/", "/fr/", "/de/", "/es/"), "host": ("//m.", "//blog.", "spam-farm"), "tld": (".com", ".net", ".org"), "track": ("utm_", "ref=", "#top")}


@query("SELECT axis, token, count(*) AS n FROM pages, (VALUES " + ", ".join(f"('{a}', '{t}')" for a, ts in TOKENS.items() for t in ts) + ") v(axis, token) WHERE contains(url, token) GROUP BY ALL")
def axis_token_hits(spark, sf):
    return P.axis_hits(pages(spark, sf), TOKENS, "url")


@query("""SELECT coalesce(bool_or(contains(url, '/de/')), false) AS has_normal FROM pages""")
def axis_has_normal(spark, sf):
    return P.has_normal(pages(spark, sf), "url", "/de/")


_SHAPE = "regexp_replace(regexp_replace({0}, '[0-9]+', '#', 'g'), '[A-Za-z]+', 'L', 'g')"


@query(f"""WITH x AS (SELECT c_name AS v FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT url FROM pages),
g AS (SELECT {_SHAPE.format('v')} AS value, count(*) AS n FROM x GROUP BY 1) SELECT value, n FROM g ORDER BY n DESC, value LIMIT 10""")
def name_pattern_topk(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_name").alias("v")).union(table(spark, sf, "supplier").select("s_name")).union(table(spark, sf, "pages").select("url"))
    return P.name_shapes(names, "v")


@query("""SELECT nullif(regexp_extract(p_brand || '_A' || (p_size % 9)::VARCHAR || '.jpg', '(?:^|[/_. -])(A[1-7])(?:$|[/_. -])', 1), '') AS class, count(*) AS n FROM part GROUP BY 1""")
def class_code_counts(spark, sf):
    return P.class_counts(table(spark, sf, "part").select(F.concat("p_brand", F.lit("_A"), (F.col("p_size") % 9).cast("string"), F.lit(".jpg")).alias("path")))


@query(f"""WITH x AS (SELECT string_split_regex('S' || o_custkey || '_' || o_orderstatus || '-' || o_orderpriority || '.' || o_orderkey, '[_.-]') AS a FROM orders),
t AS (SELECT (i - 1)::INT AS position, a[i] AS token FROM x, unnest(range(1, least(len(a), 8) + 1)) u(i) WHERE a[i] <> ''), g AS (SELECT position, token, count(*) AS n FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY n DESC, token) AS r FROM g),
s AS (SELECT position, sum(n)::BIGINT AS total, count(*) AS n_unique, bool_and(regexp_matches(token, '^A[1-7]$')) FILTER (r <= 3) AS codes FROM r GROUP BY 1)
SELECT position, total, n_unique, round(total / n_unique, 6) AS ratio FROM s WHERE total >= 50 AND n_unique >= 5 AND total / n_unique >= 2 AND n_unique < total / 2 AND NOT codes ORDER BY n_unique DESC, position LIMIT 5""")
def id_token_candidates(spark, sf):
    o = table(spark, sf, "orders")
    return P.id_token_candidates(o.select(F.concat(F.lit("S"), "o_custkey", F.lit("_"), "o_orderstatus", F.lit("-"), "o_orderpriority", F.lit("."), "o_orderkey").alias("name")), "name")


def _leaves(spark, sf):
    """The leaves of events' props, in document order."""
    json_walk.register(spark)
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), "props")
    return spark.sql("SELECT id, f.* FROM {rows}, LATERAL flatten_json(props) f", rows=e)


def _profiled(spark, sf):
    """The leaves of events' props in any order, and events."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), "props")
    return leaf_rows(e, "props"), e


@query("""WITH l AS (SELECT event_id, k, json_extract_string(props, '$.' || k) AS v FROM events, unnest(json_keys(props)) u(k))
SELECT k AS path, count(*) AS n, count(*) / (SELECT count(*) FROM events) AS freq, MAP {'int': count(*)} AS types, [arg_min(v, event_id)] AS examples FROM l GROUP BY k""")
def json_flatten_profile(spark, sf):
    leaves, e = _profiled(spark, sf)
    return P.key_profile(leaves, e)


HINTS = {"animal_id": ("id", "no", "k"), "width": ("width", "w"), "height": ("k",), "label": ("label", "kind")}


@query("""WITH l AS (SELECT k AS path, count(*) / (SELECT count(*) FROM events)::DOUBLE AS freq, arg_min(json_extract_string(props, '$.' || k), event_id) AS ex FROM events, unnest(json_keys(props)) u(k) GROUP BY k),
h(role, hint) AS (VALUES ('animal_id', 'id'), ('animal_id', 'no'), ('animal_id', 'k'), ('width', 'width'), ('width', 'w'), ('height', 'k'), ('label', 'label'), ('label', 'kind')),
s AS (SELECT role, path, freq, ex, sum(CASE WHEN lower(path) = hint THEN 3.0::DOUBLE WHEN contains(lower(path), hint) THEN 1.5::DOUBLE ELSE 0 END) AS s FROM l, h GROUP BY ALL HAVING s > 0),
b AS (SELECT role, path, s * freq + CASE WHEN role IN ('width', 'height') THEN 1.0::DOUBLE WHEN role = 'animal_id' AND length(ex) < 40 THEN 0.5::DOUBLE ELSE 0 END AS score FROM s)
SELECT role, path, score FROM b QUALIFY row_number() OVER (PARTITION BY role ORDER BY score DESC, path) = 1""")
def json_role_guess(spark, sf):
    leaves, e = _profiled(spark, sf)
    return P.role_guess(P.key_profile(leaves, e), HINTS)


@query("""SELECT event_id AS id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def json_find_first(spark, sf):
    return json_walk.find_first(_leaves(spark, sf), ["k"])


@query("""SELECT event_id AS id, [json_extract_string(props, '$.k')::DOUBLE] AS numbers FROM events""")
def json_collect_numbers(spark, sf):
    return json_walk.collect_numbers(_leaves(spark, sf), ["k"])


@query("""SELECT user_id, count(*) AS n, sum((e.j->>'k')::BIGINT)::BIGINT AS total FROM (SELECT user_id, props AS j FROM events) e GROUP BY 1""")
def variant_projection(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query(r"""WITH x AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'n/a' ELSE (p_size * 40) || ' x ' || (p_size * 30) END AS t FROM part)
SELECT p_partkey, nullif(regexp_extract(t, '^\s*([0-9]+)\s*[xX*×]\s*([0-9]+)\s*$', 1), '')::INT AS w, nullif(regexp_extract(t, '^\s*([0-9]+)\s*[xX*×]\s*([0-9]+)\s*$', 2), '')::INT AS h FROM x""")
def parse_resolution(spark, sf):
    text = F.when(F.col("p_size") % 5 == 0, "n/a").otherwise(F.concat((F.col("p_size") * 40).cast("string"), F.lit(" x "), (F.col("p_size") * 30).cast("string")))
    return table(spark, sf, "part").select("p_partkey", text.alias("t")).select("p_partkey", S.resolution("t", 1).alias("w"), S.resolution("t", 2).alias("h"))


@query("""WITH x AS (SELECT 'G_' || coalesce(trim(source), '') || '|' || coalesce(trim(lang), '') || '|' || (n_chars % 7) AS id FROM documents)
SELECT count(DISTINCT id) AS n_ids, count(*) AS n_rows, count(*) / count(DISTINCT id) AS rows_per_id, count(*) / count(DISTINCT id) < 1.5 AS warn FROM x""")
def surrogate_id(spark, sf):
    d = table(spark, sf, "documents").select(S.surrogate_id(["source", "lang", F.col("n_chars") % 7]).alias("id"))
    return P.id_sanity(d, "id")


@query("""WITH g AS (SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1) SELECT max(n) / min(n) AS imbalance FROM g""")
def label_imbalance(spark, sf):
    return P.imbalance(table(spark, sf, "events"), "event_type")


@query("""SELECT 'toxic' AS "column", avg((toxic IS NULL)::INT) AS null_rate FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'lang', avg((lang IS NULL)::INT) FROM documents""")
def null_rates(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return P.null_rates(d, ["toxic", "lang"])


@query("""WITH m AS (SELECT quality, n_chars FROM documents LEFT JOIN labels USING (doc_id))
SELECT quality, count(*) AS n, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share, median(n_chars)::DOUBLE AS median_value FROM m GROUP BY quality""")
def manifest_profile(spark, sf):
    m = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    return P.manifest_profile(m, "quality", "n_chars")


@query("""WITH s AS (SELECT list_sort(list(n_chars)) AS a, count(*) AS n FROM documents)
SELECT a[least(floor(n * 0.1::DOUBLE), n - 1)::INT + 1] AS p10, a[least(floor(n * 0.25::DOUBLE), n - 1)::INT + 1] AS p25, a[least(floor(n * 0.5::DOUBLE), n - 1)::INT + 1] AS p50, a[least(floor(n * 0.75::DOUBLE), n - 1)::INT + 1] AS p75, a[least(floor(n * 0.9::DOUBLE), n - 1)::INT + 1] AS p90 FROM s""")
def floor_rank_quantiles(spark, sf):
    return audit.floor_quantiles(table(spark, sf, "documents"), "n_chars", [0.1, 0.25, 0.5, 0.75, 0.9])


@query("""SELECT lang, count(*) AS n, quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS p75 FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def linear_quantiles_by_label(spark, sf):
    return audit.quantiles_by_label(table(spark, sf, "documents"), "lang", "n_chars")


@query("""WITH m AS (SELECT lang, quantile_cont(n_chars, 0.5) AS median FROM documents WHERE lang IS NOT NULL GROUP BY lang),
g AS (SELECT max(median) FILTER (lang = 'en') AS normal, quantile_cont(median, 0.5) FILTER (lang <> 'en') AS lesion, max(median) FILTER (lang <> 'en') AS hi, min(median) FILTER (lang <> 'en') AS lo,
 arg_max(lang, (median, lang)) FILTER (lang <> 'en') AS largest, arg_min(lang, (median, lang)) FILTER (lang <> 'en') AS smallest FROM m)
SELECT normal / lesion AS ratio, hi / lo AS spread, largest, smallest, normal / lesion > 1.5 OR normal / lesion < 0.67 AS scale_leak, hi / lo > 2 AS uneven FROM g""")
def label_spread(spark, sf):
    return audit.label_spread(table(spark, sf, "documents"), "lang", "n_chars", "en")


@query("""WITH g AS (SELECT md5(text) AS h, count(*) AS n, count(DISTINCT lang) AS k FROM documents GROUP BY 1)
SELECT count(*) FILTER (n > 1) AS groups, sum(n - 1)::BIGINT AS extra, sum(n)::BIGINT AS rows, count(*) FILTER (k > 1) AS cross_class, sum(n - 1) / sum(n)::DOUBLE AS dup_rate FROM g""")
def exact_dup_estimate(spark, sf):
    d = table(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("h"), "lang")
    return audit.exact_duplicates(d, "h", "lang")


@query("""SELECT text AS image_name, count(DISTINCT source) AS n_labels FROM documents GROUP BY text HAVING count(DISTINCT source) > 1""")
def names_with_labels(spark, sf):
    return audit.names_with_labels(table(spark, sf, "documents"), "text", "source").withColumnRenamed("text", "image_name")


@query("""WITH f AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '├─ part ' || (page_id % 7) ELSE NULL END AS folder FROM pages),
c AS (SELECT page_id, coalesce(last_value(folder IGNORE NULLS) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS folder FROM f)
SELECT c.page_id, regexp_replace(folder, '^├─ ', '') AS folder, 'p' || c.page_id || '.zip' AS name, (strlen(html) % 50 + 1) || '.5 MB' AS size, (100 + c.page_id)::VARCHAR AS filekey, (strlen(html) % 50 + 1.5::DOUBLE) * 0.001::DOUBLE AS size_gb
FROM c JOIN pages p ON p.page_id = c.page_id WHERE c.page_id % 5 <> 0""")
def listing_carry_down(spark, sf):
    p = table(spark, sf, "pages")
    row = F.concat(F.lit("│  └─ p"), "page_id", F.lit(".zip | "), F.octet_length("html") % 50 + 1, F.lit(".5 MB | "), F.col("page_id") + 100)
    lines = p.select("page_id", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("├─ part "), F.col("page_id") % 7)).otherwise(row).alias("value"))
    return files.parse_listing(lines, "page_id")


@query(f"""WITH f AS (SELECT page_id, {PATH_SQL} AS path FROM pages) SELECT page_id, path FROM f WHERE regexp_matches(lower(path), '\\.(html|htm)$') AND NOT regexp_matches(path, '/9[0-9]{{2}}\\.html$')""")
def archive_filter(spark, sf):
    p = pages(spark, sf)
    return p.filter(F.lower("path").rlike(r"\.(html|htm)$") & ~p["path"].rlike(r"/9[0-9]{2}\.html$")).select("page_id", "path")


@query("""SELECT doc_id, n_chars, running FROM (SELECT doc_id, n_chars, sum(n_chars::DOUBLE) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running <= 1000000""")
def size_budget_prefix(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return normalize.within_budget(d, "n_chars", 1e6, ["doc_id"])


@query("""SELECT page_id, url FROM pages WHERE NOT contains(url, 'spam-farm') AND (contains(url, '/en/') OR NOT (contains(url, '/fr/') OR contains(url, '/de/')))""")
def select_files(spark, sf):
    return normalize.select_files(pages(spark, sf), "url", include=[["/en/", "/fr/", "/de/"]], exclude=["spam-farm"]).select("page_id", "url")


@query("""WITH f AS (SELECT lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1)) AS e, strlen(html) AS n FROM pages)
SELECT count(*) FILTER (e IN ('bmp', 'jpeg', 'jpg', 'png', 'webp')) AS images, count(*) FILTER (e = 'json') AS jsons, round(sum(n) / 1073741824.0::DOUBLE, 2) AS size_gb, count(*) FILTER (e IN ('bmp', 'jpeg', 'jpg', 'png', 'webp')) = 0 AS no_images FROM f""")
def listing_verify(spark, sf):
    return files.verify(pages(spark, sf))


@query("""WITH l AS (SELECT event_id, k, json_extract_string(props, '$.' || k) AS v FROM events, unnest(json_keys(props)) u(k))
SELECT k AS path, count(*) AS n, count(DISTINCT v) AS n_unique, count(DISTINCT event_id) / count(DISTINCT v)::DOUBLE AS rows_per_value, count(DISTINCT event_id) / count(DISTINCT v)::DOUBLE BETWEEN 1.5 AND 200 AND count(DISTINCT v) > 3 AS may_be_id FROM l GROUP BY k""")
def json_key_uniques(spark, sf):
    return P.key_uniques(_profiled(spark, sf)[0])


@query("SELECT 'k' || (p_size % 3) AS kind, sum(p_retailprice) AS gb, max(p_retailprice) AS largest, sum(p_retailprice) <= 1500 AS fits, max(p_retailprice) <= 1500 AS largest_fits FROM part GROUP BY 1")
def label_size_plan(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("k"), (F.col("p_size") % 3).cast("string")).alias("kind"), F.col("p_retailprice").alias("gb"))
    return files.label_plan(p, 1500.0)


@query("SELECT (p_size % 5 + 1) * 100 || 'x' || (p_size % 3 + 1) * 50 AS value, count(*) AS n FROM part GROUP BY 1")
def size_histogram(spark, sf):
    return P.size_histogram(table(spark, sf, "part").select(((F.col("p_size") % 5 + 1) * 100).alias("width"), ((F.col("p_size") % 3 + 1) * 50).alias("height")))


_RUNS = "SELECT page_id, '/root/' || CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END || '/run' || (page_id % 7) || '/' || CASE WHEN page_id % 3 = 0 THEN 'last.pt' ELSE 'best.pt' END AS path FROM pages"


@query(f"SELECT DISTINCT split_part(path, '/', 4) AS name FROM ({_RUNS}) WHERE path LIKE '%/best.pt'")
def run_names(spark, sf):
    p = table(spark, sf, "pages")
    path = F.concat(F.lit("/root/"), F.when(F.col("page_id") % 2 == 0, "a").otherwise("b"), F.lit("/run"), (F.col("page_id") % 7).cast("string"), F.lit("/"), F.when(F.col("page_id") % 3 == 0, "last.pt").otherwise("best.pt"))
    listed = p.select(path.alias("path"))
    return files.run_names([listed.filter(F.col("path").startswith("/root/a/")), listed.filter(F.col("path").startswith("/root/b/"))])


@query("""SELECT o_orderkey, name FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '/d/download_20240101_120000.tar' WHEN 1 THEN '/d/TL01.ZIP' WHEN 2 THEN '/d/x.tar.gz' WHEN 3 THEN '/d/zip' ELSE '/d/a.tar' END AS name FROM orders) WHERE o_orderkey % 5 IN (1, 2, 4)""")
def finished_archives(spark, sf):
    k = F.col("o_orderkey") % 5
    name = F.when(k == 0, "/d/download_20240101_120000.tar").when(k == 1, "/d/TL01.ZIP").when(k == 2, "/d/x.tar.gz").when(k == 3, "/d/zip").otherwise("/d/a.tar")
    return files.archives(table(spark, sf, "orders").select("o_orderkey", name.alias("name")), "name")


def _json(**parts) -> Column:
    """JSON text of an object; values are columns of JSON text."""
    out = [F.lit("{")]
    for n, (k, v) in enumerate(parts.items()):
        out += [F.lit((", " if n else "") + f'"{k}": '), v.cast("string")]
    return F.concat(*out, F.lit("}"))


def _quoted(*parts) -> Column:
    return F.concat(F.lit('"'), *(p.cast("string") for p in parts), F.lit('"'))


def _nested(part: DataFrame) -> DataFrame:
    """id, json: nested label files of parts, three deep, with lists; every seventh is a list of two records and a number."""
    k, s = F.col("p_partkey"), F.col("p_size")
    raw = _json(id=_quoted(F.lit("p"), k), size=s, ratio=F.concat(s, F.lit(".5")))
    item = _json(code=_quoted(F.lit("A"), s % 7 + 1), pos=F.concat(F.lit("["), s, F.lit(", "), s + 1, F.lit("]")))
    items = F.concat(F.lit("["), item, F.lit(', {"code": "zz", "other": 1}]'))
    one = _json(meta=_json(raw=raw, tags=F.lit("[]"), box=F.lit("{}")), items=items, ok=F.when(s % 2 == 0, "true").otherwise("null"), mixed=F.when(s % 3 == 0, s.cast("string")).otherwise(_quoted(F.lit("s"), s)))
    two = F.concat(F.lit("["), one, F.lit(", 5, "), _json(late=_json(x=k)), F.lit("]"))
    return part.select(k.alias("id"), F.when(k % 7 == 0, two).otherwise(one).alias("json"))


_NESTED_SQL = """t AS (SELECT p_partkey AS id, '{"meta": {"raw": {"id": "p' || p_partkey || '", "size": ' || p_size || ', "ratio": ' || p_size || '.5}, "tags": [], "box": {}}, "items": [{"code": "A' || (p_size % 7 + 1) || '", "pos": [' || p_size || ', ' || (p_size + 1) || ']}, {"code": "zz", "other": 1}], "ok": ' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'null' END || ', "mixed": ' || CASE WHEN p_size % 3 = 0 THEN p_size::VARCHAR ELSE '"s' || p_size || '"' END || '}' AS one FROM part),
j AS (SELECT id, CASE WHEN id % 7 = 0 THEN '[' || one || ', 5, {"late": {"x": ' || id || '}}]' ELSE one END AS j FROM t),
u AS (SELECT j.id, regexp_replace(u.fullkey, '^\\$(\\[[0-9]+\\])?\\.?', '') AS k, u.type AS ty, u.value AS v FROM j, LATERAL (SELECT * FROM json_tree(j.j)) u WHERE NOT (j.id % 7 = 0 AND u.fullkey = '$[1]')),
l AS (SELECT id, replace(k, '[0]', '[]') || CASE WHEN ty = 'ARRAY' THEN '[]' ELSE '' END AS path,
 CASE ty WHEN 'VARCHAR' THEN 'str' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' ELSE 'NoneType' END AS type, CASE WHEN ty IN ('ARRAY', 'NULL') THEN NULL ELSE json_extract_string(v, '$') END AS value
 FROM u WHERE NOT regexp_matches(k, '\\[[1-9]') AND (ty NOT IN ('OBJECT', 'ARRAY') OR v = '[]'))"""


@query(f"""WITH {_NESTED_SQL}, g AS (SELECT path, type, count(*) AS n, min((id, value)) AS e FROM l GROUP BY ALL)
SELECT path, sum(n)::BIGINT AS n, sum(n) / (SELECT count(*) FROM part)::DOUBLE AS freq, map_from_entries(list((type, n) ORDER BY type)) AS types, coalesce(list(e[2] ORDER BY e) FILTER (type <> 'NoneType'), []) AS examples FROM g GROUP BY path""")
def json_nested_profile(spark, sf):
    """Keys of nested JSON with lists, mixed types and several records a file."""
    files_ = _nested(table(spark, sf, "part"))
    return P.key_profile(leaf_rows(files_, "json"), files_)


@query(f"WITH {_NESTED_SQL} SELECT id, path, type, value FROM l")
def json_nested_leaves(spark, sf):
    """Every leaf of nested JSON."""
    return leaf_rows(_nested(table(spark, sf, "part")), "json").select("id", "path", "type", "value")


_CODE = "CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'A' || (p_size % 6 + 1) END"


@query(f"""SELECT p_partkey AS id, 'img_' || p_partkey || '.jpg' AS image_name, {_CODE} AS label, (p_partkey % 17)::VARCHAR AS animal_id, (p_size + 100)::INT AS img_w, (p_size + 50)::INT AS img_h, p_size::DOUBLE AS x1, (p_size + 20)::DOUBLE AS x2, (p_size + 5)::DOUBLE AS y2 FROM part""")
def record_fallback(spark, sf):
    """Records of an unknown schema."""
    from brindle.operators.fallback import extract

    k, s = F.col("p_partkey"), F.col("p_size")
    code = F.when(s % 4 == 0, F.lit('"none"')).otherwise(_quoted(F.lit("grade "), F.concat(F.lit("A"), (s % 6 + 1).cast("string"))))
    box = F.concat(F.lit("["), F.concat_ws(", ", s.cast("string"), (s + 1).cast("string"), (s + 20).cast("string"), (s + 5).cast("string")), F.lit("]"))
    text = _json(source=_json(file_name=_quoted(F.lit("dir/img_"), k, F.lit(".jpg")), width=s + 100, height=s + 50), finding=_json(disease=code, bbox=box), pet_id=k % 17)
    json_walk.register(spark)
    rows = table(spark, sf, "part").select(k.alias("id"), text.alias("json"))
    entries = spark.sql("SELECT id, e.* FROM {rows}, LATERAL json_entries(json) e", rows=rows)
    return extract(entries).select("id", "image_name", "label", "animal_id", "img_w", "img_h", "bbox.x1", "bbox.x2", "bbox.y2")


@query("""SELECT 'VL/p' || p_partkey || '.json' AS json_path, 'p' || p_partkey || '.jpg' AS image_name, 'A' || (p_size % 7 + 1) AS label, 'G_D|b' || (p_size % 5) || '||F|2022' AS animal_id, 'D' AS species_code, (p_size + 200)::INT AS img_w, 100::INT AS img_h,
(CASE WHEN p_size % 2 = 0 THEN 3 END)::INT AS corners, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE ELSE 1.0 END AS x1, CASE WHEN p_size % 2 = 0 THEN p_size + 10.0::DOUBLE ELSE 1.0 + p_size END AS x2, p_size % 7 = 6 AS is_normal, 1::INT AS n_lesion FROM part""")
def record_parse(spark, sf):
    """Records of the confirmed schema, with polygons and boxes."""
    k, s = F.col("p_partkey"), F.col("p_size")
    meta = _json(**{"Raw data ID": _quoted(F.lit("p"), k, F.lit(".jpg"))}, lesions=_quoted(F.lit("A"), s % 7 + 1), species=F.lit('"D"'), breed=_quoted(F.lit("b"), s % 5), gender=F.lit('"F"'), date=F.lit("2022"), resolution=_quoted(s + 200, F.lit("X100")))
    polygon = _json(polygon=_json(location=F.concat(F.lit("["), _json(x1=s, y1=F.lit(1), x2=s + 10, y2=F.lit(2), x3=s + 5, y3=F.lit(30)), F.lit("]"))))
    box = _json(box=_json(location=F.concat(F.lit("["), _json(x=F.lit(1), y=F.lit(2), width=s, height=F.lit(4)), F.lit("]"))))
    text = _json(metaData=meta, labelingInfo=F.concat(F.lit("["), F.when(s % 2 == 0, polygon).otherwise(box), F.lit("]")))
    rows = table(spark, sf, "part").select(F.concat(F.lit("VL/p"), k.cast("string"), F.lit(".json")).alias("json_path"), text.alias("json"))
    out = normalize.parse_records(rows)
    return out.select("json_path", "image_name", "label", "animal_id", "species_code", "img_w", "img_h", F.when(F.col("polygon").isNotNull(), F.size("polygon")).alias("corners"), "bbox.x1", "bbox.x2", "is_normal", "n_lesion")


@query("""SELECT p_partkey, (CASE WHEN p_size % 4 = 3 THEN 3 ELSE 2 END)::INT AS n, p_size::DOUBLE AS x1, CASE WHEN p_size % 4 = 3 THEN 9.0::DOUBLE ELSE p_size + 7.0::DOUBLE END AS y_last FROM part""")
def coordinate_forms(spark, sf):
    """Points as pairs, as a box with a size, as text, and as numbered corners within a wrapper."""
    from brindle.functions.points import as_xy

    s = F.col("p_size")
    t = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    forms = [t("[[", s, ", 1], [2, ", s + 7, "]]"), t('{"x": ', s, ', "y": 5, "width": 3, "height": ', s + 2, "}"), t(s, ",1 3,", s + 7), t('{"location": [{"x1": ', s, ', "y1": 1, "x2": 2, "y2": 3, "x3": 4, "y3": 9}]}')]
    text = F.element_at(F.array(*forms), (s % 4 + 1).cast("int"))
    pts = table(spark, sf, "part").select("p_partkey", as_xy(text).alias("p"))
    return pts.select("p_partkey", F.size("p").alias("n"), F.col("p")[0]["x"].alias("x1"), F.element_at("p", -1)["y"].alias("y_last"))
