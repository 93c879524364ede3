"""Scope, matching, chunks, near-duplicates, conflicts, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import scalars as S
from brindle.operators import dedup as D
from brindle.operators import normalize as N
from brindle.plans.registry import query
from brindle.session import Staged, table

BITS, HALF = D.BANDS * D.BITS, D.BITS

# sim-hash bands in SQL: word hashes, bit votes, bands of 15 bits
SIG_SQL = f"""w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS w FROM documents),
h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 15))::BIGINT AS h FROM w),
v AS (SELECT doc_id, count(*) AS n, {", ".join(f"sum((h >> {k}) & 1) AS v{k}" for k in range(BITS))} FROM h GROUP BY doc_id),
s AS (SELECT d.doc_id, {", ".join("(" + " + ".join(f"(CASE WHEN n IS NULL THEN NULL WHEN 2 * v{b * HALF + i} > n THEN {1 << i} ELSE 0 END)" for i in range(HALF)) + f")::BIGINT AS b{b}" for b in range(D.BANDS))} FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id)"""
_DIST = " + ".join(f"bit_count(xor(x.b{k}, y.b{k}))" for k in range(D.BANDS))
PAIR_SQL = f"""r AS (SELECT min(doc_id) AS id, b0, b1, b2, b3 FROM s WHERE b0 IS NOT NULL GROUP BY ALL),
q AS (SELECT id, r.b0, r.b1, r.b2, r.b3, band, bits FROM r, (VALUES (0), (1), (2), (3)) t(band), LATERAL (SELECT [b0, b1, b2, b3][band + 1] AS bits)),
p AS (SELECT DISTINCT x.id AS u, y.id AS v, ({_DIST})::INT AS distance FROM q x JOIN q y ON x.band = y.band AND x.bits = y.bits AND x.id < y.id WHERE {_DIST} <= 6)"""
CLUSTER_SQL = """e AS (SELECT u, v FROM p UNION SELECT v, u FROM p UNION SELECT id, id FROM r),
reach AS (SELECT id AS a, id AS b FROM r UNION SELECT reach.a, e.v FROM reach JOIN e ON e.u = reach.b),
comp AS (SELECT a AS id, min(b) AS dup_cluster FROM reach GROUP BY a),
c AS (SELECT s.doc_id, coalesce(comp.dup_cluster, s.doc_id) AS dup_cluster, s.b0 IS NOT NULL AS hashed FROM s LEFT JOIN r ON s.b0 = r.b0 AND s.b1 = r.b1 AND s.b2 = r.b2 AND s.b3 = r.b3 LEFT JOIN comp ON comp.id = r.id)"""


@query(f"WITH {SIG_SQL} SELECT * FROM s")
def simhash_signature(spark, sf):
    return D.simhash(table(spark, sf, "documents"))


@query(f"WITH {SIG_SQL}, {PAIR_SQL} SELECT * FROM p")
def lsh_candidate_pairs(spark, sf):
    sigs = Staged(spark).write(D.simhash(table(spark, sf, "documents")))
    return D.candidate_pairs(sigs)


@query(f"WITH RECURSIVE {SIG_SQL}, {PAIR_SQL}, {CLUSTER_SQL} SELECT * FROM c")
def near_dup_clusters(spark, sf):
    return D.clusters(D.simhash(table(spark, sf, "documents")))


@query(f"WITH RECURSIVE {SIG_SQL}, {PAIR_SQL}, {CLUSTER_SQL} SELECT * FROM c")
def near_dup_clusters_added(spark, sf):
    """The same clusters, documents coming in two chunks, the second one against a stored index of the first."""
    from uuid import uuid4

    from brindle.operators.dedup_index import SignatureIndex

    docs = table(spark, sf, "documents").select("doc_id", "text")
    index = SignatureIndex(spark, Staged(spark).root, f"brindle_bands_{uuid4().hex}")
    for chunk in (docs.filter("xxhash64(doc_id) % 2 = 0"), docs.filter("xxhash64(doc_id) % 2 <> 0")):
        index.add(D.simhash(chunk))
    return index.clusters()


def labelled(spark, sf: str) -> DataFrame:
    """doc_id, dup_cluster, hashed, label (quality, null where unknown), area_ratio (n_chars)."""
    rows = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("area_ratio"))
    rows = rows.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left")
    return Staged(spark).write(rows.join(near_dup_clusters(spark, sf), "doc_id", "left"))


_ROWS = f"WITH RECURSIVE {SIG_SQL}, {PAIR_SQL}, {CLUSTER_SQL}, m AS (SELECT d.doc_id, c.dup_cluster, c.hashed, l.quality AS label, d.n_chars::DOUBLE AS area_ratio FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN c USING (doc_id))"
_BAD = "bad AS (SELECT dup_cluster, count(DISTINCT label) AS n_labels, count(*) AS n FROM m GROUP BY 1 HAVING count(DISTINCT label) > 1)"
_KEPT = "k AS (SELECT dup_cluster, doc_id, label, area_ratio FROM m WHERE dup_cluster NOT IN (SELECT dup_cluster FROM bad) QUALIFY row_number() OVER (PARTITION BY dup_cluster, label ORDER BY area_ratio DESC NULLS LAST, doc_id) = 1)"


@query(f"{_ROWS}, {_BAD} SELECT * FROM bad")
def label_conflict_clusters(spark, sf):
    return D.conflicts(labelled(spark, sf))


@query(f"{_ROWS}, {_BAD}, {_KEPT} SELECT * FROM k")
def dedup_keep_largest(spark, sf):
    return D.keep_largest(labelled(spark, sf), "doc_id").drop("hashed")


@query(f"{_ROWS}, {_BAD}, {_KEPT} SELECT (SELECT count(*) FROM m) AS before, (SELECT count(*) FROM m WHERE hashed) AS hashed, (SELECT count(DISTINCT dup_cluster) FROM m) AS clusters, (SELECT count(*) FROM bad) AS cross_class_clusters, (SELECT coalesce(sum(n), 0)::BIGINT FROM bad) AS cross_class_rows, count(*) AS after, (SELECT count(*) FROM m) - count(*) AS removed, round(1 - count(*) / greatest((SELECT count(*) FROM m), 1)::DOUBLE, 4) AS duplicate_rate, round(1 - count(*) / greatest((SELECT count(*) FROM m), 1)::DOUBLE, 4) > 0.5 AS alarm FROM k")
def dedup_info(spark, sf):
    rows = labelled(spark, sf)
    return D.dedup_info(rows, D.keep_largest(rows, "doc_id"))


@query(f"WITH {SIG_SQL}, r AS (SELECT DISTINCT b0, b1, b2, b3 FROM s WHERE b0 IS NOT NULL), q AS (SELECT band, [b0, b1, b2, b3][band + 1] AS bits FROM r, (VALUES (0), (1), (2), (3)) t(band)) SELECT band, bits, count(*) AS n FROM q GROUP BY ALL HAVING count(*) > 3")
def skipped_buckets(spark, sf):
    return D.skipped_buckets(D.simhash(table(spark, sf, "documents")), cap=3)


@query(f"WITH {SIG_SQL}, r AS (SELECT DISTINCT b0, b1, b2, b3 FROM s WHERE b0 IS NOT NULL), q AS (SELECT band, [b0, b1, b2, b3][band + 1] AS bits FROM r, (VALUES (0), (1), (2), (3)) t(band)) SELECT band, bits, count(*) AS n FROM q GROUP BY ALL HAVING count(*) > 2000")
def skipped_buckets_of_clusters(spark, sf):
    """Those that near_dup_clusters would leave out with a cap of 2,000; it has none."""
    return D.skipped_buckets(D.simhash(table(spark, sf, "documents")))


@query("""SELECT doc_id, lang, source FROM documents WHERE (NOT EXISTS (SELECT 1 FROM documents WHERE nullif(lang, '') IS NOT NULL) OR lang = 'en') AND (source IS NULL OR source NOT IN ('src3'))
AND (NOT EXISTS (SELECT 1 FROM documents WHERE source IN ('src1', 'src2', 'src5')) OR source IS NULL OR source IN ('src1', 'src2', 'src5'))""")
def scope_filter_guarded(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return N.scope(d, "lang", "en", "source", include=["src1", "src2", "src5"], exclude=["src3"])


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE trim(quality::VARCHAR) <> ''")
def drop_unlabeled(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return N.drop_unlabeled(d, "quality")


_MATCH = """WITH img AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS image_path FROM pages),
k AS (SELECT image_path, regexp_replace(image_path, '^.*/', '') AS k FROM img UNION SELECT image_path, regexp_replace(regexp_replace(image_path, '^.*/', ''), '\\.[^.]*$', '') FROM img),
rec AS (SELECT page_id AS row_id, url AS json_path, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', '') AS image_name FROM pages),
w AS (SELECT row_id, json_path, image_name AS k, 0 AS want FROM rec UNION ALL SELECT row_id, json_path, regexp_replace(image_name, '\\.[^.]*$', ''), 1 FROM rec),
j AS (SELECT row_id, image_path, want, len(list_intersect(list_distinct(string_split_regex(json_path, '[/\\\\]')), list_distinct(string_split_regex(image_path, '[/\\\\]')))) AS o FROM w JOIN k USING (k)),
b AS (SELECT row_id, image_path FROM j QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY want, o DESC, image_path) = 1)
SELECT row_id, image_path FROM b"""


@query(_MATCH)
def label_image_match(spark, sf):
    p = table(spark, sf, "pages")
    clean = F.regexp_replace("url", r"[?#].*$", "")
    images = p.select(clean.alias("image_path")).distinct()
    records = p.select(F.col("page_id").alias("row_id"), F.col("url").alias("json_path"), S.file_name(clean).alias("image_name"))
    return N.match_images(records, images).select("row_id", "image_path")


@query("""WITH u AS (SELECT 0 AS chunk, doc_id, source, lang, NULL AS extra FROM documents UNION ALL SELECT 1, doc_id + 1, source, lang, 'x' FROM documents)
SELECT chunk, doc_id, source, lang, extra FROM u QUALIFY row_number() OVER (PARTITION BY source, lang, doc_id % 100 ORDER BY chunk, doc_id) = 1""")
def chunk_union_keepfirst(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    a, b = d, d.withColumn("doc_id", F.col("doc_id") + 1).withColumn("extra", F.lit("x"))
    keyed = [x.withColumn("k", F.col("doc_id") % 100) for x in (a, b)]
    return N.combine(keyed, ["source", "lang", "k", "not_there"], ["doc_id"]).drop("k")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def resume_antijoin(spark, sf):
    return N.to_do(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def orders_to_do(spark, sf):
    return N.to_do(table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT avg((o.k IS NOT NULL)::INT::DOUBLE) AS coverage FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c.c_custkey")
def file_coverage(spark, sf):
    got = N.coverage(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", 0.0)
    return spark.createDataFrame([(got,)], "coverage double")


@query("""WITH l AS (SELECT doc_id, substr(sha256(doc_id::VARCHAR), 1, 4) AS b, sha256(doc_id::VARCHAR || chr(31) || coalesce(source, chr(0)) || chr(31) || coalesce(lang, chr(0))) AS h FROM documents),
p AS (SELECT b, sha256(string_agg(h, '' ORDER BY doc_id)) AS h, count(*) AS n FROM l GROUP BY b) SELECT sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY b)) AS fingerprint FROM p""")
def content_fingerprint(spark, sf):
    return N.fingerprint(table(spark, sf, "documents"), "doc_id", ["source", "lang"])


@query("""SELECT page_id, 'm1.5/' || substr(md5(url), 1, 2) || '/' || regexp_replace(regexp_replace(url, '^.*/', ''), '\\.[^.]*$', '') || '_' || substr(md5(url), 1, 12) || '.jpg' AS crop_rel, '/data/root/' || replace(url, '\\', '/') AS rebased FROM pages""")
def crop_paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.crop_path("url", F.lit("m1.5")).alias("crop_rel"), S.rebase("/data/root", "url").alias("rebased"))


@query("""SELECT doc_id FROM documents WHERE lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42' || doc_id), doc_id) <= 20""")
def stratified_sample_md5(spark, sf):
    from brindle.operators.split import sample_per_label

    return sample_per_label(table(spark, sf, "documents").filter("lang is not null").select("doc_id", "lang"), "doc_id", "lang", n=20).select("doc_id")


@query("""SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('7' || doc_id), doc_id) <= round_even(0.1::DOUBLE * count(*) OVER (PARTITION BY lang), 0)""")
def stratified_fraction(spark, sf):
    from brindle.operators.split import sample_per_label

    return sample_per_label(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang", fraction=0.1, seed=7).select("doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('42' || doc_id), doc_id LIMIT 50")
def uniform_sample(spark, sf):
    from brindle.operators.split import sample_uniform

    return sample_uniform(table(spark, sf, "documents").select("doc_id"), "doc_id", 50)


@query("SELECT count(DISTINCT source) AS groups, count(*) AS rows, count(*) / count(DISTINCT source)::DOUBLE AS rows_per_group, count(*) / count(DISTINCT source)::DOUBLE < 1.2 AS warn FROM documents")
def group_stats(spark, sf):
    from brindle.operators.split import group_stats as stats

    return stats(table(spark, sf, "documents").select(F.col("source").alias("group")))


@query("SELECT doc_id, coalesce(list_position(['en', 'de', 'fr'], lang) - 1, -1)::INT AS y FROM documents WHERE source IS NOT NULL")
def with_target(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"), F.col("source").alias("crop_path"))
    return N.with_target(d, ["en", "de", "fr"]).select("doc_id", "y")


_CROP = "'full/' || substr(md5(url), 1, 2) || '/' || regexp_replace(regexp_replace(url, '^.*/', ''), '\\.[^.]*$', '') || '_' || substr(md5(url), 1, 12) || '.jpg'"


@query(f"SELECT page_id, {_CROP} AS crop_rel, '/crops/' || {_CROP} AS crop_path, 'full' AS crop_tag FROM pages WHERE {_CROP} IN (SELECT {_CROP} FROM pages WHERE page_id % 50 <> 0)")
def switch_tag(spark, sf):
    """Most crops of another tag are there."""
    from brindle.sources.crops import switch_tag as switch

    p = table(spark, sf, "pages").select("page_id", F.col("url").alias("image_path"))
    there = p.filter("page_id % 50 <> 0").select(F.concat(F.lit("/crops/"), S.crop_path("image_path", F.lit("full"))).alias("path"))
    return switch(p, there, "/crops", "full", ending=".jpg").select("page_id", "crop_rel", "crop_path", "crop_tag")
