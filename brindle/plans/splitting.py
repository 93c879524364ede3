"""Groups, hold-outs, folds, leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.scalars import bucket
from brindle.operators import split as P
from brindle.plans.registry import query
from brindle.session import Staged, table


def _bucket(salt: str, key: str, n: int) -> str:
    return f"('0x' || substr(md5('{salt}' || {key}), 1, 8))::BIGINT % {n}"


# events stand for rows: some share an animal, a few a duplicate cluster
_GROUP_SQL = """WITH RECURSIVE r AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'animal::' || (user_id % 40) END AS a, CASE WHEN event_id % 97 = 0 THEN 'dup::' || (event_id % 11) END AS d FROM events),
e AS (SELECT DISTINCT a AS u, d AS v FROM r WHERE a IS NOT NULL AND d IS NOT NULL), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
n AS (SELECT u AS x FROM b), reach AS (SELECT x, x AS y FROM n UNION SELECT reach.x, b.v FROM reach JOIN b ON b.u = reach.y), c AS (SELECT x, min(y) AS g FROM reach GROUP BY x)
SELECT event_id, coalesce(c.g, a, d, 'row::' || event_id) AS "group" FROM r LEFT JOIN c ON c.x = coalesce(a, d)"""


@query(_GROUP_SQL)
def split_groups(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, F.col("user_id") % 40).alias("animal_id"), F.when(F.col("event_id") % 97 == 0, F.col("event_id") % 11).alias("dup_cluster"))
    return P.build_groups(e, "event_id").select("event_id", "group")


@query(_GROUP_SQL)
def split_groups_added(spark, sf):
    """The same groups, events coming in two chunks, the second one's edges added to the stored forest of the first."""
    from brindle.operators.forest import Forest

    e = table(spark, sf, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, F.col("user_id") % 40).alias("animal_id"), F.when(F.col("event_id") % 97 == 0, F.col("event_id") % 11).alias("dup_cluster"))
    forest = Forest(spark, Staged(spark).root)
    for chunk in (e.filter("xxhash64(event_id) % 2 = 0"), e.filter("xxhash64(event_id) % 2 <> 0")):
        P.extend_groups(forest, chunk)
    return P.groups_of(forest, e, "event_id").select("event_id", "group")


@query(f"SELECT c_custkey, {_bucket('holdout42', 'c_custkey', 1000)} AS bucket, {_bucket('holdout42', 'c_custkey', 1000)} < 150 AS is_holdout FROM customer")
def holdout_bucket(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", bucket("c_custkey", 1000, "holdout42").alias("bucket"), P.holdout("c_custkey").alias("is_holdout"))


@query(f"SELECT DISTINCT user_id, ({_bucket('fold42', 'user_id', 5)})::INT AS fold FROM events")
def hash_fold(spark, sf):
    return table(spark, sf, "events").select("user_id", P.hash_fold("user_id").alias("fold")).distinct()


def assigned(spark, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("group", F.col("user_id"))
    return P.assign(e, "event_id", "event_type", stratify=False)


_ASSIGNED = f"WITH a AS (SELECT *, {_bucket('holdout42', 'user_id', 1000)} < 150 AS is_holdout, CASE WHEN {_bucket('holdout42', 'user_id', 1000)} < 150 THEN -1 ELSE ({_bucket('fold42', 'user_id', 5)})::INT END AS fold FROM events)"


@query(f"""WITH e AS (SELECT user_id AS "group", event_type, {_bucket('holdout42', 'user_id', 1000)} < 150 AS h FROM events), l AS (SELECT "group", event_type, count(*) AS n FROM e WHERE NOT h GROUP BY ALL),
g AS (SELECT "group", sum(n)::BIGINT AS n, string_agg(event_type, chr(31) ORDER BY n DESC, event_type) AS profile, floor(8 * max(n) / sum(n)::DOUBLE) AS eighths FROM l GROUP BY 1),
r AS (SELECT "group", row_number() OVER (ORDER BY profile, eighths, n DESC, md5('42' || "group"), "group") - 1 AS pos FROM g),
f AS (SELECT "group", (CASE WHEN (pos // 5) % 2 = 0 THEN pos % 5 ELSE 4 - pos % 5 END)::INT AS fold FROM r)
SELECT "group", CASE WHEN h THEN -1 ELSE fold END AS fold, CASE WHEN h THEN -1 ELSE fold END AS fold_again, count(*) AS n FROM e LEFT JOIN f USING ("group") GROUP BY "group", h, fold""")
def stratified_group_fold(spark, sf):
    """Groups dealt to folds by a running count over their profiles."""
    e = table(spark, sf, "events").withColumn("group", F.col("user_id"))
    return P.assign(e, "event_id", "event_type").groupBy("group").agg(F.min("fold").alias("fold"), F.max("fold").alias("fold_again"), F.count("*").alias("n"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(f"""{_ASSIGNED}, c AS (SELECT fold, {", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in _TYPES)} FROM a GROUP BY fold)
SELECT *, {", ".join(f"round({t} * 100.0::DOUBLE / ({' + '.join(_TYPES)}), 4) AS {t}_pct" for t in _TYPES)} FROM c""")
def fold_label_crosstab(spark, sf):
    return P.fold_crosstab(assigned(spark, sf), "event_type", _TYPES)


@query(f"""{_ASSIGNED}, s AS (SELECT 'user_id' AS key, user_id::VARCHAR AS v, CASE WHEN is_holdout THEN 'h' WHEN fold = 0 THEN 'v' ELSE 't' END AS p FROM a UNION ALL SELECT 'props', props, CASE WHEN is_holdout THEN 'h' WHEN fold = 0 THEN 'v' ELSE 't' END FROM a WHERE props IS NOT NULL),
g AS (SELECT key, v, bool_or(p = 't') AS t, bool_or(p = 'v') AS va, bool_or(p = 'h') AS h FROM s GROUP BY ALL)
SELECT key, count(*) FILTER (t AND va) AS train_val, count(*) FILTER (t AND h) AS train_holdout, count(*) FILTER (va AND h) AS val_holdout FROM g GROUP BY key""")
def leakage_check(spark, sf):
    return P.leaks(assigned(spark, sf), ["user_id", "props"])


@query(f"""WITH f AS (SELECT user_id, {_bucket('random42', 'event_id', 1000)} < 800 AS t FROM events), g AS (SELECT user_id, count(*) FILTER (t) AS t, count(*) FILTER (NOT t) AS v FROM f GROUP BY 1)
SELECT sum(v)::BIGINT AS n_val, (sum(v) FILTER (t > 0))::BIGINT AS n_leaked, round((sum(v) FILTER (t > 0)) / sum(v)::DOUBLE, 6) AS leak_rate FROM g""")
def random_split_leak_rate(spark, sf):
    return P.random_split_leak(table(spark, sf, "events"), "event_id", "user_id")


@query(f"{_ASSIGNED} SELECT 'train' AS part, count(*) AS n FROM a WHERE NOT is_holdout AND fold <> 1 UNION ALL SELECT 'val', count(*) FROM a WHERE NOT is_holdout AND fold = 1 UNION ALL SELECT 'holdout', count(*) FROM a WHERE is_holdout")
def fold_parts(spark, sf):
    rows = assigned(spark, sf)
    train, val = P.get_fold(rows, 1)
    out = None
    for name, df in (("train", train), ("val", val), ("holdout", P.get_holdout(rows))):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.union(one)
    return out


@query("SELECT text AS key FROM documents INTERSECT SELECT text FROM benchmark UNION SELECT NULL WHERE false")
def key_intersection(spark, sf):
    return table(spark, sf, "documents").select(F.col("text").alias("key")).intersect(table(spark, sf, "benchmark").select("text"))


@query("SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def nations_of_both(spark, sf):
    """Keys that two tables share."""
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("key")).intersect(table(spark, sf, "supplier").select("s_nationkey"))
