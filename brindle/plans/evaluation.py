"""Logits, metrics, calibration, two-stage pipelines, stress curves, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import vectors as V
from brindle.operators import calibration as C
from brindle.operators import experiments as X
from brindle.operators import metrics as M
from brindle.operators import two_stage as T
from brindle.plans.registry import query
from brindle.session import table

SCALE = 6.0


def logits(spark, sf: str) -> DataFrame:
    """vec_id, y, logits (10 classes), probs, s1 (a screen's score), p2 (kinds), y2."""
    z = F.transform(V.doubles("embedding", 1, 10), lambda x: x * SCALE)
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("int").alias("y"), z.alias("logits"), V.doubles("embedding", 11, 2).alias("z1"))
    e = e.withColumn("probs", V.softmax("logits")).withColumn("s1", F.get(V.softmax(F.transform("z1", lambda x: x * SCALE)), F.lit(1)))
    # six kinds and normal: labels 0..5, 6..9 are normal
    return e.withColumn("p2", V.softmax(F.slice("logits", 1, 6))).withColumn("y2", F.least("y", F.lit(6)))


_SUM = "list_sum({0})"
Z = f"""z0 AS (SELECT vec_id, label::INT AS y, list_transform(embedding[1:10], lambda x: x::DOUBLE * 6.0::DOUBLE) AS logits, embedding[11]::DOUBLE * 6.0::DOUBLE AS a, embedding[12]::DOUBLE * 6.0::DOUBLE AS b FROM embeddings),
z1 AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e, list_transform(logits[1:6], lambda x: exp(x - list_max(logits[1:6]))) AS e2 FROM z0),
z AS (SELECT vec_id, y, least(y, 6) AS y2, logits, list_transform(e, lambda x: x / list_sum(e)) AS probs, exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS s1, list_transform(e2, lambda x: x / list_sum(e2)) AS p2 FROM z1)"""
ARG = "(list_position({0}, list_max({0})) - 1)::INT"
CONF = f"{Z}, c AS (SELECT vec_id AS id, y, list_max(probs) AS conf, ({ARG.format('probs')} = y)::INT AS correct FROM z)"


@query(f"WITH {Z} SELECT vec_id, {ARG.format('probs')} AS pred, round(list_max(probs), 6) AS conf FROM z")
def softmax_argmax(spark, sf):
    return logits(spark, sf).select("vec_id", V.argmax("probs").alias("pred"), F.round(F.array_max("probs"), 6).alias("conf"))


@query(f"""WITH {Z}, t AS (SELECT vec_id, i - 1 AS class, probs[i] AS p FROM z, unnest(range(1, 11)) u(i)), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class) AS r FROM t)
SELECT vec_id, list(class ORDER BY r)::INT[] AS classes, CASE WHEN max(p) >= 0.75 THEN 'high' WHEN max(p) >= 0.5 THEN 'middle' ELSE 'low' END AS band, max(p) < 0.45 AS abstain FROM r WHERE r <= 3 GROUP BY vec_id""")
def topk_classes(spark, sf):
    e = logits(spark, sf).withColumn("t", V.top_k("probs", 3))
    return e.select("vec_id", F.col("t.class").alias("classes"), V.band(F.col("t")[0]["p"]).alias("band"), (F.col("t")[0]["p"] < 0.45).alias("abstain"))


def predictions(spark, sf: str) -> DataFrame:
    return logits(spark, sf).select("vec_id", "y", V.argmax("probs").alias("pred"))


_CELLS = f"""WITH {Z}, p AS (SELECT y, {ARG.format('probs')} AS pred FROM z), cells AS (SELECT a.i::INT AS y, b.i::INT AS pred, (SELECT count(*) FROM p WHERE p.y = a.i AND p.pred = b.i) AS n FROM range(10) a(i), range(10) b(i)),
k AS (SELECT i::INT AS class, (SELECT sum(n) FROM cells WHERE y = i)::BIGINT AS support, (SELECT sum(n) FROM cells WHERE pred = i)::BIGINT AS predicted, (SELECT sum(n) FROM cells WHERE y = i AND pred = i)::BIGINT AS tp FROM range(10) r(i)),
f AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted::DOUBLE ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS rc FROM k), g AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM f)"""


@query(f"{_CELLS} SELECT y, pred, n FROM cells")
def confusion_matrix(spark, sf):
    return M.confusion(predictions(spark, sf), 10)


@query(f"{_CELLS} SELECT class, support, predicted, tp, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1 FROM g")
def per_class_metrics(spark, sf):
    return M.per_class(M.confusion(predictions(spark, sf), 10)).select("class", "support", "predicted", "tp", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""{_CELLS}, s AS (SELECT sum(support)::BIGINT AS n, sum(tp) / sum(support)::DOUBLE AS acc, avg(rc) FILTER (support > 0) AS bal, avg(f1) FILTER (support + predicted > 0) AS mf, sum(f1 * support) / sum(support) AS wf, sum(support * predicted::DOUBLE) / (sum(support)::DOUBLE * sum(support)) AS pe FROM g)
SELECT n, round(acc, 6) AS accuracy, round(bal, 6) AS balanced_accuracy, round(mf, 6) AS macro_f1, round(wf, 6) AS weighted_f1, round((acc - pe) / (1 - pe), 6) AS kappa FROM s""")
def classification_metrics(spark, sf):
    s = M.summary(M.confusion(predictions(spark, sf), 10))
    return s.select("n", *(F.round(c, 6).alias(c) for c in s.columns if c != "n"))


def scored(spark, sf: str) -> DataFrame:
    """score (n_chars, with ties), y (toxic)."""
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 500).cast("double").alias("score"))
    return d.join(table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y")), "doc_id")


_SCORED = "s AS (SELECT (n_chars % 500)::DOUBLE AS score, toxic AS y FROM documents JOIN labels USING (doc_id))"
_CURVE = f"""WITH {_SCORED}, g AS (SELECT score, sum(y)::BIGINT AS tp, count(*) AS n FROM s GROUP BY score), t AS (SELECT sum(y)::DOUBLE AS pos FROM s),
c AS (SELECT score, tp, n, sum(tp) OVER (ORDER BY score DESC) AS ctp, sum(n) OVER (ORDER BY score DESC) AS cn FROM g),
p AS (SELECT score, ctp / cn::DOUBLE AS precision, ctp / pos AS recall, tp / pos AS step FROM c, t)"""


@query(f"""WITH {_SCORED}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM s), t AS (SELECT sum(r) FILTER (y = 1) AS sr, count(*) FILTER (y = 1)::DOUBLE AS p, count(*) FILTER (y = 0)::DOUBLE AS n FROM r)
SELECT round((sr - p * (p + 1) / 2) / (p * n), 6) AS auroc FROM t""")
def binary_auroc(spark, sf):
    return M.auroc(scored(spark, sf)).select(F.round("auroc", 6).alias("auroc"))


@query(f"{_CURVE} SELECT score, round(precision, 6) AS precision, round(recall, 6) AS recall FROM p")
def pr_curve(spark, sf):
    return M.pr_curve(scored(spark, sf)).select("score", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"{_CURVE} SELECT round(sum(step * precision), 6) AS ap FROM p")
def average_precision(spark, sf):
    return M.average_precision(M.pr_curve(scored(spark, sf))).select(F.round("ap", 6).alias("ap"))


@query(f"{_CURVE} SELECT score AS threshold, round(precision, 6) AS precision_at_target, round(recall, 6) AS recall_at_target FROM p WHERE recall >= 0.95 ORDER BY p.precision DESC, score LIMIT 1")
def threshold_at_recall(spark, sf):
    t = M.threshold_at_recall(M.pr_curve(scored(spark, sf)))
    return t.select("threshold", F.round("precision_at_target", 6).alias("precision_at_target"), F.round("recall_at_target", 6).alias("recall_at_target"))


@query(f"""WITH {Z}, l AS (SELECT i - 1 AS class, probs[i] AS score, (y = i - 1)::INT AS t FROM z, unnest(range(1, 11)) u(i)), r AS (SELECT class, t, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0::DOUBLE AS r FROM l),
a AS (SELECT class, sum(r) FILTER (t = 1) AS sr, (count(*) FILTER (t = 1))::DOUBLE AS p, (count(*) FILTER (t = 0))::DOUBLE AS n FROM r GROUP BY class) SELECT round(CASE WHEN min(p) > 0 AND min(n) > 0 THEN avg((sr - p * (p + 1) / 2) / (p * n)) END, 6) AS macro_auroc FROM a""")
def macro_auroc_ovr(spark, sf):
    return M.macro_auroc(logits(spark, sf)).select(F.round("macro_auroc", 6).alias("macro_auroc"))


@query("""WITH n AS (SELECT i::INT AS class, greatest(count(label), 1) AS n FROM range(12) r(i) LEFT JOIN embeddings ON label = i GROUP BY i) SELECT class, n, round((1 / sqrt(n)) / (avg(1 / sqrt(n)) OVER ()), 6) AS weight FROM n""")
def class_weights(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("y"))
    return M.class_weights(e, 12).select("class", "n", F.round("weight", 6).alias("weight"))


@query("""SELECT vec_id, CASE WHEN label >= 2 THEN 1.0::DOUBLE / count(*) OVER (PARTITION BY label) ELSE 0 END AS sample_weight FROM embeddings""")
def sampler_weights(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("y"))
    return M.sampler_weights(e, known="y >= 2").select("vec_id", "sample_weight")


@query(f"""WITH {CONF}, b AS (SELECT least(greatest(ceil(conf * 15.0::DOUBLE)::INT, 1), 15) AS bin, conf, correct FROM c), g AS (SELECT bin, count(*) AS n, avg(conf) AS mc, avg(correct) AS acc FROM b GROUP BY bin)
SELECT round(sum(n * abs(acc - mc)) / sum(n), 6) AS ece, round(coalesce(max(abs(acc - mc)) FILTER (n >= 5), 0), 6) AS mce FROM g""")
def ece_mce(spark, sf):
    return C.calibration_error(C.confidences(logits(spark, sf), "vec_id")).select(F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce"))


@query(f"""WITH {CONF}, b AS (SELECT least(greatest(ceil(conf * 15.0::DOUBLE)::INT, 1), 15) AS bin, conf, correct FROM c) SELECT bin, count(*) AS n, round(avg(conf), 6) AS mean_conf, round(avg(correct), 6) AS accuracy FROM b GROUP BY bin HAVING count(*) >= 3""")
def reliability_bins(spark, sf):
    return C.reliability(C.confidences(logits(spark, sf), "vec_id"), least=3).select("bin", "n", F.round("mean_conf", 6).alias("mean_conf"), F.round("accuracy", 6).alias("accuracy"))


_TEMPS = [0.25, 0.5, 1.0, 2.0, 4.0, 10.0]


@query(f"""WITH {Z}, t(temperature) AS (VALUES {", ".join(f"({t}::DOUBLE)" for t in _TEMPS)}) SELECT temperature, round(avg(list_max(logits) / temperature + ln(list_sum(list_transform(logits, lambda x: exp((x - list_max(logits)) / temperature)))) - logits[y + 1] / temperature), 6) AS nll FROM z, t GROUP BY temperature""")
def temperature_grid_nll(spark, sf):
    return C.temperature_grid(logits(spark, sf), _TEMPS).select("temperature", F.round("nll", 6).alias("nll"))


@query()
def temperature_fit(spark, sf):
    """A search; the tests hold it to the best of a fine grid."""
    e = logits(spark, sf).select("vec_id", "y", "logits")
    return C.calibration_report(e, "vec_id", C.fit_temperature(e))


@query(f"""WITH {CONF}, r AS (SELECT conf, row_number() OVER w AS k, sum(correct) OVER w AS cc FROM c WINDOW w AS (ORDER BY conf DESC, id ROWS UNBOUNDED PRECEDING)), t(coverage) AS (VALUES (1.0::DOUBLE), (0.9), (0.8), (0.7), (0.5))
SELECT coverage, round(1 - cc / k::DOUBLE, 6) AS risk, round(conf, 6) AS threshold FROM r JOIN t ON k = greatest(least(trunc(coverage * (SELECT count(*) FROM c))::INT, (SELECT count(*) FROM c)), 1)""")
def coverage_risk(spark, sf):
    return C.coverage_risk(C.confidences(logits(spark, sf), "vec_id")).select("coverage", F.round("risk", 6).alias("risk"), F.round("threshold", 6).alias("threshold"))


@query(f"""WITH {CONF}, g AS (SELECT i, 0.2::DOUBLE + 0.79::DOUBLE * i / 79 AS t FROM range(80) r(i)), m AS (SELECT i, t, count(*) AS n, avg(correct) AS acc FROM g JOIN c ON conf >= t GROUP BY ALL), o AS (SELECT * FROM m WHERE n >= 20 AND 1 - acc <= 0.7 ORDER BY n DESC, i LIMIT 1)
SELECT round(coalesce(max(t), 1), 6) AS threshold, round(coalesce(max(n) / (SELECT count(*) FROM c)::DOUBLE, 0), 6) AS coverage FROM o""")
def abstain_threshold(spark, sf):
    a = C.abstain_threshold(C.confidences(logits(spark, sf), "vec_id"), max_risk=0.7)
    return a.select(F.round("threshold", 6).alias("threshold"), F.round("coverage", 6).alias("coverage"))


@query(f"""WITH {Z}, p AS (SELECT y, ({ARG.format('probs')} = y)::INT AS hit, ('0x' || substr(md5('boot42' || vec_id), 1, 8))::BIGINT % 1024 AS slot FROM z), c AS (SELECT slot, y, count(*) AS n, sum(hit) AS hit FROM p GROUP BY ALL),
r AS (SELECT rep, y, n, hit, ('0x' || substr(md5('42|' || rep || '|' || slot), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM c, range(200) t(rep)),
w AS (SELECT rep, y, n, hit, CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238462 THEN 3 WHEN u < 0.9963401531726563 THEN 4 ELSE 5 END AS w FROM r),
a AS (SELECT rep, sum(hit * w) / sum(n * w)::DOUBLE AS acc FROM w WHERE w > 0 GROUP BY rep HAVING count(DISTINCT y) >= 2)
SELECT round((SELECT avg(hit) FROM p), 6) AS accuracy, round(quantile_cont(acc, 0.025), 6) AS low, round(quantile_cont(acc, 0.975), 6) AS high, count(*) AS replicates FROM a""")
def bootstrap_ci_poisson(spark, sf):
    b = M.bootstrap(predictions(spark, sf), "vec_id")
    return b.select(*(F.round(c, 6).alias(c) for c in ("accuracy", "low", "high")), "replicates")


def _bootstrap_sql(metric: str) -> str:
    value = "avg(2 * t / (s + p)::DOUBLE)" if metric == "macro_f1" else "avg(CASE WHEN s > 0 THEN t / s::DOUBLE END)"
    draw = "(('0x' || substr(md5('{}42|' || rep || '|' || y || '|' || pred), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
    return f"""WITH RECURSIVE {Z}, steps AS (SELECT k, 0 AS i, exp(-k::DOUBLE) AS p, exp(-k::DOUBLE) AS c FROM range(1, {M.COUNTED + 1}) r(k) UNION ALL SELECT k, i + 1, p * k / (i + 1), c + p * k / (i + 1) FROM steps WHERE i < {4 * M.COUNTED}),
cell AS (SELECT y, {ARG.format('probs')} AS pred, count(*) AS n FROM z WHERE y IS NOT NULL GROUP BY ALL), d AS (SELECT rep, y, pred, n, {draw.format('a')} AS u, {draw.format('b')} AS v FROM cell, range(1000) t(rep)),
g AS (SELECT *, sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS x FROM d),
w AS (SELECT rep, y, pred, (CASE WHEN n > {M.COUNTED} THEN greatest(round(n + sqrt(n) * x + (x * x - 1) / 6), 0) ELSE (SELECT count(*) FROM steps WHERE steps.k = g.n AND steps.c < g.u) END)::BIGINT AS n FROM g UNION ALL SELECT -1, y, pred, n FROM cell),
e AS (SELECT rep, y AS c, n AS s, 0 AS p, CASE WHEN y = pred THEN n ELSE 0 END AS t FROM w WHERE n > 0 UNION ALL SELECT rep, pred, 0, n, 0 FROM w WHERE n > 0),
k AS (SELECT rep, c, sum(s) AS s, sum(p) AS p, sum(t) AS t FROM e WHERE c IS NOT NULL GROUP BY ALL), r AS (SELECT rep, {value} AS v, count(*) FILTER (s > 0) AS k FROM k GROUP BY rep)
SELECT '{metric}' AS metric, round(max(v) FILTER (rep < 0), 6) AS value, round(quantile_cont(v, 0.025) FILTER (rep >= 0 AND k >= 2), 6) AS low, round(quantile_cont(v, 0.975) FILTER (rep >= 0 AND k >= 2), 6) AS high, count(*) FILTER (rep >= 0 AND k >= 2) AS replicates FROM r"""


def _bootstrap(spark, sf, metric):
    return M.bootstrap_cells(predictions(spark, sf), metric).select("metric", *(F.round(c, 6).alias(c) for c in ("value", "low", "high")), "replicates")


@query(_bootstrap_sql("macro_f1"))
def bootstrap_macro_f1(spark, sf):
    return _bootstrap(spark, sf, "macro_f1")


@query(_bootstrap_sql("balanced_accuracy"))
def bootstrap_balanced_accuracy(spark, sf):
    return _bootstrap(spark, sf, "balanced_accuracy")


_TWO = f"{Z}, t AS (SELECT vec_id, y2, s1, p2, CASE WHEN s1 >= 0.5 THEN {ARG.format('p2')} ELSE 6 END AS pred, CASE WHEN s1 >= 0.5 THEN s1 * list_max(p2) ELSE 1 - s1 END AS conf FROM z)"


@query(f"WITH {_TWO} SELECT vec_id, pred, round(conf, 6) AS conf FROM t")
def pipeline_predict(spark, sf):
    e = logits(spark, sf)
    both = T.join_stages(e.select("vec_id", "s1"), e.select("vec_id", "p2"), "vec_id")
    return T.predict(both).select("vec_id", "pred", F.round("conf", 6).alias("conf"))


@query(f"""WITH {_TWO}, k AS (SELECT i, count(*) FILTER (y2 = i) AS s, count(*) FILTER (pred = i) AS p, count(*) FILTER (y2 = i AND pred = i) AS tp FROM t, range(7) r(i) GROUP BY i),
f AS (SELECT avg(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (s + p) ELSE 0 END) FILTER (s + p > 0) AS mf FROM k)
SELECT count(*) AS n, round(count(*) FILTER (y2 <> 6 AND pred = 6) / greatest(count(*) FILTER (y2 <> 6), 1)::DOUBLE, 6) AS missed_rate, round(count(*) FILTER (y2 = 6 AND pred <> 6) / greatest(count(*) FILTER (y2 = 6), 1)::DOUBLE, 6) AS false_alarm_rate,
round(count(*) FILTER (y2 <> 6 AND pred <> 6 AND pred = y2) / nullif(count(*) FILTER (y2 <> 6 AND pred <> 6), 0)::DOUBLE, 6) AS kind_accuracy, round(avg(conf), 6) AS mean_conf, round(avg((pred = y2)::INT), 6) AS accuracy, round((SELECT mf FROM f), 6) AS macro_f1 FROM t""")
def pipeline_report(spark, sf):
    e = T.predict(logits(spark, sf)).select("y2", "pred", "conf")
    r = T.report(e, 6, "y2")
    return r.select("n", *(F.round(c, 6).alias(c) for c in r.columns if c != "n"))


@query(f"""WITH {Z} SELECT round(count(*) FILTER (y2 <> 6 AND s1 >= 0.5) / count(*) FILTER (y2 <> 6)::DOUBLE, 6) AS recall, round(avg(({ARG.format('p2')} = y2)::INT) FILTER (y2 <> 6), 6) AS kind_accuracy,
round(count(*) FILTER (y2 <> 6 AND s1 >= 0.5) / count(*) FILTER (y2 <> 6)::DOUBLE * avg(({ARG.format('p2')} = y2)::INT) FILTER (y2 <> 6), 6) AS estimate FROM z""")
def product_estimate(spark, sf):
    e = logits(spark, sf)
    p = T.product_estimate(e.select("s1", T.binary_target("y2", 6).alias("y")), e.filter("y2 <> 6").select("p2", F.col("y2").alias("y")))
    return p.select(*(F.round(c, 6).alias(c) for c in p.columns))


@query(f"""WITH {Z}, q AS (SELECT vec_id, s1, list_transform(list_sort(list_transform(range(1, 7), lambda i: struct_pack(q := -p2[i], c := i - 1)))[1:3], lambda s: s.c)::INT[] AS kinds, list_max(p2) AS top FROM z)
SELECT vec_id, CASE WHEN s1 >= 0.5 THEN kinds ELSE [6] END AS classes, round(CASE WHEN s1 >= 0.5 THEN top * s1 ELSE 1 - s1 END, 6) AS p, s1 >= 0.5 AND top * s1 < 0.45 AS abstain,
CASE WHEN (CASE WHEN s1 >= 0.5 THEN top * s1 ELSE 1 - s1 END) >= 0.75 THEN 'high' WHEN (CASE WHEN s1 >= 0.5 THEN top * s1 ELSE 1 - s1 END) >= 0.5 THEN 'middle' ELSE 'low' END AS band FROM q""")
def two_stage_topk(spark, sf):
    return T.engine(logits(spark, sf)).select("vec_id", F.col("topk.class").alias("classes"), F.round(F.col("topk")[0]["p"], 6).alias("p"), "abstain", "band")


@query("""SELECT vec_id, CASE WHEN label = 6 THEN 'A7' ELSE 'ABNORMAL' END AS label, 'A' || (label + 1) AS label_orig FROM embeddings""")
def stage1_view(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("A"), F.col("label") + 1).alias("label"))
    return T.to_stage1(e)


@query("""SELECT vec_id, 'A' || (label + 1) AS label FROM embeddings WHERE label < 6""")
def stage2_view(spark, sf):
    return T.to_stage2(table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("A"), F.col("label") + 1).alias("label")))


@query("""WITH m AS (SELECT vec_id, list_transform(range(1, 11), lambda i: (embedding[i]::DOUBLE * 2 + embedding[i + 10]::DOUBLE) / 3) AS m FROM embeddings) SELECT vec_id, (list_position(m, list_max(m)) - 1)::INT AS pred, round(list_max(m), 6) AS top FROM m""")
def ensemble_mean_logits(spark, sf):
    m = V.weighted_mean([V.doubles("embedding", 1, 10), V.doubles("embedding", 11, 10)], [2.0, 1.0])
    return table(spark, sf, "embeddings").select("vec_id", m.alias("m")).select("vec_id", V.argmax("m").alias("pred"), F.round(F.array_max("m"), 6).alias("top"))


# scores under ten conditions: means of events' values by type and by k modulo 10
def curves(spark, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("x", (F.col("event_id") % 10).cast("double"))
    return e.groupBy("event_type", "x").agg(F.round(F.avg("value"), 6).alias("score"))


_CURVES = "c AS (SELECT event_type, (event_id % 10)::DOUBLE AS x, round(avg(value), 6) AS score FROM events GROUP BY ALL)"


@query(f"""WITH {_CURVES}, g AS (SELECT event_type, max(score) FILTER (x = 1) AS baseline, min(score) AS worst, arg_min('x' || x::INT, (score, x)) AS worst_condition FROM c GROUP BY 1)
SELECT event_type, baseline, worst, worst_condition, round(baseline - worst, 6) AS abs_drop, round((baseline - worst) / greatest(baseline, 1e-9), 6) AS rel_drop, CASE WHEN (baseline - worst) / greatest(baseline, 1e-9) > 0.3 THEN 'fail' WHEN (baseline - worst) / greatest(baseline, 1e-9) > 0.15 THEN 'warn' ELSE 'pass' END AS verdict FROM g""")
def stress_summary(spark, sf):
    rows = curves(spark, sf).withColumn("condition", F.concat(F.lit("x"), F.col("x").cast("int")))
    s = X.stress_summary(rows, "x1", ["event_type"])
    return s.select("event_type", "baseline", "worst", "worst_condition", F.round("abs_drop", 6).alias("abs_drop"), F.round("rel_drop", 6).alias("rel_drop"), "verdict")


@query(f"""WITH {_CURVES}, p AS (SELECT *, max(score) OVER (PARTITION BY event_type) AS peak FROM c), a AS (SELECT *, min(x) FILTER (score = peak) OVER (PARTITION BY event_type) AS at FROM p),
t AS (SELECT a.*, tol AS tolerance, score >= peak * (1 - tol) AS ok FROM a, (VALUES (0.1::DOUBLE), (0.2)) v(tol)), g AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY event_type, tolerance ORDER BY x) AS gap FROM t)
SELECT event_type, tolerance, min(x) AS low, max(x) AS high, max(peak) AS peak, max(at) AS peak_at FROM g WHERE ok GROUP BY event_type, tolerance, gap HAVING bool_or(x = at)""".replace(" AS at", " AS at_").replace("max(at)", "max(at_)").replace("= at)", "= at_)"))
def usable_band(spark, sf):
    return X.usable_band(curves(spark, sf), [0.1, 0.2], by=["event_type"])


@query(f"""WITH {_CURVES}, z AS (SELECT event_type, score AS base FROM c WHERE x = 0), b AS (SELECT event_type, x, sum(coalesce(score < 0.8 * base, true)::INT) OVER (PARTITION BY event_type ORDER BY x) AS bad FROM c LEFT JOIN z USING (event_type))
SELECT event_type, coalesce(max(x) FILTER (bad = 0), 0) AS usable_shift FROM b GROUP BY 1""")
def usable_shift(spark, sf):
    return X.usable_shift(curves(spark, sf), 0.2, by=["event_type"])


@query("""WITH e AS (SELECT vec_id % 4 AS condition, label AS y, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS pred FROM embeddings),
x AS (SELECT condition, y AS c, 1 AS s, 0 AS p, (y = pred)::INT AS t FROM e UNION ALL SELECT condition, pred, 0, 1, 0 FROM e),
g AS (SELECT condition, c, sum(s) AS s, sum(p) AS p, sum(t) AS t FROM x GROUP BY ALL)
SELECT condition, sum(s)::BIGINT AS n, sum(t) / sum(s)::DOUBLE AS accuracy, avg(2 * t / (s + p)::DOUBLE) AS score FROM g GROUP BY 1""")
def scores_by_condition(spark, sf):
    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 4).alias("condition"), F.col("label").alias("y"), V.argmax(F.slice("embedding", 1, 10)).alias("pred"))
    return X.scores_by_condition(e)


@query("""WITH m AS (SELECT 'm' || (vec_id % 5) AS model, label % 3 AS cls, avg(embedding[1]::DOUBLE + 0.5) AS recall FROM embeddings GROUP BY ALL),
g AS (SELECT model, list(recall ORDER BY cls) AS recalls, min(recall) AS min_recall, sum(recall) AS macro_f1 FROM m GROUP BY 1) SELECT model, recalls, macro_f1, min_recall FROM g""")
def model_comparison(spark, sf):
    e = table(spark, sf, "embeddings").select(F.concat(F.lit("m"), (F.col("vec_id") % 5).cast("string")).alias("model"), (F.col("label") % 3).alias("cls"), (F.element_at("embedding", 1).cast("double") + 0.5).alias("x"))
    r = e.groupBy("model", "cls").agg(F.avg("x").alias("recall")).groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("cls", "recall"))), lambda s: s["recall"]).alias("recalls"), F.sum("recall").alias("macro_f1"))
    return M.compare_models(r).select("model", "recalls", "macro_f1", "min_recall")


@query(f"""WITH {_CURVES}, r AS (SELECT (x::INT % 2) AS stage, event_type AS run, avg(score) AS score, (max(score) - min(score)) / max(score) AS scale_drop FROM c GROUP BY ALL),
b AS (SELECT * FROM r WHERE run = 'error'), o AS (SELECT * FROM r WHERE run <> 'error' QUALIFY row_number() OVER (PARTITION BY stage ORDER BY scale_drop, run) = 1)
SELECT b.stage, b.run AS baseline, o.run AS best, round(o.scale_drop - b.scale_drop, 6) AS drop_delta, round(o.score - b.score, 6) AS score_delta, CASE WHEN o.scale_drop - b.scale_drop < -0.03 AND o.scale_drop <= 0.15 THEN 'adopt' WHEN o.scale_drop - b.scale_drop < -0.03 THEN 'improved' ELSE 'no_effect' END AS verdict FROM b JOIN o ON b.stage = o.stage""")
def experiment_compare(spark, sf):
    c = curves(spark, sf)
    types = sorted(r[0] for r in c.select("event_type").distinct().collect())
    ord_ = F.element_at(F.create_map(*(F.lit(v) for k, t in enumerate(types) for v in (t, k + 1))), F.col("run"))
    runs = c.groupBy((F.col("x").cast("int") % 2).alias("stage"), F.col("event_type").alias("run")).agg(F.avg("score").alias("score"), ((F.max("score") - F.min("score")) / F.max("score")).alias("scale_drop"))
    v = X.compare_runs(runs.withColumn("ord", ord_), "error")
    return v.select("stage", "baseline", "best", F.round("drop_delta", 6).alias("drop_delta"), F.round("score_delta", 6).alias("score_delta"), "verdict")


@query("""WITH h AS (SELECT event_type, hour(ts)::INT AS epoch, round(avg(value), 6) AS score FROM events GROUP BY ALL), i AS (SELECT *, coalesce(score > max(score) OVER (PARTITION BY event_type ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved, max(score) OVER (PARTITION BY event_type ORDER BY epoch) AS best_so_far FROM h),
b AS (SELECT *, last_value(CASE WHEN improved THEN epoch END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best_epoch FROM i) SELECT event_type, epoch, score, improved, best_so_far, best_epoch, epoch - best_epoch AS epochs_since FROM b""")
def early_stopping_trace(spark, sf):
    h = table(spark, sf, "events").groupBy("event_type", F.hour("ts").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("score"))
    return X.training_trace(h, by=["event_type"])


@query("""SELECT i AS step, round(CASE WHEN i < 10 THEN (i + 1) / 10.0::DOUBLE ELSE 0.01::DOUBLE + 0.99::DOUBLE * 0.5::DOUBLE * (1 + cos(least((i - 10) / 90.0::DOUBLE, 1) * pi())) END, 6) AS factor, round(least(i / 50.0::DOUBLE / 1.5, 1), 6) AS occupancy FROM range(100) r(i)""")
def lr_schedule(spark, sf):
    r = spark.range(100).withColumnRenamed("id", "step")
    return r.select("step", F.round(X.learning_rate("step", 10, 100), 6).alias("factor"), F.round(X.occupancy(F.col("step") / 50.0, 1.5), 6).alias("occupancy"))


@query()
def shortcut_baseline_ml(spark, sf):
    """How well metadata alone tells the class: trees on sizes only; the tests hold it above chance where sizes tell."""
    from brindle.operators.shortcut import shortcut_auroc

    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    feats = d.select("doc_id", F.col("quality").alias("y"), F.log1p(F.col("n_chars").cast("double")).alias("size"), (F.col("n_chars") % 2).cast("double").alias("parity"))
    return shortcut_auroc(feats, ["size", "parity"], "doc_id")
