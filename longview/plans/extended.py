"""More registered queries: tables behind figures, full test results, encodings, trees, graphs and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longview.frame import from_table, move_to_obs, move_to_x, obs_df, var_df
from longview.functions import order
from longview.operators import association, causal, cluster, embedding, encode, figures, impute, normalize, quality, ranking, survival
from longview.plans.catalogue import GAPPY, RISK, SURVIVAL, TENSOR, _design, _effect, _gappy, _r, _survival, _t, _tensor, _treated, register
from longview.session import versions as session_versions

NUMBERS = ["l_quantity", "l_discount", "l_tax"]


def _lines(spark, sf) -> DataFrame:
    return _t(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("obs_id"), "l_returnflag", "l_linestatus", F.col("l_extendedprice").cast("double").alias("l_extendedprice"),
        *(F.col(c).cast("double").alias(c) for c in NUMBERS),
    )


LINES = """n AS (SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS obs_id, l_returnflag AS grp, l_linestatus, CAST(l_extendedprice AS DOUBLE) AS price,
  CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax FROM lineitem)"""
CELLS = LINES + ", v AS (" + " UNION ALL ".join(f"SELECT obs_id, grp, '{c}' AS var, {c} AS x FROM n" for c in NUMBERS) + ")"
RANKED = CELLS + """, s AS (SELECT grp, var, count(x) AS n, sum(x) AS s, sum(x * x) AS q FROM v GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER w - n AS rn, sum(s) OVER w - s AS rs, sum(q) OVER w - q AS rq FROM s WINDOW w AS (PARTITION BY var)),
t AS (SELECT grp, var, (s / n - rs / rn) / sqrt((q - s * s / n) / (n - 1) / n + (rq - rs * rs / rn) / (rn - 1) / rn) AS t FROM r),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY t DESC, var) AS INTEGER) AS place FROM t)"""


# figures
@register("""SELECT c_mktsegment AS x, CAST(c_nationkey % 3 AS VARCHAR) AS hue, count(*) AS n, round(avg(CAST(c_acctbal AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST(c_acctbal AS DOUBLE)), 6) AS sd
FROM customer GROUP BY 1, 2""")
def category_plot(spark, sf):
    return figures.category_plot(_t(spark, sf, "customer").withColumn("k", F.col("c_nationkey") % 3), "c_mktsegment", "c_acctbal", "k")


@register(f"WITH {GAPPY} SELECT obs_id, q IS NOT NULL AS q, p IS NOT NULL AS p, d IS NOT NULL AS d, CAST((q IS NOT NULL)::INT + (p IS NOT NULL)::INT + (d IS NOT NULL)::INT AS INTEGER) AS completeness FROM g")
def missing_matrix(spark, sf):
    return figures.missing_matrix(_gappy(spark, sf), ["q", "p", "d"])


_M3 = [("q", "p"), ("q", "d"), ("p", "d")]


@register(f"""WITH {GAPPY}, e AS ({" UNION ALL ".join(f"SELECT '{min(a, b)}' AS a, '{max(a, b)}' AS b, sqrt(sum(CASE WHEN ({a} IS NULL) <> ({b} IS NULL) THEN 1 ELSE 0 END)) AS d FROM g" for a, b in _M3)}),
o AS (SELECT *, row_number() OVER (ORDER BY round(d, 12), a, b) AS r FROM e), f AS (SELECT * FROM o WHERE r = 1),
x AS (SELECT CASE WHEN 'd' NOT IN (f.a, f.b) THEN 'd' WHEN 'p' NOT IN (f.a, f.b) THEN 'p' ELSE 'q' END AS third FROM f)
SELECT 0 AS step, a AS "left", b AS "right", round(d, 6) AS distance, 2 AS size FROM f UNION ALL
SELECT 1, least(f.a, x.third), greatest(f.a, x.third), round((SELECT avg(d) FROM o WHERE r > 1), 6), 3 FROM f, x""")
def missing_dendrogram(spark, sf):
    return cluster.missing_dendrogram(_gappy(spark, sf), ["q", "p", "d"])


@register(f"""WITH {TENSOR} SELECT obs_id, var, round(avg(value), 6) + 0.0 AS mean, round(arg_min(value, t) FILTER (value IS NOT NULL), 6) + 0.0 AS first, round(arg_max(value, t) FILTER (value IS NOT NULL), 6) + 0.0 AS last
FROM c GROUP BY 1, 2""")
def collapse_time(spark, sf):
    long = _tensor(spark, sf)
    made = [figures.collapse_time(long, how).withColumnRenamed("value", how) for how in ("mean", "first", "last")]
    return made[0].join(made[1], ["obs_id", "var"]).join(made[2], ["obs_id", "var"])


@register(f"WITH {TENSOR} SELECT CAST(obs_id % 2 AS VARCHAR) AS \"group\", var, t, round(sum(value), 6) + 0.0 AS total, count(value) AS n FROM c GROUP BY 1, 2, 3")
def timeseries_groups(spark, sf):
    means = figures.timeseries(_tensor(spark, sf).withColumn("parity", F.col("obs_id") % 2), overlay="parity")
    return means.select("group", "var", "t", (F.col("mean") * F.col("n")).alias("total"), "n")  # means fall halfway between places


@register(f"WITH {TENSOR} SELECT obs_id, var, t, round(value, 6) + 0.0 AS value FROM c WHERE var IN ('click', 'purchase') AND obs_id IN (1, 2, 3, 5, 8)")
def timeseries_labels(spark, sf):
    return figures.timeseries(_tensor(spark, sf), ["click", "purchase"], [1, 2, 3, 5, 8])


_BAL = {c: {a: (f"avg({c}) FILTER (l_linestatus = '{a}')", f"var_samp({c}) FILTER (l_linestatus = '{a}')") for a in "FO"} for c in NUMBERS[:2]}
_WB = {c: {a: f"sum(w * {c}) FILTER (l_linestatus = '{a}') / sum(w) FILTER (l_linestatus = '{a}')" for a in "FO"} for c in NUMBERS[:2]}
_WQ = {c: {a: f"sum(w * {c} * {c}) FILTER (l_linestatus = '{a}') / sum(w) FILTER (l_linestatus = '{a}')" for a in "FO"} for c in NUMBERS[:2]}


@register(f"""WITH {LINES}, w AS (SELECT *, 1 + l_tax AS w FROM n), b AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS covariate, ({_BAL[c]['F'][0]} - {_BAL[c]['O'][0]}) / sqrt(({_BAL[c]['F'][1]} + {_BAL[c]['O'][1]}) / 2) AS u, {_WB[c]['F']} AS f, {_WB[c]['O']} AS o, {_WQ[c]['F']} AS ff, {_WQ[c]['O']} AS oo FROM w" for c in NUMBERS[:2])}),
z AS (SELECT covariate, u, (f - o) / sqrt((ff - f * f + oo - o * o) / 2) AS s FROM b)
SELECT CAST(row_number() OVER (ORDER BY abs(u), covariate) AS INTEGER) AS place, covariate, round(u, 6) + 0.0 AS smd_before, round(s, 6) + 0.0 AS smd_after, abs(s) < 0.1 AS balanced FROM z""")
def love_plot(spark, sf):
    return figures.love_plot(_treated(spark, sf), "t", NUMBERS[:2], 1 + F.col("l_tax"))


@register(f"""WITH {LINES}, l AS (SELECT regr_slope(price, l_quantity) AS b, regr_intercept(price, l_quantity) AS a FROM n)
SELECT obs_id, round(l_quantity, 4) AS x, round(price, 4) AS y, round(a + b * l_quantity, 4) + 0.0 AS fitted, round(price - (a + b * l_quantity), 4) + 0.0 AS residual FROM n, l""", places=4)
def ols_line(spark, sf):
    return figures.fitted_line(_lines(spark, sf), "l_quantity", "l_extendedprice")


@register(f"""WITH {CELLS} SELECT grp AS "group", obs_id, var, round((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w), 6) + 0.0 AS value FROM v WINDOW w AS (PARTITION BY var)""")
def heatmap(spark, sf):
    return figures.heatmap(_lines(spark, sf), "l_returnflag", NUMBERS)


@register(f"""WITH {LINES}, p AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY obs_id, l_quantity, l_discount, l_tax) AS INTEGER) AS place FROM n)
{" UNION ALL ".join(f"SELECT grp AS \"group\", place, obs_id, '{c}' AS var, round({c}, 6) + 0.0 AS value FROM p" for c in NUMBERS)}""")
def tracksplot(spark, sf):
    return figures.tracks(_lines(spark, sf), "l_returnflag", NUMBERS)


@register(f"""WITH {CELLS}, m AS (SELECT grp, var, avg(x) AS m FROM v GROUP BY 1, 2)
SELECT grp AS "group", var, round(m, 6) AS mean, round((m - min(m) OVER w) / (max(m) OVER w - min(m) OVER w), 4) + 0.0 AS scaled FROM m WINDOW w AS (PARTITION BY var)""")
def matrixplot(spark, sf):
    return figures.matrix(_lines(spark, sf), "l_returnflag", NUMBERS).withColumn("scaled", F.round("scaled", 4) + 0.0)


@register(f"""WITH {CELLS} SELECT grp AS "group", var, {_r("quantile_cont(x, 0.25) AS q1", "quantile_cont(x, 0.5) AS median", "quantile_cont(x, 0.75) AS q3")} FROM v GROUP BY 1, 2""")
def stacked_violin(spark, sf):
    return figures.stacked_quantiles(_lines(spark, sf), "l_returnflag", NUMBERS)


@register(f"""WITH {LINES} SELECT obs_id, round(l_quantity, 6) AS x, round(price, 6) AS y, grp AS color FROM n""")
def scatter(spark, sf):
    return figures.scatter(_lines(spark, sf), "l_quantity", "l_extendedprice", "l_returnflag")


@register(f"""WITH {GAPPY}, c AS (SELECT 'q' AS a, 'p' AS b, corr(q, p) AS r FROM g UNION ALL SELECT 'q', 'd', corr(q, d) FROM g UNION ALL SELECT 'p', 'd', corr(p, d) FROM g)
SELECT a, b, round(abs(r), 6) AS strength, CAST(sign(r) AS INTEGER) AS sign FROM c WHERE abs(r) >= 0.001""")
def variable_dependencies(spark, sf):
    return figures.dependencies(association.correlations(_gappy(spark, sf), ["q", "p", "d"]), 0.001, False)


@register(f"""WITH {LINES}, b AS (SELECT l_linestatus AS "group", CAST(least(19, floor(l_discount * 10 / (1.0::DOUBLE / 20))) AS INTEGER) AS bin FROM n WHERE l_discount * 10 BETWEEN 0 AND 1), c AS (SELECT "group", bin, count(*) AS n FROM b GROUP BY 1, 2)
SELECT "group", bin, n, round(n / sum(n) OVER (PARTITION BY "group"), 6) AS share FROM c""")
def overlap_histogram(spark, sf):
    return figures.share_histogram(_lines(spark, sf).withColumn("x", F.col("l_discount") * 10), "x", "l_linestatus")


@register(f"WITH {RANKED} SELECT grp AS \"group\", var, round(t, 4) + 0.0 AS t, place FROM k WHERE place <= 2", places=4)
def ranked_scores(spark, sf):
    return figures.ranked_variables(_lines(spark, sf), "l_returnflag", NUMBERS, 2)


_MEANS = RANKED + ", m AS (SELECT grp, var, avg(x) AS m, avg(CASE WHEN x > 0.05 THEN 1.0 ELSE 0.0 END) AS f, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY 1, 2)"


@register(f"WITH {_MEANS} SELECT k.grp AS ranked_in, place, k.var, m.grp AS \"group\", round(m, 6) AS mean, round(f, 6) AS fraction FROM k JOIN m ON k.var = m.var WHERE place <= 2")
def ranked_dotplot(spark, sf):
    return figures.ranked_matrix(_lines(spark, sf), "l_returnflag", NUMBERS, 2, 0.05)


@register(f"WITH {_MEANS} SELECT k.grp AS ranked_in, place, k.var, m.grp AS \"group\", round(m, 6) AS mean FROM k JOIN m ON k.var = m.var WHERE place <= 1")
def ranked_matrixplot(spark, sf):
    return figures.ranked_matrix(_lines(spark, sf), "l_returnflag", NUMBERS, 1).drop("fraction")


@register(f"WITH {_MEANS} SELECT k.grp AS ranked_in, place, k.var, m.grp AS \"group\", round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3 FROM k JOIN m ON k.var = m.var WHERE place <= 2")
def ranked_stacked_violin(spark, sf):
    return figures.ranked_violins(_lines(spark, sf), "l_returnflag", NUMBERS, 2)


@register(f"WITH {_MEANS} SELECT k.grp AS ranked_in, place, k.var, m.grp AS \"group\", round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3 FROM k JOIN m ON k.var = m.var AND k.grp = m.grp WHERE place <= 3")
def ranked_violin(spark, sf):
    return figures.ranked_violins(_lines(spark, sf), "l_returnflag", NUMBERS, 3).where(F.col("ranked_in") == F.col("group"))


@register(f"""WITH {RANKED}, z AS (SELECT obs_id, grp, var, (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) AS x FROM v WINDOW w AS (PARTITION BY var))
SELECT k.grp AS ranked_in, k.var, z.grp AS "group", obs_id, round(x, 6) + 0.0 AS value FROM k JOIN z ON k.var = z.var AND k.grp = z.grp WHERE place <= 1""")
def ranked_heatmap(spark, sf):
    return figures.ranked_heatmap(_lines(spark, sf), "l_returnflag", NUMBERS, 1)


@register(f"""WITH {RANKED}, p AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY obs_id, l_quantity, l_discount, l_tax) AS INTEGER) AS place FROM n),
u AS ({" UNION ALL ".join(f"SELECT grp, place, obs_id, '{c}' AS var, {c} AS x FROM p" for c in NUMBERS)})
SELECT k.grp AS ranked_in, k.var, u.grp AS "group", u.place, u.obs_id, round(x, 6) + 0.0 AS value FROM k JOIN u ON k.var = u.var WHERE k.place <= 1""")
def ranked_tracksplot(spark, sf):
    return figures.ranked_tracks(_lines(spark, sf), "l_returnflag", NUMBERS, 1)


@register(f"""WITH {RANKED} SELECT grp AS "group", var, round(t, 4) + 0.0 AS score, CAST(row_number() OVER (ORDER BY abs(t) DESC, grp, var) AS INTEGER) AS place FROM k ORDER BY abs(t) DESC LIMIT 5""", places=4)
def ranking_top(spark, sf):
    moments = ranking.welch(ranking.group_moments(_lines(spark, sf), "l_returnflag", NUMBERS))
    return figures.top_by(moments.select("group", "var", F.col("t").alias("score")), "score", 5, absolute=True)


@register(f"""WITH {LINES}, z AS (SELECT grp, {", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in ("price", *NUMBERS))} FROM n),
m AS (SELECT grp, unnest([avg(price), avg(l_quantity), avg(l_discount), avg(l_tax)]) AS m, unnest([1, 2, 3, 4]) AS i FROM z GROUP BY 1),
e AS (SELECT a.grp AS a, b.grp AS b, 1 - corr(a.m, b.m) AS d FROM m a JOIN m b ON a.i = b.i AND a.grp < b.grp GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (ORDER BY round(d, 12), a, b) AS r FROM e), f AS (SELECT * FROM o WHERE r = 1), x AS (SELECT min(grp) AS third FROM m, f WHERE grp NOT IN (f.a, f.b))
SELECT 0 AS step, a AS "left", b AS "right", round(d, 6) + 0.0 AS distance, 2 AS size FROM f UNION ALL SELECT 1, least(f.a, third), greatest(f.a, third), round((SELECT max(d) FROM o WHERE r > 1), 6) + 0.0, 3 FROM f, x""")
def dendrogram(spark, sf):
    columns = ["l_extendedprice", *NUMBERS]
    return cluster.dendrogram(normalize.scale(_lines(spark, sf), columns), "l_returnflag", columns)


@register()
def clustermap(spark, sf):
    return cluster.cluster_map(_lines(spark, sf), "l_returnflag", NUMBERS)


# data access
@register("SELECT CAST(c_custkey AS BIGINT) AS obs_id, round(CAST(c_acctbal AS DOUBLE), 6) AS c_acctbal, c_mktsegment FROM customer")
def obs_table(spark, sf):
    frame = from_table(_t(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment"), "c_custkey", ["c_mktsegment"])
    return obs_df(frame, ["c_acctbal", "c_mktsegment"])


@register("""SELECT 'bal' AS var, max(CASE WHEN c_custkey = 1 THEN CAST(c_acctbal AS DOUBLE) END) AS "1", max(CASE WHEN c_custkey = 2 THEN CAST(c_acctbal AS DOUBLE) END) AS "2" FROM customer
UNION ALL SELECT 'nation', max(CASE WHEN c_custkey = 1 THEN CAST(c_nationkey AS DOUBLE) END), max(CASE WHEN c_custkey = 2 THEN CAST(c_nationkey AS DOUBLE) END) FROM customer""")
def var_table(spark, sf):
    frame = from_table(_t(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("bal"), F.col("c_nationkey").cast("double").alias("nation")), "c_custkey")
    return var_df(frame, [1, 2])


@register("SELECT CAST(c_custkey AS BIGINT) AS obs_id, c_mktsegment, round(CAST(c_acctbal AS DOUBLE), 6) AS c_acctbal FROM customer")
def moved_columns(spark, sf):
    frame = from_table(_t(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment"), "c_custkey", ["c_mktsegment"])
    frame = move_to_x(move_to_obs(frame, ["c_acctbal"]), ["c_mktsegment"])
    return frame.x.join(frame.obs, "obs_id")


@register("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def membership(spark, sf):
    return _t(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_mktsegment")


@register("SELECT CAST(c_custkey AS BIGINT) AS obs_id, CASE WHEN c_acctbal >= 0 THEN round(1 + CAST(c_acctbal AS DOUBLE) / 100, 6) END AS weight FROM customer")
def aligned_weights(spark, sf):
    """Weights of the rows an analysis kept, back on all rows."""
    rows = _t(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("obs_id"), F.col("c_acctbal").cast("double").alias("bal"))
    kept = rows.where("bal >= 0").select("obs_id", (1 + F.col("bal") / 100).alias("weight"))
    return rows.select("obs_id").join(kept, "obs_id", "left")


@register("SELECT CAST(200 AS BIGINT) AS n")
def subsample(spark, sf):
    return encode.sample(_t(spark, sf, "orders"), n=200, seed=3).agg(F.count(F.lit(1)).alias("n"))


# tests and regressions
_PAIRS = [(m, v) for m in "qpd" for v in "qpd" if m != v]


@register(f"WITH {GAPPY}, a AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS missing, '{v}' AS var, avg({v}) FILTER ({m} IS NULL) AS m1, var_samp({v}) FILTER ({m} IS NULL) / count({v}) FILTER ({m} IS NULL) AS a, count({v}) FILTER ({m} IS NULL) AS n1, "
    f"avg({v}) FILTER ({m} IS NOT NULL) AS m2, var_samp({v}) FILTER ({m} IS NOT NULL) / count({v}) FILTER ({m} IS NOT NULL) AS b, count({v}) FILTER ({m} IS NOT NULL) AS n2 FROM g" for m, v in _PAIRS
) + ") SELECT missing, var, round((m1 - m2) / sqrt(a + b), 5) + 0.0 AS t, round((a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)), 3) AS df FROM a")
def mcar_t_tests(spark, sf):
    return association.mcar_t_tests(_gappy(spark, sf), ["q", "p", "d"]).select("missing", "var", F.round("t", 5).alias("t"), F.round("df", 3).alias("df"))


@register(f"""WITH {GAPPY}, c AS (SELECT q - (SELECT avg(q) FROM g) AS q, p - (SELECT avg(p) FROM g) AS p FROM g),
s AS (SELECT sum(q * q) / (count(q) - 1) AS qq, sum(p * p) / (count(p) - 1) AS pp, sum(q * p) / (count(q * p) - 1) AS qp FROM c),
k AS (SELECT q IS NULL AS nq, p IS NULL AS np, count(*) AS n, avg(q) AS q, avg(p) AS p FROM c GROUP BY 1, 2)
SELECT round(sum(n * CASE WHEN NOT nq AND NOT np THEN (q * q * pp - 2 * q * p * qp + p * p * qq) / (qq * pp - qp * qp) WHEN np AND NOT nq THEN q * q / qq WHEN nq AND NOT np THEN p * p / pp ELSE 0 END), 5) AS statistic,
CAST(sum((NOT nq)::INT + (NOT np)::INT) - 2 AS DOUBLE) AS df FROM k, s""", places=5)
def mcar_little_pair(spark, sf):
    statistic, df, _ = association.little_test(_gappy(spark, sf), ["q", "p"])
    return spark.createDataFrame([(statistic, df)], "statistic double, df double")


@register(f"""WITH {GAPPY}, b AS (SELECT q, d FROM g WHERE q IS NOT NULL AND d IS NOT NULL), k AS (SELECT q, d, count(*) AS k FROM b GROUP BY 1, 2), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM b),
s AS (SELECT sum(x.k * y.k * sign(y.d - x.d)) AS s FROM k x JOIN k y ON x.q < y.q), tq AS (SELECT sum(c * (c - 1) / 2) AS t FROM (SELECT count(*) AS c FROM b GROUP BY q)), td AS (SELECT sum(c * (c - 1) / 2) AS t FROM (SELECT count(*) AS c FROM b GROUP BY d))
SELECT 'q' AS a, 'd' AS b, round(s / (sqrt(n * (n - 1) / 2 - tq.t) * sqrt(n * (n - 1) / 2 - td.t)), 6) + 0.0 AS corr FROM s, n, tq, td""")
def kendall(spark, sf):
    return association.correlations(_gappy(spark, sf), ["q", "d"], "kendall").select("a", "b", "corr")


@register(f"""WITH {RISK} SELECT time, round(sum(CASE WHEN observed > 0 THEN list_sum(list_transform(range(observed), lambda i: 1.0 / (at_risk - i))) ELSE 0 END) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS hazard FROM r""")
def nelson_aalen_smooth(spark, sf):
    return survival.nelson_aalen(_survival(spark, sf), "duration", "event").select("time", "hazard")


@register(f"""WITH {SURVIVAL}, b AS (SELECT duration AS t, sum(event) AS d, count(*) AS m, coalesce(sum(event) FILTER (arm = 'F'), 0) AS d1, count(*) FILTER (arm = 'F') AS m1 FROM s GROUP BY 1),
r AS (SELECT *, sum(m) OVER (ORDER BY t DESC) AS n, sum(m1) OVER (ORDER BY t DESC) AS n1 FROM b), p AS (SELECT *, product(1 - d / (n + 1)) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM r),
w AS (SELECT 'none' AS weighting, 1.0::DOUBLE AS w, * FROM p UNION ALL SELECT 'peto', s, * FROM p UNION ALL SELECT 'tarone-ware', sqrt(n), * FROM p UNION ALL SELECT 'wilcoxon', n::DOUBLE, * FROM p),
k AS (SELECT weighting, sum(w * (d1 - d * n1 / n)) AS u, sum(CASE WHEN n > 1 THEN w * w * d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM w WHERE d > 0 GROUP BY 1) SELECT weighting, round(u * u / v, 3) AS chi2 FROM k""", places=3)
def logrank_weighted(spark, sf):
    s = _survival(spark, sf)
    rows = [(w or "none", float(survival.logrank(s, "duration", "event", "arm", "F", w)[0])) for w in (None, "wilcoxon", "tarone-ware", "peto")]
    return spark.createDataFrame(rows, "weighting string, chi2 double")


@register(f"""WITH {RISK}, k AS (SELECT time, observed, at_risk, product(1 - observed / at_risk) OVER w AS s, sum(CASE WHEN at_risk > observed THEN observed / (at_risk * (at_risk - observed)) ELSE 0 END) OVER w AS g FROM r WINDOW w AS (ORDER BY time ROWS UNBOUNDED PRECEDING)),
z AS (SELECT *, 1.959963984540054 * sqrt(g) / nullif(abs(ln(CASE WHEN s > 0 THEN s ELSE 1 END)), 0) AS h FROM k)
SELECT time, observed, at_risk, round(s, 6) + 0.0 AS survival, round(CASE WHEN s > 0 AND s < 1 THEN pow(s, exp(h)) ELSE s END, 6) + 0.0 AS low, round(CASE WHEN s > 0 AND s < 1 THEN pow(s, exp(-h)) ELSE s END, 6) + 0.0 AS high FROM z""")
def survival_bands(spark, sf):
    return figures.survival_bands(_survival(spark, sf), "duration", "event")


@register(f"""WITH {SURVIVAL}, b AS (SELECT duration AS time, count(*) AS observed FROM s GROUP BY 1), r AS (SELECT *, sum(observed) OVER (ORDER BY time DESC) AS at_risk FROM b)
SELECT time, observed, CAST(at_risk AS BIGINT) AS at_risk, round(product(1 - observed / at_risk) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS survival FROM r""")
def kmf(spark, sf):
    return survival.kmf(_survival(spark, sf), "duration").select("time", "observed", "at_risk", "survival")


_OLS = f"""{LINES}, a AS (SELECT count(*) AS n, avg(l_quantity) AS mx, regr_slope(price, l_quantity) AS b, regr_intercept(price, l_quantity) AS a, var_pop(l_quantity) * count(*) AS sxx,
  var_pop(price) * count(*) * (1 - pow(corr(price, l_quantity), 2)) AS ssr FROM n), e AS (SELECT *, ssr / (n - 2) AS s2 FROM a)"""


@register(f"""WITH {_OLS} SELECT 'intercept' AS term, round(a, 3) AS coef, round(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 3) AS se, round(a / sqrt(s2 * (1.0 / n + mx * mx / sxx)), 3) AS t FROM e
UNION ALL SELECT 'l_quantity', round(b, 3), round(sqrt(s2 / sxx), 3), round(b / sqrt(s2 / sxx), 3) FROM e""", places=3)
def ols_table(spark, sf):
    return survival.ols_formula(_lines(spark, sf), "l_extendedprice ~ l_quantity").select("term", "coef", "se", "t")


@register(f"""WITH {LINES}, s AS (SELECT count(*) AS n, var_pop(price) * count(*) AS yy, var_pop(l_quantity) * count(*) AS aa, var_pop(l_discount) * count(*) AS bb, covar_pop(l_quantity, l_discount) * count(*) AS ab,
covar_pop(price, l_quantity) * count(*) AS ya, covar_pop(price, l_discount) * count(*) AS yb FROM n),
r AS (SELECT n, yy - ya * ya / aa AS small, yy - ((ya * bb - yb * ab) * ya + (yb * aa - ya * ab) * yb) / (aa * bb - ab * ab) AS big FROM s)
SELECT 'small' AS model, n - 2 AS df_resid, CAST(0 AS BIGINT) AS df_diff, CAST(NULL AS DOUBLE) AS f FROM r UNION ALL SELECT 'big', n - 3, 1, round((small - big) / (big / (n - 3)), 3) FROM r""", places=3)
def anova(spark, sf):
    lines = _lines(spark, sf)
    small, big = (survival.fit_summary(lines, f"l_extendedprice ~ {x}") for x in ("l_quantity", "l_quantity + l_discount"))
    return survival.anova(spark, small, big).select("model", "df_resid", "df_diff", "f")


@register("""WITH a AS (SELECT c_mktsegment AS g, CAST(c_acctbal AS DOUBLE) AS x, c_nationkey % 3 AS k FROM customer), m AS (SELECT g, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM a GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS m FROM m),
f AS (SELECT 'bal' AS var, 'anova' AS test, (sum(m.n * pow(m.m - t.m, 2)) / (max(t.k) - 1)) / (sum((m.n - 1) * v) / (max(t.n) - max(t.k))) AS s, max(t.k) - 1 AS d1, max(t.n) - max(t.k) AS d2 FROM m, t),
r AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS r FROM a), q AS (SELECT sum(pow(s, 2) / n) AS s, sum(n) AS n, count(*) AS k FROM (SELECT g, sum(r) AS s, count(*) AS n FROM r GROUP BY 1)),
ties AS (SELECT sum(pow(c, 3) - c) AS t FROM (SELECT count(*) AS c FROM a GROUP BY x)), h AS (SELECT 'med' AS var, 'kruskal-wallis' AS test, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (pow(n, 3) - n)) AS s, k - 1 AS d1, NULL AS d2 FROM q, ties),
c AS (SELECT g, k, count(*) AS n FROM a GROUP BY 1, 2), e AS (SELECT n, sum(n) OVER (PARTITION BY g) * sum(n) OVER (PARTITION BY k) / sum(n) OVER () AS e FROM c), x AS (SELECT 'k' AS var, 'chi-square' AS test, sum(pow(n - e, 2) / e) AS s, 8 AS d1, NULL AS d2 FROM e)
SELECT var, test, round(s, 5) AS statistic, CAST(d1 AS DOUBLE) AS df1, CAST(d2 AS DOUBLE) AS df2 FROM (SELECT * FROM f UNION ALL SELECT * FROM h UNION ALL SELECT * FROM x)""", places=5)
def table_one_tests(spark, sf):
    c = _t(spark, sf, "customer").select("c_mktsegment", F.col("c_acctbal").cast("double").alias("bal"), F.col("c_acctbal").cast("double").alias("med"), (F.col("c_nationkey") % 3).alias("k"))
    return ranking.table_one_tests(c, "c_mktsegment", ["bal", "med"], ["k"], ["med"]).select("var", "test", "statistic", "df1", "df2")


@register("""WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size AS DOUBLE) AS a, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_retailprice AS DOUBLE) END AS price FROM part),
n AS (SELECT x.k, y.price, row_number() OVER (PARTITION BY x.k ORDER BY (x.a - y.a) * (x.a - y.a), y.k) AS r FROM p x JOIN p y ON x.price IS NULL AND y.price IS NOT NULL), m AS (SELECT k, avg(price) AS price FROM n WHERE r <= 5 GROUP BY 1)
SELECT p.k AS obs_id, a, round(coalesce(p.price, m.price), 6) AS price FROM p LEFT JOIN m ON p.k = m.k""")
def impute_knn_rows(spark, sf):
    df = _t(spark, sf, "part").select(
        F.col("p_partkey").cast("long").alias("obs_id"), F.col("p_size").cast("double").alias("a"),
        F.expr("case when p_partkey % 11 = 0 then null else cast(p_retailprice as double) end").alias("price"),
    )
    return impute.knn(df, ["price"], ["a"], k=5)


@register("""WITH s AS (SELECT 0 AS step, 'all' AS label, CAST(NULL AS VARCHAR) AS parent, CAST(c_acctbal AS DOUBLE) AS bal, c_mktsegment AS seg FROM customer UNION ALL SELECT 1, 'solvent', 'all', CAST(c_acctbal AS DOUBLE), c_mktsegment FROM customer WHERE c_acctbal >= 0)
SELECT step, label, parent, count(*) AS cohort, 'bal' AS var, CAST(NULL AS VARCHAR) AS level, count(*) AS n, round(avg(bal), 6) AS value, round(stddev_samp(bal), 6) AS spread FROM s GROUP BY 1, 2, 3 UNION ALL
SELECT step, label, parent, CAST(sum(n) OVER (PARTITION BY step) AS BIGINT), 'c_mktsegment', seg, n, round(n / sum(n) OVER (PARTITION BY step), 6), NULL FROM (SELECT step, label, parent, seg, count(*) AS n FROM s GROUP BY 1, 2, 3, 4)""")
def cohort_tracking(spark, sf):
    df = _t(spark, sf, "customer").select(F.col("c_acctbal").cast("double").alias("bal"), "c_mktsegment")
    tracker = ranking.CohortTracker(df, ["bal"], ["c_mktsegment"])
    tracker(df, "all")
    tracker(df.where("bal >= 0"), "solvent", "filter")
    return tracker.tracked_tables(spark)


@register(f"""WITH {LINES}, c AS (SELECT 'l_linestatus' AS sensitive, unnest(['l_quantity', 'l_discount', 'l_tax']) AS var, unnest([corr(s, l_quantity), corr(s, l_discount), corr(s, l_tax)]) AS r FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS s FROM n))
SELECT sensitive, var, round(r, 6) + 0.0 AS corr FROM c""")
def bias_correlations(spark, sf):
    return association.detect_bias(_lines(spark, sf), ["l_linestatus"], NUMBERS, method="pearson", corr_above=0.0)["correlations"]


@register("""WITH a AS (SELECT l_returnflag AS value, l_linestatus AS category, count(*) AS k FROM lineitem GROUP BY 1, 2), f AS (SELECT v.value, c.category, coalesce(a.k, 0) AS k FROM (SELECT DISTINCT value FROM a) v CROSS JOIN (SELECT DISTINCT category FROM a) c LEFT JOIN a ON a.value = v.value AND a.category = c.category),
s AS (SELECT *, k / sum(k) OVER (PARTITION BY value) AS share, (sum(k) OVER (PARTITION BY category) - k) / nullif(sum(k) OVER () - sum(k) OVER (PARTITION BY value), 0) AS other FROM f), r AS (SELECT value, category, share, share / nullif(other, 0) AS ratio FROM s)
SELECT 'l_returnflag' AS sensitive, value, category, round(share, 6) AS share, round(ratio, 6) AS ratio, 'l_linestatus' AS var FROM r WHERE greatest(ratio, CASE WHEN ratio = 0 THEN NULL ELSE 1 / ratio END) > 1.001""")
def bias_ratios(spark, sf):
    return association.detect_bias(_lines(spark, sf), ["l_returnflag"], NUMBERS, ["l_linestatus"], method="pearson", ratio_above=1.001)["shares"]


# encodings
@register("""SELECT CAST(c_custkey AS BIGINT) AS obs_id, """ + ", ".join(f"CAST((c_mktsegment = '{v}')::INT AS FLOAT) AS \"cat_c_mktsegment_{v}\"" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + ", CAST(c_acctbal AS DOUBLE) AS bal FROM customer")
def encode_detected(spark, sf):
    df = _t(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("obs_id"), "c_mktsegment", F.col("c_acctbal").cast("double").alias("bal"))
    return encode.Encoded.detect(df).frame


@register("""SELECT CAST(c_custkey AS BIGINT) AS obs_id, CAST((SELECT count(DISTINCT x.c_mktsegment) FROM customer x WHERE x.c_mktsegment < y.c_mktsegment) AS FLOAT) AS cat_c_mktsegment, CAST(c_acctbal AS DOUBLE) AS bal FROM customer y""")
def encode_again(spark, sf):
    df = _t(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("obs_id"), "c_mktsegment", F.col("c_acctbal").cast("double").alias("bal"))
    return encode.Encoded.detect(df).encode({"c_mktsegment": "label"}).frame


@register("SELECT CAST(c_custkey AS BIGINT) AS obs_id, c_mktsegment, CAST(c_acctbal AS DOUBLE) AS bal FROM customer")
def encode_undone(spark, sf):
    df = _t(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("obs_id"), "c_mktsegment", F.col("c_acctbal").cast("double").alias("bal"))
    return encode.Encoded.detect(df).undo()


# decompositions and graphs
@register(f"""WITH {LINES}, s AS (SELECT var_pop(l_quantity) AS a, var_pop(price) AS b, covar_pop(l_quantity, price) AS c FROM n), e AS (SELECT *, (a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c) AS l FROM s)
SELECT 1 AS component, round(l / (a + b), 6) AS share, round(c / sqrt(c * c + pow(l - a, 2)), 6) AS load_quantity, round((l - a) / sqrt(c * c + pow(l - a, 2)), 6) AS load_price FROM e""")
def pca_pair(spark, sf):
    _, load, share = embedding.pca(_lines(spark, sf), ["l_quantity", "l_extendedprice"], 2)
    return spark.createDataFrame([(1, float(share[0]), float(load[0, 0]), float(load[1, 0]))], "component int, share double, load_quantity double, load_price double")


@register()
def pca_variance(spark, sf):
    v = _t(spark, sf, "embeddings")
    width = v.agg(F.max(F.size("embedding"))).first()[0] or 0
    df = v.select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(width)))
    _, load, share = embedding.pca(df, [f"e{i}" for i in range(width)], 4, "vec_id")
    rows = [(j + 1, f"e{i}", float(load[i, j]), float(share[j])) for j in range(load.shape[1]) for i in range(width)]
    return spark.createDataFrame(rows, "component int, var string, loading double, share double")


def _graph(spark, sf) -> DataFrame:
    return cluster.connectivities(embedding.nearest_all(_t(spark, sf, "embeddings"), 15))


@register()
def graph_weights(spark, sf):
    return _graph(spark, sf)


@register()
def diffusion_components(spark, sf):
    return cluster.diffusion_map(_graph(spark, sf), 3, rounds=12)[0]


@register()
def diffusion_pseudotime(spark, sf):
    parts, values = cluster.diffusion_map(_graph(spark, sf), 3, rounds=12)
    root = parts.agg(F.min("id")).first()[0]
    labels = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return figures.pseudotime_order(cluster.pseudotime(parts, values, root), labels)


@register()
def graph_communities(spark, sf):
    return cluster.modularity_communities(_graph(spark, sf))


@register()
def graph_layout(spark, sf):
    v = _t(spark, sf, "embeddings")
    width = v.agg(F.max(F.size("embedding"))).first()[0] or 0
    df = v.select(F.col("vec_id").alias("obs_id"), *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(width)))
    start = embedding.pca(df, [f"e{i}" for i in range(width)], 2)[0].select(F.col("obs_id").alias("id"), F.col("pc1").alias("x"), F.col("pc2").alias("y"))
    return cluster.layout(_graph(spark, sf), start, rounds=8)


@register("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.vec_id AS id, CAST(b.label AS VARCHAR) AS label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(1 - list_cosine_similarity(a.v, b.v), 12), b.vec_id) AS r
FROM e a JOIN e b ON a.vec_id <> b.vec_id AND b.vec_id % 50 <> 0 WHERE a.vec_id % 50 = 0), c AS (SELECT id, label, count(*) AS n FROM d WHERE r <= 15 GROUP BY 1, 2),
k AS (SELECT *, n / sum(n) OVER (PARTITION BY id) AS share, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS r FROM c) SELECT id, label, round(share, 6) AS share FROM k WHERE r = 1""")
def ingest_labels(spark, sf):
    """Labels of the query set from all other vectors."""
    v = _t(spark, sf, "embeddings")
    near = embedding.nearest(v.where("vec_id % 50 <> 0"), v.where("vec_id % 50 = 0"), 15)
    return cluster.transfer_labels(near, v.select(F.col("vec_id").alias("id"), "label"))


@register()
def soft_dtw_distances(spark, sf):
    return embedding.series_distances_all(_tensor(spark, sf), metric="soft_dtw")


@register()
def alignment_distances(spark, sf):
    long = _tensor(spark, sf)
    return embedding.series_distances(long, long.where("obs_id % 50 = 0"), metric="gak")


@register()
def versions(spark, sf):
    return session_versions(spark)


@register()
def embedding_density(spark, sf):
    return embedding.density(_lines(spark, sf).select("obs_id", "l_quantity", "l_extendedprice", "l_linestatus"), "l_quantity", "l_extendedprice", "l_linestatus")


# models without a closed form
@register()
def highly_variable(spark, sf):
    return quality.highly_variable(_lines(spark, sf).withColumn("x", F.col("l_extendedprice") / F.col("l_quantity")), ["l_extendedprice", *NUMBERS, "x"], 0.4)


@register()
def combat(spark, sf):
    return normalize.combat(_lines(spark, sf).select("obs_id", "l_returnflag", *NUMBERS), NUMBERS, "l_returnflag")


@register()
def impute_forest(spark, sf):
    return impute.by_trees(_gappy(spark, sf).select("obs_id", "q", "p", "d"), ["q", "p", "d"], rounds=1, trees=5)


@register()
def log_logistic_aft(spark, sf):
    return survival.log_logistic_aft(_survival(spark, sf), "duration", "event", ["l_quantity", "l_discount"])


@register()
def cox_strata(spark, sf):
    return survival.cox(_survival(spark, sf), "duration", "event", ["l_quantity", "l_discount"], strata="arm", penalty=1e-4)


@register()
def cox_adjusted_curves(spark, sf):
    s = _survival(spark, sf).withColumn("f", (F.col("arm") == "F").cast("int"))
    return survival.adjusted_curves(s, "duration", "event", ["l_quantity", "l_discount"], "f", points=20)


@register()
def causal_iptw_refit(spark, sf):
    return _effect(spark, causal.iptw(_design(spark, sf), n_bootstrap=3))


@register()
def causal_matching_both(spark, sf):
    return _effect(spark, causal.matching(_design(spark, sf), estimand="ate"))


@register()
def causal_matching(spark, sf):
    e = causal.matching(_design(spark, sf))
    return spark.createDataFrame([(e.method, float(e.value), int(e.n), int(e.dropped))], "method string, value double, n long, dropped long")


@register(f"""WITH {LINES}, p AS (SELECT percent_rank() OVER (ORDER BY price) AS p, price FROM n) SELECT count(*) AS n, round(min(p), 6) AS low, round(max(p), 6) AS high FROM p""")
def quantile_range(spark, sf):
    return normalize.percent_rank(_lines(spark, sf), "l_extendedprice").agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@register(f"""WITH {LINES} SELECT {", ".join(f"round(quantile_cont(price, {p}), 6) AS q{int(p * 100)}" for p in (0.05, 0.25, 0.5, 0.95))} FROM n""")
def exact_quantiles(spark, sf):
    got = order.exact_quantiles(_lines(spark, sf), ["l_extendedprice"], [0.05, 0.25, 0.5, 0.95])["l_extendedprice"]
    return spark.createDataFrame([tuple(got)], "q5 double, q25 double, q50 double, q95 double")
