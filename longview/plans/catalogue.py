"""Registered queries over the star-schema tables, with the SQL that gives the same rows.

The tables hold no NULLs, so some queries make values missing by a rule that both engines share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longview.frame import to_long
from longview.functions import stats
from longview.operators import association, causal, embedding, encode, filters, impute, normalize, plotdata, quality, ranking, survival

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _gappy(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with an id and gaps."""
    return _t(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("obs_id"),
        F.expr("case when l_linenumber % 3 = 0 then null else cast(l_quantity as double) end").alias("q"),
        F.expr("case when l_orderkey % 7 = 0 then null else cast(l_extendedprice as double) end").alias("p"),
        F.expr("case when (l_orderkey + l_linenumber) % 5 = 0 then null else cast(l_discount as double) end").alias("d"),
        "l_returnflag", "l_linestatus", F.col("l_orderkey").cast("long").alias("l_orderkey"),
    )


GAPPY = """g AS (SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS obs_id,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS q,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_extendedprice AS DOUBLE) END AS p,
  CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN NULL ELSE CAST(l_discount AS DOUBLE) END AS d,
  l_returnflag, l_linestatus, CAST(l_orderkey AS BIGINT) AS l_orderkey FROM lineitem)"""
LONG = GAPPY + """, l AS (SELECT obs_id, l_returnflag, 'q' AS var, q AS value FROM g UNION ALL SELECT obs_id, l_returnflag, 'p', p FROM g UNION ALL SELECT obs_id, l_returnflag, 'd', d FROM g)"""


def _tensor(spark: SparkSession, sf: str) -> DataFrame:
    """events as (obs_id, var, t, value): one row per user, type and day with an event, days from the first."""
    e = _t(spark, sf, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("int")
    return e.groupBy(F.col("user_id").alias("obs_id"), F.col("event_type").alias("var"), day.alias("t")).agg(
        F.expr("case when sum(cast(event_id % 4 = 0 as int)) > 0 then null else round(avg(value), 6) end").alias("value")
    )


TENSOR = """c AS (SELECT user_id AS obs_id, event_type AS var, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t,
  CASE WHEN sum(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) > 0 THEN NULL ELSE round(avg(value), 6) END AS value FROM events GROUP BY ALL)"""


def _survival(spark: SparkSession, sf: str) -> DataFrame:
    line, orders = _t(spark, sf, "lineitem"), _t(spark, sf, "orders")
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey)
    return joined.select(
        F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).cast("double").alias("duration"),
        (F.col("l_returnflag") == "R").cast("int").alias("event"),
        F.col("l_linestatus").alias("arm"),
        F.col("l_quantity").cast("double").alias("l_quantity"),
        F.col("l_discount").cast("double").alias("l_discount"),
    ).where("duration >= 0")


SURVIVAL = """s AS (SELECT CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS duration,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS event, l_linestatus AS arm,
  CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_discount AS DOUBLE) AS l_discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) >= 0)"""
RISK = SURVIVAL + """, b AS (SELECT duration AS time, sum(event) AS observed, count(*) AS removed FROM s GROUP BY 1),
r AS (SELECT time, CAST(observed AS BIGINT) AS observed, CAST(removed - observed AS BIGINT) AS censored, CAST(sum(removed) OVER (ORDER BY time DESC) AS BIGINT) AS at_risk FROM b)"""


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, with -0.0 made 0.0."""
    return df.select(*((F.round(F.col(f"`{n}`"), places) + 0.0).alias(n) if k == "double" else F.col(f"`{n}`") for n, k in df.dtypes))


REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(sql: str | None = None, places: int = 6):
    def add(f):
        REGISTRY[f.__name__] = (lambda spark, sf: _rounded(f(spark, sf), places), sql)
        return f

    return add


def _r(*names: str, places: int = 6) -> str:
    return ", ".join(f"round({n.split(' AS ')[0]}, {places}) + 0.0 AS {n.split(' AS ')[-1]}" for n in names)


# quality control
@register(f"""WITH {LONG}, a AS (SELECT var, count(*) AS total, count(value) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi FROM l GROUP BY var),
e AS (SELECT *, greatest(1e-10, least(1 - 1e-10, (total - n) / total)) AS z FROM a)
SELECT var, total - n AS missing_values_abs, {_r("(total - n) / total * 100 AS missing_values_pct", "-(z * log2(z) + (1 - z) * log2(1 - z)) AS entropy_of_missingness", "mean", "median", "sd AS standard_deviation", '"lo" AS min', '"hi" AS max')},
  lo < q1 - 1.5 * (q3 - q1) OR hi > q3 + 1.5 * (q3 - q1) AS iqr_outliers, {_r("sd / mean AS coefficient_of_variation")}, lo = hi AS is_constant, {_r("(hi - lo) / mean * 100 AS range_ratio")} FROM e""")
def qc_var(spark, sf):
    return quality.qc_var(to_long(_gappy(spark, sf), ["q", "p", "d"]))


@register(f"""WITH {GAPPY}, a AS (SELECT obs_id, CAST((q IS NULL)::INT + (p IS NULL)::INT + (d IS NULL)::INT AS BIGINT) AS m FROM g),
e AS (SELECT *, greatest(1e-10, least(1 - 1e-10, m / 3)) AS z FROM a)
SELECT obs_id, m AS missing_values_abs, {_r("m / 3 * 100 AS missing_values_pct", "-(z * log2(z) + (1 - z) * log2(1 - z)) AS entropy_of_missingness")} FROM e""")
def qc_obs(spark, sf):
    return quality.qc_obs(_gappy(spark, sf), ["q", "p", "d"])


@register("""SELECT 'l_returnflag' AS var, count(DISTINCT l_returnflag) AS unique_values_abs, round(count(DISTINCT l_returnflag) / count(l_returnflag), 6) AS unique_values_ratio FROM lineitem
UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus), round(count(DISTINCT l_linestatus) / count(l_linestatus), 6) FROM lineitem""")
def qc_categorical(spark, sf):
    return quality.qc_categorical(_t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


def _lab(method: str, score: str, group: str | None):
    def query(spark, sf):
        return quality.qc_lab(_gappy(spark, sf), "p", method, score, group).select("obs_id", "p_outlier", "p_score")

    part = "PARTITION BY l_returnflag" if group else ""
    flag = {
        "iqr": "p < q1 - 1.5 * (q3 - q1) OR p > q3 + 1.5 * (q3 - q1)",
        "quantile": "p < lo OR p > hi",
        "zscore": "abs(p - m) / s > 3",
        "modified_zscore": "abs(0.6745 * (p - q2) / nullif(mad, 0)) > 3.5",
    }[method]
    value = {"zscore": "(p - m) / s", "iqr": "(p - q2) / (q3 - q1)", "percentile": "(rank() OVER (" + (part or "") + " ORDER BY p NULLS LAST) + (count(*) OVER (PARTITION BY p" + (", l_returnflag" if group else "") + ") - 1) / 2) / n * 100"}[score]
    sql = f"""WITH {GAPPY}, a AS (SELECT *, avg(p) OVER w AS m, stddev_pop(p) OVER w AS s, count(p) OVER w AS n, quantile_cont(p, 0.025) OVER w AS lo, quantile_cont(p, 0.25) OVER w AS q1,
      quantile_cont(p, 0.5) OVER w AS q2, quantile_cont(p, 0.75) OVER w AS q3, quantile_cont(p, 0.975) OVER w AS hi FROM g WINDOW w AS ({part})),
      b AS (SELECT *, quantile_cont(abs(p - q2), 0.5) OVER ({part}) AS mad FROM a)
      SELECT obs_id, coalesce({flag}, false) AS p_outlier, CASE WHEN p IS NOT NULL THEN round({value}, 6) + 0.0 END AS p_score FROM b"""
    return query, sql


for _name, _args in {
    "qc_lab_iqr": ("iqr", "zscore", None), "qc_lab_iqr_grouped": ("iqr", "iqr", "l_returnflag"), "qc_lab_quantile": ("quantile", "zscore", None),
    "qc_lab_zscore_grouped": ("zscore", "zscore", "l_returnflag"), "qc_lab_modified_zscore": ("modified_zscore", "iqr", None), "qc_lab_percentile": ("iqr", "percentile", "l_returnflag"),
}.items():
    _query, _sql = _lab(*_args)
    REGISTRY[_name] = (lambda spark, sf, f=_query: _rounded(f(spark, sf)), _sql)


@register(f"WITH {GAPPY} SELECT l_orderkey, {_r('min(q) AS q_min', 'max(q) AS q_max', 'avg(q) AS q_mean', 'min(p) AS p_min', 'max(p) AS p_max', 'avg(p) AS p_mean')} FROM g GROUP BY 1")
def summarize_measurements(spark, sf):
    return quality.summarize_measurements(_gappy(spark, sf), "l_orderkey", ["q", "p"])


# filters, clipping, masks
@register(f"WITH {LONG} SELECT var, count(value) AS n_nonmissing FROM l GROUP BY var HAVING count(value) <= (SELECT count(*) * 0.82 FROM g)")
def filter_features(spark, sf):
    g = _gappy(spark, sf)
    return filters.filter_features(to_long(g, ["q", "p", "d"]), max_obs=int(g.count() * 0.82))


@register(f"WITH {LONG} SELECT obs_id, count(value) AS n_nonmissing FROM l GROUP BY 1 HAVING count(value) >= 2")
def filter_observations(spark, sf):
    return filters.filter_observations(to_long(_gappy(spark, sf), ["q", "p", "d"]), min_vars=2)


def _timed(mode: str, rule: str, axis: str, at_least: int):
    def query(spark, sf):
        f = filters.filter_features if axis == "var" else filters.filter_observations
        kw = {"min_obs" if axis == "var" else "min_vars": at_least}
        return f(_tensor(spark, sf), time_mode=mode, prop=0.5 if mode == "proportion" else None, time="t", **kw)

    sql = f"""WITH {TENSOR}, k AS (SELECT {axis}, t, count(value) AS n FROM c GROUP BY 1, 2)
      SELECT {axis}, CAST(sum(n) AS BIGINT) AS n_nonmissing FROM k GROUP BY 1 HAVING {rule.format(f"n >= {at_least}")}"""
    return query, sql


for _name, _args in {
    "filter_features_time_all": ("all", "bool_and({})", "var", 1), "filter_features_time_any": ("any", "bool_or({})", "var", 3),
    "filter_observations_time_prop": ("proportion", "avg(CASE WHEN {} THEN 1.0 ELSE 0.0 END) >= 0.5", "obs_id", 1), "filter_observations_time_any": ("any", "bool_or({})", "obs_id", 2),
}.items():
    _query, _sql = _timed(*_args)
    REGISTRY[_name] = (_query, _sql)


@register("SELECT c_custkey, round(greatest(0.0, least(5000.0, CAST(c_acctbal AS DOUBLE))), 6) + 0.0 AS c_acctbal FROM customer")
def clip_values(spark, sf):
    df = _t(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return filters.clip_values(df, ["c_acctbal"], (0.0, 5000.0))


@register("""WITH a AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS v FROM customer), b AS (SELECT v, row_number() OVER (ORDER BY v) AS r, count(*) OVER () AS n FROM a),
k AS (SELECT max(CASE WHEN r = CAST(floor(0.05 * n) AS BIGINT) + 1 THEN v END) AS lo, max(CASE WHEN r = n - CAST(floor(0.05 * n) AS BIGINT) THEN v END) AS hi FROM b)
SELECT c_custkey, round(greatest(lo, least(hi, v)), 6) + 0.0 AS c_acctbal FROM a, k""")
def winsorize(spark, sf):
    df = _t(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return filters.winsorize(df, ["c_acctbal"], (0.05, 0.05))


@register(f"WITH {GAPPY} SELECT obs_id, q IS NULL OR q IN (1, 50) AS q, p IS NULL AS p FROM g")
def missing_mask(spark, sf):
    g = filters.missing_mask(_gappy(spark, sf), ["q"], [1.0, 50.0])
    return filters.missing_mask(g, ["p"]).select("obs_id", "q", "p")


# imputation
@register(f"WITH {GAPPY} SELECT obs_id, {_r('coalesce(q, -1) AS q', 'coalesce(p, 0.5) AS p')} FROM g")
def impute_explicit(spark, sf):
    return impute.explicit(_gappy(spark, sf), ["q", "p"], {"q": -1.0, "default": 0.5}).select("obs_id", "q", "p")


def _simple(strategy: str, sql: str):
    def query(spark, sf):
        return impute.simple(_gappy(spark, sf), ["q", "d"], strategy).select("obs_id", "q", "d")

    return query, f"WITH {GAPPY} SELECT obs_id, round(coalesce(q, ({sql.format('q')})), 6) + 0.0 AS q, round(coalesce(d, ({sql.format('d')})), 6) + 0.0 AS d FROM g"


for _name, _sql in {
    "mean": "SELECT avg({0}) FROM g", "median": "SELECT quantile_cont({0}, 0.5) FROM g",
    "most_frequent": "SELECT {0} FROM g WHERE {0} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1",
}.items():
    _query, _sql = _simple(_name, _sql)
    REGISTRY[f"impute_{_name}"] = (lambda spark, sf, f=_query: _rounded(f(spark, sf)), _sql)


def _locf(fallback: str | None):
    def query(spark, sf):
        return impute.locf(_tensor(spark, sf), ["obs_id"], fallback=fallback)

    extra = {
        "mean": "(SELECT avg(value) FROM c x WHERE x.var = f.var)", "median": "(SELECT quantile_cont(value, 0.5) FROM c x WHERE x.var = f.var)",
        "bfill": "nxt", None: "NULL",
    }[fallback]
    sql = f"""WITH {TENSOR}, f AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY obs_id, var ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prv,
      first_value(value IGNORE NULLS) OVER (PARTITION BY obs_id, var ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM c)
      SELECT obs_id, var, t, round(coalesce(prv, {extra}), 6) + 0.0 AS value FROM f"""
    return query, sql


for _name, _fallback in {"locf_mean": "mean", "locf_median": "median", "locf_bfill": "bfill", "locf_none": None}.items():
    _query, _sql = _locf(_fallback)
    REGISTRY[_name] = (lambda spark, sf, f=_query: _rounded(f(spark, sf)), _sql)


@register()
def impute_knn(spark, sf):
    df = _t(spark, sf, "part").select(
        F.col("p_partkey").cast("long").alias("obs_id"), F.col("p_size").cast("double").alias("a"),
        F.expr("case when p_partkey % 11 = 0 then null else cast(p_retailprice as double) end").alias("price"),
    )
    return impute.knn(df, ["price"], ["a"], k=5)


# normalization
def _norm(f, columns: str, windowed: bool = False, group: bool = False, **kw):
    def query(spark, sf):
        args = {"group": "l_returnflag"} | kw if group else kw
        return f(_gappy(spark, sf), ["q", "p"], **args).select("obs_id", "q", "p")

    part = "PARTITION BY l_returnflag" if group else ""
    cells = ", ".join(f"round({columns.format(x=x, w=f'OVER ({part})')}, 6) + 0.0 AS {x}" for x in "qp")
    return query, f"WITH {GAPPY} SELECT obs_id, {cells} FROM g"


for _name, (_f, _sql, _kw) in {
    "norm_scale": (normalize.scale, "({x} - avg({x}) {w}) / stddev_pop({x}) {w}", {}),
    "norm_scale_grouped": (normalize.scale, "({x} - avg({x}) {w}) / stddev_pop({x}) {w}", {"group": True}),
    "norm_minmax": (normalize.minmax, "({x} - min({x}) {w}) / (max({x}) {w} - min({x}) {w})", {}),
    "norm_minmax_grouped": (normalize.minmax, "({x} - min({x}) {w}) / (max({x}) {w} - min({x}) {w})", {"group": True}),
    "norm_maxabs": (normalize.maxabs, "{x} / max(abs({x})) {w}", {}),
    "norm_robust": (normalize.robust, "({x} - quantile_cont({x}, 0.5) {w}) / (quantile_cont({x}, 0.75) {w} - quantile_cont({x}, 0.25) {w})", {}),
    "norm_robust_grouped": (normalize.robust, "({x} - quantile_cont({x}, 0.5) {w}) / (quantile_cont({x}, 0.75) {w} - quantile_cont({x}, 0.25) {w})", {"group": True}),
    "norm_log": (normalize.log, "ln(1 + {x})", {}),
    "norm_log_base10": (normalize.log, "ln({x} + 0.5) / ln(10)", {"base": 10.0, "offset": 0.5}),
}.items():
    _query, _sql = _norm(_f, _sql, **_kw)
    REGISTRY[_name] = (lambda spark, sf, f=_query: _rounded(f(spark, sf)), _sql)


@register("SELECT c_custkey, round(CAST(c_acctbal AS DOUBLE) + abs((SELECT least(0.0, min(CAST(c_acctbal AS DOUBLE))) FROM customer)), 6) + 0.0 AS c_acctbal FROM customer")
def norm_offset_negative(spark, sf):
    df = _t(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return normalize.offset_negative(df, ["c_acctbal"])


@register("SELECT p_partkey, round(percent_rank() OVER (ORDER BY CAST(p_retailprice AS DOUBLE)), 6) + 0.0 AS price FROM part")
def norm_percent_rank(spark, sf):
    df = _t(spark, sf, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("price"))
    return normalize.percent_rank(df, "price")


@register()
def norm_quantile(spark, sf):
    return normalize.quantile(_gappy(spark, sf), ["p"], 100).select("obs_id", "p")


@register()
def norm_power(spark, sf):
    return normalize.power(_gappy(spark, sf), ["p"]).select("obs_id", "p")


@register(f"WITH {TENSOR} SELECT obs_id, var, t, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) + 0.0 AS value FROM c WINDOW w AS (PARTITION BY var)")
def norm_scale_over_time(spark, sf):
    return normalize.scale(_tensor(spark, sf), ["value"], group="var")


# encoding and sampling
@register("""SELECT CAST((l_returnflag = 'A')::INT AS FLOAT) AS cat_l_returnflag_A, CAST((l_returnflag = 'N')::INT AS FLOAT) AS cat_l_returnflag_N, CAST((l_returnflag = 'R')::INT AS FLOAT) AS cat_l_returnflag_R,
CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS obs_id FROM lineitem""")
def encode_one_hot(spark, sf):
    return encode.one_hot(_gappy(spark, sf).select("l_returnflag", "obs_id"), ["l_returnflag"])


@register("SELECT CAST((SELECT count(DISTINCT x.c_mktsegment) FROM customer x WHERE x.c_mktsegment < y.c_mktsegment) AS FLOAT) AS cat_c_mktsegment, c_custkey FROM customer y")
def encode_label(spark, sf):
    return encode.label_encode(_t(spark, sf, "customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"])


@register("SELECT o_orderstatus, (SELECT min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)) AS n FROM orders GROUP BY 1")
def balanced_under(spark, sf):
    return encode.balanced(_t(spark, sf, "orders"), "o_orderstatus").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT o_orderstatus, (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)) AS n FROM orders GROUP BY 1")
def balanced_over(spark, sf):
    return encode.balanced(_t(spark, sf, "orders"), "o_orderstatus", over=True).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT CAST(100 AS BIGINT) AS n")
def sample_exact(spark, sf):
    return encode.sample(_t(spark, sf, "orders"), n=100).agg(F.count(F.lit(1)).alias("n"))


# association, bias, missingness
@register(f"WITH {GAPPY} SELECT 'q' AS a, 'p' AS b, round(corr(q, p), 6) AS corr FROM g UNION ALL SELECT 'q', 'd', round(corr(q, d), 6) FROM g UNION ALL SELECT 'p', 'd', round(corr(p, d), 6) FROM g")
def corr_pearson(spark, sf):
    return association.correlations(_gappy(spark, sf), ["q", "p", "d"]).select("a", "b", "corr")


@register(f"""WITH {GAPPY}, b AS (SELECT q, p FROM g WHERE q IS NOT NULL AND p IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2 AS rq,
rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rp FROM b) SELECT 'q' AS a, 'p' AS b, round(corr(rq, rp), 6) AS corr FROM r""")
def corr_spearman(spark, sf):
    return association.correlations(_gappy(spark, sf), ["q", "p"], "spearman").select("a", "b", "corr")


@register()
def corr_kendall(spark, sf):
    return association.correlations(_gappy(spark, sf), ["q", "d"], "kendall")


@register(f"""WITH {LONG}, k AS (SELECT l_returnflag AS value, var, l.value AS x FROM l),
v AS (SELECT DISTINCT value FROM k), m AS (SELECT v.value, k.var, avg(CASE WHEN k.value = v.value THEN x END) AS a, var_samp(CASE WHEN k.value = v.value THEN x END) AS va,
avg(CASE WHEN k.value <> v.value THEN x END) AS b, var_samp(CASE WHEN k.value <> v.value THEN x END) AS vb FROM v, k GROUP BY 1, 2) SELECT value, var, round((a - b) / sqrt((va + vb) / 2), 6) + 0.0 AS smd FROM m""")
def bias_smd(spark, sf):
    return association.standardized_differences(_gappy(spark, sf), "l_returnflag", ["q", "p", "d"])


@register("""WITH a AS (SELECT l_returnflag AS value, l_linestatus AS category, count(*) AS k FROM lineitem GROUP BY 1, 2), f AS (SELECT v.value, c.category, coalesce(a.k, 0) AS k
FROM (SELECT DISTINCT value FROM a) v CROSS JOIN (SELECT DISTINCT category FROM a) c LEFT JOIN a ON a.value = v.value AND a.category = c.category),
s AS (SELECT *, sum(k) OVER (PARTITION BY value) AS n, sum(k) OVER (PARTITION BY category) - k AS ok, sum(k) OVER () - sum(k) OVER (PARTITION BY value) AS onn FROM f)
SELECT value, category, round(k / n, 6) AS share, round(k / n / nullif(ok / nullif(onn, 0), 0), 6) AS ratio FROM s""")
def bias_shares(spark, sf):
    return association.category_shares(_t(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@register(f"""WITH {GAPPY}, a AS (SELECT avg(p) FILTER (q IS NULL) AS m1, var_samp(p) FILTER (q IS NULL) / count(p) FILTER (q IS NULL) AS a, count(p) FILTER (q IS NULL) AS n1,
avg(p) FILTER (q IS NOT NULL) AS m2, var_samp(p) FILTER (q IS NOT NULL) / count(p) FILTER (q IS NOT NULL) AS b, count(p) FILTER (q IS NOT NULL) AS n2 FROM g)
SELECT 'q' AS missing, 'p' AS var, round((m1 - m2) / sqrt(a + b), 6) + 0.0 AS t, round((a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)), 4) AS df FROM a""")
def mcar_t_test(spark, sf):
    return association.mcar_t_tests(_gappy(spark, sf), ["q", "p"]).where("missing = 'q'").select("missing", "var", "t", F.round("df", 4).alias("df"))


@register()
def mcar_little(spark, sf):
    return spark.createDataFrame([association.little_test(_gappy(spark, sf), ["q", "p", "d"])], "statistic double, df double, p double")


# ranking, tables, cohorts
@register("""WITH v AS (SELECT DISTINCT l_returnflag AS grp FROM lineitem), m AS (SELECT grp, count(*) FILTER (l_returnflag = grp) AS n, avg(CAST(l_quantity AS DOUBLE)) FILTER (l_returnflag = grp) AS a,
var_samp(CAST(l_quantity AS DOUBLE)) FILTER (l_returnflag = grp) AS va, count(*) FILTER (l_returnflag <> grp) AS rn, avg(CAST(l_quantity AS DOUBLE)) FILTER (l_returnflag <> grp) AS b,
var_samp(CAST(l_quantity AS DOUBLE)) FILTER (l_returnflag <> grp) AS vb FROM v, lineitem GROUP BY grp)
SELECT grp AS "group", 'l_quantity' AS var, round((a - b) / sqrt(va / n + vb / rn), 5) + 0.0 AS t, n FROM m""", places=5)
def rank_t_test(spark, sf):
    return ranking.welch(ranking.group_moments(_t(spark, sf, "lineitem"), "l_returnflag", ["l_quantity"])).select("group", "var", "t", "n")


@register("""WITH r AS (SELECT l_returnflag AS grp, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rk, count(*) OVER () AS n FROM lineitem),
k AS (SELECT grp, count(*) AS n1, sum(rk) AS s, max(n) AS n FROM r GROUP BY 1)
SELECT grp AS "group", n1 AS n, round(s, 6) AS rank_sum, round((s - n1 * (n + 1) / 2) / sqrt(n1 * (n - n1) * (n + 1) / 12.0), 6) + 0.0 AS z FROM k""")
def rank_wilcoxon(spark, sf):
    return ranking.wilcoxon(_t(spark, sf, "lineitem"), "l_returnflag", "l_quantity").select("group", F.col("n").cast("long").alias("n"), "rank_sum", "z")


@register("SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2")
def contingency(spark, sf):
    return ranking.contingency(_t(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@register()
def rank_features(spark, sf):
    return ranking.rank_features(_t(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_discount"], ["l_linestatus", "l_shipmode"] if "l_shipmode" in _t(spark, sf, "lineitem").columns else ["l_linestatus"])


@register("""WITH p AS (SELECT c_custkey, c_mktsegment AS g, (c_custkey * 7919 % 1000 + 1) / 1000 AS p FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, c_custkey) AS r, count(*) OVER (PARTITION BY g) AS m FROM p)
SELECT c_custkey, g, round(least(1.0, min(p * m / r) OVER (PARTITION BY g ORDER BY r DESC)), 6) AS p_adj FROM r""")
def adjust_bh(spark, sf):
    df = _t(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("g"), ((F.col("c_custkey") * 7919 % 1000 + 1) / 1000).alias("p"))
    return stats.benjamini_hochberg(df, "p", "g").select("c_custkey", "g", "p_adj")


@register()
def feature_importances(spark, sf):
    return ranking.importances(_t(spark, sf, "lineitem").select(*(F.col(c).cast("double").alias(c) for c in NUMBERS)), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], "regression")


@register("""WITH a AS (SELECT c_mktsegment AS grp, CAST(c_acctbal AS DOUBLE) AS x, c_nationkey % 3 AS k FROM customer)
SELECT grp AS "group", 'bal' AS var, CAST(NULL AS VARCHAR) AS level, count(x) AS n, round(avg(x), 6) AS value, round(stddev_samp(x), 6) AS spread_low, CAST(NULL AS DOUBLE) AS spread_high FROM a GROUP BY 1
UNION ALL SELECT grp, 'med', NULL, count(x), round(quantile_cont(x, 0.5), 6), round(quantile_cont(x, 0.25), 6), round(quantile_cont(x, 0.75), 6) FROM a GROUP BY 1
UNION ALL SELECT grp, 'k', CAST(k AS VARCHAR), n, round(n / sum(n) OVER (PARTITION BY grp), 6), NULL, NULL FROM (SELECT grp, k, count(*) AS n FROM a GROUP BY 1, 2)""")
def table_one(spark, sf):
    df = _t(spark, sf, "customer").select("c_mktsegment", F.col("c_acctbal").cast("double").alias("bal"), F.col("c_acctbal").cast("double").alias("med"), (F.col("c_nationkey") % 3).alias("k"))
    return ranking.table_one(df, "c_mktsegment", ["bal", "med"], ["k"], ["med"])


@register()
def cohort_steps(spark, sf):
    df = _t(spark, sf, "customer").select(F.col("c_acctbal").cast("double").alias("bal"), "c_mktsegment")
    tracker = ranking.CohortTracker(df, ["bal"], ["c_mktsegment"])
    tracker(df, "all")
    tracker(df.where("bal >= 0"), "solvent", "filter")
    return tracker.tracked_tables(spark)


# survival and regression
@register(f"WITH {RISK} SELECT time, observed, at_risk, round(product(1 - observed / at_risk) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS survival FROM r")
def kaplan_meier(spark, sf):
    return survival.kaplan_meier(_survival(spark, sf), "duration", "event").select("time", "observed", "at_risk", "survival")


@register(f"WITH {RISK} SELECT time, censored, round(sum(observed / at_risk) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS hazard FROM r")
def nelson_aalen(spark, sf):
    return survival.nelson_aalen(_survival(spark, sf), "duration", "event", smooth=False).select("time", "censored", "hazard")


@register(f"""WITH {SURVIVAL}, b AS (SELECT duration AS t, sum(event) AS d, count(*) AS m, sum(event) FILTER (arm = 'F') AS d1, count(*) FILTER (arm = 'F') AS m1 FROM s GROUP BY 1),
r AS (SELECT *, sum(m) OVER (ORDER BY t DESC) AS n, sum(m1) OVER (ORDER BY t DESC) AS n1 FROM b),
k AS (SELECT sum(coalesce(d1, 0) - d * n1 / n) AS u, sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM r WHERE d > 0) SELECT round(u * u / v, 4) AS chi2 FROM k""", places=4)
def logrank(spark, sf):
    return spark.createDataFrame([(float(survival.logrank(_survival(spark, sf), "duration", "event", "arm", "F")[0]),)], "chi2 double")


@register("SELECT 'intercept' AS term, round(regr_intercept(CAST(l_extendedprice AS DOUBLE), CAST(l_quantity AS DOUBLE)), 3) AS coef FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(CAST(l_extendedprice AS DOUBLE), CAST(l_quantity AS DOUBLE)), 3) FROM lineitem", places=3)
def ols(spark, sf):
    return survival.ols(_t(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"]).select("term", "coef")


@register()
def glm_gaussian(spark, sf):
    m = survival.glm(_t(spark, sf, "lineitem").select(F.col("l_extendedprice").cast("double").alias("y"), F.col("l_quantity").cast("double").alias("x")).where("y > 0"), "y", ["x"], "gaussian")
    return spark.createDataFrame([("intercept", float(m.intercept)), ("x", float(m.coefficients[0]))], "term string, coef double")


@register()
def cox(spark, sf):
    return survival.cox(_survival(spark, sf), "duration", "event", ["l_quantity", "l_discount"])


@register()
def weibull(spark, sf):
    return spark.createDataFrame([survival.weibull(_survival(spark, sf), "duration", "event")], "lambda double, rho double")


@register()
def weibull_aft(spark, sf):
    m = survival.aft(_survival(spark, sf), "duration", "event", ["l_quantity"])
    return spark.createDataFrame([("intercept", float(m.intercept)), ("l_quantity", float(m.coefficients[0])), ("scale", float(m.scale))], "term string, coef double")


# causal
def _treated(spark, sf) -> DataFrame:
    return _t(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("obs_id"), (F.col("l_linestatus") == "F").cast("int").alias("t"),
        F.col("l_extendedprice").cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")),
    )


_ARMS = ", ".join(f"avg(CAST({c} AS DOUBLE)) FILTER (l_linestatus = '{s}') AS {c}{s}m, var_samp(CAST({c} AS DOUBLE)) FILTER (l_linestatus = '{s}') AS {c}{s}v" for c in ("l_quantity", "l_discount") for s in ("F", "O"))


@register(f"WITH a AS (SELECT {_ARMS} FROM lineitem) " + " UNION ALL ".join(f"SELECT '{c}' AS covariate, round(({c}Fm - {c}Om) / sqrt(({c}Fv + {c}Ov) / 2), 6) + 0.0 AS smd, round({c}Fv / {c}Ov, 6) AS variance_ratio FROM a" for c in ("l_quantity", "l_discount")))
def covariate_balance(spark, sf):
    return causal.balance(_treated(spark, sf), "t", ["l_quantity", "l_discount"])


def _effect(spark, e) -> DataFrame:
    return spark.createDataFrame([(e.method, float(e.value), e.se, e.low, e.high, int(e.n))], "method string, value double, se double, low double, high double, n long")


def _design(spark, sf) -> DataFrame:
    return causal.design(_treated(spark, sf), "t", ["l_quantity", "l_discount", "l_tax"], "y")


@register()
def causal_iptw(spark, sf):
    return _effect(spark, causal.iptw(_design(spark, sf), n_bootstrap=20, refit=False))


@register()
def causal_g_computation(spark, sf):
    return _effect(spark, causal.g_computation(_design(spark, sf)))


@register()
def causal_aipw(spark, sf):
    return _effect(spark, causal.aipw(_design(spark, sf)))


@register()
def causal_t_learner(spark, sf):
    return causal.t_learner(_design(spark, sf)).agg(F.avg("cate").alias("cate"))


@register()
def causal_s_learner(spark, sf):
    return causal.s_learner(_design(spark, sf)).agg(F.avg("cate").alias("cate"))


@register()
def causal_x_learner(spark, sf):
    return causal.x_learner(_design(spark, sf)).agg(F.avg("cate").alias("cate"))


@register()
def causal_positivity(spark, sf):
    return causal.positivity(_design(spark, sf))


# decomposition, graphs, series
@register()
def pca(spark, sf):
    v = _t(spark, sf, "embeddings")
    width = v.agg(F.max(F.size("embedding"))).first()[0] or 0
    df = v.select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(width)))
    return embedding.pca(df, [f"e{i}" for i in range(width)], 2, "vec_id")[0]


@register()
def famd(spark, sf):
    return embedding.famd(_gappy(spark, sf), ["q", "p", "d"], ["l_returnflag"])


@register("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.vec_id AS query, b.vec_id AS neighbor, round(1 - list_cosine_similarity(a.v, b.v), 6) AS distance,
row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(a.v, b.v), b.vec_id) AS r FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT query, neighbor, distance + 0.0 AS distance FROM d WHERE r <= 10""")
def neighbors(spark, sf):
    v = _t(spark, sf, "embeddings")
    return embedding.nearest(v, v.where("vec_id % 50 = 0"), 10)


@register()
def neighbor_groups(spark, sf):
    v = _t(spark, sf, "embeddings")
    edges = embedding.nearest_all(v, 10).select(F.col("query").alias("i"), F.col("neighbor").alias("j"), (1 - F.col("distance")).alias("weight"))
    return embedding.group_graph(edges, v.select(F.col("vec_id").alias("id"), "label"))


@register()
def dtw_distances(spark, sf):
    long = _tensor(spark, sf)
    return embedding.series_distances(long, long.where("obs_id % 50 = 0"))


@register("SELECT obs_id, round(y - (SELECT regr_intercept(y, x) FROM k) - (SELECT regr_slope(y, x) FROM k) * x, 4) + 0.0 AS y FROM (SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS obs_id, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS x FROM lineitem) z, (SELECT 1) o".replace("FROM k", "FROM (SELECT CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS x FROM lineitem)"), places=4)
def regress_out(spark, sf):
    return embedding.regress_out(_treated(spark, sf), ["y"], "l_quantity").select("obs_id", "y")


# plot data
@register("SELECT 0 AS step, o_orderstatus AS source, o_orderpriority AS target, count(*) AS n FROM orders GROUP BY ALL")
def sankey(spark, sf):
    return filters.flows(_t(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@register("""WITH a AS (SELECT user_id, event_type AS state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_state FROM events)
SELECT state, next_state, count(*) AS n FROM a WHERE next_state IS NOT NULL GROUP BY 1, 2""")
def sankey_time(spark, sf):
    e = _t(spark, sf, "events")
    order = F.struct("ts", "event_id")
    return filters.transitions(e.select("user_id", order.alias("t"), "event_type"), ["user_id"], "t", "event_type")


@register(f"WITH {LONG} SELECT var, count(value) AS present FROM l GROUP BY 1")
def missing_bars(spark, sf):
    return plotdata.presence_counts(_gappy(spark, sf), ["q", "p", "d"])


@register(f"WITH {GAPPY}, n AS (SELECT (q IS NULL)::INT AS q, (p IS NULL)::INT AS p FROM g) SELECT 'q' AS a, 'p' AS b, round(corr(q, p), 6) + 0.0 AS corr FROM n")
def missing_heatmap(spark, sf):
    return plotdata.nullity_correlation(_gappy(spark, sf), ["q", "p"])


@register(f"WITH {LONG} SELECT l_returnflag AS \"group\", var, round(avg(l.value), 6) AS mean, round(avg(CASE WHEN l.value > 10 THEN 1.0 WHEN l.value IS NOT NULL THEN 0.0 END), 6) AS fraction FROM l GROUP BY 1, 2")
def dotplot(spark, sf):
    return plotdata.group_means(_gappy(spark, sf), "l_returnflag", ["q", "p", "d"], 10.0)


@register("SELECT l_returnflag AS \"group\", round(min(x), 6) AS low, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS high FROM (SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem) GROUP BY 1")
def violin(spark, sf):
    return plotdata.group_quantiles(_t(spark, sf, "lineitem").withColumn("x", F.col("l_extendedprice").cast("double")), "l_returnflag", "x")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _extend()
    return {name: f for name, (f, _) in REGISTRY.items()}


def _extend() -> None:
    """The rest of the catalogue adds itself to the registry."""
    from longview.plans import extended

    assert extended.register is register


def oracle_sql() -> dict[str, str]:
    _extend()
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}


