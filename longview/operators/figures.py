"""Tables that figures draw: categories, missingness, series, balance, heat maps and ranked features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longview.functions.order import quantile_table


def _text(name: str, alias: str) -> Column:
    return F.col(f"`{name}`").cast("string").alias(alias)


def category_plot(df: DataFrame, x: str, y: str | None = None, hue: str | None = None) -> DataFrame:
    """(x, hue, n, mean, sd): what bars, points and counts of a categorical plot show; groups without a category are left out."""
    value = F.col(y).cast("double") if y else F.lit(None).cast("double")
    h = _text(hue, "hue") if hue else F.lit(None).cast("string").alias("hue")
    rows = df.where(F.col(x).isNotNull()).select(_text(x, "x"), h, value.alias("y"))
    return rows.groupBy("x", "hue").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"))


def missing_matrix(df: DataFrame, columns: list[str], key: str = "obs_id", keep: str | None = None, most_columns: int = 0, share: float = 0.0) -> DataFrame:
    """One row an observation: whether each column is present, and ``completeness``, how many are.

    ``keep`` ("top" or "bottom") picks columns by how complete they are: those with at least (at most) ``share``, and
    of these the ``most_columns`` most (least) complete.
    """
    if keep:
        row = df.agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns)).first()
        good = [c for c in columns if not share or (row[c] >= share if keep == "top" else row[c] <= share)]
        order = sorted(good, key=lambda c: -row[c] if keep == "top" else row[c])[: most_columns or None]
        columns = [c for c in columns if c in order]
    there = [F.col(c).isNotNull() for c in columns]
    return df.select(key, *(t.alias(c) for t, c in zip(there, columns, strict=True)), sum((t.cast("int") for t in there), F.lit(0)).alias("completeness"))


def collapse_time(long: DataFrame, how: str = "mean", keys: tuple[str, ...] = ("obs_id",)) -> DataFrame:
    """(keys, var, value): a series as its mean, or its first or last value, gaps left out; all gaps give none."""
    there = F.col("value").isNotNull()
    value = {"mean": F.avg("value"), "first": F.min_by("value", F.when(there, F.col("t"))), "last": F.max_by("value", F.when(there, F.col("t")))}[how]
    return long.groupBy(*keys, "var").agg(value.alias("value"))


def timeseries(long: DataFrame, variables: list[str] | None = None, observations: list | None = None, overlay: str | None = None) -> DataFrame:
    """(obs_id, var, t, value) of the chosen labels, or with ``overlay`` (a column of the table) the mean by group and time."""
    rows = long
    if variables is not None:
        rows = rows.where(F.col("var").isin(variables))
    if observations is not None:
        rows = rows.where(F.col("obs_id").isin(observations))
    if overlay is None:
        return rows.select("obs_id", "var", "t", "value")
    return rows.groupBy(_text(overlay, "group"), "var", "t").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def love_plot(df: DataFrame, treatment: str, covariates: list[str], weight: Column, threshold: float = 0.1) -> DataFrame:
    """(place, covariate, smd_before, smd_after, balanced) by rising absolute difference before weighting."""
    from longview.operators import causal

    before = causal.balance(df, treatment, covariates).select("covariate", F.col("smd").alias("smd_before"))
    after = causal.balance(df, treatment, covariates, weight).select("covariate", F.col("smd").alias("smd_after"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.abs("smd_before"), "covariate")  # one row a covariate
    return before.join(after, "covariate").select(F.row_number().over(w).alias("place"), "covariate", "smd_before", "smd_after", (F.abs("smd_after") < threshold).alias("balanced"))


def fitted_line(df: DataFrame, x: str, y: str, key: str = "obs_id") -> DataFrame:
    """(key, x, y, fitted, residual) of the least-squares line, from one aggregation."""
    line = df.agg(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")), F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double"))).first()
    fitted = F.lit(line[1]) + F.lit(line[0]) * F.col(x).cast("double")
    return df.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), fitted.alias("fitted"), (F.col(y).cast("double") - fitted).alias("residual"))


def heatmap(df: DataFrame, group: str, columns: list[str], key: str = "obs_id", scale: bool = True) -> DataFrame:
    """(group, obs_id, var, value): cells of a heat map, scaled to [0, 1] within a variable if asked."""
    from longview.frame import to_long
    from longview.operators import normalize

    wide = df.select(_text(group, "group"), F.col(key).alias("obs_id"), *(F.col(c).cast("double").alias(c) for c in columns))
    wide = normalize.minmax(wide, columns) if scale else wide
    return to_long(wide.where("group is not null"), columns, ("group", "obs_id"))


def tracks(df: DataFrame, group: str, columns: list[str], key: str = "obs_id") -> DataFrame:
    """(group, place, obs_id, var, value): each variable along observations in the order of their groups.

    ``place`` counts within a group; groups follow each other by name.
    """
    from longview.frame import to_long

    wide = df.where(F.col(group).isNotNull()).select(_text(group, "group"), F.col(key).alias("obs_id"), *(F.col(c).cast("double").alias(c) for c in columns))
    ranked = wide.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy("obs_id", *columns)))
    return to_long(ranked, columns, ("group", "place", "obs_id"))


def matrix(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, var, mean, scaled): group means, and scaled to [0, 1] between groups."""
    from longview.operators import plotdata

    w = Window.partitionBy("var")
    means = plotdata.group_means(df, group, columns).select("group", "var", "mean")
    low, high = F.min("mean").over(w), F.max("mean").over(w)
    return means.select("group", "var", "mean", ((F.col("mean") - low) / F.when(high == low, 1.0).otherwise(high - low)).alias("scaled"))


def stacked_quantiles(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, var, q1, median, q3): stacked violins."""
    long = df.where(F.col(group).isNotNull()).select(_text(group, "group"), *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(["group"], columns, "var", "v")
    return quantile_table(long, ["v"], [0.25, 0.5, 0.75], ["group", "var"]).withColumnRenamed("v", "q").select("group", "var", *(F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))))


def top_by(df: DataFrame, score: str, n: int, group: str | None = None, absolute: bool = False) -> DataFrame:
    """``df``'s ``n`` rows of greatest ``score`` (in each ``group``), numbered from one in ``place``; ties by the other columns."""
    by = F.abs(F.col(score)) if absolute else F.col(score)
    rest = [c for c in df.columns if c not in (score, group)]
    if group is None:
        top = df.orderBy(by.desc(), *rest).limit(n)
        return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(by.desc(), *rest)))  # n rows
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(by.desc(), *rest))).where(F.col("place") <= n)


def ranked_variables(df: DataFrame, group: str, columns: list[str], n: int) -> DataFrame:
    """(group, var, t, place): the variables that set each group apart most, by Welch's t."""
    from longview.operators import ranking

    return top_by(ranking.welch(ranking.group_moments(df, group, columns)).select("group", "var", "t"), "t", n, "group")


def ranked_matrix(df: DataFrame, group: str, columns: list[str], n: int, cutoff: float = 0.0) -> DataFrame:
    """(ranked_in, place, var, group, mean, fraction): every group's mean of the top variables of each group."""
    from longview.operators import plotdata

    top = ranked_variables(df, group, columns, n).select(F.col("group").alias("ranked_in"), "place", "var")
    return top.join(plotdata.group_means(df, group, columns, cutoff), "var").select("ranked_in", "place", "var", "group", "mean", "fraction")


def ranked_violins(df: DataFrame, group: str, columns: list[str], n: int) -> DataFrame:
    """(ranked_in, place, var, group, q1, median, q3): quartiles of the top variables of each group."""
    top = ranked_variables(df, group, columns, n).select(F.col("group").alias("ranked_in"), "place", "var")
    return top.join(stacked_quantiles(df, group, columns), "var").select("ranked_in", "place", "var", "group", "q1", "median", "q3")


def ranked_heatmap(df: DataFrame, group: str, columns: list[str], n: int, key: str = "obs_id") -> DataFrame:
    """(ranked_in, var, group, obs_id, value): scaled cells of each group's own observations for its top variables."""
    top = ranked_variables(df, group, columns, n).select(F.col("group").alias("ranked_in"), "var")
    cells = heatmap(df, group, columns, key)
    return cells.join(F.broadcast(top), (cells["var"] == top["var"]) & (cells["group"] == top["ranked_in"])).select("ranked_in", cells["var"], "group", "obs_id", "value")  # n rows a group


def ranked_tracks(df: DataFrame, group: str, columns: list[str], n: int, key: str = "obs_id") -> DataFrame:
    """(ranked_in, var, group, place, obs_id, value): tracks of the top variables of any group."""
    top = ranked_variables(df, group, columns, n).select(F.col("group").alias("ranked_in"), "var")
    return tracks(df, group, columns, key).join(F.broadcast(top), "var").select("ranked_in", "var", "group", "place", "obs_id", "value")  # n rows a group


def scatter(df: DataFrame, x: str, y: str, color: str | None = None, key: str = "obs_id") -> DataFrame:
    """(obs_id, x, y, color): points that have both coordinates; embeddings of any kind are drawn so."""
    c = _text(color, "color") if color else F.lit(None).cast("string").alias("color")
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("obs_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), c)


def dependencies(correlations: DataFrame, threshold: float = 0.3, only_significant: bool = True) -> DataFrame:
    """(a, b, strength, sign): the chords of a dependency plot, from :func:`longview.operators.association.correlations`."""
    rows = correlations.where(F.abs("corr") >= threshold)
    rows = rows.where("significant") if only_significant else rows
    return rows.select("a", "b", F.abs("corr").alias("strength"), F.signum("corr").cast("int").alias("sign"))


def share_histogram(df: DataFrame, column: str, group: str, bins: int = 20, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(group, bin, n, share): overlaid histograms, each group's shares adding to one; values outside are left out."""
    at = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / ((high - low) / bins))).cast("int")
    counts = df.where(F.col(column).between(low, high)).groupBy(_text(group, "group"), at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("group")))


def survival_bands(df: DataFrame, duration: str, event: str, alpha: float = 0.05, group: str | None = None) -> DataFrame:
    """(group,) time, observed, at_risk, survival, low, high: Kaplan-Meier curves with log(-log) intervals."""
    from longview.functions import stats
    from longview.operators import survival

    z = stats.normal_quantile(df.sparkSession, 1 - alpha / 2)
    curve = survival.kaplan_meier(df, duration, event, group)
    s = F.col("survival")
    width = z * F.sqrt(F.col("variance")) / (s * F.abs(F.log(s)))
    inside = (s > 0) & (s < 1)
    bound = lambda sign: F.when(inside, F.pow(s, F.exp(sign * width))).otherwise(s)
    return curve.select(*([group] if group else []), "time", "observed", "at_risk", "survival", bound(1).alias("low"), bound(-1).alias("high"))


def pseudotime_order(times: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, place, id, pseudotime): observations of each group by pseudotime."""
    w = Window.partitionBy("label").orderBy("pseudotime", "id")
    return times.join(labels.select("id", F.col("label").cast("string").alias("label")), "id").select("label", F.row_number().over(w).alias("place"), "id", "pseudotime")


def path_means(values: DataFrame, times: DataFrame, labels: DataFrame, path: list, columns: list[str], bins: int = 10) -> DataFrame:
    """(label, step, bin, var, mean): means of variables along pseudotime through the groups of ``path``, in its order."""
    from longview.frame import to_long

    steps = F.create_map(*(F.lit(v) for i, k in enumerate(path) for v in (str(k), i)))
    rows = values.join(times, "id").join(labels.select("id", F.col("label").cast("string").alias("label")), "id").where(F.col("label").isin([str(k) for k in path]))
    at = F.least(F.lit(bins - 1), F.floor(F.col("pseudotime") * bins)).cast("int")
    long = to_long(rows.withColumn("bin", at), columns, ("label", "bin"))
    return long.groupBy("label", "bin", "var").agg(F.avg("value").alias("mean")).select("label", F.element_at(steps, F.col("label")).alias("step"), "bin", "var", "mean")
