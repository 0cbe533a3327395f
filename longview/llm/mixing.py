"""Soft-membership mixing: document rates whose expected domain totals meet target weights."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longview.llm.common import Scratch, cut, unused

#: Characters whose share of a text is a feature: those that tell the domains apart best.
MARKS = 12


def learned_marks(marked: DataFrame, texts: int, seed: int = 23) -> list[str]:
    """The ``MARKS`` characters whose share of a text differs most between domains, for its spread inside them.

    ``marked`` has (id, text, domain); about ``texts`` rows are drawn by a hash of the id. Their characters are
    counted on the executors, and ``MARKS`` characters reach the driver.
    """
    n = marked.count()
    drawn = marked.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < min(1.0, texts / max(1, n)) * (1 << 20))
    sizes = {r["domain"]: r["n"] for r in drawn.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return []
    size = F.greatest(F.octet_length("text"), F.lit(1))
    each = drawn.select("domain", F.xxhash64("id", "text").alias("row"), size.alias("size"), F.explode(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))).alias("mark"))
    share = each.groupBy("domain", "row", "size", "mark").agg(F.count(F.lit(1)).alias("k")).select("domain", "mark", F.log1p(F.col("k") * 1000.0 / F.col("size")).alias("s"))
    sums = share.groupBy("mark").pivot("domain", list(sizes)).agg(F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s")).alias("q"))
    total, at = sum(sizes.values()), lambda d, k: F.coalesce(F.col(f"`{d}_{k}`"), F.lit(0.0))
    mean = sum((at(d, "s") for d in sizes), F.lit(0.0)) / total
    between = sum((n * (at(d, "s") / n - mean) * (at(d, "s") / n - mean) for d, n in sizes.items()), F.lit(0.0))
    within = sum((at(d, "q") - at(d, "s") * at(d, "s") / n for d, n in sizes.items()), F.lit(0.0))
    best = sums.select("mark", (between / (within + 0.01 * total)).alias("f")).orderBy(F.desc("f"), "mark").limit(MARKS)
    return sorted(r["mark"] for r in best.collect())


def features(text: Column, marks: list[str]) -> Column:
    """array<double>: shares of ``marks``, of multi-byte characters and of repeated lines, word length, length."""
    size = F.octet_length(text)
    per = F.greatest(size, F.lit(1))

    def share(part: Column) -> Column:
        return F.log1p(part * 1000.0 / per)

    marks = [share(size - F.octet_length(F.replace(text, F.lit(m), F.lit("")))) for m in marks]
    lines = F.split(text, "\n")
    repeated = 1 - F.size(F.array_distinct(lines)) / F.size(lines)
    words = size - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
    return F.array(*marks, share(size - F.length(text)), repeated.cast("double"), share(words), F.log1p(size.cast("double")))


@dataclass
class Classifier:
    """Gaussian naive Bayes over :func:`features`: a mean, a variance and a log prior per domain."""

    domains: list[str]
    mean: np.ndarray
    variance: np.ndarray
    prior: np.ndarray

    def posteriors(self, x: Column) -> Column:
        """array<double> of P(domain), in the order of ``domains``; equal if nothing was learned."""
        if not len(self.mean):
            return F.array(*(F.lit(1.0 / len(self.domains)) for _ in self.domains))
        scores, width = [], self.mean.shape[1]
        for m, v, p in zip(self.mean, self.variance, self.prior, strict=True):
            offset = float(p - 0.5 * np.log(v).sum())
            terms = [(x[k] - float(m[k])) * (x[k] - float(m[k])) / (2 * float(v[k])) for k in range(width)]
            total = F.lit(offset)
            for t in terms:
                total = total - t
            scores.append(total)
        top = F.greatest(*scores) if len(scores) > 1 else scores[0]
        odds = F.transform(F.array(*scores), lambda s: F.exp(s - top))
        return F.transform(odds, lambda e: e / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b))


def train(described: DataFrame, domains: list[str], width: int, least: int = 5) -> Classifier:
    """Fit on every labelled row of ``described(x, domain)``: one pre-aggregated pass over sums and squares of ``width`` features."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    for k in range(width):
        aggregates += [F.sum(F.col("x")[k]).alias(f"s{k}"), F.sum(F.col("x")[k] * F.col("x")[k]).alias(f"q{k}")]
    rows = {r["domain"]: r for r in described.where(F.col("domain").isin(domains)).groupBy("domain").agg(*aggregates).collect()}
    rows = {d: r for d, r in rows.items() if r["n"] >= least}
    if not rows:
        return Classifier(domains, np.empty((0, width)), np.empty((0, width)), np.empty(0))
    total = sum(r["n"] for r in rows.values())
    mean, variance, prior = [], [], []
    for d in domains:
        if d in rows:
            r = rows[d]
            m = np.array([r[f"s{k}"] / r["n"] for k in range(width)])
            mean.append(m)
            variance.append(np.maximum(np.array([r[f"q{k}"] / r["n"] for k in range(width)]) - m * m, 0.02))
            prior.append(np.log(r["n"] / total))
        else:  # never seen: no mass
            mean.append(np.zeros(width))
            variance.append(np.ones(width))
            prior.append(-1e6)
    return Classifier(domains, np.array(mean), np.array(variance), np.array(prior))


def _rate(p: Column, steps: list[np.ndarray], momentum: list[float], most: float) -> Column:
    """A document's rate after the given gradient steps (accelerated), clipped to [0, most] at each."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(
        *(F.struct(F.array(*(F.lit(float(v)) for v in g)).alias("g"), F.lit(float(b)).alias("b")) for g, b in zip(steps, momentum, strict=True))
    )

    def step(state: Column, move: Column) -> Column:
        dot = F.aggregate(F.zip_with(p, move["g"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        r = F.least(F.lit(most), F.greatest(F.lit(0.0), state["y"] - dot))
        return F.struct(r.alias("r"), (r + move["b"] * (r - state["r"])).alias("y"))

    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    return F.aggregate(moves, start, step)


def fit_rates(table: DataFrame, weights: list[float], most: float, tolerance: float = 1e-3, rounds: int = 60):
    """Projected-gradient least squares for the rates of ``table(n, p)``: (rate column, shares reached).

    With s(r) = sum(r n p) / sum(n), |s(r) - w|^2 falls along p_i (s - w) for document i, in the metric of
    its tokens; rates are clipped after each step. A round is one pass that sums as many numbers as there are
    domains; a rate is an expression of the steps so far, so no table is rewritten between rounds. Rounds end
    when every share is within ``tolerance`` of its target, when they stop coming closer (the target is out of
    reach within the bounds), or after ``rounds``; the shares reached say which.
    """
    k, w = len(weights), np.array(weights)
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if not total:
        return F.lit(1.0), np.zeros(k)
    gram = table.agg(*(F.sum(F.col("n") * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(k))).first()
    g = np.array([[gram[f"g{i}_{j}"] for j in range(k)] for i in range(k)]) / total
    size = 1.0 / max(1e-9, float(np.linalg.eigvalsh(g).max()))
    steps, momentum, t, reached, before = [], [], 1.0, w, None
    for _ in range(rounds):
        state = _rate(F.col("p"), steps, momentum, most) if steps else F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
        sums = (
            table.withColumn("_s", state)
            .agg(*(F.sum(F.col(f"_s.{c}") * F.col("n") * F.col("p")[i]).alias(f"{c}{i}") for c in "ry" for i in range(k)))
            .first()
        )
        reached = np.array([sums[f"r{i}"] for i in range(k)]) / total
        off = float(np.abs(reached - w).max())
        if off <= tolerance or (before is not None and abs(before - off) < 1e-9 and len(steps) > 10):
            break
        before = off
        at_y = np.array([sums[f"y{i}"] for i in range(k)]) / total
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        steps.append(size * (at_y - w))
        momentum.append((t - 1) / later)
        t = later
    rate = _rate(F.col("p"), steps, momentum, most)["r"] if steps else F.lit(1.0)
    return rate, reached


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    most: float = 3.0,
    budget: float = 1.0,
    texts_for_marks: int = 1000,
) -> DataFrame:
    """(id, h, n_tokens, posteriors, rate, copies, off_target) of every row.

    ``targets`` gives each domain (a value of ``label_col`` as text) its weight; weights are normalised. A
    naive Bayes classifier fitted on all labelled rows predicts domain posteriors from the whole text; its
    features are learned from about ``texts_for_marks`` labelled texts (:func:`learned_marks`);
    projected-gradient least squares then finds rates between 0 and ``most`` whose expected tokens by domain
    (words times posterior times rate) come to weight * ``budget`` * all tokens, starting from one. Where
    the targets can't be met within those bounds the rates are the nearest; ``off_target``, the same in every row,
    is the largest difference between a domain's share of the expected tokens reached and its target. ``copies`` rounds a rate up or
    down by a hash of the row, so its expectation is the rate and every run gives the same.

    Null texts count as empty: no tokens. Null labels and those of other domains don't count, nor do the labels
    of an id that has different ones; without usable labels all posteriors are equal. Rows keep their number,
    repeated ones too; an empty table gives no rows.
    """
    domains = sorted(targets)
    weights = np.array([targets[d] for d in domains], float)
    weights = list(budget * weights / weights.sum())
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    marked = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("domain"))
    marked = marked.where(F.col("domain").isin(domains) & F.col("id").isNotNull())
    marked = marked.groupBy("id").agg(F.min("domain").alias("domain"), F.max("domain").alias("_other")).where("domain = _other").drop("_other")
    with Scratch(docs.sparkSession) as scratch:
        marks = learned_marks(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text")).join(marked, "id"), texts_for_marks)
        described = scratch.table(
            docs.select(
                F.col(f"`{id_col}`").cast("long").alias("id"),
                F.xxhash64(text).alias("h"),
                F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long").alias("n"),
                features(text, marks).alias("x"),
            )
        )
        model = train(described.join(marked, "id"), domains, len(marks) + 4)
        table = scratch.table(described.select("id", "h", "n", model.posteriors(F.col("x")).alias("p")))
        rate, reached = fit_rates(table, weights, most)
        chance = F.pmod(F.xxhash64("id", "h", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
        out = table.withColumn("rate", F.round(rate, 6)).select(
            F.col("id").alias(id_col),
            "h",
            F.col("n").alias("n_tokens"),
            F.col("p").alias("posteriors"),
            "rate",
            F.floor(F.col("rate") + chance).cast("int").alias("copies"),
            F.lit(float(np.abs(reached - np.array(weights)).max())).alias("off_target"),
        )
        return cut(out)


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each row repeated as often as :func:`mix` says (not at all where copies is 0).

    Rows that agree in id and text (a null text is empty) are treated alike; all columns are kept, whatever their names.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    plan = mix(docs, labels, targets, id_col, text_col, **options)
    none, (k, h, c, copy) = F.lit(-(2**63)), unused(docs, "k", "h", "c", "copy")
    plan = plan.select(F.coalesce(F.col(id_col), none).alias(k), F.col("h").alias(h), F.col("copies").alias(c))
    keyed = docs.withColumns({k: F.coalesce(F.col(f"`{id_col}`").cast("long"), none), h: F.xxhash64(text)})
    joined = keyed.join(plan.dropDuplicates([k, h]), [k, h])
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(c)))).select(*(F.col(f"`{n}`") for n in docs.columns))
