"""Trees of groups and variables, layouts and pseudotime on neighbour graphs.

Spark aggregates and joins; what reaches the driver is a matrix of groups or variables, or ``k`` numbers a component.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longview.session import cut

#: Leaves of a tree: their distances are a matrix on the driver.
MOST_LEAVES = 5_000


def linkage(names: list[str], distance: np.ndarray, method: str = "average") -> list[tuple]:
    """(step, left, right, distance, size) of agglomerative clustering; a merged cluster is named by its first leaf.

    Of equally close pairs the first by name is merged. ``method``: single, complete or average.
    """
    if len(names) > MOST_LEAVES:
        raise ValueError(f"a tree of more than {MOST_LEAVES} leaves: aggregate into groups first")
    order = np.argsort(names)
    names, d = [names[i] for i in order], np.array(distance, float)[np.ix_(order, order)]
    np.fill_diagonal(d, np.inf)
    size, out = np.ones(len(names)), []
    for step in range(len(names) - 1):
        i, j = divmod(int(np.argmin(np.round(d, 12))), len(names))
        out.append((step, names[i], names[j], float(d[i, j]), int(size[i] + size[j])))
        joined = {"single": np.minimum(d[i], d[j]), "complete": np.maximum(d[i], d[j]), "average": (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])}[method]
        d[i], d[:, i] = joined, joined
        size[i] += size[j]
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
    return out


def leaf_order(merges: list[tuple], names: list[str]) -> list[str]:
    """The leaves from left to right as the tree is drawn."""
    groups = {n: [n] for n in names}
    for _, a, b, _, _ in merges:
        groups[a] = groups[a] + groups.pop(b)
    return [n for k in sorted(groups) for n in groups[k]]


def _frame(spark, merges: list[tuple]) -> DataFrame:
    return spark.createDataFrame(merges, "step int, left string, right string, distance double, size int")


def missing_dendrogram(df: DataFrame, columns: list[str], method: str = "average") -> DataFrame:
    """The tree of columns by the Euclidean distance of their missingness: one aggregation of pairwise differences."""
    null = {c: F.col(f"`{c}`").isNull() for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(F.sum((null[a] != null[b]).cast("long")).alias(f"{i}") for i, (a, b) in enumerate(pairs))).first()
    d = np.zeros((len(columns), len(columns)))
    for i, (a, b) in enumerate(pairs):
        d[columns.index(a), columns.index(b)] = d[columns.index(b), columns.index(a)] = np.sqrt(row[i] or 0)
    return _frame(df.sparkSession, linkage(columns, d, method))


def group_profiles(df: DataFrame, group: str, columns: list[str]) -> tuple[list[str], np.ndarray]:
    """(groups, their means by column)."""
    rows = df.where(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("g")).agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in columns)).orderBy("g").collect()
    return [r["g"] for r in rows], np.array([[r[c] if r[c] is not None else 0.0 for c in columns] for r in rows], float)


def dendrogram(df: DataFrame, group: str, columns: list[str], method: str = "complete") -> DataFrame:
    """The tree of groups by one minus the correlation of their means."""
    names, means = group_profiles(df, group, columns)
    return _frame(df.sparkSession, linkage(names, 1 - np.atleast_2d(np.corrcoef(means)), method))


def cluster_map(df: DataFrame, group: str, columns: list[str], method: str = "average") -> DataFrame:
    """(row, column, group, var, mean, scaled): a matrix of group means with rows and columns in the order of their trees."""
    names, means = group_profiles(df, group, columns)
    spread = np.ptp(means, 0)
    scaled = (means - means.min(0)) / np.where(spread == 0, 1, spread)
    far = lambda x: np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    rows, cols = leaf_order(linkage(names, far(scaled), method), names), leaf_order(linkage(columns, far(scaled.T), method), columns)
    cells = [(rows.index(g), cols.index(c), g, c, float(means[i, j]), float(scaled[i, j])) for i, g in enumerate(names) for j, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(cells, "row int, column int, group string, var string, mean double, scaled double")


def connectivities(neighbors: DataFrame) -> DataFrame:
    """(i, j, weight): symmetric fuzzy weights of a neighbour table (query, neighbor, distance), both directions.

    A neighbour's weight falls from one at the nearest with the mean distance beyond it; directions join as a + b - ab.
    """
    w = Window.partitionBy("query")
    near = F.min("distance").over(w)
    table = neighbors.withColumn("_near", near)
    scale = F.greatest(F.avg(F.col("distance") - F.col("_near")).over(w), F.lit(1e-12))
    directed = table.select(F.col("query").alias("i"), F.col("neighbor").alias("j"), F.exp(-(F.col("distance") - F.col("_near")) / scale).alias("w"))
    both = directed.union(directed.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    sides = both.groupBy("i", "j").agg(F.sum("w").alias("s"), F.product("w").alias("p"), F.count(F.lit(1)).alias("n"))
    return sides.select("i", "j", (F.col("s") - F.when(F.col("n") > 1, F.col("p")).otherwise(0.0)).alias("weight"))


def diffusion_map(edges: DataFrame, k: int = 3, rounds: int = 40, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """((id, c1 ... ck), eigenvalues) of the density-normalised symmetric transition matrix of (i, j, weight), largest first.

    Orthogonal iteration: a round multiplies the matrix into k columns by one join and one aggregation, and only k x k
    sums reach the driver. ``edges`` has both directions; results are cut from their lineage by a checkpoint.
    """
    edges = cut(edges.select("i", "j", "weight"))
    degree = edges.groupBy("i").agg(F.sum("weight").alias("d"))
    q = edges.join(degree, "i").join(degree.select(F.col("i").alias("j"), F.col("d").alias("e")), "j").select("i", "j", (F.col("weight") / (F.col("d") * F.col("e"))).alias("w"))
    z = q.groupBy("i").agg(F.sqrt(F.sum("w")).alias("z"))
    t = q.join(z, "i").join(z.select(F.col("i").alias("j"), F.col("z").alias("y")), "j").select("i", "j", (F.col("w") / (F.col("z") * F.col("y"))).alias("w"))
    t = cut(t)
    names = [f"c{n + 1}" for n in range(k)]
    x = t.select(F.col("i").alias("id")).distinct().withColumns({n: F.xxhash64("id", F.lit(seed * 97 + m)) / float(2**63) for m, n in enumerate(names)})

    def products(frame: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
        row = frame.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(left) for j, b in enumerate(right))).first()
        return np.array([[row[f"{i}_{j}"] for j in range(len(right))] for i in range(len(left))], float)

    def rotated(frame: DataFrame, by: np.ndarray, source: list[str]) -> DataFrame:
        return frame.select("id", *(sum((F.col(a) * float(by[i, j]) for i, a in enumerate(source)), F.lit(0.0)).alias(n) for j, n in enumerate(names)))

    values = np.zeros(k)
    for _ in range(rounds):
        image = t.join(x.withColumnRenamed("id", "j"), "j").groupBy(F.col("i").alias("id")).agg(*(F.sum(F.col("w") * F.col(n)).alias(n) for n in names))
        image = image.join(x.select("id", *(F.col(n).alias(f"p{n}") for n in names)), "id").select("id", *((F.col(n) + F.col(f"p{n}")).alias(n) for n in names))
        image = cut(image)  # shifted by one: all eigenvalues count as positive
        low, vectors = np.linalg.eigh(products(image, names, names))
        x = cut(rotated(image, (vectors / np.sqrt(np.maximum(low, 1e-300)))[:, ::-1], names))
        moved = t.join(x.withColumnRenamed("id", "j"), "j").groupBy(F.col("i").alias("id")).agg(*(F.sum(F.col("w") * F.col(n)).alias(f"m{n}") for n in names))
        small = products(moved.join(x, "id"), names, [f"m{n}" for n in names])
        own, turn = np.linalg.eigh((small + small.T) / 2)
        before, values = values, own[::-1]
        x = rotated(x, turn[:, ::-1], names)
        if np.abs(values - before).max() < 1e-6:
            break
    return cut(x), [float(v) for v in values]


def pseudotime(components: DataFrame, values: list[float], root: int) -> DataFrame:
    """(id, pseudotime): diffusion distance from ``root``, scaled to [0, 1]; components with eigenvalue one are left out."""
    weights = [(f"c{n + 1}", v / (1 - v)) for n, v in enumerate(values) if v < 1 - 1e-6]
    start = components.where(F.col("id") == root).first()
    if start is None:
        raise ValueError(f"no observation {root}")
    d = F.sqrt(sum(((F.col(c) - float(start[c])) ** 2 * float(w) ** 2 for c, w in weights), F.lit(0.0)))
    table = components.select("id", d.alias("d"))
    most = table.agg(F.max("d")).first()[0] or 1.0
    return table.select("id", (F.col("d") / float(most)).alias("pseudotime"))


def layout(edges: DataFrame, start: DataFrame, rounds: int = 30, negatives: int = 5, a: float = 1.58, b: float = 0.9, rate: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, x, y): a two-dimensional layout in which linked observations attract and random ones repel each other.

    Stochastic descent of the cross-entropy between ``edges`` (i, j, weight in (0, 1]) and the similarity
    1 / (1 + a d^(2b)) in the plane, from positions ``start`` (id, x, y). A round is one join and one aggregation a side;
    the observations that repel are drawn by a hash of the id, so a round does not depend on how rows are dealt out.
    """
    edges = cut(edges.select("i", "j", "weight"))
    place = cut(start.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    n = place.count()
    index = place.select("id").withColumn("slot", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id"))).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    sizes = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.max("slot").alias("n")).collect()}
    table = F.create_map(*(F.lit(v) for kv in sizes.items() for v in kv))
    index = cut(index)
    for r in range(rounds if n > 1 else 0):
        step = rate * (1 - r / rounds)
        here = place.select(F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
        there = place.select(F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
        parts = list(sizes)
        draw = F.explode(F.transform(F.sequence(F.lit(1), F.lit(negatives)), lambda k: F.xxhash64(F.col("i"), k, F.lit(seed * 1009 + r))))
        drawn = here.select("i", draw.alias("h")).withColumn("part", F.element_at(F.array(*map(F.lit, parts)), (F.pmod(F.shiftright("h", 20), F.lit(len(parts))) + 1).cast("int")))
        drawn = drawn.withColumn("slot", (F.pmod("h", F.element_at(table, F.col("part"))) + 1).cast("int")).join(index.withColumnRenamed("id", "j"), ["part", "slot"])
        pairs = edges.select("i", "j", F.col("weight").alias("pull"), F.lit(0.0).alias("push")).union(drawn.select("i", "j", F.lit(0.0), F.lit(1.0))).where("i <> j")
        d = pairs.join(here, "i").join(there, "j").withColumn("q", F.greatest((F.col("xi") - F.col("xj")) ** 2 + (F.col("yi") - F.col("yj")) ** 2, F.lit(1e-6)))
        grow = 1 + a * F.pow("q", F.lit(b))
        force = -2 * a * b * F.pow("q", F.lit(b - 1)) / grow * F.col("pull") + 2 * b / ((0.001 + F.col("q")) * grow) * F.col("push")
        clip = lambda c: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), c))
        moved = d.groupBy(F.col("i").alias("id")).agg(F.sum(clip(force * (F.col("xi") - F.col("xj")))).alias("dx"), F.sum(clip(force * (F.col("yi") - F.col("yj")))).alias("dy"))
        shift = lambda c: F.coalesce(clip(F.col(c)) * step, F.lit(0.0))
        place = cut(place.join(moved, "id", "left").select("id", (F.col("x") + shift("dx")).alias("x"), (F.col("y") + shift("dy")).alias("y")))
    return place


def transfer_labels(neighbors: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label, share): the label most of an observation's reference neighbours have; of equally many, the first."""
    votes = neighbors.join(labels.select(F.col("id").alias("neighbor"), F.col("label").cast("string").alias("label")), "neighbor").groupBy(F.col("query").alias("id"), "label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("id")
    ranked = votes.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.col("n").desc(), "label")))
    return ranked.where("_r = 1").select("id", "label", "share")


def modularity_communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 12) -> DataFrame:
    """(id, label) by moves that raise modularity on weighted undirected ``edges`` (i, j, weight), both directions listed.

    In a round each node weighs its neighbours' communities by w(node, c) - resolution * degree * total(c) / 2m and half
    of the nodes (by a hash, so that pairs do not swap for ever) take the best; a tie goes to the smallest label.
    """
    edges = cut(edges.select("i", "j", "weight"))
    degree = cut(edges.groupBy(F.col("i").alias("id")).agg(F.sum("weight").alias("d")))
    total = degree.agg(F.sum("d")).first()[0] or 1.0
    labels = degree.select("id", F.col("id").alias("label"), "d")
    for r in range(rounds):
        mass = labels.groupBy("label").agg(F.sum("d").alias("m"))
        votes = edges.where("i <> j").join(labels.select(F.col("id").alias("j"), "label"), "j").groupBy("i", "label").agg(F.sum("weight").alias("w"))
        own = labels.select(F.col("id").alias("i"), F.col("label").alias("own"), "d")
        stay = own.select("i", F.col("own").alias("label"), F.lit(0.0).alias("w"))
        votes = votes.union(stay).groupBy("i", "label").agg(F.sum("w").alias("w")).join(own, "i").join(mass, "label")
        inside = F.col("m") - F.when(F.col("label") == F.col("own"), F.col("d")).otherwise(0.0)
        gain = F.round(F.col("w") - resolution * F.col("d") * inside / total, 9)
        best = votes.groupBy(F.col("i").alias("id")).agg(F.max_by("label", F.struct(gain, -F.col("label"))).alias("best"))
        moves = F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0
        now = cut(labels.join(best, "id").select("id", F.when(moves, F.col("best")).otherwise(F.col("label")).alias("label"), "d", (moves & (F.col("best") != F.col("label"))).alias("moved")))
        changed = now.where("moved").limit(1).count()
        labels = now.drop("moved")
        if not changed and r % 2:
            break
    return labels.select("id", "label")


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    a, b = labels.select(F.col("id").alias("i"), F.col("label").alias("a")), labels.select(F.col("id").alias("j"), F.col("label").alias("b"))
    cells = edges.join(a, "i").join(b, "j")
    total = cells.agg(F.sum("weight")).first()[0] or 1.0
    inside = cells.where("a = b").agg(F.sum("weight")).first()[0] or 0.0
    degree = cells.groupBy("a").agg(F.sum("weight").alias("d")).agg(F.sum(F.col("d") * F.col("d"))).first()[0] or 0.0
    return inside / total - resolution * degree / total**2
