"""Clustering of vectors, and trees of clusters.

DBSCAN, its varied-density form and leader clustering work on the neighbours of one keyword at a time: groups that a
query asks for, as small as its answers, and sequential by nature. K-means, silhouette and medoids work on any number
of vectors, as partial sums.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import vectors as V

NOISE = -1


def distances(x: np.ndarray) -> np.ndarray:
    """Cosine distances of rows; a zero row is 1 away from everything but itself."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n == 0, 1, n)
    d = np.clip(1 - u @ u.T, 0, 2)
    np.fill_diagonal(d, 0)
    return d


def dbscan(d: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Labels from a distance matrix: clusters in the order of their first core point, noise -1. A border point goes
    to the first cluster that reaches it."""
    near = d <= eps
    core = near.sum(1) >= least
    labels, current = np.full(len(d), NOISE), 0
    for i in np.flatnonzero(core):
        if labels[i] != NOISE:
            continue
        labels[i] = current
        queue = [i]
        while queue:
            j = queue.pop()
            if core[j]:
                new = np.flatnonzero(near[j] & (labels == NOISE))
                labels[new] = current
                queue += new.tolist()
        current += 1
    return labels


def density_steps(d: np.ndarray, k: int, stride: int = 4) -> list[tuple[float, float]]:
    """(eps, least points) for each density: from the sorted curve of mean distances to the k nearest, at every
    ``stride``-th place where the mean number of neighbours is two or more."""
    ordered = np.sort(d, axis=1)
    curve = np.sort(ordered[:, 1 : k + 1].mean(1)) if len(d) > 1 else np.zeros(len(d))
    slope = (curve[stride::stride] - curve[:-stride:stride][: len(curve[stride::stride])]) / stride
    out = []
    for i in range(len(slope) - 1):
        change, s, eps = slope[i + 1] - slope[i], slope[i], float(curve[i * stride])
        counts = (d <= eps).sum(1)
        points = counts.sum() / max(1, (counts > 0).sum())
        if (change >= 0.1 * s or change <= 0.2 * s) and points >= 2:
            out.append((eps, float(points)))
    return out


def varied_density(x: np.ndarray, k: int = 3) -> np.ndarray:
    """DBSCAN again and again on what is still noise, from dense to sparse; it ends when no noise is left."""
    d = distances(x)
    labels = np.full(len(x), NOISE)
    for eps, points in density_steps(d, k):
        left = np.flatnonzero(labels == NOISE)
        if not len(left):
            break
        found = dbscan(d[np.ix_(left, left)], eps, max(int(points), 2))
        labels[left] = np.where(found == NOISE, NOISE, found + labels.max() + 1)
    return labels


def leader(x: np.ndarray, threshold: float) -> np.ndarray:
    """In order, each unit row joins the closest centre if its dot product reaches the threshold, else it opens a
    cluster; a centre is the unit mean of its members."""
    labels, sums, centres = np.zeros(len(x), np.int64), [], []
    for i, v in enumerate(x):
        if centres:
            dots = np.array(centres) @ v
            c = int(dots.argmax())
            if dots[c] >= threshold:
                sums[c] = sums[c] + v
                n = np.linalg.norm(sums[c])
                centres[c] = sums[c] / (n or 1)
                labels[i] = c
                continue
        labels[i] = len(centres)
        sums.append(v.copy())
        centres.append(v.copy())
    return labels


def by_group(df: DataFrame, group: str, key: str, vec: str, label: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """group, key, cluster: a labelling of each group's unit vectors in the order of their keys."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return pd.DataFrame({group: pdf[group], key: pdf[key], "cluster": label(x / np.where(n == 0, 1, n))})

    return df.select(group, key, vec).groupBy(group).applyInPandas(run, df.select(group, key).schema.add("cluster", "long"))


def silhouette(df: DataFrame, key: str, label: str, vec: str, width: int) -> DataFrame:
    """key, silhouette by cosine distance. The mean distance to a cluster is 1 minus the product with the sum of its
    unit vectors, divided by their number; so sums per cluster are enough. Singletons have 0."""
    unit = df.select(key, label, V.normalize(V.doubles(vec)).alias("_v"))
    s = V.sums(unit, label, "_v", width)
    sides = F.broadcast(s.select(F.collect_list(F.struct(F.col(label).alias("label"), "n", "total")).alias("all")))  # a row a cluster
    rows = unit.crossJoin(sides)
    own = F.element_at(F.filter("all", lambda c: c["label"] == F.col(label)), 1)
    a = F.try_divide(own["n"] - V.dot(F.col("_v"), own["total"]), own["n"] - 1)
    b = F.array_min(F.transform(F.filter("all", lambda c: c["label"] != F.col(label)), lambda c: 1 - V.dot(F.col("_v"), c["total"]) / c["n"]))
    return rows.select(key, F.when(own["n"] == 1, 0.0).otherwise(F.try_divide(b - a, F.greatest(a, b))).alias("silhouette"))


def spherical_kmeans(df: DataFrame, key: str, vec: str, k: int, width: int, rounds: int = 10) -> DataFrame:
    """key, cluster: row i of the keys' order starts in cluster i % k; centres are unit sums; ties go to the lowest.

    A round is one partial aggregation to k sums, which the driver hands to the next round; ``key`` must be 0, 1, 2, ...
    """
    unit = df.select(key, V.normalize(V.doubles(vec)).alias("_v"))
    placed = unit.withColumn("cluster", F.pmod(F.col(key), F.lit(k)).cast("long"))
    for _ in range(rounds):
        sums = {r["cluster"]: r["total"] for r in V.sums(placed, "cluster", "_v", width).collect()}  # k rows
        centres = np.array([sums.get(c, [0.0] * width) for c in range(k)])
        n = np.linalg.norm(centres, axis=1, keepdims=True)
        centres = F.lit((centres / np.where(n == 0, 1, n)).tolist())
        scored = F.transform(centres, lambda c, i: F.struct(F.round(V.dot(F.col("_v"), c), 9).alias("s"), (-i).alias("i")))
        placed = unit.withColumn("cluster", (-F.array_max(scored)["i"]).cast("long"))
    return placed.select(key, "cluster")


def members(df: DataFrame, cluster: str, key: str) -> DataFrame:
    """cluster, members sorted."""
    return df.groupBy(cluster).agg(F.sort_array(F.collect_set(key)).alias("members"))


def descendants(edges: DataFrame, deepest: int = 64) -> DataFrame:
    """edges (parent, child) of a forest -> node, member: each node with all below it, by path doubling."""
    from lexloom.sources.files import shared_dir

    def stored(df: DataFrame) -> DataFrame:
        at = shared_dir(df.sparkSession, "tree")
        df.write.parquet(at)
        return df.sparkSession.read.schema(df.schema).parquet(at)

    reach = stored(edges.select(F.col("parent").alias("node"), F.col("child").alias("member")).where("node <> member").distinct())
    size = reach.count()
    for _ in range(max(1, deepest.bit_length())):
        longer = reach.join(reach.select(F.col("node").alias("member"), F.col("member").alias("m")), "member").select("node", F.col("m").alias("member"))
        reach = stored(reach.union(longer).distinct())
        size, last = reach.count(), size
        if size == last:
            break
    return reach
