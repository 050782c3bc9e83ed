"""The knowledge graph: parsing property maps, links between known nodes, walks, hierarchical expansion."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators import clustering, vectors

#: instance of, subclass of, part of, facet of, metasubclass of
PROPERTIES = ("P31", "P279", "P361", "P1269", "P1557")


def parse_properties(json: Column) -> Column:
    """{property: [id, ...]} -> array of (prop, dst)."""
    m = F.from_json(json, "map<string,array<string>>")
    return F.flatten(F.transform(F.map_entries(m), lambda e: F.transform(e["value"], lambda d: F.struct(e["key"].alias("prop"), d.alias("dst")))))


def known_edges(edges: DataFrame, nodes: DataFrame, properties: Sequence[str] | None = None) -> DataFrame:
    """edges (src, prop, dst) -> distinct undirected (u, v), both ends among ``nodes`` (id), without loops."""
    kept = edges.where(F.col("prop").isin(*properties)) if properties else edges
    for end in ("src", "dst"):
        kept = kept.join(nodes.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    return kept.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def numbered_nodes(nodes: DataFrame) -> DataFrame:
    """index, id, word: nodes in the order of their ids."""
    from lexloom.operators.corpus import vocabulary

    v = vocabulary(nodes.select(F.concat_ws("\t", "id", "word").alias("token"), F.lit(0).cast("long").alias("cn")), ())
    return v.select(F.col("id").alias("index"), F.split_part("token", F.lit("\t"), F.lit(1)).alias("id"), F.split_part("token", F.lit("\t"), F.lit(2)).alias("word"))


def walks(edges: DataFrame, length: int, per_node: int, seed: int = 45) -> DataFrame:
    """start, walk, path: random walks, each step an equi-join that picks a neighbour by hash; neighbours of a node
    are numbered first, so that a hub's aren't gathered."""
    from pyspark.sql import Window

    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    ranked = both.withColumn("i", F.row_number().over(Window.partitionBy("a").orderBy("b")) - 1)
    degree = both.groupBy("a").agg(F.count("*").alias("n"))
    out = degree.select(F.col("a").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("walk"), F.array("a").alias("path"))
    for step in range(1, length):
        here = out.withColumn("a", F.element_at("path", -1)).join(degree, "a")
        pick = here.withColumn("i", F.pmod(F.xxhash64("start", "walk", F.lit(step), F.lit(seed)), F.col("n")).cast("int"))
        out = pick.join(ranked, ["a", "i"]).select("start", "walk", F.concat("path", F.array("b")).alias("path"))
    return out


def expand(vecs: DataFrame, centre: int, related: float, together: float, width: int) -> DataFrame:
    """One level of a keyword's tree: its neighbours by topic, clustered by their offsets from it; a cluster's
    representative is the member closest to its centre -> cluster, id, representative."""
    mine = vecs.where(F.col("id") == centre).select(F.col("id").alias("qid"), "vec")
    near = vectors.scores(vecs, mine, least=related).where(F.col("id") != centre).select("id")
    base = vecs.join(near, "id").select("id", vectors.normalize(F.col("vec")).alias("vec"))
    at = mine.select(vectors.normalize(F.col("vec")).alias("c"))
    off = base.crossJoin(F.broadcast(at)).select(F.lit(centre).alias("g"), "id", vectors.offset(F.col("vec"), F.col("c")).alias("vec"))  # one row
    labels = clustering.by_group(off, "g", "id", "vec", lambda x: clustering.leader(x, together))
    placed = labels.join(off.select("id", "vec"), "id")
    centres = vectors.centroids(placed, "cluster", "vec", width)
    close = placed.join(centres, "cluster").select("cluster", "id", F.round(vectors.dot(F.col("vec"), F.col("centre")), 6).alias("s"))
    names = close.groupBy("cluster").agg(F.max_by("id", F.struct("s", -F.col("id"))).alias("representative"))
    return close.join(names, "cluster").select("cluster", "id", "representative")


def silhouette_score(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette by cosine distance of what isn't noise; -1 where all is noise or one cluster holds it all."""
    keep = labels != clustering.NOISE
    x, labels = x[keep], labels[keep]
    names = np.unique(labels)
    if len(names) < 2:
        return -1.0
    d = clustering.distances(x)
    to = np.stack([d[:, labels == c].sum(1) for c in names], 1)
    n = np.array([(labels == c).sum() for c in names])
    own = np.searchsorted(names, labels)
    i = np.arange(len(x))
    a = to[i, own] / np.maximum(n[own] - 1, 1)
    mean = to / n
    mean[i, own] = np.inf
    b = mean.min(1)
    s = np.where(n[own] == 1, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-12))
    return float(s.mean())


def first_hits(keywords: DataFrame, entities: DataFrame) -> DataFrame:
    """keywords (kw), entities (label, entity) -> kw, entity (the smallest of its label's, -1 where there is none), found: misses are for the log."""
    first = entities.groupBy("label").agg(F.min("entity").alias("entity"))
    return keywords.join(first, F.col("kw") == F.col("label"), "left").select("kw", F.coalesce("entity", F.lit(-1).cast("long")).alias("entity"), F.col("entity").isNotNull().alias("found"))
