"""Queries over clusters of vectors and over the graph of regions, nations and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import clustering as K
from lexloom.operators import graph as G
from lexloom.operators import vectors as V
from lexloom.plans.base import literal, query, rounded, table
from lexloom.plans.vector_queries import _U, WIDTH, _vectors


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 nearest of each vector of the query set, as the clustering endpoint takes them."""
    v = _vectors(spark, sf_dir)
    got = V.scores(v, v.where("id % 50 = 0").select(F.col("id").alias("qid"), "vec"), k=40)
    return got.join(v, "id").select("qid", "id", "vec")


@query()
def clu1_varied_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each query vector, clustered from dense to sparse."""
    return K.by_group(_near(spark, sf_dir), "qid", "id", "vec", K.varied_density)


_SIL = _U + """, x AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM u), t AS (SELECT label, i, sum(x) AS x FROM x GROUP BY 1, 2), s AS (SELECT label, list(x ORDER BY i) AS v FROM t GROUP BY 1), n AS (SELECT label, count(*) AS n FROM u GROUP BY 1),
d AS (SELECT u.id, u.label, s.label AS other, n, list_dot_product(u.v, s.v) AS dot FROM u, s JOIN n ON n.label = s.label),
m AS (SELECT id, max(CASE WHEN label = other THEN (n - dot) / nullif(n - 1, 0) END) AS a, min(CASE WHEN label <> other THEN 1 - dot / n END) AS b FROM d GROUP BY id)"""


@query(f"WITH {_SIL} SELECT id, round((b - a) / greatest(a, b), 6) AS silhouette FROM m")
def clu2_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the labels that the vectors come with."""
    return K.silhouette(_vectors(spark, sf_dir), "id", "label", "vec", WIDTH).select("id", rounded("silhouette"))


@query(f"WITH {_U}, c AS (SELECT a.id, count(*) AS n FROM u a, u b WHERE 1 - list_dot_product(a.v, b.v) <= 0.6 OR a.id = b.id GROUP BY 1) SELECT id, n, n >= 5 AS core FROM c")
def clu3_core_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DBSCAN's core test: at least five vectors within 0.6."""
    v = _vectors(spark, sf_dir)
    counts = V.within(v, v.select(F.col("id").alias("qid"), "vec"), 0.6)
    return counts.select(F.col("qid").alias("id"), "n", (F.col("n") >= 5).alias("core"))


@query()
def clu3_dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.by_group(_near(spark, sf_dir), "qid", "id", "vec", lambda x: K.dbscan(K.distances(x), 0.7, 5))


@query()
def clu4_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.by_group(_near(spark, sf_dir), "qid", "id", "vec", lambda x: K.leader(x, 0.3))


_KM = _U + """, p AS (SELECT id, v, id % 7 AS c FROM u), x AS (SELECT c, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM p), t AS (SELECT c, i, sum(x) AS x FROM x GROUP BY 1, 2), s AS (SELECT c, list(x ORDER BY i) AS v FROM t GROUP BY 1), m AS (SELECT c, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM s)"""


@query(f"WITH {_KM}, d AS (SELECT u.id, m.c, round(list_dot_product(u.v, m.v), 9) AS s FROM u, m) SELECT id, arg_max(c, (s, -c)) AS cluster FROM d GROUP BY id")
def clu6_kmeans_one_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.spherical_kmeans(_vectors(spark, sf_dir), "id", "vec", 7, WIDTH, 1)


@query()
def clu6_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.spherical_kmeans(_vectors(spark, sf_dir), "id", "vec", 7, WIDTH)


@query("SELECT label, count(*) AS n, array_to_string(list(vec_id ORDER BY vec_id), ' ') AS members FROM embeddings GROUP BY label")
def clu7_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = K.members(_vectors(spark, sf_dir), "label", "id")
    return got.select("label", F.size("members").cast("long").alias("n"), F.array_join(F.col("members").cast("array<string>"), " ").alias("members"))


_TREE = "edge AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'world', 'r' || r_regionkey FROM region)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s, r = (table(spark, sf_dir, t) for t in ("nation", "supplier", "region"))
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    return n.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child")).unionByName(s.select(name("n", "s_nationkey").alias("parent"), name("s", "s_suppkey").alias("child"))).unionByName(r.select(F.lit("world").alias("parent"), name("r", "r_regionkey").alias("child")))


@query(f"WITH RECURSIVE {_TREE}, t AS (SELECT parent AS node, child AS member FROM edge UNION SELECT t.node, edge.child FROM t JOIN edge ON edge.parent = t.member) SELECT node, member FROM t")
def clu8_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.descendants(_tree(spark, sf_dir))


@query("SELECT DISTINCT least('n' || s_nationkey, 's' || s_suppkey) AS u, greatest('n' || s_nationkey, 's' || s_suppkey) AS v FROM supplier WHERE s_nationkey < 20")
def join15_known_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also GRF4 and M20: property maps as JSON, two properties, one of them wanted, and nodes that aren't all known."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit('{"P31": ["n'), "s_nationkey", F.lit('", "x9"], "P999": ["n0"]}')).alias("props"))
    edges = s.select("src", F.explode(G.parse_properties(F.col("props"))).alias("e")).select("src", "e.prop", "e.dst")
    nodes = s.select(F.col("src").alias("id")).unionByName(table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.concat(F.lit("n"), "n_nationkey").alias("id")))
    return G.known_edges(edges, nodes, G.PROPERTIES)


@query("SELECT row_number() OVER (ORDER BY 'n' || n_nationkey) - 1 AS index, 'n' || n_nationkey AS id, n_name AS word FROM nation")
def grf4_node_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.numbered_nodes(table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("word")))


@query()
def grf5_random_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _tree(spark, sf_dir).select(F.col("parent").alias("u"), F.col("child").alias("v"))
    return G.walks(edges, 6, 2).select("start", "walk", F.array_join("path", " ").alias("path"))


@query()
def cmp1_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level of the tree of vector 0."""
    return G.expand(_vectors(spark, sf_dir).select("id", "vec"), 0, 0.1, 0.2, WIDTH)


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (1, 2, 3) UNION ALL SELECT 10000000, NULL")
def flt16_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses of a lookup."""
    asked = literal(spark, [(1,), (2,), (3,), (10**7,)], "id long")
    return asked.join(_vectors(spark, sf_dir).select("id", "label"), "id", "left")
