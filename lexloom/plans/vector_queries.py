"""Queries over vectors: normalising, similarity, search, analogy, ranks, centroids and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.operators import vectors as V
from lexloom.plans.base import query, rounded, table, values

WIDTH = 64
_E = "e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_U = _E + ", u AS (SELECT id, label, list_transform(v, lambda x: x / CASE WHEN sqrt(list_dot_product(v, v)) = 0 THEN 1 ELSE sqrt(list_dot_product(v, v)) END) AS v FROM e)"
#: The query set: every vector whose id is divisible by 50.
_S = _U + ", s AS (SELECT q.id AS qid, u.id, u.label, q.label AS qlabel, list_dot_product(q.v, u.v) AS score FROM u q, u WHERE q.id % 50 = 0)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), V.doubles("embedding").alias("vec"), "label")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).where("id % 50 = 0").select(F.col("id").alias("qid"), "vec")


def _scored(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return V.scores(_vectors(spark, sf_dir), _queries(spark, sf_dir), **how)


@query(f"WITH {_U} SELECT id, generate_subscripts(v, 1) - 1 AS i, round(unnest(v), 6) AS x FROM u")
def vec1_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also VEC2."""
    return _vectors(spark, sf_dir).select("id", F.posexplode(V.normalize(F.col("vec"))).alias("i", "x")).select("id", F.col("i").cast("long").alias("i"), rounded("x"))


@query(f"WITH {_E}, p AS (SELECT a.id, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS c FROM e a LEFT JOIN e b ON b.id = a.id + 1) SELECT id, round(coalesce(c, 0), 6) AS cosine FROM p")
def vec3_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector and the next one; 0 where that is missing."""
    v = _vectors(spark, sf_dir)
    after = v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("w"))
    return v.join(after, "id", "left").select("id", F.round(V.cosine(F.col("vec"), F.col("w")), 6).alias("cosine"))


@query(f"WITH {_S} SELECT qid, id, round(score, 6) AS score FROM s WHERE round(score, 6) >= 0.3")
def vec4_threshold_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also FLT15: at least 0.3, the query itself included."""
    return _scored(spark, sf_dir, least=0.3).select("qid", "id", rounded("score"))


@query(f"WITH {_S} SELECT qid, id, round(1 - score, 6) + 0 AS distance FROM s")
def vec5_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also JOIN17: the query set against all vectors."""
    return _scored(spark, sf_dir).select("qid", "id", (F.round(1 - F.col("score"), 6) + 0.0).alias("distance"))


_ASK = _S.replace("q.id % 50 = 0", "q.id % 50 < 3") + """, w AS (SELECT qid - qid % 50 AS q, id, max(CASE WHEN qid % 50 = 0 THEN score END) AS a, max(CASE WHEN qid % 50 = 1 THEN score END) AS b, max(CASE WHEN qid % 50 = 2 THEN score END) AS c FROM s GROUP BY 1, 2),
m AS (SELECT q AS qid, id, {score} AS score FROM w WHERE id NOT IN (q, q + 1, q + 2)), r AS (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM m)
SELECT qid, id, score, rank FROM r WHERE rank <= {k}"""
_MUL, _ADD = "(1 + b) / 2 * ((1 + c) / 2) / ((1 + a) / 2)", "b + c - a"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of vectors n, n + 1 and n + 2, for every n divisible by 50; the right answer is said to be n + 3."""
    n = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select("vec_id")
    return n.select(F.col("vec_id").alias("qid"), F.col("vec_id").alias("n1"), (F.col("vec_id") + 1).alias("p1"), (F.col("vec_id") + 2).alias("p2"))


@query(f"WITH {_ASK.format(score=_MUL, k=5)}")
def vec6_analogy_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.analogies(_vectors(spark, sf_dir), _questions(spark, sf_dir), 5).select("qid", "id", rounded("score"), "rank")


@query(f"WITH {_ASK.format(score=_ADD, k=5)}")
def vec7_analogy_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.analogies(_vectors(spark, sf_dir), _questions(spark, sf_dir), 5, multiply=False).select("qid", "id", rounded("score"), "rank")


@query(f"WITH q AS (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 50 = 0 UNION ALL SELECT -3), best AS (WITH {_ASK.format(score=_MUL, k=1)}) SELECT q.qid, coalesce(id::VARCHAR, 'MISSING') AS answer, coalesce(id = q.qid + 3, false) AS right FROM q LEFT JOIN best ON best.qid = q.qid")
def vec8_analogy_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question asks of ids that no vector has."""
    asked = _questions(spark, sf_dir).unionByName(spark.createDataFrame([(-3, -3, -2, -1)], "qid long, n1 long, p1 long, p2 long"))
    best = V.analogies(_vectors(spark, sf_dir), asked)
    return asked.join(best, "qid", "left").select("qid", F.coalesce(F.col("id").cast("string"), F.lit("MISSING")).alias("answer"), F.coalesce(F.col("id") == F.col("qid") + 3, F.lit(False)).alias("right"))


_C = _U + """, x AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM u), mean AS (SELECT label, i, sum(x) / count(*) AS x FROM x GROUP BY 1, 2),
m AS (SELECT label, list(x ORDER BY i) AS v FROM mean GROUP BY 1), c AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM m)"""


def _centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.centroids(_vectors(spark, sf_dir), "label", "vec", WIDTH)


@query(f"WITH {_C}, p AS (SELECT a.id, list_transform(list_zip(b.v, a.v), lambda z: z[1] - z[2]) AS v FROM u a JOIN u b ON b.id = a.id + 1 WHERE a.id % 2 = 0) SELECT id, c.label, round(list_dot_product(p.v, c.v) / nullif(sqrt(list_dot_product(p.v, p.v)), 0), 6) AS score FROM p, c")
def vec9_pair_relation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of pairs against the centre of each label; the labels are few and fixed."""
    unit = _vectors(spark, sf_dir).select("id", V.normalize(F.col("vec")).alias("v"))
    after = unit.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    pairs = unit.where("id % 2 = 0").join(after, "id").select("id", F.zip_with("w", "v", lambda a, b: a - b).alias("vec"))
    got = V.scores(pairs, _centres(spark, sf_dir).select(F.col("label").cast("long").alias("qid"), F.col("centre").alias("vec")))
    return got.select("id", F.col("qid").cast("int").alias("label"), rounded("score"))


@query(f"WITH {_C}, o AS (SELECT u.id, list_transform(list_zip(u.v, c.v), lambda z: z[1] - z[2]) AS v FROM u JOIN c USING (label)) SELECT id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS last FROM o")
def vec10_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the centre of its label to each vector."""
    unit = _vectors(spark, sf_dir).select("id", "label", V.normalize(F.col("vec")).alias("v")).join(_centres(spark, sf_dir), "label")
    off = unit.select("id", V.offset(F.col("v"), F.col("centre")).alias("o"))
    return off.select("id", F.round(F.element_at("o", 1), 6).alias("first"), F.round(F.element_at("o", -1), 6).alias("last"))


_P = _U + ", p AS (SELECT a.id, list_transform(list_zip(b.v, a.v), lambda z: z[1] - z[2]) AS v FROM u a JOIN u b ON b.id = a.id + 1 WHERE a.id % 2 = 0), n AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM p)"


@query(f"WITH {_P}, s AS (SELECT q.id AS qid, n.id, list_dot_product(q.v, n.v) AS score FROM n q, n WHERE q.id % 50 = 0 AND n.id <> q.id), r AS (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM s) SELECT * FROM r WHERE rank <= 3")
def vec11_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = _vectors(spark, sf_dir).select("id", V.normalize(F.col("vec")).alias("v"))
    after = unit.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    pairs = unit.where("id % 2 = 0").join(after, "id").select("id", F.zip_with("w", "v", lambda a, b: a - b).alias("vec"))
    near = V.scores(pairs, pairs.where("id % 50 = 0").select(F.col("id").alias("qid"), "vec"), k=4).where("qid <> id")
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 6)), "id")
    return near.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 3").select("qid", "id", rounded("score"), "rank")


@query()
def vec12_attention_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of neighbouring ids, four a row, pooled by masked softmax attention."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = np.array([np.stack(x) for x in pdf["vecs"]]) if len(pdf) else np.zeros((0, 4, WIDTH))
            mask = np.arange(4)[None, :] < pdf["n"].to_numpy()[:, None]
            pooled = V.attention_pool(rows, np.linspace(-1, 1, WIDTH), mask)
            yield pd.DataFrame({"row": pdf["row"], "first": pooled[:, 0], "norm": np.linalg.norm(pooled, axis=1)})

    v = _vectors(spark, sf_dir).select(F.floor(F.col("id") / 4).alias("row"), F.struct("id", "vec").alias("x"))
    four = v.groupBy("row").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["vec"]).alias("v"))
    blank = F.array_repeat(F.lit(0.0), WIDTH)
    filled = four.select("row", F.concat("v", F.array_repeat(blank, 4 - F.size("v"))).alias("vecs"), (1 + F.pmod("row", F.lit(4))).alias("n"))
    return filled.mapInPandas(run, "row long, first double, norm double").select("row", rounded("first"), rounded("norm"))


_GRAMS = "flatten([list_transform(range(1, len(c) - n + 2), lambda i: array_to_string(list_slice(c, i, i + n - 1), '')) for n in [2, 3, 4] if len(c) >= n])"


@query(f"""WITH {_U}, w AS (SELECT DISTINCT p_name AS word FROM part), c AS (SELECT word, list_concat(list_concat(['#BEGIN#'], string_split(word, '')), ['#END#']) AS c FROM w),
g AS (SELECT word, unnest({_GRAMS}) AS gram FROM c), ids AS (SELECT gram, row_number() OVER (ORDER BY gram) - 1 AS id FROM (SELECT DISTINCT gram FROM g)), x AS (SELECT word, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM g JOIN ids USING (gram) JOIN u USING (id))
SELECT word, i - 1 AS i, round(avg(x), 6) AS x FROM x GROUP BY word, i""")
def vec13_ngram_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word's vector is the mean of those of its character n-grams; n-grams are given vectors in their order."""
    words = table(spark, sf_dir, "part").select(F.col("p_name").alias("word")).distinct()
    grams = words.select("word", F.explode(V.char_ngrams(F.col("word"))).alias("gram"))
    from lexloom.operators.corpus import vocabulary

    ids = vocabulary(grams.select(F.col("gram").alias("token"), F.lit(0).cast("long").alias("cn")).distinct(), ()).select(F.col("token").alias("gram"), "id")
    unit = _vectors(spark, sf_dir).select("id", V.normalize(F.col("vec")).alias("v"))
    means = V.sums(grams.join(ids, "gram").join(unit, "id"), "word", "v", WIDTH)
    return means.select("word", F.posexplode(F.transform("total", lambda x: x / F.col("n"))).alias("i", "x")).select("word", F.col("i").cast("long").alias("i"), rounded("x"))


@query("SELECT event_id, round(CASE WHEN (value - 10) / 3 >= 6 THEN 1e0 WHEN (value - 10) / 3 <= -6 THEN 0e0 ELSE 1 / (1 + exp(-(value - 10) / 3)) END, 6) AS p FROM events")
def vec14_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(V.sigmoid((F.col("value") - 10) / 3), 6).alias("p"))


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def top1_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(25)


_RANKED = _S + ", r AS (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM s{where}) SELECT qid, id, score, rank FROM r WHERE rank <= {k}"


@query(f"WITH {_RANKED.format(where='', k=10)}")
def top2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query itself included."""
    return _scored(spark, sf_dir, k=10).select("qid", "id", rounded("score"), "rank")


@query(f"""WITH {_U}, q AS (SELECT a.id AS qid, list_transform(list_zip(a.v, b.v), lambda z: z[1] + z[2]) AS v FROM u a JOIN u b ON b.id = a.id + 1 WHERE a.id % 50 = 0),
s AS (SELECT qid, u.id, list_dot_product(q.v, u.v) / sqrt(list_dot_product(q.v, q.v)) AS score FROM q, u WHERE u.id NOT IN (qid, qid + 1)), r AS (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM s)
SELECT qid, id, score, rank FROM r WHERE rank <= 40""")
def top3_nearest_to_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 nearest to the sum of two words' vectors, both left out."""
    unit = _vectors(spark, sf_dir).select("id", V.normalize(F.col("vec")).alias("v"))
    after = unit.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    asked = unit.where("id % 50 = 0").join(after, "id").select(F.col("id").alias("qid"), F.zip_with("v", "w", lambda a, b: a + b).alias("vec"))
    near = V.scores(_vectors(spark, sf_dir), asked, k=42).where("id <> qid AND id <> qid + 1")
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 6)), "id")
    return near.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 40").select("qid", "id", rounded("score"), "rank")


@query(f"WITH {_P}, {_C.replace(_U + ', ', '').replace('m AS', 'm_ AS').replace('FROM m)', 'FROM m_)')}, s AS (SELECT n.id AS qid, c.label, list_dot_product(n.v, c.v) AS score FROM n, c), r AS (SELECT qid, label, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, label) AS rank FROM s) SELECT qid, label, score, rank FROM r WHERE rank <= 3")
def top4_closest_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each pair's offset, the three closest label centres."""
    got = vec9_pair_relation_scores(spark, sf_dir)
    ranked = got.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "label")).cast("long"))
    return ranked.where("rank <= 3").select(F.col("id").alias("qid"), "label", "score", "rank")


@query(f"WITH {_C}, d AS (SELECT u.id, u.label, round(list_dot_product(u.v, c.v), 6) AS s FROM u JOIN c USING (label)) SELECT label, arg_max(id, (s, -id)) AS id, max(s) AS score FROM d GROUP BY label")
def top7_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also CLU5: the member closest to its label's centre."""
    unit = _vectors(spark, sf_dir).select("id", "label", V.normalize(F.col("vec")).alias("v")).join(_centres(spark, sf_dir), "label")
    near = unit.select("id", "label", F.round(V.dot(F.col("v"), F.col("centre")), 6).alias("s"))
    return near.groupBy("label").agg(F.max_by("id", F.struct("s", -F.col("id"))).alias("id"), F.max("s").alias("score"))


@query(f"WITH {_C} SELECT label, (SELECT count(*) FROM u WHERE u.label = c.label) AS n, generate_subscripts(v, 1) - 1 AS i, round(unnest(v), 6) AS x FROM c")
def agg25_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centres(spark, sf_dir).select("label", "n", F.posexplode("centre").alias("i", "x")).select("label", "n", F.col("i").cast("long").alias("i"), rounded("x"))


@query(f"""WITH {_S}, left_ AS (SELECT qid, id, score FROM s WHERE id = qid + 1 OR label <> qlabel), g AS (SELECT qid, score AS g FROM s WHERE id = qid + 1)
SELECT qid, count(CASE WHEN round(score, 6) > round(g, 6) THEN 1 END) + 1 AS rank, round(1 / (count(CASE WHEN round(score, 6) > round(g, 6) THEN 1 END) + 1), 6) AS reciprocal FROM left_ JOIN g USING (qid) GROUP BY qid""")
def agg23_filtered_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also AGG29 and WIN7: the place of the next vector, where others of the query's label don't count."""
    v = _vectors(spark, sf_dir)
    q = v.where("id % 50 = 0").select(F.col("id").alias("qid"), "label", "vec", (F.col("id") + 1).alias("gold"))
    return V.gold_ranks(v, q).select("qid", "rank", rounded("reciprocal"))


_KNN = _S + ", r AS (SELECT qid, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rn FROM s WHERE qid <> id), d AS (SELECT qid, avg(1 - score) AS d FROM r WHERE rn <= 5 GROUP BY qid)"


@query(f"WITH {_KNN} SELECT qid, round(d, 6) AS d FROM d")
def win4_distance_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.mean_of_nearest(_scored(spark, sf_dir, k=7), 5).select("qid", rounded("d"))


@query(f"WITH {_KNN}, p AS (SELECT qid AS n, d, (lead(d, 4) OVER (ORDER BY d, qid) - d) / 4 AS slope FROM d), b AS (SELECT n, d, slope, lead(slope, 4) OVER (ORDER BY d, n) - slope AS bend FROM p) SELECT n, round(d, 6) AS d, round(slope, 6) AS slope, round(bend, 6) AS bend FROM b")
def win5_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = V.mean_of_nearest(_scored(spark, sf_dir, k=7), 5).select(F.col("qid").alias("n"), "d")
    return V.slopes(curve).select("n", rounded("d"), rounded("slope"), rounded("bend"))


@query(f"SELECT v.id, e.label, round(coalesce(e.embedding[1], 0)::DOUBLE, 6) AS first FROM {values([(i,) for i in (0, 7, 49, 10**9)], 'id')} LEFT JOIN embeddings e ON e.vec_id = v.id".replace("AS t(id)", "AS v(id)"))
def join16_vector_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also JOIN19: unknown ids get zeros."""
    asked = spark.createDataFrame([(i,) for i in (0, 7, 49, 10**9)], "id int")
    got = asked.join(_vectors(spark, sf_dir).withColumn("id", F.col("id").cast("int")), "id", "left")
    return got.select("id", "label", F.round(F.element_at(F.coalesce("vec", F.array_repeat(F.lit(0.0), WIDTH)), 1), 6).alias("first"))
