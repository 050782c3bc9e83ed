"""Queries of the search operators: postings, loose and strict search, ranking, related keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import search as S
from lexloom.plans.base import documents, query, spread, table

FIELDS = {"p_name": "text", "p_brand": "id", "p_type": "keyword"}

_POST = """post AS (SELECT p_partkey AS id, 'p_name' AS field, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS term FROM (SELECT p_partkey, list_filter(string_split_regex(lower(p_name), '[^a-z0-9_]+'), lambda t: t <> '') AS w FROM part)
UNION ALL SELECT p_partkey, 'p_brand', 0, lower(p_brand) FROM part
UNION ALL SELECT p_partkey, 'p_type', generate_subscripts(w, 1) - 1, unnest(w) FROM (SELECT p_partkey, string_split(lower(p_type), ' ') AS w FROM part))"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.postings(table(spark, sf_dir, "part"), "p_partkey", FIELDS)


@query(f"WITH {_POST} SELECT id, field, term, pos::INTEGER AS pos FROM post")
def srh1_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)


@query(f"WITH {_POST} SELECT DISTINCT id FROM post WHERE term IN ('small', 'ring', 'economy') AND field IN ('p_name', 'p_type')")
def srh2_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.loose(_index(spark, sf_dir), "Small ring; the; economy", ["p_name", "p_type"])


@query(f"WITH {_POST} SELECT DISTINCT a.id FROM post a JOIN post b ON a.id = b.id AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.term = 'small' AND b.term = 'ring' AND a.field = 'p_name' AND a.id IN (SELECT id FROM post WHERE term = 'economy')")
def srh3_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase and a single word."""
    return S.strict(_index(spark, sf_dir), "small ring;economy", list(FIELDS), ["p_name"])


@query(r"SELECT doc_id AS id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])eriner[^a-z0-9_]+thanea($|[^a-z0-9_])')")
def srh3_phrase_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.strict(S.postings(spread(documents(spark, sf_dir)), "doc_id", {"text": "text"}), "eriner thanea", ["text"], ["text"])


_BM25 = """p AS (SELECT doc_id AS id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda t: t <> '')) AS term FROM documents),
l AS (SELECT id, count(*) AS len FROM p GROUP BY id), m AS (SELECT avg(len) AS mean, count(*) AS docs FROM l), tf AS (SELECT id, term, count(*) AS tf FROM p WHERE term IN ('tion', 'this', 'that') GROUP BY 1, 2), df AS (SELECT term, count(*) AS n FROM tf GROUP BY 1),
scored AS (SELECT id, round(sum((ln(docs::DOUBLE / (n + 1)) + 1) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN l USING (id), m GROUP BY id)"""


@query(f"WITH {_BM25} SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 25")
def srh4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also TOP5: the best 25 documents."""
    return S.bm25(S.postings(spread(documents(spark, sf_dir)), "doc_id", {"text": "text"}), "tion this; that", ["text"], 25)


@query(f"WITH {_POST} SELECT DISTINCT p_partkey AS id, p_name, p_type FROM part WHERE p_partkey IN (SELECT id FROM post WHERE term = 'ring')")
def srh5_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown fields are ignored, hyphens in names are underscores."""
    hits = S.loose(_index(spark, sf_dir), "ring", list(FIELDS))
    return S.fetch(table(spark, sf_dir, "part"), "p_partkey", hits, ["p-name", "nothing", "p_type"])


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_partkey = 17 LIMIT 1")
def srh6_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey = 17").select("p_partkey", "p_name", "p_brand", "p_type").limit(1)


_REL = "rel AS (SELECT p_name AS keyword, list(w ORDER BY p_partkey, j) AS related FROM (SELECT p_partkey, p_name, unnest([lower(p_brand), lower(p_type)]) AS w, unnest([0, 1]) AS j FROM part) GROUP BY p_name)"


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and types of the parts of each name, with repeats."""
    parts = table(spark, sf_dir, "part").select("p_name", "p_partkey", F.array(F.lower("p_brand"), F.lower("p_type")).alias("w"))
    return parts.groupBy(F.col("p_name").alias("keyword")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "w"))), lambda x: x["w"])).alias("related"))


_ASKED = ["small ring", "red widget"]


@query(f"WITH {_REL} SELECT keyword, array_to_string(related, ' ') AS related FROM rel WHERE keyword IN ('small ring', 'red widget')")
def srh7_local_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _related(spark, sf_dir).where(F.col("keyword").isin(*_ASKED)).select("keyword", F.array_join("related", " ").alias("related"))


_WEIGHT = _REL + ", w AS (SELECT word, count(*) AS weight FROM (SELECT unnest(related) AS word FROM rel WHERE keyword IN ('small ring', 'red widget')) GROUP BY word)"


@query(f"WITH {_WEIGHT} SELECT word, weight FROM w")
def agg17_suggestion_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.suggestion_weights(_related(spark, sf_dir), _ASKED)


@query(f"WITH {_WEIGHT} SELECT keyword, sum(weight)::BIGINT AS score, array_to_string(list(word ORDER BY pos), ' ') AS overlap FROM (SELECT keyword, generate_subscripts(related, 1) AS pos, unnest(related) AS word FROM rel) JOIN w USING (word) GROUP BY keyword")
def agg18_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.related(_related(spark, sf_dir), _ASKED, None).select("keyword", "score", F.array_join("overlap", " ").alias("overlap"))


@query(f"WITH {_WEIGHT} SELECT keyword, sum(weight)::BIGINT AS score FROM (SELECT keyword, unnest(related) AS word FROM rel) JOIN w USING (word) GROUP BY keyword ORDER BY score DESC, keyword LIMIT 5")
def srh8_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also TOP6: the five best, ties in order of retrieval."""
    return S.related(_related(spark, sf_dir), _ASKED).select("keyword", "score")


@query(f"WITH {_REL} SELECT keyword, len(related)::BIGINT AS n FROM rel UNION ALL SELECT 'new keyword', 2")
def srh9_expand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SRC27: an index is built where none is, and entries are appended to it."""
    from lexloom.sources.files import open_or_build, shared_dir

    path = shared_dir(spark, "index")
    for _ in range(2):
        index = open_or_build(spark, path, lambda: _related(spark, sf_dir))
    spark.createDataFrame([("new keyword", ["a", "b"])], index.schema).write.mode("append").parquet(path)
    return spark.read.schema(index.schema).parquet(path).select("keyword", F.size("related").cast("long").alias("n"))


@query("SELECT conv_id, turn, regexp_replace(text, '(?i)\\b(thand|onen)\\b', '<b class=\"match\">\\1</b>', 'g') AS html FROM conversations WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])(thand|onen)($|[^a-z0-9_])')")
def search_with_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paper search of the service: loose, highlighted."""
    said = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    hits = S.loose(S.postings(said, "id", {"text": "text"}), "thand;onen", ["text"])
    return said.join(hits, "id", "left_semi").select("conv_id", "turn", T.search_highlight("text", ["thand", "onen"]).alias("html"))
