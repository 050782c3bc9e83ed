"""What every module of queries needs: the decorator that registers a query with its SQL, tables, and shared SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives its rows where there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


#: The most times that a keyword may occur in the SQL of queries over keywords.
CEILING = 60


def every_word(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Register a query over keywords a second time, as NAME_every_word: no word is too common for it. The SQL of the
    first has the ceiling; the second has none to compare with, and is tested by brute force."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(spark, sf_dir, None)

    run.__name__, run.__doc__ = f"{f.__name__}_every_word", f.__doc__
    QUERIES[run.__name__] = run
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the scan has fewer parts than these, as one small file would otherwise be one task.
    A scan of many parts stays as it is."""
    if df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], columns: str) -> str:
    """The same rows for SQL: (VALUES ...) AS t(columns) without the surrounding SELECT."""

    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        if isinstance(x, list):
            return "[" + ", ".join(map(one, x)) + "]"
        return f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({columns})"


def rounded(column: str, to: str | None = None) -> F.Column:
    return F.round(column, 6).alias(to or column)


#: White space as both regex dialects understand it.
WS = r"[ \t\n\x0B\f\r]"

SENTENCES = r"""cut AS (SELECT doc_id, string_split_regex(text, '[.!?\n]+') AS a FROM documents WHERE text IS NOT NULL),
sents AS (SELECT doc_id * 1000000 + generate_subscripts(a, 1) - 1 AS sent_id, unnest(a) AS sentence FROM cut)"""


def tokens_sql(least: int = 1) -> str:
    return SENTENCES + rf""",
words AS (SELECT sent_id, list_filter(string_split_regex(lower(sentence), '[^a-z0-9_]+'), lambda t: length(t) >= {least}) AS w FROM sents),
toks AS (SELECT sent_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS token FROM words)"""


TOKENS, LONG_TOKENS = tokens_sql(), tokens_sql(4)

OCCURRENCES = LONG_TOKENS + """,
dict AS (SELECT token, count(DISTINCT sent_id // 1000000) AS docs FROM toks GROUP BY token HAVING count(DISTINCT sent_id // 1000000) >= 5),
occ AS (SELECT DISTINCT token AS kw, sent_id FROM toks JOIN dict USING (token))"""

GRAPH = OCCURRENCES + """,
edge AS (SELECT a.kw AS u, b.kw AS v, count(*) AS c FROM occ a JOIN occ b ON a.sent_id = b.sent_id AND a.kw < b.kw GROUP BY 1, 2),
k AS (SELECT sent_id, count(*) - 1 AS n FROM occ GROUP BY 1),
node AS (SELECT kw, sum(n)::BIGINT AS c FROM occ JOIN k USING (sent_id) GROUP BY 1),
z AS (SELECT sum(c)::DOUBLE AS z FROM node),
graph AS (SELECT u, v, edge.c AS c, -ln(2.0e0 * z * edge.c / (a.c::DOUBLE * b.c)) / nullif(ln(2.0e0 * edge.c / z), 0) AS npmi
  FROM edge JOIN node a ON u = a.kw JOIN node b ON v = b.kw, z)"""
