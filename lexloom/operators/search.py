"""Full-text search over several fields, and related-keyword ranking.

Postings are one table (id, field, term, pos), so an index is that table written as parquet, and a search is a filter
by terms (which reaches the scan), a partial aggregation by record, and a top-k.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T

#: BM25's usual parameters.
B, K1 = 0.75, 1.2


def analyze(column: str, kind: str) -> Column:
    """Terms of a field: "text" has positions, "id" is one term, "keyword" is split at spaces."""
    if kind == "text":
        return T.word_tokens(column)
    value = F.lower(F.col(column).cast("string"))
    terms = F.array(value) if kind == "id" else F.split(value, " ")
    return F.filter(terms, lambda t: t.isNotNull() & (t != ""))


def postings(records: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """id, field, term, pos of all fields in one pass."""
    each = F.array(*[F.struct(F.lit(name).alias("field"), analyze(name, kind).alias("terms")) for name, kind in fields.items()])
    rows = records.select(F.col(key).alias("id"), F.explode(each).alias("f"))
    return rows.select("id", "f.field", F.posexplode("f.terms").alias("pos", "term")).select("id", "field", "term", "pos")


def terms_of(keyword: str, stops: Sequence[str] = T.QUERY_STOPS) -> list[str]:
    """A keyword's terms as the analyzer would give them, stop words left out."""
    import re

    return [t for t in re.split("[^a-z0-9_]+", keyword.lower()) if t and t not in stops]


def loose(index: DataFrame, query: str, fields: Sequence[str]) -> DataFrame:
    """id: records with any term of any keyword in any of the fields."""
    terms = sorted({t for k in T.parse_query(query) for t in terms_of(k)})
    return index.where(F.col("term").isin(*terms) & F.col("field").isin(*fields)).select("id").distinct()


def strict(index: DataFrame, query: str, fields: Sequence[str], positioned: Sequence[str]) -> DataFrame:
    """id: records that hold every keyword. One of several words must stand as a phrase in a positioned field, one of a
    single word anywhere in the fields. Phrases without a positioned field match nothing."""
    wanted = [w for k in T.parse_query(query) if (w := terms_of(k))]
    phrase_fields = [f for f in fields if f in positioned]
    if not wanted or (any(len(w) > 1 for w in wanted) and not phrase_fields):
        return index.select("id").where("false")
    # what each term may be part of: (number of the keyword, offset, length)
    parts: dict[str, list[tuple[int, int, int]]] = {}
    for i, words in enumerate(wanted):
        for j, t in enumerate(words):
            parts.setdefault(t, []).append((i, j, len(words)))
    role = lambda i, j, n: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(n).alias("n"))
    roles = reduce(lambda c, t: c.when(F.col("term") == t, F.array(*[role(*p) for p in parts[t]])), list(parts)[1:], F.when(F.col("term") == list(parts)[0], F.array(*[role(*p) for p in parts[list(parts)[0]]])))
    hits = index.where(F.col("term").isin(*parts) & F.col("field").isin(*fields)).select("id", "field", "pos", F.explode(roles).alias("r"))
    allowed = (F.col("r.n") == 1) | F.col("field").isin(*phrase_fields)
    whole = hits.where(allowed).groupBy("id", "field", "r.i", "r.n", F.when(F.col("r.n") > 1, F.col("pos") - F.col("r.j")).otherwise(-1).alias("start")).agg(F.count_distinct("r.j").alias("got")).where("got = n")
    return whole.groupBy("id").agg(F.count_distinct("i").alias("k")).where(F.col("k") == len(wanted)).select("id")


def bm25(index: DataFrame, query: str, fields: Sequence[str], limit: int | None = 5) -> DataFrame:
    """id, score: for each field and term, idf = ln(N / (n + 1)) + 1 times the saturated frequency, added up.

    Lengths and frequencies come from one aggregation by record and field, which the fields' totals read too.
    """
    terms = sorted({t for k in T.parse_query(query) for t in terms_of(k)})
    tf = [f"tf{i}" for i in range(len(terms))]
    counted = index.where(F.col("field").isin(*fields)).groupBy("id", "field").agg(F.count("*").alias("len"), *[F.count_if(F.col("term") == t).alias(c) for t, c in zip(terms, tf, strict=True)])
    totals = counted.groupBy("field").agg(F.avg("len").alias("mean"), F.count("*").alias("docs"), *[F.count_if(F.col(c) > 0).alias(f"n_{c}") for c in tf])  # a row a field
    some = reduce(lambda x, c: x | (F.col(c) > 0), tf, F.lit(False))
    both = counted.where(some).join(F.broadcast(totals), "field")

    def weight(c: str) -> Column:
        idf = F.ln(F.col("docs") / (F.col(f"n_{c}") + 1)) + 1
        return F.when(F.col(c) > 0, idf * F.col(c) * (K1 + 1) / (F.col(c) + K1 * (1 - B + B * F.col("len") / F.col("mean")))).otherwise(0.0)

    scored = both.groupBy("id").agg(F.round(F.sum(reduce(lambda x, c: x + weight(c), tf, F.lit(0.0))), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(limit) if limit else scored


def fetch(records: DataFrame, key: str, hits: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The hits' records, unknown field names left out; hyphens in names count as underscores."""
    known = [f.replace("-", "_") for f in fields if f.replace("-", "_") in records.columns]
    if not known:
        return hits.where("false")
    return hits.join(records.select(F.col(key).alias("id"), *known), "id").select(*hits.columns, *known)


def suggestion_weights(index: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """index (keyword, related array) -> word, weight: how often the query keywords' entries list each word."""
    return index.where(F.col("keyword").isin(*keywords)).select(F.explode("related").alias("word")).groupBy("word").agg(F.count("*").alias("weight"))


def related(index: DataFrame, keywords: Sequence[str], limit: int | None = 5) -> DataFrame:
    """keyword, score, overlap: every entry that shares words with the query, by the words' weights (repeats count),
    ties by keyword; the overlap lists them in the entry's order."""
    words = index.select("keyword", F.posexplode("related").alias("pos", "word"))
    met = words.join(suggestion_weights(index, keywords), "word")
    scored = met.groupBy("keyword").agg(F.sum("weight").alias("score"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("overlap"))
    return scored.orderBy(F.desc("score"), "keyword").limit(limit) if limit else scored
