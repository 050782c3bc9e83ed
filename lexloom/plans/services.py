"""The services' queries as functions: each takes tables and parameters and gives a status and a DataFrame.

Status 1 means found, 0 that a keyword is unknown. Flags are real booleans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import clustering, corpus, search, vectors
from lexloom.operators.cooccurrence import Numbered
from lexloom.operators.graph import expand
from lexloom.sources.files import stored


def search_papers(records: DataFrame, index: DataFrame, key: str, keywords: str, fields: Sequence[str], positioned: Sequence[str], is_strict: bool = False, limit: int = 5, highlight: bool = False, show: Sequence[str] = ()) -> DataFrame:
    """The best records by rank; those of strict search must hold every keyword."""
    ranked = search.bm25(index, keywords, fields, None)
    if is_strict:
        ranked = ranked.join(search.strict(index, keywords, fields, positioned), "id", "left_semi")
    best = ranked.orderBy(F.desc("score"), "id").limit(limit)
    found = search.fetch(records, key, best, show or fields)
    terms = [t for k in T.parse_query(keywords) for t in search.terms_of(k)]
    if highlight and terms:
        found = found.select(*[T.search_highlight(c, terms).alias(c) if c in fields else c for c in found.columns])
    return found.orderBy(F.desc("score"), "id")


def get_paper(records: DataFrame, key: str, value: object) -> DataFrame:
    return records.where(F.col(key) == value).limit(1)


def search_related(index: DataFrame, keywords: str, local: bool = True, suggestions: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """Related keywords by overlap. Not ``local``, the words come from a table of suggestions (query, suggestions)
    instead of the index's own entries."""
    asked = T.parse_query(keywords, lower=True)
    if not local and suggestions is not None:
        own = suggestions.where(F.col("query").isin(*asked)).select(F.col("query").alias("keyword"), T.suggestion_words("query", "suggestions").alias("related"))
        words = index.select("keyword", F.posexplode("related").alias("pos", "word")).join(search.suggestion_weights(own, asked), "word")
        scored = words.groupBy("keyword").agg(F.sum("weight").alias("score"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("overlap"))
        return scored.orderBy(F.desc("score"), "keyword").limit(limit)
    return search.related(index, asked, limit)


def neighbours(vecs: DataFrame, centre: int, threshold: float) -> tuple[int, DataFrame]:
    """Vectors at least so similar: by topic, function or graph, as the table of vectors is."""
    mine = vecs.where(F.col("id") == centre).select(F.col("id").alias("qid"), "vec")
    got = vectors.scores(vecs, mine, least=threshold)
    return int(not mine.isEmpty()), got.where("id <> qid").orderBy(F.desc("score"), "id")


def pair_neighbours(edges: DataFrame, keyword: str, least: int = 5, score: float = 0.15) -> DataFrame:
    """Keywords tied to one, by the pair table's two-decimal score."""
    kept = corpus.pair_filter(edges.withColumn("npmi", F.round("npmi", 2)), least, score)
    return corpus.neighbours(kept).where(F.col("src") == keyword)


def clusters(edges: DataFrame, vecs: DataFrame, keyword: str, k: int = 3) -> DataFrame:
    """The keyword's related ones, clustered from dense to sparse by their vectors (token, vec); -1 is noise."""
    near = pair_neighbours(edges, keyword).select(F.col("dst").alias("token"))
    return clustering.by_group(vecs.join(near, "token", "left_semi").select(F.lit(keyword).alias("keyword"), "token", "vec"), "keyword", "token", "vec", lambda x: clustering.varied_density(x, k))


def closest_relations(pairs: DataFrame, relations: DataFrame, patterns: DataFrame, n: int = 5, show_entity: bool = True) -> DataFrame:
    """pairs (id, x, y, vec), relations (id, vec), patterns (id, pattern) -> the n relations closest to each pair's
    vector, with the pair's names in their places if wanted."""
    got = vectors.scores(relations, pairs.select(F.col("id").alias("qid"), "vec"), k=n)
    named = got.join(patterns, "id").join(pairs.select(F.col("id").alias("qid"), "x", "y"), "qid")
    text = T.fill_placeholders("pattern", "x", "y") if show_entity else F.col("pattern")
    return named.select("qid", "rank", F.round("score", 6).alias("score"), T.cut_pad(text).alias("relation"))


def top_relations(records: DataFrame, n: int = 10) -> DataFrame:
    """records (relation, sent_id) -> the most frequent relations, each with its first sentence."""
    counts = records.groupBy("relation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation").limit(n)
    first = records.withColumn("r", F.row_number().over(Window.partitionBy("relation").orderBy("sent_id"))).where("r = 1").select("relation", "sent_id")
    return counts.join(first, "relation").orderBy(F.desc("n"), "relation")


def keyword_tree(vecs: DataFrame, centre: int, related: float, together: float, width: int) -> DataFrame:
    """One level of hierarchical expansion; representatives are the next centres."""
    return expand(vecs, centre, related, together, width)


def prepare(docs: DataFrame, least_docs: int = 5, score: float = 0.3, least: int = 3) -> dict[str, DataFrame]:
    """The corpus pipeline: sentences, tokens, dictionary, occurrences, pair graph, strong edges; ``pairs`` are the edges
    by their words' numbers. What later steps read more than once is stored."""
    sents = corpus.sentences(docs)
    toks = corpus.document_tokens(docs, 4)
    words = stored(corpus.document_dictionary(docs, least_docs, 4), "dictionary")
    numbered = Numbered(docs, words, 4)
    occ, nodes = numbered.named(numbered.occurrences()), numbered.named(numbered.nodes())
    strong = stored(corpus.subgraph(numbered.graph(least, score), score, least), "strong")
    return {"sentences": sents, "tokens": toks, "dictionary": words, "occurrences": occ, "edges": numbered.graph(), "pairs": numbered.counts(), "nodes": nodes, "strong": strong}
