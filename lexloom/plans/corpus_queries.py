"""Queries over the corpus: vocabularies, occurrences, the pair graph, windows and phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import corpus as C
from lexloom.operators import phrases as P
from lexloom.operators.cooccurrence import Numbered
from lexloom.plans.base import CEILING, GRAPH, LONG_TOKENS, OCCURRENCES, SENTENCES, TOKENS, documents, every_word, literal, query, rounded, spread, table, values
from lexloom.sources.files import stored


def _toks(spark: SparkSession, sf_dir: str, least: int = 1) -> DataFrame:
    return C.document_tokens(spread(documents(spark, sf_dir)), least)


def _occ(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(documents(spark, sf_dir))
    return C.occurrences(C.document_tokens(docs, 4), C.document_dictionary(docs, least=4))


def _numbered(spark: SparkSession, sf_dir: str) -> Numbered:
    docs = spread(documents(spark, sf_dir))
    return Numbered(docs, C.document_dictionary(docs, least=4), 4)


def _graph(spark: SparkSession, sf_dir: str, least: int = 1) -> DataFrame:
    return _numbered(spark, sf_dir).graph(least)


def _strong(spark: SparkSession, sf_dir: str, words: Numbered | None = None) -> DataFrame:
    """Strong edges, which most queries read several times."""
    words = words or _numbered(spark, sf_dir)
    return stored(C.subgraph(words.graph(3, 0.3)), "strong")


_STRONG = GRAPH + ", strong AS (SELECT * FROM graph WHERE npmi > 0.3 AND c >= 3)"


@query(f"WITH {GRAPH} SELECT u, v, c, round(npmi, 6) AS npmi FROM graph WHERE npmi > 0.3 AND c >= 3 ORDER BY round(npmi, 6) DESC, c DESC, u, v LIMIT 20")
def related_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the strongest pairs of the corpus."""
    return C.subgraph(_numbered(spark, sf_dir).graph(3, 0.3)).select("u", "v", "c", rounded("npmi")).orderBy(F.desc("npmi"), F.desc("c"), "u", "v").limit(20)


# joins


@query(f"WITH {OCCURRENCES} SELECT kw, sent_id FROM occ")
def join1_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occ(spark, sf_dir)


@query(f"""WITH {TOKENS}, v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS id FROM toks GROUP BY token HAVING count(*) >= 5),
b AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda t: t <> '')) AS token FROM benchmark)
SELECT item_id, token, coalesce(id, 0) AS id FROM b LEFT JOIN v USING (token)""")
def join2_vocabulary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = C.vocabulary(C.token_counts(_toks(spark, sf_dir), 5))
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.word_tokens("text")).alias("token"))
    return C.numericalize(words, vocab).select("item_id", "token", "id")


_BASKETS = "basket AS (SELECT DISTINCT l_orderkey AS sent_id, p_brand AS kw FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("p_brand").alias("kw"), F.col("l_orderkey").alias("sent_id")).distinct()


@query(f"WITH {_BASKETS} SELECT a.sent_id, a.kw AS u, b.kw AS v FROM basket a JOIN basket b ON a.sent_id = b.sent_id AND a.kw < b.kw")
def join3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that one order holds, each pair once."""
    return C.pairs(C.sentence_sets(_baskets(spark, sf_dir)))


def _phrase_sql(least: int = 8) -> str:
    return TOKENS + f""",
grams AS (SELECT w[i] || ' ' || w[i + 1] AS phrase FROM (SELECT w, unnest(range(1, len(w))) AS i FROM words)
  UNION ALL SELECT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM words)),
phrases AS (SELECT phrase FROM grams GROUP BY phrase HAVING count(*) >= {least})"""


def _phrases(docs: DataFrame, least: int = 8) -> DataFrame:
    """Word bigrams and trigrams that occur so often."""
    return stored(P.document_phrases(docs, (2, 3), least), "phrases")


@query(f"""WITH {_phrase_sql()}, g AS (
  SELECT sent_id, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS phrase FROM (SELECT sent_id, w, unnest(range(1, len(w))) AS i FROM words)
  UNION ALL SELECT sent_id, i - 1, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT sent_id, w, unnest(range(1, len(w) - 1)) AS i FROM words))
SELECT sent_id, pos::INTEGER AS pos, phrase FROM g JOIN phrases USING (phrase)""")
def join4_phrase_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(documents(spark, sf_dir))
    return P.document_matches(docs, _phrases(docs))


@query()
def join5_reform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent phrases of the corpus as entities. The walk in SQL takes minutes; tests compare it with a loop."""
    docs = spread(documents(spark, sf_dir))
    return P.document_reform(docs, _phrases(docs))


@query(f"WITH {_STRONG} SELECT a.sent_id, a.kw AS u, b.kw AS v FROM occ a JOIN occ b ON a.sent_id = b.sent_id AND a.kw < b.kw SEMI JOIN strong ON u = a.kw AND v = b.kw")
def join6_pairs_in_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _numbered(spark, sf_dir)
    return words.tied(_strong(spark, sf_dir, words))


_NEAR = _STRONG + ", near AS (SELECT u AS src, v AS dst, c, npmi FROM strong UNION ALL SELECT v, u, c, npmi FROM strong)"


@query(f"WITH {_NEAR} SELECT src, dst, c, round(npmi, 6) AS npmi FROM near")
def join7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.neighbours(_strong(spark, sf_dir)).select("src", "dst", "c", rounded("npmi"))


@query(f"WITH {_NEAR} SELECT s.u AS a, s.v AS b, x.dst AS mid FROM strong s JOIN near x ON x.src = s.u JOIN near y ON y.src = s.v AND y.dst = x.dst")
def join8_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords linked to both ends of a strong pair."""
    edges = _strong(spark, sf_dir)
    return C.bridges(edges, edges.select(F.col("u").alias("a"), F.col("v").alias("b")))


@query(f"""WITH {_STRONG}, once AS (SELECT sent_id, token, min(pos) AS pos FROM toks GROUP BY 1, 2 HAVING count(*) = 1),
size AS (SELECT sent_id FROM toks GROUP BY 1 HAVING max(pos) + 1 <= 32)
SELECT x.sent_id, u AS a, v AS b, abs(x.pos - y.pos)::INTEGER AS distance FROM strong JOIN once x ON x.token = u JOIN once y ON y.token = v AND y.sent_id = x.sent_id
SEMI JOIN size ON size.sent_id = x.sent_id WHERE abs(x.pos - y.pos) <= 6""")
def join9_shared_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short sentences that hold both ends of a strong pair, each once and near each other."""
    words = _numbered(spark, sf_dir)
    return words.shared_sentences(_strong(spark, sf_dir, words))


_CTX = f"""{TOKENS}, key AS (SELECT token FROM toks GROUP BY token HAVING count(*) BETWEEN 20 AND 60 AND length(token) >= 4),
marked AS (SELECT sent_id, pos, token FROM toks SEMI JOIN key USING (token)),
ctx AS (SELECT a.sent_id, a.token AS x, b.token AS y, list_concat(list_concat(['<X>'], list_slice(w, a.pos + 2, b.pos)), ['<Y>']) AS c
  FROM marked a JOIN marked b ON a.sent_id = b.sent_id AND b.pos > a.pos AND b.pos - a.pos < 8 JOIN words ON words.sent_id = a.sent_id)"""


def _ctx(spark: SparkSession, sf_dir: str, most: int | None = CEILING) -> DataFrame:
    """Of words of four letters that occur 20 times, and at most ``most`` times if that is set."""
    docs = spread(documents(spark, sf_dir))
    keys = C.document_counts(docs, 20).where("length(token) >= 4")
    return C.document_pair_contexts(docs, keys if most is None else keys.where(F.col("cn") <= most))


@every_word
@query(f"WITH {_CTX} SELECT sent_id, x, y, array_to_string(list_slice(list_concat(c, list_transform(range(8), lambda i: '<pad>')), 1, 8), ' ') AS ctx FROM ctx")
def join10_pair_contexts(spark: SparkSession, sf_dir: str, most: int | None = CEILING) -> DataFrame:
    return _ctx(spark, sf_dir, most).select("sent_id", "x", "y", F.array_join("ctx", " ").alias("ctx"))


@query(f"""WITH {OCCURRENCES}, known AS (SELECT sent_id, token, row_number() OVER (PARTITION BY sent_id ORDER BY pos) AS p FROM toks SEMI JOIN dict USING (token))
SELECT least(a.token, b.token) AS a, greatest(a.token, b.token) AS b, count(*) AS c FROM known a JOIN known b ON a.sent_id = b.sent_id AND b.p > a.p AND b.p - a.p <= 6 GROUP BY 1, 2""")
def join11_window_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also WIN3: places are counted anew among the known words."""
    toks = _toks(spark, sf_dir, 4)
    return C.window_pairs(toks.join(C.dictionary(toks), "token", "left_semi"))


_SKIP = TOKENS + """, v AS (SELECT token FROM toks GROUP BY token HAVING count(*) >= 20), known AS (SELECT sent_id, pos, token FROM toks SEMI JOIN v USING (token)),
skip AS (SELECT a.token AS word, 'l' || (b.pos - a.pos) || '_' || b.token AS context FROM known a JOIN known b ON a.sent_id = b.sent_id AND b.pos <> a.pos AND abs(b.pos - a.pos) <= 2)"""


def _vocabulary(spark: SparkSession, sf_dir: str) -> Numbered:
    """Sentences by the numbers of words that occur 20 times."""
    docs = spread(documents(spark, sf_dir))
    return Numbered(docs, C.document_counts(docs, 20))


def _skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, context, n."""
    return _vocabulary(spark, sf_dir).skipgrams()


@query(f"WITH {_SKIP} SELECT word, context, count(*) AS n FROM skip GROUP BY 1, 2")
def join12_skipgrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skip(spark, sf_dir)


@query(f"""WITH {LONG_TOKENS}, b AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda t: length(t) >= 4)) AS token FROM benchmark)
SELECT token, count(*) AS cn FROM toks ANTI JOIN b USING (token) GROUP BY token""")
def anti_join_novel_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the corpus that the benchmark doesn't have."""
    known = table(spark, sf_dir, "benchmark").select(F.explode(T.word_tokens("text")).alias("token")).distinct()
    return C.token_counts(_toks(spark, sf_dir, 4).join(known, "token", "left_anti"))


# aggregations


@query(f"WITH {TOKENS} SELECT token, count(*) AS cn FROM toks GROUP BY token HAVING count(*) >= 2")
def agg1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.token_counts(_toks(spark, sf_dir), 2)


@query("SELECT event_type AS token, count(*) AS cn FROM events GROUP BY 1")
def agg2_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each day, written as lines, some of them broken, and added up."""
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").count()
    lines = days.select(F.concat_ws(" ", "event_type", "count").alias("line")).union(literal(spark, [("broken",), ("x y z",)], "line string"))
    return C.merge_counts(lines.select(F.split("line", " ").alias("p")).select(F.col("p")[0].alias("token"), F.when(F.size("p") == 2, F.try_to_number(F.get("p", F.lit(1)), F.lit("999999999")).cast("long")).alias("cn")))


@query(f"""WITH {TOKENS}, v AS (SELECT token, count(*) AS cn FROM toks GROUP BY token HAVING count(*) >= 3)
SELECT row_number() OVER (ORDER BY cn DESC, token) + 3 AS id, token, cn FROM v UNION ALL SELECT * FROM {values([(0, '<unk>', 0), (1, '<pad>', 0), (2, '<X>', 0), (3, '<Y>', 0)], 'id, token, cn')}""")
def agg3_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also AGG6 and WIN1: ids by falling count behind the special tokens."""
    return C.vocabulary(C.token_counts(_toks(spark, sf_dir), 3), (T.UNK, T.PAD, "<X>", "<Y>"))


@query(f"WITH {_SKIP} SELECT 'word' AS kind, word AS token, count(*) AS cn FROM skip GROUP BY 2 HAVING count(*) >= 5 UNION ALL SELECT 'context', context, count(*) FROM skip GROUP BY 2 HAVING count(*) >= 5")
def agg4_word_context_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _skip(spark, sf_dir).select(F.explode(F.array(F.struct(F.lit("word").alias("kind"), F.col("word").alias("token")), F.struct(F.lit("context").alias("kind"), F.col("context").alias("token")))).alias("x"), "n")
    return both.groupBy("x.kind", "x.token").agg(F.sum("n").alias("cn")).where("cn >= 5")


@query(f"WITH {_SKIP}, c AS (SELECT context FROM skip GROUP BY 1 HAVING count(*) >= 5) SELECT regexp_extract(context, '^(prep_[^_]*|[^_]*)', 1) AS relation, count(*) AS n FROM c GROUP BY 1")
def agg5_relation_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts that survive the threshold, by relation."""
    kept = _skip(spark, sf_dir).groupBy("context").agg(F.sum("n").alias("count")).where("count >= 5")
    return kept.groupBy(T.relation_prefix("context").alias("relation")).agg(F.count("*").alias("n"))


@query(f"WITH {OCCURRENCES} SELECT kw, count(*) AS n FROM occ GROUP BY kw")
def agg7_merge_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of two halves of the corpus, united."""
    toks = _toks(spark, sf_dir, 4)
    words = C.dictionary(toks)
    halves = [C.occurrences(toks.where(F.col("sent_id") % 2 == k), words) for k in (0, 1)]
    return halves[0].union(halves[1]).distinct().groupBy("kw").agg(F.count("*").alias("n"))


@query(f"WITH {OCCURRENCES} SELECT sent_id, array_to_string(list(kw ORDER BY kw), ' ') AS kws FROM occ GROUP BY sent_id")
def agg8_sentence_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sentence_sets(_occ(spark, sf_dir)).select("sent_id", F.array_join("kws", " ").alias("kws"))


@query(f"WITH {GRAPH} SELECT kw, c, (SELECT z::BIGINT FROM z) AS z FROM node")
def agg9_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = C.pair_graph(C.sentence_sets(_occ(spark, sf_dir)))[1]
    return nodes.crossJoin(F.broadcast(nodes.agg(F.sum("c").alias("z"))))  # one row


@query(f"WITH {_BASKETS}, edge AS (SELECT a.kw AS u, b.kw AS v, count(*) AS c FROM basket a JOIN basket b ON a.sent_id = b.sent_id AND a.kw < b.kw GROUP BY 1, 2), k AS (SELECT sent_id, count(*) - 1 AS n FROM basket GROUP BY 1), node AS (SELECT kw, sum(n)::DOUBLE AS c FROM basket JOIN k USING (sent_id) GROUP BY 1), z AS (SELECT sum(c) AS z FROM node) SELECT u, v, edge.c AS c, round(-ln(2.0e0 * z * edge.c / (a.c * b.c)) / nullif(ln(2.0e0 * edge.c / z), 0), 6) AS npmi FROM edge JOIN node a ON u = a.kw JOIN node b ON v = b.kw, z")
def agg10_npmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of brands in orders."""
    return C.pair_graph(C.sentence_sets(_baskets(spark, sf_dir)))[0].select("u", "v", "c", rounded("npmi"))


@query(f"WITH {GRAPH} SELECT u AS w0, v AS w1, c AS freq FROM graph WHERE c >= 2")
def agg11_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir, 2).select(F.col("u").alias("w0"), F.col("v").alias("w1"), F.col("c").alias("freq"))


@query(f"""WITH {_SKIP}, t AS (SELECT word, regexp_replace(context, '^[^_]*_', '') AS target FROM skip), p AS (SELECT least(word, target) AS w0, greatest(word, target) AS w1 FROM t WHERE word <> target AND target IN (SELECT token FROM v))
SELECT w0, w1, count(*) AS freq FROM p GROUP BY 1, 2""")
def agg12_semantic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered pairs of words and the words of their contexts."""
    pairs = _vocabulary(spark, sf_dir).skipgram_pairs()
    return pairs.select(F.col("u").alias("w0"), F.col("v").alias("w1"), F.col("n").alias("freq"))


@every_word
@query(f"WITH {_CTX} SELECT array_to_string(c, ' ') AS ctx, count(*) AS n FROM ctx GROUP BY 1")
def agg13_unique_contexts(spark: SparkSession, sf_dir: str, most: int | None = CEILING) -> DataFrame:
    """Least frequent first."""
    kept = _ctx(spark, sf_dir, most).select(F.filter("ctx", lambda t: t != "<pad>").alias("c"))
    return kept.groupBy(F.array_join("c", " ").alias("ctx")).agg(F.count("*").alias("n")).orderBy("n", "ctx")


@query(f"WITH {TOKENS}, v AS (SELECT token, count(*) AS cn FROM toks GROUP BY token) SELECT token, cn, round(pow(cn::DOUBLE, 0.75e0) / sum(pow(cn::DOUBLE, 0.75e0)) OVER (), 9) AS p FROM v")
def agg14_sampling_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sampling_table(C.token_counts(_toks(spark, sf_dir))).select("token", "cn", F.round("p", 9).alias("p"))


@query(f"WITH {TOKENS}, l AS (SELECT len(w)::BIGINT AS n, count(*) AS rows FROM words GROUP BY 1), r AS (SELECT n, rows, sum(rows) OVER (ORDER BY n) AS run, sum(rows) OVER () AS whole FROM l) SELECT n, rows, round(run::DOUBLE / whole, 6) AS cover, run >= 0.9e0 * whole AS enough FROM r")
def agg19_length_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also WIN2: the running share of sentences by their number of words."""
    cut = C.sentences(spread(documents(spark, sf_dir))).select(F.size(T.word_tokens("sentence")).cast("long").alias("n"))
    return C.length_cover(cut).select("n", "rows", rounded("cover"), "enough")


@query(f"WITH {SENTENCES} SELECT (SELECT count(*) FROM sents) AS lines, sent_id, sentence FROM sents ORDER BY sent_id LIMIT 10000")
def agg20_test_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 10,000 sentences, beside the number of all."""
    sents = C.sentences(spread(documents(spark, sf_dir)))
    return sents.orderBy("sent_id").limit(10_000).crossJoin(F.broadcast(sents.agg(F.count("*").alias("lines"))))  # one row


@query(f"""WITH {_STRONG}, tied AS (SELECT a.sent_id, a.kw AS u, b.kw AS v FROM occ a JOIN occ b ON a.sent_id = b.sent_id AND a.kw < b.kw SEMI JOIN strong ON u = a.kw AND v = b.kw),
both_ AS (SELECT sent_id, u AS kw, v AS o FROM tied UNION ALL SELECT sent_id, v, u FROM tied)
SELECT sent_id, kw, array_to_string(list(DISTINCT o ORDER BY o), ',') AS related FROM both_ GROUP BY 1, 2 HAVING count(DISTINCT o) >= 2""")
def agg21_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _numbered(spark, sf_dir)
    return words.hubs(_strong(spark, sf_dir, words))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(avg((value > 10)::INTEGER)::DOUBLE, 6) AS positive, round(avg((value <= 10)::INTEGER)::DOUBLE, 6) AS negative FROM events GROUP BY 1")
def agg22_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss, and shares on either side of a threshold."""
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), rate(F.col("value") > 10).alias("positive"), rate(F.col("value") <= 10).alias("negative"))


@query(f"WITH {TOKENS} SELECT token, count(*) AS cn FROM (SELECT token FROM toks UNION ALL SELECT unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda t: t <> '')) FROM conversations) GROUP BY 1 HAVING count(*) >= 4")
def agg24_field_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over two sources of one field."""
    said = table(spark, sf_dir, "conversations").select(F.explode(T.word_tokens("text")).alias("token"))
    return C.token_counts(_toks(spark, sf_dir).select("token").unionByName(said), 4)


@query(f"WITH {OCCURRENCES}, top AS (SELECT kw FROM occ GROUP BY kw ORDER BY count(*) DESC, kw LIMIT 1), s AS (SELECT sent_id FROM occ SEMI JOIN top USING (kw)) SELECT kw, count(*) AS n FROM occ SEMI JOIN s USING (sent_id) WHERE kw NOT IN (SELECT kw FROM top) GROUP BY kw ORDER BY n DESC, kw LIMIT 100")
def agg26_beside_one_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 keywords that most often share a sentence with the commonest one."""
    occ = _occ(spark, sf_dir)
    top = occ.groupBy("kw").count().orderBy(F.desc("count"), "kw").limit(1).select("kw")
    mine = occ.join(F.broadcast(top), "kw", "left_semi").select("sent_id")  # one row
    beside = occ.join(mine, "sent_id", "left_semi").join(F.broadcast(top), "kw", "left_anti")
    return beside.groupBy("kw").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kw").limit(100)


@query(f"WITH {TOKENS}, v AS (SELECT token, count(*) AS n FROM toks GROUP BY token) SELECT token, n, row_number() OVER (ORDER BY length(token) <> 1, n DESC, token) AS id FROM v")
def agg27_subword_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single characters first, then by falling count."""
    counts = C.token_counts(_toks(spark, sf_dir))
    ranked = counts.select("token", F.when(F.length("token") == 1, F.col("cn") + (1 << 50)).otherwise(F.col("cn")).alias("cn"))
    return C.vocabulary(ranked, ()).select("token", F.when(F.length("token") == 1, F.col("cn") - (1 << 50)).otherwise(F.col("cn")).alias("n"), (F.col("id") + 1).alias("id"))


@every_word
@query(f"WITH {_CTX} SELECT x, array_to_string(list_slice(c, 1, 3), ' ') AS span, count(*) AS n FROM ctx GROUP BY 1, 2 HAVING count(*) >= 2")
def agg28_spans(spark: SparkSession, sf_dir: str, most: int | None = CEILING) -> DataFrame:
    """Distinct openings of contexts by keyword."""
    kept = _ctx(spark, sf_dir, most).select("x", F.slice(F.filter("ctx", lambda t: t != "<pad>"), 1, 3).alias("s"))
    return kept.groupBy("x", F.array_join("s", " ").alias("span")).agg(F.count("*").alias("n")).where("n >= 2")


# filters on pairs and phrases


@query(f"WITH {_STRONG} SELECT u, v, c, round(npmi, 6) AS npmi FROM strong")
def flt3_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also GRF1 and GRF2: the graph of the corpus, and its strong edges."""
    return _strong(spark, sf_dir).select("u", "v", "c", rounded("npmi"))


@query(f"WITH {GRAPH} SELECT u, v, c, round(npmi, 6) AS npmi FROM graph WHERE c >= 5 AND round(npmi, 2) >= 0.15")
def flt4_pair_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the service does: on the score that its table holds, two decimals."""
    edges = _numbered(spark, sf_dir).graph(5, 0.14).withColumn("full", F.col("npmi")).withColumn("npmi", F.round("npmi", 2))
    return C.pair_filter(edges, 5, 0.15).select("u", "v", "c", rounded("full", "npmi"))


@query(f"WITH {_STRONG}, size AS (SELECT sent_id FROM toks GROUP BY 1 HAVING max(pos) + 1 <= 32) SELECT sent_id, array_to_string(list(kw ORDER BY kw), ' ') AS kws FROM occ SEMI JOIN size USING (sent_id) SEMI JOIN (SELECT u AS kw FROM strong UNION SELECT v FROM strong) s USING (kw) GROUP BY sent_id")
def flt5_short_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph keywords of sentences of at most 32 words."""
    words = _numbered(spark, sf_dir)
    return words.linked(_strong(spark, sf_dir, words), 32).select("sent_id", F.array_join("kws", " ").alias("kws"))


@query(f"""WITH {_phrase_sql(4)}, b AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda t: t <> '')) AS token FROM benchmark),
p AS (SELECT phrase, unnest(string_split(phrase, ' ')) AS token FROM phrases) SELECT phrase FROM p LEFT JOIN b ON p.token = b.token GROUP BY phrase HAVING count(*) = count(b.token)""")
def flt13_known_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of the corpus all of whose words the benchmark has."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.word_tokens("text")).alias("token"))
    return P.all_known(_phrases(spread(documents(spark, sf_dir)), 4), words)


@query(f"WITH {SENTENCES} SELECT sent_id, sentence FROM sents WHERE contains(sentence, 'eron')")
def flt18_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sentences(spread(documents(spark, sf_dir))).where(F.contains("sentence", F.lit("eron")))


# windows and set operations on their own


@query(f"WITH {_NEAR} SELECT src, dst, rank FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY round(npmi, 6) DESC, c DESC, dst) AS rank FROM near) WHERE rank <= 5")
def win6_top_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = C.neighbours(_strong(spark, sf_dir)).withColumn("npmi", F.round("npmi", 6))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("npmi"), F.desc("c"), "dst")).cast("long"))
    return ranked.where("rank <= 5").select("src", "dst", "rank")


_ENDS = "SELECT DISTINCT sent_id FROM occ WHERE kw IN (SELECT kw FROM occ GROUP BY kw ORDER BY count(*) DESC, kw LIMIT 1 OFFSET {})"


@query(f"WITH {OCCURRENCES}, a AS ({_ENDS.format(0)}), b AS ({_ENDS.format(1)}) SELECT 'both' AS kind, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'any', * FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'first only', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET1-SET4: sentences of the two commonest keywords, intersected, united and subtracted."""
    words = _numbered(spark, sf_dir)
    top = [r["id"] for r in words.occurrences().groupBy("id").count().orderBy(F.desc("count"), "id").limit(2).collect()]  # two words
    a, b = (words.sets.where(F.array_contains("ids", F.lit(k))).select("sent_id") for k in [*top, -1, -1][:2])
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "sent_id")
    return named(a.intersect(b), "both").unionByName(named(a.union(b).distinct(), "any")).unionByName(named(a.exceptAll(b), "first only"))


@query(f"""WITH {TOKENS}, base AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS id FROM toks GROUP BY token HAVING count(*) >= 10),
b AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda t: t <> '')) AS token FROM conversations), n AS (SELECT token FROM b ANTI JOIN base USING (token))
SELECT token, id FROM base UNION ALL SELECT token, (SELECT count(*) FROM base) + row_number() OVER (ORDER BY token) - 1 FROM n""")
def set5_extend_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unseen words of another source behind those of the vocabulary, in order."""
    base = C.vocabulary(C.token_counts(_toks(spark, sf_dir), 10), ()).select("token", "id")
    new = table(spark, sf_dir, "conversations").select(F.explode(T.word_tokens("text")).alias("token")).distinct().join(base, "token", "left_anti")
    more = C.vocabulary(new.select("token", F.lit(0).cast("long").alias("cn")), ()).select("token", "id")
    return base.unionByName(more.crossJoin(F.broadcast(base.agg(F.count("*").alias("n")))).select("token", (F.col("id") + F.col("n")).alias("id")))  # one row


@query(f"WITH {OCCURRENCES}, c AS (SELECT token, count(*) AS cn FROM toks GROUP BY token), n AS (SELECT sum(cn)::DOUBLE AS total FROM c) SELECT token, cn, round((sqrt(cn / (1e-3::DOUBLE * total)) + 1) * (1e-3::DOUBLE * total) / cn, 6) AS keep FROM c, n")
def ml4_keep_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = C.token_counts(_toks(spark, sf_dir, 4))
    total = counts.agg(F.sum("cn").cast("double").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("token", "cn", F.round(C.keep_probability(F.col("cn"), F.col("total")), 6).alias("keep"))  # one row


@query(f"WITH {TOKENS}, v AS (SELECT token, count(*) AS cn FROM toks GROUP BY token), p AS (SELECT token, cn, pow(cn::DOUBLE, 0.75e0) AS w FROM v) SELECT token, round(sum(w) OVER (ORDER BY token) / sum(w) OVER (), 6) AS upto FROM p")
def ml2_unigram_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running probabilities for drawing negatives."""
    return C.running_share(C.sampling_table(C.token_counts(_toks(spark, sf_dir))), "token", "p").select("token", rounded("upto"))
