"""Queries over single texts and words: cleaning, splitting, normalising, highlighting, padding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import corpus as C
from lexloom.plans.base import SENTENCES, TOKENS, WS, documents, literal, query, table, values

_CLEAN = r"replace(replace(replace(text, '\n', ' '), '$', ''), '\', ' ')"
for _p, _by in ((r"--+", ", "), (r"\([^)]*\)", ""), (r"\{[^)]*\}", ""), ("-", " - "), (WS + "+", " ")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_by}', 'g')"
_CLEAN = f"translate({_CLEAN}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents")
def txt1_clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.clean_corpus("text").alias("cleaned"))


@query(rf"SELECT doc_id, replace(replace(replace(replace(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), chr(10), ' '), '$', ''), '--', ', '), '-', ' - ') AS cleaned FROM documents")
def txt2_clean_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.clean_abstract("text").alias("cleaned"))


@query(rf"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '==[^\n]*==', '', 'g'), '^{WS}+', ''), '{WS}+', ' ', 'g') AS cleaned FROM pages")
def txt3_clean_wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.clean_wiki("html").alias("cleaned"))


@query(f"WITH {SENTENCES} SELECT sent_id, sentence FROM sents WHERE NOT contains(sentence, 'null')")
def txt4_drop_null_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sentences(documents(spark, sf_dir)).where(~T.mentions_null("sentence"))


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-zA-Z]', ' ', 'g'), '{WS}+', ' ', 'g') AS letters FROM documents")
def txt5_letters_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.letters_only("text").alias("letters"))


@query(f"WITH {SENTENCES} SELECT sent_id, sentence FROM sents")
def txt6_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sentences(documents(spark, sf_dir))


_WORDS = f"list_filter(string_split_regex(text, '{WS}+'), lambda t: t <> '')"


@query(f"SELECT doc_id, len(w)::BIGINT AS n, array_to_string(w, '|') AS words FROM (SELECT doc_id, {_WORDS} AS w FROM documents)")
def txt7_whitespace_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.tokens("text").alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.array_join("w", "|").alias("words"))


@query(f"WITH {TOKENS} SELECT sent_id, pos::BIGINT AS pos, token FROM toks")
def txt8_word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tokens(C.sentences(documents(spark, sf_dir))).select("sent_id", F.col("pos").cast("long").alias("pos"), "token")


_LEMMA = r"""CASE WHEN length(X) <= 3 THEN X
  WHEN regexp_matches(X, '[^aeiou]ies$') THEN regexp_replace(X, 'ies$', 'y')
  WHEN regexp_matches(X, '(ss|x|ch|sh)es$') THEN regexp_replace(X, 'es$', '')
  WHEN regexp_matches(X, '[^sui]s$') THEN regexp_replace(X, 's$', '') ELSE X END"""


@query(f"WITH {TOKENS} SELECT DISTINCT token, {_LEMMA.replace('X', 'token')} AS lemma FROM toks")
def txt9_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = C.tokens(C.sentences(documents(spark, sf_dir))).select("token").distinct()
    return words.select("token", T.lemma(F.col("token")).alias("lemma"))


_LEMMAS = f"list_transform({_WORDS}, lambda x: {_LEMMA.replace('X', 'x')})"


@query(f"SELECT doc_id, array_to_string(list_filter({_LEMMAS}, lambda t: NOT (length(t) > 4 AND regexp_matches(t, 'ly$'))), ' ') AS normal FROM documents")
def txt10_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.normalize("text").alias("normal"))


_KEYWORDS = ["b-tree", "data structure", "open-source software", "can", "graphs", "C", "x", "hash  table", "boxes", "query languages", "on- line", "parts", "bus", "analysis", "tree-based  methods", "ies", "studies"]
_ENTITY = f"array_to_string(list_filter(string_split_regex(replace(keyword, '-', ' - '), '{WS}+'), lambda t: t <> ''), '_')"


@query(f"SELECT keyword, {_ENTITY} AS entity FROM (SELECT * FROM {values([(k,) for k in _KEYWORDS], 'keyword')} UNION SELECT DISTINCT p_name FROM part)")
def txt11_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = literal(spark, [(k,) for k in _KEYWORDS], "keyword string").union(table(spark, sf_dir, "part").select("p_name")).distinct()
    return words.select("keyword", T.entity("keyword").alias("entity"))


_STOPS = ", ".join(f"'{s}'" for s in T.KEYWORD_STOPS)
_STABLE = f"""WITH k AS (SELECT keyword, list_filter(string_split_regex(replace(lower(keyword), '-', ' - '), '{WS}+'), lambda t: t <> '') AS w
  FROM (SELECT * FROM {values([(k,) for k in _KEYWORDS], 'keyword')} UNION SELECT DISTINCT p_name FROM part))
SELECT keyword, array_to_string(list_transform(w, lambda x: {_LEMMA.replace('X', 'x')}), ' ') = array_to_string(w, ' ') AND NOT contains(keyword, '- ') AND lower(keyword) NOT IN ({_STOPS}) AS stable FROM k"""


@query(_STABLE)
def txt12_stable_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both outputs of the split: what is stable, and what isn't."""
    words = literal(spark, [(k,) for k in _KEYWORDS], "keyword string").union(table(spark, sf_dir, "part").select("p_name")).distinct()
    return words.select("keyword", T.is_stable("keyword").alias("stable"))


@query(f"""WITH {TOKENS}, v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS id FROM toks GROUP BY token)
SELECT sent_id, array_to_string(list(v.token ORDER BY pos), ' ') AS words FROM toks JOIN v USING (token) GROUP BY sent_id""")
def txt13_ids_to_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences to ids and back: the vocabulary is joined, as it grows with the corpus."""
    toks = C.tokens(C.sentences(documents(spark, sf_dir)))
    vocab = C.vocabulary(C.token_counts(toks))
    ids = C.numericalize(toks, vocab).select("sent_id", "pos", "id")
    back = ids.join(vocab.select("id", "token"), "id")
    return back.groupBy("sent_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("words"))


_PADS = {
    "right": (dict(), "list_slice(list_concat(w, list_transform(range(greatest(0, 12 - len(w))), lambda i: '<pad>')), 1, 12)"),
    "left": (dict(left=True), "list_concat(list_transform(range(greatest(0, 12 - len(w))), lambda i: '<pad>'), list_slice(w, 1, 12))"),
    "last": (dict(keep_last=True), "list_concat(list_slice(w, greatest(1, len(w) - 11), len(w)), list_transform(range(greatest(0, 12 - len(w))), lambda i: '<pad>'))"),
}


@query(f"WITH {TOKENS} SELECT sent_id, " + ", ".join(f"array_to_string({s}, ' ') AS \"{k}\"" for k, (_, s) in _PADS.items()) + ", CASE WHEN len(w) <= 12 THEN array_to_string(list_slice(list_concat(w, list_transform(range(greatest(0, 12 - len(w))), lambda i: '<pad>')), 1, 12), ' ') END AS aligned FROM words")
def txt14_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = C.sentences(documents(spark, sf_dir)).select("sent_id", T.word_tokens("sentence").alias("w"))
    return cut.select("sent_id", *[F.array_join(T.pad("w", 12, **how), " ").alias(k) for k, (how, _) in _PADS.items()], F.array_join(T.align("w", 12), " ").alias("aligned"))


@query(f"""WITH {TOKENS}, v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS id FROM toks GROUP BY token HAVING count(*) >= 5)
SELECT sent_id, array_to_string(list(coalesce(id, 0) ORDER BY pos), ' ') AS ids FROM toks LEFT JOIN v USING (token) GROUP BY sent_id""")
def txt15_numericalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = C.tokens(C.sentences(documents(spark, sf_dir)))
    ids = C.numericalize(toks, C.vocabulary(C.token_counts(toks, 5)))
    return ids.groupBy("sent_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"].cast("string")), " ").alias("ids"))


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform({_WORDS}, lambda t: lower(t)), lambda t: length(t) > 3), ' ') AS words FROM documents")
def txt16_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = lambda a: F.filter(a, lambda t: F.length(t) > 3)
    return documents(spark, sf_dir).select("doc_id", F.array_join(T.preprocess("text", keep), " ").alias("words"))


_MARKED = ["the", "and", "that", "onen", "in", "der", "que"]
_IN = "[" + ", ".join(f"'{m}'" for m in _MARKED) + "]"


@query(f"""WITH {TOKENS} SELECT sent_id, array_to_string(list_transform(w, lambda t, i:
  CASE WHEN list_contains({_IN}, t) AND NOT coalesce(list_contains({_IN}, w[i - 1]), false) THEN '<span style="color:red">' ELSE '' END || t ||
  CASE WHEN list_contains({_IN}, t) AND NOT coalesce(list_contains({_IN}, w[i + 1]), false) THEN '</span>' ELSE '' END), ' ') AS html FROM words""")
def txt17_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = C.sentences(documents(spark, sf_dir)).select("sent_id", T.word_tokens("sentence").alias("w"))
    return cut.select("sent_id", T.highlight("w", F.array(*map(F.lit, _MARKED))).alias("html"))


_CONTEXTS = ["prep_in_java", "nsubj_java", "dobj", "prep_of", "prep_", "l-1_word", "amod_a_b", "_x", "prep", ""]


@query(f"SELECT context, regexp_extract(context, '^(prep_[^_]*|[^_]*)', 1) AS relation FROM {values([(c,) for c in _CONTEXTS], 'context')}")
def txt18_relation_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal(spark, [(c,) for c in _CONTEXTS], "context string").select("context", T.relation_prefix("context").alias("relation"))


@query("""WITH names AS (SELECT p_brand, list(DISTINCT p_name ORDER BY p_name) AS s FROM part GROUP BY p_brand),
q AS (SELECT p_brand, unnest(['red', 'widget ', 'Blue']) AS query, s FROM names),
n AS (SELECT p_brand, query, lower(trim(query)) AS q, s FROM q),
w AS (SELECT p_brand, query, q, flatten(list_transform(list_filter(s, lambda x: contains(x, q)), lambda x: string_split(x, ' '))) AS words FROM n)
SELECT p_brand, query, array_to_string(list_concat([q], list_filter(list_transform(words, lambda x, i: CASE WHEN list_position(words, x) = i AND x <> q AND x NOT IN ('ring', 'the') THEN x END), lambda x: x IS NOT NULL)), ' ') AS words FROM w""")
def txt19_suggestion_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_name")).alias("s"))
    asked = names.select("p_brand", F.explode(F.array(*map(F.lit, ["red", "widget ", "Blue"]))).alias("query"), "s")
    return asked.select("p_brand", "query", F.array_join(T.suggestion_words("query", "s", F.array(F.lit("ring"), F.lit("the"))), " ").alias("words"))


@query(f"WITH {TOKENS} SELECT sent_id, array_to_string(list_filter(w, lambda t: t NOT IN ({', '.join(repr(s) for s in T.QUERY_STOPS)})), ' ') AS words FROM words")
def txt20_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = C.sentences(documents(spark, sf_dir)).select("sent_id", T.word_tokens("sentence").alias("w"))
    return cut.select("sent_id", F.array_join(T.without("w", T.QUERY_STOPS), " ").alias("words"))


@query("SELECT DISTINCT p_brand, p_type, replace(replace('<X> is a kind of <Y>, as <X>', '<X>', p_brand), '<Y>', p_type) AS filled FROM part")
def txt21_fill_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    return pairs.select("p_brand", "p_type", T.fill_placeholders(F.lit("<X> is a kind of <Y>, as <X>"), "p_brand", "p_type").alias("filled"))


@query(f"""WITH {TOKENS}, p AS (SELECT sent_id, array_to_string(list_slice(list_concat(w, ['<pad>', '<pad>']), 1, 10), ' ') AS padded FROM words)
SELECT sent_id, split_part(padded, '<pad>', 1) AS cut FROM p""")
def txt22_cut_at_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.word_tokens("sentence")
    padded = C.sentences(documents(spark, sf_dir)).select("sent_id", F.array_join(F.slice(F.concat(w, F.array(F.lit("<pad>"), F.lit("<pad>"))), 1, 10), " ").alias("padded"))
    return padded.select("sent_id", T.cut_pad("padded").alias("cut"))


@query("SELECT p_partkey, len(string_split(p_name, ' '))::BIGINT AS n, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS turned FROM part")
def txt23_keyword_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.size(w).cast("long").alias("n"), F.array_join(F.reverse(w), " ").alias("turned"))


_QUERIES = ["Data Mining; graph ;; SQL", " ; ", "one", "a;b;A ;b"]


@query(f"""WITH q AS (SELECT query, list_filter(list_transform(string_split(query, ';'), lambda x: trim(x)), lambda x: x <> '') AS p FROM {values([(q,) for q in _QUERIES], 'query')})
SELECT query, array_to_string(p, '|') AS parts, lower(array_to_string(p, '|')) AS lowered FROM q""")
def txt24_parse_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal(spark, [(q, "|".join(T.parse_query(q)), "|".join(T.parse_query(q, lower=True))) for q in _QUERIES], "query string, parts string, lowered string")


@query(r"""SELECT item_id, regexp_replace(text, '(?i)\b(the|onen)\b', '<b class="match">\1</b>', 'g') AS html FROM benchmark""")
def txt25_search_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.search_highlight("text", ["the", "onen"]).alias("html"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_nationkey::VARCHAR AS number, replace('of ' || n_name || ' and more', ' ', '_') AS label FROM nation")
def txt26_graph_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("Q"), "n_nationkey").alias("q"), F.concat(F.lit("of "), "n_name", F.lit(" and more")).alias("name"))
    return n.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), T.wikidata_number("q").alias("number"), T.underscored("name").alias("label"))


@query(r"SELECT doc_id, array_to_string(list_transform(list_filter(string_split_regex(replace(text, chr(13), ''), '[ \t\n]+'), lambda t: t <> ''), lambda t: substr(t, 1, 9)), ' ') AS words FROM documents")
def txt27_read_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words cut to 9 characters; txt27_read_words_99 cuts as the reference does."""
    return documents(spark, sf_dir).select("doc_id", F.array_join(T.read_words("text", 9), " ").alias("words"))


@query(r"SELECT doc_id, array_to_string(list_transform(list_filter(string_split_regex(replace(text, chr(13), ''), '[ \t\n]+'), lambda t: t <> ''), lambda t: substr(t, 1, 99)), ' ') AS words FROM documents")
def txt27_read_words_99(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.array_join(T.read_words("text"), " ").alias("words"))


@query(f"""WITH w AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations),
p AS (SELECT conv_id, a.turn AS turn, CASE WHEN len(a.w) <= len(b.w) THEN a.w ELSE b.w END AS s, CASE WHEN len(a.w) <= len(b.w) THEN b.w ELSE a.w END AS l
  FROM w a JOIN w b USING (conv_id) WHERE b.turn = a.turn + 1),
e AS (SELECT conv_id, turn, len(s) AS n, list_sum(list_transform(list_distinct(s), lambda t: least(len(list_filter(s, lambda x: x = t)), len(list_filter(l, lambda x: x = t))))) AS hits FROM p)
SELECT conv_id, turn, round(CASE WHEN n > 0 THEN coalesce(hits, 0)::DOUBLE / n END, 6) AS recall FROM e""")
def txt28_rouge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each turn and the next one."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens("text").alias("w"))
    after = said.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return said.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.rouge("w", "v"), 6).alias("recall"))


@query(f"WITH {TOKENS} SELECT token, count(*) AS n FROM toks WHERE token NOT IN ({_STOPS}) GROUP BY token")
def flt1_keyword_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = C.tokens(C.sentences(documents(spark, sf_dir)))
    return toks.where(~F.col("token").isin(*T.KEYWORD_STOPS)).groupBy("token").agg(F.count("*").alias("n"))


@query(rf"""WITH w AS (SELECT unnest({_WORDS}) AS token FROM documents)
SELECT token, count(*) AS n FROM w WHERE NOT regexp_matches(token, '[{{}}()\\\[\]~=^/|]') AND token NOT IN ('-', '`') GROUP BY token""")
def flt2_odd_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select(F.explode(T.tokens("text")).alias("token"))
    return words.where(~T.odd_characters("token")).groupBy("token").agg(F.count("*").alias("n"))
