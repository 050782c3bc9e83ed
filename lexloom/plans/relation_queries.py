"""Queries over dependency parses and triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import corpus as C
from lexloom.operators import dependency as D
from lexloom.operators import triples as R
from lexloom.plans.base import CEILING, TOKENS, WS, documents, every_word, literal, query, spread, table, values
from lexloom.sources.files import stored

_PREP = ", ".join(f"'{p}'" for p in D.PREPOSITIONS)
_RELS = "[" + ", ".join(f"'{r}'" for r in D.RELATIONS) + "]"
_PARSE = f"""{TOKENS}, parse AS (SELECT sent_id, pos AS tok_id, token AS form, CASE WHEN pos = 0 THEN 0 ELSE (pos - 1) // 2 END AS head,
  CASE WHEN pos = 0 THEN 'ROOT' WHEN token IN ({_PREP}) THEN 'prep' ELSE {_RELS}[pos % 5 + 1] END AS rel FROM toks),
kw AS (SELECT token FROM toks WHERE length(token) >= 4 GROUP BY token HAVING count(*) BETWEEN 20 AND 60)"""


def _parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored, as contexts, paths and roles each read it several times."""
    return stored(D.stand_in(C.sentences(spread(documents(spark, sf_dir)))), "parse")


def _keywords(parse: DataFrame, most: int | None = CEILING) -> DataFrame:
    """Words of four letters that occur 20 times, and at most ``most`` times if that is set."""
    counts = C.token_counts(parse.select(F.col("form").alias("token")), 20).where("length(token) >= 4")
    return (counts if most is None else counts.where(F.col("cn") <= most)).select("token")


_CTX = _PARSE + """, w AS (SELECT p.* FROM parse p SEMI JOIN kw ON kw.token = p.form),
down AS (SELECT w.sent_id, w.tok_id, w.form AS word, c.tok_id AS c_tok, c.form AS c_form, c.rel AS c_rel FROM w JOIN parse c ON c.sent_id = w.sent_id AND c.head = w.tok_id AND c.tok_id <> c.head),
ctx AS (SELECT sent_id, word, c_rel AS relation, c_form AS context FROM down WHERE c_rel <> 'prep'
  UNION ALL SELECT d.sent_id, d.word, 'prep_' || d.c_form, arg_min(o.form, o.tok_id) FROM down d JOIN parse o ON o.sent_id = d.sent_id AND o.head = d.c_tok AND o.rel = 'pobj' WHERE d.c_rel = 'prep' GROUP BY d.sent_id, d.word, d.tok_id, d.c_tok, d.c_form
  UNION ALL SELECT w.sent_id, w.form, w.rel || 'I', h.form FROM w JOIN parse h ON h.sent_id = w.sent_id AND h.tok_id = w.head)"""


def _contexts(spark: SparkSession, sf_dir: str, most: int | None = CEILING) -> DataFrame:
    docs = spread(documents(spark, sf_dir))
    counts = C.document_counts(docs, 20).where("length(token) >= 4")
    return D.document_contexts(docs, counts if most is None else counts.where(F.col("cn") <= most))


@every_word
@query(f"WITH {_CTX} SELECT word, relation, context, count(*) AS n FROM ctx GROUP BY 1, 2, 3")
def join13_dependency_contexts(spark: SparkSession, sf_dir: str, most: int | None = CEILING) -> DataFrame:
    return _contexts(spark, sf_dir, most).groupBy("word", "relation", "context").agg(F.count("*").alias("n"))


_CONLL = [(1, 1, "australian", 2, "amod"), (1, 2, "scientist", 3, "nsubj"), (1, 3, "discovers", 0, "root"), (1, 4, "star", 3, "dobj"), (1, 5, "with", 3, "adpmod"), (1, 6, "telescope", 5, "adpobj"), (2, 1, "stars", 2, "nsubj"), (2, 2, "shine", 0, "root")]


@query("SELECT * FROM " + values([("scientist", "amod_australian"), ("australian", "amodI_scientist"), ("discovers", "nsubj_scientist"), ("scientist", "nsubjI_discovers"), ("discovers", "dobj_star"), ("star", "dobjI_discovers"), ("discovers", "adpmod:with_telescope"), ("telescope", "adpmod:withI_discovers"), ("shine", "nsubj_stars"), ("stars", "nsubjI_shine")], "word, context"))
def join13_conll_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The textbook sentence, by hand; the root is no known word."""
    parse = literal(spark, [*_CONLL, (1, 0, "*root*", -1, "rroot"), (2, 0, "*root*", -1, "rroot")], "sent_id int, tok_id int, form string, head int, rel string")
    return D.conll_contexts(parse, parse.where("tok_id > 0").select(F.col("form").alias("token")).distinct())


@every_word
@query(f"WITH {_CTX} SELECT word, relation || '_' || context AS context, count(*) AS n FROM ctx WHERE relation NOT IN ('punct', 'dep', 'punctI', 'depI') GROUP BY 1, 2")
def dep4_context_lines(spark: SparkSession, sf_dir: str, most: int | None = CEILING) -> DataFrame:
    """Also FLT14."""
    return D.context_lines(_contexts(spark, sf_dir, most)).groupBy("word", "context").agg(F.count("*").alias("n"))


_PAIRS = ", pair AS (SELECT DISTINCT a.sent_id, a.form AS a, b.form AS b FROM w a JOIN w b ON a.sent_id = b.sent_id AND a.form < b.form)"


def _pairs(parse: DataFrame, most: int | None = CEILING) -> DataFrame:
    places = D.keyword_places(parse, _keywords(parse, most))
    sets = C.sentence_sets(places.select("sent_id", F.col("form").alias("kw")).distinct())
    return C.pairs(sets).select("sent_id", F.col("u").alias("a"), F.col("v").alias("b"))


@every_word
@query(f"WITH {_CTX}{_PAIRS}, c AS (SELECT DISTINCT sent_id, word, relation || '_' || context AS context FROM ctx), s AS (SELECT a, b, context, true AS opens FROM pair JOIN c ON c.sent_id = pair.sent_id AND c.word = a UNION ALL SELECT a, b, context, false FROM pair JOIN c ON c.sent_id = pair.sent_id AND c.word = b) SELECT pair, context, count(*) AS n FROM (SELECT a || '__' || b AS pair, CASE WHEN opens THEN 'h_' ELSE 't_' END || context AS context FROM s UNION ALL SELECT b || '__' || a, CASE WHEN opens THEN 't_' ELSE 'h_' END || context FROM s) GROUP BY 1, 2")
def join14_pair_contexts(spark: SparkSession, sf_dir: str, most: int | None = CEILING) -> DataFrame:
    parse, contexts = _parse(spark, sf_dir), _contexts(spark, sf_dir, most)
    mine = contexts.select("sent_id", "word", F.concat("relation", F.lit("_"), "context").alias("context"))
    return D.pair_lines(mine, _pairs(parse, most)).groupBy("pair", "context").agg(F.count("*").alias("n"))


_DEP1 = [(0, "java", 1, "nsubj"), (1, "beats", 1, "ROOT"), (2, "slow", 3, "amod"), (3, "python", 1, "dobj")]
_DEP1_PAIRS = [("java", "python", "i_nsubj dobj"), ("python", "java", "i_dobj nsubj"), ("slow", "python", "i_amod"), ("python", "slow", "amod"), ("java", "absent", "")]


@query(f"SELECT * FROM {values(_DEP1_PAIRS, 'a, b, path')}")
def dep1_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = literal(spark, _DEP1, "tok_id int, form string, head int, rel string").withColumn("sent_id", F.lit(0))
    asked = literal(spark, [(0, a, b) for a, b, _ in _DEP1_PAIRS], "sent_id int, a string, b string")
    return asked.join(D.sentences_as_arrays(tokens), "sent_id").select("a", "b", D.path(F.col("tokens"), F.col("a"), F.col("b")).alias("path"))


@every_word
@query(f"""WITH RECURSIVE {_PARSE}, w AS (SELECT p.* FROM parse p SEMI JOIN kw ON kw.token = p.form){_PAIRS}, d AS (SELECT sent_id, a AS subj, b AS obj FROM pair UNION ALL SELECT sent_id, b, a FROM pair),
f AS (SELECT sent_id, form, min(tok_id) AS tok_id FROM parse GROUP BY 1, 2),
up AS (SELECT DISTINCT f.sent_id, f.tok_id AS start, f.tok_id AS at, 0 AS depth FROM f JOIN kw ON kw.token = f.form UNION ALL SELECT up.sent_id, start, p.head, depth + 1 FROM up JOIN parse p ON p.sent_id = up.sent_id AND p.tok_id = up.at WHERE p.head <> p.tok_id),
meet AS (SELECT d.sent_id, subj, obj, x.tok_id AS i, y.tok_id AS j, arg_min((a.depth, b.depth), a.depth + b.depth) AS m FROM d JOIN f x ON x.sent_id = d.sent_id AND x.form = subj JOIN f y ON y.sent_id = d.sent_id AND y.form = obj JOIN up a ON a.sent_id = d.sent_id AND a.start = x.tok_id JOIN up b ON b.sent_id = d.sent_id AND b.start = y.tok_id AND b.at = a.at GROUP BY 1, 2, 3, 4, 5),
rise AS (SELECT meet.sent_id, subj, obj, string_agg('i_' || p.rel, ' ' ORDER BY depth) AS r FROM meet JOIN up ON up.sent_id = meet.sent_id AND up.start = i AND depth < m[1] JOIN parse p ON p.sent_id = up.sent_id AND p.tok_id = up.at GROUP BY 1, 2, 3),
fall AS (SELECT meet.sent_id, subj, obj, string_agg(p.rel, ' ' ORDER BY depth DESC) AS r FROM meet JOIN up ON up.sent_id = meet.sent_id AND up.start = j AND depth < m[2] JOIN parse p ON p.sent_id = up.sent_id AND p.tok_id = up.at GROUP BY 1, 2, 3)
SELECT meet.sent_id, concat_ws(' ', rise.r, fall.r) AS path, meet.subj, meet.obj FROM meet LEFT JOIN rise USING (sent_id, subj, obj) LEFT JOIN fall USING (sent_id, subj, obj)""")
def dep2_path_dataset(spark: SparkSession, sf_dir: str, most: int | None = CEILING) -> DataFrame:
    """Paths between keywords of one sentence, both ways."""
    parse = _parse(spark, sf_dir)
    return D.paths(parse, _pairs(parse, most)).select("sent_id", "path", "subj", "obj")


@every_word
@query(f"WITH {_PARSE} SELECT sent_id, tok_id::INTEGER AS tok_id, form FROM parse SEMI JOIN kw ON kw.token = form")
def dep3_keyword_places(spark: SparkSession, sf_dir: str, most: int | None = CEILING) -> DataFrame:
    parse = _parse(spark, sf_dir)
    return D.keyword_places(parse, _keywords(parse, most))


@every_word
@query(f"WITH {_PARSE}, m AS (SELECT p.* FROM parse p SEMI JOIN kw ON kw.token = p.form) SELECT sent_id FROM m GROUP BY sent_id HAVING bool_or(rel = 'nsubj') AND bool_or(rel = 'dobj')")
def flt17_two_roles(spark: SparkSession, sf_dir: str, most: int | None = CEILING) -> DataFrame:
    parse = _parse(spark, sf_dir)
    places = D.keyword_places(parse, _keywords(parse, most)).select("sent_id", F.col("form").alias("kw")).distinct()
    return D.two_roles(parse, places)


# triples


_OLLIE = [
    (0, "data mining is a process of extracting patterns in large data sets."),
    (1, "0.769: (patterns; be discovering in; large data sets)"),
    (2, "0.763: (data mining; is; a process of extracting)"),
    (3, "0.5: (too; low; score)"),
    (4, "0.9: (two; parts)"),
    (5, ""),
    (6, "Another sentence."),
    (7, "No extractions found."),
    (8, "0.7: (a; b; c)"),
]
_OLLIE_OUT = [(0, _OLLIE[0][1]), (1, "patterns; be discovering in; large data sets"), (2, "data mining; is; a process of extracting"), (5, ""), (6, "Another sentence."), (8, "a; b; c")]


@query(f"SELECT * FROM {values(_OLLIE_OUT, 'n, line')}")
def oie1_scored_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also FLT9."""
    rows = literal(spark, _OLLIE, "n int, line string")
    return rows.select("n", R.block_lines(F.col("line"), 0.7).alias("line")).where("line IS NOT NULL")


@query("SELECT p_partkey, p_name || '; is; ' || p_type AS triple FROM part WHERE p_brand <> 'Brand#2'")
def oie2_tabbed_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also FLT19: rows with a semicolon are dropped."""
    raw = F.concat_ws("\t", F.lit("1.0"), "p_name", F.lit("is"), F.when(F.col("p_brand") == "Brand#2", F.concat("p_type", F.lit("; or so"))).otherwise(F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", R.tabbed(raw).alias("triple")).where("triple IS NOT NULL")


@query("SELECT p_partkey, p_name || '; is; ' || p_type AS triple FROM part WHERE p_partkey % 7 <> 0 AND p_size >= 25")
def oie3_semicolon_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an object, or below the threshold, a row is dropped."""
    raw = F.concat_ws("; ", (F.col("p_size") / 50).cast("decimal(4,2)").cast("string"), "p_name", F.lit("is"), F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", R.semicolons(raw, 0.5).alias("triple")).where("triple IS NOT NULL")


_TRIPLES = r"""cut AS (SELECT doc_id, string_split_regex(text, '[.!?\n]+') AS a FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id * 1000000 + generate_subscripts(a, 1) - 1 AS id, list_filter(string_split_regex(lower(unnest(a)), '[^a-z0-9_]+'), lambda t: t <> '') AS w FROM cut),
triple AS (SELECT id, array_to_string(list_slice(w, 1, len(w) // 3), ' ') AS x, array_to_string(list_slice(w, len(w) // 3 + 1, 2 * (len(w) // 3)), ' ') AS r, array_to_string(list_slice(w, 2 * (len(w) // 3) + 1, len(w)), ' ') AS y, len(w) AS n FROM s WHERE len(w) >= 3)"""


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence cut into thirds: a stand-in for an extractor."""
    w, k = F.col("w"), F.floor(F.size("w") / 3).cast("int")
    cut = R.once(C.sentences(spread(documents(spark, sf_dir))).withColumnRenamed("sent_id", "id"), w=T.word_tokens("sentence")).where(F.size("w") >= 3)
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    return R.once(cut, triple=F.concat_ws("; ", part(F.lit(1), k), part(k + 1, k), part(2 * k + 1, F.size("w")))).select("id", "triple")


@query(f"WITH {_TRIPLES} SELECT id, concat_ws('; ', x, r, y) AS triple FROM triple WHERE n // 3 <= 6 AND n - 2 * (n // 3) <= 6")
def flt6_short_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.short_triples(_triples(spark, sf_dir)).select("id", "triple")


_SHORT = _TRIPLES + ", short AS (SELECT * FROM triple WHERE n // 3 <= 6 AND n - 2 * (n // 3) <= 6)"


@query(f"""WITH {_SHORT}, arg AS (SELECT id, unnest([string_split(x, ' '), string_split(y, ' ')]) AS w FROM short), g AS (SELECT w[i] || ' ' || w[i + 1] AS phrase FROM (SELECT w, unnest(range(1, len(w))) AS i FROM arg)), dict AS (SELECT phrase FROM g GROUP BY 1 HAVING count(*) >= 5),
hit AS (SELECT DISTINCT id FROM (SELECT id, w[i] || ' ' || w[i + 1] AS phrase FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM arg)) SEMI JOIN dict USING (phrase))
SELECT id, concat_ws('; ', x, r, y) AS triple FROM short SEMI JOIN hit USING (id)""")
def flt7_keyword_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short triples whose arguments hold a frequent pair of words."""
    from lexloom.operators.phrases import grams

    rows = stored(_triples(spark, sf_dir), "triples")
    w = F.col("words")
    args = R.short_triples(rows).select(F.explode(F.array(w[0], w[2])).alias("w"))
    phrases = args.select(F.explode(grams("w", 2)).alias("g")).groupBy(F.col("g.phrase").alias("phrase")).agg(F.count("*").alias("n")).where("n >= 5").select("phrase")
    return R.keyword_triples(rows, phrases)


_BLOCKS = _TRIPLES + ", block AS (SELECT id // 1000000 AS block, list(concat_ws('; ', x, r, y) ORDER BY id) AS t FROM triple GROUP BY 1)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _triples(spark, sf_dir).select(F.floor(F.col("id") / C.STRIDE).alias("block"), F.struct("id", "triple").alias("x"))
    return rows.groupBy("block").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["triple"]).alias("triples"))


@query(f"WITH {_BLOCKS} SELECT block, unnest(list_filter(t, lambda x: contains(x, 'onen') AND contains(x, 'and'))) AS triple FROM block")
def flt8_mentioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also OIE5 and UDF4: the triples of each block that hold both words."""
    return _blocks(spark, sf_dir).select("block", F.explode(R.mentioning(F.col("triples"), "onen", "and")).alias("triple"))


@query(f"WITH {_BLOCKS} SELECT block, generate_subscripts(t, 1) - 1 AS place, unnest(t) AS triple FROM block")
def oie4_triples_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as a file holds them, sentences in front, then without these."""
    from lexloom.sources.files import triple_blocks

    text = _blocks(spark, sf_dir).select("block", F.concat_ws("\n", F.lit("The sentence."), "triples").alias("text"))
    return text.select("block", triple_blocks("text").alias("b")).select("block", F.posexplode("b.triples").alias("place", "triple")).select("block", F.col("place").cast("long").alias("place"), "triple")


@query(f"""WITH {_SHORT}, tok AS (SELECT id, part, generate_subscripts(w, 1) AS pos, unnest(w) AS token FROM (SELECT id, unnest([0, 1, 2]) AS part, unnest([string_split(x, ' '), string_split(r, ' '), string_split(y, ' ')]) AS w FROM short)),
v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS i FROM tok GROUP BY token HAVING count(*) >= 3), n AS (SELECT id, count(*) AS n, count(i) AS k FROM tok LEFT JOIN v USING (token) GROUP BY id),
p AS (SELECT id, part, list(i ORDER BY pos) AS ids FROM tok JOIN v USING (token) WHERE id IN (SELECT id FROM n WHERE n = k) GROUP BY 1, 2)
SELECT id, string_agg(array_to_string(list_slice(list_concat(ids, [1, 1, 1, 1, 1, 1]), 1, 6), ' '), ' ' ORDER BY part) AS ids FROM p GROUP BY id""")
def oie6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = R.spans(stored(_triples(spark, sf_dir), "triples"), 3)
    return rows.select("id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(f"WITH {_TRIPLES} SELECT id, concat_ws('; ', x, r, y) AS triple FROM triple WHERE (contains(x, 'onen') OR contains(x, 'eron')) AND (contains(y, 'onen') OR contains(y, 'eron'))")
def oie7_both_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triples(spark, sf_dir).where(R.both_ends(F.col("triple"), ["onen", "eron"]))


_PATTERNS = [(1, ["<X>", "is", "a", "<Y>"]), (2, ["<X>", "is", "an", "old", "<Y>"]), (3, ["<X>", "is", "used", "in", "<Y>"]), (4, ["<X>", "was", "in", "<Y>"]), (5, ["<X>", "is", "<Y>"]), (6, ["<X>", "is", "part", "of", "the", "<Y>"])]


@query("SELECT * FROM " + values([(1,), (2,)], "id"))
def flt11_is_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal(spark, _PATTERNS, "id int, ctx array<string>").where(R.is_a(F.col("ctx"))).select("id")


@query("SELECT * FROM " + values([(3, "in")], "id, preposition"))
def flt12_is_preposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal(spark, _PATTERNS, "id int, ctx array<string>").select("id", R.is_preposition(F.col("ctx")).alias("preposition")).where("preposition IS NOT NULL")


@query("WITH e AS (SELECT event_type AS relation, user_id FROM events) SELECT relation, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, relation LIMIT 3")
def agg15_top_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also FLT10: relations by frequency, of those frequent enough."""
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("relation")).agg(F.count("*").alias("n")).where("n >= 2")
    return counts.orderBy(F.desc("n"), "relation").limit(3)


@every_word
@query(f"WITH {_CTX} SELECT relation, count(*) AS n, count(DISTINCT sent_id) AS sentences FROM ctx GROUP BY 1")
def agg16_relation_records(spark: SparkSession, sf_dir: str, most: int | None = CEILING) -> DataFrame:
    """Records of each relation, of two halves merged."""
    contexts = _contexts(spark, sf_dir, most)
    halves = [contexts.where(F.col("sent_id") % 2 == k) for k in (0, 1)]
    return halves[0].unionByName(halves[1]).groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("sent_id").alias("sentences"))


@every_word
@query(f"WITH {_CTX}, r AS (SELECT DISTINCT relation, sent_id FROM ctx), n AS (SELECT relation, sent_id, row_number() OVER (PARTITION BY relation ORDER BY sent_id) AS rank FROM r) SELECT relation, rank, sent_id, sentence FROM n JOIN sents USING (sent_id) WHERE rank <= 3")
def join18_example_sentences(spark: SparkSession, sf_dir: str, most: int | None = CEILING) -> DataFrame:
    """The first three sentences of each relation."""
    contexts = _contexts(spark, sf_dir, most).select("relation", "sent_id").distinct()
    ranked = contexts.withColumn("rank", F.row_number().over(Window.partitionBy("relation").orderBy("sent_id")).cast("long")).where("rank <= 3")
    return ranked.join(C.sentences(spread(documents(spark, sf_dir))), "sent_id").select("relation", "rank", "sent_id", "sentence")


_WEIGHTS = [("nsubj", 0.5), ("prep_of", 2.0)]


@every_word
@query(f"WITH {_CTX}, r AS (SELECT relation, count(*) AS n FROM ctx GROUP BY 1) SELECT relation, n, coalesce(weight, 0) AS weight FROM r LEFT JOIN {values(_WEIGHTS, 'relation, weight')} USING (relation)")
def join20_relation_weights(spark: SparkSession, sf_dir: str, most: int | None = CEILING) -> DataFrame:
    counts = _contexts(spark, sf_dir, most).groupBy("relation").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(literal(spark, _WEIGHTS, "relation string, weight double")), "relation", "left").select("relation", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))


@query()
def set6_without_redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within each conversation, sentences that a kept one doesn't cover."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return R.distinct_sentences(said, "conv_id", "turn", "text")


@query(f"SELECT p_partkey, p_name || '__' || p_type AS key, list_filter(string_split_regex(p_name || ' ' || p_type, '{WS}+'), lambda t: t <> '')[1] AS first FROM part")
def udf6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also UDF5: one row to many, by any expression."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("__"), "p_type").alias("key"), F.posexplode(T.preprocess(F.concat_ws(" ", "p_name", "p_type"), lower=False)).alias("i", "first"))
    return rows.where("i = 0").select("p_partkey", "key", "first")
