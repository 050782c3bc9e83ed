"""What the findings of r03 found, on small tables: whole jobs, exact edges, and no rows a pair where sums do."""

import math
import random

import duckdb
import pytest

from lexloom.operators import cooccurrence as O
from lexloom.operators import corpus as C
from lexloom.operators import vectors as V
from lexloom.plans import registry

from .test_registry import rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Random unit vectors, and for number 0 some at a distance of 0.6 and a hair more or less."""
    rng, path = random.Random(3), str(tmp_path_factory.mktemp("vectors"))
    data = [(i, [rng.gauss(0, 1) for _ in range(64)], i % 4) for i in range(3, 299)]
    edge = [(0, [1.0, *[0.0] * 63], 0), (1, [0.4 - 2e-7, *[0.0] * 62, math.sqrt(1 - (0.4 - 2e-7) ** 2)], 1), (2, [0.0] * 64, 2), (299, [0.4 + 2e-7, *[0.0] * 62, -math.sqrt(1 - (0.4 + 2e-7) ** 2)], None)]
    spark.createDataFrame(edge + data, "vec_id long, embedding array<double>, label int").coalesce(3).write.parquet(f"{path}/embeddings.parquet")
    return path


def agree(spark, path, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, path)
    want = con.sql(registry.ORACLES[name]).df()
    assert len(want) and rows(got.toPandas()) == rows(want)
    return got, want


def test_core_points_of_all_vectors(spark, vectors):
    """every vector is tested, at the very distance, and a zero vector has itself."""
    _, want = agree(spark, vectors, "clu3_core_points")
    assert len(want) == 300 and int(want[want["id"] == 2]["n"].iloc[0]) == 1


def test_core_points_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "LARGE_BLOCK", 2)
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(7)] + [(7, None)], "id long, vec array<double>")
    got = {r["qid"]: r["n"] for r in V.within(v, v.withColumnRenamed("id", "qid"), 0.6).collect()}
    assert got == {i: sum(1 - math.cos(i - j) <= 0.6 for j in range(7)) for i in range(7)} | {7: 1}


@pytest.mark.parametrize("name", ["vec6_analogy_multiply", "vec7_analogy_add", "vec8_analogy_evaluation", "agg23_filtered_rank"])
def test_no_row_a_pair(spark, vectors, name):
    """products are put together or counted by the worker that makes them."""
    got, _ = agree(spark, vectors, name)
    assert "CASE WHEN" not in plan(got) and "LeftAnti" not in plan(got)


GRAPH = ["agg21_hubs", "cmp3_prepare", "flt5_short_sentences", "join6_pairs_in_graph", "join9_shared_sentences", "agg11_pair_counts", "flt4_pair_filter", "join7_neighbours", "flt3_subgraph", "join8_bridges", "win6_top_per_query", "service_pair_neighbours"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Words that go together, a sentence twice, a document twice, one without text, words without marks between."""
    rng, path = random.Random(4), str(tmp_path_factory.mktemp("corpus"))
    groups = [[f"{k}{i}word" for k in "abcd"] for i in range(30)] + [["tion", "ment", "elle"]]
    words = sum(groups, ["of", "in", "tion"])
    texts = [". ".join(" ".join(rng.sample(g := rng.choice(groups), len(g)) + rng.choices(words, k=rng.randrange(4))) for _ in range(6)) for _ in range(150)]
    rows_ = [*enumerate(texts), (3, texts[5]), (200, None), (201, ""), (202, " ".join(words * 3))]
    spark.createDataFrame(rows_, "doc_id long, text string").coalesce(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", GRAPH)
def test_pair_graph(spark, corpus, monkeypatch, name):
    """No pair of words is a row before it is counted, in
    many small blocks as in one."""
    monkeypatch.setattr(O, "EVENTS", 500)
    monkeypatch.setattr(O, "BLOCK", 900)
    monkeypatch.setattr(O, "TOKENS", 300)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{corpus}/documents.parquet/*.parquet'")
    monkeypatch.setattr(C, "pairs", None)
    got, want = registry.QUERIES[name](spark, corpus).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert len(want) and rows(got) == rows(want)


def test_pairs_of_one_long_sentence():
    import numpy as np

    starts, lens, ids = np.array([0, 5]), np.array([5, 3]), np.array([1, 2, 5, 7, 9, 2, 3, 4], np.int32)
    want = {(0, a, b) for a in ids[:5] for b in ids[:5] if a < b} | {(1, a, b) for a in ids[5:] for b in ids[5:] if a < b}
    for most in (3, 100):
        assert {x for part in O._pairs(starts, lens, ids, most) for x in zip(*part)} == want


def test_words_of_bytes(spark):
    """The tokeniser over bytes gives what the expressions give."""
    texts = ["", "...", "One two.THREE!?four five\nsix", "no mark at end", "Ünï ñ İstanbul K2 \u212aelvin a_b 9", "\n.\nlead. ", "x", "tail. ", None, "a b.c"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "lost words")], "doc_id long, text string").coalesce(1)
    for least in (1, 2, 4):
        want = C.tokens(C.sentences(docs), least).toPandas()
        assert len(want) and rows(C.document_tokens(docs, least).toPandas()) == rows(want)
        got = {r["token"]: r["docs"] for r in C.document_dictionary(docs.where("doc_id IS NOT NULL"), 1, least).collect()}
        assert got == {r["token"]: r["docs"] for r in C.dictionary(C.tokens(C.sentences(docs.where("doc_id IS NOT NULL")), least), 1).collect()}


@pytest.mark.parametrize("name", ["agg12_semantic_pairs", "join12_skipgrams", "agg4_word_context_counts", "agg5_relation_vocabulary", "set_operations"])
def test_skipgrams(spark, corpus, monkeypatch, name):
    """no token is shuffled."""
    monkeypatch.setattr(O, "EVENTS", 500)
    monkeypatch.setattr(O, "BLOCK", 900)
    monkeypatch.setattr(C, "skipgrams", None)
    monkeypatch.setattr(C, "occurrences", None)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{corpus}/documents.parquet/*.parquet'")
    got, want = registry.QUERIES[name](spark, corpus).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert len(want) and rows(got) == rows(want)


def test_skipgram_rows(spark, corpus):
    """the rows that training reads are those that are counted."""
    from lexloom.plans.corpus_queries import _vocabulary

    words = _vocabulary(spark, corpus)
    assert rows(words.skipgram_rows().groupBy("word", "context").count().withColumnRenamed("count", "n").toPandas()) == rows(words.skipgrams().toPandas())


def test_all_words_are_labelled(spark, monkeypatch):
    """the rule labels every word of the model, not the 500 commonest."""
    from lexloom.operators import training as M

    pairs = spark.createDataFrame([(f"{'ab'[i % 2] * (4 + i % 2)}{i:03}", f"r{i % 2}_c{i % 7}") for i in range(700) for _ in range(2)], "word string, context string")
    seen, fit = [], M.fit_logistic
    monkeypatch.setattr(M, "fit_logistic", lambda x, y, **how: seen.append(len(x)) or fit(x, y, **how))
    out = M.learn_relation_weights(pairs, lambda w: int(len(w) > 7), rounds=1, width=4, epochs=1)
    assert set(out) == {"r0", "r1"} and seen == [700]


CONTEXTS = ["join13_dependency_contexts", "agg16_relation_records", "join18_example_sentences", "join20_relation_weights", "dep4_context_lines"]


@pytest.mark.parametrize("name", CONTEXTS)
def test_contexts(spark, corpus, monkeypatch, tmp_path, name):
    """Of documents no two of which are the same, no token is shuffled or stored; of others, as
    before."""
    from lexloom.operators import dependency as D

    once = f"{tmp_path}/once"
    spark.read.parquet(f"{corpus}/documents.parquet").dropDuplicates(["doc_id"]).coalesce(2).write.parquet(f"{once}/documents.parquet")
    for path in (corpus, once):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
        if path == once:
            monkeypatch.setattr(D, "word_contexts", None)
        for query, sql in ((name, registry.ORACLES[name]), (f"{name}_every_word", registry.ORACLES[name].replace("BETWEEN 20 AND 60", ">= 20"))):
            got, want = registry.QUERIES[query](spark, path).toPandas(), con.sql(sql).df()
            assert len(want) and rows(got) == rows(want)


PARTS = ["join4_phrase_matches", "flt13_known_phrases", "join10_pair_contexts", "agg13_unique_contexts", "agg28_spans"]


@pytest.mark.parametrize("name", PARTS)
def test_cut_where_documents_lie(spark, corpus, monkeypatch, tmp_path, name):
    """phrases and contexts of pairs come from the tokeniser over bytes; sentences are not gathered for them."""
    once = f"{tmp_path}/once"
    docs = spark.read.parquet(f"{corpus}/documents.parquet").dropDuplicates(["doc_id"]).coalesce(2)
    docs.write.parquet(f"{once}/documents.parquet")
    spark.createDataFrame([(1, "a0word b0word tion c0word d0word ment elle")], "item_id long, text string").write.parquet(f"{once}/benchmark.parquet")
    monkeypatch.setattr(C, "pair_contexts", None)
    monkeypatch.setattr(C, "sentences", None)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{once}/{t}.parquet/*.parquet'")
    sql = registry.ORACLES[name]
    for query, sql in [(name, sql), *([(f"{name}_every_word", sql.replace("BETWEEN 20 AND 60", ">= 20"))] if "BETWEEN 20" in sql else [])]:
        got, want = registry.QUERIES[query](spark, once).toPandas(), con.sql(sql).df()
        assert len(want) and rows(got) == rows(want)


@pytest.mark.parametrize("most", [0, 4_000_000])
def test_phrases_sent_or_joined(spark, monkeypatch, most):
    """the walk at the workers gives what the joins give."""
    from lexloom.operators import phrases as P

    monkeypatch.setattr(P, "MOST_SENT", most)
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, ". ".join(" ".join(rng.choices("abcdef", k=rng.randrange(9))) for _ in range(4))) for i in range(40)], "doc_id long, text string")
    phrases = spark.createDataFrame([(p,) for p in ("a b", "a b c d", "b c", "c", "e f a", "f f")], "phrase string")
    assert rows(P.document_reform(docs, phrases).toPandas()) == rows(P.reform(C.sentences(docs), phrases).toPandas())
    assert rows(P.document_matches(docs, phrases).toPandas()) == rows(P.matches(C.sentences(docs), phrases).toPandas())
