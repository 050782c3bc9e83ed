"""Literal fixtures, and kernels against slow or exact versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import clustering as K
from lexloom.operators import corpus as C
from lexloom.operators import dependency as D
from lexloom.operators import phrases as P
from lexloom.operators import search as S
from lexloom.operators import training as M
from lexloom.operators import triples as R
from lexloom.operators import vectors as V
from lexloom.operators.graph import silhouette_score
from lexloom.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_clean(spark):
    assert one(spark, T.clean_corpus(F.lit("Foo--bar (baz) a-b $x$"))) == "foo, bar a - b x"


def test_entity(spark):
    assert one(spark, T.entity(F.lit("b-tree"))) == "b_-_tree"


@pytest.mark.parametrize(
    "phrases,sentence,reformed,rescanned",
    [
        (["data structure", "data structure mining", "mining tool"], "data structure mining tool", "data_structure_mining tool", "data_structure_mining tool"),
        (["a b c d", "b c"], "a b c x", "a b c x", "a b_c x"),
        (["data structure", "data structure mining tool", "mining act"], "data structure mining act", "data_structure mining act", "data_structure mining_act"),
    ],
)
def test_reform(spark, phrases, sentence, reformed, rescanned):
    sents = spark.createDataFrame([(1, sentence), (2, "")], "sent_id long, sentence string")
    dictionary = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    for rescan, want in ((False, reformed), (True, rescanned)):
        assert [r["reformed"] for r in P.reform(sents, dictionary, rescan).collect()] == [want]


def test_reform_as_a_loop(spark):
    import random

    rng = random.Random(3)
    phrases = {" ".join(rng.choices("abcd", k=rng.randint(2, 4))) for _ in range(12)}
    heads = {tuple(p.split()[:n]) for p in phrases for n in range(1, 5)}
    whole = {tuple(p.split()) for p in phrases}
    sents = [(i, " ".join(rng.choices("abcde", k=rng.randint(1, 14)))) for i in range(120)]
    want = {}
    for i, text in sents:
        w, out, at = text.split(), [], 0
        while at < len(w):
            reach = 0
            while at + reach < len(w) and tuple(w[at : at + reach + 1]) in heads:
                reach += 1
            match = max((n for n in range(1, reach + 1) if tuple(w[at : at + n]) in whole), default=0)
            out += ["_".join(w[at : at + match])] if match else []
            out += w[at + match : at + max(reach, 1)]
            at += max(reach, 1)
        want[i] = " ".join(out)
    got = P.reform(spark.createDataFrame(sents, "sent_id long, sentence string"), spark.createDataFrame([(p,) for p in phrases], "phrase string"))
    assert {r["sent_id"]: r["reformed"] for r in got.collect()} == want


def test_all_matches(spark):
    sents = spark.createDataFrame([(1, "data structure mining")], "sent_id long, sentence string")
    phrases = ["data structure", "structure mining", "data structure mining"]
    assert {r["phrase"] for r in P.matches(sents, spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect()} == set(phrases)


def test_graph_by_hand(spark):
    occ = [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "b"), (3, "c"), (4, "a")]
    edges, nodes = C.pair_graph(C.sentence_sets(spark.createDataFrame(occ, "sent_id long, kw string")))
    assert {r["kw"]: r["c"] for r in nodes.collect()} == {"a": 3, "b": 4, "c": 3}
    got = {(r["u"], r["v"]): (r["c"], round(r["npmi"], 6)) for r in edges.collect()}
    assert got == {("a", "b"): (2, 1.313964), ("a", "c"): (1, 0.496141), ("b", "c"): (2, 1.313964)}


def test_single_pair_has_no_score(spark):
    edges, _ = C.pair_graph(C.sentence_sets(spark.createDataFrame([(1, "a"), (1, "b")], "sent_id long, kw string")))
    assert [r["npmi"] for r in edges.collect()] == [None]


def tokens(spark, text):
    return C.tokens(spark.createDataFrame([(1, text)], "sent_id long, sentence string"))


def test_pair_contexts(spark):
    keys = spark.createDataFrame([("k1",), ("k2",)], "token string")
    rows = C.pair_contexts(tokens(spark, "k1 w1 k2"), keys).collect()
    assert [(r["x"], r["y"], r["ctx"]) for r in rows] == [("k1", "k2", ["<X>", "w1", "<Y>"] + ["<pad>"] * 5)]
    gap = lambda n: C.pair_contexts(tokens(spark, "k1 " + "w " * (n - 1) + "k2"), keys).collect()
    assert "<pad>" not in gap(7)[0]["ctx"] and gap(8) == []


def test_window_pairs(spark):
    rows = C.window_pairs(tokens(spark, "a b c d e f g h")).collect()
    assert sum(r["c"] for r in rows) == 27
    assert {r["b"] for r in rows if r["a"] == "a"} == set("bcdefg")


def test_relation_prefix(spark):
    assert [one(spark, T.relation_prefix(F.lit(c))) for c in ("prep_in_java", "nsubj_java", "dobj")] == ["prep_in", "nsubj", "dobj"]


def test_suggestion_words(spark):
    said = F.array(*map(F.lit, ["data mining tools", "what is data mining", "data science"]))
    assert one(spark, T.suggestion_words(F.lit(" Data Mining"), said, F.array(F.lit("what"), F.lit("is")))) == ["data", "mining", "tools"]
    assert one(spark, T.suggestion_words(F.lit("data mining"), said)) == ["data", "mining", "tools", "what", "is"]


def test_related(spark):
    index = spark.createDataFrame([("k1", ["data", "mining", "tool"]), ("k2", ["data", "science"]), ("k3", ["mining", "data", "data"])], "keyword string, related array<string>")
    assert {r["word"]: r["weight"] for r in S.suggestion_weights(index, ["k1", "k2"]).collect()} == {"data": 2, "mining": 1, "tool": 1, "science": 1}
    assert [(r["keyword"], r["score"], r["overlap"]) for r in S.related(index, ["k1", "k2"]).collect()] == [("k3", 5, ["mining", "data", "data"]), ("k1", 4, ["data", "mining", "tool"]), ("k2", 3, ["data", "science"])]


def test_strict_search(spark):
    records = spark.createDataFrame([(1, "red data structure", "x"), (2, "data red structure", "x"), (3, "data structure", "red")], "id long, title string, tag string")
    index = S.postings(records, "id", {"title": "text", "tag": "id"})
    find = lambda q, f: sorted(r["id"] for r in S.strict(index, q, f, ["title"]).collect())
    assert find("data structure", ["title", "tag"]) == [1, 3] and find("data structure;red", ["title", "tag"]) == [1, 3]
    assert find("data structure;red", ["title"]) == [1] and find("data structure", ["tag"]) == [] and find(";", ["title"]) == []
    assert sorted(r["id"] for r in S.loose(index, "red", ["tag"]).collect()) == [3]


def test_redundancy_by_hand():
    assert R.without_redundant(["is a kind of", "is a", "uses"]) == ["is a", "uses"]
    assert R.without_redundant(["a  b", "a b "]) == ["a b"]


def test_patterns(spark):
    ctx = lambda s: F.array(*map(F.lit, s.split()))
    assert one(spark, R.is_preposition(ctx("<X> is used in <Y>"))) == "in" and one(spark, R.is_preposition(ctx("<X> is a <Y>"))) is None
    assert one(spark, R.is_a(ctx("<X> is an <Y>"))) and not one(spark, R.is_a(ctx("<X> was a <Y>")))


def test_scored_triples(spark):
    line = "0.763: (data mining; is; a process of)"
    assert one(spark, R.scored(F.lit(line), 0.7)) == "data mining; is; a process of" and one(spark, R.scored(F.lit(line), 0.765)) is None


def test_paths_need_a_common_root(spark):
    rows = [(0, "a", 0, "ROOT"), (1, "b", 1, "ROOT"), (2, "c", 0, "x")]
    parse = spark.createDataFrame([(1, *r) for r in rows], "sent_id long, tok_id int, form string, head int, rel string")
    path = lambda a, b: D.sentences_as_arrays(parse).select(D.path(F.col("tokens"), F.lit(a), F.lit(b)).alias("p")).first()["p"]
    assert path("a", "b") == "" and path("c", "a") == "i_x" and path("a", "c") == "x"


def test_bridges(spark):
    edges = spark.createDataFrame([("a", "m", 3, 0.5), ("b", "m", 3, 0.5), ("a", "n", 3, 0.5)], "u string, v string, c long, npmi double")
    assert [r["mid"] for r in C.bridges(edges, spark.createDataFrame([("a", "b")], "a string, b string")).collect()] == ["m"]


def test_analogies_by_hand(spark):
    vecs = spark.createDataFrame([(1, [1.0, 1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 1.0, 1.0]), (5, [0.0, 0.0, 1.0])], "id long, vec array<double>")
    asked = spark.createDataFrame([(0, 2, 1, 3)], "qid long, n1 long, p1 long, p2 long")
    for multiply, want in ((True, [1.28033, 0.5]), (False, [1.207107, 0.0])):
        rows = V.analogies(vecs, asked, 2, multiply).orderBy("rank").collect()
        assert [r["id"] for r in rows] == [4, 5] and np.allclose([r["score"] for r in rows], want, atol=1e-5)


def test_query_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    vecs = spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)
    asked = vecs.selectExpr("id AS qid", "vec")
    whole = sorted((r["qid"], r["id"], r["rank"]) for r in V.scores(vecs, asked, k=3).collect())
    monkeypatch.setattr(V, "QUERY_BLOCK", 16)
    assert sorted((r["qid"], r["id"], r["rank"]) for r in V.scores(vecs, asked, k=3).collect()) == whole and len(whole) == 180


def test_zero_vector(spark):
    assert one(spark, V.normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_softmax_mask():
    p = V.masked_softmax(np.array([[1.0, 2.0, 3.0], [0.0, 0.0, 0.0]]), np.array([[True, True, False], [False] * 3]))
    assert np.allclose(p[0, :2], np.exp([1, 2]) / np.exp([1, 2]).sum()) and not p[0, 2] and not p[1].any()


def test_leader_by_hand():
    x = np.array([[1, 0], [0.9, 0.1], [0, 1]])
    assert K.leader(x / np.linalg.norm(x, axis=1, keepdims=True), 0.8).tolist() == [0, 0, 1]


def test_dbscan_against_its_definition():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal([3, 0], 0.2, (20, 2)), rng.normal([0, 3], 0.2, (20, 2)), rng.normal(0, 3, (6, 2))])
    d = K.distances(x)
    labels = K.dbscan(d, 0.01, 4)
    core = (d <= 0.01).sum(1) >= 4
    reach = (d <= 0.01) & core[:, None] & core[None, :]
    for i in range(len(x)):
        for j in np.flatnonzero(reach[i]):
            assert labels[i] == labels[j] != K.NOISE
        if not core[i]:
            near = np.flatnonzero((d[i] <= 0.01) & core)
            assert (labels[i] == K.NOISE) == (not len(near)) and (not len(near) or labels[i] in labels[near])
    assert len({*labels[labels >= 0]}) == len({labels[i] for i in np.flatnonzero(core)})


def test_varied_density_ends():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal([5, 0, 0], 0.05, (15, 3)), rng.normal([0, 5, 0], 0.6, (15, 3)), np.zeros((1, 3))])
    labels = K.varied_density(x)
    assert len({*labels[:15]} - {K.NOISE}) >= 1 and len(labels) == 31
    assert -1 <= silhouette_score(x, labels) <= 1 and silhouette_score(x, np.full(31, K.NOISE)) == -1.0


def test_sampling_by_hand(spark):
    rows = C.sampling_table(spark.createDataFrame([("x", 1), ("y", 16)], "token string, cn long")).collect()
    assert {r["token"]: round(r["p"], 6) for r in rows} == {"x": 0.111111, "y": 0.888889}
    assert math.isclose(one(spark, C.keep_probability(F.lit(100), F.lit(1000))), 0.11)


def test_length_cover_by_hand(spark):
    rows = C.length_cover(spark.createDataFrame([(n,) for n in (1, 1, 2, 3, 10)], "n long")).where("enough").collect()
    assert min(r["n"] for r in rows) == 10


def test_filtered_rank_by_hand(spark):
    scored = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.8), (0, 2, 0.1)], "qid long, id long, score double")
    gold, true = (spark.createDataFrame([(0, i)], "qid long, id long") for i in (1, 0))
    assert [(r["rank"], r["reciprocal"]) for r in V.filtered_rank(scored, gold, true).collect()] == [(1, 1.0)]


def test_padding(spark):
    xy = F.array(F.lit("x"), F.lit("y"))
    assert one(spark, T.pad(xy, 6)) == ["x", "y"] + ["<pad>"] * 4 and one(spark, T.align(F.array_repeat(F.lit("w"), 7), 6)) is None


def test_sgns_learns(spark):
    """Two groups of words with contexts of their own come apart."""
    rng = np.random.default_rng(1)
    pairs = [(f"{g}{rng.integers(4)}", f"c{g}{rng.integers(4)}") for g in "ab" for _ in range(1500)]
    model = M.train_sgns(spark.createDataFrame(pairs, "word string, context string").repartition(2), width=8, epochs=4, negatives=3, rate=0.3, batch=64)
    assert model.losses[-1] < model.losses[0]
    v = {w: x / np.linalg.norm(x) for w, x in zip(model.words, model.vectors, strict=True)}
    same, cross = v["a0"] @ v["a1"], v["a0"] @ v["b1"]
    assert same > cross + 0.3


def test_weights_follow_the_classes(spark):
    """A relation whose contexts tell the classes apart gains over one that says nothing."""
    rng = np.random.default_rng(2)
    pairs = [(f"{g}{rng.integers(5)}", f"tell_{g}{rng.integers(2)}") for g in "ab" for _ in range(400)]
    pairs += [(f"{rng.choice(['a', 'b'])}{rng.integers(5)}", f"noise_{rng.integers(40)}") for _ in range(800)]
    w = M.learn_relation_weights(spark.createDataFrame(pairs, "word string, context string"), {f"{g}{i}": int(g == "a") for g in "ab" for i in range(5)}, rounds=2, width=6, epochs=2, rate=0.3, batch=64)
    assert w["tell"] > w["noise"]


def test_lstm_passes_padding_on():
    m = M.PairModel.random(5, 9, 4, 3, 2)
    ids = np.array([[2, 3, 1, 1], [2, 3, 4, 5]])
    full, short = m.encode(ids, ids != 1), m.encode(ids[:1, :2], np.ones((1, 2), bool))
    assert np.allclose(full[0], short[0]) and not np.allclose(full[0], full[1])


def test_loop_lowers_the_rate():
    losses = iter([5, 4, 6, 6, 6, 3, 9, 9, 9])
    best, rates = M.train_loop(lambda r: 0.0, lambda: next(losses), 9, 1.0, 0.5, patience=1)
    assert best == 3 and rates == [1.0, 1.0, 1.0, 1.0, 0.5, 0.5, 0.5, 0.5, 0.25]
    assert np.isclose(sum((g**2).sum() for g in M.clip([np.array([30.0, 40.0])], 10)), 100)


def test_model_round_trip(spark):
    path = files.shared_dir(spark, "model")
    files.save_model(spark, path, {"a": 1}, {"w": np.arange(6.0).reshape(2, 3), "i": np.array([1], np.int32)})
    config, arrays = files.load_model(spark, path)
    assert config == {"a": 1} and (arrays["w"] == np.arange(6.0).reshape(2, 3)).all() and arrays["i"].dtype == np.int32


def test_trie():
    assert files.trie_keywords('{"a": {"": 1, "b": {"": 1}}, "c": {"d": {}}}') == [("a", "a"), ("a b", "a_b")]


def test_binary_vectors(spark, tmp_path):
    rows = np.array([[3.0, 4.0], [0.0, 0.0]])
    (tmp_path / "v.bin").write_bytes(files.pack_vectors(["x", "y"], rows))
    got = {r["token"]: r["vec"] for r in files.binary_vectors(spark, str(tmp_path), normalize=True).collect()}
    assert np.allclose(got["x"], [0.6, 0.8]) and got["y"] == [0.0, 0.0]


def test_library_stands_without_the_subpackage():
    import pathlib

    root = pathlib.Path(files.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "lexloom.llm" in p.read_text()]
