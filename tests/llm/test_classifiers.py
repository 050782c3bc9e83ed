import random
import zlib

import numpy as np
import pytest

from lexloom.llm import common, quality, toxicity

from .conftest import words


def corpus(spark, n=360):
    """Toxic documents hold a few bad words, misspelt in the held-out fold; poor ones shout."""
    rng, docs, labels = random.Random(6), [], []
    vocabulary = words(rng, 300).split()
    bad = ["grumblefist", "snarlwretch", "vilemonger"]
    for i in range(n):
        toxic, good = int(i % 6 == 0), int(i % 4 != 1)
        text = rng.choices(vocabulary, k=rng.randint(20, 120))
        if toxic:
            for _ in range(3):
                w = rng.choice(bad)
                if zlib.crc32(str(i).encode()) % 3 == 1:
                    k = rng.randrange(2, len(w) - 2)
                    w = w[:k] + "x" + w[k + 1 :]
                text.insert(rng.randrange(len(text)), w)
        if not good:
            text = [(w.upper() + "!!!") if rng.random() < 0.6 else w for w in text]
        docs.append((i, " ".join(text), "en", "s", i))
        labels.append((i, good, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = corpus(spark)
    return docs.cache(), labels.cache()


def accuracy(scores, labels, column, threshold):
    truth = {r["doc_id"]: r[column] for r in labels.collect()}
    held = [(r["score"] >= threshold) == bool(truth[r["doc_id"]]) for r in scores.collect() if common.fold(r["doc_id"]) == 1]
    return sum(held) / len(held)


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    assert accuracy(toxicity.score(docs, model), labels, "toxic", toxicity.THRESHOLD) > 0.93


def test_quality_held_out(labelled):
    docs, labels = labelled
    model = quality.train(docs, labels)
    assert accuracy(quality.score(docs, model), labels, "quality", quality.THRESHOLD) > 0.93
    kept = quality.accept(docs, model)
    assert kept.columns == docs.columns and 0.6 * docs.count() < kept.count() < 0.9 * docs.count()


def test_folds(spark):
    ids = [*range(50), -3, 10**15]
    rows = spark.createDataFrame([(i,) for i in ids], "i long").select("i", common.fold_column(common.F.col("i")).alias("f")).collect()
    assert all(r["f"] == common.fold(r["i"]) for r in rows)


def test_only_labelled_rows_of_the_other_folds(labelled):
    docs, labels = labelled
    sample = common.labelled_sample(docs, labels, "toxic", 1000, lambda t: t)
    texts = {r["text"]: r["doc_id"] for r in docs.collect()}
    assert sample and all(common.fold(texts[t]) != 1 for t, _ in sample)
    assert len(common.labelled_sample(docs, labels, "toxic", 5, len)) == 10
    again = common.labelled_sample(docs.repartition(7), labels.repartition(5), "toxic", 20, lambda t: t)
    assert again == common.labelled_sample(docs, labels, "toxic", 20, lambda t: t)


@pytest.mark.parametrize("op", [toxicity, quality])
def test_odd_rows(op, labelled, odd, clashing, nothing, spark):
    docs, labels = labelled
    model = op.train(docs, labels)
    rows = op.score(clashing, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert op.score(nothing, model).collect() == []
    equal = {}
    for r in op.score(odd, model).collect():
        if r["doc_id"] == 1:
            equal.setdefault(1, r["score"])
            assert equal[1] == r["score"]
    # no labels, labels of one class, null labels: no crash and one score for all
    for few in (labels.limit(0), labels.where("toxic = 0 and quality = 1"), spark.createDataFrame([(None, None, None)], labels.schema)):
        scores = {round(r["score"], 9) for r in op.score(odd, op.train(docs, few)).collect()}
        assert len(scores) == 1


def test_part_of_a_bucket_is_embedding_times_softmax():
    rng = np.random.default_rng(0)
    emb, out, bias = rng.normal(size=(toxicity.DIM, toxicity.BUCKETS)).astype(np.float32), rng.normal(size=(toxicity.DIM, 2)).astype(np.float32), np.array([0.1, -0.2], np.float32)
    model = toxicity.Toxicity(emb, out, bias)
    b, o, n = toxicity.subwords("grumble fist " * 40)
    best = -1e9
    for s in toxicity.passage_starts(n):
        inside = b[(o >= s) & (o < s + toxicity.WINDOW)]
        logits = emb[:, inside].sum(1) / max(len(inside), toxicity.FULL) @ out + bias
        best = max(best, logits[1] - logits[0])
    assert abs(model.passages(b, o, n).max() - best) < 1e-3


def test_neighbours_are_exact():
    rng = np.random.default_rng(2)
    vectors = quality._unit(rng.normal(size=(300, 8)))
    labels = rng.integers(0, 2, 300)
    model = quality.Quality(np.ones(quality.FEATURES, np.float32), rng.normal(size=(quality.FEATURES, 8)).astype(np.float32), vectors, labels)
    counts = np.zeros((150, quality.FEATURES), np.float32)
    counts[np.arange(150)[:, None], rng.integers(0, quality.FEATURES, (150, 20))] = 1
    got = model.scores(counts)
    for row, score in zip(counts, got, strict=True):
        x = model.project(row[None])[0]
        near = sorted(range(300), key=lambda i: (-round(float(vectors[i] @ x), 6), i))[: quality.K]
        w = [max(float(vectors[i] @ x), 0) ** quality.SHARPNESS * model.weight[i] for i in near]
        assert abs(score - sum(a * labels[i] for a, i in zip(w, near)) / sum(w)) < 1e-3
