"""Queries over keywords without the ceiling, on documents with words that are far above it: by the SQL of the
query with its ceiling taken out, and the contexts of pairs by hand."""

import random
import re
from collections import Counter

import duckdb
import pytest

from lexloom.plans import registry

from .test_registry import rows

NAMES = [n for n in registry.QUERIES if n.endswith("_every_word")]
HOT = ["often", "always"]


def texts():
    rng = random.Random(8)
    rare = [f"word{i}" for i in range(8)]
    return [" ".join(rng.choice(HOT if rng.random() < 0.3 else [*rare, "of", "in", "a"]) for _ in range(12)) + ". Once often." for _ in range(60)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hot"))
    spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def test_names():
    assert len(NAMES) == 14
    assert all("BETWEEN 20 AND 60" in registry.ORACLES[n] for x in NAMES if (n := x.removesuffix("_every_word")) in registry.ORACLES)


@pytest.mark.parametrize("name", [n for n in NAMES if n.removesuffix("_every_word") in registry.ORACLES])
def test_without_ceiling(spark, small, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet/*.parquet'")
    sql = registry.ORACLES[name.removesuffix("_every_word")]
    got, want = registry.QUERIES[name](spark, small).toPandas(), con.sql(sql.replace("BETWEEN 20 AND 60", ">= 20")).df()
    assert len(want) and rows(got) == rows(want)
    assert rows(want) != rows(con.sql(sql).df())


def test_pair_contexts_by_hand(spark, small):
    sents = [re.findall(r"\w+", s) for t in texts() for s in t.lower().split(".")]
    counts = Counter(w for s in sents for w in s)
    keys = {w for w, n in counts.items() if n >= 20 and len(w) >= 4}
    assert min(counts[w] for w in HOT) > 60
    want = Counter()
    for s in sents:
        for i, x in enumerate(s):
            for j in range(i + 1, min(i + 8, len(s))):
                if x in keys and s[j] in keys:
                    want[x, s[j], " ".join((["<X>", *s[i + 1 : j], "<Y>"] + ["<pad>"] * 8)[:8])] += 1
    got = registry.QUERIES["join10_pair_contexts_every_word"](spark, small).collect()
    assert Counter((r["x"], r["y"], r["ctx"]) for r in got) == want


@pytest.mark.parametrize("name", ["ml5_weighted_sgns_every_word", "ml6_relation_weights_every_word"])
def test_trained(spark, small, name):
    out = registry.QUERIES[name](spark, small).toPandas()
    assert len(out)
    if "token" in out:
        assert set(HOT) <= set(out["token"])
