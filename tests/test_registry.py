"""Queries against their SQL, on the smallest tables; texts, joins, searches and files each have a few here, and the
rest run with LEXLOOM_ALL=1."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from lexloom.plans import registry

CORE = ["related_keywords", "txt1_clean_corpus", "txt12_stable_keywords", "txt14_padding", "txt17_highlight", "txt19_suggestion_words", "txt28_rouge", "join2_vocabulary_lookup", "join4_phrase_matches", "join8_bridges", "join9_shared_sentences", "join10_pair_contexts", "join11_window_pairs", "join12_skipgrams", "join13_conll_contexts", "join14_pair_contexts", "agg2_merge_counts", "agg3_vocabulary", "agg10_npmi", "agg21_hubs", "agg23_filtered_rank", "dep2_path_dataset", "oie1_scored_triples", "oie6_spans", "srh3_strict", "srh4_ranking", "agg18_overlap", "vec6_analogy_multiply", "vec13_ngram_vectors", "top3_nearest_to_sum", "clu2_silhouette", "clu6_kmeans_one_round", "clu8_descendants", "join15_known_edges", "src6_json_lists", "src7_pair_csv", "src9_text_vectors", "src14_listed_vocab", "src16_triple_file", "stream_token_counts"]
NAMES = [n for n in registry.ORACLES if os.environ.get("LEXLOOM_ALL") or n in CORE]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        if isinstance(x, float):
            return f"{x:.6g}"
        return str(list(x)) if isinstance(x, (list, np.ndarray)) else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_as_sql(spark, duck, sf_dir, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_names():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and set(CORE) <= set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["u", "v", "c", "npmi"] and df.count() == 20
