import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lexloom.llm import bpe, exact_dedup, mixing, quality, simhash  # noqa: E402
from lexloom.llm.common import table  # noqa: E402

from .test_exact_dedup import brute as equal_groups  # noqa: E402
from .test_simhash import brute as near_groups  # noqa: E402


def test_each_stage_on_its_own_input(spark, sf_dir, tmp_path):
    docs, ins, outs = table(spark, sf_dir, "documents"), [], []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        ins.append(docs)
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        outs.append(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources", "BPE encoding"]
    assert all(o.columns == ins[0].columns for o in outs[:-1])

    model = quality.train(ins[0], table(spark, sf_dir, "labels"))
    good = {r["doc_id"] for r in quality.score(ins[0], model).where("score >= 0.5").collect()}
    assert {r["doc_id"] for r in outs[0].collect()} == good and len(good) < ins[0].count()

    assert {r[0] for r in equal_groups(ins[1].collect()) if r[0] == r[1]} == {str(r["doc_id"]) for r in outs[1].collect()}
    assert {r[0] for r in near_groups(ins[2].collect()) if r[0] == r[2]} == {str(r["doc_id"]) for r in outs[2].collect()}

    taken = {}
    for r in outs[3].collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.totals(ins[3]).collect() if r["size"]}
    assert all(taken.get(d, 0) == n for d, n in want.items())

    rows = outs[4].collect()
    texts = {r["doc_id"]: r["text"] for r in ins[4].collect()}
    assert len(rows) == ins[4].count()
    assert all(r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest() for r in rows)


def test_run_is_the_stages(spark, sf_dir):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) for _ in range(2))
    assert a == b and len(a) > 50


def test_odd_rows_and_empty_tables(spark, clashing, nothing, sf_dir):
    for docs in (clashing, nothing):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            assert k == 4 or out.columns == docs.columns
            out.collect()


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert {bpe, exact_dedup, mixing, quality, simhash}
