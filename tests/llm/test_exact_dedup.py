import hashlib
import re
from collections import defaultdict

from lexloom.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append(r)
    out = []
    for key, members in groups.items():
        best = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        out += [(str(r["doc_id"]), str(best["doc_id"]), len(members), hashlib.sha256(key.encode()).hexdigest()) for r in members]
    return sorted(out)


def plain(rows):
    return sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in rows)


def test_against_brute_force(odd, clashing):
    rows = exact_dedup.report(clashing).collect()
    assert plain(rows) == brute(odd.collect())
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_real_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert plain(exact_dedup.report(docs).collect()) == brute(docs.collect())


def test_chains_when_keys_collide(odd):
    """All texts under one of three keys: the chains tell them apart by their bytes."""
    index = exact_dedup.build_index(odd, capacity=4, key_of=lambda text: (len(text) % 3 - 1) << 60)
    rows = exact_dedup.groups(index).collect()
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["sha"]) for r in rows)
    assert got == brute(odd.collect())


def test_directory_splits_and_doubles(spark):
    texts = spark.range(500).selectExpr("id as doc_id", "cast(id as string) as text")
    index = exact_dedup.build_index(texts, capacity=8)
    assert index.directory.doublings >= 6 and len(index.directory.buckets) >= 500 / 8
    sizes = index.buckets.groupBy("bucket").count().collect()
    assert max(r["count"] for r in sizes) <= 8 and sum(r["count"] for r in sizes) == 500
    for r in index.buckets.collect():
        assert index.directory.bucket(r["key"]) == r["bucket"]
    assert all(r["kept"] and r["group_size"] == 1 for r in exact_dedup.report(texts).collect())


def test_dedup(odd, clashing):
    out = exact_dedup.dedup(clashing)
    assert out.columns == clashing.columns
    got = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in out.collect()]
    assert sorted(got) == sorted({re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in odd.collect()})
    assert [r["doc_id"] for r in out.where("doc_id in (1, 2)").collect()] == [2]  # the longer text


def test_empty(nothing):
    assert exact_dedup.report(nothing).collect() == [] and exact_dedup.dedup(nothing).collect() == []


def test_buckets_lie_whole_in_contiguous_tasks(spark):
    from pyspark.sql import functions as F

    texts = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    index = exact_dedup.build_index(texts, capacity=40)
    placed = index.buckets.select("bucket", F.input_file_name().alias("f"))
    rows = placed.groupBy("bucket").agg(F.count_distinct("f").alias("files")).collect()
    assert len(rows) > 50 and all(r["files"] == 1 for r in rows)
    by_file = placed.groupBy("f").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).collect()
    spans = sorted((r["lo"], r["hi"]) for r in by_file)
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_directory_is_bounded(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "BUCKETS", 8)
    texts = spark.range(4000).select(F.xxhash64("id").alias("key"))
    assert len(exact_dedup.build_directory(texts, 1).buckets) <= 32


def test_texts_of_the_index_go_before_documents_move(odd, monkeypatch):
    """The log has all texts: with the documents and their shuffle it was over the pipeline's limit of disk."""
    import os

    written, write = {}, exact_dedup.materialize

    def spy(df, what):
        out = write(df, what)
        written[what] = out._lexloom_path.removeprefix("file://")
        return out

    monkeypatch.setattr(exact_dedup, "materialize", spy)
    out = exact_dedup.dedup(odd)
    assert not os.path.exists(written["log"]) and not os.path.exists(written["buckets"])
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect()) == sorted((str(r["doc_id"]), r["text"] or "") for r in exact_dedup.dedup(odd).collect())
    assert out.count() == exact_dedup.report(odd).where("kept").count()
