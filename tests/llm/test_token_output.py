import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexloom.llm import token_output as out
from lexloom.llm.common import shared_dir

PATH = public_tokenizers.path(out.TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("ab #<|>\n", max_size=20) | st.sampled_from(["<|endoftext|>", "a <|endoftext|> b", "# a\n <|endoftext|>"]), max_size=4))
def test_chunks_as_the_library(library, texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in out.encoder(PATH).encode(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 100, 5000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
    slots = out.PerfectHash.build(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    dense = np.arange(n, dtype=np.int64)
    assert sorted(out.PerfectHash.build(dense).slots(dense).tolist()) == list(range(n))


def test_shard_lookup():
    keys, counts = [out.NULL_KEY, -5, 3, 3, 9], [1, 2, 1, 4, 2]
    ids = np.array([2, 70000, 2, 2, 2, 5, 6, 2, 8, 2], "<u4")
    s = out.Shard(*out.files_of(keys, counts, ids, True))
    assert [[x.tolist() for x in s.get(k)] for k in (None, -5, 3, 9)] == [[[2]], [[70000, 2]], [[2], [2, 5, 6, 2]], [[8, 2]]]
    assert all(s.get(k) is None for k in (4, 0, 10**12, -6))
    with pytest.raises(ValueError):
        out.Shard(b"nothing" * 10, b"nothing" * 10)


def brute(rows, library):
    found, start = [], 0
    encoded = [(r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in rows]
    for doc, ids in sorted(encoded, key=lambda x: (x[0] is not None, x[0] or 0)):
        found.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


def test_report(odd, clashing, library):
    got = sorted((tuple(r) for r in out.report(clashing).collect()), key=lambda r: r[1])
    want = brute(odd.collect(), library)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == sorted((str(r[0]), r[2], r[3]) for r in want)
    assert [r[1] for r in got] == np.r_[0, np.cumsum([r[2] for r in got])[:-1]].tolist()


def test_many_shards(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark, "test")
    manifest = out.write_shards(docs, folder, shard_bytes=40_000)
    assert manifest.count() > 3
    got = sorted((tuple(r) for r in out.read_shards(manifest, folder).collect()), key=lambda r: r[1])
    assert got == brute(docs.collect(), library)


def test_empty(nothing):
    assert out.report(nothing).collect() == []


def test_end_id_in_texts_of_one_key(spark, library):
    rows = [(i, t) for i in (1, None) for t in ("# a", "# a", "#", "", "b # c <|endoftext|> d", "<|endoftext|>", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in out.report(docs).collect()), key=lambda r: r[1])
    want = brute(docs.collect(), library)
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == sorted((str(r[0]), r[2], r[3]) for r in want)
    assert [r[1] for r in got] == np.r_[0, np.cumsum([r[2] for r in got])[:-1]].tolist()


def test_reader_and_shards_by_rows(spark, library):
    rows = [(i // 3 - 10, "# x" if i % 2 else "") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = shared_dir(spark, "test")
    manifest = out.write_shards(docs, folder, shard_rows=50)
    assert manifest.count() >= 10 and manifest.agg({"documents": "max"}).first()[0] < 200
    reader = out.Reader(manifest, folder)
    for key in (-10, 0, 100, 189):
        want = sorted(library.encode(t, add_special_tokens=False).ids + [2] for k, t in rows if k == key)
        assert sorted(x.tolist() for x in reader.get(key)) == want
    assert reader.get(1000) == [] and reader.get(None) == []


def test_manifest_starts_over_blocks(spark):
    rows = [(i, 0, 0, 1, i * 7 % 5 + 1) for i in range(23)]
    got = sorted((r["shard"], r["start"]) for r in out._started(spark.createDataFrame(rows, "shard long, first long, last long, documents long, ids long"), 4).collect())
    assert got == [(i, sum(r[4] for r in rows[:i])) for i in range(23)]


def test_split_of_the_tokenizer_is_the_one_built_here():
    import json

    with open(PATH, encoding="utf-8") as f:
        found = json.load(f)
    assert found["normalizer"] is None and found["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    assert [t["content"] for t in found["added_tokens"]] == ["<|endoftext|>"]
