import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(PATH)


def ids(own, text):
    return bpe.np.frombuffer(own.encode(text), "<u4").tolist()


TEXTS = ["", " ", "  ", "a", "Hello world, it's  two  spaces\n\n x", "\t b", "naïve café 漢字 😀😀", "<|endoftext|>", "a" * 300, "\r\n \x00 ", "don't 'S they'LL  ", " \n \n"]


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(own, library, text):
    assert ids(own, text) == library.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(own, library, text):
    assert ids(own, text) == library.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=40))
def test_appends_are_exact(own, library, a, b):
    grown = bpe.PrefixEncoder(own.vocabulary, a)
    grown.append(b)
    assert grown.ids() == bpe.PrefixEncoder(own.vocabulary, a + b).ids()
    assert b"".join(own.vocabulary.bytes[i] for i in grown.ids()) == a + b


def test_edits_are_exact(own):
    rng = random.Random(5)
    for _ in range(60):
        raw = bytes(rng.choice(b"the andreing stoion") for _ in range(rng.randint(0, 60)))
        start = rng.randint(0, len(raw))
        end = rng.randint(start, len(raw))
        new = bytes(rng.choice(b"abc the") for _ in range(rng.randint(0, 8)))
        edited = bpe.PrefixEncoder(own.vocabulary, raw)
        edited.edit(start, end, new)
        assert edited.ids() == bpe.PrefixEncoder(own.vocabulary, raw[:start] + new + raw[end:]).ids()


def test_edits_are_local(own):
    """However long the text, an edit at its start recomputes few prefixes."""
    rng = random.Random(6)
    raw = bytes(rng.choice(b"the andreing stoion") for _ in range(6000))
    for start, end, new in ((3, 9, b"xyz"), (0, 4, b""), (0, 0, b"ab"), (2990, 2991, b"q"), (5990, 6000, b"end")):
        edited = bpe.PrefixEncoder(own.vocabulary, raw)
        done = edited.edit(start, end, new)
        assert edited.last == bpe.PrefixEncoder(own.vocabulary, raw[:start] + new + raw[end:]).last and bytes(edited.raw) == raw[:start] + new + raw[end:]
        assert done <= len(new) + 2 * own.vocabulary.longest + 40


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=bpe.SHORT), max_size=12))
def test_many_at_once_as_one_by_one(own, pieces):
    assert own.vocabulary.encode(pieces) == [bpe.np.array(bpe.PrefixEncoder(own.vocabulary, x).ids(), "<u4").tobytes() for x in pieces]


def test_every_token_is_itself(own):
    some = [x for x in own.vocabulary.bytes[::7] if 0 < len(x) <= bpe.SHORT]
    assert own.vocabulary.encode(some) == [own.vocabulary.rank[x].to_bytes(4, "little") for x in some]


def test_digests(odd, clashing, library):
    want = sorted((str(r["doc_id"]), len(i), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in i)).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in odd.collect() for i in [library.encode_ordinary(r["text"] or "")])
    for docs in (odd, clashing):
        assert sorted((str(r[0]), *r[1:]) for r in bpe.digests(docs).collect()) == want


def test_column(odd, nothing):
    rows = bpe.encode_column(odd).collect()
    assert len(rows) == odd.count() and all(len(r["ids"]) % 4 == 0 for r in rows)
    assert bpe.digests(nothing).collect() == []


def test_real_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r["doc_id"]: len(library.encode_ordinary(r["text"] or "")) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.digests(docs).collect()} == want
