"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can end its encoding: the encoding of a prefix is unique, and so
is its last token. ``PrefixEncoder`` stores that token for each prefix. The token t may end prefix i if it matches
the bytes before i and the pair (last token of the prefix before t, t) is one that merging would leave standing: the
pair test undoes the merges on both sides of the border, latest first, and looks for an earlier one across it. So
appending bytes goes on from the stored tokens, and an edit recomputes only the prefixes near it: both give exactly
the tokens of encoding anew.

``Vocabulary.encode`` runs the same recurrence on many short strings at once, a prefix length at a time: tokens are
found by the hashes of substrings (128 bits), and the pair test is a loop over arrays.

Texts are cut by the public pattern first, each match is encoded by itself. A null text is empty and has no ids. Very
long texts are like others; a very long match is encoded by ``PrefixEncoder``. Repeated rows get equal results, an
empty table an empty one; only doc_id and text are read, so that other columns may have any names. A worker keeps the
ids of a bounded number of frequent chunks.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from lexloom.llm.common import as_text, slices

RANKS = "byte_bpe_50k.tiktoken"
#: Chunks whose ids a worker keeps (those met lately, and as many of before), the longest in characters, pairs of tokens
#: whose test it keeps.
KEPT_CHUNKS, KEPT_CHARS, KEPT_PAIRS = 80_000, 48, 50_000
#: Longest strings that are encoded many at once, how many; characters that are cut into chunks at once.
SHORT, AT_ONCE, SEGMENT = 32, 16_384, 4_000_000
#: Texts that are encoded at once: the more, the fewer their unknown chunks and the longer the arrays.
TEXTS = 1024
#: Bases of the two polynomial hashes, and the bits of the token table.
_BASES, _TABLE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), 18


class Vocabulary:
    """Byte strings by rank, and which pairs of neighbours merging leaves standing."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.rank.values()) + 1
        self.bytes = [b""] * size
        for raw, r in self.rank.items():
            self.bytes[r] = raw
        self.length = np.fromiter(map(len, self.bytes), np.int64, size)
        self.longest = int(self.length.max())
        #: All tokens' bytes, one behind the other, and where each begins.
        self.flat, self.start = np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(self.length) - self.length
        self._powers = [np.cumprod(np.r_[1, np.full(2 * self.longest, b, np.uint64)].astype(np.uint64), dtype=np.uint64) for b in _BASES]
        self._hash = [np.zeros(size, np.uint64) for _ in _BASES]
        for n in range(1, self.longest + 1):
            of = np.flatnonzero(self.length == n)
            if len(of):
                raw = self.flat[self.start[of][:, None] + np.arange(n)]
                for h, base in zip(self._hash, _BASES, strict=True):
                    h[of] = self._prefixes(raw, base)[:, n]
        self._index()
        #: The two tokens whose merge makes each token; -1 for single bytes. They are the last two left when its bytes
        #: are merged by lower ranks only.
        self.halves = np.full((size, 2), -1, np.int64)
        for n in range(2, self.longest + 1):
            of = np.flatnonzero(self.length == n)
            if len(of):
                self._halve(of, n)
        #: By a << 32 | b.
        self._stands: dict[int, bool] = {}

    @staticmethod
    def _prefixes(raw: np.ndarray, base: int) -> np.ndarray:
        """Hashes of all prefixes of each row, of the empty one first."""
        out = np.zeros((len(raw), raw.shape[1] + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(raw.shape[1]):
                out[:, k + 1] = out[:, k] * np.uint64(base) + (raw[:, k].astype(np.uint64) + np.uint64(1))
        return out

    def _index(self) -> None:
        """An open table of the tokens by their first hash."""
        self._slots = np.full(1 << _TABLE, -1, np.int32)
        tokens = np.flatnonzero(self.length)
        for token, at in zip(tokens.tolist(), self._slot(self._hash[0][tokens]).tolist(), strict=True):
            while self._slots[at] >= 0:
                at = at + 1 & (1 << _TABLE) - 1
            self._slots[at] = token

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        """Where the search for a first hash begins."""
        with np.errstate(over="ignore"):
            return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - _TABLE)).astype(np.int64)

    def find(self, h: np.ndarray, check) -> np.ndarray:
        """The token with each first hash, or -1; ``check`` (numbers of places) gives their second hashes."""
        out = np.full(len(h), -1, np.int64)
        at, left = self._slot(h), np.arange(len(h))
        while len(left):
            token = self._slots[at]
            there = token >= 0
            left, at, token = left[there], at[there], token[there]
            same = self._hash[0][token] == h[left]
            hit, t = left[same], token[same]
            sure = self._hash[1][t] == check(hit)
            out[hit[sure]] = t[sure]
            left, at = left[~same], at[~same] + 1 & (1 << _TABLE) - 1
        return out

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that is a's bytes and then b's, or -1."""
        n = self.length[b]
        with np.errstate(over="ignore"):
            h, g = (x[a] * p[n] + x[b] for x, p in zip(self._hash, self._powers, strict=True))
        return self.find(h, lambda k: g[k])

    def _halve(self, of: np.ndarray, n: int) -> None:
        """The halves of the tokens ``of``, all n bytes long: the cut whose pair stands against all lower ranks."""
        raw = self.flat[self.start[of][:, None] + np.arange(n)]
        (h, g) = (self._prefixes(raw, b) for b in _BASES)
        for cut in range(1, n):
            with np.errstate(over="ignore"):
                tail, tail2 = (x[:, n] - x[:, cut] * p[n - cut] for x, p in zip((h, g), self._powers, strict=True))
            a, b = self.find(h[:, cut], lambda k, c=cut: g[k, c]), self.find(tail, lambda k, t=tail2: t[k])
            may = np.flatnonzero((a >= 0) & (b >= 0) & (a < of) & (b < of))
            good = may[self.standing(a[may], b[may], of[may])]
            self.halves[of[good]] = np.stack([a[good], b[good]], 1)

    def standing(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """``stands`` for many pairs; merges of ``limit`` and above are left out."""
        out, left = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), 1 << 62, np.int64) if limit is None else limit
        while len(left):
            both = self._joined(a, b)
            bad = (both >= 0) & (both < limit)
            out[left[bad]] = False
            inner, outer = self.halves[a, 1], self.halves[b, 0]
            # undo the later of the two merges; of equal ones the right, as merging goes from the left
            in_a = (inner >= 0) & ((a > b) | (outer < 0))
            on = ~bad & (in_a | (outer >= 0))
            limit = np.where(in_a, a, b + 1)[on]
            a, b, left = np.where(in_a, inner, a)[on], np.where(in_a, b, outer)[on], left[on]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many byte strings that aren't empty, up to SHORT bytes each."""
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        out: list[bytes] = [b""] * len(pieces)
        for lo in range(0, len(order), AT_ONCE):
            mine = order[lo : lo + AT_ONCE]
            for i, ids in zip(mine, self._encode([pieces[i] for i in mine]), strict=True):
                out[i] = ids
        return out

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        """Longest first."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        most = int(size[0])
        raw = np.frombuffer(b"".join([x.ljust(most, b"\0") for x in pieces]), np.uint8).reshape(-1, most)
        h, g = (self._prefixes(raw, b) for b in _BASES)
        last = np.full((len(pieces), most + 1), -1, np.int32)
        for end in range(1, most + 1):
            left = np.arange(np.searchsorted(-size, -end, "right"))
            for n in range(min(end, self.longest), 0, -1):
                with np.errstate(over="ignore"):
                    token = self.find(h[left, end] - h[left, end - n] * self._powers[0][n], lambda k, n=n, e=end, at=left: g[at[k], e] - g[at[k], e - n] * self._powers[1][n])
                hit = np.flatnonzero(token >= 0)
                if n < end:
                    hit = hit[self.standing(last[left[hit], end - n].astype(np.int64), token[hit])]
                last[left[hit], end] = token[hit]
                left = np.delete(left, hit)
                if not len(left):
                    break
            else:
                raise ValueError(f"no token ends the prefix of {end} bytes: the vocabulary lacks a byte")
        # from each end back to its beginning, all at once
        row, at, found = np.arange(len(pieces)), size.copy(), []
        while len(row):
            token = last[row, at[row]]
            found.append((row, token))
            at[row] -= self.length[token]
            row = row[at[row] > 0]
        rows, tokens = np.concatenate([r for r, _ in found][::-1]), np.concatenate([t for _, t in found][::-1])
        packed = tokens[np.argsort(rows, kind="stable")].astype("<u4").tobytes()
        edge = np.r_[0, np.cumsum(np.bincount(rows, minlength=len(pieces)))] * 4
        return [packed[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

    def stands(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of a and b together gives a, b: no merge across the border comes first."""
        key = a << 32 | b
        if (known := self._stands.get(key)) is None:
            if len(self._stands) > KEPT_PAIRS:
                self._stands.clear()
            known = self._stands[key] = self._check(a, b)
        return known

    def _check(self, a: int, b: int) -> bool:
        return bool(self.standing(np.array([a]), np.array([b]))[0])


class PrefixEncoder:
    """The last token of every prefix of one byte string, for exact appends and edits."""

    def __init__(self, vocabulary: Vocabulary, raw: bytes = b""):
        self.vocabulary = vocabulary
        self.raw = bytearray()
        self.last: list[int] = []
        self.append(raw)

    def append(self, more: bytes) -> None:
        self.raw += more
        self._grow(len(self.raw))

    def _grow(self, to: int) -> None:
        """Last tokens of the prefixes up to ``to`` bytes."""
        rank, known, stands, longest, whole, last = self.vocabulary.rank, self.vocabulary._stands, self.vocabulary.stands, self.vocabulary.longest, self.raw, self.last
        for end in range(len(last) + 1, to + 1):
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                token = rank.get(bytes(whole[start:end]))
                if token is None:
                    continue
                if not start:
                    break
                before = last[start - 1]
                pair = before << 32 | token
                if known[pair] if pair in known else stands(before, token):
                    break
            else:
                raise ValueError(f"no token ends the prefix of {end} bytes: the vocabulary lacks a byte")
            last.append(token)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace raw[start:end]; how many prefixes were computed anew.

        A last token depends on those of the prefixes before it, as far back as the longest token. Once behind the edit
        that many have come out as they were, all others will.
        """
        old, begun = self.last, start + len(new)
        shift = begun - end
        self.raw[start:end] = new
        self.last = old[:start]
        alike, at = 0, start
        while at < len(self.raw) and alike < self.vocabulary.longest:
            at += 1
            self._grow(at)
            alike = alike + 1 if at > begun and old[at - shift - 1] == self.last[-1] else 0
        self.last += old[at - shift :] if at < len(self.raw) else []
        return at - start

    def ids(self) -> list[int]:
        out, at = [], len(self.last)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.bytes[out[-1]])
        return out[::-1]


class Encoder:
    """Whole texts to packed little-endian unsigned 32-bit ids and back.

    A space before anything but white space always opens a match, so a text's ids are those of the chunks that begin
    there, one behind the other. Chunks are told apart and their ids put together in arrays; those that aren't known yet
    are cut by the pattern (letters alone are one piece) and their pieces encoded many at once. Texts in which a space stands elsewhere are cut whole.
    """

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.vocabulary = Vocabulary(path)
        self._find = regex.compile(pattern).findall
        self._odd = regex.compile(r" (?=\s|$)").search
        #: Ids of chunks without their space: those met lately, and those of before, which go when the first are many.
        self._chunks: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empties the tables of chunks and pairs; the vocabulary stays."""
        self._chunks, self._before = {}, {}
        self.vocabulary._stands.clear()

    def _pieces(self, lists: list[list[str]]) -> list[bytes]:
        """Packed ids of each list of matches."""
        rank, ids, short = self.vocabulary.rank, {}, []
        for piece in dict.fromkeys(x for found in lists for x in found):
            raw = piece.encode("utf-8", "surrogatepass")
            one = rank.get(raw)
            if one is not None:
                ids[piece] = one.to_bytes(4, "little")
            elif len(raw) <= SHORT:
                short.append((piece, raw))
            else:
                ids[piece] = np.array(PrefixEncoder(self.vocabulary, raw).ids(), "<u4").tobytes()
        for (piece, _), packed in zip(short, self.vocabulary.encode([raw for _, raw in short]), strict=True):
            ids[piece] = packed
        return [b"".join([ids[x] for x in found]) for found in lists]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        owner, parts, held = [], [], 0
        for k, text in enumerate(texts):
            if self._odd(text):
                out[k] = self._pieces([self._find(text)])
                continue
            for part in _segments(text):
                owner.append(k)
                parts.append(part)
                held += len(part)
                if held > SEGMENT:
                    self._flush(owner, parts, out)
                    owner, parts, held = [], [], 0
        self._flush(owner, parts, out)
        return [b"".join(x) for x in out]

    def _flush(self, owner: list[int], parts: list[str], out: list[list[bytes]]) -> None:
        if not parts:
            return
        lists = pc.split_pattern(pa.array(parts, pa.large_string()), " ")
        place, flat = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        which, chunks = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_pylist()
        heads = [chunks[which[p]] for p in place[:-1]]
        if len(self._chunks) > KEPT_CHUNKS:
            self._before, self._chunks = self._chunks, {}
        table, before = self._chunks, self._before
        asked = []
        for x in chunks:
            if x not in table:
                if x in before:
                    table[x] = before[x]
                else:
                    asked.append(x)
        table.update(zip(asked, self._pieces([[" " + x] if x.isalpha() else self._find(" " + x) for x in asked]), strict=True))
        # a head has no space before it, so each is an entry of its own behind the chunks
        which[place[:-1]] = len(chunks) + np.arange(len(heads))
        known = [*map(table.__getitem__, chunks), *self._pieces([self._find(x) for x in heads])]
        for x in asked:
            if len(x) > KEPT_CHARS:
                del table[x]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids = np.frombuffer(b"".join(known), "<u4")[_runs(np.cumsum(size)[which] - size[which], size[which])]
        edge = np.r_[0, np.cumsum(size[which])][place]
        for k, a, b in zip(owner, edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            out[k].append(ids[a:b].tobytes())

    def decode(self, packed: bytes) -> bytes:
        ids, v = np.frombuffer(packed, "<u4"), self.vocabulary
        return b"".join([v.flat[_runs(v.start[x], v.length[x])].tobytes() for x in (ids[at : at + SEGMENT] for at in range(0, len(ids), SEGMENT))])


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for n numbers each, one run behind the other."""
    end = np.cumsum(n)
    return np.repeat(start - (end - n), n) + np.arange(end[-1] if len(end) else 0)


def _segments(text: str) -> Iterator[str]:
    """Parts of at most about SEGMENT characters; each but the first begins with the space that opens a chunk."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = text.find(" ", at + SEGMENT)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker, as its vocabulary serves all tasks; what a task has learnt of chunks goes with it, as other
    stages may need the memory."""
    return Encoder(path)


def encode_column(docs: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, ids binary (packed unsigned 32-bit), decoded binary."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in slices(batches, TEXTS):
            ids = own.encode_all(as_text(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])
        own.forget()

    return docs.select("doc_id", column).mapInArrow(run, docs.select("doc_id").schema.add("ids", "binary").add("decoded", "binary"))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs -> doc_id, n_tokens, ids_sha256, decoded_sha256, without sending the ids through Spark."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in slices(batches, TEXTS):
            count, ids, decoded = [], [], []
            for packed in own.encode_all(as_text(batch.column(1))):
                count.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(own.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.forget()

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string"))
