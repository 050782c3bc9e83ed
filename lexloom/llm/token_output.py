"""Token ids in binary shards with a minimal perfect hash index.

Range partitions of the documents by doc_id become shards: a task encodes the texts of one partition in order and
writes their ids. A shard is two files: ``ids-NNNNN.bin`` (a header, then the raw little-endian ids of its documents in ascending
order of doc_id, 16 bits each where the ids fit, else 32, then the key and the number of ids of each document) and
``idx-NNNNN.bin``, a minimal perfect hash: a displacement for each bucket of keys sends every key of the shard to a slot of its own, and the slot holds the key's
fingerprint, its offset and its number of ids. A key costs two hashes and one slot, however many there are; another
key's fingerprint differs but once in 2**32. ``manifest`` has a row a shard: first and last key, ids before it.
``Reader`` finds the shards of any key by the manifest and its documents there by the index.

Files are written under a task's own name and renamed, and hold the same bytes whichever task writes them, so that a
lost executor's shards are just written again.

Null texts are empty: they hold the end id alone. Documents with the same doc_id (or none; null comes first) stand
one behind the other, in order of a hash of their texts, and those of them that one shard holds share an entry, which
says how many they are; reading cuts them by their stored numbers of ids, as the end id may be any text's too. However
many share an id, they may lie in several shards. A null id is stored as the least 64-bit number, and an id of that
value is read as null. The string of a special token in a text gets that token's id, as the library does it. Very long
texts are encoded in parts, with the same ids. Only doc_id and text are read, so that other columns may have any names.
An empty table gives no shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import as_text, materialize, shared_dir, slices

TOKENIZER, END = "byte_bpe_50k.json", 2
#: Bytes of text and documents in a shard, about; keys that share a displacement, about; the key of a null doc_id.
SHARD_BYTES, SHARD_ROWS, LOAD, NULL_KEY = 32_000_000, 250_000, 4, -(1 << 63)
#: Shards whose ids are summed by one window when the manifest is numbered.
MANIFEST_BLOCK = 4096
#: Chunks that a worker keeps, if no longer than so many characters; characters that arrays are made of at once.
KEPT_CHUNKS, KEPT_BARE, KEPT_CHARS, SEGMENT = 500_000, 200_000, 48, 1_000_000
MAGIC = b"LXID"


class Encoder:
    """The tokenizers library, asked once for each frequent chunk of text.

    A space before anything but white space opens a piece of its own under this tokenizer's split, so a text's ids
    are those of the chunks that begin there, one behind the other. Chunks are told apart and their ids put together
    in arrays; those that aren't known yet are cut by the split's pattern, and the library's model gets their pieces
    in its byte alphabet. Texts in which a space stands elsewhere, or that hold the string of a special token, go to the
    library whole.
    """

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        from tokenizers import Tokenizer

        self._own = Tokenizer.from_file(path)
        self._special = [t.content for t in self._own.get_added_tokens_decoder().values()]
        self._find = regex.compile(pattern).findall
        self._model = self._own.model  # each access copies it
        self._byte = {b: c for b, c in enumerate(_byte_alphabet())}
        #: Ids of chunks without their space: those met lately, and those of before, which go when the first are many.
        self._chunks: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}
        #: Ids of pieces without a space before them, as punctuation and the words that begin a line.
        self._bare: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._own.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self._model.tokenize(piece.encode().decode("latin-1").translate(self._byte))]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk and the space before it."""
        if chunk.isalpha():  # letters are one piece; those of ASCII stand for themselves
            return array("I", [t.id for t in self._model.tokenize(self._byte[32] + chunk)]).tobytes() if chunk.isascii() else self._piece(" " + chunk)
        first, *rest = self._find(" " + chunk)
        word, bare = first[1:], self._bare
        out = [self._chunks.get(word) or self._before.get(word) or self._piece(first)]
        for piece in rest:
            if (ids := bare.get(piece)) is None:
                if len(bare) > KEPT_BARE:
                    bare.clear()
                ids = bare[piece] = self._piece(piece)
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        owner, parts, held = [], [], 0
        for k, text in enumerate(texts):
            if _odd(text) or any(x in text for x in self._special):
                out[k] = self._ids([text])
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
        which, chunks = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = [chunks[which[p]] for p in place[:-1]]
        if len(self._chunks) > KEPT_CHUNKS:
            self._before, self._chunks = self._chunks, {}
        table, before = self._chunks, self._before
        asked = [x for x in chunks if x not in table]
        for x in asked:
            table[x] = before[x] if x in before else self._chunk(x)
        # a head has no space before it, so each is an entry of its own behind the chunks
        which[place[:-1]] = len(chunks) + np.arange(len(heads))
        known = [*map(table.__getitem__, chunks), *self._ids(heads)]
        for x in asked:
            if len(x) > KEPT_CHARS:
                del table[x]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        start, n = np.cumsum(size) - size, size[which]
        end = np.cumsum(n)
        ids = np.frombuffer(b"".join(known), "<u4")[np.repeat(start[which] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
        edge = np.r_[0, end][place]
        for k, a, b in zip(owner, edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            out[k].append(ids[a:b].tobytes())


def _odd(text: str) -> bool:
    """Whether a space stands before white space or at the end."""
    return "  " in text or text[-1:] == " " or " \n" in text or (not text.isascii() or any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f")) and _SPACES(text) is not None


_SPACES = regex.compile(r" (?=[\s\x1c-\x1f])").search


def _byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else one of those from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


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
    return Encoder(path)


def mix(keys: np.ndarray, seed) -> np.ndarray:
    """A 64-bit mixing of signed keys with a seed (or one a key)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + (np.asarray(seed, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct keys: buckets, largest first, try displacements until their slots are free."""

    def __init__(self, displacement: np.ndarray, n: int):
        self.displacement, self.n = displacement, n

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        m = max(1, -(-n // LOAD))
        bucket = (mix(keys, 0) % np.uint64(m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=m)
        start = np.r_[0, np.cumsum(size)]
        taken, out = np.zeros(n, bool), np.zeros(m, np.uint32)
        for b in np.argsort(-size, kind="stable").tolist():
            mine = keys[order[start[b] : start[b + 1]]]
            if not len(mine):
                break
            seed = 1
            while True:
                seeds = np.arange(seed, seed + (64 if len(mine) > 1 else 1024), dtype=np.uint64)
                slots = (mix(mine[None, :].repeat(len(seeds), 0), seeds[:, None]) % np.uint64(n)).astype(np.int64)
                free = ~taken[slots].any(1)
                if len(mine) > 1:
                    ordered = np.sort(slots, 1)
                    free &= (ordered[:, 1:] != ordered[:, :-1]).all(1)
                hit = np.flatnonzero(free)
                if len(hit):
                    taken[slots[hit[0]]] = True
                    out[b] = seeds[hit[0]]
                    break
                seed += len(seeds)
        return cls(out, n)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        bucket = (mix(keys, 0) % np.uint64(len(self.displacement))).astype(np.int64)
        return (mix(keys, self.displacement[bucket].astype(np.uint64)) % np.uint64(max(1, self.n))).astype(np.int64)


def finger(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 0xF1) >> np.uint64(32)).astype(np.uint32)


#: A slot: the key's fingerprint, the offset of its first id, the number of its first document in the shard, and how many it has.
_ENTRY = [("finger", "<u4"), ("offset", "<u8"), ("document", "<u4"), ("documents", "<u4")]


def files_of(keys: list[int], counts: list[int], ids: np.ndarray, wide: bool) -> tuple[bytes, bytes]:
    """The two files of a shard. Keys ascend and may repeat; counts are ids of each document."""
    k, c = np.array(keys, np.int64), np.array(counts, np.int64)
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    own = k[first]
    offset = np.r_[0, np.cumsum(c)]
    ph = PerfectHash.build(own)
    slot = ph.slots(own)
    table = np.zeros(len(own), _ENTRY)
    table["finger"][slot], table["offset"][slot] = finger(own), offset[first]
    table["document"][slot], table["documents"][slot] = first, np.diff(np.r_[first, len(k)])
    data = MAGIC + struct.pack("<BxxxQQ", 4 if wide else 2, len(k), len(ids)) + ids.astype("<u4" if wide else "<u2").tobytes() + k.astype("<i8").tobytes() + c.astype("<i8").tobytes()
    index = MAGIC + struct.pack("<xxxxQQ", len(own), len(ph.displacement)) + ph.displacement.astype("<u4").tobytes() + table.tobytes()
    return data, index


class Shard:
    """A shard's two files, read: ``get(key)`` gives the ids of each of a key's documents, or None."""

    def __init__(self, data: bytes, index: bytes):
        if data[:4] != MAGIC or index[:4] != MAGIC:
            raise ValueError("not a shard")
        width, n_docs, n_ids = struct.unpack("<BxxxQQ", data[4:24])
        self.ids = np.frombuffer(data, f"<u{width}", n_ids, 24)
        self.keys = np.frombuffer(data, "<i8", n_docs, 24 + n_ids * width)
        self.counts = np.frombuffer(data, "<i8", n_docs, 24 + n_ids * width + 8 * n_docs)
        n, m = struct.unpack("<xxxxQQ", index[4:24])
        self._hash = PerfectHash(np.frombuffer(index, "<u4", m, 24), n)
        self.table = np.frombuffer(index, _ENTRY, n, 24 + 4 * m)

    def entries(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of keys, and whether the fingerprints there are theirs."""
        if not len(self.table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        slot = self._hash.slots(keys)
        return slot, self.table["finger"][slot] == finger(keys)

    def spans(self, entry: np.void) -> Iterator[tuple[int, int]]:
        """Where the ids of each of an entry's documents begin and end."""
        at, first = int(entry["offset"]), int(entry["document"])
        for n in self.counts[first : first + int(entry["documents"])].tolist():
            yield at, at + n
            at += n

    def get(self, key: int | None) -> list[np.ndarray] | None:
        k = np.array([NULL_KEY if key is None else key], np.int64)
        slot, there = self.entries(k)
        if not there[0] or self.keys[self.table[slot[0]]["document"]] != k[0]:
            return None
        return [self.ids[a:b].astype("<u4") for a, b in self.spans(self.table[slot[0]])]


class Reader:
    """Keyed access to written shards. Holds a row a shard, and the shards read last."""

    def __init__(self, manifest: DataFrame, folder: str, kept: int = 4):
        rows = sorted(tuple(r) for r in manifest.select("shard", "first", "last").collect())
        self._shards, self._first, self._last = ([r[k] for r in rows] for k in range(3))
        self._read = lru_cache(maxsize=kept)(lambda shard: read_shard(folder, shard))

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of each document with this doc_id, in the order of the shards; none if there is none."""
        k, out = NULL_KEY if key is None else key, []
        for i in range(bisect_left(self._last, k), bisect_right(self._first, k)):
            out += self._read(self._shards[i]).get(key) or []
        return out


def _fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def _put(folder: str, name: str, raw: bytes) -> None:
    fs, path = _fs(folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(raw)
    fs.move(own, f"{path}/{name}")


def _get(folder: str, name: str) -> bytes:
    fs, path = _fs(folder)
    with fs.open_input_stream(f"{path}/{name}") as f:
        return f.read()


def read_shard(folder: str, shard: int) -> Shard:
    return Shard(_get(folder, f"ids-{shard:05d}.bin"), _get(folder, f"idx-{shard:05d}.bin"))


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end: int = END, shard_bytes: int = SHARD_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Encode docs and write shards below ``folder``; the manifest: shard, first, last, documents, ids, start.

    However few bytes they have, a shard holds about ``shard_rows`` documents at most.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    whole = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    parts = max(1, -(-(whole["bytes"] or 0) // shard_bytes), -(-whole["n"] // shard_rows))
    ordered = rows.repartitionByRange(int(parts), "key", "tie").sortWithinPartitions("key", "tie", "text")
    stop = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        own, shard = encoder(path), TaskContext.get().partitionId()
        keys, counts, ids = [], [], []
        for batch in slices(batches):
            keys += batch.column(0).to_pylist()
            for packed in own.encode(as_text(batch.column(1))):
                u = np.frombuffer(packed + stop, "<u4")
                counts.append(len(u))
                ids.append(u if u.max() >> 16 else u.astype("<u2"))
        if not keys:
            return
        wide = any(x.dtype.itemsize == 4 for x in ids)
        flat = np.concatenate(ids)
        del ids
        data, index = files_of(keys, counts, flat, wide)
        _put(folder, f"ids-{shard:05d}.bin", data)
        _put(folder, f"idx-{shard:05d}.bin", index)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, keys[0], keys[-1], len(keys), len(flat))], ["shard", "first", "last", "documents", "ids"])

    manifest = materialize(ordered.select("key", "text").mapInArrow(run, "shard long, first long, last long, documents long, ids long"), "manifest")
    return _started(manifest)


def _started(manifest: DataFrame, block: int = MANIFEST_BLOCK) -> DataFrame:
    """manifest with ``start``, the ids of all shards before: within blocks of shards, then over one row a block."""
    b = F.floor(F.col("shard") / block)
    inside = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    summed = manifest.withColumn("block", b).withColumn("start", F.coalesce(F.sum("ids").over(inside), none))
    blocks = manifest.groupBy(b.alias("block")).agg(F.sum("ids").alias("all")).select("block", F.coalesce(F.sum("all").over(before), none).alias("base"))
    return summed.join(blocks, "block").select("shard", "first", "last", "documents", "ids", (F.col("start") + F.col("base")).alias("start"))


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the files alone: every key is looked up in its shard's index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = read_shard(folder, shard)
                first = np.flatnonzero(np.r_[True, s.keys[1:] != s.keys[:-1]]) if len(s.keys) else np.empty(0, np.int64)
                slot, there = s.entries(s.keys[first])
                if not there.all():
                    raise ValueError(f"shard {shard}: a key's fingerprint isn't in the index")
                out = ([], [], [], [])
                for key, e in zip(s.keys[first].tolist(), s.table[slot], strict=True):
                    for a, b in s.spans(e):
                        for column, x in zip(out, (None if key == NULL_KEY else key, start + a, b - a, zlib.crc32(s.ids[a:b].astype("<u4").tobytes())), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("shard", "start").repartition(F.col("shard")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame) -> DataFrame:
    folder = shared_dir(docs.sparkSession, "shards")
    return read_shards(write_shards(docs, folder), folder)
