"""Exact dedup by an extendible-hash index on shared files.

Texts are equal when their bytes are, after deleting ASCII white space; null counts as empty. Of equal texts the row
with the most code points stays, then the one with the smallest doc_id (null last), then the first row read.

1. Every scan task keeps a bounded table of the texts it has met and logs each row to the shared folder; a text that
   is already in the table is logged as a reference. So a group of copies, however large, leaves one text a task.
2. The driver builds the directory from a histogram of key prefixes: a bucket over its capacity splits, doubling the
   directory when the bucket is as deep as it. The histogram is refined only below overfull prefixes.
3. Owner tasks get ranges of buckets, each bucket whole, sorted by key, and stream through them: rows with one key are
   compared byte for byte, and a text that differs from those before it is chained behind them. The buckets are written
   to the shared folder. A task holds one chain at a time, so a bucket may be of any size: its capacity grows with the
   texts where there would else be more than BUCKETS of them, and the driver's directory stays bounded.
4. Groups are counted by (key, place in the chain), first within scan tasks, and joined back to the log.

A row that is repeated whole is a copy like any other: one of the rows stays. Very long texts are like others. Only doc_id
and text are read, so that other columns may have any names. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import as_bytes, discard, fresh, materialize, numbered, slices

BLANK = b" \t\n\x0b\x0c\r"
#: Bytes of texts that a scan task keeps to refer to; texts in a bucket; buckets, about; bits of the first histogram, and
#: of those that refine it below overfull prefixes.
TABLE_BYTES, CAPACITY, BUCKETS, HISTOGRAM_BITS, FINER_BITS, DEEPEST = 48 << 20, 2_000, 1 << 13, 12, 4, 48

LOG = "rid long, doc_id long, n_cp long, key long, sha string, ref long, body binary"


def normalized(text: bytes) -> bytes:
    return text.translate(None, BLANK)


def code_points(text: bytes) -> int:
    return len(text) - sum(map(text.count, _CONTINUED)) if not text.isascii() else len(text)


_CONTINUED = [bytes([b]) for b in range(0x80, 0xC0)]


def _scan(batches: Iterator[pa.RecordBatch], key_of=None) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    met: dict[int, list[tuple[int, bytes]]] = {}
    held = 0
    for batch in slices(batches):
        out = [[] for _ in range(5)]
        for rid, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(2)), strict=True):
            text = normalized(raw)
            digest = hashlib.sha256(text).digest()
            key = key_of(text) if key_of else struct.unpack(">q", digest[:8])[0]
            chain = met.get(key, ())
            ref = next((r for r, t in chain if t == text), None)
            body = None
            if ref is None:
                ref, body = rid, pack.compress(text)
                if held > TABLE_BYTES:
                    met.clear()
                    held = 0
                met.setdefault(key, []).append((rid, text))
                held += len(text) + 200
            for column, x in zip(out, (len(raw.decode("utf-8", "surrogatepass")), key, digest.hex(), ref, body), strict=True):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["rid", "doc_id", "n_cp", "key", "sha", "ref", "body"])


class Directory:
    """Buckets by key prefix. ``buckets``: (depth, prefix) sorted by range; ``depth``: the directory has 2**depth slots."""

    def __init__(self, counts, capacity: int = CAPACITY, deepest: int = DEEPEST):
        """counts(depth, prefixes) -> {prefix: texts} at that depth below the given (depth, prefix) buckets."""
        self.depth = 0
        self.doublings = 0
        full, done, depth = [(0, 0)], [], 0
        while full:
            step = min(FINER_BITS if depth else HISTOGRAM_BITS, deepest - depth)
            if step <= 0:
                done += full
                break
            got = counts(depth + step, full)
            again = []
            for d, prefix in full:
                fine = {p: n for p, n in got.items() if p >> step == prefix}
                stack = [(d, prefix, fine)]
                while stack:
                    at, pre, inside = stack.pop()
                    if sum(inside.values()) <= capacity:
                        done.append((at, pre))
                    elif at == depth + step:
                        again.append((at, pre))
                    else:  # the bucket splits; a directory no deeper than it doubles
                        if at == self.depth:
                            self.depth += 1
                            self.doublings += 1
                        for half in (1, 0):
                            child = pre << 1 | half
                            stack.append((at + 1, child, {p: n for p, n in inside.items() if p >> (depth + step - at - 1) == child}))
            full, depth = again, depth + step
        self.buckets = sorted(done, key=lambda x: x[1] << (64 - x[0]))

    def bounds(self) -> list[int]:
        """The first key of each bucket, keys read as signed with the top bit flipped back."""
        return [(p << (64 - d)) for d, p in self.buckets]

    def bucket(self, key: int) -> int:
        import bisect

        return bisect.bisect_right(self.bounds(), key & 0xFFFFFFFFFFFFFFFF) - 1


def _prefix(depth: int) -> F.Column:
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def build_directory(texts: DataFrame, capacity: int = CAPACITY) -> Directory:
    """The driver gets 2**HISTOGRAM_BITS counts, then 2**FINER_BITS for each overfull prefix, of which there are at most
    twice BUCKETS."""
    capacity = max(capacity, -(-texts.count() // BUCKETS))

    def counts(depth: int, full: list[tuple[int, int]]) -> dict[int, int]:
        rows = texts
        at = full[0][0]
        if at:
            over = texts.sparkSession.createDataFrame([(p,) for _, p in full], "_p long")
            rows = texts.withColumn("_p", _prefix(at)).join(F.broadcast(over), "_p", "left_semi")
        return {r["p"]: r["n"] for r in rows.groupBy(_prefix(depth).alias("p")).agg(F.count("*").alias("n")).collect()}

    return Directory(counts, capacity)


def _owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    current, chain = None, []
    for batch in slices(batches):
        slots = []
        for key, body in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if key != current:
                current, chain = key, []
            text = unpack.decompress(body)
            slot = next((i for i, t in enumerate(chain) if t == text), None)
            if slot is None:
                slot = len(chain)
                chain.append(text)
            slots.append(slot)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(slots, pa.int32())], ["bucket", "key", "ref", "slot"])


class Index:
    """``log``: every row; ``buckets``: (bucket, key, ref, slot) of every text that a scan task met first."""

    def __init__(self, log: DataFrame, buckets: DataFrame, directory: Directory):
        self.log, self.buckets, self.directory = log, buckets, directory


def build_index(docs: DataFrame, capacity: int = CAPACITY, key_of=None, rid: str | None = None) -> Index:
    """``key_of`` (bytes -> signed 64-bit key) replaces the key for tests of chains; ``rid`` names a column that numbers the rows."""
    rows = docs.select((F.col(rid) if rid else F.monotonically_increasing_id()).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    log = materialize(rows.mapInArrow(lambda b: _scan(b, key_of), LOG), "log")
    texts = log.where("body is not null").select("key", "ref", "body")
    directory = build_directory(texts.select("key"), capacity)
    spark = docs.sparkSession
    depth = directory.depth
    if depth <= 16:
        slots = [0] * (1 << depth)
        for i, (d, p) in enumerate(directory.buckets):
            for s in range(p << (depth - d), (p + 1) << (depth - d)):
                slots[s] = i
        lookup = F.element_at(F.array(*map(F.lit, slots)) if depth <= 6 else F.lit(slots), (_prefix(depth) + 1).cast("int"))
        owned = texts.withColumn("bucket", lookup.cast("int"))
    else:
        table = spark.createDataFrame([(d, p, i) for i, (d, p) in enumerate(directory.buckets)], "d int, p long, bucket int")
        owned = None
        for d in sorted({d for d, _ in directory.buckets}):
            part = texts.withColumn("p", _prefix(d)).join(table.where(F.col("d") == d).select("p", "bucket"), "p").drop("p")
            owned = part if owned is None else owned.unionByName(part)
    parts = max(1, min(len(directory.buckets) * 4, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    owned = owned.select("bucket", "key", "ref", "body").repartitionByRange(parts, "bucket").sortWithinPartitions("bucket", "key", "ref")
    buckets = materialize(owned.mapInArrow(_owner, "bucket int, key long, ref long, slot int"), "buckets")
    return Index(log, buckets, directory)


def groups(index: Index) -> DataFrame:
    """rid, doc_id, keep_rid, keep_id, group_size, sha, n_cp: one row per row of docs.

    Rows meet the text that their scan task met first, and only those texts meet their group, so that a group's rows
    never gather in one task.
    """
    order = F.struct("n_cp", (-F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))).alias("d"), (-F.col("rid")).alias("r"), "rid", "doc_id")
    firsts = index.log.groupBy("ref").agg(F.max(order).alias("b"), F.count("*").alias("n"))
    firsts = materialize(firsts.join(index.buckets.select("ref", "key", "slot"), "ref"), "firsts")
    best = firsts.groupBy("key", "slot").agg(F.max("b").alias("k"), F.sum("n").alias("group_size"))
    named = firsts.select("ref", "key", "slot").join(best, ["key", "slot"]).select("ref", F.col("k.rid").alias("keep_rid"), F.col("k.doc_id").alias("keep_id"), "group_size")
    return index.log.join(named, "ref").select("rid", "doc_id", "keep_rid", "keep_id", "group_size", "sha", "n_cp")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256."""
    return groups(build_index(docs)).select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row keeps; its columns stay as they are."""
    keyed, rid = numbered(docs, "docs")
    (mine,) = fresh(keyed, "_kept")
    index = build_index(keyed, rid=rid)
    # written, so that the log, which has all texts, goes before the documents move
    keep = materialize(groups(index).where("rid = keep_rid").select(F.col("rid").alias(mine)), "kept")
    discard(index.log)
    discard(index.buckets)
    return keyed.join(keep, F.col(rid) == F.col(mine), "left_semi").select(*docs.columns)
