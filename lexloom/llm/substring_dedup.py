"""Substring dedup by content-defined chunking with a gear rolling hash.

A text's bytes are cut wherever the gear hash of the last 16 bytes falls below a threshold, on average every CHUNK
bytes, so that an insertion moves the cuts near it only. Every WIDTH neighbouring chunks (fewer in a short text)
are one unit, and its digest is what is deduplicated: a unit is a duplicate if an earlier document, or an earlier
place in the same one, has the digest. Documents are ordered by doc_id (null last), then as they were read.
Neighbouring duplicate units merge into spans, and spans of MIN_WORDS words or more are reported and removed; the
first occurrence stays. A repeated passage of 51 words loses a part of a chunk at either end, hence the lower bound.

A digest has 128 bits. The places of a digest are sorted, and all but the first are duplicates: places are shuffled
once, and a task streams through its digests. Digests that hold much of all places don't gather in a task: their first
places are a partial aggregation, which is broadcast. What is gathered is bounded by one document.

Null and empty texts have no units. Very long texts are like others. Whole copies are one span. Rows with one doc_id are
documents of their own. Only doc_id and text are read, so that other columns may have any names. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import as_bytes, fresh, heavy, materialize, numbered, slices

CHUNK, LONGEST, WIDTH, MIN_WORDS = 32, 512, 2, 15
_GEAR = np.random.default_rng(1234).integers(0, 1 << 16, 256, dtype=np.uint16)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LAST = (1 << 63) - 1


def gear(raw: np.ndarray) -> np.ndarray:
    """At each byte the 16-bit gear hash of the 16 bytes that end there: sum of gear[b] << age, by doubling."""
    h = _GEAR[raw]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint16(step) if step < len(h) else 0
    return h


def cuts(raw: bytes, chunk: int = CHUNK) -> np.ndarray:
    """Chunk boundaries, 0 and the length included; stretches without a cut are cut at multiples of LONGEST."""
    a = np.frombuffer(raw, np.uint8)
    if not len(a):
        return np.zeros(1, np.int64)
    at = np.flatnonzero(gear(a) < (1 << 16) // chunk) + 1
    edge = np.unique(np.r_[0, at, len(a)])
    gaps = np.diff(edge)
    if gaps.max() > LONGEST:
        more = [np.arange(s + LONGEST, s + g, LONGEST) for s, g in zip(edge[:-1][gaps > LONGEST], gaps[gaps > LONGEST], strict=True)]
        edge = np.unique(np.concatenate([edge, *more]))
    return edge


def units(raw: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Chunk boundaries, words begun before each boundary, and the digest of each unit."""
    edge = cuts(raw)
    if len(edge) == 1:
        return edge, np.zeros(1, np.int64), []
    blank = _BLANK[np.frombuffer(raw, np.uint8)]
    begun = np.cumsum(~blank & np.r_[True, blank[:-1]])
    words = np.r_[0, begun][edge]
    w = min(width, len(edge) - 1)
    digest = xxhash.xxh3_128_digest
    e = edge.tolist()
    return edge, words, [digest(raw[a:b]) for a, b in zip(e, e[w:], strict=False)]


def _cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        edges, words, halves = [], [], ([], [])
        for raw in as_bytes(batch.column(2)):
            e, w, d = units(raw)
            edges.append(e.astype(np.int32))
            words.append(w.astype(np.int32))
            both = np.frombuffer(b"".join(d), "<i8").reshape(-1, 2)
            for k in range(2):
                halves[k].append(np.ascontiguousarray(both[:, k]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(edges, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.int32())), *(pa.array(x, pa.list_(pa.int64())) for x in halves)], ["rid", "doc_id", "edges", "words", "d1", "d2"])


def spans_of(edges: np.ndarray, words: np.ndarray, at: np.ndarray, first: list, width: int, least: int) -> list[tuple]:
    """Merge duplicate units (their numbers, ascending) into (start, end, words, first documents)."""
    out = []
    if not len(at):
        return out
    w = min(width, len(edges) - 1)
    breaks = np.flatnonzero(np.diff(at) > w) + 1
    for run in np.split(np.arange(len(at)), breaks):
        lo, hi = at[run[0]], min(at[run[-1]] + w, len(edges) - 1)
        n = int(words[hi] - words[lo])
        if n >= least:
            out.append((int(edges[lo]), int(edges[hi]), n, sorted({first[i] for i in run.tolist() if first[i] is not None})))
    return out


def _merge(width: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for rid, doc, edges, words, hits in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                hits.sort(key=lambda x: x["at"])
                found = spans_of(np.array(edges), np.array(words), np.array([x["at"] for x in hits]), [x["first"] for x in hits], width, least)
                rows += [(rid, doc, *s) for s in found]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["rid", "doc_id", "start", "end", "n_words", "first_docs"])

    return run


def spans(docs: DataFrame, least: int = MIN_WORDS, rid: str | None = None) -> DataFrame:
    """rid, doc_id, start, end (bytes), n_words, first_docs: the spans that earlier places of the corpus have.

    first_docs are the documents in which the span's units occur first; a document may be its own. ``rid`` names a
    column that numbers the rows; without it they are numbered as they are read.
    """
    rows = docs.select((F.col(rid) if rid else F.monotonically_increasing_id()).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = materialize(rows.mapInArrow(_cut_all, "rid long, doc_id long, edges array<int>, words array<int>, d1 array<long>, d2 array<long>"), "chunks")
    places = cut.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "rid", F.posexplode(F.arrays_zip("d1", "d2")).alias("at", "d")).select("doc", "rid", "at", F.col("d.d1").alias("d1"), F.col("d.d2").alias("d2"))
    hit = lambda: F.struct("at", F.nullif(F.col("f.doc"), F.lit(_LAST)).alias("first")).alias("hit")
    hot = heavy(places, "d1")
    is_hot = F.col("d1").isin(hot) if hot else F.lit(False)
    # places are shuffled once: the first of a digest goes before the others of its group
    group = Window.partitionBy("d1", "d2").orderBy("doc", "rid", "at").rowsBetween(Window.unboundedPreceding, 0)
    hits = places.where(~is_hot).select("rid", "at", F.first(F.struct("doc", "rid", "at")).over(group).alias("f")).where("rid <> f.rid or at <> f.at").select("rid", hit())
    if hot:
        crowd = places.where(is_hot)
        firsts = crowd.groupBy("d1", "d2").agg(F.min(F.struct("doc", "rid", "at")).alias("f"))
        hits = hits.unionByName(crowd.join(F.broadcast(firsts), ["d1", "d2"]).where("rid <> f.rid or at <> f.at").select("rid", hit()))
    # written, so that the places that were shuffled go before documents are
    hits = materialize(hits, "hits")
    # no more than the units of one document
    by_doc = hits.groupBy("rid").agg(F.collect_list("hit").alias("hits"))
    return cut.select("rid", "doc_id", "edges", "words").join(by_doc, "rid").mapInArrow(_merge(WIDTH, least), "rid long, doc_id long, start int, end int, n_words int, first_docs array<long>")


def report(docs: DataFrame) -> DataFrame:
    """A row for each removed span; documents without any have none."""
    return spans(docs).select("doc_id", "start", "end", "n_words", "first_docs")


def whole_characters(raw: bytes, start: int, end: int) -> tuple[int, int]:
    """The span without the parts of characters that it begins or ends with."""
    while start < end and raw[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def dedup(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """docs with the spans cut out of their texts (whole characters only); other columns stay."""
    keyed, rid = numbered(docs, "docs")
    row, cut_out = fresh(keyed, "_row", "_spans")
    found = spans(keyed, least, rid).groupBy(F.col("rid").alias(row)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cut_out))
    names = keyed.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for raw, cut in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if raw is not None and cut:
                    b, parts, last = raw.encode("utf-8", "surrogatepass"), [], 0
                    for s in cut:
                        start, end = whole_characters(b, s["start"], s["end"])
                        parts.append(b[last:start])
                        last = end
                    raw = b"".join([*parts, b[last:]]).decode("utf-8", "surrogatepass")
                texts.append(raw)
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    joined = keyed.join(found, F.col(rid) == F.col(row), "left").select(*keyed.columns, cut_out)
    return joined.mapInArrow(run, keyed.schema).select(*docs.columns)
