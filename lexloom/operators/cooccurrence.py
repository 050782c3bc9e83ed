"""The pair graph of a corpus as a sparse matrix product: words get numbers, a sentence becomes an array of these, and
pairs are counted in Arrow batches.

The dictionary goes to the workers, which number the words of their sentences, so that no token is shuffled. A task adds
up EVENTS pairs at a time before it hands them on, sorted and compressed, a blob for each block of pairs; blocks are dealt
by a hash of both words, so that a common word lands in all of them, and are so many that each has about BLOCK pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import tokens as W
from lexloom.operators import corpus as C
from lexloom.sources.files import stored

#: Pairs that a task adds up at once, and those of one block, with repeats.
EVENTS, BLOCK = 8_000_000, 4_000_000
#: Tokens looked up at once, rows handed over at once, bits of the table that tells most pairs off.
TOKENS, ROWS, BITS = 1_000_000, 50_000, 24


class Numbered:
    """``names``: known words in order; ``sets`` (sent_id, ids, pos, size): of each sentence the numbers of its known
    words, their places among its words, and how many these are."""

    def __init__(self, docs: DataFrame, words: DataFrame, least: int = 1):
        """docs (doc_id, text), words (token); words of fewer than ``least`` characters don't count."""
        self.spark = docs.sparkSession
        names = words.select("token").distinct().toArrow().column(0).combine_chunks().cast(pa.string())
        self.names = names.take(pc.array_sort_indices(names))
        self.shared = shared = self.spark.sparkContext.broadcast(self.names)

        def run(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for part in parts:
                held.append(part)
                n += len(part[1])
                if n >= TOKENS:
                    yield from _encoded(held, shared.value)
                    held, n = [], 0
            if held:
                yield from _encoded(held, shared.value)

        rows = W.mapped(docs.where("doc_id IS NOT NULL"), run, "sent_id long, ids array<int>, pos array<int>, size int", least)
        if C.repeated(docs):  # sentences of repeated documents are one
            both = lambda c: F.flatten(F.collect_list(c)).alias(c)
            rows = rows.groupBy("sent_id").agg(both("ids"), both("pos"), F.max("size").alias("size"))
        self.sets, self.weights = stored(rows, "sets"), None

    def nodes(self) -> DataFrame:
        """id, c: neighbours of each word in its sentences."""
        many = len(self.names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen = np.zeros(many, np.int64), np.zeros(many, bool)
            for batch in batches:
                _, lens, ids = _sets(batch.column(0))
                own += np.bincount(ids, np.repeat(lens - 1, lens), many).astype(np.int64)
                seen[ids] = True
            found = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(own[found])], ["id", "n"])

        return self.sets.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("c"))

    def _weights(self) -> np.ndarray:
        """The nodes' counts by number."""
        if self.weights is None:
            found = self.nodes().toArrow()  # a number a word
            self.weights = np.zeros(len(self.names), np.int64)
            self.weights[found.column(0).to_numpy()] = found.column(1).to_numpy()
        return self.weights

    def occurrences(self) -> DataFrame:
        """sent_id, id: distinct."""
        return self.sets.select("sent_id", F.explode(F.array_distinct("ids")).alias("id"))

    def named(self, rows: DataFrame) -> DataFrame:
        """Rows with kw, the word, instead of id."""
        names, i = self.shared, rows.columns.index("id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.set_column(i, "kw", names.value.take(batch.column(i)))

        kinds = [("kw string" if f.name == "id" else f"{f.name} {f.dataType.simpleString()}") for f in rows.schema]
        return rows.mapInArrow(run, ", ".join(kinds))

    def counts(self, least: int = 1) -> DataFrame:
        """id_u, id_v, c with id_u < id_v."""
        return self._counted(lambda u, v, c: [pa.array(u, pa.int32()), pa.array(v, pa.int32()), pa.array(c, pa.int64())], "id_u int, id_v int, c long", least)

    def graph(self, least: int = 1, above: float | None = None) -> DataFrame:
        """u, v, c, npmi as corpus.pair_graph() has them, of pairs of at least so many sentences; with ``above`` those
        whose score is (strictly) higher."""
        own = self._weights()
        z, shared, names = int(own.sum()), self.spark.sparkContext.broadcast(own), self.shared

        def finish(u: np.ndarray, v: np.ndarray, c: np.ndarray) -> list[pa.Array]:
            cu, cv = shared.value[u], shared.value[v]
            if above is not None:  # a little less than asked for; the rest is Spark's
                with np.errstate(divide="ignore", invalid="ignore"):
                    near = -np.log(2.0 * z * c / (cu.astype(float) * cv)) / np.log(2.0 * c / z) > above - 1e-6
                u, v, c, cu, cv = (x[near] for x in (u, v, c, cu, cv))
            return [names.value.take(pa.array(u)), names.value.take(pa.array(v)), *(pa.array(x, pa.int64()) for x in (c, cu, cv))]

        edges = self._counted(finish, "u string, v string, c long, cu long, cv long", least)
        scored = edges.select("u", "v", "c", C.npmi(F.col("c"), F.col("cu"), F.col("cv"), F.lit(z)).alias("npmi"))
        return scored if above is None else scored.where(F.col("npmi") > above)

    def _counted(self, finish: Callable[[np.ndarray, np.ndarray, np.ndarray], list[pa.Array]], schema: str, least: int) -> DataFrame:
        def events(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for _, u, v in _pairs(*_sets(batch.column(0))):
                yield u.astype(np.int64) << 32 | v

        # a pair counts at both of its ends
        return self._summed(self.sets.select("ids"), events, int(self._weights().sum()) // 2, finish, schema, least)

    def _summed(self, rows: DataFrame, events: Callable[[pa.RecordBatch], Iterator[np.ndarray]], many: int, finish: Callable[[np.ndarray, np.ndarray, np.ndarray], list[pa.Array]], schema: str, least: int) -> DataFrame:
        """How often each key (two numbers of 31 and 32 bits) comes up in the ``many`` that rows have."""
        blocks = max(1, -(-many // BLOCK))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                for keys in events(batch):
                    held.append(keys)
                    n += len(keys)
                    if n >= EVENTS:
                        yield from _blobs(*np.unique(np.concatenate(held), return_counts=True), blocks)
                        held, n = [], 0
            if held:
                yield from _blobs(*np.unique(np.concatenate(held), return_counts=True), blocks)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple[int, bytes]]] = {}
            for batch in batches:
                for b, n, blob in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    held.setdefault(b, []).append((n, blob))
            while held:
                keys, counts = (np.concatenate(x) for x in zip(*map(_unpacked, held.popitem()[1]), strict=True))
                order = np.argsort(keys, kind="stable")
                keys, counts = keys[order], counts[order]
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                keys, counts = keys[first], np.add.reduceat(counts, first)
                keys, counts = keys[counts >= least], counts[counts >= least]
                for at in range(0, len(keys), ROWS):
                    some = keys[at : at + ROWS]
                    yield pa.RecordBatch.from_arrays(finish((some >> 32).astype(np.int32), (some & 0xFFFFFFFF).astype(np.int32), counts[at : at + ROWS]), names=names)

        names = [x.split()[0] for x in schema.split(", ")]
        blobs = rows.mapInArrow(count, "block int, n int, blob binary")
        return blobs.repartition(blocks, "block").mapInArrow(merge, schema)

    def skipgrams(self, reach: int = 2) -> DataFrame:
        """word, context, n: how often each word has a neighbour up to ``reach`` places away, as corpus.skipgrams() names
        them."""
        names, far = self.shared, 2 * reach + 1

        def events(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            return _near(batch, reach)

        def finish(u: np.ndarray, v: np.ndarray, c: np.ndarray) -> list[pa.Array]:
            offsets = pa.array([f"l{k}_" for k in range(-reach, reach + 1)]).take(pa.array(u % far))
            return [names.value.take(pa.array(u // far)), pc.binary_join_element_wise(offsets, names.value.take(pa.array(v)), ""), pa.array(c, pa.int64())]

        return self._summed(self.sets.select("ids", "pos"), events, self._tokens() * 2 * reach, finish, "word string, context string, n long", 1)

    def skipgram_pairs(self, reach: int = 2) -> DataFrame:
        """u, v, n with u < v: how often one of two words is a neighbour of the other; both ways count."""
        names, far = self.shared, 2 * reach + 1

        def events(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for keys in _near(batch, reach):
                u, v = (keys >> 32) // far, keys & 0xFFFFFFFF
                yield (np.minimum(u, v) << 32 | np.maximum(u, v))[u != v]

        def finish(u: np.ndarray, v: np.ndarray, c: np.ndarray) -> list[pa.Array]:
            return [names.value.take(pa.array(u)), names.value.take(pa.array(v)), pa.array(c, pa.int64())]

        return self._summed(self.sets.select("ids", "pos"), events, self._tokens() * 2 * reach, finish, "u string, v string, n long", 1)

    def skipgram_rows(self, reach: int = 2) -> DataFrame:
        """word, context: each of them a row, made where its sentence lies."""
        names, far = self.shared, 2 * reach + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            offsets = pa.array([f"l{k}_" for k in range(-reach, reach + 1)])
            for batch in batches:
                for keys in _near(batch, reach):
                    u, v = keys >> 32, keys & 0xFFFFFFFF
                    yield pa.RecordBatch.from_arrays([names.value.take(pa.array(u // far)), pc.binary_join_element_wise(offsets.take(pa.array(u % far)), names.value.take(pa.array(v)), "")], ["word", "context"])

        return self.sets.select("ids", "pos").mapInArrow(run, "word string, context string")

    def _tokens(self) -> int:
        return self.sets.agg(F.sum(F.size("ids")).cast("long")).first()[0] or 0

    # what edges tie in sentences

    def _tie(self, edges: DataFrame):
        """edges (u, v) -> a broadcast of their numbers, sorted, and of a table of bits that tells most others off."""
        rows = edges.select("u", "v").toArrow()
        u, v = (pc.index_in(rows.column(i).combine_chunks().cast(pa.string()), value_set=self.names).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        keys = np.sort(u << 32 | v)
        bits = np.zeros(1 << BITS, bool)
        bits[_slot(keys)] = True
        return self.spark.sparkContext.broadcast((keys, bits))

    def tied(self, edges: DataFrame) -> DataFrame:
        """sent_id, u, v: the pairs of each sentence that are edges."""
        shared, names = self._tie(edges), self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, u, v in _pairs(*_sets(batch.column(1))):
                    on = _among(u.astype(np.int64) << 32 | v, *shared.value)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[on])), names.value.take(pa.array(u[on])), names.value.take(pa.array(v[on]))], ["sent_id", "u", "v"])

        return self.sets.select("sent_id", "ids").mapInArrow(run, "sent_id long, u string, v string")

    def hubs(self, edges: DataFrame, least: int = 2) -> DataFrame:
        """sent_id, kw, related: words that edges tie to so many others of their sentence."""
        shared, names = self._tie(edges), self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for row, u, v in _pairs(*_sets(batch.column(1))):
                    on = _among(u.astype(np.int64) << 32 | v, *shared.value)
                    found += [(row[on], u[on], v[on]), (row[on], v[on], u[on])]
                if not found:
                    continue
                row, kw, other = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((other, kw, row))
                row, kw, other = row[order], kw[order], other[order]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (kw[1:] != kw[:-1])]) if len(row) else np.zeros(0, np.int64)
                n = np.diff(np.r_[first, len(row)])
                enough = n >= least
                kept = np.repeat(enough, n)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n[enough])], pa.int32()), names.value.take(pa.array(other[kept])))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[first[enough]])), names.value.take(pa.array(kw[first[enough]])), pc.binary_join(lists, ",")], ["sent_id", "kw", "related"])

        return self.sets.select("sent_id", "ids").mapInArrow(run, "sent_id long, kw string, related string")

    def shared_sentences(self, edges: DataFrame, most: int = 6, longest: int = 32) -> DataFrame:
        """sent_id, a, b, distance: sentences of at most ``longest`` words in which both ends of an edge occur exactly
        once, near."""
        shared, names = self._tie(edges), self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, pos, ids = _places(batch.column(1), batch.column(2))
                _, place, n = np.unique(row << 32 | ids, return_inverse=True, return_counts=True)
                once = n[place] == 1
                ids, pos, row = ids[once], pos[once], row[once]
                for far in range(1, len(row)):
                    near = np.flatnonzero((row[far:] == row[:-far]) & (pos[far:] - pos[:-far] <= most))
                    if not len(near):
                        break
                    x, y = ids[near], ids[near + far]
                    a, b = np.minimum(x, y), np.maximum(x, y)
                    on = _among(a << 32 | b, *shared.value)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[near][on])), names.value.take(pa.array(a[on])), names.value.take(pa.array(b[on])), pa.array((pos[near + far] - pos[near])[on], pa.int32())], ["sent_id", "a", "b", "distance"])

        return self.sets.where(F.col("size") <= longest).select("sent_id", "ids", "pos").mapInArrow(run, "sent_id long, a string, b string, distance int")

    def linked(self, edges: DataFrame, longest: int) -> DataFrame:
        """sent_id, kws: words of any edge in sentences of at most ``longest`` words, sorted."""
        names, on = self.shared, np.zeros(len(self.names), bool)
        ends = edges.select(F.explode(F.array("u", "v")).alias("kw")).distinct().toArrow().column(0).combine_chunks().cast(pa.string())
        on[pc.index_in(ends, value_set=self.names).to_numpy(zero_copy_only=False).astype(np.int64)] = True
        shared = self.spark.sparkContext.broadcast(on)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                starts, lens, ids = _sets(batch.column(1))
                kept = shared.value[ids]
                upto = np.r_[0, np.cumsum(kept)]
                n = upto[starts + lens] - upto[starts]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), names.value.take(pa.array(ids[kept])))
                some = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(some), lists.filter(some)], ["sent_id", "kws"])

        return self.sets.where(F.col("size") <= longest).select("sent_id", "ids").mapInArrow(run, "sent_id long, kws array<string>")


def _encoded(parts: list[tuple], names: pa.Array) -> Iterator[pa.RecordBatch]:
    """Of tokenised documents, a row a sentence that has known words."""
    sent = np.concatenate([W.sentence_ids(ids, row, sentence, C.STRIDE).to_numpy(zero_copy_only=False) for ids, row, sentence, _, _ in parts])
    pos = np.concatenate([x[3] for x in parts])
    ids = pc.index_in(pa.chunked_array([x[4] for x in parts], pa.string()), value_set=names).combine_chunks()
    first = np.flatnonzero(pos == 0)  # of each sentence
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    ends = np.r_[0, np.cumsum(known)][np.r_[first, len(pos)]]
    offsets = pa.array(ends, pa.int32())
    out = pa.RecordBatch.from_arrays([pa.array(sent[first]), pa.ListArray.from_arrays(offsets, ids.drop_null().cast(pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(pos[known], pa.int32())), pa.array(np.diff(np.r_[first, len(pos)]), pa.int32())], ["sent_id", "ids", "pos", "size"])
    out = out.filter(pa.array(np.diff(ends) > 0))
    for at in range(0, out.num_rows, ROWS):
        yield out.slice(at, ROWS)


def _near(batch: pa.RecordBatch, reach: int) -> Iterator[np.ndarray]:
    """Of ids and pos, keys of word and offset, and neighbour, up to ``reach`` places away. Places of a repeated document
    occur more than once, and each is met with all of the next ones."""
    row, pos, ids = _places(batch.column(0), batch.column(1))
    far = 2 * reach + 1
    for step in range(1, len(row)):
        near = np.flatnonzero((row[step:] == row[:-step]) & (pos[step:] - pos[:-step] <= reach))
        if not len(near):
            break
        k = pos[near + step] - pos[near]
        near, k = near[k > 0], k[k > 0]
        u, v = ids[near], ids[near + step]
        yield (u * far + reach + k) << 32 | v
        yield (v * far + reach - k) << 32 | u


def _places(ids: pa.Array, pos: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, place and number of each word, in this order."""
    row = np.repeat(np.arange(len(ids)), pc.list_value_length(ids).to_numpy(zero_copy_only=False))
    ids, pos = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (ids, pos))
    order = np.lexsort((ids, pos, row))
    return row[order], pos[order], ids[order]


def _sets(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and numbers of each row's distinct numbers, sorted."""
    lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    keys = np.unique(np.repeat(np.arange(len(lens)), lens) << 32 | lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    lens = np.bincount(keys >> 32, minlength=len(lens))
    return np.cumsum(lens) - lens, lens, (keys & 0xFFFFFFFF).astype(np.int32)


def _pairs(starts: np.ndarray, lens: np.ndarray, ids: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """row, u, v with u < v: all pairs of each row, about ``most`` or those of one word at a time."""
    for k in np.unique(lens[lens > 1]).tolist():
        rows = np.flatnonzero(lens == k)
        if k * (k - 1) // 2 > most:
            for r in rows:
                own = ids[starts[r] : starts[r] + k]
                for i in range(k - 1):
                    yield np.full(k - 1 - i, r), np.full(k - 1 - i, own[i]), own[i + 1 :]
            continue
        i, j = np.triu_indices(k, 1)
        step = max(1, most // len(i))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            m = ids[starts[some][:, None] + np.arange(k)]
            yield np.repeat(some, len(i)), m[:, i].ravel(), m[:, j].ravel()


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


def _among(keys: np.ndarray, known: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the keys that are known."""
    maybe = np.flatnonzero(bits[_slot(keys)])
    at = np.searchsorted(known, keys[maybe])
    return maybe[known[at.clip(0, max(len(known) - 1, 0))] == keys[maybe]] if len(known) else maybe[:0]


def _blobs(keys: np.ndarray, counts: np.ndarray, blocks: int) -> Iterator[pa.RecordBatch]:
    block = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(blocks)
    order = np.argsort(block.astype(np.uint16) if blocks < 1 << 16 else block, kind="stable")
    keys, counts, block = keys[order], counts[order], block[order].astype(np.int64)
    ends = np.flatnonzero(np.r_[block[1:] != block[:-1], True]) + 1
    for some in np.array_split(np.arange(len(ends)), max(1, len(ends) // 64)):
        parts = [slice(ends[i - 1] if i else 0, ends[i]) for i in some]
        yield pa.RecordBatch.from_arrays([pa.array(block[ends[some] - 1], pa.int32()), pa.array([p.stop - p.start for p in parts], pa.int32()), pa.array([_packed(keys[p], counts[p]) for p in parts], pa.binary())], ["block", "n", "blob"])


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as steps between first words, second words, and counts, byte by byte in planes, compressed."""
    u = (keys >> 32).astype(np.int32)
    planes = np.concatenate([np.diff(u, prepend=np.int32(0)), (keys & 0xFFFFFFFF).astype(np.int32), counts.astype(np.int32)]).view(np.uint8).reshape(3, -1, 4)
    return pa.compress(planes.transpose(0, 2, 1).tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: tuple[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    n, data = blob
    planes = np.frombuffer(pa.decompress(data, 12 * n, codec="zstd", asbytes=True), np.uint8).reshape(3, 4, n)
    u, v, c = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int32).reshape(3, n).astype(np.int64)
    return np.cumsum(u) << 32 | v, c
