"""Documents to tokens over the bytes of an Arrow batch: the places of all words at once instead of a regular expression a
sentence. Gives what text.sentences() and text.word_tokens() give: all that isn't a-z, 0-9 or _ parts words, and runs of
sentence marks part sentences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text cut at once.
BYTES = 4_000_000
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"abcdefghijklmnopqrstuvwxyz0123456789_")] = 1
_KIND[list(b".!?\n")] = 2


def cut(texts: pa.Array, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Lower-cased texts, none of them null -> row, sentence, place and form of each word of so many characters; places
    are among these."""
    if not len(texts) or not texts.get_total_buffer_size():
        return *(np.zeros(0, np.int64) for _ in range(3)), pa.array([], pa.string())
    texts = texts.cast(pa.string())
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    if not len(data):
        return *(np.zeros(0, np.int64) for _ in range(3)), pa.array([], pa.string())
    kind, opens = _KIND[data], np.zeros(len(data) + 1, bool)
    opens[at] = True
    word, mark = kind == 1, kind == 2
    first = word.copy()
    first[1:] &= ~word[:-1] | opens[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | opens[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    mark[1:] &= ~mark[:-1] | opens[1:-1]
    marks = np.r_[0, np.cumsum(mark)]
    forms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.r_[0, np.cumsum(ends - starts)].astype(np.int32)), pa.py_buffer(data[word]))
    if least > 1:
        long = ends - starts >= least
        starts, forms = starts[long], forms.filter(pa.array(long))
    row = np.searchsorted(at, starts, "right") - 1
    sentence = marks[starts] - marks[at[row]]
    new = np.r_[True, (row[1:] != row[:-1]) | (sentence[1:] != sentence[:-1])] if len(row) else np.zeros(0, bool)
    place = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0)) if len(row) else row
    return row, sentence, place, forms


def mapped(docs: DataFrame, found: Callable[[Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.Array]]], Iterator[pa.RecordBatch]], schema: str, least: int = 1) -> DataFrame:
    """docs (doc_id, text) through ``found``, which gets ids, row, sentence, place and form of some documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
            for batch in batches:
                lens = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                part = np.cumsum(lens) // BYTES
                edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows] if batch.num_rows else []
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    yield batch.column(0).slice(a, b - a), *cut(batch.column(1).slice(a, b - a), least)

        yield from found(parts())

    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    return rows.withColumn("n", F.octet_length("text")).mapInArrow(run, schema)


def sentence_ids(ids: pa.Array, row: np.ndarray, sentence: np.ndarray, stride: int) -> pa.Array:
    docs = ids.fill_null(0).to_numpy(zero_copy_only=False)
    return pa.array(docs[row] * stride + sentence, pa.int64(), mask=ids.is_null().to_numpy(zero_copy_only=False)[row] if ids.null_count else None)
