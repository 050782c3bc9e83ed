"""From raw documents to token ids: reject low quality, drop copies, near copies, mix the sources, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of documents, and columns of other names that docs may have.

Null and empty texts, in every stage: the quality model knows nothing of them and keeps them; they are copies of each
other, of which exact dedup keeps one; they share the fingerprint of texts without words; they are of size 0 in the mix
and encode to no ids. A null doc_id comes last where ids decide, a null source is a source of its own. Of repeated rows,
as of other ties, the first one read stays in either dedup. Very long texts are read whole by every stage. Without
labels of both classes, quality keeps all. Empty tables pass through all stages and stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import bpe, exact_dedup, mixing, quality, simhash
from lexloom.llm.common import discard, materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of the corpus, not from what a stage kept."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.accept(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the one with the most characters, then the smallest doc_id."""
    return exact_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id."""
    return simhash.dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times."""
    return mixing.repeat(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of the mix."""
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing sources", mixing_stage),
    ("BPE encoding", encoding_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs, read = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
            discard(read)  # what the stage has read
            read = docs
    return docs
