"""Shared plumbing: the shared folder, lineage cuts, Arrow helpers, and distributed components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled at once in a Python worker; long texts make even these slices a few tens of MB.
SLICE = 256
#: A key with more than this share of all rows, and this many, is dealt out by itself: fewer than a thousand keys can be.
HEAVY, HEAVY_ROWS = 0.001, 1000
#: Spark's setting by which a query removes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor can read and write.

    Only where that setting is missing (local tests) does it fall back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="lexloom-")
        shared_dir.own = base
    return f"{base.rstrip('/')}/lexloom-{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage so that lost executors cost only their tasks."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    # shuffle files go as the write ends; else they go at the second collection of the driver's garbage from then on
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexloom_path = path
    # those of collected counts and samples
    spark._jvm.System.gc()
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what materialize() wrote for this very DataFrame, once nothing reads it any more."""
    path = getattr(df, "_lexloom_path", None) if df is not None else None
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all columns of ``df``."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def numbered(docs: DataFrame, what: str) -> tuple[DataFrame, str]:
    """docs written to the shared folder with a row number, and that column's name: rows stay the same rows in every later scan."""
    (rid,) = fresh(docs, "rid")
    return materialize(docs.withColumn(rid, F.monotonically_increasing_id()), what), rid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trim() -> None:
    """Gives back to the system what earlier tasks of this worker have freed, as workers serve stage after stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    _trim()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def fold(doc_id: int | None) -> int | None:
    """crc32 of the id as text, modulo 3: fold 1 is held out of every training set."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 3


def fold_column(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, keep: Callable) -> list[tuple]:
    """At most ``per_class`` labelled texts of each class, the ones with the smallest id hashes.

    Rows of fold 1, rows without a label and rows without an id never enter. The ids are picked first, by a
    top-k over the small label table, and only their texts are then fetched; the bound is 2 * per_class texts.
    Returns (keep(text), label) in the order of the ids.
    """
    marked = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull()).where(fold_column(F.col("_id")) != 1).groupBy("_id").agg(F.max("_y").alias("_y"))
    order = F.xxhash64(F.col("_id").cast("string"))
    picked = None
    for y in (0, 1):
        part = marked.where(F.col("_y") == y).orderBy(order, "_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    picked = {r["_id"]: r["_y"] for r in picked.collect()}
    if not picked:
        return []
    ids = docs.sparkSession.createDataFrame(list(picked.items()), "_id long, _y int")
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t")).join(F.broadcast(ids), "_id")
    found = {}
    for r in rows.select("_id", "_t").toLocalIterator():
        text = r["_t"] or ""
        digest = zlib.crc32(text.encode())
        if r["_id"] not in found or digest > found[r["_id"]][0]:
            found[r["_id"]] = (digest, keep(text), picked[r["_id"]])
    return [found[k][1:] for k in sorted(found)]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links of one partition, a bounded number of links at a time."""

    def out(parent):
        pairs = [(x, r) for x, r in ((k, find(parent, k)) for k in list(parent)) if x != r]
        return pa.RecordBatch.from_arrays([pa.array([r for _, r in pairs], pa.int64()), pa.array([x for x, _ in pairs], pa.int64())], ["a", "b"])

    def find(parent, x):
        r = x
        while parent[r] != r:
            r = parent[r]
        while parent[x] != r:
            parent[x], x = r, parent[x]
        return r

    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            ra, rb = find(parent, a), find(parent, b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > 500_000:
            yield out(parent)
            parent.clear()
    if parent:
        yield out(parent)


def heavy(df: DataFrame, column: str, share: float = HEAVY) -> list:
    """The values of a column that more than ``share`` of the rows, and HEAVY_ROWS, have: fewer than 1 / share, whatever the data.

    A first pass keeps at most 1 / share candidates for them, a second counts those exactly. Null is never one.
    """
    rows = df.select(F.col(column).alias("k"))
    if len(rows.take(HEAVY_ROWS + 1)) <= HEAVY_ROWS:
        return []
    candidates = [x for x in rows.freqItems(["k"], share).first()[0] if x is not None]
    if not candidates:
        return []
    counts = {r["k"]: r["n"] for r in rows.groupBy(F.when(F.col("k").isin(candidates), F.col("k")).alias("k")).agg(F.count("*").alias("n")).collect()}
    least = max(share * sum(counts.values()), HEAVY_ROWS)
    return sorted(k for k, n in counts.items() if k is not None and n > least)


def join_skewed(many: DataFrame, few: DataFrame, *on: str) -> DataFrame:
    """many join few, of which ``few`` has one row a key: keys whose first column is heavy in ``many`` never gather in a task.

    Their rows of ``few`` are broadcast: as many as keys begin with a heavy value, so the first column should be all of the key or a hash's half.
    """
    hot = heavy(many, on[0])
    if not hot:
        return many.join(few, [*on])
    there = F.col(on[0]).isin(hot)
    calm = many.where(~there).join(few.where(~there), [*on])
    return many.where(there).join(F.broadcast(few.where(there)), [*on]).unionByName(calm)


def components(links: DataFrame, native: bool = False) -> DataFrame:
    """Connected components of links (a long, b long): rows (node, root) with root the smallest node reachable.

    Alternating large-star and small-star rounds. Every round is partial aggregation (the smallest neighbour of a
    node) and an equi-join in which hubs are broadcast, so that a hub's links are never gathered in one task; each round
    is written to the shared folder. Nodes without links do not occur. ``native`` leaves out the Python pre-contraction of partitions.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    if not native:
        links = links.mapInArrow(_forest, "a long, b long")
    links = materialize(links.distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = materialize(join_skewed(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_skewed(large, down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        last, links = links, materialize(small.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b").distinct(), "stars")
        discard(last)
        discard(large)
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or (now["n"], now["h"]) == before:
            break
        before = (now["n"], now["h"])
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
