"""Readers and writers of the text and binary formats, and the shared folder."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a paper record; all are read as text, nested ones as their JSON.
PAPER = ("id", "submitter", "authors", "title", "comments", "journal-ref", "doi", "report-no", "categories", "license", "abstract", "versions", "update_date", "authors_parsed")
#: Numbers of a text vector's line that are no numbers make the line malformed; lines shorter than this are headers.
NPY_BLOCK, SPAN_BLOCK = 1_000_000, 500_000


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below spark.checkpoint.dir; only a local master (as in tests) may do without, and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")

        base = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="lexloom-")
        shared_dir.own = base
    return f"{base.rstrip('/')}/lexloom-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: computed once for all its uses, and its lineage cut."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def open_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What is stored at the path; built and stored first where there is nothing yet."""
    if not exists(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path)


# sources


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line: whole lines; their order within a file is that of ``line_no`` in numbered_lines()."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def parse_numbered(line: Column) -> tuple[Column, Column]:
    """N:text, split at the first colon."""
    parts = F.split(line, ":", 2)
    return parts[0].cast("long").alias("line_no"), F.get(parts, F.lit(1)).alias("text")


def papers(spark: SparkSession, path: str) -> DataFrame:
    """JSON records, a line each, every field as text (hyphens become underscores, a missing field is null)."""
    raw = spark.read.text(path)
    return raw.select(*[F.get_json_object("value", f"$['{f}']").alias(f.replace("-", "_")) for f in PAPER])


def json_field(line: Column | str, field: str) -> Column:
    return F.get_json_object(line, f"$.{field}")


def pretty_field(df: DataFrame, field: str, column: str = "value") -> DataFrame:
    """Of pretty-printed JSON, the value of the lines that begin with a field's name."""
    start = f'"{field}": "'
    trimmed = F.ltrim(F.col(column))
    return df.where(F.startswith(trimmed, F.lit(start))).select(F.regexp_extract(trimmed, '^"[^"]*": "(.*?)",?$', 1).alias(field))


def json_lists(df: DataFrame, column: str = "value", of: str = "string") -> DataFrame:
    """{key: [item, ...]} -> key, pos, item."""
    parsed = df.select(F.from_json(column, f"map<string,array<{of}>>").alias("m"))
    return parsed.select(F.explode("m").alias("key", "items")).select("key", F.posexplode("items").alias("pos", "item"))


def pair_csv(spark: SparkSession, path: str) -> DataFrame:
    """a__b, freq, npmi -> w0, w1, freq, npmi."""
    rows = spark.read.schema("pair string, freq long, npmi double").csv(path)
    return rows.select(F.split_part("pair", F.lit("__"), F.lit(1)).alias("w0"), F.split_part("pair", F.lit("__"), F.lit(2)).alias("w1"), "freq", "npmi")


def keyword_csv(spark: SparkSession, path: str) -> DataFrame:
    """The first column."""
    return spark.read.text(path).select(F.split("value", ",")[0].alias("keyword"))


def text_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a token and its numbers, behind a header of two numbers -> token, vec."""
    parts = F.split(F.trim("value"), " ")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") > 2)
    return rows.select(F.col("p")[0].alias("token"), F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("double")).alias("vec"))


def unpack_vectors(files: DataFrame, normalize: bool = False) -> DataFrame:
    """files (content): a header line "V D", then for each token its name, a space and D little-endian 32-bit
    numbers -> token, vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                end = raw.index(b"\n")
                count, width = map(int, raw[:end].split())
                at, tokens, rows = end + 1, [], []
                for _ in range(count):
                    space = raw.index(b" ", at)
                    tokens.append(raw[at:space].lstrip(b"\n").decode("utf-8", "replace"))
                    v = np.frombuffer(raw, "<f4", width, space + 1)
                    rows.append((v / (np.linalg.norm(v) or 1) if normalize else v).astype(np.float32))
                    at = space + 1 + 4 * width
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(rows, pa.list_(pa.float32()))], ["token", "vec"])

    return files.select("content").mapInArrow(run, "token string, vec array<float>")


#: Vectors that a reader of binary files gives at once, and bytes that it asks for at once.
VECTORS_AT_ONCE, READ_BYTES = 4096, 1 << 20


def binary_vectors(spark: SparkSession, path: str, normalize: bool = False) -> DataFrame:
    """token, vec of files as unpack_vectors() has them, of any length: a task streams through each, batch by batch."""
    files = spark.read.format("binaryFile").load(path).select("path").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, at = pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else uri.replace(":/", ":///", 1))
                with fs.open_input_stream(at, buffer_size=READ_BYTES) as f:
                    yield from _vectors_of(f, normalize)

    return files.repartition(F.col("path")).mapInArrow(run, "token string, vec array<float>")


def _vectors_of(f, normalize: bool) -> Iterator[pa.RecordBatch]:
    held = b""

    def more() -> bool:
        nonlocal held
        got = f.read(READ_BYTES)
        held += got
        return bool(got)

    while b"\n" not in held and more():
        pass
    head, _, held = held.partition(b"\n")
    count, width = map(int, head.split())
    tokens, rows = [], []
    for k in range(count):
        while (space := held.find(b" ")) < 0 or len(held) < space + 1 + 4 * width:
            if not more():
                raise ValueError(f"the file ends within vector {k} of {count}")
        tokens.append(held[:space].lstrip(b"\n").decode("utf-8", "replace"))
        v = np.frombuffer(held, "<f4", width, space + 1)
        rows.append((v / (np.linalg.norm(v) or 1) if normalize else v).astype(np.float32))
        held = held[space + 1 + 4 * width :]
        if len(rows) == VECTORS_AT_ONCE or k == count - 1:
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(rows, pa.list_(pa.float32()))], ["token", "vec"])
            tokens, rows = [], []


def write_stored_vectors(df: DataFrame, path: str) -> None:
    """token, vec -> parts of an array file and a token list each: NAME.npy and NAME.vocab, written by tasks."""
    write = _put_bytes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        from pyspark import TaskContext

        for k, batch in enumerate(batches):
            if batch.num_rows:
                name, out = f"part-{TaskContext.get().partitionId():05d}-{k:05d}", io.BytesIO()
                np.save(out, np.array(batch.column(1).to_pylist(), np.float32))
                write(f"{name}.npy", out.getvalue())
                write(f"{name}.vocab", "\n".join(batch.column(0).to_pylist()).encode())
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    df.select("token", "vec").mapInArrow(run, "n long").agg(F.sum("n")).collect()  # one number


def _put_bytes(path: str):
    def write(name: str, raw: bytes) -> None:
        import pyarrow.fs

        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(at, recursive=True)
        own = f"{at}/.{name}-{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as f:
            f.write(raw)
        fs.move(own, f"{at}/{name}")

    return write


def stored_vectors(spark: SparkSession, path: str) -> DataFrame:
    """token, vec of all NAME.npy and NAME.vocab below the path; a part is read by one task."""
    import io

    both = spark.read.format("binaryFile").option("pathGlobFilter", "*.{npy,vocab}").load(path)
    parts = both.select(F.regexp_extract("path", r"^(.*)\.(npy|vocab)$", 1).alias("name"), F.endswith("path", F.lit(".npy")).alias("array"), "content").groupBy("name").agg(F.max(F.when(F.col("array"), F.col("content"))).alias("npy"), F.max(F.when(~F.col("array"), F.col("content"))).alias("vocab"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for npy, vocab in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, tokens = np.load(io.BytesIO(npy), allow_pickle=False), vocab.decode().split("\n")
                for at in range(0, len(tokens), VECTORS_AT_ONCE):
                    yield pa.RecordBatch.from_arrays([pa.array(tokens[at : at + VECTORS_AT_ONCE]), pa.array([*rows[at : at + VECTORS_AT_ONCE]], pa.list_(pa.float32()))], ["token", "vec"])

    return parts.select("npy", "vocab").mapInArrow(run, "token string, vec array<float>")


def filled(words: DataFrame, pretrained: DataFrame, width: int, default: float = 0.0) -> DataFrame:
    """words (token, ...) with the vector of each from a pretrained table, ``default`` throughout where it has none."""
    return words.join(pretrained.select("token", "vec"), "token", "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(default).cast("float"), width)))


def from_stream(spark: SparkSession, handle, path: str, batch: int = 10_000) -> DataFrame:
    """Lines of an open text stream, as of a pipe -> line; written to the path a batch at a time, never held whole."""
    from itertools import islice

    while part := [(x.rstrip("\n"),) for x in islice(handle, batch)]:
        spark.createDataFrame(part, "value string").coalesce(1).write.mode("append").text(path)
    return lines(spark, path) if exists(spark, path) else spark.createDataFrame([], "line string")


def map_files(spark: SparkSession, path: str, row, post=None) -> DataFrame:
    """file, line: ``row`` (a column -> a column) of each line of every file below the path, null lines dropped; ``post``
    (a DataFrame -> a DataFrame) then works on each file's lines by the column ``file``."""
    out = spark.read.text(path).select(F.input_file_name().alias("file"), row(F.col("value")).alias("line")).where("line IS NOT NULL")
    return post(out) if post else out


def conll(text: Column | str) -> Column:
    """A sentence's lines (tab-separated; the head is fourth from the end, the relation third) -> array of
    (tok_id, form, head, rel), a root in front."""
    rows = F.filter(F.split(text, "\n"), lambda r: F.trim(r) != "")
    cells = lambda r: F.split(r, "\t")
    token = lambda r: F.struct(cells(r)[0].cast("int").alias("tok_id"), cells(r)[1].alias("form"), F.element_at(cells(r), -4).cast("int").alias("head"), F.element_at(cells(r), -3).alias("rel"))
    root = F.struct(F.lit(0).alias("tok_id"), F.lit("*root*").alias("form"), F.lit(-1).alias("head"), F.lit("rroot").alias("rel"))
    return F.concat(F.array(root), F.transform(rows, token))


def conll_file(spark: SparkSession, path: str) -> DataFrame:
    """sent_id, tok_id, form, head, rel; blank lines divide sentences, which are numbered as they are read."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    return blocks.select(F.monotonically_increasing_id().alias("sent_id"), F.explode(conll("value")).alias("t")).select("sent_id", "t.*")


def counted_vocab(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """word count -> token, cn."""
    return spark.read.option("sep", " ").schema("token string, cn long").csv(path).where(F.col("cn") >= least)


def listed_vocab(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """A token a line -> id, token; ids are places in the file less those skipped. One file, read by one task, as
    vocabularies are small."""
    text = spark.read.format("binaryFile").load(path).select(F.rtrim(F.col("content").cast("string")).alias("value"))
    rows = text.select(F.posexplode(F.split(F.regexp_replace("value", "\n+$", ""), "\n")).alias("id", "token"))
    return rows.where(F.col("id") >= skip).select((F.col("id") - skip).cast("long").alias("id"), "token")


def triplet_blocks(spark: SparkSession, path: str, dev: bool) -> DataFrame:
    """Blocks written by write_blocks(); block 0 is for development, the rest for training."""
    return spark.read.parquet(path).where(F.col("block") == 0 if dev else F.col("block") > 0)


def triple_blocks(text: Column | str) -> Column:
    """A block of lines: the sentence, then its triples -> struct(sentence, triples)."""
    rows = F.filter(F.split(text, "\n"), lambda r: F.trim(r) != "")
    return F.struct(rows[0].alias("sentence"), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))).alias("triples"))


def triple_file(spark: SparkSession, path: str) -> DataFrame:
    blocks = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    return blocks.select(triple_blocks("value").alias("b")).select("b.*")


def similarity_test(line: Column | str) -> Column:
    """central:kw1,kw2 -> array of (central, keyword)."""
    parts = F.split(line, ":", 2)
    return F.transform(F.filter(F.split(parts[1], ","), lambda k: F.trim(k) != ""), lambda k: F.struct(F.trim(parts[0]).alias("central"), F.trim(k).alias("keyword")))


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", " ").schema("u string, v string, c long").csv(path)


def trie_keywords(raw: str) -> list[tuple[str, str]]:
    """A nested JSON dictionary whose empty key marks an end -> (keyword, entity), in order."""
    found, stack = [], [((), json.loads(raw))]
    while stack:
        path, node = stack.pop()
        if "" in node and path:
            found.append((" ".join(path), "_".join(path)))
        stack += [((*path, k), v) for k, v in sorted(node.items(), reverse=True) if k]
    return found


def id_lists(line: Column | str) -> Column:
    return F.transform(F.filter(F.split(line, " "), lambda x: x != ""), lambda x: x.cast("int"))


def padded_types(vocab: DataFrame, types: DataFrame, width: int) -> DataFrame:
    """Rows of the vocabulary with their type vectors, ones where there is none."""
    return vocab.join(types, "token", "left").select(*vocab.columns, F.coalesce("types", F.array_repeat(F.lit(1.0), width)).alias("types"))


# sinks


def write_lines(df: DataFrame, path: str, column: str = "line", drop_blank: bool = False) -> None:
    rows = df.where(F.trim(column) != "") if drop_blank else df
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_json_lists(df: DataFrame, path: str, key: str, item: str) -> None:
    """{"key": ..., "items": [...]} a line, items sorted."""
    df.groupBy(key).agg(F.sort_array(F.collect_set(item)).alias("items")).write.mode("overwrite").json(path)


def write_pair_csv(edges: DataFrame, path: str) -> None:
    """u__v, c, npmi to two decimals; the full precision stays in parquet."""
    edges.select(F.concat("u", F.lit("__"), "v").alias("pair"), "c", F.format_string("%.2f", F.round("npmi", 2)).alias("npmi")).write.mode("overwrite").csv(path)


def write_blocks(df: DataFrame, path: str, block_rows: int = NPY_BLOCK) -> None:
    """Blocks of at most so many rows; numbered by row keys, so that a rerun of a task gives the same blocks."""
    parts = max(1, -(-df.count() // block_rows))
    dealt = df.withColumn("block", F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int"))
    dealt.repartition(parts, "block").write.mode("overwrite").option("maxRecordsPerFile", block_rows).partitionBy("block").parquet(path)


def write_text_vectors(df: DataFrame, path: str) -> None:
    """token and numbers a line; the header's two numbers are in the file of their own that sorts first."""
    df.select(F.concat_ws(" ", "token", F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value")).write.mode("overwrite").text(path)


def pack_vectors(tokens: list[str], rows: np.ndarray) -> bytes:
    head = f"{len(tokens)} {rows.shape[1] if len(tokens) else 0}\n".encode()
    return head + b"".join(t.encode() + b" " + struct.pack(f"<{rows.shape[1]}f", *r) + b"\n" for t, r in zip(tokens, rows.tolist(), strict=True))


def write_vocab(df: DataFrame, path: str) -> None:
    """word count, most frequent first."""
    df.select("token", "cn").orderBy(F.desc("cn"), "token").write.mode("overwrite").option("sep", " ").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_triples(df: DataFrame, path: str, drop_empty: bool = True) -> None:
    """Blocks of a sentence and its triples, a blank line between them."""
    kept = df.where(F.size("triples") > 0) if drop_empty else df
    kept.select(F.concat_ws("\n", "sentence", "triples").alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def html_report(title: Column, sentence: Column) -> Column:
    return F.concat(F.lit("<h3>"), title, F.lit("</h3><p>"), sentence, F.lit("</p>"))


def response(df: DataFrame, status: int = 1) -> DataFrame:
    """Each row as the JSON of an answer."""
    return df.select(F.to_json(F.struct(F.lit(status).alias("status"), F.struct(*df.columns).alias("payload"))).alias("json"))


def save_model(spark: SparkSession, path: str, config: dict, arrays: dict[str, np.ndarray]) -> None:
    """A model's settings and weights as a row each; a later save replaces it."""
    rows = [("config", json.dumps(config), None, None)] + [(k, str(v.dtype), list(v.shape), v.tobytes()) for k, v in arrays.items()]
    spark.createDataFrame(rows, "name string, kind string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> tuple[dict, dict[str, np.ndarray]]:
    config, arrays = {}, {}
    for r in spark.read.parquet(path).collect():  # a row an array of the model
        if r["name"] == "config":
            config = json.loads(r["kind"])
        else:
            arrays[r["name"]] = np.frombuffer(bytes(r["data"]), r["kind"]).reshape(r["shape"]).copy()
    return config, arrays
