"""Queries that write a format and read it back: every reader and writer against the rows it came from."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import corpus as C
from lexloom.plans.base import SENTENCES, TOKENS, documents, literal, query, spread, table, values
from lexloom.sources import files as S


def _text(spark: SparkSession, df: DataFrame, what: str, separator: str | None = None) -> str:
    path = S.shared_dir(spark, what)
    writer = df.select(F.col(df.columns[0]).alias("value")).write
    (writer.option("lineSep", separator) if separator else writer).text(path)
    return path


@query(f"WITH {SENTENCES} SELECT trim(sentence, ' ') AS line, count(*) AS n FROM sents WHERE trim(sentence, ' ') <> '' AND NOT contains(sentence, chr(13)) GROUP BY 1")
def src1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SNK1 and SNK2: sentences as lines, blank ones dropped."""
    path = S.shared_dir(spark, "lines")
    S.write_lines(C.sentences(spread(documents(spark, sf_dir))).where("NOT contains(sentence, '\r')").select(F.trim("sentence").alias("line")), path, drop_blank=True)
    return S.lines(spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS line_no, p_name || ': ' || p_type AS text FROM part")
def src2_numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _text(spark, table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(":"), "p_name", F.lit(": "), "p_type").alias("v")), "numbered")
    return spark.read.text(path).select(*S.parse_numbered(F.col("value")))


@query("SELECT p_partkey::VARCHAR AS id, p_name AS title, p_brand AS journal_ref, '[{\"version\":\"v1\",\"created\":\"' || p_type || '\"}]' AS versions, NULL::VARCHAR AS doi FROM part")
def src3_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records; nested values stay JSON, missing ones are null."""
    rec = table(spark, sf_dir, "part").select(F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("journal-ref"), F.array(F.struct(F.lit("v1").alias("version"), F.col("p_type").alias("created"))).alias("versions"))).alias("v"))
    return S.papers(spark, _text(spark, rec, "papers")).select("id", "title", "journal_ref", "versions", "doi")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def src4_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.json_field("props", "k").cast("long").alias("k"))


@query("SELECT p_name AS abstract, count(*) AS n FROM part GROUP BY 1")
def src5_pretty_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.concat(F.lit('{\n  "id": 1,\n  "abstract": "'), "p_name", F.lit('",\n  "title": "x"\n}'))
    path = _text(spark, table(spark, sf_dir, "part").select(lines.alias("v")), "pretty")
    return S.pretty_field(spark.read.text(path), "abstract").groupBy("abstract").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT p_brand AS key, p_name AS item FROM part")
def src6_json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SNK3, SNK13 and A2: {key: [items]} written and read."""
    path = S.shared_dir(spark, "lists")
    S.write_json_lists(table(spark, sf_dir, "part"), path, "p_brand", "p_name")
    raw = spark.read.schema("p_brand string, items array<string>").json(path)
    one = raw.select(F.to_json(F.map_from_arrays(F.array("p_brand"), F.array("items"))).alias("value"))
    return S.json_lists(one).select("key", "item")


@query("SELECT p_brand AS w0, p_type AS w1, count(*) AS freq, round(count(*) / 100.0e0, 2) AS npmi FROM part GROUP BY 1, 2")
def src7_pair_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SNK5: scores to two decimals."""
    path = S.shared_dir(spark, "pairs")
    S.write_pair_csv(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("u"), F.col("p_type").alias("v")).agg(F.count("*").alias("c")).withColumn("npmi", F.col("c") / 100), path)
    return S.pair_csv(spark, path)


@query("SELECT p_name AS keyword, count(*) AS n FROM part GROUP BY 1")
def src8_keyword_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SNK10."""
    path = S.shared_dir(spark, "csv")
    S.write_csv(table(spark, sf_dir, "part").select("p_name", "p_brand", "p_size"), path)
    return S.keyword_csv(spark, path).where("keyword <> 'p_name'").groupBy("keyword").agg(F.count("*").alias("n"))


@query("SELECT 'v' || vec_id AS token, round(embedding[1]::DOUBLE, 5) AS first, round(embedding[64]::DOUBLE, 5) AS last FROM embeddings")
def src9_text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SNK7: vectors as text, with a header."""
    path = S.shared_dir(spark, "vectors")
    S.write_text_vectors(table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("token"), F.col("embedding").alias("vec")), path)
    literal(spark, [("500 64",)], "value string").coalesce(1).write.mode("append").text(path)
    v = S.text_vectors(spark, path)
    number = lambda i: F.round(F.element_at("vec", i).cast("float").cast("double"), 5)
    return v.select("token", number(1).alias("first"), number(-1).alias("last"))


@query("SELECT 'v' || vec_id AS token, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings")
def src10_binary_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary files, one a part of the rows, written by tasks as the format's bytes."""
    import pyarrow as pa

    path = S.shared_dir(spark, "binary")

    def pack(batches):
        for b in batches:
            if b.num_rows:
                raw = S.pack_vectors(b.column(0).to_pylist(), np.array(b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["content"])

    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("token"), F.col("embedding").alias("vec"))
    packed = rows.mapInArrow(pack, "content binary")
    write = S._put_bytes(path)

    def put(batches):
        import uuid

        for b in batches:
            for raw in b.column(0).to_pylist():
                write(f"{uuid.uuid5(uuid.NAMESPACE_OID, raw[:4096].hex())}.bin", raw)
                yield pa.RecordBatch.from_arrays([pa.array([len(raw)], pa.int64())], ["n"])

    packed.mapInArrow(put, "n long").agg(F.sum("n")).collect()  # one number
    return S.binary_vectors(spark, path).select("token", F.round(F.element_at("vec", 1).cast("double"), 5).alias("first"))


_SENTENCE = "1\\tstars\\t_\\tN\\t2\\tnsubj\\t_\\t_\n2\\tshine\\t_\\tV\\t0\\troot\\t_\\t_".replace("\\t", "\t")


@query("SELECT tok_id, form, head, rel, n::BIGINT AS n FROM " + values([(0, "*root*", -1, "rroot", 3), (1, "stars", 2, "nsubj", 3), (2, "shine", 0, "root", 3)], "tok_id, form, head, rel, n"))
def src12_conll(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _text(spark, literal(spark, [(_SENTENCE,)] * 3, "v string"), "conll", "\n\n")
    return S.conll_file(spark, path).groupBy("tok_id", "form", "head", "rel").agg(F.count("*").alias("n"))


@query(f"WITH {TOKENS} SELECT token, count(*) AS cn FROM toks GROUP BY 1 HAVING count(*) >= 7")
def src13_counted_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SNK8."""
    path = S.shared_dir(spark, "vocab")
    S.write_vocab(C.token_counts(C.tokens(C.sentences(spread(documents(spark, sf_dir))))), path)
    return S.counted_vocab(spark, path, 7)


@query("SELECT row_number() OVER (ORDER BY p_name) - 1 AS id, p_name AS token FROM (SELECT DISTINCT p_name FROM part)")
def src14_listed_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three special tokens in front are skipped."""
    path = S.shared_dir(spark, "tokens")
    names = table(spark, sf_dir, "part").select("p_name").distinct().select(F.concat(F.lit("b"), "p_name").alias("o"), F.col("p_name").alias("value")).union(literal(spark, [("a1", "<unk>"), ("a2", "<pad>"), ("a3", "<X>")], "o string, value string"))
    names.coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return S.listed_vocab(spark, f"{path}/part-*", 3)


@query("SELECT count(*) AS n, sum(l_partkey)::BIGINT AS x FROM lineitem")
def src15_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SNK6: block 0 for development and the rest for training are all the rows."""
    path = S.shared_dir(spark, "blocks")
    S.write_blocks(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), path, 2000)
    both = S.triplet_blocks(spark, path, True).unionByName(S.triplet_blocks(spark, path, False))
    return both.agg(F.count("*").alias("n"), F.sum("l_partkey").alias("x"))


@query("SELECT p_partkey::VARCHAR AS sentence, 'a; b; ' || p_name AS triple FROM part WHERE p_partkey % 3 <> 0")
def src16_triple_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SNK16: blocks of a sentence and its triples, those without any dropped."""
    path = S.shared_dir(spark, "triples")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("sentence"), F.when(F.col("p_partkey") % 3 != 0, F.array(F.concat(F.lit("a; b; "), "p_name"))).otherwise(F.array().cast("array<string>")).alias("triples"))
    S.write_triples(rows, path)
    return S.triple_file(spark, path).select("sentence", F.explode("triples").alias("triple"))


@query("SELECT DISTINCT p_brand AS central, p_type AS keyword FROM part")
def src17_similarity_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.concat(F.col("p_brand"), F.lit(":"), F.array_join(F.collect_set("p_type"), ",")).alias("line"))
    return lines.select(F.explode(S.similarity_test("line")).alias("x")).select("x.*")


@query("SELECT DISTINCT 'n' || n_nationkey AS u, 'r' || n_regionkey AS v, 1::BIGINT AS c FROM nation")
def src18_edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SNK9."""
    path = S.shared_dir(spark, "edges")
    table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.lit(1)).write.option("sep", " ").csv(path)
    return S.edge_list(spark, path)


_TRIE = {"data": {"": 1, "structure": {"": 1}, "mining": {"tool": {"": 1}}}, "graph": {"": 1}}


@query("SELECT * FROM " + values([("data", "data"), ("data mining tool", "data_mining_tool"), ("data structure", "data_structure"), ("graph", "graph")], "keyword, entity"))
def src19_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal(spark, S.trie_keywords(json.dumps(_TRIE)), "keyword string, entity string")


@query("SELECT o_custkey AS id, unnest(list(o_orderkey ORDER BY o_orderkey))::INTEGER AS item FROM orders GROUP BY 1")
def src28_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also SNK4: lists of ids as text."""
    path = S.shared_dir(spark, "ids")
    table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat_ws(" ", F.col("o_custkey").cast("string"), F.sort_array(F.collect_list("o_orderkey")).cast("array<string>")).alias("line")).select("line").write.text(path)
    ids = S.id_lists("value")
    return spark.read.text(path).select(ids[0].cast("long").alias("id"), F.explode(F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))).alias("item"))


@query("SELECT n_name AS token, array_to_string(CASE WHEN n_nationkey % 2 = 0 THEN [n_regionkey::DOUBLE, 2] ELSE [1, 1] END::INTEGER[], ' ') AS types FROM nation")
def src30_type_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    types = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("token"), F.array(F.col("n_regionkey").cast("double"), F.lit(2.0)).alias("types"))
    got = S.padded_types(n.select(F.col("n_name").alias("token")), types, 2)
    return got.select("token", F.array_join(F.col("types").cast("array<int>").cast("array<string>"), " ").alias("types"))


@query("SELECT n_nationkey::BIGINT AS n, '<h3>' || n_name || '</h3><p>the <span style=\"color:red\">' || n_name || '</span> report</p>' AS html FROM nation")
def snk11_html_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    line = T.highlight(F.array(F.lit("the"), F.col("n_name"), F.lit("report")), F.array("n_name"))
    return n.select(F.col("n_nationkey").cast("long").alias("n"), S.html_report(F.col("n_name"), line).alias("html"))


@query("SELECT '{\"status\":1,\"payload\":{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}}' AS json FROM nation")
def snk12_json_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.response(table(spark, sf_dir, "nation").select("n_name", "n_regionkey"))


@query("SELECT '!' || n_name || '<=>' || r_name AS line FROM nation JOIN region ON n_regionkey = r_regionkey")
def snk15_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.shared_dir(spark, "listing")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    S.write_lines(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("!"), "n_name", F.lit("<=>"), "r_name").alias("line")), path)
    return S.lines(spark, path)


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url FROM pages")
def src22_page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stand in for fetched articles."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "url")


@query("SELECT 'v' || vec_id AS token, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def src11_stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array files with their token lists, written and read back."""
    path = S.shared_dir(spark, "stored")
    S.write_stored_vectors(table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("token"), F.col("embedding").alias("vec")), path)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return S.stored_vectors(spark, path).select("token", F.round(total, 4).alias("total"))


@query("""SELECT p_partkey, coalesce(round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4), 16.0) AS total
FROM part LEFT JOIN embeddings ON vec_id = p_partkey AND vec_id % 3 > 0""")
def src24_pretrained_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with vectors of a pretrained file, a third of which it lacks; those get a default. The file is built once."""
    path = S.shared_dir(spark, "pretrained")
    own = table(spark, sf_dir, "embeddings").where("vec_id % 3 > 0").select(F.concat(F.lit("w"), "vec_id").alias("token"), F.col("embedding").alias("vec"))
    cached = S.open_or_build(spark, path, lambda: own)
    words = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("w"), "p_partkey").alias("token"))
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return S.filled(words, cached, 64, 0.25).select("p_partkey", F.round(total, 4).alias("total"))


_HANDLE = [(f"word{i % 7}", None) for i in range(40)]


@query("SELECT 'word' || (i % 7) AS token, count(*) AS cn FROM range(40) AS t(i) GROUP BY 1")
def src25_stream_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an open stream, counted."""
    import io

    path = S.shared_dir(spark, "stdin")
    return S.from_stream(spark, io.StringIO("".join(f"{w}\n" for w, _ in _HANDLE)), path, 16).groupBy(F.col("line").alias("token")).agg(F.count("*").alias("cn"))


@query("SELECT 's' || (p_partkey % 4) AS shard, count(DISTINCT upper(p_name)) AS n FROM part WHERE p_size > 10 GROUP BY 1")
def udf3_sharded_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row operator over sharded files that drops some lines, and one on what is left of each file's shard."""
    path = S.shared_dir(spark, "shards")
    line = F.concat_ws("|", F.col("p_size").cast("string"), "p_name").alias("value")
    table(spark, sf_dir, "part").select(F.concat(F.lit("s"), F.pmod("p_partkey", F.lit(4))).alias("shard"), line).write.partitionBy("shard").text(path)
    size = lambda x: F.split(x, "[|]", 2)
    row = lambda x: F.when(size(x)[0].cast("int") > 10, F.upper(size(x)[1]))
    shard = F.regexp_extract("file", "shard=([^/]*)/", 1).alias("shard")
    return S.map_files(spark, path, row, lambda df: df.groupBy(shard).agg(F.count_distinct("line").alias("n")))


@query("""SELECT kw, coalesce(min(p_partkey), -1)::BIGINT AS entity, count(p_partkey) > 0 AS found
FROM (SELECT DISTINCT p_brand AS kw FROM part UNION SELECT 'Nothing' AS kw) LEFT JOIN part ON p_brand = kw GROUP BY kw""")
def src21_entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords by an offline table of entities: the first hit of each, or a miss for the log."""
    from lexloom.operators.graph import first_hits

    parts = table(spark, sf_dir, "part")
    words = parts.select(F.col("p_brand").alias("kw")).distinct().union(literal(spark, [("Nothing",)], "kw string"))
    return first_hits(words, parts.select(F.col("p_brand").alias("label"), F.col("p_partkey").cast("long").alias("entity")))
