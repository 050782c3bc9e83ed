"""From documents to sentences, tokens, vocabularies, occurrences and the pair graph.

Every operator takes and gives DataFrames. Keys stay (sentence, token); sentence ids are explicit, so that results
don't depend on how files are split.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.functions import tokens as W

#: Sentence ids are document * STRIDE + place.
STRIDE = 1_000_000
#: A broadcast is asked for only where a side has no more rows than this; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if counting shows that it is small; as it is otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """sent_id, sentence: split after sentence marks and line ends."""
    cut = docs.select(F.col(key).alias("k"), F.posexplode(T.sentences(text)).alias("sp", "sentence"))
    return cut.select((F.col("k") * STRIDE + F.col("sp")).alias("sent_id"), "sentence")


def tokens(sents: DataFrame, least: int = 1) -> DataFrame:
    """sent_id, pos, token: words of at least so many characters, placed among themselves."""
    words = F.filter(T.word_tokens("sentence"), lambda t: F.length(t) >= least)
    return sents.select("sent_id", F.posexplode(words).alias("pos", "token"))


def document_tokens(docs: DataFrame, least: int = 1) -> DataFrame:
    """The tokens of the sentences of docs (doc_id, text)."""

    def run(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for ids, row, sentence, place, forms in parts:
            sent = W.sentence_ids(ids, row, sentence, STRIDE)
            for at in range(0, len(row), 50_000):
                yield pa.RecordBatch.from_arrays([x.slice(at, 50_000) for x in (sent, pa.array(place, pa.int32()), forms)], ["sent_id", "pos", "token"])

    return W.mapped(docs, run, "sent_id long, pos int, token string", least)


def document_dictionary(docs: DataFrame, least_docs: int = 5, least: int = 1) -> DataFrame:
    """The dictionary of the tokens of docs (doc_id, text); each worker finds the distinct words of its documents."""

    def run(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for ids, row, _, _, forms in parts:
            coded = forms.dictionary_encode()
            keys = np.unique(row << 32 | coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
            if whole:
                words, n = np.unique(keys & 0xFFFFFFFF, return_counts=True)
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(words)), pa.array(n, pa.int64())], ["token", "docs"])
            else:
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(keys & 0xFFFFFFFF)), ids.take(pa.array(keys >> 32))], ["token", "docs"])

    whole = not repeated(docs)
    found = W.mapped(docs, run, "token string, docs long", least)
    # documents of one id are one
    counts = found.groupBy("token").agg(F.sum("docs").alias("docs")) if whole else found.distinct().groupBy("token").agg(F.count("*").alias("docs"))
    return counts.where(F.col("docs") >= least_docs)


def document_counts(docs: DataFrame, least: int = 1) -> DataFrame:
    """token_counts() of the tokens of docs (doc_id, text)."""

    def run(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for *_, forms in parts:
            coded = forms.dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n, pa.int64())], ["token", "n"])

    return W.mapped(docs, run, "token string, n long").groupBy("token").agg(F.sum("n").alias("cn")).where(F.col("cn") >= least)


def repeated(docs: DataFrame) -> bool:
    """Whether an id has several rows."""
    return (docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > 1


def dictionary(toks: DataFrame, least_docs: int = 5) -> DataFrame:
    """token, docs: tokens by the number of documents that have them."""
    doc = F.floor(F.col("sent_id") / STRIDE)
    return toks.select("token", doc.alias("d")).distinct().groupBy("token").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs)


def occurrences(toks: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct (kw, sent_id)."""
    return toks.join(words.select("token"), "token").select(F.col("token").alias("kw"), "sent_id").distinct()


def sentence_sets(occ: DataFrame) -> DataFrame:
    """sent_id, kws: the sorted keywords of each sentence."""
    return occ.groupBy("sent_id").agg(F.sort_array(F.collect_set("kw")).alias("kws"))


def pairs(sets: DataFrame) -> DataFrame:
    """sent_id, u, v with u < v: all pairs of a sentence's keywords, without a self-join."""
    kws = F.col("kws")
    both = F.flatten(F.transform(kws, lambda a, i: F.transform(F.slice(kws, i + 2, F.greatest(F.size(kws) - i - 1, F.lit(0))), lambda b: F.struct(a.alias("u"), b.alias("v")))))
    return sets.select("sent_id", F.explode(both).alias("p")).select("sent_id", "p.u", "p.v")


def npmi(c: Column, cu: Column, cv: Column, z: Column) -> Column:
    """-ln(2 z c / (cu cv)) / ln(2 c / z); null where 2 c = z. It may exceed 1, as the joint is unordered."""
    return F.try_divide(-F.ln(F.lit(2.0) * z * c / (cu * cv)), F.ln(F.lit(2.0) * c / z))


def pair_graph(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v, c, npmi) and nodes (kw, c): c of an edge counts sentences, c of a node its neighbours there."""
    k = F.size("kws").cast("long")
    nodes = sets.select(F.explode("kws").alias("kw"), (k - 1).alias("n")).groupBy("kw").agg(F.sum("n").alias("c"))
    total = nodes.agg(F.sum("c").alias("z"))
    edges = pairs(sets).groupBy("u", "v").agg(F.count("*").alias("c"))
    nu, nv = nodes.select(F.col("kw").alias("u"), F.col("c").alias("cu")), nodes.select(F.col("kw").alias("v"), F.col("c").alias("cv"))
    scored = edges.join(nu, "u").join(nv, "v").crossJoin(F.broadcast(total))  # one row
    return scored.select("u", "v", "c", npmi(F.col("c"), F.col("cu"), F.col("cv"), F.col("z")).alias("npmi")), nodes


def subgraph(edges: DataFrame, above: float = 0.3, least: int = 3) -> DataFrame:
    """Edges over (strictly) a score and of at least so many sentences."""
    return edges.where((F.col("npmi") > above) & (F.col("c") >= least))


def pair_filter(edges: DataFrame, least: int = 1, from_: float = -1.0) -> DataFrame:
    """The inclusive filter of the pair table."""
    return edges.where((F.col("c") >= least) & (F.col("npmi") >= from_))


def neighbours(edges: DataFrame) -> DataFrame:
    """src, dst, c, npmi in both directions."""
    return edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "c", "npmi").unionByName(edges.select(F.col("v").alias("src"), F.col("u").alias("dst"), "c", "npmi"))


def bridges(edges: DataFrame, pairs_: DataFrame) -> DataFrame:
    """a, b, mid: keywords linked to both of a pair."""
    near = neighbours(edges).select("src", "dst")
    one = near.select(F.col("src").alias("a"), F.col("dst").alias("mid"))
    two = near.select(F.col("src").alias("b"), F.col("dst").alias("mid"))
    return pairs_.select("a", "b").join(one, "a").join(two, ["b", "mid"]).select("a", "b", "mid")


def shared_sentences(toks: DataFrame, pairs_: DataFrame, most: int = 6, longest: int = 32) -> DataFrame:
    """sent_id, a, b, distance: sentences of at most ``longest`` tokens in which both occur exactly once, near."""
    once = toks.groupBy("sent_id", "token").agg(F.count("*").alias("n"), F.min("pos").alias("pos")).where("n = 1")
    size = toks.groupBy("sent_id").agg((F.max("pos") + 1).alias("size")).where(F.col("size") <= longest)
    one = once.select("sent_id", F.col("token").alias("a"), F.col("pos").alias("pa"))
    two = once.select("sent_id", F.col("token").alias("b"), F.col("pos").alias("pb"))
    met = pairs_.select("a", "b").join(one, "a").join(two, ["sent_id", "b"]).join(size, "sent_id")
    return met.select("sent_id", "a", "b", F.abs(F.col("pa") - F.col("pb")).alias("distance")).where(F.col("distance") <= most)


def token_counts(toks: DataFrame, least: int = 1) -> DataFrame:
    return toks.groupBy("token").agg(F.count("*").alias("cn")).where(F.col("cn") >= least)


def merge_counts(parts: DataFrame) -> DataFrame:
    """Partial counts (token, cn) added up; rows that are no counts are skipped."""
    return parts.where(F.col("token").isNotNull() & F.col("cn").isNotNull()).groupBy("token").agg(F.sum("cn").alias("cn"))


def vocabulary(counts: DataFrame, specials: Sequence[str] = (T.UNK,)) -> DataFrame:
    """id, token, cn: specials first, then by falling count, then by token.

    Ids are places in a range-partitioned sort: each partition numbers its rows from the count of those before it,
    so the vocabulary never sits in one task.
    """
    spark = counts.sparkSession
    ordered = counts.select("token", "cn").repartitionByRange(F.desc("cn"), F.asc("token")).sortWithinPartitions(F.desc("cn"), "token").withColumn("part", F.spark_partition_id())
    n = len(specials)
    head = spark.createDataFrame([(i, s, 0) for i, s in enumerate(specials)], "id long, token string, cn long")
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))
    start = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("cn"), "token"))
    body = ordered.join(F.broadcast(start), "part").select((place + F.col("before") + n - 1).cast("long").alias("id"), "token", "cn")
    return head.unionByName(body)


def numericalize(toks: DataFrame, vocab: DataFrame) -> DataFrame:
    """toks with id: that of the token, 0 where it isn't known."""
    return toks.join(vocab.select("token", "id"), "token", "left").withColumn("id", F.coalesce("id", F.lit(0).cast("long")))


def window_pairs(toks: DataFrame, ahead: int = 6) -> DataFrame:
    """a, b, c: counts of unordered pairs of tokens at most so far apart, among the tokens given; a may equal b."""
    compact = toks.groupBy("sent_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("w"))
    w = F.col("w")
    near = F.flatten(F.transform(w, lambda t, i: F.transform(F.slice(w, i + 2, ahead), lambda u: F.struct(F.least(t, u).alias("a"), F.greatest(t, u).alias("b")))))
    return compact.select(F.explode(near).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("c"))


def skipgrams(toks: DataFrame, vocab: DataFrame, reach: int = 2) -> DataFrame:
    """word, context: neighbours up to ``reach`` places away as l-1_w, l1_w and so on; both ends in the vocabulary."""
    known = toks.join(vocab.select("token"), "token", "left_semi")
    offset = F.explode(F.array(*[F.lit(k) for k in range(-reach, reach + 1) if k]))
    here = known.select("sent_id", "pos", F.col("token").alias("word"), offset.alias("k")).withColumn("at", F.col("pos") + F.col("k"))
    there = known.select("sent_id", F.col("pos").alias("at"), "token")
    return here.join(there, ["sent_id", "at"]).select("word", F.concat(F.lit("l"), F.col("k"), F.lit("_"), "token").alias("context"))


def pair_contexts(toks: DataFrame, keywords: DataFrame, window: int = 8) -> DataFrame:
    """x, y, ctx: keyword pairs less than ``window`` apart with the tokens between them, <X> and <Y> around, padded."""
    sent = toks.groupBy("sent_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]).alias("w"))
    marked = toks.join(keywords.select("token"), "token", "left_semi").groupBy("sent_id").agg(F.collect_set("token").alias("k"))
    w, k = F.col("w"), F.col("k")

    def after(x, i):
        rest = F.filter(F.sequence(i + 1, F.least(i + window - 1, F.size(w) - 1)), lambda j: F.array_contains(k, F.get(w, j)) & (j > i))
        return F.transform(rest, lambda j: F.struct(x.alias("x"), F.get(w, j).alias("y"), F.slice(w, i + 2, j - i - 1).alias("between")))

    found = F.flatten(F.transform(w, lambda x, i: F.when(F.array_contains(k, x) & (i < F.size(w) - 1), after(x, i)).otherwise(F.array().cast("array<struct<x:string,y:string,between:array<string>>>"))))
    rows = sent.join(marked, "sent_id").select("sent_id", F.explode(found).alias("p"))
    return rows.select("sent_id", "p.x", "p.y", T.pad(F.concat(F.array(F.lit("<X>")), F.col("p.between"), F.array(F.lit("<Y>"))), window).alias("ctx"))


def document_pair_contexts(docs: DataFrame, keywords: DataFrame, window: int = 8) -> DataFrame:
    """pair_contexts() of docs (doc_id, text), made where they lie; the keywords go to the workers."""
    if repeated(docs):  # sentences of repeated documents are one
        return pair_contexts(document_tokens(docs), keywords, window)
    names = keywords.select("token").toArrow().column(0).combine_chunks().cast(pa.string())
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def run(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for ids, row, sentence, place, forms in parts:
            known = pc.is_in(forms, value_set=shared.value).to_numpy(zero_copy_only=False)
            n, pool = len(row), pa.concat_arrays([forms, pa.array(["<X>", "<Y>", T.PAD])])
            sent = W.sentence_ids(ids, row, sentence, STRIDE)
            for far in range(1, min(window, n)):
                i = np.flatnonzero(known[:-far] & known[far:] & (place[far:] - place[:-far] == far) & (row[far:] == row[:-far]) & (sentence[far:] == sentence[:-far]))
                for at in range(0, len(i), 10_000):
                    x = i[at : at + 10_000]
                    words = np.full((len(x), window), n + 2)
                    words[:, 0] = n
                    words[:, 1:far] = x[:, None] + np.arange(1, far)
                    words[:, far] = n + 1
                    ctx = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * window, pa.int32()), pool.take(pa.array(words.ravel())))
                    yield pa.RecordBatch.from_arrays([sent.take(pa.array(x)), forms.take(pa.array(x)), forms.take(pa.array(x + far)), ctx], ["sent_id", "x", "y", "ctx"])

    return W.mapped(docs, run, "sent_id long, x string, y string, ctx array<string>")


def hubs(edges: DataFrame, sets: DataFrame, least: int = 2) -> DataFrame:
    """sent_id, kw, related: keywords that graph edges tie to two or more others of their sentence."""
    tied = pairs(sets).join(edges.select("u", "v"), ["u", "v"])
    both = tied.select("sent_id", F.col("u").alias("kw"), F.col("v").alias("o")).unionByName(tied.select("sent_id", F.col("v").alias("kw"), F.col("u").alias("o")))
    return both.groupBy("sent_id", "kw").agg(F.sort_array(F.collect_set("o")).alias("o")).where(F.size("o") >= least).select("sent_id", "kw", F.array_join("o", ",").alias("related"))


def length_cover(lengths: DataFrame, share: float = 0.9) -> DataFrame:
    """n, rows, cover: how many rows are at most n long, for the distribution of a column ``n``; a row a length."""
    counts = lengths.groupBy("n").agg(F.count("*").alias("rows"))
    whole = Window.partitionBy(F.lit(0))
    run = F.sum("rows").over(whole.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return counts.select("n", "rows", (run / F.sum("rows").over(whole)).alias("cover"), (run >= share * F.sum("rows").over(whole)).alias("enough"))


def sampling_table(counts: DataFrame, power: float = 0.75) -> DataFrame:
    """token, cn, p: probabilities in proportion to cn ** power, and their running sum in the order of the tokens."""
    raised = counts.select("token", "cn", F.pow(F.col("cn").cast("double"), F.lit(power)).alias("w"))
    total = raised.agg(F.sum("w").alias("z"))
    return raised.crossJoin(F.broadcast(total)).select("token", "cn", (F.col("w") / F.col("z")).alias("p"))  # one row


def running_share(df: DataFrame, order: str, weight: str) -> DataFrame:
    """df with ``upto``: the sum of ``weight`` up to each row in the order of a column, in parts added up range by range."""
    parted = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("part", F.spark_partition_id())
    sums = parted.groupBy("part").agg(F.sum(weight).alias("s"))
    start = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))  # a row a partition
    inside = F.sum(weight).over(Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return parted.join(F.broadcast(start), "part").select(*df.columns, (inside + F.col("before")).alias("upto"))


def keep_probability(cn: Column, total: Column, sample: float = 1e-3) -> Column:
    """How likely a frequent word survives subsampling; over 1 means always."""
    t = F.lit(sample) * total
    return (F.sqrt(cn / t) + 1) * t / cn
