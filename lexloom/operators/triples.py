"""Subject-relation-object triples as extractors print them: parsing, filters, spans, redundancy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T

#: Prepositions of the second relation pattern, in the order of its output.
PREPOSITIONS = ("of", "on", "in", "at", "for", "to", "with", "about", "against", "by", "above")
SPAN = 6


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: a generator stands between them and what reads them, across which
    the optimizer neither copies expressions nor moves filters."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    return df.select(*[c for c in df.columns if c not in columns], made).select("*", "_once.*").drop("_once")


def scored(line: Column, threshold: float) -> Column:
    """score: (a; r; b) -> a;r;b where the score reaches the threshold and there are three parts, else null."""
    score = F.regexp_extract(line, r"^\s*([0-9.]+)\s*:", 1)
    parts = F.split(F.btrim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1), F.lit(" ()")), ";")
    return F.when(F.try_to_number(score, F.lit("9.999999")).cast("double") >= threshold, F.when(F.size(parts) == 3, F.array_join(parts, ";")))


def block_lines(line: Column, threshold: float) -> Column:
    """What becomes of a line of the first extractor's output: sentences and blank lines stay, "No extractions" goes,
    triples are kept or dropped by score; dropped ones are null."""
    first = F.regexp_extract(line, r"^(\S*)", 1)
    triple = line.rlike(r"^\s*[0-9.]+\s*:")
    return F.when(F.trim(line) == "", "").when(first == "No", None).when(triple, scored(line, threshold)).otherwise(line)


def tabbed(line: Column) -> Column:
    """score, s, r, o between tabs -> "s; r; o"; those that hold a semicolon, or aren't four parts, are null."""
    p = F.split(line, "\t")
    return F.when((F.size(p) == 4) & ~F.contains(line, F.lit(";")), F.concat_ws("; ", F.slice(p, 2, 3)))


def semicolons(line: Column, threshold: float = 0.0) -> Column:
    """"score; s; r; o" -> "s; r; o"; without an object, or below the threshold, null."""
    p = F.transform(F.split(line, ";"), lambda x: F.trim(x))
    return F.when(F.size(p) >= 4, F.when((p[3] != "") & (F.try_to_number(p[0], F.lit("9.999999")).cast("double") >= threshold), F.concat_ws("; ", F.slice(p, 2, 3))))


def parts(triple: Column) -> Column:
    """arg1, rel, arg2 as an array of trimmed texts; null unless there are exactly three."""
    p = F.transform(F.split(triple, ";"), lambda x: F.trim(x))
    return F.when(F.size(p) == 3, p)


def worded(triples: DataFrame) -> DataFrame:
    """triples (triple, ...) with ``words``: the words of each of its parts."""
    return once(triples, words=F.transform(F.split("triple", ";"), lambda x: T.tokens(F.trim(x))))


def short_triples(triples: DataFrame, most: int = SPAN) -> DataFrame:
    """triples (triple, ...), with their words, that have three parts of at most so many words each."""
    return worded(triples).where((F.size("words") == 3) & F.forall("words", lambda x: F.size(x) <= most))


def mentioning(triples: Column, *keywords: str) -> Column:
    """Of an array of triples those that hold all keywords."""
    out = triples
    for k in keywords:
        out = _holding(out, k)
    return out


def _holding(triples: Column, keyword: str) -> Column:
    return F.filter(triples, lambda t: F.contains(t, F.lit(keyword)))


def both_ends(triple: Column, keywords: Sequence[str]) -> Column:
    """Whether each of the two arguments holds some keyword."""
    p = parts(triple)
    some = lambda x: F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(x, k))
    return p.isNotNull() & some(p[0]) & some(p[2])


def keyword_triples(triples: DataFrame, phrases: DataFrame, most: int = SPAN) -> DataFrame:
    """triples (id, triple) of short parts whose arguments hold a dictionary phrase, found as in running text."""
    from lexloom.operators.phrases import matches

    kept = short_triples(triples, most)
    w = F.col("words")
    ends = kept.select(F.col("id").alias("sent_id"), F.explode(F.array(w[0], w[2])).alias("w")).select("sent_id", F.array_join("w", " ").alias("sentence"))
    hit = matches(ends, phrases).select(F.col("sent_id").alias("id")).distinct()
    return kept.drop("words").join(hit, "id", "left_semi")


def spans(triples: DataFrame, least: int = 1, length: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """triples (id, triple) -> (id, ids array of 3 * length), vocabulary: lower case, short parts, frequent words,
    padded and numbered; triples with an unknown word are dropped."""
    from lexloom.operators.corpus import token_counts, vocabulary

    rows = short_triples(triples.withColumn("triple", F.lower("triple")), length).select("id", F.posexplode("words").alias("part", "span"))
    toks = rows.select("id", "part", F.posexplode("span").alias("pos", "token"))
    vocab = vocabulary(token_counts(toks, least), (T.UNK, T.PAD))
    known = toks.join(vocab.select("token", F.col("id").alias("t")), "token", "left")
    whole = known.groupBy("id").agg(F.count("*").alias("n"), F.count("t").alias("k"), F.collect_list(F.struct("part", "pos", "t")).alias("x")).where("n = k")
    part = lambda k: F.transform(F.filter(F.sort_array("x"), lambda y: y["part"] == k), lambda y: y["t"])
    padded = lambda a: F.slice(F.concat(a, F.array_repeat(F.lit(1).cast("long"), length)), 1, length)
    return whole.select("id", F.concat(*[padded(part(k)) for k in (0, 1, 2)]).alias("ids")), vocab


def is_a(ctx: Column) -> Column:
    """A context array that begins <X> is a, or <X> is an."""
    return (F.get(ctx, F.lit(0)) == "<X>") & (F.get(ctx, F.lit(1)) == "is") & F.get(ctx, F.lit(2)).isin("a", "an")


def is_preposition(ctx: Column) -> Column:
    """The preposition before <Y> of a context that begins <X> is; null where there is none of PREPOSITIONS."""
    before = F.get(ctx, (F.array_position(ctx, "<Y>") - 2).cast("int"))
    return F.when((F.get(ctx, F.lit(0)) == "<X>") & (F.get(ctx, F.lit(1)) == "is") & before.isin(*PREPOSITIONS), before)


def without_redundant(sentences: list[str], least: float = 0.7) -> list[str]:
    """Greedy: a sentence goes if an earlier, kept one covers it at that recall and is the shorter; a longer kept one
    goes instead. White space is normalised first; of equal lengths the newer stays, unless both are the same."""
    kept: list[list[str]] = []
    for new in (s.split() for s in sentences):
        stays = []
        redundant = False
        for i, old in enumerate(kept):
            short_, long_ = (new, old) if len(old) >= len(new) else (old, new)
            if _recall(short_, long_) < least:
                stays.append(old)
            elif old == short_:
                redundant = True
                stays += kept[i:]
                break
        kept = stays if redundant else [*stays, new]
    return [" ".join(k) for k in kept]


def _recall(short_: list[str], long_: list[str]) -> float:
    if not short_:
        return 1.0
    return sum(min(short_.count(t), long_.count(t)) for t in set(short_)) / len(short_)


def distinct_sentences(df: DataFrame, by: str, order: str, sentence: str, least: float = 0.7) -> DataFrame:
    """without_redundant() within each group of a query, in an order; groups are one query's answers."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = without_redundant(pdf.sort_values(order)[sentence].tolist(), least)
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(kept), "place": range(len(kept)), sentence: kept})

    schema = df.select(by).schema.add("place", "long").add(sentence, "string")
    return df.select(by, order, sentence).groupBy(by).applyInPandas(run, schema)
