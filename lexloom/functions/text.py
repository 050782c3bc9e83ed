"""Text functions as column expressions: cleaning, tokens, entities, padding, highlighting, query parsing.

Everything here stays inside the JVM; nothing needs a Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD, UNK = "<pad>", "<unk>"

#: Keywords that are no keywords: function words and single letters but c.
KEYWORD_STOPS = ("can", "it", "work", "in", "parts", "its", *[x for x in "abdefghijklmnopqrstuvwxyz"])

#: Function words for query terms; Spark's own list serves where none is given.
QUERY_STOPS = ("a", "an", "the", "of", "and", "or", "to", "in", "is", "for", "on", "with", "by", "what", "are", "it", "as", "at", "der", "die", "das", "und", "le", "la", "les", "de", "el", "los")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_corpus(text: Column | str) -> Column:
    """Literal \\n and backslashes to spaces, no $, two or more hyphens to a comma, no (...) and {...}, a spaced
    hyphen, repeated white space squeezed, ASCII lower case. The brace rule is greedy and stops at ) only."""
    out = F.replace(col(text), F.lit("\\n"), F.lit(" "))
    out = F.replace(F.replace(out, F.lit("$"), F.lit("")), F.lit("\\"), F.lit(" "))
    for pattern, by in ((r"--+", ", "), (r"\([^)]*\)", ""), (r"\{[^)]*\}", ""), ("-", " - "), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.translate(out, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clean_abstract(text: Column | str) -> Column:
    out = F.replace(F.btrim(col(text), F.lit(" \t\n\x0b\x0c\r")), F.lit("\n"), F.lit(" "))
    for old, new in (("$", ""), ("--", ", "), ("-", " - ")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def clean_wiki(text: Column | str) -> Column:
    """Headings between == marks go (greedily), then white space at the start and repeats of it."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col(text), r"==[^\n]*==", ""), r"^\s+", ""), r"\s+", " ")


def mentions_null(line: Column | str) -> Column:
    return F.contains(col(line), F.lit("null"))


def letters_only(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(text)), "[^a-zA-Z]", " "), r"\s+", " ")


def sentences(text: Column | str, ends: str = r"[.!?\n]+") -> Column:
    return F.split(col(text), ends)


def tokens(text: Column | str) -> Column:
    """Between white space; no empty tokens."""
    return F.filter(F.split(col(text), r"\s+"), lambda t: t != "")


def word_tokens(text: Column | str) -> Column:
    """Runs of a-z, 0-9 and _ after lower-casing."""
    return F.filter(F.split(F.lower(col(text)), "[^a-z0-9_]+"), lambda t: t != "")


def lemma(word: Column) -> Column:
    """Rules for plurals: -ies to -y, -sses to -ss, -xes/-ches/-shes without -es, a lone final s off."""
    return (
        F.when(F.length(word) <= 3, word)
        .when(word.rlike("[^aeiou]ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(ss|x|ch|sh)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("[^sui]s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def lemmas(text: Column | str) -> Column:
    return F.transform(tokens(text), lemma)


def normalize(text: Column | str, adverbs: str = "ly$") -> Column:
    """Lemmas without adverbs, joined again."""
    return F.array_join(F.filter(lemmas(text), lambda t: ~((F.length(t) > 4) & t.rlike(adverbs))), " ")


def entity(keyword: Column | str) -> Column:
    """One token for a keyword: hyphens are tokens of their own, all joined by _."""
    return F.array_join(tokens(F.replace(col(keyword), F.lit("-"), F.lit(" - "))), "_")


def is_stable(keyword: Column | str, stops: Sequence[str] = KEYWORD_STOPS) -> Column:
    """Whether lemmatising leaves the keyword as it is, and neither '- ' nor the stop list rules it out."""
    k = F.replace(F.lower(col(keyword)), F.lit("-"), F.lit(" - "))
    return (F.array_join(lemmas(k), " ") == F.array_join(tokens(k), " ")) & ~F.contains(col(keyword), F.lit("- ")) & ~F.lower(col(keyword)).isin(*stops)


def pad(array: Column | str, length: int, left: bool = False, keep_last: bool = False, value: str = PAD) -> Column:
    """To exactly ``length``: filled up, or cut at the end (at the start with ``keep_last``)."""
    a = col(array)
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(0), F.lit(length) - F.size(a)))
    cut = F.when(F.size(a) > length, F.slice(a, F.greatest(F.lit(1), F.size(a) - length + 1), length)).otherwise(a) if keep_last else F.slice(a, 1, length)
    return F.concat(fill, cut) if left else F.concat(cut, fill)


def align(array: Column | str, length: int) -> Column:
    """Padded like pad(); null (to be dropped) where it is longer."""
    return F.when(F.size(col(array)) <= length, pad(array, length))


def cut_pad(text: Column | str) -> Column:
    return F.split_part(col(text), F.lit(PAD), F.lit(1))


def preprocess(text: Column | str, *steps: Callable[[Column], Column], tokenize: Callable[[Column], Column] = tokens, lower: bool = True) -> Column:
    """Tokenise, lower-case, then any further steps over the token array."""
    out = tokenize(col(text))
    if lower:
        out = F.transform(out, lambda t: F.lower(t))
    for step in steps:
        out = step(out)
    return out


def highlight(array: Column | str, keywords: Column) -> Column:
    """The tokens as HTML, each contiguous run of keywords in one red span."""
    a = col(array)
    on = F.transform(a, lambda t: F.array_contains(keywords, t))

    def mark(t: Column, i: Column) -> Column:
        here = F.element_at(on, i + 1)
        before = F.coalesce(F.get(on, i - 1), F.lit(False))
        after = F.coalesce(F.get(on, i + 1), F.lit(False))
        return F.concat(F.when(here & ~before, '<span style="color:red">').otherwise(""), t, F.when(here & ~after, "</span>").otherwise(""))

    return F.array_join(F.transform(a, mark), " ")


def search_highlight(text: Column | str, terms: Sequence[str]) -> Column:
    """Terms in bold where they stand as words (of a-z, 0-9 and _), in any case."""
    import re

    return F.regexp_replace(col(text), r"(?i)(?<![a-z0-9_])(" + "|".join(map(re.escape, terms)) + r")(?![a-z0-9_])", '<b class="match">$1</b>') if terms else col(text)


def relation_prefix(context: Column | str) -> Column:
    """What stands before the first _; prep_x keeps two parts."""
    return F.regexp_extract(col(context), "^(prep_[^_]*|[^_]*)", 1)


def suggestion_words(query: Column | str, suggestions: Column | str, stops: Column | None = None) -> Column:
    """The query's words, then the new words of the suggestions that contain it, in order; stop words left out."""
    q = F.lower(F.trim(col(query)))
    own = F.filter(F.split(q, " "), lambda t: t != "")
    words = F.flatten(F.transform(F.filter(col(suggestions), lambda s: F.contains(s, q)), lambda s: F.split(s, " ")))
    drop = F.concat(own, stops) if stops is not None else own
    return F.concat(own, F.array_except(words, drop))


def without(array: Column | str, stops: Sequence[str]) -> Column:
    return F.filter(col(array), lambda t: ~t.isin(*stops))


def fill_placeholders(pattern: Column | str, x: Column | str, y: Column | str) -> Column:
    return F.replace(F.replace(col(pattern), F.lit("<X>"), col(x)), F.lit("<Y>"), col(y))


def wikidata_number(q: Column | str) -> Column:
    return F.regexp_replace(col(q), "^Q+|Q+$", "")


def underscored(label: Column | str) -> Column:
    return F.replace(col(label), F.lit(" "), F.lit("_"))


def read_words(text: Column | str, longest: int = 99) -> Column:
    """Tokens between spaces, tabs and newlines, carriage returns left out, cut to ``longest`` characters."""
    parts = F.split(F.replace(col(text), F.lit("\r"), F.lit("")), "[ \t\n]+")
    return F.transform(F.filter(parts, lambda t: t != ""), lambda t: F.substring(t, 1, longest))


def rouge(a: Column | str, b: Column | str) -> Column:
    """Unigram recall of the shorter token array within the longer, tokens counted with repeats."""
    x, y = col(a), col(b)
    short, long = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    times = lambda arr, t: F.size(F.filter(arr, lambda u: u == t))
    hits = F.aggregate(F.array_distinct(short), F.lit(0), lambda n, t: n + F.least(times(short, t), times(long, t)))
    return F.try_divide(hits.cast("double"), F.size(short))


def parse_query(text: str, lower: bool = False) -> list[str]:
    """A query's parts between semicolons, trimmed, without empty ones."""
    return [p.lower() if lower else p for p in (x.strip() for x in text.split(";")) if p]


def lookup(ids: Column | str, names: Column) -> Column:
    """Names of ids (from 0) by a broadcast array."""
    return F.transform(col(ids), lambda i: F.element_at(names, i + 1))


def odd_characters(token: Column | str) -> Column:
    """Whether a context word holds brackets, operators or bars, or is a lone hyphen or backquote."""
    return col(token).rlike(r"[{}()\\\[\]~=^/|]") | col(token).isin("-", "`")
