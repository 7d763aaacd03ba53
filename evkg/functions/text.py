"""Scalar and array functions, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evkg.schema import PRONOUNS


def content_words(words: Column | str) -> Column:
    return F.array_except(words, F.array(*[F.lit(p) for p in PRONOUNS]))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct words, pronouns left out; 0 if nothing is left."""
    a, b = content_words(a), content_words(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def simpson(a: Column, b: Column) -> Column:
    """Shared over the fewer distinct words; 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), least), F.lit(0.0))


def clean(text: Column, keep_lines: bool = False) -> Column:
    """Text as a parser wants it: ASCII, references and addresses out, one blank at most (ends of lines may stay)."""
    text = F.regexp_replace(text, r"[^\x00-\x7F]", " ")
    text = F.regexp_replace(text, r"(?i)<ref(.*?)>", " ")
    text = F.regexp_replace(text, r"https?://[^\s]+|www\.[^\s]+", "<url>")
    return F.trim(F.regexp_replace(text, r"[^\S\n]+" if keep_lines else r"\s+", " "))


def tokens(text: Column) -> Column:
    """Runs of letters of any script, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def add_maps(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def positions(seq: Column, value: Column) -> Column:
    """All 0-based places of a value."""
    return F.filter(F.transform(seq, lambda x, i: F.when(x == value, i)), lambda i: i.isNotNull())


# Endings of a bare domain; all endings of two letters count besides.
ENDINGS = ("com", "net", "org", "edu", "gov", "mil", "aero", "asia", "biz", "cat", "coop", "info", "int", "jobs", "mobi", "museum", "name", "post", "pro", "tel", "travel", "xxx")


def has_url(text: Column) -> Column:
    """Whether a text holds an address: with a scheme, or a bare domain that is no part of a mail address."""
    ends = "|".join(ENDINGS)
    return F.rlike(text, F.lit(rf"(?i)\bhttps?:(?:/{{1,3}}|[a-z0-9%])[^\s()<>{{}}\[\]]|(?<![@a-z0-9.-])[a-z0-9]+(?:[.-][a-z0-9]+)*[.](?:{ends}|[a-z]{{2}})\b/?(?!@)"))


def has_digit(text: Column) -> Column:
    return F.rlike(text, F.lit(r"\d"))


def has_word(text: Column, word: Column) -> Column:
    """Containment at word borders."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), word, F.lit(" ")))


def swap_persons(words: Column, a: str = "PersonX", b: str = "PersonY") -> Column:
    return F.transform(words, lambda w: F.when(w == a, F.lit(b)).when(w == b, F.lit(a)).otherwise(w))


def triple(head: Column, sense: Column, tail: Column) -> Column:
    return F.concat_ws("$", head, sense, tail)


def split_triple(said: Column) -> Column:
    """``struct(head, sense, tail)`` of a triple; what follows a third mark stays in the tail."""
    parts = F.split(said, "\\$", 3)
    return F.struct(F.get(parts, 0).alias("head"), F.get(parts, 1).alias("sense"), F.get(parts, 2).alias("tail"))


def index_overlap(argument: Column, own: Column) -> Column:
    """Shared over all indexes of an argument and an eventuality; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(argument, own)).cast("double"), F.size(F.array_union(argument, own))), F.lit(0.0))


def linked(edges: Column, connective: Column, argument: Column, own: Column) -> Column:
    """Whether an edge leads between the connective and a word that argument and eventuality share."""
    both = F.array_intersect(argument, own)
    way = lambda a, b: F.array_contains(connective, a) & F.array_contains(both, b)
    return F.exists(edges, lambda e: way(e["dpt"], e["gov"]) | way(e["gov"], e["dpt"]))


def one_hot(values: Column, size: int) -> Column:
    """Zeros and ones of ``size`` places, one at each value."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(values, i).cast("int"))


def bracketed(text: Column) -> Column:
    """``array<struct<role, words>>`` of texts like ``{I}_[subject] {like}_[verb]``; what follows ``||`` in a part goes.
    A role stands once, at its first place with its last words."""
    parts = F.filter(F.split(F.trim(text), "\\]"), lambda p: F.element_at(F.split(p, "\\["), -1) != "")
    role = lambda p: F.element_at(F.split(p, "\\["), -1)
    first = lambda p: F.split(F.regexp_replace(F.regexp_replace(F.element_at(F.split(p, "\\["), 1), "\\{", ""), "\\}_", ""), "\\|\\|")[0]
    said = lambda p: F.when(F.contains(p, F.lit("||")), F.regexp_replace(F.split(p, "\\|\\|")[0], "\\{", "")).otherwise(first(p))
    every = F.transform(parts, lambda p: F.struct(role(p).alias("role"), F.trim(said(p)).alias("words")))
    last = lambda xs, r: F.element_at(F.filter(xs, lambda x: x["role"] == r), -1)
    one = lambda xs: F.transform(F.array_distinct(F.transform(xs, lambda x: x["role"])), lambda r: last(xs, r))
    return F.get(F.transform(F.array(every), one), 0)


def bracketed_text(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["words"]), " ")


def ends_with(words: Column, *last: str) -> Column:
    """Whether the last words are these."""
    return F.slice(words, -len(last), len(last)) == F.array(*[F.lit(w) for w in last])


def short_pieces(text: Column, most: int = 1024) -> Column:
    """A text cut for a parser: whole if it is short, else at blank lines, else at line ends, else after sentences,
    and what is still too long at punctuation."""
    def cut(pieces, pattern):
        return F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(F.split(p, pattern))))

    out = F.array(text)
    for pattern in ("\n\n", "\n", r"(?<=[.!?])\s+", r"[,;:]"):
        out = cut(out, pattern)
    return F.filter(F.transform(out, lambda p: F.trim(p)), lambda p: p != "")


def pad(seq: Column, length: int, fill: str = "") -> Column:
    """Cut or filled to ``length``."""
    return F.slice(F.concat(seq, F.array_repeat(F.lit(fill), length)), 1, length)


def bits_to_senses(bits: Column, senses) -> Column:
    names = F.array(*[F.lit(s) for s in senses])
    return F.filter(F.transform(names, lambda s, i: F.when(F.substring(bits, i + 1, F.lit(1)) == "1", s)), lambda s: s.isNotNull())
