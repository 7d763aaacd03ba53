"""Persons of an eventuality by its parse: which words name people, which of them are one person, and the graph whose
nodes have numbers in the place of people.  All of it is array expressions over rows of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Question words for persons, words that possess, words for persons anywhere, and as subjects.
WHO = ("who", "whom", "whose", "whoever", "whomever")
POSSESSIVE = ("my", "mine", "your", "yours", "his", "hers", "ours", "theirs")
INDEFINITE = (
    "woman", "men", "women", "i", "me", "myself", "my", "mine", "you", "yourself", "your", "yours", "he", "him", "himself", "his", "she", "her", "herself", "hers",
    "we", "us", "ourself", "ourselves", "ours", "they", "them", "themself", "themselves", "their", "theirs", "anybody", "everybody", "somebody", "nobody", "anyone", "everyone", "someone",
)
SUBJECTS = ("one", "all", "man", "person", "guy")
# Words for one and the same person, by group; the first group is part of the fifth.
SAME = (
    ("i", "me", "myself", "my", "mine"), ("you", "yourself", "your", "yours"), ("he", "him", "himself", "his", "man"), ("she", "her", "herself", "hers", "woman"),
    ("we", "us", "ourself", "ourselves", "ours"), ("they", "them", "themself", "themselves", "their", "theirs"), ("anybody", "everybody", "anyone", "everyone", "all"),
)
PART, WHOLE = 0, 4
# Tags of what a copula may join, and of words that may name a person.
JOINED = ("NN", "NNS", "NNP", "NNPS", "PRP", "PRP$", "WP", "WP$", "JJ")
NOUNS = ("NN", "NNS", "NNP", "NNPS", "PRP", "PRP$", "FW", "LS")

PERSON = "struct<target:int,first:int,last:int,possessive:boolean,word:string,words:array<string>,same:int,person:int>"


def _same_group(word: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, words in enumerate(SAME):
        out = F.when(word.isin(*words), F.lit(k)).otherwise(out)
    return out


def _places(core: Column, edges: Column, tags: Column) -> Column:
    """``array<struct<at, subject, possessive>>``: subject, objects, possessors and other modifiers, in this order; empty
    without a subject."""
    item = lambda at, subject=False, possessive=False: F.struct(at.alias("at"), F.lit(subject).alias("subject"), F.lit(possessive).alias("possessive"))
    subject = F.try_element_at(F.filter(core, lambda e: F.startswith(e["dep"], F.lit("nsubj"))), F.lit(-1))["dpt"]
    both = lambda e: F.array_compact(F.array(F.when(F.startswith(F.substring(e["dep"], 2, 3), F.lit("obj")), e["dpt"]), F.when((e["dep"] == "cop") & F.get(tags, e["gov"]).isin(*JOINED), e["gov"])))
    objects = F.flatten(F.transform(core, both))
    owners = F.transform(F.filter(edges, lambda e: e["dep"] == "nmod:poss"), lambda e: e["dpt"])
    labels = F.transform(edges, lambda e: e["dep"])
    others = F.filter(F.transform(edges, lambda e, i: F.struct(F.array_position(labels, e["dep"]).alias("k"), i.alias("i"), e["dpt"].alias("at"), e["dep"].alias("dep"))), lambda x: F.contains(x["dep"], F.lit("mod")) & (x["dep"] != "nmod:poss"))
    others = F.transform(F.array_sort(others), lambda x: x["at"])
    every = F.concat(F.array(item(subject, subject=True)), F.transform(objects, lambda x: item(x)), F.transform(owners, lambda x: item(x, possessive=True)), F.transform(others, lambda x: item(x)))
    return F.when(subject.isNotNull(), every).otherwise(F.slice(every, 1, 0))


def mentioned(words: Column, tags: Column, ners: Column, mentions: Column, core: Column, edges: Column) -> Column:
    """``array<PERSON>``: the words that name people, with their compounds, and the number of their person in the node.
    Words are one person's if they, their spans or their groups of pronouns are equal to any that it has."""
    tag = lambda x: F.get(tags, x["at"])
    word = lambda x: F.get(words, x["at"])

    def person(x: Column) -> Column:
        told = F.coalesce(F.get(ners, x["at"]) == "PERSON", F.lit(False)) | F.exists(mentions, lambda m: (m["ner"] == "PERSON") & (m["start"] <= x["at"]) & (x["at"] < m["end"]))
        noun = tag(x).isin(*NOUNS) & (word(x).isin(*INDEFINITE) | (word(x).isin(*SUBJECTS) & x["subject"]) | told)
        return (tag(x).isin("PRP", "PRP$") & (word(x) != "it")) | (tag(x).isin("WP", "WP$") & word(x).isin(*WHO)) | noun

    def spanned(x: Column) -> Column:
        joined = F.filter(edges, lambda e: (e["gov"] == x["at"]) & ((e["dep"] == "compound") | (x["possessive"] & (e["dep"] == "case") & (F.get(words, e["dpt"]) == "'s"))))
        every = F.concat(F.array(x["at"]), F.transform(joined, lambda e: e["dpt"]))
        return F.struct(x["at"].alias("target"), F.array_min(every).alias("first"), (F.array_max(every) + 1).alias("last"), (x["possessive"] | word(x).isin(*POSSESSIVE) | tag(x).isin("PRP$", "WP$")).alias("possessive"), word(x).alias("word"))

    full = lambda p: F.struct(*[p[c].alias(c) for c in ("target", "first", "last", "possessive", "word")], F.slice(words, p["first"] + 1, p["last"] - p["first"]).alias("words"), _same_group(p["word"]).alias("same"))
    found = F.transform(F.transform(F.filter(_places(core, edges, tags), person), spanned), full)

    def numbered(now: Column, p: Column) -> Column:
        like = F.filter(now, lambda q: (q["words"] == p["words"]) | (q["word"] == p["word"]) | F.coalesce(q["same"] == p["same"], F.lit(False)))
        number = F.coalesce(F.array_min(F.transform(like, lambda q: q["person"])), F.array_max(F.transform(now, lambda q: q["person"])) + 1, F.lit(0))
        return F.concat(now, F.array(F.struct(*[p[c].alias(c) for c in ("target", "first", "last", "possessive", "word", "words", "same")], number.alias("person")).cast(PERSON)))

    return F.aggregate(found, F.array().cast(f"array<{PERSON}>"), numbered)


def parts(people: Column) -> Column:
    """``array<struct<part, whole>>``: persons of a node that are among others of it, as in *I* and *we*."""
    numbers = lambda k: F.array_distinct(F.transform(F.filter(people, lambda p: p["same"] == k), lambda p: p["person"]))
    return F.flatten(F.transform(numbers(PART), lambda a: F.transform(F.filter(numbers(WHOLE), lambda b: b != a), lambda b: F.struct(a.alias("part"), b.alias("whole")))))


def named(words: Column, people: Column, show_possessive: bool = True) -> Column:
    """The words of a node with ``[P0]``, ``[P1]``, ... in the place of its persons; of spans that overlap the one that
    begins first counts, of equal ones the last."""
    ordered = F.array_sort(F.transform(people, lambda p, i: F.struct(p["person"].alias("person"), i.alias("i"), p["first"].alias("first"), p["last"].alias("last"), p["possessive"].alias("possessive"))))
    placed = F.array_sort(F.transform(ordered, lambda p, i: F.struct(p["first"].alias("first"), i.alias("i"), p["last"].alias("last"), p["person"].alias("person"), p["possessive"].alias("possessive"))))
    empty = F.struct(F.slice(words, 1, 0).alias("said"), F.lit(0).alias("upto"), F.lit(-1).alias("first"))

    def put(now: Column, p: Column) -> Column:
        last = lambda q: F.try_element_at(F.filter(ordered, lambda o: (o["first"] == q["first"]) & (o["last"] == q["last"])), F.lit(-1))
        name = F.concat(F.lit("[P"), last(p)["person"].cast("string"), F.when(last(p)["possessive"] & F.lit(show_possessive), F.lit("'s]")).otherwise(F.lit("]")))
        more = F.concat(now["said"], F.slice(words, now["upto"] + 1, p["first"] - now["upto"]), F.array(name))
        return F.when(p["first"] < now["upto"], now).otherwise(F.struct(more.alias("said"), p["last"].alias("upto"), p["first"].alias("first")))

    return F.aggregate(placed, empty, put, lambda x: F.concat(x["said"], F.slice(words, x["upto"] + 1, F.size(words))))


def aligned(head: Column, tail: Column) -> Column:
    """``struct<same, subset>`` of two nodes' people: pairs of names (``H_P0``, ``T_P1``) of one person, and pairs of a
    person and those that it is among.  Of two persons the first of their mentions that agree decides."""

    def label(h: Column, t: Column) -> Column:
        n = F.least(F.size(h["words"]), F.size(t["words"]))
        alike = (F.slice(h["words"], 1, n) == F.slice(t["words"], 1, n)) | (h["word"] == t["word"]) | F.coalesce(h["same"] == t["same"], F.lit(False))
        among = lambda a, b: F.coalesce((a["same"] == PART) & (b["same"] == WHOLE), F.lit(False))
        return F.when(alike, 0).when(among(h, t), 1).when(among(t, h), 2)

    numbers = lambda people: F.array_sort(F.array_distinct(F.transform(people, lambda p: p["person"])))
    of = lambda people, k: F.filter(people, lambda p: p["person"] == k)
    first = lambda a, b: F.get(F.array_compact(F.flatten(F.transform(of(head, a), lambda h: F.transform(of(tail, b), lambda t: label(h, t))))), 0)
    h_name, t_name = (lambda k: F.concat(F.lit("H_P"), k.cast("string"))), (lambda k: F.concat(F.lit("T_P"), k.cast("string")))
    pairs = F.flatten(F.transform(numbers(head), lambda a: F.transform(numbers(tail), lambda b: F.struct(a.alias("h"), b.alias("t"), first(a, b).alias("label")))))
    two = lambda a, b: F.struct(a.alias("a"), b.alias("b"))

    def told(x: Column) -> Column:
        same = F.filter(x["pairs"], lambda p: p["label"] == 0)
        own = F.transform(F.filter(x["pairs"], lambda p: p["label"] > 0), lambda p: F.when(p["label"] == 1, two(h_name(p["h"]), t_name(p["t"]))).otherwise(two(t_name(p["t"]), h_name(p["h"]))))
        where = lambda xs, k: F.flatten(F.transform(same, lambda p: F.flatten(F.transform(xs, lambda s: k(p, s)))))
        if_ = lambda c, v: F.when(c, F.array(v)).otherwise(F.slice(F.array(v), 1, 0))
        by_head = where(x["heads"], lambda p, s: F.concat(if_(p["h"] == s["part"], two(t_name(p["t"]), h_name(s["whole"]))), if_(p["h"] == s["whole"], two(h_name(s["part"]), t_name(p["t"])))))
        by_tail = where(x["tails"], lambda p, s: F.concat(if_(p["t"] == s["part"], two(h_name(p["h"]), t_name(s["whole"]))), if_(p["t"] == s["whole"], two(t_name(s["part"]), h_name(p["h"])))))
        return F.struct(F.transform(same, lambda p: two(h_name(p["h"]), t_name(p["t"]))).alias("same"), F.array_sort(F.array_distinct(F.concat(own, by_head, by_tail))).alias("subset"))

    return F.get(F.transform(F.array(F.struct(pairs.alias("pairs"), parts(head).alias("heads"), parts(tail).alias("tails"))), told), 0)


def with_people(nodes: DataFrame, show_possessive: bool = True) -> DataFrame:
    """``nodes`` ``(words, pos_tags, ners, mentions, skeleton_dependencies, dependencies)`` with their ``people`` and, as one
    text, their ``name``."""
    out = nodes.withColumn("people", mentioned(*map(F.col, ("words", "pos_tags", "ners", "mentions", "skeleton_dependencies", "dependencies"))))
    return out.withColumn("name", F.array_join(named(F.col("words"), F.col("people"), show_possessive), " "))


def regraph(nodes: DataFrame, edges: DataFrame, show_possessive: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph of names: ``(name, frequency, forms)``, ``(head, tail, sense, weight)`` and, a row each, the alignments of
    people ``(head, tail, same, subset)`` that an edge of names was found with.

    Nodes of the same words are read by the parse of the most frequent of them.
    """
    text = nodes.withColumn("_said", F.array_join("words", " "))
    best = text.groupBy("_said").agg(F.max_by(F.struct(*nodes.columns), F.struct("frequency", "eid")).alias("x"), F.sum("frequency").alias("_f"))
    people = with_people(best.select("_said", "_f", "x.*"), show_possessive).select("_said", "_f", "people", "name")
    merged = people.groupBy("name").agg(F.sum("_f").alias("frequency"), F.count("*").alias("forms"))
    own = text.select("eid", "_said").join(people.drop("_f"), "_said").select("eid", "people", "name")
    h, t = own.toDF("hid", "_hp", "head"), own.toDF("tid", "_tp", "tail")
    # Senses add up by ids first, so people are joined once an edge.
    sums = edges.groupBy("hid", "tid").agg(F.collect_list(F.struct("sense", "weight")).alias("senses"))
    joined = sums.join(h, "hid").join(t, "tid")
    each = joined.select("head", "tail", F.explode("senses").alias("s")).groupBy("head", "tail", "s.sense").agg(F.sum("s.weight").alias("weight"))
    pairs = joined.select("head", "tail", aligned(F.col("_hp"), F.col("_tp")).alias("x")).select("head", "tail", "x.same", "x.subset").distinct()
    return merged, each, pairs
