"""Eventualities from dependency parses, by pattern rules, of sentences or of their clauses.

``extract`` is one plan of array expressions over rows of sentences, without a shuffle: the edges of a sentence are
matched by each pattern around each verb, matches are exploded, and what they are made of is computed by columns.  Only
clauses are cut by a Python function, as they come from bracketed parses.  ``eventualities`` is the same for one sentence
at hand, outside a job.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evkg.functions.ids import eid, eid_of
from evkg.operators import trees
from evkg.operators.rules import MODIFIERS, PATTERNS, SPLITS, Pattern
from evkg.schema import CLAUSE_WORDS, DEPENDENCY


def match(pattern: Pattern, verb: int, edges: list[tuple[int, str, int]]):
    """``(core edges, all edges)`` of a pattern around a verb, or None.

    Each core edge is the first that fits; its governor or its dependent is known from the ones before.
    """
    place, core = {"V1": verb}, []
    for g, label, t in pattern.core:
        known, fresh, at, to = (g, t, 0, 2) if g in place else (t, g, 2, 0)
        edge = next((e for e in edges if e[1] == label and e[at] == place[known]), None)
        if edge is None:
            return None
        place[fresh] = edge[to]
        core.append(edge)
    own = set(core)
    for word in pattern.modified:
        found = [e for e in edges if e[0] == place[word] and e[1] in MODIFIERS]
        own.update(found)
        if found:  # the last modifier brings its preposition
            own.update([e for e in edges if e[0] == found[-1][2] and e[1] == "case"][:1])
    for word, labels in pattern.joins.items():
        own.update(e for e in edges if e[0] == place[word] and e[1] in labels)
    for word, labels in pattern.besides.items():
        if any(e[0] == place[word] and e not in own and e[1] not in labels for e in edges):
            return None
    said = {place[w] for w in pattern.no_ccomp}
    if any(e[1] == "ccomp" and e[2] in said and e not in own for e in edges):
        return None
    return core, own


def construct(name: str, core, own, words: list[str], tags: list[str]) -> dict | None:
    """An eventuality of its edges.  A leading preposition goes, with the edges at it; the words keep their number."""
    at = sorted({i for g, _, t in own for i in (g, t)})
    if tags[at[0]] == "IN":
        core, own = ([e for e in x if at[0] not in (e[0], e[2])] for x in (core, own))
        at = at[1:]
    kept = sorted({i for g, _, t in own for i in (g, t)})
    place = {x: i for i, x in enumerate(kept)}
    edges = sorted({(place[g], d, place[t]) for g, d, t in own}, key=lambda e: (e[0], e[2], e[1]))
    own_words, own_tags = [words[i] for i in at], [tags[i] for i in at]
    if not own_words or "|" in own_words:
        return None
    named = named_pattern(name, edges, own_words, own_tags)
    if named is None:
        return None
    skeleton = [place[i] for i in sorted({i for g, _, t in core for i in (g, t)})]
    parts = trees.segments(len(own_words), edges)
    part_of = {i: p for p in parts for i in range(p[1], p[2] + 1)}
    phrase = lambda p: " ".join(own_words[p[1] : p[2] + 1])
    return {
        "eid": eid_of(own_words, own_tags, edges), "pattern": named, "words": own_words, "pos_tags": own_tags, "verbs": [w for w, t in zip(own_words, own_tags, strict=True) if t.startswith("VB")],
        "skeleton_words": [own_words[i] for i in skeleton], "skeleton_pos": [own_tags[i] for i in skeleton], "phrases": [phrase(p) for p in parts], "phrase_at": [p[0] for p in parts],
        "skeleton_phrases": [phrase(part_of[i]) for i in skeleton], "skeleton_at": [part_of[i][0] for i in skeleton], "dependencies": edges,
        "position": sum(kept) / len(kept) if kept else 0.0, "raw_idx": kept, "word_idx": at,
    }


def named_pattern(name: str, edges, words: list[str], tags: list[str]) -> str | None:
    """The pattern after the look at its predicate, or None where that has another tag or the subject follows."""
    if name == "s-v":
        return name if any(d == "nsubj" and (g > t or words[g] == "be") for g, d, t in edges) else None
    if name in SPLITS:
        label, end, to = SPLITS[name]
        edge = next((e for e in edges if e[1] == label), None)
        found = [p for tag, p in to.items() if edge and tag in tags[edge[end]]]
        return found[-1] if found else None
    return name


def eventualities(tokens, lemmas, tags, edges, skip=CLAUSE_WORDS, use_lemma: bool = True) -> list[dict]:
    """All eventualities of one sentence, by position; none where it holds a word of ``skip``."""
    if set(skip) & set(tokens):
        return []
    edges = [tuple(e) for e in edges]
    words = [w.lower() for w in (lemmas if use_lemma else tokens)]
    out = []
    for name, pattern in PATTERNS.items():
        for verb, tag in enumerate(tags):
            got = match(pattern, verb, edges) if tag.startswith("VB") else None
            made = construct(name, *got, words, tags) if got else None
            if made:
                out.append(made)
    return sorted(out, key=lambda e: e["position"])


EDGES = f"array<{DEPENDENCY}>"


def _first(edges: Column) -> Column:
    return F.slice(edges, 1, 1)


def matches(name: str, pattern: Pattern, edges: Column, modifiers: Column, cases: Column, verbs: Column) -> Column:
    """``array<struct<name, no, core, own>>``: ``match`` around each of ``verbs``; ``modifiers`` and ``cases`` are the
    edges of those labels.  Each step is a transform of the one before, so no expression is written twice."""
    xs, words = F.transform(verbs, lambda v: F.struct(v.alias("V1"))), ["V1"]
    for k, (g, label, t) in enumerate(pattern.core):
        known, fresh, at, to = (g, t, "gov", "dpt") if g in words else (t, g, "dpt", "gov")
        kept = [*words, *(f"c{j}" for j in range(k))]
        taken = lambda s, e: F.struct(*[s[x].alias(x) for x in kept], e[to].alias(fresh), e.alias(f"c{k}"))  # noqa: B023, E731
        fits = lambda s: _first(F.filter(edges, lambda e: (e["dep"] == label) & (e[at] == s[known])))  # noqa: B023, E731
        xs = F.flatten(F.transform(xs, lambda s: F.transform(fits(s), lambda e: taken(s, e))))  # noqa: B023
        words.append(fresh)
    places = lambda s: [s[w].alias(w) for w in words]

    def case(s: Column, word: str) -> Column:
        """The first preposition of a word's last modifier."""
        last = F.try_element_at(F.filter(modifiers, lambda e: e["gov"] == s[word]), F.lit(-1))
        return _first(F.filter(cases, lambda e: e["gov"] == last["dpt"]))

    core = lambda s: F.array(*[s[f"c{k}"] for k in range(len(pattern.core))])
    brought = lambda s: F.flatten(F.array(*[case(s, w) for w in pattern.modified]))
    xs = F.transform(xs, lambda s: F.struct(*places(s), core(s).alias("core"), brought(s).alias("cases")))

    def belongs(s: Column, e: Column) -> Column:
        out = F.array_contains(s["core"], e) | F.array_contains(s["cases"], e) | (e["dep"].isin(*MODIFIERS) & e["gov"].isin(*[s[w] for w in pattern.modified]))
        for word, labels in pattern.joins.items():
            out = out | ((e["gov"] == s[word]) & e["dep"].isin(*labels))
        return out

    xs = F.transform(xs, lambda s: F.struct(*places(s), s["core"].alias("core"), F.array_distinct(F.filter(edges, lambda e: belongs(s, e))).alias("own")))

    def allowed(s: Column) -> Column:
        """Whether no edge stands against the match: one beside it whose label its word may not have, or a clause of saying."""
        beside = F.filter(edges, lambda e: ~F.array_contains(s["own"], e))
        against = lambda e: F.lit(False)
        for word, labels in pattern.besides.items():
            against = lambda e, old=against, word=word, labels=labels: old(e) | ((e["gov"] == s[word]) & ~e["dep"].isin(*labels))
        if pattern.no_ccomp:
            against = lambda e, old=against: old(e) | ((e["dep"] == "ccomp") & e["dpt"].isin(*[s[w] for w in pattern.no_ccomp]))
        return ~F.exists(beside, lambda e: against(e))

    no = list(PATTERNS).index(name) if name in PATTERNS else len(PATTERNS)
    return F.transform(F.filter(xs, allowed), lambda s: F.struct(F.lit(name).alias("name"), F.lit(no).alias("no"), s["core"].alias("core"), s["own"].alias("own")))


def _ends(edges: Column) -> Column:
    """The words of some edges, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(edges, lambda e: F.array(e["gov"], e["dpt"])))))


def _named(name: Column, edges: Column, words: Column, tags: Column) -> Column:
    """``named_pattern`` as an expression."""
    out = F.when(name == "s-v", F.when(F.exists(edges, lambda e: (e["dep"] == "nsubj") & ((e["gov"] > e["dpt"]) | (F.get(words, e["gov"]) == "be"))), name))
    for own, (label, end, to) in SPLITS.items():
        edge = F.get(F.filter(edges, lambda e: e["dep"] == label), 0)  # noqa: B023
        tag = F.get(tags, edge["gov" if end == 0 else "dpt"])
        last = F.coalesce(*[F.when(F.contains(tag, F.lit(t)), F.lit(p)) for t, p in reversed(to.items())])
        out = out.when(name == own, last)
    return out.otherwise(name)


def _segments(n: Column, edges: Column) -> Column:
    """``trees.segments`` as an expression: the words that compound edges join get one label, runs of a label are phrases."""
    pairs = F.filter(edges, lambda e: F.startswith(e["dep"], F.lit("compound")))
    every = F.sequence(F.lit(0), n - 1)
    joined = F.aggregate(pairs, every, lambda now, e: F.transform(now, lambda x: F.when(x == F.get(now, e["gov"]), F.get(now, e["dpt"])).otherwise(x)))
    told = F.transform(pairs, lambda e: e["dpt"])
    x = F.array(F.struct(joined.alias("label"), told.alias("told")))

    def cut(x: Column) -> Column:
        begins = F.filter(every, lambda i: (i == 0) | (F.get(x["label"], i) != F.get(x["label"], i - 1)))
        ends = lambda i: F.array_min(F.filter(F.concat(begins, F.array(n)), lambda j: j > i)) - 1
        runs = F.transform(begins, lambda i: F.struct(i.alias("first"), ends(i).alias("last"), F.get(x["label"], i).alias("label")))

        def head(r: Column) -> Column:
            own = F.sequence(r["first"], r["last"])
            whole = F.size(F.filter(x["label"], lambda y: y == r["label"])) == F.size(own)
            return F.when(whole, F.coalesce(F.get(F.filter(own, lambda i: ~F.array_contains(x["told"], i)), 0), r["first"])).otherwise(r["first"])

        return F.transform(runs, lambda r: F.struct(head(r).alias("head"), r["first"].alias("first"), r["last"].alias("last")))

    return F.get(F.transform(x, cut), 0)


OUT = ["sid", "eid", "pattern", "words", "pos_tags", "verbs", "skeleton_words", "skeleton_pos", "phrases", "skeleton_phrases", "position", "raw_idx", "ners", "phrase_at", "skeleton_at", "phrase_pos", "skeleton_phrase_pos", "mentions", "dependencies", "skeleton_dependencies"]
MENTIONS = "array<struct<start:int,end:int,text:string,ner:string,link:string,entity:string>>"


def _constructed(found: DataFrame, use_lemma: bool) -> DataFrame:
    """``construct`` by columns, of rows of ``(name, core, own)`` beside their sentence."""
    apart = lambda edges: F.when(F.col("lead"), F.filter(edges, lambda e: (e["gov"] != F.col("at")[0]) & (e["dpt"] != F.col("at")[0]))).otherwise(F.col(edges))
    pick = lambda source, at: F.transform(at, lambda i: F.get(source, i))
    spread = lambda df, **cols: df.select("*", *[c.alias(n) for n, c in cols.items()])
    df = spread(found, at=_ends(F.col("own")))
    df = spread(df, lead=F.get("pos_tags", F.col("at")[0]) == "IN").withColumns({"own": apart("own"), "core": apart("core"), "at": F.when(F.col("lead"), F.slice("at", 2, F.size("at"))).otherwise(F.col("at"))})
    df = spread(df, kept=_ends(F.col("own")), skeleton_at_raw=_ends(F.col("core")), words=F.transform(pick("lemmas" if use_lemma else "tokens", "at"), F.lower), own_tags=pick("pos_tags", "at"), own_ners=pick("ners", "at"))
    df = df.where((F.size("words") > 0) & ~F.array_contains("words", "|"))
    place = lambda i: (F.array_position("kept", i) - 1).cast("int")
    ordered = F.array_sort(F.transform("own", lambda e: F.struct(place(e["gov"]).alias("gov"), place(e["dpt"]).alias("dpt"), e["dep"].alias("dep"))))
    df = spread(df, edges=F.transform(ordered, lambda e: F.struct(e["gov"], e["dep"], e["dpt"])).cast(EDGES), skeleton=F.transform("skeleton_at_raw", place))
    df = spread(df, pattern=_named(F.col("name"), F.col("edges"), F.col("words"), F.col("own_tags"))).where("pattern IS NOT NULL")
    df = spread(df, parts=_segments(F.size("words"), F.col("edges")))
    phrase = lambda p: F.array_join(F.slice("words", p["first"] + 1, p["last"] - p["first"] + 1), " ")
    df = spread(df, skeleton_parts=F.transform("skeleton", lambda i: F.get(F.filter("parts", lambda p: (p["first"] <= i) & (i <= p["last"])), 0)))
    where_to = lambda i: (F.array_position("at", i) - 1).cast("int")
    inside = F.filter("mentions", lambda m: F.array_contains("at", m["start"]) & F.array_contains("at", m["end"] - 1))

    def moved(m: Column) -> Column:
        a, b = where_to(m["start"]), where_to(m["end"] - 1)
        return F.struct(a.alias("start"), (b + 1).alias("end"), F.array_join(F.slice("words", a + 1, b - a + 1), " ").alias("text"), m["ner"].alias("ner"), m["link"].alias("link"), m["entity"].alias("entity"))

    n = F.size("kept")
    total = F.aggregate("kept", F.lit(0), lambda a, i: a + i)
    made = {
        "eid": eid("words", "own_tags", "edges"), "pos_tags": F.col("own_tags"), "verbs": pick("words", F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.startswith(F.get("own_tags", i), F.lit("VB")))),
        "skeleton_words": pick("words", "skeleton"), "skeleton_pos": pick("own_tags", "skeleton"), "phrases": F.transform("parts", phrase), "phrase_at": F.transform("parts", lambda p: p["head"]),
        "skeleton_phrases": F.transform("skeleton_parts", phrase), "skeleton_at": F.transform("skeleton_parts", lambda p: p["head"]),
        "phrase_pos": F.transform("parts", lambda p: F.get("own_tags", p["head"])), "skeleton_phrase_pos": F.transform("skeleton_parts", lambda p: F.get("own_tags", p["head"])),
        "position": F.when(n > 0, total / n).otherwise(F.lit(0.0)), "raw_idx": F.col("kept"), "ners": F.col("own_ners"), "mentions": F.transform(inside, moved), "dependencies": F.col("edges"),
        "skeleton_dependencies": F.filter("edges", lambda e: F.exists("core", lambda c: (place(c["gov"]) == e["gov"]) & (c["dep"] == e["dep"]) & (place(c["dpt"]) == e["dpt"]))),
    }
    return df.select("sid", "no", "clause", *[made[c].alias(c) if c in made else F.col(c) for c in OUT[1:]])


def _clauses(sentences: DataFrame) -> DataFrame:
    """A row a clause, with the places of its words in the sentence (``clause``).  Python sees what cuts the sentences alone."""

    def run(tokens: pd.Series, parses: pd.Series, connectives: pd.Series) -> pd.Series:
        return pd.Series([[list(c) for c in trees.clauses(list(t), p, set(c) if c is not None else set())] for t, p, c in zip(tokens, parses, connectives, strict=True)], dtype=object)

    wanted = [c for c in sentences.columns if c not in ("parse", "connective_idx")]
    found = F.pandas_udf(run, "array<array<int>>")("tokens", "parse", "connective_idx")
    cut = sentences.select(*wanted, found.alias("clauses")).select(*wanted, F.explode_outer("clauses").alias("clause")).where("clause IS NOT NULL")
    pick = lambda c: F.transform("clause", lambda i: F.get(c, i))
    to = lambda i: (F.array_position("clause", i) - 1).cast("int")
    inner = F.filter("dependencies", lambda e: F.array_contains("clause", e["gov"]) & F.array_contains("clause", e["dpt"]))
    own = {c: pick(c) for c in ("tokens", "lemmas", "pos_tags", "ners")}
    told = F.filter("mentions", lambda m: F.array_contains("clause", m["start"]) & F.array_contains("clause", m["end"] - 1))
    own["dependencies"] = F.transform(inner, lambda e: F.struct(to(e["gov"]).alias("gov"), e["dep"].alias("dep"), to(e["dpt"]).alias("dpt")))
    own["mentions"] = F.transform(told, lambda m: F.struct(to(m["start"]).alias("start"), (to(m["end"] - 1) + 1).alias("end"), *[m[c].alias(c) for c in ("text", "ner", "link", "entity")]))
    return cut.withColumns(own)


def dealt(sentences: DataFrame, by: str = "sid") -> DataFrame:
    """``sentences`` over as many partitions as the session shuffles to, by ``by``.

    A small file is read by one or two tasks however many cores there are, and ``extract``, which has no shuffle, stays
    with them, though it takes far longer for a row than reading it.  Later steps by the same key move nothing again.
    """
    return sentences.repartition(int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def extract(sentences: DataFrame, clause_split: bool = False, skip=None, use_lemma: bool = True) -> DataFrame:
    """Occurrences from ``(sid, tokens, lemmas, pos_tags, dependencies)``, with entity types and mentions where there are
    ``ners`` and ``mentions``.

    With ``clause_split`` the ``parse`` and, where there is such a column, the ``connective_idx`` (indexes of tokens
    of connectives) cut sentences into clauses first, and no word makes a sentence be skipped unless ``skip`` says so.
    Clauses share no words; of several eventualities of the same words at the same places the first pattern's counts.
    """
    skip = tuple((() if clause_split else CLAUSE_WORDS) if skip is None else skip)
    has = lambda c, other: (F.coalesce(F.col(c), other) if c in sentences.columns else other).alias(c)
    optional = [has("ners", F.transform("tokens", lambda _: F.lit("O"))), has("mentions", F.array().cast(MENTIONS)).cast(MENTIONS).alias("mentions")]
    rows = sentences.select("sid", "tokens", "lemmas", "pos_tags", F.col("dependencies").cast(EDGES).alias("dependencies"), *optional, *([has("parse", F.lit(None).cast("string")), has("connective_idx", F.array().cast("array<int>"))] if clause_split else []))
    rows = _clauses(rows) if clause_split else rows.withColumn("clause", F.lit(None).cast("array<int>"))
    if skip:
        rows = rows.where(~F.arrays_overlap("tokens", F.array(*[F.lit(w) for w in skip])))
    verbs = F.filter(F.transform("pos_tags", lambda t, i: F.when(F.startswith(t, F.lit("VB")), i)), lambda i: i.isNotNull())
    rows = rows.select("*", verbs.alias("_verbs"), F.filter("dependencies", lambda e: e["dep"].isin(*MODIFIERS)).alias("_modifiers"), F.filter("dependencies", lambda e: e["dep"] == "case").alias("_cases"))
    rows = rows.withColumn("_labels", F.transform("dependencies", lambda e: e["dep"]))

    def tried(name: str, p: Pattern) -> Column:
        """The matches of a pattern; it is tried where a sentence has all labels of its core."""
        here = [F.array_contains("_labels", label) for label in dict.fromkeys(label for _, label, _ in p.core)]
        return F.when(reduce(and_, here), matches(name, p, F.col("dependencies"), F.col("_modifiers"), F.col("_cases"), F.col("_verbs")))

    every = F.flatten(F.array_compact(F.array(*[tried(name, p) for name, p in PATTERNS.items()])))
    # An outer explode: before a plain one the optimizer would compute all matches once more, to see that there are some.
    found = rows.select("*", F.explode_outer(every).alias("_x")).where("_x IS NOT NULL").select("sid", "tokens", "lemmas", "pos_tags", "ners", "mentions", "clause", "_x.name", "_x.no", "_x.core", "_x.own")
    made = _constructed(found, use_lemma)
    if clause_split:
        whole = F.transform("raw_idx", lambda i: F.get("clause", i))
        made = made.withColumn("raw_idx", whole).withColumn("position", F.when(F.size("raw_idx") > 0, F.aggregate("raw_idx", F.lit(0), lambda a, i: a + i) / F.size("raw_idx")).otherwise(F.lit(0.0)))
        w = Window.partitionBy("sid", "eid", "raw_idx").orderBy("clause", "no")
        made = made.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return made.select(*OUT)


def merged(occurrences: DataFrame) -> DataFrame:
    """One row for each eventuality, by id, with its frequency: the output that is not in order."""
    same = [F.min(c).alias(c) for c in ("pattern", "words", "pos_tags", "verbs", "skeleton_words")]
    return occurrences.groupBy("eid").agg(F.count("*").cast("double").alias("frequency"), *same)
