"""Entity candidates, mention dictionaries, and the lookups of a dialogue."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evkg.operators.extract import dealt
from evkg.sources import steps


def mention_dictionary(links: DataFrame) -> DataFrame:
    """``(mention, entity, freq)`` from counts ``(mention, entity, n)``: shares of a mention, one at most."""
    total = F.sum("n").over(Window.partitionBy("mention"))
    sums = links.groupBy("mention", "entity").agg(F.sum("n").alias("n"))
    return sums.withColumn("freq", F.least(F.lit(1.0), F.col("n") / total)).drop("n")


def best_entities(mentions: DataFrame, dictionary: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """The likeliest entity of each mention; redirects are followed once; ties by name."""
    found = mentions.join(dictionary, "mention")
    if redirects is not None:
        found = found.join(redirects.toDF("entity", "_to"), "entity", "left").withColumn("entity", F.coalesce("_to", "entity")).drop("_to")
    found = found.groupBy("mention", "entity").agg(F.max("freq").alias("freq"))
    w = Window.partitionBy("mention").orderBy(F.col("freq").desc(), "entity")
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def heaviest(nodes: DataFrame, edges: DataFrame, k: int, cap: int, seed: int = 0) -> DataFrame:
    """``(hid, told)``: of each head, with every sense but the last, the ``k`` heaviest successors that are nodes, as ``array<struct<draw, tid, sense>>``
    in order of their draws; more than ``cap`` can't be of use to a post.  ``edges`` are read once, with a row for each sense of a pair."""
    pairs = edges.groupBy("hid", "tid").agg(F.sum("weight").alias("total"), F.collect_list(F.when(F.col("sense") != "Co_Occurrence", F.col("sense"))).alias("senses"))
    best = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("hid").orderBy(F.col("total").desc(), "tid"))).where(F.col("_r") <= k)
    each = best.join(nodes.select(F.col("eid").alias("tid")), "tid", "left_semi").select("hid", "tid", F.explode("senses").alias("sense"))
    one = F.struct(F.xxhash64("hid", "tid", "sense", F.lit(seed)).alias("draw"), "tid", "sense")
    return each.groupBy("hid").agg(F.slice(F.array_sort(F.collect_list(one)), 1, cap).alias("told"))


def inference(posts: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 8, cap: int = 20, seed: int = 0) -> DataFrame:
    """Triples for the events of a post ``(post, eid)``: the ``k`` heaviest successors, every sense but the last, ``cap`` a post.

    Posts meet with their heads alone, over all of the session's partitions; triples, many times as many, are made of them
    at the end where they are, and only those of posts with more than ``cap`` are ranked.
    """
    heads = steps.kept(heaviest(nodes, edges, k, cap, seed))
    own = dealt(posts.select("post", F.col("eid").alias("hid")), "post").distinct().join(heads.select("hid", F.size("told").alias("_n")), "hid")
    own = own.select("post", "hid", F.sum("_n").over(Window.partitionBy("post")).alias("_n"))
    made = lambda some: own.where(some).join(heads, "hid").select("post", "hid", F.explode("told").alias("x"))
    w = Window.partitionBy("post").orderBy("x.draw", "hid", "x.tid", "x.sense")
    many = made(F.col("_n") > cap).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")
    return made(F.col("_n") <= cap).unionByName(many).select("post", "hid", "x.sense", "x.tid")


def contained(keys: DataFrame, posts: DataFrame) -> DataFrame:
    """``(key, post)``: keys all of whose tokens a post has.  A key is looked up by its rarest token alone, so a
    common token brings no pair that another would rule out."""
    k = keys.select("key", F.array_distinct("tokens").alias("t")).where(F.size("t") > 0).distinct()
    p = posts.select("post", F.array_distinct("tokens").alias("own"))
    often = p.select(F.explode("own").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    each = k.select("key", "t", F.explode("t").alias("token")).join(often, "token", "left")
    rare = each.groupBy("key", "t").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    # A token travels without its post's other ones; only hits fetch them.
    hits = rare.join(p.select("post", F.explode("own").alias("token")), "token").select("key", "t", "post")
    return hits.join(p, "post").where(F.forall("t", lambda x: F.array_contains("own", x))).select("key", "post").distinct()


def aliases(phrase: Column, stop_words) -> Column:
    """Names that a mention may go by: itself, and its words with capitals, stop words without; months and days have
    their abbreviations instead, with and without a dot."""
    low, upper = F.lower(phrase), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2_147_483_647))
    dotted = lambda xs: F.flatten(F.transform(xs, lambda x: F.array(x, F.concat(x, F.lit(".")))))
    short = F.array(upper(F.substring(phrase, 1, 3)))
    more = F.lit(None).cast("array<string>")
    for name, others in MORE_SHORT.items():
        more = F.when(low == name, F.array(*[F.lit(o) for o in others])).otherwise(more)
    named = dotted(F.concat(short, F.coalesce(more, F.array().cast("array<string>"))))
    stop = F.array(*[F.lit(w) for w in stop_words]).cast("array<string>")
    form = F.array_join(F.transform(F.split(phrase, " "), lambda w: F.when(F.array_contains(stop, w), F.lower(w)).otherwise(upper(F.lower(w)))), " ")
    return F.array_distinct(F.when(low.isin(*TIMES), named).otherwise(F.array(phrase, form)))


# Names of months and days that have abbreviations, and the ones of some besides their first three letters.
TIMES = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday",
)
MORE_SHORT = {"september": ("Sept",), "tuesday": ("Tu", "Tues"), "thursday": ("Thur", "Thurs", "Th")}


def one_person(names: list[str]) -> list[str]:
    """For each of several names the smallest of those that it is joined to: names that hold one another at blanks,
    directly or over others.  A name looks up its runs of words, no name looks at all others."""
    up = {n: n for n in names}

    def root(n: str) -> str:
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    sizes = sorted({n.count(" ") + 1 for n in up})
    for name in up:
        words = name.split(" ")
        for k in (k for k in sizes if k <= len(words)):
            for i in range(len(words) - k + 1):
                held = " ".join(words[i : i + k])
                if held in up:
                    a, b = sorted((root(held), root(name)))
                    up[b] = a
    return [root(n) for n in names]


def same_persons(mentions: DataFrame) -> DataFrame:
    """``(doc, mention, person)``: persons' mentions of one document that hold one another at word borders, directly or
    over others, have the smallest of their texts as ``person``.  The names of a document meet in one row."""

    def run(names: pd.Series) -> pd.Series:
        return pd.Series([one_person(list(x)) for x in names], dtype=object)

    own = mentions.where("ner = 'PERSON'").select("doc", F.col("mention").cast("string").alias("mention")).where("mention IS NOT NULL")
    # Arrays of many documents reach Python together: a call for each document costs more than its names.
    each = own.groupBy("doc").agg(F.collect_set("mention").alias("mention")).select("doc", "mention", F.pandas_udf(run, "array<string>")("mention").alias("person"))
    return each.select("doc", F.explode_outer(F.arrays_zip("mention", "person")).alias("x")).select("doc", "x.mention", "x.person")


def shared_candidates(candidates: DataFrame, persons: DataFrame) -> DataFrame:
    """``(doc, person, entity, freq)``: the candidates of all mentions of a person, by document or by text alone; the frequency of one that several
    mentions bring is the mean of what is had so far and the next one's, in order of the mentions."""
    own = persons.join(candidates, [c for c in ("doc", "mention") if c in candidates.columns]).groupBy("doc", "person", "entity").agg(F.array_sort(F.collect_list(F.struct("mention", "freq"))).alias("x"))
    freq = F.aggregate(F.slice("x", 2, F.size("x")), F.col("x")[0]["freq"], lambda a, y: (a + y["freq"]) / 2)
    return own.select("doc", "person", "entity", freq.alias("freq"))


#: Shares that differ from one by less count as one.
CERTAIN = 1e-4


def candidates_of(texts: DataFrame, dictionary: DataFrame, redirects: DataFrame, stop_words=()) -> DataFrame:
    """``(mention, entity, freq)``: entities that the dictionary ``(mention, entity, freq)`` has for any alias of a text,
    the highest share of each; a redirect ``(mention, entity)`` of an alias is certain."""
    named = texts.select("mention").distinct().select("mention", F.explode(aliases(F.col("mention"), stop_words)).alias("alias"))
    sure = redirects.select("mention", "entity", F.lit(1.0).alias("freq"))
    known = dictionary.select("mention", "entity", F.col("freq").cast("double").alias("freq")).unionByName(sure).withColumnRenamed("mention", "alias")
    return named.join(known, "alias").groupBy("mention", "entity").agg(F.max("freq").alias("freq"))


def chosen(candidates: DataFrame, keys: list[str], vague: DataFrame) -> DataFrame:
    """``(keys, entity)``: the likeliest candidate, of several the first by name.  A page of ``vague`` (``entity``), which only
    tells names apart, gives way to the next certain one that is none; without one there is no link."""
    told = candidates.join(vague.select("entity").distinct().withColumn("_v", F.lit(True)), "entity", "left")
    rank = F.struct((-F.col("freq")).alias("f"), "entity", F.col("_v").isNotNull().alias("vague"))
    sure = (F.abs(F.col("freq") - 1) < CERTAIN) & F.col("_v").isNull()
    best = told.groupBy(*keys).agg(F.min(rank).alias("first"), F.min(F.when(sure, F.col("entity"))).alias("next"))
    return best.select(*keys, F.when(~F.col("first.vague"), F.col("first.entity")).when(F.abs(F.col("first.f") + 1) < CERTAIN, F.col("next")).alias("entity")).where("entity IS NOT NULL")


def link(mentions: DataFrame, dictionary: DataFrame, redirects: DataFrame, vague: DataFrame, persons: DataFrame, stop_words=()) -> DataFrame:
    """``mentions`` ``(doc, mention, ner, ...)`` with their ``entity``, null where there is none.

    Candidates come from the dictionary and the redirects by alias, once for each distinct text.  Mentions of persons,
    by type or because the likeliest candidate is among ``persons`` (``entity``), share the candidates of all mentions
    of their person in the document; all others have those of their text.
    """
    found = steps.kept(candidates_of(mentions, dictionary, redirects, stop_words))
    likeliest = found.groupBy("mention").agg(F.min_by("entity", F.struct(-F.col("freq"), "entity")).alias("entity"))
    known = likeliest.join(persons.select("entity").distinct(), "entity", "left_semi").select("mention", F.lit(True).alias("_p"))
    typed = mentions.join(known, "mention", "left").withColumn("_p", F.coalesce(F.col("ner") == "PERSON", F.lit(False)) | F.col("_p").isNotNull())
    people = steps.kept(same_persons(typed.where("_p").select("doc", "mention", F.lit("PERSON").alias("ner"))))
    by_text = chosen(found, ["mention"], vague).withColumnRenamed("entity", "_text")
    # A person one of whose mentions alone has candidates has what is chosen for its text; the candidates of the others meet.
    with_any = found.select("mention").distinct().join(by_text, "mention", "left")
    told = steps.kept(people.join(with_any, "mention").withColumn("_n", F.count("*").over(Window.partitionBy("doc", "person"))))
    several = chosen(shared_candidates(found, told.where("_n > 1").select("doc", "mention", "person")), ["doc", "person"], vague)
    by_person = told.where("_n = 1 AND _text IS NOT NULL").select("doc", "person", F.col("_text").alias("entity")).unionByName(several)
    own = people.join(by_person, ["doc", "person"]).select("doc", "mention", F.lit(True).alias("_p"), F.col("entity").alias("_own"))
    out = typed.join(own, ["doc", "mention", "_p"], "left").join(by_text, "mention", "left")
    return out.select(*mentions.columns, F.when(F.col("_p"), F.col("_own")).otherwise(F.col("_text")).alias("entity"))


def link_sentences(sentences: DataFrame, dictionary: DataFrame, redirects: DataFrame, vague: DataFrame, persons: DataFrame, stop_words=(), address: str = "") -> DataFrame:
    """``sentences`` whose ``mentions`` have their ``entity`` and, made of it and ``address``, their ``link``."""
    each = sentences.select("doc", "sid", F.posexplode("mentions").alias("at", "m")).select("doc", "sid", "at", "m", F.col("m.text").alias("mention"), F.col("m.ner").alias("ner"))
    told = link(each, dictionary, redirects, vague, persons, stop_words)
    filled = F.struct("at", F.struct("m.start", "m.end", "m.text", "m.ner", F.coalesce(F.concat(F.lit(address), "entity"), "m.link").alias("link"), F.coalesce("entity", "m.entity").alias("entity")).alias("m"))
    whole = told.groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(filled)), lambda x: x["m"]).alias("_m"))
    return sentences.join(whole, "sid", "left").withColumn("mentions", F.coalesce("_m", "mentions")).select(*sentences.columns)


def pair_lookup(triples: DataFrame, posts: DataFrame) -> DataFrame:
    """Triples ``(a, r, b)`` whose two words both occur in a post, in either order; each is looked up by its rarer word."""
    p = posts.select("post", F.explode(F.array_distinct("tokens")).alias("t"))
    often = p.groupBy("t").agg(F.count("*").alias("n"))
    rows = triples.where("a <> b").join(often.toDF("a", "_na"), "a").join(often.toDF("b", "_nb"), "b")
    first = (F.col("_na") < F.col("_nb")) | ((F.col("_na") == F.col("_nb")) & (F.col("a") < F.col("b")))
    rows = rows.select("a", "r", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("t"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("_other"))
    return rows.join(p, "t").join(p.select("post", F.col("t").alias("_other")), ["post", "_other"]).select("post", "a", "r", "b")


def coverage(posts: DataFrame, triples: DataFrame) -> DataFrame:
    """Share of posts with a triple, and how many heads are covered."""
    with_one = triples.select("post").distinct().withColumn("_c", F.lit(1))
    hit = posts.select("post").distinct().join(with_one, "post", "left").agg(F.count("*").alias("posts"), F.count("_c").alias("covered"))
    return hit.crossJoin(triples.agg(F.count_distinct("hid").alias("heads")))  # one row each
