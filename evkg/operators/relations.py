"""Relations by seed connectives, inside a sentence and between neighbours, and candidates for connectives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evkg.schema import CONNECTIVES

#: Words between two eventualities of neighbouring sentences, fewer than which a connective joins them.
NEAR = 10


def lexicon(table=CONNECTIVES) -> Column:
    """``array<struct<sense, connective, first, second>>`` of phrases by sense; ``a..b`` has two parts."""
    words = lambda x: F.array(*[F.lit(w) for w in x.split()]).cast("array<string>")
    rows = [(sense, c, *(c.split("..") + [""])[:2]) for sense, all_ in table.items() for c in all_]
    return F.array(*[F.struct(F.lit(s).alias("sense"), F.lit(c).alias("connective"), words(a).alias("first"), words(b).alias("second")) for s, c, a, b in rows])


def places(tokens: Column, words: Column) -> Column:
    """All 0-based places where a phrase begins."""
    starts = F.when(F.size(tokens) >= F.size(words), F.sequence(F.lit(0), F.size(tokens) - F.size(words))).otherwise(F.array().cast("array<int>"))
    # The first word rules most places out before the phrase is compared.
    return F.filter(starts, lambda i: (F.get(tokens, i) == F.get(words, F.lit(0))) & (F.slice(tokens, i + 1, F.size(words)) == words))


def phrases(tokens: Column, table=CONNECTIVES) -> Column:
    """``array<struct<n, b, sense, connective, indices>>``: phrases in a sentence, of one or two parts, in any case of letters.

    Where some share words, those of more words come first, then those that begin later.
    """
    run = lambda i, w: F.sequence(i, i + F.size(w) - 1)
    once = lambda value, f: F.get(F.transform(F.array(value), f), 0)

    def found(low, x):
        one = lambda i: F.array(run(i, x["first"]))
        two = lambda i, seconds: F.transform(F.filter(seconds, lambda j: j >= i + F.size(x["first"])), lambda j: F.concat(run(i, x["first"]), run(j, x["second"])))
        singles = F.transform(places(low, x["first"]), one)
        doubles = once(places(low, x["second"]), lambda seconds: F.transform(places(low, x["first"]), lambda i: two(i, seconds)))
        every = F.flatten(F.when(F.size(x["second"]) > 0, doubles).otherwise(singles))
        return F.transform(every, lambda at: F.struct((-F.size(at)).alias("n"), (-at[0]).alias("b"), x["sense"].alias("sense"), x["connective"].alias("connective"), at.alias("indices")))

    def shared(own):
        """Words of more than one of the phrases."""
        again = lambda at: F.transform(F.slice(at, 2, F.size(at)), lambda i, k: F.when(i == F.get(at, k), i))
        return once(F.array_sort(F.flatten(F.transform(own, lambda x: x["indices"]))), lambda at: F.array_distinct(F.filter(again(at), lambda i: i.isNotNull())))

    def kept(own, taken):
        """Phrases that share no word stay; only the others are compared with one another."""
        alone = F.filter(own, lambda x: ~F.arrays_overlap(x["indices"], taken))
        others = F.filter(own, lambda x: F.arrays_overlap(x["indices"], taken))
        chosen = F.aggregate(others, F.slice(own, 1, 0), lambda a, x: F.when(F.exists(a, lambda y: F.arrays_overlap(y["indices"], x["indices"])), a).otherwise(F.concat(a, F.array(x))))
        return F.when(F.size(taken) == 0, own).otherwise(F.array_sort(F.concat(alone, chosen)))

    every = once(F.transform(tokens, lambda t: F.lower(t)), lambda low: F.array_sort(F.flatten(F.transform(lexicon(table), lambda x: found(low, x)))))
    return once(every, lambda own: once(shared(own), lambda taken: kept(own, taken)))


def candidates(sentences: DataFrame, table=CONNECTIVES) -> DataFrame:
    """``(sid, sense, connective, indices)``: a row for each of ``phrases``."""
    # An outer explode: before a plain one the optimizer would look all phrases up once more, to see that there are some.
    found = sentences.select("sid", F.explode_outer(phrases(F.col("tokens"), table)).alias("x")).where("x IS NOT NULL")
    return found.select("sid", "x.sense", "x.connective", "x.indices")


def present(tokens: Column, table=CONNECTIVES) -> Column:
    """``array<struct<sense, mid, last>>`` of the connectives whose words and phrase ``tokens`` hold, as they are written.

    ``mid`` is the mean of the words' first places; ``last`` marks the one that follows both eventualities.
    """
    said = F.array_join(tokens, " ")
    here = F.filter(lexicon(table), lambda x: F.forall(x["first"], lambda w: F.array_contains(tokens, w)) & F.contains(said, F.array_join(x["first"], " ")))
    mid = lambda x: F.aggregate(x["first"], F.lit(0.0), lambda a, w: a + F.array_position(tokens, w) - 1) / F.size(x["first"])
    return F.transform(here, lambda x: F.struct(x["sense"].alias("sense"), mid(x).alias("mid"), F.array_contains(x["first"], "instead").alias("last")))


def joined(conn: Column, head: Column, tail: Column) -> Column:
    """Senses of the connectives between two positions, or after both for the one that follows."""
    own = F.filter(conn, lambda x: F.when(x["last"], (head < tail) & (tail < x["mid"])).otherwise((head < x["mid"]) & (x["mid"] < tail)))
    return F.array_distinct(F.transform(own, lambda x: x["sense"]))


def clause_link(edges: Column, head: Column, tail: Column) -> Column:
    """Whether an ``advcl`` edge leads from a word of the head to one of the tail; false where they share words."""
    link = F.exists(edges, lambda e: F.contains(e["dep"], F.lit("advcl")) & F.array_contains(head, e["gov"]) & F.array_contains(tail, e["dpt"]))
    return link & ~F.arrays_overlap(head, tail)


def shrink(edges: Column, head: Column, tail: Column) -> Column:
    """Edges between the head, the tail and the rest, as labels; null where head and tail share words."""
    name = lambda i: F.when(F.array_contains(head, i), F.lit("_H_")).when(F.array_contains(tail, i), F.lit("_T_")).otherwise(i.cast("string"))
    out = F.filter(F.transform(edges, lambda e: F.struct(name(e["gov"]).alias("gov"), e["dep"].alias("dep"), name(e["dpt"]).alias("dpt"))), lambda e: e["gov"] != e["dpt"])
    return F.when(~F.arrays_overlap(head, tail), out)


def within(sentences: DataFrame, occurrences: DataFrame, table=CONNECTIVES) -> DataFrame:
    """Seed relations ``(hid, tid, sense, weight, head_sid, tail_sid)`` of one sentence; ``occurrences`` has ``(sid, eid,
    position, raw_idx)``.

    The head is before the tail, a clause edge leads from one to the other and the connective's middle
    lies between them; ``instead`` follows both.
    """
    own = sentences.select("sid", "dependencies", present(F.col("tokens"), table=table).alias("conn")).where(F.size("conn") > 0)
    every = occurrences.groupBy("sid").agg(F.collect_list(F.struct("eid", "position", "raw_idx")).alias("every"))
    # A head and then its tails: the occurrences are made once, and no row holds all pairs of a sentence.
    heads = every.where(F.size("every") > 1).join(own, "sid").withColumn("h", F.explode("every"))
    both = heads.withColumn("t", F.explode(F.filter("every", lambda t: F.col("h.position") < t["position"]))).where(clause_link(F.col("dependencies"), F.col("h.raw_idx"), F.col("t.raw_idx")))
    senses = F.explode(joined(F.col("conn"), F.col("h.position"), F.col("t.position"))).alias("sense")
    return both.select(F.col("h.eid").alias("hid"), F.col("t.eid").alias("tid"), senses, F.lit(1.0).alias("weight"), F.col("sid").alias("head_sid"), F.col("sid").alias("tail_sid"))


def across(sentences: DataFrame, occurrences: DataFrame, table=CONNECTIVES, near: int = NEAR) -> DataFrame:
    """Seed relations of neighbouring sentences with one eventuality each, fewer than ``near`` words apart; the
    connective may be in either sentence, between the eventualities or, for ``instead``, after both."""
    one = occurrences.groupBy("sid").agg(F.count("*").alias("n"), F.min("eid").alias("eid"), F.min("position").alias("position")).where("n = 1")
    w = Window.partitionBy("doc").orderBy("sent_idx")
    pairs = sentences.select("sid", F.col("tokens").alias("a"), F.lead("sid").over(w).alias("next"), F.lead("tokens").over(w).alias("b")).where("next IS NOT NULL")
    out = pairs.join(one.select("sid", F.col("eid").alias("hid"), F.col("position").alias("hp")), "sid").join(one.select(F.col("sid").alias("next"), F.col("eid").alias("tid"), F.col("position").alias("tp")), "next")
    out = out.withColumn("tp", F.col("tp") + F.size("a")).where(F.col("tp") - F.col("hp") < near)
    return out.select("hid", "tid", F.explode(joined(present(F.concat("a", "b"), table=table), F.col("hp"), F.col("tp"))).alias("sense"), F.lit(1.0).alias("weight"), F.col("sid").alias("head_sid"), F.col("next").alias("tail_sid"))
