"""Filters and rewriting of finished graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evkg.functions.text import bracketed, bracketed_text, has_digit, has_url, swap_persons

# Verbs of saying, deictic words, words that no event begins with.
SAYING = ("say", "do", "tell")
DEICTIC = ("this", "that", "these", "those", "here", "there")
ASKING = ("be", "how", "t", "what", "when", "where", "which", "who", "why", "do", "-lsb-", "whatever", "whose", "whom", "if")


def among(words: Column, some) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in some]))


def keep_event(words: Column, saying=SAYING, asking=ASKING, deictic=DEICTIC, stop=()) -> Column:
    """False for events of up to two words with a verb of saying, questions, deictic ones and those of stop words alone."""
    short = (F.size(words) <= 2) & among(words, saying)
    asked = F.coalesce(F.try_element_at(words, F.lit(1)).isin(*asking), F.lit(False))
    hollow = F.forall(words, lambda w: w.isin(*stop)) if stop else F.lit(False)
    return (F.size(words) > 0) & ~short & ~asked & ~among(words, deictic) & ~hollow


def clean_nodes(nodes: DataFrame) -> DataFrame:
    said = F.array_join("words", " ")
    return nodes.where(keep_event(F.col("words")) & ~has_url(said) & ~has_digit(said))


# Words for one person and for several, and the names that they get.
SINGULAR = ("i", "you", "he", "she", "someone", "guy", "man", "woman", "somebody")
PLURAL = ("they", "we")
PERSONS = ("PersonX", "PersonY", "PersonZ", "PersonA", "PersonB")
GROUPS = ("PeopleX", "PeopleY")


def _once(value: Column, use) -> Column:
    """``use(value)``, the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _renamed(words: Column, order: Column, names) -> Column:
    """Words that stand in ``order`` as the name of that place; those beyond the names stay."""
    named = F.array(*[F.lit(n) for n in names])
    at = lambda w: F.nullif(F.array_position(order, w), F.lit(0)).cast("int")
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(named, at(w)), w))


def _subject(words: Column) -> Column:
    return F.coalesce(F.get(words, 0).isin(*SINGULAR), F.lit(False))


def _singular(head: Column, tail: Column) -> Column:
    """Words for one person in order of appearance, the subjects of head and tail before all others if both are such words."""
    first = F.when(_subject(head) & _subject(tail), F.array(F.get(head, 0), F.get(tail, 0))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(first, F.filter(F.concat(head, tail), lambda w: w.isin(*SINGULAR))))


def name_persons(head: Column, tail: Column) -> Column:
    """``struct(head, tail)`` of word arrays: ``my`` is read as ``i``, one person becomes PersonX..., several PeopleX..., in
    order of appearance, but the two subjects first.  Persons beyond the names keep their words."""
    mine = lambda ws: F.transform(ws, lambda w: F.when(w == "my", F.lit("i")).otherwise(w))
    plural = lambda x: F.array_distinct(F.filter(F.concat(x["h"], x["t"]), lambda w: w.isin(*PLURAL)))
    orders = lambda x: F.struct(x["h"].alias("h"), x["t"].alias("t"), _singular(x["h"], x["t"]).alias("s"), plural(x).alias("p"))
    both = lambda x, ws: _renamed(_renamed(ws, x["s"], PERSONS), x["p"], GROUPS)
    named = lambda x: F.struct(both(x, x["h"]).alias("head"), both(x, x["t"]).alias("tail"))
    return _once(_once(F.struct(mine(head).alias("h"), mine(tail).alias("t")), orders), named)


def name_subjects(head: Column, tail: Column, names=PERSONS[:3]) -> Column:
    """``struct(head, tail)`` with up to three persons named, if the subject of either is a word for one person."""
    order = F.when(_subject(head) | _subject(tail), _singular(head, tail)).otherwise(F.array().cast("array<string>"))
    named = lambda o: F.struct(_renamed(head, o, names).alias("head"), _renamed(tail, o, names).alias("tail"))
    return _once(order, named)


# Which senses lead from a node to what holds beside it, to its causes and to its effects, as the head
# of an edge (out), as its tail (in), or as either (both).
DIRECTIONS = {
    "stative": {"out": (), "in": (), "both": ("Synchronous", "Reason", "Result", "Condition", "Conjunction", "Restatement", "Alternative")},
    "cause": {"out": ("Succession", "Condition", "Reason"), "in": ("Precedence", "Result"), "both": ("Synchronous", "Conjunction")},
    "effect": {"out": ("Precedence", "Result"), "in": ("Succession", "Condition", "Reason"), "both": ("Synchronous", "Conjunction")},
}


def by_direction(edges: DataFrame, kind: str) -> DataFrame:
    """``(eid, other, sense, weight)``: each edge from the node whose ``kind`` (of ``DIRECTIONS``) its other end is."""
    way = DIRECTIONS[kind]
    own = edges.where(F.col("sense").isin(*way["out"], *way["in"], *way["both"]))
    side = lambda name, a, b: F.when(F.col("sense").isin(*way[name], *way["both"]), F.struct(F.col(a).alias("eid"), F.col(b).alias("other")))
    ends = F.filter(F.array(side("out", "hid", "tid"), side("in", "tid", "hid")), lambda x: x.isNotNull())
    return own.select(F.explode(ends).alias("x"), "sense", "weight").select("x.*", "sense", "weight")


# Words of bracketed texts that name more persons, places or things than can be told apart.
UNUSABLE = (
    "&", "C", "D", "E", "F", "Someone_E", "Someone_F", "Someone_G", "People_D", "SomePeople_D", "People_E", "SomePeople_E", "People_F",
    "SomePeople_F", "Somewhere_C", "Somewhere_D", "Somewhere_E", "Somewhere_F", "Something_D", "Something_E", "Something_F",
)


def usable(text: Column) -> Column:
    """Whether no word of a bracketed text is among ``UNUSABLE``."""
    return ~among(F.split(bracketed_text(bracketed(text)), " "), UNUSABLE)


def regraph_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(words, frequency)`` of the nodes of ``regraph``: every end of an edge brings the frequency of its old node
    ``(words, frequency)``, once for its name and once for that with persons swapped."""
    named = edges.withColumn("p", name_persons(F.col("head"), F.col("tail")))
    ends = named.select(F.explode(F.array(F.struct(F.col("head").alias("words"), F.col("p.head").alias("named")), F.struct(F.col("tail").alias("words"), F.col("p.tail").alias("named")))).alias("x"))
    # Ends are counted before they meet their node, so a node of many edges is joined once a name.
    counted = ends.groupBy("x.words", "x.named").agg(F.count("*").alias("n")).join(nodes.select("words", "frequency"), "words")
    own = counted.select(F.explode(F.array("named", swap_persons(F.col("named")))).alias("w"), (F.col("n") * F.col("frequency")).alias("f"))
    return own.groupBy(F.array_join("w", " ").alias("words")).agg(F.sum("f").alias("frequency"))


def regraph(edges: DataFrame) -> DataFrame:
    """Edges of word arrays ``(head, tail, sense, weight)`` with persons named, each with its twin of swapped persons."""
    named = edges.withColumn("p", name_persons(F.col("head"), F.col("tail"))).select("p.head", "p.tail", "sense", "weight")
    twin = F.array(F.struct("head", "tail"), F.struct(swap_persons(F.col("head")).alias("head"), swap_persons(F.col("tail")).alias("tail")))
    both = named.select(F.explode(F.array_distinct(twin)).alias("e"), "sense", "weight")
    return both.groupBy(F.array_join("e.head", " ").alias("head"), F.array_join("e.tail", " ").alias("tail"), "sense").agg(F.sum("weight").alias("weight"))


def processed(nodes: DataFrame, edges: DataFrame, low: int = 5, high: int = 1000, top: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The whole treatment of a graph: nodes with few or very many edges go, then the ``top`` of highest degree, then those
    that are no events; of the edges that keep both ends come the nodes and edges with persons named."""
    from evkg.operators import graph

    kept = graph.degree_filter(nodes, edges, low, high).select(*nodes.columns)
    kept = clean_nodes(kept.join(graph.top_degree(edges, top).select("eid"), "eid", "left_anti").select(*nodes.columns))
    words = lambda c: kept.select(F.col("eid").alias(c), F.col("words").alias({"hid": "head", "tid": "tail"}[c]))
    rows = edges.join(words("hid"), "hid").join(words("tid"), "tid").select("head", "tail", "sense", "weight")
    freq = kept.groupBy("words").agg(F.sum("frequency").alias("frequency"))
    return regraph_nodes(rows, freq), regraph(rows)
