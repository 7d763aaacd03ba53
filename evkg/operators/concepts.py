"""Taxonomy scores, conceptualization and the concept graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evkg.functions.ids import cid, pid, rid
from evkg.schema import CONCEPT_TYPES, PERSON_WORDS


def scores(taxonomy: DataFrame, method: str = "likelihood") -> DataFrame:
    """``(concept, instance, freq, score)``: n(c,i)/n(i), or with ``pmi`` n(c,i)/n(c)/n(i)."""
    of = lambda c: taxonomy.groupBy(c).agg(F.sum("freq").alias(f"_{c}"))
    out = taxonomy.groupBy("concept", "instance").agg(F.sum("freq").alias("freq")).join(of("instance"), "instance")
    score = F.col("freq") / F.col("_instance")
    if method == "pmi":
        out, score = out.join(of("concept"), "concept"), F.col("freq") / F.col("_concept") / F.col("_instance")
    return out.select("concept", "instance", "freq", score.alias("score"))


def top_concepts(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best concepts of each instance, blanks as hyphens; ties by name."""
    named = scored.withColumn("concept", F.replace("concept", F.lit(" "), F.lit("-"))).groupBy("instance", "concept").agg(F.max("score").alias("score"))
    w = Window.partitionBy("instance").orderBy(F.col("score").desc(), "concept")
    return named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def chain(scored: DataFrame, starts: DataFrame, length: int = 5) -> DataFrame:
    """``(instance, step, concept)``: the best concept again and again, up to ``length`` steps."""
    best = top_concepts(scored, 1).select(F.col("instance").alias("_at"), F.col("concept").alias("_to"))
    now = starts.select("instance", F.col("instance").alias("at"))
    out = None
    for step in range(1, length + 1):
        now = now.join(best, F.col("at") == F.col("_at")).select("instance", F.col("_to").alias("at"))
        part = now.select("instance", F.lit(step).alias("step"), F.col("at").alias("concept"))
        out = part if out is None else out.union(part)
    return out


def seed_form(words, ners):
    """Words or phrases with entity types and persons replaced by ``__TYPE__k``; k counts the distinct ones of a type in order."""
    kind = F.transform(
        F.arrays_zip(words.alias("w"), ners.alias("n")),
        lambda x: F.struct(x["w"].alias("w"), F.when(x["n"].isin(*CONCEPT_TYPES), x["n"]).when(x["w"].isin(*PERSON_WORDS), F.lit("PERSON")).alias("t")),
    )
    seen = F.array_distinct(F.filter(kind, lambda x: x["t"].isNotNull()))
    no = lambda x: F.array_position(F.transform(F.filter(seen, lambda y: y["t"] == x["t"]), lambda y: y["w"]), x["w"]) - 1
    return F.transform(kind, lambda x: F.when(x["t"].isNotNull(), F.concat(F.lit("__"), x["t"], F.lit("__"), no(x).cast("string"))).otherwise(x["w"]))


def is_seed(word):
    """Whether a word is the bare name of a type."""
    return word.isin(*[f"__{t}__" for t in CONCEPT_TYPES])


def is_pronoun(word):
    return word.isin(*PERSON_WORDS, "it")


def seed_concepts(nodes: DataFrame) -> DataFrame:
    """One concept of each node ``(eid, pattern, phrases, phrase_ners)``: its phrases in seed form, with score 1."""
    out = nodes.withColumn("w", seed_form(F.col("phrases"), F.col("phrase_ners")))
    return out.select(pid(cid("w"), "eid").alias("pid"), cid("w").alias("cid"), "eid", "pattern", F.col("w").alias("words"), F.lit(1.0).alias("score"))


def conceptualize(nodes: DataFrame, taxonomy: DataFrame, k: int = 3, method: str = "likelihood") -> DataFrame:
    """Concept-instance pairs of nodes ``(eid, pattern, skeleton_phrases, skeleton_pos, skeleton_ners)``.

    The seed form of the skeleton's phrases first; then each non-empty choice of its nouns is replaced by each of
    the noun's ``k`` best concepts, all occurrences of a noun together, with the product of the scores; the ``k ** k``
    best forms stay, and no more are held at any step: a form is never better than the one it was made of.  A node without a known
    noun keeps its seed form with score 1.
    """
    formed = nodes.withColumn("form", seed_form(F.col("skeleton_phrases"), F.col("skeleton_ners")))
    noun = lambda x: F.startswith(x["t"], F.lit("NN")) & ~is_seed(x["f"]) & ~is_pronoun(x["f"])
    nouns = F.array_distinct(F.transform(F.filter(F.arrays_zip(F.col("form").alias("f"), F.col("skeleton_pos").alias("t")), noun), lambda x: x["f"]))
    top = top_concepts(scores(taxonomy, method), k).groupBy("instance").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("concept").alias("c")))).alias("options"))
    each = formed.select("eid", F.posexplode(nouns).alias("at", "instance")).join(top, "instance")
    of = each.groupBy("eid").agg(F.array_sort(F.collect_list(F.struct("at", "instance", "options"))).alias("nouns"))
    start = F.array(F.struct(F.lit(0).alias("n"), F.lit(1.0).alias("s"), F.col("form").alias("w")))
    best = lambda forms: F.slice(F.reverse(F.array_sort(F.filter(forms, lambda f: f["n"] > 0))), 1, k**k)

    def replaced(forms, noun):
        new = lambda f, o: F.struct(F.lit(1).alias("n"), (f["s"] * -o["s"]).alias("s"), F.transform(f["w"], lambda x: F.when(x == noun["instance"], o["c"]).otherwise(x)).alias("w"))
        more = F.flatten(F.transform(noun["options"], lambda o: F.transform(forms, lambda f: new(f, o))))
        return F.concat(F.filter(forms, lambda f: f["n"] == 0), best(F.concat(forms, more)))

    joined = formed.join(of, "eid", "left")
    forms = F.when(F.col("nouns").isNull(), start).otherwise(F.filter(F.aggregate("nouns", start, replaced), lambda f: f["n"] > 0))
    out = joined.select("eid", "pattern", F.explode(forms).alias("f")).select(cid("f.w").alias("cid"), "eid", "pattern", F.col("f.w").alias("words"), F.col("f.s").alias("score"))
    return out.groupBy(pid("cid", "eid").alias("pid"), "cid", "eid", "words").agg(F.mode("pattern", True).alias("pattern"), F.sum("score").alias("score"))


def instantiate(pairs: DataFrame, nodes: DataFrame, cids: DataFrame) -> DataFrame:
    """The nodes behind concepts: ``(cid, score)`` and the columns of each node."""
    return pairs.join(cids.select("cid").distinct(), "cid", "left_semi").select("cid", "eid", "score").join(nodes, "eid")


def instances(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(cid, n)``: how many nodes of the graph each concept has."""
    return pairs.join(nodes.select("eid"), "eid", "left_semi").groupBy("cid").agg(F.count_distinct("eid").alias("n"))


def sizes(taxonomy: DataFrame) -> DataFrame:
    """Distinct concepts and instances, and the sum of frequencies."""
    return taxonomy.agg(F.count_distinct("concept").alias("concepts"), F.count_distinct("instance").alias("instances"), F.sum("freq").alias("freq"))


def concept_weights(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(cid, weight)``: scores times node frequencies."""
    return pairs.join(nodes.select("eid", "frequency"), "eid").groupBy("cid").agg(F.sum(F.col("score") * F.col("frequency")).alias("weight"))


def concept_edges(edges: DataFrame, pairs: DataFrame, least: float | None = None) -> DataFrame:
    """Edges between concepts: weight times both scores, summed; an edge to the same concept is dropped."""
    h = pairs.select(F.col("eid").alias("hid"), F.col("cid").alias("h_cid"), F.col("score").alias("hs"))
    t = pairs.select(F.col("eid").alias("tid"), F.col("cid").alias("t_cid"), F.col("score").alias("ts"))
    out = edges.select("hid", "tid", "sense", "weight").join(h, "hid").join(t, "tid").where("h_cid <> t_cid")
    out = out.groupBy(rid("h_cid", "t_cid").alias("rid"), F.col("h_cid").alias("hid"), F.col("t_cid").alias("tid"), "sense").agg(F.sum(F.col("weight") * F.col("hs") * F.col("ts")).alias("weight"))
    return out.where(F.col("weight") >= least) if least is not None else out


def explain(edges: DataFrame, pairs: DataFrame, head: str, tail: str, sense: str) -> DataFrame:
    """The node edges behind a concept edge."""
    h = pairs.where(F.col("cid") == head).select(F.col("eid").alias("hid"))
    t = pairs.where(F.col("cid") == tail).select(F.col("eid").alias("tid"))
    return edges.where(F.col("sense") == sense).join(h, "hid", "left_semi").join(t, "tid", "left_semi")


def sweep(weights: DataFrame, edges: DataFrame, thresholds) -> DataFrame:
    """Concepts ``(cid, weight)`` and edges between them that remain at each least weight, in one pass over either table."""
    from evkg.operators import graph

    return graph.sweep(weights.select(F.col("cid").alias("eid"), F.col("weight").alias("frequency")), edges, thresholds)
