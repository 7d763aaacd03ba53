"""From parsed sentences to the full graph, the core graph and the graph of concepts.

Each step is written as Parquet below one folder and read again by the next, so rules run once over the
corpus and a lost executor repeats no more than its step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evkg.operators import concepts, extract, graph
from evkg.plans import facade
from evkg.schema import CONNECTIVES


def type_counts(occurrences: DataFrame) -> DataFrame:
    """``(eid, at, ner, n)``: how often each word of a node had each entity type; verbs have none."""
    each = occurrences.select("eid", "pos_tags", F.posexplode("ners").alias("at", "ner"), "frequency")
    each = each.withColumn("ner", F.when(F.startswith(F.col("pos_tags")[F.col("at")], F.lit("VB")), "O").otherwise(F.col("ner")))
    return each.groupBy("eid", "at", "ner").agg(F.sum("frequency").alias("n"))


def entity_types(occurrences: DataFrame) -> DataFrame:
    """``(eid, ners)``: for each word of a node its most frequent entity type other than O."""
    seen = type_counts(occurrences)
    rank = F.struct(F.when(F.col("ner") != "O", F.col("n")).otherwise(F.lit(0.0)), F.col("ner"))
    best = seen.groupBy("eid", "at").agg(F.max_by("ner", rank).alias("ner"))
    return best.groupBy("eid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ner"))), lambda x: x["ner"]).alias("ners"))


def nodes_of(occurrences: DataFrame) -> DataFrame:
    """Nodes with the sum of frequencies; all but the pattern follows from the id."""
    same = [F.any_value(c).alias(c) for c in ("words", "pos_tags", "verbs", "skeleton_words", "skeleton_pos", "phrases", "skeleton_phrases", "phrase_at", "skeleton_at", "phrase_pos", "skeleton_phrase_pos", "dependencies", "skeleton_dependencies")]
    # Of its mentions a node keeps those of one occurrence, the one with most of them.
    told = F.max_by("mentions", F.struct(F.size("mentions"), "sid")).alias("mentions")
    out = occurrences.groupBy("eid").agg(F.sum("frequency").alias("frequency"), F.min("pattern").alias("pattern"), told, *same)
    out = out.join(entity_types(occurrences), "eid")
    typed = lambda at: F.transform(at, lambda i: F.get("ners", i))
    return out.withColumn("phrase_ners", typed("phrase_at")).withColumn("skeleton_ners", typed("skeleton_at"))


def build(sentences: DataFrame, taxonomy: DataFrame, out: str, least_node: float = 2.0, least_edge: float = 2.0, least_concept: float = 5.0, k: int = 3, lexicon=CONNECTIVES, clause_split: bool = False) -> dict[str, DataFrame]:
    """All tables by name; core nodes and edges reach their least weight, concepts theirs over the core graph."""
    spark = sentences.sparkSession
    tables: dict[str, DataFrame] = {}

    def step(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        tables[name] = spark.read.parquet(f"{out}/{name}")
        return tables[name]

    occurrences = step("occurrences", extract.extract(sentences, clause_split).withColumn("frequency", F.lit(1.0)))
    found = step("relation_occurrences", facade.relations_of(sentences, occurrences, lexicon))
    # Long tables in order of their key, so that a look-up reads few row groups and no node gathers its sentences in a row.
    step("node_sources", occurrences.select("eid", "sid").distinct().sortWithinPartitions("eid", "sid"))
    step("edge_sources", graph.edge_sources(found).sortWithinPartitions("rid", "head_sid"))
    nodes = step("nodes", nodes_of(occurrences))
    edges = step("edges", graph.merge_edges(found))
    core = step("core_nodes", graph.core_nodes(nodes, least_node))
    core_edges = step("core_edges", graph.core_edges(edges, core, least_edge))
    pairs = step("concept_pairs", concepts.conceptualize(core, taxonomy, k))
    weights = concepts.concept_weights(pairs, core).where(F.col("weight") >= least_concept)
    names = pairs.groupBy("cid").agg(F.any_value("words").alias("words"), F.min("pattern").alias("pattern"))
    kept = step("concepts", names.join(weights, "cid"))
    step("concept_edges", concepts.concept_edges(core_edges, pairs.join(kept, "cid", "left_semi")))
    return tables
