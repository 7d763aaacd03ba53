"""Statistics of graphs and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evkg.schema import SENSES


def per_pattern(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("pattern").agg(F.sum("frequency").alias("frequency"), F.count("*").alias("n"))


def per_dataset(occurrences: DataFrame) -> DataFrame:
    """Frequencies and distinct nodes by data set and pattern, and over all data sets as ``overall``."""
    each = occurrences.groupBy("dataset", "pattern", "eid").agg(F.sum("frequency").alias("f"))
    out = each.groupingSets([["dataset", "pattern"], ["pattern"]], "dataset", "pattern").agg(F.grouping("dataset").alias("g"), F.sum("f").alias("frequency"), F.count_distinct("eid").alias("n"))
    return out.select(F.when(F.col("g") == 1, F.lit("overall")).otherwise(F.col("dataset")).alias("dataset"), "pattern", "frequency", "n")


def major_senses(edges: DataFrame, senses=SENSES) -> DataFrame:
    """``(rid, sense)``: the heaviest sense, the last one only where there is no other; ties by sense order."""
    order = F.array_position(F.array(*[F.lit(s) for s in senses]), F.col("sense"))
    rank = F.struct((F.col("sense") != senses[-1]).alias("other"), F.col("weight"), (-order).alias("o"))
    return edges.groupBy("rid", "sense").agg(F.sum("weight").alias("weight")).groupBy("rid").agg(F.max_by("sense", rank).alias("sense"))


def per_sense(edges: DataFrame, senses=SENSES) -> DataFrame:
    """Weight, edges and edges of which it is the major sense, by sense, from one pass over the edges."""
    sums = edges.groupBy("rid", "sense").agg(F.sum("weight").alias("weight"))
    order = F.array_position(F.array(*[F.lit(s) for s in senses]), F.col("sense"))
    rank = F.struct((F.col("sense") != senses[-1]).alias("other"), F.col("weight"), (-order).alias("o"))
    major = F.col("sense") == F.max_by("sense", rank).over(Window.partitionBy("rid"))
    return sums.withColumn("major", major).groupBy("sense").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), F.count_if("major").alias("n_major"))


def sizes(texts: DataFrame, words: Column) -> DataFrame:
    """Rows and words by language."""
    return texts.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size(words)).cast("long").alias("n_tokens"))


def commonest(df: DataFrame, group: str, value: str) -> DataFrame:
    """The commonest value of each group, the smallest of several."""
    return df.groupBy(group).agg(F.mode(value, True).alias("common"))


def shares(df: DataFrame, group: Column, distinct: str, condition: Column) -> DataFrame:
    """Distinct values and the percentage of rows of a condition, by group ``k``."""
    share = F.lit(100.0) * F.count_if(condition) / F.count("*")
    return df.groupBy(group.alias("k")).agg(F.count_distinct(distinct).alias("parts"), share.alias("share"))


def vocabulary(words: DataFrame, top: int) -> DataFrame:
    """``(word, n, id)`` of the commonest words; ties by word."""
    best = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(top)
    listed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "word"))).alias("all"))  # ``top`` rows
    return listed.select(F.posexplode("all").alias("id", "x")).select("x.word", (-F.col("x.m")).alias("n"), "id")


def to_ids(tokens: DataFrame, vocab: DataFrame, unknown: int = -1) -> DataFrame:
    return tokens.join(vocab.select("word", "id"), "word", "left").fillna(unknown, ["id"])


def counters(triples: DataFrame, top: int) -> DataFrame:
    """``(kind, value, n)`` of the commonest events (either end), relations and whole triples of ``(head, sense, tail)``, ``top``
    of each kind; ties by value."""
    whole = F.concat_ws("$", "head", "sense", "tail")
    kinds = [("event", F.col("head")), ("event", F.col("tail")), ("relation", F.col("sense")), ("triple", whole)]
    each = triples.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds])).alias("x")).select("x.*")
    n = each.groupBy("kind", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("kind").orderBy(F.col("n").desc(), "value")
    return n.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")
