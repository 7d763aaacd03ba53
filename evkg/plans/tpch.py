"""The graph that the test tables hold: orders as sentences, line items as occurrences, brands as nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evkg.operators import graph

#: Return flag and line status of the head as the sense of a pair.
SENSE_OF = {"AF": "Precedence", "RF": "Contrast", "NF": "Result", "NO": "Reason"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sent, pos, eid, words, pattern, frequency, flag)``; parts are joined by the line items' key."""
    # Names are hashed once a part, before the join.
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.sha1("p_brand").alias("eid"))
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("flag"))
    out = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return out.select(F.col("l_orderkey").alias("sent"), F.col("l_linenumber").alias("pos"), "eid", F.col("p_brand").alias("words"), F.col("p_type").alias("pattern"), F.lit(1.0).alias("frequency"), "flag")


def nodes(spark, sf_dir) -> DataFrame:
    return graph.merge_nodes(occurrences(spark, sf_dir))


def sense():
    out = F.lit("Co_Occurrence")
    for flag, name in SENSE_OF.items():
        out = F.when(F.col("flag") == flag, F.lit(name)).otherwise(out)
    return out


def raw_edges(spark, sf_dir) -> DataFrame:
    return graph.cooccurrence(occurrences(spark, sf_dir), sense())


def edges(spark, sf_dir) -> DataFrame:
    """Pairs meet and add up by name; the ids are made of the sums."""
    named = occurrences(spark, sf_dir).withColumn("eid", F.col("words"))
    sums = graph.cooccurrence(named, sense()).groupBy("hid", "tid", "sense").agg(F.sum("weight").alias("weight"))
    return graph.merge_edges(sums.withColumn("hid", F.sha1("hid")).withColumn("tid", F.sha1("tid")))


def sentences(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("sent"), "o_orderdate")


def taxonomy(spark, sf_dir) -> DataFrame:
    """``(concept, instance, freq)``: part types of brands."""
    return load(spark, sf_dir, "part").groupBy(F.col("p_type").alias("concept"), F.col("p_brand").alias("instance")).agg(F.count("*").alias("freq"))


def pairs(spark, sf_dir) -> DataFrame:
    """Concept-instance pairs of brands: their two best part types."""
    from evkg.operators import concepts

    top = concepts.top_concepts(concepts.scores(taxonomy(spark, sf_dir)), 2)
    c, e = F.sha1("concept"), F.sha1("instance")
    return top.select(F.sha1(F.concat_ws("$", c, e)).alias("pid"), c.alias("cid"), e.alias("eid"), "concept", "score")


#: DuckDB text of the same views.
SQL = """
occ AS (SELECT l_orderkey AS sent, l_linenumber AS pos, sha1(p_brand) AS eid, p_brand AS words, p_type AS pattern, 1.0::DOUBLE AS frequency, l_returnflag || l_linestatus AS flag
        FROM lineitem JOIN part ON l_partkey = p_partkey),
nodes AS (SELECT eid, words, sum(frequency) AS frequency, min(pattern) AS pattern FROM occ GROUP BY eid, words),
raw AS (SELECT h.eid AS hid, t.eid AS tid, CASE h.flag WHEN 'AF' THEN 'Precedence' WHEN 'RF' THEN 'Contrast' WHEN 'NF' THEN 'Result' WHEN 'NO' THEN 'Reason' ELSE 'Co_Occurrence' END AS sense, 1.0::DOUBLE AS weight, h.sent
        FROM occ h JOIN occ t ON h.sent = t.sent AND h.pos < t.pos),
edges AS (SELECT sha1(hid || '$' || tid) AS rid, hid, tid, sense, sum(weight) AS weight FROM raw GROUP BY ALL),
tot AS (SELECT rid, hid, tid, sum(weight) AS total FROM edges GROUP BY ALL),
tax AS (SELECT p_type AS concept, p_brand AS instance, count(*) AS freq FROM part GROUP BY ALL),
score AS (SELECT *, freq / sum(freq) OVER (PARTITION BY instance) AS score, sum(freq) OVER (PARTITION BY concept) AS nc, sum(freq) OVER (PARTITION BY instance) AS ni FROM tax),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY score DESC, replace(concept, ' ', '-')) AS rank FROM score) WHERE rank <= 2),
pairs AS (SELECT sha1(sha1(replace(concept, ' ', '-')) || '$' || sha1(instance)) AS pid, sha1(replace(concept, ' ', '-')) AS cid, sha1(instance) AS eid, replace(concept, ' ', '-') AS concept, score FROM top)
"""
