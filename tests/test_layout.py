"""The stored layout: results of the plain look-ups, stored sides without an exchange, files of few buckets."""

import re

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from evkg.operators import lookup
from evkg.sources import layout


def _plan(df):
    """The physical plan as text, operator after operator."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _buckets(find):
    """``(selected, all)`` buckets of a plan's scans; plans tell them only of scans that keep the buckets apart."""
    auto = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    spark = SparkSession.getActiveSession()
    spark.conf.set(auto, "false")
    try:
        return [(int(a), int(b)) for a, b in re.findall(r"SelectedBucketsCount: (\d+) out of (\d+)", _plan(find()))]
    finally:
        spark.conf.unset(auto)


@pytest.fixture
def graph(spark):
    """Nodes of words, and edges of which a hub holds a third; one edge has no head, one is there twice."""
    node = lambda c: F.concat(F.lit("n"), c % 200)
    nodes = spark.range(200).select(node(F.col("id")).alias("eid"), F.array(F.lit("go"), (F.col("id") % 7).cast("string")).alias("words"), F.col("id").cast("double").alias("frequency"))
    i = F.col("id")
    edges = spark.range(3000).select(F.concat(F.lit("r"), i).alias("rid"), F.when(i % 3 == 0, F.lit("n0")).otherwise(node(i * 7)).alias("hid"), node(i * 11 + 1).alias("tid"), F.when(i % 2 == 0, "Result").otherwise("Reason").alias("sense"), (i % 5 + 1).cast("double").alias("weight"))
    odd = spark.createDataFrame([("x", None, "n1", "Result", 1.0), ("r5", "n35", "n56", "Reason", 1.0)], edges.schema)
    return nodes, edges.unionByName(odd)


def test_layout(spark, tmp_path, graph):
    nodes, edges = graph
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    kg = layout.write(nodes, edges, str(tmp_path / "kg"), "kg_test", buckets=16, spread=4)
    try:
        rows = lambda df: sorted(map(str, df.collect()))
        assert kg.nodes().count() == 200 and rows(kg.edges()) == rows(edges)
        ids = spark.createDataFrame([(0, "n3"), (1, "none"), (2, "n3"), (3, "n0"), (4, None)], "ord int, eid string")
        got = kg.multi_get(ids)
        assert got.collect() == lookup.multi_get(nodes, ids, "eid").collect()
        assert _plan(got).count("Exchange hashpartitioning") == 1  # the ids
        for way in (True, False):
            assert rows(kg.neighbours(ids, ["Result"], way)) == rows(lookup.neighbours(edges, ids, ["Result"], way))
            found = kg.edges_of_many(ids, way)
            assert _plan(found).count("Exchange hashpartitioning") == 1
            own = "hid" if way else "tid"
            assert rows(found) == rows(edges.where(F.col(own).isin("n0", "n3")))
            assert rows(kg.edges_of("n0", way)) == rows(edges.where(F.col(own) == "n0"))
            seen = _buckets(lambda: kg.edges_of("n0", way))  # noqa: B023
            assert len(seen) == 1 and seen[0][0] <= 4 and seen[0][1] == 16
        one = kg.by_grain("words", ["go", "3"])
        assert rows(one) == rows(nodes.where(F.col("words") == F.array(F.lit("go"), F.lit("3")))) and _buckets(lambda: kg.by_grain("words", ["go", "3"])) == [(1, 16)]
        assert kg.related("n0", True).collect() == lookup.related(nodes, edges, "n0", True).select(kg.related("n0").columns).collect()
        assert kg.edges_of("none").count() == kg.by_grain("words", "none").count() == 0
        # no bucket holds the hub: its edges are dealt over several
        per = kg.table("edges_hid").where("hid = 'n0'").groupBy("end").count().collect()
        assert len(per) == 4 and max(r["count"] for r in per) < 500
        # a later session finds the same tables by their folder
        kg.drop()
        again = layout.Layout(spark, str(tmp_path / "kg"))
        assert (again.buckets, again.spread, again.grains) == (16, 4, ["words"]) and rows(again.edges()) == rows(edges)
        assert _plan(again.multi_get(ids)).count("Exchange hashpartitioning") == 1
        with pytest.raises(ValueError):
            again.by_grain("verbs", "go")
        with pytest.raises(ValueError):
            layout.write(nodes, edges, str(tmp_path / "other"), "a b")
        again.drop()
        empty = layout.write(nodes.where("false"), edges.where("false"), str(tmp_path / "none"), "kg_test", buckets=4)
        assert empty.multi_get(ids).count() == 5 and empty.edges_of("n0").count() == 0
        empty.drop()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
