"""Small expressions and writers, values worked out by hand."""

from pyspark.sql import functions as F

from evkg.functions import text
from evkg.operators import post, relations, stats, trees
from evkg.sources import corpus


def test_sequences_and_maps(spark):
    row = spark.range(1).select(
        text.add_maps(F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(2.0)), F.create_map(F.lit("b"), F.lit(0.5), F.lit("c"), F.lit(4.0))).alias("sum"),
        text.positions(F.array(*map(F.lit, "abab")), F.lit("b")).alias("at"),
        text.positions(F.array(F.lit("x")), F.lit("b")).alias("nowhere"),
        text.pad(F.array(*map(F.lit, "abc")), 5, "-").alias("longer"),
        text.pad(F.array(*map(F.lit, "abc")), 2).alias("cut"),
        text.one_hot(F.array(F.lit(0), F.lit(3)), 5).alias("hot"),
        text.bits_to_senses(F.lit("0101"), ("Reason", "Result", "Contrast", "Condition")).alias("senses"),
        text.bits_to_senses(F.lit("000"), ("Reason", "Result", "Contrast")).alias("none"),
    ).first()
    assert row["sum"] == {"a": 1.0, "b": 2.5, "c": 4.0} and row["at"] == [1, 3] and row["nowhere"] == []
    assert row["longer"] == ["a", "b", "c", "-", "-"] and row["cut"] == ["a", "b"] and row["hot"] == [1, 0, 0, 1, 0]
    assert row["senses"] == ["Result", "Condition"] and row["none"] == []


def test_major_senses_and_ids(spark):
    edges = [("r1", "Co_Occurrence", 9.0), ("r1", "Result", 1.0), ("r2", "Co_Occurrence", 1.0), ("r3", "Result", 2.0), ("r3", "Reason", 1.5), ("r3", "Reason", 0.5), ("r4", "Reason", 1.0), ("r4", "Contrast", 3.0)]
    got = stats.major_senses(spark.createDataFrame(edges, "rid string, sense string, weight double"))
    assert {r["rid"]: r["sense"] for r in got.collect()} == {"r1": "Result", "r2": "Co_Occurrence", "r3": "Reason", "r4": "Contrast"}
    vocab = spark.createDataFrame([("go", 0), ("we", 1)], "word string, id int")
    told = stats.to_ids(spark.createDataFrame([("we",), ("go",), ("they",), (None,)], "word string"), vocab)
    assert sorted(((r["word"] or ""), r["id"]) for r in told.collect()) == [("", -1), ("go", 0), ("they", -1), ("we", 1)]


def test_shrunk_edges(spark):
    rows = [([(1, "nsubj", 0), (1, "advcl", 4), (4, "mark", 2), (4, "nsubj", 3)], [0, 1], [3, 4]), ([(1, "nsubj", 0)], [0, 1], [1])]
    df = spark.createDataFrame(rows, "edges array<struct<gov:int,dep:string,dpt:int>>, head array<int>, tail array<int>")
    got = [r[0] for r in df.select(relations.shrink(F.col("edges"), F.col("head"), F.col("tail"))).collect()]
    assert [tuple(e) for e in got[0]] == [("_H_", "advcl", "_T_"), ("_T_", "mark", "2")] and got[1] is None


def test_clean_nodes(spark):
    nodes = [["we", "sell", "bread"], ["we", "sell", "2", "bread"], ["we", "see", "www.bread.com"]]
    got = post.clean_nodes(spark.createDataFrame([(w,) for w in nodes], "words array<string>"))
    assert [r["words"] for r in got.collect()] == nodes[:1]


def test_entity_type():
    assert trees.entity_type("CITY") == "CITY" and trees.entity_type({"O": 9, "PERSON": 2, "CITY": 1}) == "PERSON"
    assert trees.entity_type({"O": 3}) == trees.entity_type({}) == "O"


def test_written_tables(spark, tmp_path):
    rows = [("food", "bread", 10), ("product", "bread", 1)]
    taxonomy = spark.createDataFrame(rows, corpus.TAXONOMY)
    corpus.write_taxonomy(taxonomy, str(tmp_path / "t"))
    assert sorted(map(tuple, corpus.read_saved_taxonomy(spark, str(tmp_path / "t")).collect())) == rows
    corpus.write_scores(spark.createDataFrame([("a", 1.005), ("b", 2.0)], "eid string, score double").coalesce(1), "eid", "score", str(tmp_path / "s"))
    assert sorted(line for f in (tmp_path / "s").glob("*.csv") for line in f.read_text().splitlines())[1] == "b\t2.00"
    docs = spark.createDataFrame([("d", 2, "y"), ("d", 1, "x"), ("e", 5, "z")], "doc string, place int, text string")
    assert sorted((r["text"], r["sent_idx"]) for r in corpus.with_order(docs, "place").collect()) == [("x", 0), ("y", 1), ("z", 0)]
