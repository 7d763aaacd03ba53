"""A stream of parsed documents against the batch build; batches are merged, replays count once."""

import os

from pyspark.sql import functions as F

from evkg.operators import extract, graph
from evkg.plans import facade
from evkg.streaming import upsert

SHAPE = "sid string, doc string, sent_idx int, tokens array<string>, lemmas array<string>, pos_tags array<string>, dependencies array<struct<gov:int,dep:string,dpt:int>>"


def parsed(doc):
    texts = (("he left", "PRP VBD", [(1, "nsubj", 0)]), ("thus she wins", "RB PRP VBZ", [(2, "nsubj", 1)]), ("we go , they stay", "PRP VBP , PRP VBP", [(1, "nsubj", 0), (1, "parataxis", 4), (4, "nsubj", 3)]))
    return [(f"{doc}|{i}", doc, i, t.split(), t.split(), p.split(), e) for i, (t, p, e) in enumerate(texts[: 2 + len(doc) % 2])]


def test_streamed_graph(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    every = []

    def run():
        stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(src)
        q = upsert.write_graph(stream, out, str(tmp_path / "cp"), most=1).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    for docs in (["a", "bb"], ["ccc"]):
        rows = [s for d in docs for s in parsed(d)]
        every += rows
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(src)
    run()  # a batch a file
    nodes, edges = upsert.read_graph(spark, out)
    sents = spark.createDataFrame(every, SHAPE)
    occ = extract.extract(sents)
    want = occ.groupBy("eid", F.array_join("words", " ").alias("said")).agg(F.min("pattern").alias("pattern"), F.count("*").cast("double").alias("frequency"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(nodes) == key(want) and key(edges) == key(graph.merge_edges(facade.relations_of(sents, occ)))
    for name in ("nodes", "edges"):  # both batches were merged
        folders = os.listdir(f"{out}/{name}")
        assert sum(f.startswith("batch=") for f in folders) <= 1 and len([f for f in os.listdir(f"{out}/{name}/base") if f.startswith("upto=")]) == 1


def test_replays_and_broken_compaction(spark, tmp_path):
    path, keys = str(tmp_path), ["k"]
    rows = lambda *x: spark.createDataFrame(x, "k string, v double")
    read = lambda: sorted(map(tuple, upsert.read_sums(spark, path, keys, "v").collect()))
    upsert._add(rows(("a", 1.0), ("b", 1.0)), keys, "v", path, 0, 9)
    upsert._add(rows(("a", 2.0)), keys, "v", path, 1, 9)
    upsert._add(rows(("a", 2.0)), keys, "v", path, 1, 9)  # again
    assert read() == [("a", 3.0), ("b", 1.0)]
    upsert.compact(spark, path, keys, "v")
    assert read() == [("a", 3.0), ("b", 1.0)] and not [f for f in os.listdir(path) if f.startswith("batch=")]
    upsert._add(rows(("a", 2.0)), keys, "v", path, 1, 9)  # a batch of the base comes again
    assert read() == [("a", 3.0), ("b", 1.0)]
    upsert._add(rows(("b", 5.0)), keys, "v", path, 2, 9)
    os.makedirs(f"{path}/base/upto=2")  # broken off: without the mark of a whole write
    assert read() == [("a", 3.0), ("b", 6.0)]
    upsert.compact(spark, path, keys, "v")
    upsert.compact(spark, path, keys, "v")
    assert read() == [("a", 3.0), ("b", 6.0)]
