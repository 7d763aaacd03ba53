"""Incremental building: a stream of occurrences, edges or parsed documents, summed into tables by batches.

A table of sums has a folder a batch, named by its number, and at most one base, the sums of all batches up to a number.
What is read is the newest base that is complete and the batches after it, so a replayed batch replaces itself or is left
out, and a run that breaks off in the middle of compaction loses and doubles nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evkg.schema import CONNECTIVES

#: Batches after which they are merged into the base.
MOST_BATCHES = 50


def _folders(spark: SparkSession, path: str, name: str) -> dict[int, str]:
    """Complete folders ``name=<number>`` of a folder, by number."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return {}
    found = (s.getPath() for s in fs.listStatus(at))
    told = ((re.fullmatch(rf"{name}=(\d+)", p.getName()), p) for p in found)
    return {int(m[1]): p.toString() for m, p in told if m and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}


def _remove(spark: SparkSession, paths) -> None:
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _add(batch: DataFrame, keys: list[str], value: str, path: str, no: int, most: int) -> None:
    spark = batch.sparkSession
    batch.groupBy(*keys).agg(F.sum(value).alias(value)).write.mode("overwrite").parquet(f"{path}/batch={no}")
    if len(_folders(spark, path, "batch")) > most:
        compact(spark, path, keys, value)


def write_sums(stream: DataFrame, keys: list[str], value: str, path: str, checkpoint: str, most: int = MOST_BATCHES):
    """Each micro-batch adds its own sums as one folder; more than ``most`` are merged."""
    return stream.writeStream.foreachBatch(lambda batch, no: _add(batch, keys, value, path, no, most)).option("checkpointLocation", checkpoint)


def _current(spark: SparkSession, path: str) -> tuple[int, list[str], dict[int, str]]:
    """Number of the newest base, the folders that count, and all batches."""
    bases, batches = _folders(spark, f"{path}/base", "upto"), _folders(spark, path, "batch")
    upto = max(bases, default=-1)
    return upto, ([bases[upto]] if bases else []) + [p for no, p in sorted(batches.items()) if no > upto], batches


def read_sums(spark: SparkSession, path: str, keys: list[str], value: str) -> DataFrame:
    """The sums of all batches."""
    return spark.read.parquet(*_current(spark, path)[1]).groupBy(*keys).agg(F.sum(value).alias(value))


def compact(spark: SparkSession, path: str, keys: list[str], value: str) -> None:
    """Merges the base and all batches into a new base; then what it was made of goes."""
    upto, _, batches = _current(spark, path)
    last = max(batches, default=-1)
    if last > upto:
        read_sums(spark, path, keys, value).write.mode("overwrite").parquet(f"{path}/base/upto={last}")
    _remove(spark, [p for no, p in batches.items() if no <= last] + [p for no, p in _folders(spark, f"{path}/base", "upto").items() if no < last])


NODE_KEYS, EDGE_KEYS = ["eid", "said", "pattern"], ["hid", "tid", "sense"]


def write_graph(sentences: DataFrame, path: str, checkpoint: str, lexicon=CONNECTIVES, clause_split: bool = False, most: int = MOST_BATCHES):
    """A stream of parsed sentences into sums of nodes and edges.  A document must come whole in one batch, as it does from
    files that hold whole documents, so that neighbouring sentences meet."""
    from evkg.operators import extract
    from evkg.plans import facade

    def one(batch: DataFrame, no: int) -> None:
        batch = batch.persist()  # read and extracted once for both tables
        found = extract.extract(batch, clause_split).persist()
        _add(found.select("eid", F.array_join("words", " ").alias("said"), "pattern", F.lit(1.0).alias("frequency")), NODE_KEYS, "frequency", f"{path}/nodes", no, most)
        _add(facade.relations_of(batch, found, lexicon), EDGE_KEYS, "weight", f"{path}/edges", no, most)
        found.unpersist()
        batch.unpersist()

    return sentences.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(eid, said, pattern, frequency)`` and edges ``(rid, hid, tid, sense, weight)`` of what has been streamed."""
    from evkg.operators import graph

    sums = read_sums(spark, f"{path}/nodes", NODE_KEYS, "frequency")
    nodes = sums.groupBy("eid", "said").agg(F.min("pattern").alias("pattern"), F.sum("frequency").alias("frequency"))
    return nodes, graph.merge_edges(read_sums(spark, f"{path}/edges", EDGE_KEYS, "weight"))
