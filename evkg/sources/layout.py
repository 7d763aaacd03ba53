"""A graph's tables stored for its look-ups: files bucketed and sorted by the columns that are looked up.

``nodes`` are kept by id, and once more for each grain (a column of words, joined to one text) by that grain; edges are
kept twice, by head and by tail.  A hub may hold a third of all edges, so the key of an edge is its node's id with one of
``spread`` numbers of its other end: a hub's edges lie in that many buckets, and a look-up asks for all of them.

A look-up by constants opens only the files of its buckets.  A look-up by a table of ids shuffles the ids alone, to the
buckets that are there.  The entry ``layout`` is written last, so that a folder of a broken write is not opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from evkg.operators import lookup

#: Buckets of each table, and buckets over which the edges of one node are dealt; more for more data.
BUCKETS, SPREAD = 64, 8


def _text(df: DataFrame, column: str) -> Column:
    return F.concat_ws(" ", column) if isinstance(df.schema[column].dataType, ArrayType) else F.col(column)


def _deal(own: str, other: str, spread: int) -> Column:
    return F.concat_ws("|", F.col(own), F.pmod(F.xxhash64(other), F.lit(spread)))


def _store(df: DataFrame, path: str, table: str, key: str, buckets: int) -> None:
    """One file a bucket: rows are dealt by the hash that buckets them."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS `{table}`")
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", f"{path}/{table}").bucketBy(buckets, key).sortBy(key).saveAsTable(f"`{table}`")


def write(nodes: DataFrame, edges: DataFrame, path: str, name: str = "kg", grains=("words",), buckets: int = BUCKETS, spread: int = SPREAD) -> Layout:
    """Stores ``nodes`` (with ``eid``) and ``edges`` (with ``hid``, ``tid``) below ``path``, as tables that begin with ``name``.
    Null keys are kept in a bucket of their own and found by no look-up."""
    spark, path = nodes.sparkSession, path.rstrip("/")
    if not name.isidentifier():
        raise ValueError(f"{name!r} is no name of tables")
    _store(nodes, path, f"{name}_nodes", "eid", buckets)
    for g in grains:
        _store(nodes.withColumn("grain", _text(nodes, g)), path, f"{name}_nodes_{g}", "grain", buckets)
    for own, other in (("hid", "tid"), ("tid", "hid")):
        key = F.when(F.col(own).isNotNull(), _deal(own, other, spread))
        _store(edges.withColumn("end", key), path, f"{name}_edges_{own}", "end", buckets)
    entry = spark.createDataFrame([(name, list(grains), buckets, spread)], "name string, grains array<string>, buckets int, spread int")
    entry.coalesce(1).write.mode("overwrite").json(f"{path}/layout")
    return Layout(spark, path)


class Layout:
    """Look-ups over stored tables, which are entered in the session's catalog where they are not yet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        entry = spark.read.schema("name string, grains array<string>, buckets int, spread int").json(f"{self.path}/layout").first()
        self.name, self.grains, self.buckets, self.spread = entry["name"], entry["grains"], entry["buckets"], entry["spread"]
        for table, key in [("nodes", "eid"), *[(f"nodes_{g}", "grain") for g in self.grains], ("edges_hid", "end"), ("edges_tid", "end")]:
            self._enter(f"{self.name}_{table}", key)

    def _enter(self, table: str, key: str) -> None:
        if self.spark.catalog.tableExists(table):
            at = self.spark.sql(f"DESCRIBE FORMATTED `{table}`").where("col_name = 'Location'").first()["data_type"]
            if at.rstrip("/").endswith(f"{self.path.split(':', 1)[-1]}/{table}"):
                return
            raise ValueError(f"table {table} is that of another folder, {at}")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(f"{self.path}/{table}").schema)
        self.spark.sql(f"CREATE TABLE `{table}` ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{table}'")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"`{self.name}_{name}`")

    def nodes(self) -> DataFrame:
        return self.table("nodes")

    def edges(self) -> DataFrame:
        return self.table("edges_hid").drop("end")

    def multi_get(self, ids: DataFrame, order: str = "ord") -> DataFrame:
        """As ``lookup.multi_get`` by ``eid``; the nodes are not shuffled."""
        return lookup.multi_get(self.nodes(), ids, "eid", order)

    def edges_of(self, eid: str, forward: bool = True) -> DataFrame:
        """The edges from or to one node, from the files of its buckets."""
        own = "hid" if forward else "tid"
        ends = [f"{eid}|{i}" for i in range(self.spread)]
        return self.table(f"edges_{own}").where(F.col("end").isin(ends) & (F.col(own) == eid)).drop("end")

    def related(self, eid: str, reverse: bool = False) -> DataFrame:
        """As ``lookup.related``."""
        return lookup.related(self.nodes(), self.edges_of(eid), eid, reverse)

    def edges_of_many(self, ids: DataFrame, forward: bool = True) -> DataFrame:
        """The edges from or to the nodes ``eid`` of a table, which is repeated ``spread`` times and shuffled; the edges are not."""
        own = "hid" if forward else "tid"
        ends = ids.select(F.explode(F.sequence(F.lit(0), F.lit(self.spread - 1))).alias("i"), "eid").where("eid IS NOT NULL")
        return self.table(f"edges_{own}").join(ends.select(F.concat_ws("|", "eid", "i").alias("end")), "end", "left_semi").drop("end")

    def neighbours(self, ids: DataFrame, senses=None, forward: bool = True) -> DataFrame:
        """As ``lookup.neighbours``."""
        own, other = ("hid", "tid") if forward else ("tid", "hid")
        found = self.edges_of_many(ids, forward)
        some = found.where(F.col("sense").isin(*senses)) if senses else found
        return some.select(F.col(own).alias("eid"), F.col(other).alias("other")).distinct()

    def by_grain(self, grain: str, value: str | list[str]) -> DataFrame:
        """The nodes whose grain has this value, a text or its words, from the files of one bucket."""
        if grain not in self.grains:
            raise ValueError(f"not laid out by {grain!r}")
        return self.table(f"nodes_{grain}").where(F.col("grain") == (value if isinstance(value, str) else " ".join(value))).drop("grain")

    def drop(self) -> None:
        """Takes the tables out of the session's catalog; their files stay."""
        for table in ("nodes", *[f"nodes_{g}" for g in self.grains], "edges_hid", "edges_tid"):
            self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}_{table}`")
