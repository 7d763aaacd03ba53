"""A graph's tables in one folder, opened lazily, cached, or laid out by a grain of its nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of a store.
TABLES = ("nodes", "edges", "concepts", "concept_pairs", "concept_edges")
#: Ways to open a store, and the columns of nodes by which similar ones are looked up.
MODES, GRAINS = ("insert", "cache", "memory"), (None, "words", "skeleton_words", "verbs")
#: Files of each table that is laid out by a grain.
BUCKETS = 64


def write(tables: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"unknown table {name!r}")
        df.write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")


class Store:
    """Tables by name.  ``insert`` reads them anew with each query, ``cache`` keeps what queries read in the executors'
    memory or on their disks, ``memory`` reads all tables into it at once.  With a ``grain`` the nodes are cached in
    ranges of that column, so that a lookup by it skips the others."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "cache", grain: str | None = None, kind: str = "parquet"):
        if mode not in MODES:
            raise ValueError(f"mode {mode!r} is none of {MODES}")
        if grain not in GRAINS:
            raise ValueError(f"grain {grain!r} is none of {GRAINS}")
        if kind != "parquet":
            raise ValueError(f"no store of kind {kind!r}; import it with sources.corpus.read_sqlite")
        self.spark, self.path, self.mode, self.grain = spark, path.rstrip("/"), mode, grain
        self.held: dict[str, DataFrame] = {}
        if mode == "memory":
            for name in self.names():
                self.table(name).count()

    def names(self) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [n for n in TABLES if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}"))]

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise ValueError(f"unknown table {name!r}")
        if name not in self.held:
            df = self.spark.read.parquet(f"{self.path}/{name}")
            if self.mode == "insert":
                return df
            if name == "nodes" and self.grain in df.columns:
                df = df.repartitionByRange(BUCKETS, self.grain).sortWithinPartitions(self.grain)
            self.held[name] = df.persist()
        return self.held[name]

    def append(self, name: str, news: DataFrame) -> None:
        """Rows are added; what was cached of the table is read anew."""
        if name not in TABLES:
            raise ValueError(f"unknown table {name!r}")
        news.write.mode("append").parquet(f"{self.path}/{name}")
        self.forget(name)

    def forget(self, name: str) -> None:
        if name in self.held:
            self.held.pop(name).unpersist()

    def close(self) -> None:
        for name in list(self.held):
            self.forget(name)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()
