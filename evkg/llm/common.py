"""Helpers shared by the corpus operators: lineage cuts, bounded samples, clean inputs."""

from __future__ import annotations

import pickle
import tempfile
import uuid

import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, ``new=old``; a column the table lacks becomes null strings.

    Extra columns never reach an operator, so their names can't clash with its own.
    """
    have = {c.lower(): c for c in df.columns}
    return df.select(
        *[(df[f"`{have[old.lower()]}`"] if old.lower() in have else F.lit(None).cast("string")).alias(new) for new, old in wanted.items()]
    )


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, made of ``names``."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"{name}_"
        have.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    Only a session on one machine (tests) may leave it unset and gets a temporary one; a cluster is refused.
    """
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that later stages survive lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, before: str | None = None) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and its path; the table ``before`` is removed.

    For loops: a checkpoint keeps the size that Spark guesses for its plan, and a guess that each join of a loop
    multiplies soon takes the driver longer than the data; a table has the size of its files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if before:
        remove(spark, before)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of ids up to which their table is broadcast (16 MB).
BROADCAST_IDS = 2_000_000


def sent(ids: DataFrame, most: int | None = None) -> DataFrame:
    """``ids``, written and counted, with a broadcast hint where they are few enough; else the join shuffles."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= (BROADCAST_IDS if most is None else most) else ids


def bounded_sample(df: DataFrame, group: str, key: str, per_group: int, seed: int = 0, ties: tuple[str, ...] = ()) -> DataFrame:
    """At most ``per_group`` rows of each non-null ``group``, those with the smallest hash of ``key``, then the least ``ties``.

    Two passes: the group sizes (two narrow columns), then a hash threshold that leaves about twice
    the wanted rows of each group before the ranking, so no ranking task grows with the input.
    """
    h = F.xxhash64(F.col(key).cast("string"), F.lit(seed))
    rows = df.where(F.col(group).isNotNull() & F.col(key).isNotNull())
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    unit = F.pmod(h, F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = rows.join(F.broadcast(sizes), F.col(group) == F.col("_g")).where(unit * F.col("_n") < F.lit(2.0 * per_group + 50))
    w = Window.partitionBy(group).orderBy(h, F.col(key), *ties)
    return near.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= per_group).drop("_g", "_n", "_rank")


def pieces_of(docs: DataFrame, most: int) -> DataFrame:
    """``docs`` without ``text``, but with its hash ``h`` and the number of ``pieces`` of ``most`` characters it makes."""
    pieces = F.greatest(F.lit(1), F.ceil(F.length("text") / F.lit(most))).cast("int")
    return docs.select(*[c for c in docs.columns if c != "text"], F.xxhash64("text").alias("h"), pieces.alias("pieces"))


def drawn(marked: DataFrame, docs: DataFrame, group: str, per_group: int, most: int) -> DataFrame:
    """``(group, text)``: at most ``per_group`` pieces of texts of each group, of at most ``most`` characters each.

    ``marked`` has ``(id, h, pieces)`` of ``pieces_of`` and the group; ``docs`` has ``(id, text)``.  Texts stay where they are
    until the pieces are chosen, by a hash of id and number; of several texts of one id and group that with the smallest
    hash counts, so the choice does not depend on how the table is dealt.
    """
    own = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("?"), F.col("h").cast("string")))
    rows = marked.groupBy(group, own.alias("own")).agg(F.min(F.struct("h", "pieces", "id")).alias("x"))
    each = rows.select(group, "own", "x.h", "x.id", F.explode(F.sequence(F.lit(0), F.col("x.pieces") - 1)).alias("piece"))
    each = each.withColumn("key", F.concat_ws(":", "own", F.when(F.col("piece") > 0, F.col("piece").cast("string"))))
    some = bounded_sample(each, group, "key", per_group, ties=("h", "piece")).select(F.col(group).alias("_of"), F.col("id").alias("_id"), F.col("h").alias("_h"), "piece")
    # So many rows a group are sent, without texts.
    met = docs.join(F.broadcast(some), (F.xxhash64("text") == F.col("_h")) & F.col("id").eqNullSafe(F.col("_id")))
    cut_out = met.select(F.col("_of").alias(group), "_id", "_h", "piece", F.substring(F.col("text"), F.col("piece") * most + 1, F.lit(most)).alias("text"))
    return cut_out.groupBy(group, "_id", "_h", "piece").agg(F.min("text").alias("text")).select(group, "text")


class Stored:
    """Trained models in Parquet files that Spark brings to each executor; a worker reads them once."""

    def __init__(self, names: list[str]):
        self.names, self.models = names, None

    def __reduce__(self):
        return Stored, (self.names,)

    def open(self) -> list:
        if self.models is None:
            self.models = [pickle.loads(x.as_py()) for name in self.names for x in pq.read_table(SparkFiles.get(name), partitioning=None).column(0)]
        return self.models


def stored(models: DataFrame):
    """Pickled models, one a row, written to the shared folder, as a broadcast variable that names their files: neither
    the driver nor a broadcast holds a model."""
    sc = models.sparkSession.sparkContext
    files = written(models)[0].inputFiles()
    for name in files:
        sc.addFile(name)
    return sc.broadcast(Stored([name.rsplit("/", 1)[1] for name in files]))


LONG = T.LongType()
STR = T.StringType()
DBL = T.DoubleType()


def schema(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])
