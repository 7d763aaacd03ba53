"""Readers and writers of corpora, parses, taxonomies and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evkg.functions.ids import sid
from evkg.schema import TAXONOMY


def read_paragraphs(spark: SparkSession, path: str, most: int = 1024) -> DataFrame:
    """``(path, para_idx, text)`` of text files under ``path``; an empty line or one that begins with ``.START`` ends a
    paragraph.  A file of one paragraph of more than ``most`` characters is cut at every line end instead.

    A file is one row, so it must fit in a task; the order of its paragraphs is known in no other way.
    """
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    some = lambda ps: F.filter(ps, lambda p: p != "")
    parts = some(F.split("value", r"(?md)(?:^\.START.*(?:\n|\z)|^\n)+"))
    files = files.select("path", parts.alias("p")).withColumn("p", F.when((F.size("p") == 1) & (F.length(F.get("p", 0)) > most), F.split(F.get("p", 0), "\n")).otherwise(F.col("p")))
    trimmed = F.transform("p", lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return files.select("path", F.posexplode(some(trimmed)).alias("para_idx", "text"))


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of parsed JSON lines; the header line of cumulative paragraph ends gives ``para_idx``."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split(F.regexp_replace("value", r"\s+\z", ""), "\n").alias("lines"))
    shape = "struct<text:string,tokens:array<string>,lemmas:array<string>,pos_tags:array<string>,ners:array<string>,parse:string,dependencies:array<array<string>>,mentions:array<struct<start:int,end:int,text:string,ner:string,link:string,entity:string>>>"
    ends = F.from_json(F.col("lines")[0], "struct<sentence_lens:array<int>>")["sentence_lens"]
    rows = files.select("path", ends.alias("ends"), F.posexplode("lines").alias("line", "value")).where("line > 0").withColumn("s", F.from_json("value", shape))
    deps = F.transform("s.dependencies", lambda d: F.struct(d[0].cast("int").alias("gov"), d[1].alias("dep"), d[2].cast("int").alias("dpt")))
    return rows.select(
        sid("path", "line").alias("sid"), F.col("path").alias("doc"), F.col("line").alias("sent_idx"),
        F.size(F.filter("ends", lambda e: e <= F.col("line"))).alias("para_idx"),
        "s.text", "s.tokens", "s.lemmas", "s.pos_tags", "s.ners", "s.parse", deps.alias("dependencies"), "s.mentions",
    )


def unparsed(spark: SparkSession, path: str) -> DataFrame:
    """Files that are empty or whose header disagrees with their number of lines."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split(F.regexp_replace("value", r"\s+\z", ""), "\n").alias("lines"))
    last = F.element_at(F.from_json(F.col("lines")[0], "struct<sentence_lens:array<int>>")["sentence_lens"], -1)
    return files.where(last.isNull() | (last != F.size("lines"))).select("path").union(empty_files(spark, path)).distinct()


def empty_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path)``.  Spark's readers skip empty files, so the file system is asked; only names of empty ones come back,
    without those that the readers hide (``_SUCCESS``)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    out = []
    while found.hasNext():
        status = found.next()
        if status.getLen() == 0 and not status.getPath().getName().startswith(("_", ".")):
            out.append((status.getPath().toString(),))
    return spark.createDataFrame(sorted(out), "path string")


def change_extension(path: Column, extension: str = "jsonl") -> Column:
    """A path with what follows its last dot replaced; one without a dot becomes the extension."""
    return F.when(F.contains(path, F.lit(".")), F.regexp_replace(path, r"\.[^.]*\z", f".{extension}")).otherwise(F.lit(extension))


def list_paths(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    """``(path)`` of all files under a folder, or those with an extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (files.option("pathGlobFilter", f"*.{extension}") if extension else files).load(path).select("path")


def write_paths(paths: DataFrame, to: str) -> None:
    paths.select("path").write.mode("overwrite").text(to)


def read_paths(spark: SparkSession, at: str, root: str | None = None) -> DataFrame:
    """``(path)``, and what follows ``root`` in it as ``name``."""
    out = spark.read.text(at).select(F.trim("value").alias("path"))
    return out if root is None else out.withColumn("name", F.substring("path", len(root) + 2, 2_147_483_647))


def write_parsed(sentences: DataFrame, path: str) -> None:
    """Sentences as JSON lines; those of a document stand together in one file, in order, with its path in ``doc``."""
    order = [c for c in ("para_idx", "sent_idx") if c in sentences.columns]
    sentences.repartition("doc").sortWithinPartitions("doc", *order).write.mode("overwrite").json(path)


def write_parsed_files(sentences: DataFrame, path: str) -> None:
    """``doc=.../`` folders that ``read_parsed`` takes: a header line of cumulative paragraph ends, then the sentences
    of one document in order.  A document's sentences meet in one row."""
    skip = ("sid", "doc", "sent_idx", "para_idx", "dependencies")
    deps = F.transform("dependencies", lambda d: F.array(d["gov"].cast("string"), d["dep"], d["dpt"].cast("string")))
    line = F.to_json(F.struct(*[c for c in sentences.columns if c not in skip], *([deps.alias("dependencies")] if "dependencies" in sentences.columns else [])))
    rows = sentences.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("para_idx", "sent_idx", line.alias("line")))).alias("x"))
    upto = lambda p: F.size(F.filter("x", lambda r: r["para_idx"] <= p)) + 1
    ends = F.transform(F.sequence(F.lit(0), F.array_max(F.transform("x", lambda r: r["para_idx"]))), upto)
    text = F.concat(F.array(F.to_json(F.struct(ends.alias("sentence_lens")))), F.transform("x", lambda r: r["line"]))
    rows.select("doc", F.array_join(text, "\n").alias("value")).write.mode("overwrite").partitionBy("doc").text(path)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=TAXONOMY)


def write_taxonomy(taxonomy: DataFrame, path: str) -> None:
    taxonomy.write.mode("overwrite").parquet(path)


def read_saved_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TAXONOMY).parquet(path)


def write_scores(df: DataFrame, key: str, score: str, path: str) -> None:
    """Key and score with two decimals, tab between."""
    df.select(key, F.format_string("%.2f", score).alias(score)).write.mode("overwrite").csv(path, sep="\t")


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, parts: int = 8) -> DataFrame:
    """A table of an SQLite file that all executors see, read by ranges of row ids."""
    import sqlite3

    import pandas as pd

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        low, high = con.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{table}"').fetchone()
    step = max(1, -(-(high - low + 1) // parts))
    ranges = spark.createDataFrame([(a, a + step) for a in range(low, high + 1, step)], "a long, b long") if high >= low else spark.createDataFrame([], "a long, b long")
    names = ", ".join(f'"{c.strip().split()[0]}"' for c in schema.split(","))

    def run(batches):
        for b in batches:
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
                for x, y in zip(b["a"], b["b"], strict=True):
                    yield from pd.read_sql_query(f'SELECT {names} FROM "{table}" WHERE rowid >= ? AND rowid < ?', con, params=(int(x), int(y)), chunksize=32_768)

    return ranges.repartition(max(1, min(parts, high - low + 1))).mapInPandas(run, schema)


def write_sqlite(df: DataFrame, path: str, table: str, rows: int = 32_768) -> None:
    """An export to one SQLite file on the driver's disk, which has one writer: partition after partition is sent,
    ``rows`` at a time are written.  For graphs that fit on one machine; arrays and structs become JSON."""
    import itertools
    import sqlite3

    flat = df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in df.schema])
    names, marks = ", ".join(f'"{c}"' for c in flat.columns), ", ".join("?" * len(flat.columns))
    with sqlite3.connect(path) as con:
        con.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({names})')
        own = flat.toLocalIterator()
        while some := [tuple(r) for r in itertools.islice(own, rows)]:
            con.executemany(f'INSERT INTO "{table}" ({names}) VALUES ({marks})', some)
            con.commit()


def with_order(df: DataFrame, *order: str) -> DataFrame:
    """A running number inside each document."""
    return df.withColumn("sent_idx", F.row_number().over(Window.partitionBy("doc").orderBy(*order)) - 1)
