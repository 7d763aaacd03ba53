"""Filter interaction audit by Walsh-Hadamard sums.

Each document gets a mask, one bit for each filter that it fails.  For each part and label, 32 sums are aggregated: of the
documents, counted plus or minus by the parity of the bits that their mask shares with each set of filters.  The
Walsh-Hadamard matrix is its own inverse but for a factor of 32, so these sums give back exactly how many documents have
each mask.  From these 32 cells come all orders of the filters without another look at a document: what is kept,
removed, redundant and lost at each step, and the Shapley value, which needs no orders: of the 120 orders, a
document that fails c filters is removed first by each of them in 120/c.

Copies are found over the whole table by a hash of 256 bits: rows of one text, part and label count together before
they meet the other parts of that text, so that a text which makes up a third of the table is a handful of rows.

Defined results: null text is empty, a null source the part ``''``; of several labels of one document the highest
count, documents without one count as neither; a row without id is no copy and no row is a copy of it; rows that
repeat a document's id and text are copies of smaller ids only; texts are read whole; an empty table gives an empty one;
other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pick, table

#: Blanks end words; signs that fail D.
WORD, SIGNS = r"[^\x20\x09-\x0D]+", r"[#$%&*|]"
#: Filters in the order of their bits; the last one looks for copies.
LETTERS = "ABCDE"
MASKS = 1 << len(LETTERS)
COPY = MASKS >> 1
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: Column) -> list[Column]:
    """The conditions of the filters that look at one text, each true where it fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), F.rlike(text, F.lit(SIGNS))]


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``(part, good, toxic, mask, n)``: documents by failed filters; a mask may stand in several rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = pick(docs, id=id_col, text=text_col, part=part_col).select(F.col("id").cast("long").alias("id"), text.alias("text"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures(F.col("text")))]
    rows = src.select("id", "part", F.sha2("text", 256).alias("h"), sum(bits[1:], bits[0]).alias("mask"))
    # Rows without an id are dealt by their text and meet no label.
    rows = rows.withColumn("key", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("?"), "h")))
    one = lambda c: F.max(F.coalesce(F.col(c).cast("double") == 1, F.lit(False))).alias(c)
    marks = pick(labels, id="doc_id", good="quality", toxic="toxic").where("id IS NOT NULL").groupBy(F.col("id").cast("long").cast("string").alias("key")).agg(one("good"), one("toxic"))
    has = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    marked = rows.join(marks, "key", "left").select("key", "id", "h", "part", has("good"), has("toxic"), "mask")
    same = marked.groupBy("key", "id", "h", "part", "good", "toxic", "mask").agg(F.count("*").alias("n"))
    known = F.col("id").isNotNull()
    texts = same.groupBy("h", "part", "good", "toxic", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("unknown"), F.min(F.when(known, F.struct("id", "n"))).alias("least")
    )
    texts = texts.withColumn("first", F.min("least.id").over(Window.partitionBy("h")))
    own = F.col("unknown") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = F.array(F.struct(F.col("mask"), own.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), (F.col("n") - own).alias("n")))
    return texts.select("part", "good", "toxic", F.explode(split).alias("x")).select("part", "good", "toxic", "x.mask", "x.n").where("n > 0")


def parity_sums(cells: DataFrame) -> DataFrame:
    """``(part, good, toxic, sums)``: by set of filters, the documents that share an even number of its bits less those
    that share an odd one."""
    odd = lambda s: F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2 == 1
    sums = [F.sum(F.when(odd(s), -F.col("n")).otherwise(F.col("n"))).alias(f"s{s}") for s in range(MASKS)]
    return cells.groupBy("part", "good", "toxic").agg(*sums).select("part", "good", "toxic", F.array(*[f"s{s}" for s in range(MASKS)]).alias("sums"))


def hadamard(n: int = MASKS) -> np.ndarray:
    """Plus or minus one by the parity of the bits that row and column share."""
    h = np.ones((1, 1), np.int64)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


def invert(sums: np.ndarray) -> np.ndarray:
    """Documents by mask, from their parity sums."""
    return sums @ hadamard(sums.shape[-1]) // sums.shape[-1]


def steps() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """All ``(order, step)``, and for each figure what a document of each mask adds to it."""
    keys, m = [], np.arange(MASKS)
    fails = np.array([bin(x).count("1") for x in m])
    share = np.where(fails > 0, 120 // np.maximum(fails, 1), 0)
    rows: dict[str, list] = {k: [] for k in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    for order in permutations(LETTERS):
        done = 0
        for i, letter in enumerate(order):
            bit = 1 << LETTERS.index(letter)
            hit, before = (m & bit) > 0, (m & done) > 0
            done |= bit
            keys.append(("".join(order), i + 1))
            for k, v in zip(rows, ((m & done) == 0, hit & ~before, hit & before, m == bit, hit * share), strict=True):
                rows[k].append(v.astype(np.int64))
    return keys, {k: np.array(v) for k, v in rows.items()}


def audit(cells: DataFrame) -> DataFrame:
    """``OUT`` of documents counted by ``(part, good, toxic, mask, n)``."""

    def run(batches):
        keys, of = steps()
        for b in batches:
            for part, labels in zip(b["part"], b["labels"], strict=True):
                every, good, toxic = (sum((invert(np.array(x["sums"])) for x in labels if c is None or x[c]), np.zeros(MASKS, np.int64)) for c in (None, "good", "toxic"))
                figures = {k: of[k] @ every for k in ("kept", "removed", "redundant", "unique_fails")}
                figures |= {"good_lost": of["removed"] @ good, "toxic_lost": of["removed"] @ toxic, "shapley": of["shapley"] @ every}
                yield pd.DataFrame({"part": part, "filter_order": [k[0] for k in keys], "step": np.array([k[1] for k in keys], np.int32), **figures})

    # Four rows at most of a part meet.
    parts = parity_sums(cells).groupBy("part").agg(F.collect_list(F.struct("good", "toxic", "sums")).alias("labels"))
    return parts.mapInPandas(run, OUT)


#: DuckDB.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN min(t.doc_id) OVER (PARTITION BY text) < t.doc_id THEN 16 ELSE 0 END) AS mask
  FROM t LEFT JOIN lab ON t.doc_id = lab.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM f a JOIN f b ON b.bit <> a.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN f e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
s AS (SELECT filter_order, i AS step, bits[i] AS bit, CAST(coalesce(list_sum(bits[1:i-1]), 0) AS INTEGER) AS before FROM o, (SELECT unnest(range(1, 6)) AS i))
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
       CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
       CAST(sum(CASE WHEN mask & bit > 0 THEN n * (120 // bit_count(mask)) ELSE 0 END) AS BIGINT) AS shapley
FROM c, s GROUP BY part, filter_order, step
"""


def query(spark, sf_dir: str) -> DataFrame:
    return audit(masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
