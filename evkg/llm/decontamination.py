"""Benchmark decontamination, in DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles have five words (a text of fewer is one
shingle).  A window is a stretch of a document with as many words as a benchmark item has.  Similarity is
that of the shingle sets, ``sum of weights shared / sum of weights of either``, where a shingle weighs
``ln(1 + items / items that hold it)`` and one outside the item as much as a unique one.  0.8 or more is
contamination.

Every window that shares a shingle with an item is judged exactly; without one the similarity is zero.
An item of fewer than five words is one shingle, and is found where a document has these words in a row.
A window must share 0.8 of an item's weight, so it shares one of its heaviest shingles that together weigh over 0.2
of it.  Documents and items meet on these alone (broadcast after their number is checked), so the rest of the corpus
never leaves the scan, and a prompt that most items share brings no document together with all of them.  Only the pairs
of a document and an item that met are joined to the item's other shingles, inside the document.  The places where
they meet are dealt by document, item and *segment*, two window lengths that overlap by one, so a window lies within a segment and no row
grows with its document.  Segments, then windows, whose shared weight is below 0.8 of the item's are
dropped: the similarity can't be higher than that share.

Defined results: null texts are empty and match nothing, as do empty items; rows without an id are never
reported; repeated rows and repeated items count once; a document shorter than an item is one
window; an empty table gives an empty one; other columns are ignored (``drop_contaminated`` keeps them);
long texts are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, pick, sent, table, unused

K = 5
SIMILARITY = 0.8
#: Slack of the bounds, so that rounding drops no window.
SLACK = 1e-6
#: Shingles of a benchmark up to which it is broadcast (about 50 MB); beyond it the joins shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def shingles(h: Column, k: int = K) -> Column:
    """Hashes of the shingles of an array of word hashes, in order."""
    return (
        F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[h[i + j] for j in range(k)])))
        .when(F.size(h) > 0, F.array(F.xxhash64(h)))
        .otherwise(F.array().cast("array<bigint>"))
    )


def placed(h: Column, short: list[int]) -> Column:
    """``array<struct<pos, h>>``: the shingles of an array of word hashes, and all its runs of as many words as short items have."""
    at = lambda grams: F.transform(grams, lambda x, i: F.struct(i.alias("pos"), x.alias("h")))
    runs = lambda n: F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(F.slice(h, i + 1, n)))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(at(shingles(h)), *[at(runs(n)) for n in short])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, item_id, similarity, start_word, windows)``: each item that a document holds, and where it fits best."""
    items = pick(benchmark, item_id=item_col, text=item_text_col).where("item_id IS NOT NULL")
    items = items.select("item_id", word_hashes(words(F.col("text"))).alias("w")).select("item_id", F.xxhash64("item_id", "w").alias("item"), F.size("w").alias("len"), shingles(F.col("w")).alias("s")).where("len > 0")
    items = cut(items.withColumn("s", F.array_distinct("s")).distinct())
    n_items = items.count()
    short = sorted(r["len"] for r in items.where(F.col("len") < K).select("len").distinct().collect())  # four lengths at most
    parts = items.select("item", "len", F.explode("s").alias("h"))
    df = parts.groupBy("h").agg(F.count("*").alias("df"))
    parts = cut(parts.join(df, "h").withColumn("w", F.log1p(F.lit(float(n_items)) / F.col("df"))))
    items = items.select("item_id", "item", "len").join(parts.groupBy("item").agg(F.sum("w").alias("total")), "item")
    send = F.broadcast if parts.count() <= BROADCAST_ROWS else (lambda x: x)
    lone = F.log1p(F.lit(float(n_items)))
    least = F.lit(similarity - SLACK) * F.col("total")

    src = pick(docs, doc_id=id_col, text=text_col).where("doc_id IS NOT NULL AND text IS NOT NULL")
    hash_words = lambda rows: rows.select("doc_id", word_hashes(words(F.col("text"))).alias("w")).withColumn("doc", F.xxhash64("doc_id", "w"))
    w = F.col("w")
    grams = F.inline(placed(w, short)) if short else F.posexplode(shingles(w)).alias("pos", "h")
    heavy = Window.partitionBy("item").orderBy(F.col("w").desc(), "h")
    rare = parts.withColumn("upto", F.sum("w").over(heavy) - w).join(items.select("item", "total").distinct(), "item")
    rare = cut(rare.where(F.col("upto") <= F.lit(1 - similarity + SLACK) * F.col("total")).select("item", "h"))
    met = hash_words(src).select("doc_id", "doc", grams).select("doc_id", "doc", "h").join(send(rare), "h").select("doc_id", "doc", "item").distinct()
    met = cut(met)
    found = hash_words(src.join(sent(met.select("doc_id").distinct()), "doc_id", "left_semi")).dropDuplicates(["doc"])
    seen = found.select("doc", F.size("w").alias("n"), grams)
    hits = met.join(send(parts), "item").join(seen, ["doc", "h"])
    long = F.least("len", "n")  # words of a window
    wide = F.greatest(long - K + 1, F.lit(1))  # and its shingles
    seg = F.floor(F.col("pos") / wide).cast("int")
    dealt = hits.select("doc_id", "doc", "item", "n", F.explode(F.when(seg > 0, F.array(seg - 1, seg)).otherwise(F.array(seg))).alias("seg"), F.struct("pos", "h", "w").alias("hit"))
    weight = lambda hits: F.aggregate(F.array_distinct(F.transform(hits, lambda x: F.struct(x["h"], x["w"]))), F.lit(0.0), lambda a, x: a + x["w"])
    segments = dealt.groupBy("doc_id", "doc", "item", "n", "seg").agg(F.collect_set("hit").alias("hits")).join(send(items), "item")
    segments = segments.where(weight(F.col("hits")) >= least).withColumn("long", long).withColumn("wide", wide)
    first = F.col("seg") * F.col("wide")
    last = F.least(first + F.col("wide") - 1, F.col("n") - F.col("long"))
    laid = segments.where(last >= first).withColumn("start", F.explode(F.sequence(first, last)))
    own = F.filter("hits", lambda x: (x["pos"] >= F.col("start")) & (x["pos"] < F.col("start") + F.col("wide")))
    laid = laid.select("doc_id", "doc", "item_id", "start", "long", "total", own.alias("own"))
    common = F.size(F.array_distinct(F.transform("own", lambda x: x["h"])))
    windows = cut(laid.select("doc_id", "doc", "item_id", "start", "long", "total", weight(F.col("own")).alias("shared"), common.alias("common")).where(F.col("shared") >= least))

    # Only the documents that have a window are read again and shuffled.
    held = hash_words(src.join(sent(windows.select("doc_id").distinct()), "doc_id", "left_semi")).dropDuplicates(["doc"]).select("doc", "w")
    cuts = windows.join(held, "doc").withColumn("held", F.size(F.array_distinct(shingles(F.slice("w", F.col("start") + 1, F.col("long"))))))
    other = (F.col("held") - F.col("common")) * lone
    sure = cuts.withColumn("similarity", F.round(F.col("shared") / (F.col("total") + other), 9)).where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("at"))).alias("best")
    return sure.groupBy("doc_id", "item_id").agg(best, F.count("*").alias("windows")).select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.at")).cast("long").alias("start_word"), "windows")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are."""
    (name,) = unused(docs, "_gone")
    gone = sent(find_leaks(docs, benchmark, id_col, text_col, similarity=similarity).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone, docs[f"`{id_col}`"] == gone[name], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
