"""Key lookups, neighbours, partial matches and upserts over node, edge and pair tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evkg.functions.text import jaccard


def multi_get(df: DataFrame, ids: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """A row for each wanted id, in the ids' order, repeats kept, nulls where nothing is found."""
    return ids.join(df, key, "left").orderBy(order)


def by_keys(df: DataFrame, wanted: dict, order_bys=(), reverse: bool = False, top_n: int | None = None) -> DataFrame:
    """Rows that equal all wanted values; unknown columns are dropped and an empty wish finds nothing."""
    known = {k: v for k, v in wanted.items() if k in df.columns}
    if not known:
        return df.where(F.lit(False))
    return ranked(df.where(reduce(Column.__and__, [F.col(k) == F.lit(v) for k, v in known.items()])), order_bys, reverse, top_n)


def ranked(df: DataFrame, order_bys=(), reverse: bool = False, top_n: int | None = None) -> DataFrame:
    """One direction for all keys; ``top_n`` of 0 or None means all."""
    if order_bys:
        df = df.orderBy(*[F.col(c).desc() if reverse else F.col(c).asc() for c in order_bys])
    return df.limit(top_n) if top_n else df


def totals(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rid", "hid", "tid").agg(F.sum("weight").alias("total"))


def successors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(rid, hid, tid, total)`` and the columns of the tails, nodes or concepts, of edges."""
    return totals(edges).join(nodes, F.col("tid") == F.col("eid"))


def related(nodes: DataFrame, edges: DataFrame, eid, reverse: bool = False) -> DataFrame:
    """Successors of a node by total weight, lightest first unless ``reverse``; ties by edge id."""
    out = successors(nodes, edges.where(F.col("hid") == eid))
    return out.orderBy(F.col("total").desc() if reverse else F.col("total").asc(), "rid")


def exact(df: DataFrame, wanted: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows of ``df`` whose columns equal those of a wanted row (``keys``: own name to wanted name), with its other columns."""
    return df.join(wanted.withColumnsRenamed({v: k for k, v in keys.items()}), list(keys))


def neighbours(edges: DataFrame, ids: DataFrame, senses=None, forward: bool = True) -> DataFrame:
    """``(eid, other)``: distinct neighbours of many nodes over any of the senses."""
    own, other = ("hid", "tid") if forward else ("tid", "hid")
    some = edges.where(F.col("sense").isin(*senses)) if senses else edges
    return some.join(ids.select("eid"), F.col(own) == F.col("eid"), "left_semi").select(F.col(own).alias("eid"), F.col(other).alias("other")).distinct()


def partial_match(nodes: DataFrame, words: list[str], grains: dict[str, str], threshold: float = 0.8, top_n: int | None = None, cascade: bool = True) -> DataFrame:
    """Nodes that share a key of the first grain with any match, by (similarity, frequency, eid) from above.

    ``grains`` maps columns to wanted values, most exact first.  Without ``cascade`` every grain counts.
    """
    hit = [F.when(F.col(c) == F.lit(v), F.lit(i)) for i, (c, v) in enumerate(grains.items())]
    found = nodes.withColumn("grain", F.coalesce(*hit, F.lit(None).cast("int"))).where("grain IS NOT NULL")
    if cascade:
        found = found.crossJoin(F.broadcast(found.agg(F.min("grain").alias("_first")))).where("grain = _first").drop("_first")
    scored = found.withColumn("similarity", jaccard(F.col("words"), F.array(*[F.lit(w) for w in words]))).where(F.col("similarity") >= threshold)
    out = scored.orderBy(F.col("similarity").desc(), F.col("frequency").desc(), F.col("eid").desc())
    return out.limit(top_n) if top_n else out


def upsert(df: DataFrame, news: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """News add to known rows and join them otherwise; repeated news all count; other columns keep their first writer."""
    rest = [c for c in df.columns if c not in keys + sums]
    both = df.withColumn("_new", F.lit(0)).unionByName(news.withColumn("_new", F.lit(1)))
    aggs = [F.sum(c).alias(c) for c in sums] + [F.min_by(c, F.struct("_new", c)).alias(c) for c in rest]
    return both.groupBy(*keys).agg(*aggs).select(*df.columns)


def insert(df: DataFrame, news: DataFrame, key: str) -> DataFrame:
    """``df`` with the rows of ``news`` whose key it lacks; of several with one key the smallest."""
    rest = [c for c in df.columns if c != key]
    one = news.groupBy(key).agg(F.min(F.struct(*rest)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])
    return df.unionByName(one.join(df.select(key), key, "left_anti").select(*df.columns))


def create(spark, name: str, schema: str) -> None:
    """A table of the session's catalogue; one that is there stays."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def encode(df: DataFrame, lists: list[str], keep: list[str]) -> DataFrame:
    """Rows as a table stores them: word lists as text, all other columns as JSON in ``info``."""
    rest = [c for c in df.columns if c not in (*lists, *keep)]
    return df.select(*keep, *[F.array_join(c, " ").alias(c) for c in lists], F.to_json(F.struct(*rest)).alias("info"))


def decode(df: DataFrame, lists: list[str], info: str) -> DataFrame:
    """The other way; ``info`` is the schema of the JSON."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "").alias(c)
    plain = [c for c in df.columns if c not in (*lists, "info")]
    return df.withColumn("x", F.from_json("info", info)).select(*plain, *[words(c) for c in lists], "x.*")


def near_tokens(tokens: DataFrame, skip: list[str], forward: bool = False, most: int = 10) -> DataFrame:
    """Each token ``(doc, sent_idx, tok_idx, token)`` with the place and text of the one before (or after) it that is
    not to be skipped, across sentences, within ``most`` tokens; -1 where there is none."""
    w = Window.partitionBy("doc").orderBy("sent_idx", "tok_idx")
    own = F.when(~F.col("token").isin(*skip), F.struct("sent_idx", "tok_idx", "token"))
    near = F.first(own, True).over(w.rowsBetween(1, most)) if forward else F.last(own, True).over(w.rowsBetween(-most, -1))
    out = tokens.withColumn("x", near)
    return out.select("doc", "sent_idx", "tok_idx", "token", F.coalesce("x.sent_idx", F.lit(-1)).alias("near_sent"), F.coalesce("x.tok_idx", F.lit(-1)).alias("near_tok"), F.col("x.token").alias("near"))


def apply_updates(df: DataFrame, key: str, deltas: DataFrame, column: str, op: str) -> DataFrame:
    """``column op delta`` where a delta exists; ``+`` and ``-`` sum repeated deltas, ``=`` takes the largest."""
    agg = {"+": F.sum, "-": F.sum, "*": F.product, "/": F.product, "=": F.max}[op]
    d = deltas.groupBy(key).agg(agg("delta").alias("_d"))
    c, v = F.col(column), F.col("_d")
    new = {"+": c + v, "-": c - v, "*": c * v, "/": F.try_divide(c, v), "=": v}[op]
    return df.join(d, key, "left").withColumn(column, F.when(v.isNotNull(), new).otherwise(c)).drop("_d")


def context(sentences: DataFrame, k: int) -> DataFrame:
    """Each sentence with the texts of ``k`` sentences on either side, cut at the document's ends, in order."""
    w = Window.partitionBy("doc").orderBy("sent_idx").rowsBetween(-k, k)
    return sentences.withColumn("context", F.collect_list("text").over(w))
