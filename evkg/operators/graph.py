"""Building, filtering, merging and splitting the graph."""

from __future__ import annotations

from collections import Counter, deque
from itertools import accumulate, groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evkg.functions.ids import rid
from evkg.schema import SENSES


def merge_nodes(occurrences: DataFrame) -> DataFrame:
    """Nodes from occurrences: frequencies add up, the pattern is the smallest of the first sentence."""
    return occurrences.groupBy("eid", "words").agg(F.sum("frequency").alias("frequency"), F.min("pattern").alias("pattern"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """Weights add up by ends and sense; the id is made once for each sum, not for each occurrence."""
    out = edges.groupBy("hid", "tid", "sense").agg(F.sum("weight").alias("weight"))
    return out.select(rid("hid", "tid").alias("rid"), "hid", "tid", "sense", "weight")


def cooccurrence(occurrences: DataFrame, sense: Column | None = None) -> DataFrame:
    """Pairs of one sentence, the head strictly before the tail: an equi-join on the sentence with a residual."""
    h = occurrences.select("sent", F.col("eid").alias("hid"), F.col("pos").alias("hpos"), *([sense.alias("sense")] if sense is not None else []))
    t = occurrences.select("sent", F.col("eid").alias("tid"), F.col("pos").alias("tpos"))
    out = h.join(t, "sent").where("hpos < tpos")
    return out.select("hid", "tid", "sense" if sense is not None else F.lit("Co_Occurrence").alias("sense"), F.lit(1.0).alias("weight"), "sent")


def adjacent(sentences: DataFrame, order: list[str]) -> DataFrame:
    """``(doc, sent, next)`` of neighbouring sentences of a document."""
    w = Window.partitionBy("doc").orderBy(*order)
    return sentences.withColumn("next", F.lead("sent").over(w)).where("next IS NOT NULL").select("doc", "sent", "next")


def singles(occurrences: DataFrame) -> DataFrame:
    """``(sent, eid)`` of sentences with exactly one occurrence; the counts are combined before the shuffle."""
    return occurrences.groupBy("sent").agg(F.count("*").alias("n"), F.min("eid").alias("eid")).where("n = 1").select("sent", "eid")


def adjacent_edges(occurrences: DataFrame, pairs: DataFrame, sense: str = "Precedence") -> DataFrame:
    """Edges between neighbouring sentences that hold exactly one occurrence each."""
    one = singles(occurrences)
    out = pairs.join(one.withColumnRenamed("eid", "hid"), "sent").join(one.select(F.col("sent").alias("next"), F.col("eid").alias("tid")), "next")
    return out.select("hid", "tid", F.lit(sense).alias("sense"), F.lit(1.0).alias("weight"), "sent")


def argument_match(arguments: DataFrame, occurrences: DataFrame, similarity, threshold: float = 0.8) -> DataFrame:
    """Arguments of connectives (``conn, sent, words``) with the similar occurrences of their sentence."""
    return arguments.join(occurrences.select("sent", "eid", F.col("words").alias("own")), "sent").where(similarity(F.col("words"), F.col("own")) >= threshold).select("conn", "eid")


def spread(heads: DataFrame, tails: DataFrame, sense: str) -> DataFrame:
    """Edges of a connective, its weight of one shared by all pairs of matched heads and tails."""
    count = lambda df, c: df.withColumn(c, F.count("*").over(Window.partitionBy("conn")))
    h, t = count(heads, "nh").withColumnRenamed("eid", "hid"), count(tails, "nt").withColumnRenamed("eid", "tid")
    return h.join(t, "conn").select("hid", "tid", F.lit(sense).alias("sense"), (F.lit(1.0) / (F.col("nh") * F.col("nt"))).alias("weight"))


def core_nodes(nodes: DataFrame, least: float) -> DataFrame:
    return nodes.where(F.col("frequency") >= least)


def above_mean(nodes: DataFrame) -> DataFrame:
    """Nodes whose frequency is the mean or more; the mean is one row that is sent to the nodes."""
    mean = nodes.agg(F.avg("frequency").alias("mean_"))
    return nodes.join(F.broadcast(mean), F.col("frequency") >= F.col("mean_")).drop("mean_")


def core_edges(edges: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Edges of enough total weight whose ends both remain."""
    total = edges.withColumn("total", F.sum("weight").over(Window.partitionBy("rid")))
    return keep_ends(total.where(F.col("total") >= least).drop("total"), nodes)


def keep_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes, edges["hid"] == nodes["eid"], "left_semi").join(nodes, edges["tid"] == nodes["eid"], "left_semi")


def singletons(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("hid").alias("eid")).union(edges.select("tid")).distinct()
    return nodes.join(ends, "eid", "left_anti")


def sweep(nodes: DataFrame, edges: DataFrame, thresholds) -> DataFrame:
    """Counts of nodes and edges that remain at each threshold, in one pass over either table."""
    least = edges.select("rid", "hid", "tid").distinct()
    f = nodes.select("eid", "frequency")
    both = least.join(f.toDF("hid", "hf"), "hid").join(f.toDF("tid", "tf"), "tid").select(F.least("hf", "tf").alias("frequency"))
    counts = lambda df: df.agg(*[F.count_if(F.col("frequency") >= F.lit(float(t))).alias(f"t{i}") for i, t in enumerate(thresholds)])
    long = lambda df, name: counts(df).select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias(name)) for i, t in enumerate(thresholds)])).alias("x")).select("x.*")
    return long(nodes, "n_nodes").join(long(both, "n_edges"), "threshold")


def degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree over distinct edges, in one aggregation."""
    pairs = edges.select("hid", "tid").distinct()
    ends = pairs.select(F.explode(F.array(F.struct(F.col("hid").alias("eid"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("tid").alias("eid"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy(F.col("x.eid").alias("eid")).agg(F.sum("x.o").alias("outs"), F.sum("x.i").alias("ins"))


def degree_filter(nodes: DataFrame, edges: DataFrame, low: int = 5, high: int = 1000) -> DataFrame:
    """Nodes with more than ``low`` and fewer than ``high`` edges either way; a missing degree is zero."""
    d = nodes.join(degrees(edges), "eid", "left").fillna(0, ["outs", "ins"])
    inside = lambda c: (F.col(c) > low) & (F.col(c) < high)
    return d.where(inside("outs") & inside("ins"))


def top_degree(edges: DataFrame, n: int, allowed: DataFrame | None = None) -> DataFrame:
    d = degrees(edges).withColumn("degree", F.col("outs") + F.col("ins")).orderBy(F.col("degree").desc(), "eid").limit(n)
    return d.join(allowed, "eid", "left_anti") if allowed is not None else d


def to_wide(edges: DataFrame, senses=SENSES) -> DataFrame:
    return edges.groupBy("rid", "hid", "tid").agg(*[F.coalesce(F.sum(F.when(F.col("sense") == s, F.col("weight"))), F.lit(0.0)).alias(s) for s in senses])


def to_long(wide: DataFrame, senses=SENSES) -> DataFrame:
    return wide.unpivot(["rid", "hid", "tid"], list(senses), "sense", "weight").where("weight > 0")


def merge_graphs(*tables: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Union of several graphs' nodes or edges, values added."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(*keys).agg(F.sum(value).alias(value))


def by_words(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph whose nodes are joined words: frequencies and senses added."""
    named = nodes.select("eid", "words")
    n = nodes.groupBy("words").agg(F.sum("frequency").alias("frequency"))
    e = edges.join(named.toDF("hid", "head"), "hid").join(named.toDF("tid", "tail"), "tid")
    return n, e.groupBy("head", "tail", "sense").agg(F.sum("weight").alias("weight"))


def to_triplets(edges: DataFrame) -> DataFrame:
    """Each sense as often as its whole weight says."""
    return edges.where("weight >= 1").select("hid", "sense", "tid", F.explode(F.array_repeat(F.lit(1), F.col("weight").cast("int"))).alias("one")).drop("one")


def merge_with_sources(*tables: tuple[DataFrame, DataFrame], key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Several graphs' nodes or edges with their provenance ``(key, sources)``: values added, lists joined in order."""
    rows = merge_graphs(*[t for t, _ in tables], keys=[key], value=value)
    every = None
    for n, (_, sources) in enumerate(tables):
        own = sources.select(key, F.lit(n).alias("n"), "sources")
        every = own if every is None else every.union(own)
    joined = every.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "sources"))), lambda x: x["sources"])).alias("sources"))
    return rows, joined.join(rows, key, "left_semi")


def loose_relation(edges: DataFrame, nodes: DataFrame, head: str, tail: str) -> DataFrame:
    """``(sense, weight)`` between two nodes, where either end may be any node of the same pattern and skeleton."""
    end = nodes.where(F.col("eid").isin(head, tail)).select(F.col("eid").alias("own"), "pattern", "skeleton_words")
    like = nodes.join(F.broadcast(end), ["pattern", "skeleton_words"]).select("own", "eid")  # two rows at most are sent
    tails = edges.where(F.col("hid") == head).join(like.where(F.col("own") == tail), F.col("tid") == F.col("eid"), "left_semi")
    heads = edges.where(F.col("tid") == tail).join(like.where(F.col("own") == head), F.col("hid") == F.col("eid"), "left_semi")
    return tails.union(heads).groupBy("sense").agg(F.sum("weight").alias("weight"))


def relate(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``(sense, weight, n)`` of the edges from one set of nodes to another."""
    own = edges.join(left, edges["hid"] == left["eid"], "left_semi").join(right, edges["tid"] == right["eid"], "left_semi")
    return own.groupBy("sense").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


def edge_sources(found: DataFrame) -> DataFrame:
    """``(rid, head_sid, tail_sid)``: the pairs of sentences that an edge was found in, one row a pair, however many there are."""
    return found.select(rid("hid", "tid").alias("rid"), "head_sid", "tail_sid").distinct()


def with_texts(sources: DataFrame, sentences: DataFrame) -> DataFrame:
    """``(rid, head_text, tail_text)`` of provenance ``(rid, head_sid, tail_sid)``."""
    text = sentences.select("sid", "text")
    out = sources.join(text.toDF("head_sid", "head_text"), "head_sid").join(text.toDF("tail_sid", "tail_text"), "tail_sid")
    return out.select("rid", "head_sid", "tail_sid", "head_text", "tail_text")


def crossing_share(sources: DataFrame) -> DataFrame:
    """``(n, crossing, share)``: how many sources of edges lie in two sentences."""
    crossing = F.count_if(F.col("head_sid") != F.col("tail_sid"))
    return sources.agg(F.count("*").alias("n"), crossing.alias("crossing"), F.try_divide(crossing.cast("double"), F.count("*")).alias("share"))


def _heads(batches):
    """``(range, guest, hid, tails)`` of edges sorted by range, guest and head; the tails come one at a time."""
    rows = (r for b in batches for r in zip(b["target"].tolist(), b["guest"].tolist(), b["hid"].tolist(), b["tid"].tolist(), strict=True))
    for (target, guest, hid), own in groupby(rows, key=itemgetter(0, 1, 2)):
        yield target, guest, hid, (r[3] for r in own)


def _taken(hid: str, tails, max_nodes: int, max_edges: int) -> tuple[set[str], int]:
    """The nodes and the number of edges of a head, up to the limits: a head that reaches one closes any slice."""
    own, n = {hid}, 0
    for n, t in enumerate(tails, 1):
        own.add(t)
        if n >= max_edges or len(own) >= max_nodes:
            for _ in tails:  # the rest is read past, not held
                pass
            break
    return own, n


def _exits(heads, max_nodes: int, max_edges: int):
    """``(entry, exit, slices)`` of one range: to which head the slices lead that begin with head ``entry`` of the range,
    past its own heads (-1: the end of the table), and how many begin on the way.

    The window holds the slice that begins at its left end; when the limits are reached that slice ends, and the window
    moves on by a head.  So each edge is added and taken away once.  A slice from an earlier range ends no later
    than the one that begins at the first head, so no head after that end is an entry.
    """
    window, seen, count = deque(), Counter(), 0
    ways: dict[int, list[tuple[int, int]]] = {}  # head: the entries that lead there and their slices so far
    passed, own_heads, first_end = 0, 0, None
    for i, (guest, hid, tails) in enumerate(heads):
        if not guest:
            own_heads = i + 1
            if first_end is None or i == first_end:
                ways.setdefault(i, []).append((i, 0))
        elif passed >= own_heads:
            break  # all ways have left the range
        own, n = _taken(hid, tails, max_nodes, max_edges)
        window.append((own, n))
        seen.update(own)
        count += n
        while window and (len(seen) >= max_nodes or count >= max_edges):
            gone, m = window.popleft()
            count -= m
            for x in gone:
                seen[x] -= 1
                if not seen[x]:
                    del seen[x]
            if passed == 0:
                first_end = i + 1
            if passed < own_heads and passed in ways:  # ways that have left the range stay where they left it
                ways.setdefault(i + 1, []).extend((e, k + 1) for e, k in ways.pop(passed))
            passed += 1
    for at, own in ways.items():
        for entry, n in own:  # what is still open when the edges end, ends there
            yield (entry, at, n) if at >= own_heads else (entry, -1, n + 1)


def slices(nodes: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int, ranges: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(eid, slice)`` of nodes without edges, ``max_nodes`` a slice by id, and ``(hid, range, slice)`` of heads.

    Heads are taken by id; a slice is closed when it holds ``max_nodes`` distinct nodes or ``max_edges`` edges,
    and holds all edges of its heads.  The slices are the same for any number of ``ranges`` of ids, which are cut in
    parallel, each by one task that holds no more than a slice: first each range finds where slices lead that enter it at
    any head of its first slice (it reads on into the ranges that such a slice can reach), then these few rows
    a range are followed from the first head on, and last each range is cut from the head where it is entered.
    """
    shard = F.substring("eid", 1, 3)
    lone = singletons(nodes, edges).select("eid").withColumn("shard", shard)
    base = lone.groupBy("shard").agg(F.count("*").alias("m"))
    before = base.select("shard", (F.sum("m").over(Window.orderBy("shard")) - F.col("m")).alias("before"))  # 4,096 rows at most
    at = F.col("before") + F.row_number().over(Window.partitionBy("shard").orderBy("eid")) - 1
    alone = lone.join(F.broadcast(before), "shard").select("eid", F.floor(at / F.lit(max_nodes)).cast("long").alias("slice"))

    of = F.floor(F.conv(F.substring("hid", 1, 4), 16, 10).cast("long") * F.lit(ranges) / F.lit(65_536)).cast("int")
    own = edges.select("hid", "tid").distinct().withColumn("range", of)
    dealt = lambda df: df.repartitionById(ranges, F.col("target")).sortWithinPartitions("target", "guest", "hid", "tid").select("target", "guest", "hid", "tid")
    entries = {0: (0, 0)}
    if ranges > 1:
        stats = {r["range"]: (r["heads"], r["edges"]) for r in own.groupBy("range").agg(F.count_distinct("hid").alias("heads"), F.count("*").alias("edges")).collect()}  # a row a range
        first, also = dict(zip(sorted(stats), accumulate((stats[r][0] for r in sorted(stats)), initial=0), strict=False)), {r: [] for r in range(ranges)}
        for r in stats:  # the ranges that a slice can reach which begins with the last head of r
            ahead = 0
            for later in sorted(x for x in stats if x > r):
                if ahead >= max_edges:
                    break
                also[later].append(r)
                ahead += stats[later][1]

        def found(batches):
            for target, mine in groupby(_heads(batches), key=itemgetter(0)):
                got = [(target, *x) for x in _exits((h[1:] for h in mine), max_nodes, max_edges)]
                yield pd.DataFrame(got, columns=["range", "entry", "exit", "n"])

        def followed(batches):
            now, begun = 0, 0
            for b in batches:
                out = []
                for r, entry, exit_, n in zip(b["range"].tolist(), b["entry"].tolist(), b["exit"].tolist(), b["n"].tolist(), strict=True):
                    if first[r] + entry == now:
                        out.append((r, entry, begun, n))
                        now, begun = (first[r] + exit_ if exit_ >= 0 else -1), begun + n
                yield pd.DataFrame(out, columns=["range", "entry", "exit", "n"])

        shape = "range int, entry long, exit long, n long"
        guests = F.array(*[F.array(*[F.lit(t) for t in also[r]]).cast("array<int>") for r in range(ranges)])
        to = F.concat(F.array(F.struct(F.col("range").alias("target"), F.lit(0).alias("guest"))), F.transform(F.get(guests, F.col("range")), lambda t: F.struct(t.alias("target"), F.lit(1).alias("guest"))))
        sent = own.select("hid", "tid", F.explode(to).alias("to")).select("hid", "tid", "to.target", "to.guest")
        # No more rows a range than heads in one slice, and one at a time.
        chain = dealt(sent).mapInPandas(found, shape).repartition(1).sortWithinPartitions("range", "entry").mapInPandas(followed, shape)
        entered, begun = {r["range"]: (r["entry"], r["exit"], r["n"]) for r in chain.collect()}, 0  # a row a range
        for r in sorted(stats):
            entry, at_, n = entered.get(r, (None, begun, 0))
            entries[r], begun = (entry, at_), at_ + n

    def cut(batches):
        for target, mine in groupby(_heads(batches), key=itemgetter(0)):
            entry, now = entries[target]
            now, held, count, out = now - 1, set(), 0, []
            for i, (_, _, hid, tails) in enumerate(mine):
                if i == entry or (entry is not None and i > entry and (len(held) >= max_nodes or count >= max_edges)):
                    now, held, count = now + 1, set(), 0
                nodes_of, n = _taken(hid, tails, max_nodes, max_edges)
                if entry is not None and i >= entry:
                    held |= nodes_of
                    count += n
                out.append((hid, target, now))
                if len(out) == 10_000:
                    yield pd.DataFrame(out, columns=["hid", "range", "slice"])
                    out = []
            yield pd.DataFrame(out, columns=["hid", "range", "slice"])

    return alone, dealt(own.select("hid", "tid", F.col("range").alias("target"), F.lit(0).alias("guest"))).mapInPandas(cut, "hid string, range long, slice long")


def write_slices(edges: DataFrame, heads: DataFrame, path: str) -> None:
    """The edges and the nodes of each slice, in folders by slice."""
    own = edges.join(heads.select("hid", "slice"), "hid")
    own.write.mode("overwrite").partitionBy("slice").parquet(f"{path}/edges")
    ends = own.select("slice", F.explode(F.array("hid", "tid")).alias("eid")).distinct()
    ends.write.mode("overwrite").partitionBy("slice").parquet(f"{path}/nodes")
