"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on ``LINES`` random lines and sorted along them.  Vectors whose cosine reaches the
threshold differ by at most ``r = sqrt(2 - 2 * threshold)``, so on a line by a normal amount of deviation ``r`` at
most.  On the two *sorted* lines a pair must lie in the window of ``WIDE`` deviations around the query; the windows
of the first are found by dealing the sorted line into bins of that width, those of the second by binary search in
each block.  On the other lines a pair collides if it lies in the window of two deviations around the query; pairs
with too few collisions are dropped early on a few lines and then on all (the counts are chosen so that a pair at the
threshold fails with a probability below one in a hundred), and the rest are verified by their cosine in double
precision.

Exact copies are collapsed before the search and counted again after it.  A vector is sent once to the block of
its bin and once to the block of the bin before, with no projections (those are made again in the block); a crowded
bin is split by hash into parts of bounded size, each pair of which is a block, so one crowded label, bin or group of
copies is spread over tasks.  A block returns counts of links and a spanning forest, never all links.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, or whose
label or id is null, has no link and is its own component; vectors of different lengths never link; each row
is a vector, so repeated rows link with one another; an empty table gives an empty one; other columns
are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, cut, pick, sent, table
from .graph import connected_components
from .simhash_dedup import BROADCAST_TILES, _forest

THRESHOLD = 0.98
LINES, WIDE = 32, 3.3
#: Lines on which collisions are counted first, and the least collisions on those and on all but the sorted ones.
EARLY, LEAST_EARLY, LEAST = 6, 4, 23
#: Vectors in a part of a bin.
CHUNK = 4_096


@lru_cache(64)
def lines(dim: int) -> np.ndarray:
    return np.random.default_rng(1_000_003 + dim).normal(size=(dim, LINES))


def units(raw: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; the largest component is taken out first, so no square overflows."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _bins(width: float, kind: str):
    """Bin of each vector on the first line, and its components as bytes."""

    def run(batches):
        for b in batches:
            col = b.column(1)
            dims, flat = np.diff(col.offsets.to_numpy()), col.flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum(dims)
            out, raw = np.zeros(len(dims), np.int64), []
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                x = np.stack([flat[ends[i] - dim : ends[i]] for i in own])
                out[own] = np.floor(units(x) @ lines(int(dim))[:, 0] / width).astype(np.int64)
            for e, dim in zip(ends.tolist(), dims.tolist(), strict=True):
                raw.append(flat[e - dim : e].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array(dims.astype(np.int64)), pa.array(out), b.column(2)], names=["id", "v", "dim", "bin", "n"])

    return run


def collisions(p: np.ndarray, q: np.ndarray, wide: float, window: float, early: int = EARLY, least_early: int = LEAST_EARLY, least: int = LEAST, rows: int = 64):
    """``(i, j)`` of rows of ``p`` and ``q`` that lie in each other's windows on the sorted lines (the first two) and
    collide often enough on the rest.  ``q`` is sorted along the second line."""
    order = np.argsort(p[:, 1], kind="stable")
    for at in range(0, len(order), rows):
        own = order[at : at + rows]
        lo = np.searchsorted(q[:, 1], p[own[0], 1] - wide, "left")
        hi = np.searchsorted(q[:, 1], p[own[-1], 1] + wide, "right")
        if lo == hi:
            continue
        a, b = p[own], q[lo:hi]
        hit = np.zeros((len(a), len(b)), np.uint8)
        for k in range(2, 2 + early):
            hit += np.abs(a[:, k, None] - b[None, :, k]) <= window
        i, j = np.nonzero(hit >= least_early)
        for part in range(0, len(i), 65_536):
            u, v = i[part : part + 65_536], j[part : part + 65_536]
            d = np.abs(a[u] - b[v])
            ok = (d[:, 0] <= wide) & (d[:, 1] <= wide) & ((d[:, 2:] <= window).sum(1) >= least)
            if ok.any():
                yield own[u[ok]], v[ok] + lo


def block(ids: np.ndarray, n: np.ndarray, role: np.ndarray, raw: np.ndarray, threshold: float):
    """Counts of links ``(id, count)`` and spanning links ``(id, id)`` of one block: rows of role 0 are the queries;
    role 1 are compared with them, and role 0 with themselves where ``-1`` is among the roles."""
    x = units(raw)
    r = math.sqrt(max(0.0, 2 - 2 * threshold))
    p = (x @ lines(x.shape[1])).astype(np.float32)
    queries = np.flatnonzero(role <= 0)
    itself = (role == -1).any()
    links, found = np.zeros(len(ids), np.int64), []
    for other in ([queries] if itself else []) + [np.flatnonzero(role == 1)]:
        other = other[np.argsort(p[other, 1], kind="stable")]
        for i, j in collisions(p[queries], p[other], WIDE * r + 1e-5, 2 * r + 1e-5):
            i, j = queries[i], other[j]
            keep = i < j if other.size == queries.size and itself and role[j[0]] <= 0 else np.ones(len(i), bool)
            i, j = i[keep], j[keep]
            c = np.einsum("ij,ij->i", x[i], x[j])
            i, j, c = i[c >= threshold], j[c >= threshold], c[c >= threshold]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            if len(i):
                w = _forest(len(ids), i, j, 1 - c)
                found.append((i[w], j[w]))
    some = np.flatnonzero(links)
    if not len(some):
        return None
    u, v = (np.concatenate(z) for z in zip(*found, strict=True))
    w = _forest(len(ids), u, v, np.zeros(len(u)))
    return ids[some], links[some], ids[u[w]], ids[v[w]]


def _search(threshold: float, kind: str):
    def run(batches):
        for batch in batches:
            out = ([], [], [])
            rows = batch.column("rows")
            at, fields = rows.offsets.to_numpy(), rows.values
            ids, n, role = (fields.field(c).to_numpy(zero_copy_only=False) for c in ("id", "n", "role"))
            raw = fields.field("v")
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                first = np.unique(ids[lo:hi], return_index=True)[1] + lo  # repeated rows of one id and vector
                own = np.frombuffer(b"".join(raw[int(i)].as_py() for i in first), kind).reshape(len(first), -1)
                got = block(ids[first], n[first], role[first], own, threshold)
                if got:
                    out[0].extend([got[0], got[2]])
                    out[1].extend([np.full(len(got[0]), -1), got[3]])
                    out[2].extend([got[1], np.zeros(len(got[2]), np.int64)])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).astype(np.int64)) for z in out], names=["a", "b", "n"])

    return run


def blocks(nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows ``(tile, part, other, rows)``: queries are a part of a bin; the first block also holds a part of the next
    bin and compares the queries with one another; further ones hold the other parts of the next bin and the later
    parts of their own."""
    sizes = nodes.groupBy("label", "dim", "bin").agg(F.ceil(F.count("*") / F.lit(float(chunk))).cast("int").alias("parts")).where("parts > 1")
    sizes = cut(sizes)
    few = sizes.count() <= BROADCAST_TILES

    def with_parts(df: DataFrame, step: int, name: str) -> DataFrame:
        near = sizes.select(F.col("label").alias("l_"), F.col("dim").alias("d_"), (F.col("bin") - step).alias("b_"), F.col("parts").alias(name))
        near = F.broadcast(near) if few else near
        return df.join(near, (F.col("label") == F.col("l_")) & (F.col("dim") == F.col("d_")) & (F.col("bin") == F.col("b_")), "left").drop("l_", "d_", "b_").withColumn(name, F.coalesce(name, F.lit(1)))

    rows = with_parts(with_parts(with_parts(nodes, 0, "own"), 1, "after"), -1, "before")
    part = F.pmod(F.xxhash64("id"), F.col("own")).cast("int")
    rows = rows.withColumn("part", part)
    place = lambda bin_, part_, other, role: F.struct(bin_.alias("bin"), part_.alias("part"), other.alias("other"), role.alias("role"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    me, no = F.col("bin"), F.col("part")
    # Others of a query part are numbered: the parts of the next bin, then the later parts of its own bin.
    asks = F.transform(upto(F.col("after") + F.col("own") - 1 - no), lambda k: place(me, no, k, F.when(k == 0, -1).otherwise(0)))
    told = F.transform(upto(F.col("before")), lambda k: place(me - 1, k, no, F.lit(1)))
    beside = F.transform(upto(no), lambda k: place(me, k, F.col("after") + no - k - 1, F.lit(1)))
    sent_rows = rows.withColumn("at", F.explode(F.concat(asks, told, beside))).select("label", "dim", "at.bin", "at.part", "at.other", F.struct("id", "n", F.col("at.role").cast("int").alias("role"), "v").alias("row"))
    return sent_rows.groupBy("label", "dim", "bin", "part", "other").agg(F.collect_list("row").alias("rows")).where(F.size("rows") > 1)


def link_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", chunk: int = CHUNK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row for each row of ``vectors``."""
    rows = pick(vectors, id=id_col, v=vec_col, label=label_col)
    single = isinstance(rows.schema["v"].dataType, T.ArrayType) and isinstance(rows.schema["v"].dataType.elementType, T.FloatType)
    element, kind = ("float", "<f4") if single else ("double", "<f8")
    rows = rows.select(F.col("id").cast("long"), F.col("v").cast(f"array<{element}>"), F.col("label").cast("string"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("v", lambda c: c != 0)
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    hashed = rows.select("id", "v", "label", F.when(fit, F.xxhash64("label", "v")).alias("h"), F.when(fit, F.xxhash64("v", F.lit(7), "label")).alias("g"))
    keyed = hashed.select("id", "h", "g")
    # Copies are collapsed on their hashes; only the vector of the smallest id of each goes on.
    reps = cut(keyed.where(F.col("h").isNotNull()).groupBy("h", "g").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    of = sent(reps.select(F.col("id").alias("i_"), F.col("h").alias("h_"), F.col("g").alias("g_"), "n"))
    lone = hashed.join(of, (F.col("id") == F.col("i_")) & (F.col("h") == F.col("h_")) & (F.col("g") == F.col("g_"))).select("id", "v", "n", "label")
    width = WIDE * math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-5
    shape = T.StructType([T.StructField("id", LONG), T.StructField("v", T.BinaryType()), T.StructField("dim", LONG), T.StructField("bin", LONG), T.StructField("n", LONG), T.StructField("label", T.StringType())])

    def placed(batches):
        for b, done in ((b, next(_bins(width, kind)([b.select(["id", "v", "n"])]))) for b in batches if b.num_rows):
            yield pa.RecordBatch.from_arrays([*done.columns, b.column("label")], names=shape.names)

    nodes = cut(lone.mapInArrow(placed, shape))
    found = cut(blocks(nodes, chunk).select("rows").mapInArrow(_search(threshold, kind), "a long, b long, n long"))
    counts = found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    roots = connected_components(found.where("n = 0")).select(F.col("node").alias("id"), "root")
    of = reps.select("h", "g", "id", "n").join(counts, "id", "left").join(roots, "id", "left")
    of = of.select(F.col("h").alias("_h"), F.col("g").alias("_g"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    out = keyed.join(of, (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"))
