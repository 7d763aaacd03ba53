"""SimHash near-duplicates by tiled exact comparison.

Words are runs of anything but ASCII white space, A-Z lower-cased; shingles of ``k`` words are
hashed with XXH64 (seed 42, further seeds for further 64-bit words of the fingerprint), and a bit of
the fingerprint is one if it is set in over half of the hashes.

Fingerprints are compared exactly, tile against tile, with numpy exclusive-or and bit counts.  A tile
holds fingerprints with the same *skip key*, and tile pairs whose keys rule out a link are never
formed.  For a small radius the key is the bit count of each 16-bit quarter: the sum of the four
differences is a lower bound of the distance.  For similarity links the key is the logarithm of the
shingle count: a similarity of ``s`` bounds the ratio of counts.  Large tiles are split into chunks of
bounded size by a hash, so one crowded key is spread over many tasks.  A tile pair returns minimum
spanning forests of its links, never all of them.

Defined results: null text is like empty text (fingerprint zero, linked like any other); repeated
rows and equal fingerprints share a component; rows with a null id get the component of their
fingerprint; an empty table gives an empty table; other columns are ignored; long texts are read whole, one at a time in a task.
"""

from __future__ import annotations

import itertools
import math
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, cut, pick, schema, sent, unused
from .graph import connected_components

#: Fingerprints in a chunk of a tile: 16 bytes each and an id.
CHUNK = 16_384
#: Tiles of more than one chunk up to which their table is broadcast (some 10 MB), and the salts of a tile beyond it.
BROADCAST_TILES, SALTS = 100_000, 16
#: Shingles whose bits are counted, and links that are looked through, at once.
BLOCK = 1 << 16
#: Shingles in a chunk whose sets are compared: 8 bytes each.
SET_CHUNK = 1 << 20
#: Similarity links: bits that may differ in all and in either half of 128, and the spanning forests that are kept.
RADIUS, HALF, FORESTS = 32, 22, 4


def shingles(text: bytes, k: int) -> list[bytes]:
    w = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if len(w) < k:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False)))


def fingerprint(grams: list[bytes], seed: int = 42) -> int:
    """64 bits; zero without shingles."""
    if not grams:
        return 0
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), grams), np.uint64, len(grams))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), BLOCK):
        part = h[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int, words: int = 1, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """``(id, n, f0, f1, ...)``: shingle count and fingerprint words as signed longs, of all shingles
    with their repeats or of the distinct ones."""
    names = [f"f{i}" for i in range(words)]

    def run(batches):
        for b in batches:
            rows = [[] for _ in range(1 + words)]
            for t in b.column(1).cast(pa.binary()):
                grams = shingles(t.as_py() or b"", k)
                grams = list(set(grams)) if distinct else grams
                rows[0].append(len(grams))
                for i in range(words):
                    rows[1 + i].append(fingerprint(grams, 42 + i))
            cols = [b.column(0), pa.array(rows[0], pa.int64()), *(pa.array(np.array(r, np.uint64).view(np.int64), pa.int64()) for r in rows[1:])]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n", *names])

    src = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("string"))
    return src.mapInArrow(run, schema(id=LONG, n=LONG, **{x: LONG for x in names}))


def _forest(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Indexes of links that make a minimum spanning forest (Kruskal, by distance)."""
    up = list(range(n))
    keep = []
    left = len(np.unique(np.concatenate([i, j])))
    order = np.argsort(d, kind="stable")
    for lo in range(0, len(order), BLOCK):
        at = order[lo : lo + BLOCK]
        root = np.array(up, np.int64)
        while (root[root] != root).any():
            root = root[root]
        up = root.tolist()
        for link in at[root[i[at]] != root[j[at]]].tolist():
            x, y = int(i[link]), int(j[link])
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            while up[y] != y:
                up[y] = up[up[y]]
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
                keep.append(link)
                if len(keep) == left - 1:
                    return np.array(keep, np.int64)
    return np.array(keep, np.int64)


def _thin(n: int, found: list, forests: int, left: np.ndarray | None = None) -> list:
    """The links of ``forests`` spanning forests, each of what the ones before it left, and the number of each link's.

    ``left`` is set at the ends of the links that none of them holds.
    """
    i, j, d = (np.concatenate([x[c] for x in found]) for c in range(3))
    rest, kept, no = np.arange(len(i)), [], []
    for f in range(forests):
        own = _forest(n, i[rest], j[rest], d[rest]) if len(rest) else rest
        kept.append(rest[own])
        no.append(np.full(len(own), f, np.int64))
        rest = np.delete(rest, own)
    if left is not None:
        left[i[rest]] = left[j[rest]] = True
    kept = np.concatenate(kept)
    return [(i[kept], j[kept], d[kept], np.concatenate(no))]


def near(a: list[np.ndarray], b: list[np.ndarray], radius: int, same: bool, rows: int = 128, part: int | None = None):
    """All links between two chunks (lists of fingerprint words), some rows of ``a`` at a time: indexes into a, b and distances.

    Words link at ``radius`` or fewer differing bits in all and, where ``part`` is given, as many in each word.
    """
    part = radius if part is None else part
    for at in range(0, len(a[0]), rows):
        lo = at if same else 0
        d = np.bitwise_count(a[0][at : at + rows, None] ^ b[0][None, lo:])
        x, y = np.nonzero(d <= min(part, radius))
        if same:
            up = x < y
            x, y = x[up], y[up]
        d = d[x, y].astype(np.int64)
        y = y + lo
        for u, v in zip(a[1:], b[1:], strict=True):
            more = np.bitwise_count(u[at + x] ^ v[y])
            d += more
            close = (d <= radius) & (more <= part)
            x, y, d = x[close], y[close], d[close]
        if len(x):
            yield x + at, y, d


def compare(a: list[np.ndarray], b: list[np.ndarray], radius: int, same: bool, rows: int = 128, most: int = 1 << 20, forests: int = 1, part: int | None = None, left: np.ndarray | None = None):
    """Spanning links between two chunks, of those that ``near`` finds: indexes into a, b, distances and forest numbers.

    ``left``, false for each row of ``a`` and, in another chunk, ``b``, is set at the ends of links in no forest.
    """
    na, nb = len(a[0]), len(b[0])
    off = 0 if same else na
    found, held = [], 0
    for x, y, d in near(a, b, radius, same, rows, part):
        found.append((x, y + off, d))
        held += len(x)
        if held > most:  # thin what is held, so memory follows the chunk and not its links
            found = _thin(na + nb, found, forests, left)
            held = len(found[0][0])
    if not found:
        return None
    i, j, d, f = _thin(na + nb, found, forests, left)[0]
    return i, j - off, d, f


def _split(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """``nodes`` with the ``part`` of their tile.  Only tiles above one chunk are looked up, so no row moves to its
    tile's other rows before it has a part: their table is broadcast once it is counted, or joined by tile and salt."""
    large = sizes.where("parts > 1")
    if large.count() <= BROADCAST_TILES:
        known = nodes.join(F.broadcast(large), "tile", "left")
    else:
        salts = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        known = nodes.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SALTS)).cast("int")).join(salts, ["tile", "salt"], "left").drop("salt")
    return known.withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def tile_pairs(nodes: DataFrame, payload: list[str], others, chunk: int = CHUNK, load=None) -> DataFrame:
    """``(same, a_<payload>..., b_<payload>...)``: the columns of two chunks as arrays, for each pair to compare.

    ``nodes`` has ``id``, a struct ``tile`` and the payload; ``others`` makes of a tile the array of
    itself and the tiles to compare it with, of which only one names the other.  A chunk holds about
    ``chunk`` rows, or as much of the aggregate ``load``.
    """
    tile = F.col("tile")
    sizes = cut(nodes.groupBy("tile").agg(F.ceil((F.count("*") if load is None else load) / F.lit(float(chunk))).cast("int").alias("parts")))
    packed = cut(_split(nodes, sizes).groupBy("tile", "part").agg(F.collect_list(F.struct(*payload)).alias("rows")))
    heads = packed.select("tile", "part", F.explode(others(tile)).alias("tile2"))
    pairs = heads.join(sizes.select(tile.alias("tile2"), "parts"), "tile2").select("tile", "part", "tile2", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part2"))
    same = tile == F.col("tile2")
    pairs = pairs.where(~same | (F.col("part2") >= F.col("part"))).withColumn("same", same & (F.col("part2") == F.col("part")))
    a = packed.select("tile", "part", *[F.col(f"rows.{c}").alias(f"a_{c}") for c in payload])
    b = packed.select(tile.alias("tile2"), F.col("part").alias("part2"), *[F.col(f"rows.{c}").alias(f"b_{c}") for c in payload])
    return pairs.join(a, ["tile", "part"]).join(b, ["tile2", "part2"]).select("same", *[f"{s}_{c}" for s in "ab" for c in payload])


def pair_rows(batch: pa.RecordBatch):
    """For each row of ``tile_pairs``: whether the chunks are one, and the arrays of both by name."""
    at = {}
    for c in batch.schema.names[1:]:
        col = batch.column(c)
        values = col.values
        at[c] = (col.offsets.to_numpy(), values.to_numpy(zero_copy_only=False))
    for r, same in enumerate(batch.column(0).to_pylist()):
        yield same, {c: v[o[r] : o[r + 1]] for c, (o, v) in at.items()}


def tile_links(nodes: DataFrame, words: int, radius: int, others, chunk: int = CHUNK, forests: int = 1, part: int | None = None, rest: bool = False) -> DataFrame:
    """Spanning links ``(a, b, d, forest)`` between rows ``(id, tile, f0, ...)`` of tiles that ``others`` pairs; ids are unique and not null.

    With ``rest`` also ``(a, null, null, null)`` for each end of a link that is in no forest.
    """
    names = [f"f{i}" for i in range(words)]

    def run(batches):
        for batch in batches:
            out, ends = ([], [], [], []), []
            for same, x in pair_rows(batch):
                ids = np.concatenate([x["a_id"], x["b_id"]])
                left = np.zeros(len(ids), bool) if rest else None
                got = compare(*([x[f"{s}_{c}"].view(np.uint64) for c in names] for s in "ab"), radius, same, forests=forests, part=part, left=left)
                if rest:
                    ends.append(ids[left])
                if got is not None:
                    for o, v in zip(out, (x["a_id"][got[0]], x["b_id"][got[1]], *got[2:]), strict=True):
                        o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["a", "b", "d", "forest"])
            if ends:
                a = pa.array(np.unique(np.concatenate(ends)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([a, *[pa.nulls(len(a), pa.int64())] * 3], names=["a", "b", "d", "forest"])

    return tile_pairs(nodes, ["id", *names], others, chunk).mapInArrow(run, schema(a=LONG, b=LONG, d=LONG, forest=LONG))


def steps(offsets: list[int]):
    """Tiles of one number and those that are ``offsets`` away."""
    return lambda tile: F.array(*[F.struct((tile["t"] + F.lit(o)).cast("long").alias("t")) for o in offsets])


def count_offsets(radius: int, base: int = 32) -> list[int]:
    """Steps between packed bit counts of four quarters that a distance of ``radius`` allows, one of each opposite pair."""
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    return [sum(x * base**i for i, x in enumerate(d)) for d in steps if d >= (0, 0, 0, 0)]


def bit_tile(col: str = "f0", base: int = 32):
    parts = [F.bit_count(F.shiftright(F.col(col), 16 * i).bitwiseAND(F.lit(0xFFFF))) * F.lit(base**i) for i in range(4)]
    return (parts[0] + parts[1] + parts[2] + parts[3]).cast("long")


def simhash_components(docs: DataFrame, k: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, f0, component)``: fingerprints link at ``radius`` or fewer differing bits; a component is
    named by its smallest id."""
    prints = cut(fingerprints(docs, k, 1, id_col, text_col))
    nodes = prints.groupBy("f0").agg(F.min("id").alias("least"))
    # The fingerprint itself is the node: unique, never null.
    links = tile_links(nodes.select(F.col("f0").alias("id"), "f0", F.struct(bit_tile().alias("t")).alias("tile")), 1, radius, steps(count_offsets(radius)))
    roots = connected_components(links).select(F.col("node").alias("f0"), "root")
    placed = nodes.join(roots, "f0", "left").select("f0", "least", F.coalesce("root", "f0").alias("root"))
    names = placed.groupBy("root").agg(F.min("least").alias("component"))
    of = placed.join(names, "root").select(F.col("f0").alias("f"), "component")
    return prints.join(of, F.col("f0") == F.col("f")).select("id", "n", "f0", "component")


def _hash_sets(k: int):
    def run(batches):
        for b in batches:
            sets = [np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles(t.as_py() or b"", k)), np.uint64)).tobytes() for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["id", "s"])

    return run


def _verify(least: float):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return run


def _open(names: list[str], radius: int, part: int):
    """Ids of the ends of links between rows of different groups."""

    def run(batches):
        for batch in batches:
            ids = []
            for same, x in pair_rows(batch):
                for i, j, _ in near(*([x[f"{s}_{c}"].view(np.uint64) for c in names] for s in "ab"), radius, same, part=part):
                    apart = x["a_root"][i] != x["b_root"][j]
                    ids += [np.unique(x["a_id"][i[apart]]), np.unique(x["b_id"][j[apart]])]
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(ids)).astype(np.int64))], names=["id"])

    return run


def similar(names: list[str], radius: int, part: int, least: float, same: bool, x: dict):
    """``(i, j)``: links between two chunks that join groups and whose sets are similar.  Each link of two groups that
    the ones before it did not join is looked at, on the exact sets."""
    sets = [np.frombuffer(v, np.uint64) for v in x["a_s"]] + ([] if same else [np.frombuffer(v, np.uint64) for v in x["b_s"]])
    size = np.array([len(v) for v in sets], np.int64)
    known, place = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(place, np.cumsum(size)[:-1])
    roots, group = np.unique(np.concatenate([x["a_root"], *([] if same else [x["b_root"]])]), return_inverse=True)
    off = 0 if same else len(x["a_s"])
    label = np.arange(len(roots))  # of each group: the group it is in by now
    has = np.zeros(len(known), bool)
    for i, j, _ in near(*([x[f"{s}_{c}"].view(np.uint64) for c in names] for s in "ab"), radius, same, part=part):
        j = j + off
        can = (np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j])) & (np.minimum(size[i], size[j]) > 0)
        i, j = i[can], j[can]
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
        for at, end in itertools.pairwise([*starts, len(i)]):
            one, ys = int(i[at]), j[at:end]
            ys = ys[label[group[ys]] != label[group[one]]]
            has[own[one]] = True
            for lo in range(0, len(ys), 256):
                some = ys[lo : lo + 256]
                some = some[label[group[some]] != label[group[one]]]
                if not len(some):
                    continue
                both = np.add.reduceat(has[np.concatenate([own[y] for y in some])], np.r_[0, np.cumsum(size[some])[:-1]], dtype=np.int64)
                for y in some[both >= least * (size[some] + size[one] - both)].tolist():
                    u, v = label[group[one]], label[group[y]]
                    if u != v:
                        label[label == v] = u
                        yield one, y - off
            has[own[one]] = False


def _similar(names: list[str], radius: int, part: int, least: float):
    def run(batches):
        for batch in batches:
            out = [(x["a_id"][i], x["b_id"][j]) for same, x in pair_rows(batch) for i, j in similar(names, radius, part, least, same, x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, component)`` of documents that have a near copy: word shingles of ``k`` words whose sets
    have a Jaccard similarity of ``similarity`` or more.

    128-bit fingerprints propose links (``RADIUS`` of 128 bits, ``HALF`` of either 64: similar pairs at
    0.8 differ in 19.4 bits on average, unrelated ones in 64), which are verified on the exact shingle
    sets.  Of the links of a tile pair, ``FORESTS`` spanning forests are verified first: those of the first
    all, those of the others where their ends are not in one group yet.  Then every other proposed link
    whose ends are still in different groups is verified, chunk against chunk with the sets of the
    documents that have one, so a true link is found however many false ones are nearer.
    Documents with equal fingerprints and counts are copies.  Rows without an id are left out.
    """
    prints = cut(fingerprints(docs, k, 2, id_col, text_col, distinct=True).where(F.col("id").isNotNull()))
    same = ["n", "f0", "f1"]
    nodes = cut(prints.groupBy(*same).agg(F.min("id").alias("id")))
    step = -math.log(similarity) + 1e-9
    tile = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.lit(step)).cast("long")
    nodes = nodes.withColumn("tile", F.struct(tile.alias("t")))
    links = cut(tile_links(nodes, 2, RADIUS, steps([0, 1]), forests=FORESTS, part=HALF, rest=True).select("a", "b", "forest"))
    left = links.where("b IS NULL").select(F.col("a").alias("id")).distinct()
    links = links.where("b IS NOT NULL")
    src = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("string"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        return src.join(sent(wanted), "id", "left_semi").mapInArrow(_hash_sets(k), schema(id=LONG, s=T.BinaryType()))

    def verified(links: DataFrame) -> DataFrame:
        sets = sets_of(links.select(F.col("a").alias("id")).union(links.select("b")).distinct())
        first, second = (sets.select(F.col("id").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
        return links.join(first, "a").join(second, "b").select("a", "b", "sa", "sb").mapInArrow(_verify(similarity), schema(a=LONG, b=LONG))

    sure = cut(verified(links.where("forest = 0")))
    roots = connected_components(sure)
    first, second = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    open_ = links.where("forest > 0").join(first, "a", "left").join(second, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    more = cut(verified(cut(open_.select("a", "b").distinct())))
    if more.take(1):
        sure = cut(sure.union(more))
        roots = connected_components(sure)
    names, gone = ["f0", "f1"], left.take(1)
    if gone:
        placed = nodes.join(left, "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        placed = cut(placed.select("id", "tile", "n", *names, "root"))
        apart = cut(tile_pairs(placed, ["id", *names, "root"], steps([0, 1])).mapInArrow(_open(names, RADIUS, HALF), schema(id=LONG)).distinct())
        gone = apart.take(1)
    if gone:
        held = placed.join(sets_of(apart).distinct(), "id")
        pairs = tile_pairs(held, ["id", *names, "root", "s"], steps([0, 1]), SET_CHUNK, F.sum(F.greatest("n", F.lit(1))))
        last = cut(pairs.mapInArrow(_similar(names, RADIUS, HALF, similarity), schema(a=LONG, b=LONG)))
        roots = connected_components(sure.union(last))
    roots = roots.select(F.col("node").alias("least"), "root")
    of = nodes.withColumnRenamed("id", "least").join(roots, "least", "left").select(*same, F.coalesce("root", "least").alias("component"))
    on = [F.col(c) == F.col(f"of_{c}") for c in same]
    return prints.join(of.select(*[F.col(c).alias(f"of_{c}") for c in same], "component"), on).select("id", "component")


def drop_near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document has the smallest id of its group, all columns as they are.

    Rows that share an id are one document and stay or go together; rows without an id stay.
    """
    of = near_duplicates(docs, k, similarity, id_col, text_col)
    (name,) = unused(docs, "_gone")
    gone = sent(of.groupBy("id").agg(F.min("component").alias("c")).where(F.col("id") != F.col("c")).select(F.col("id").alias(name)))
    return docs.join(gone, docs[f"`{id_col}`"] == gone[name], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    of = simhash_components(table(spark, sf_dir, "documents"))
    return of.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
