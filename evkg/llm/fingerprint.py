"""Document fingerprints: a quartile bucket digest.

Every byte of a text, with the two before it (zeros before the first), is hashed into one of ``BUCKETS`` counters.  A
bucket's code, 0 to 3, says how many of the three quartiles of all counts its count exceeds; the digest is the
length code (eight steps a doubling of the bytes) followed by the codes, four a byte, in hexadecimal.  Two digests
differ by the mean difference of their codes plus ``LENGTH_SHARE`` times their difference in length, which counts up to
``LENGTH_REACH`` steps.  Unrelated codes differ by ``UNRELATED`` on average; likeness is one less the
difference over that, and never below zero.

``compare_neighbours`` sets each document against an edited text of it and against the next document.  The table is cut
into ranges of ids at values that occur in it; the first row of a range is also sent to the range before it (that of
all, to the last), so each text is shuffled once, and rows are read in order, one at a time, however large a range is.

Defined results: null text is empty, and equal texts have equal digests (the empty one included, at likeness 1); texts
of any length are read whole, ``PART`` bytes at a time; rows are ordered by id, null first, then by a hash of the text, so
repeated ids and rows are each other's neighbours; the only row of a table is its own neighbour; an empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DBL, LONG, STR, pick, schema, table

BUCKETS = 1024
LENGTH_SHARE, LENGTH_REACH = 0.2, 16
#: The mean difference of two independent codes of 0 to 3.
UNRELATED = 1.25
#: Bytes that are hashed at once.
PART = 1 << 20


def counts(raw: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """How many byte triplets fall in each bucket."""
    out = np.zeros(buckets, np.int64)
    for at in range(0, len(raw), PART):
        s = np.frombuffer(b"\0\0"[at:] + raw[max(0, at - 2) : at + PART], np.uint8).astype(np.uint32)
        h = (s[:-2] << np.uint32(16) | s[1:-1] << np.uint32(8) | s[2:]) * np.uint32(0x9E3779B1)
        h = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA77)
        out += np.bincount((h >> np.uint32(16)) % np.uint32(buckets), minlength=buckets)
    return out


def codes(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """The length code, then the bucket codes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = counts(raw, buckets)
    at = np.array([buckets // 4, buckets // 2, 3 * buckets // 4]) - 1
    quartiles = np.partition(n, at)[at]
    out = np.empty(buckets + 1, np.uint8)
    out[0] = min(255, round(8 * np.log2(len(raw) + 1)))
    out[1:] = (n[:, None] > quartiles).sum(1)
    return out


def digest(c: np.ndarray) -> str:
    four = c[1:].reshape(-1, 4)
    return (bytes([c[0]]) + (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).astype(np.uint8).tobytes()).hex()


def undigest(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.concatenate([raw[:1], np.stack([raw[1:] >> s & 3 for s in (6, 4, 2, 0)], 1).reshape(-1)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal codes, 0 for codes as different as unrelated ones."""
    apart = np.abs(a.astype(np.int16) - b.astype(np.int16))
    return max(0.0, 1 - (float(apart[1:].mean()) + LENGTH_SHARE * min(int(apart[0]), LENGTH_REACH) / LENGTH_REACH) / UNRELATED)


def compare(a: str, b: str) -> float:
    """Likeness of two digests."""
    return likeness(undigest(a), undigest(b))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, fingerprint)`` of each row."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array((digest(codes(t)) for t in texts), pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    src = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("string"))
    return src.mapInArrow(run, schema(doc_id=LONG, n_chars=LONG, fingerprint=STR))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = schema(doc_id=LONG, n_chars=LONG, edited_sha256=STR, fingerprint=STR, edited_fingerprint=STR, near_edited=DBL, near_next=DBL)


def in_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(range, guest, id, text)`` in order: each range of ids in one partition, followed by the row that comes next."""
    first = -(1 << 63)  # the place of a null id
    src = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("id", F.lit(first))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marks = src.agg(F.percentile_approx(key, [i / n for i in range(n)], max(10_000, 100 * n)).alias("at"), F.min(key).alias("least")).head()
    # Where ranges begin: as many ids as there are partitions, all of them ids of the table.
    begins = sorted({*(marks["at"] or ()), marks["least"]}) if marks["least"] is not None else [first]
    later = F.array(*[F.lit(x).cast("long") for x in begins[1:]]).cast("array<long>")
    own = F.size(F.filter(later, lambda x: x <= key)).alias("range")
    before = F.when(key == begins[0], F.lit(len(begins) - 1)).when(F.array_contains(later, key), own - 1)
    dealt = F.array_compact(F.array(F.struct(own, F.lit(0).alias("guest")), F.when(before.isNotNull(), F.struct(before.alias("range"), F.lit(1).alias("guest")))))
    rows = src.select(F.explode(dealt).alias("to"), "id", "text").select("to.range", "to.guest", "id", "text", F.xxhash64("text").alias("h"))
    return rows.repartitionById(len(begins), F.col("range").cast("int")).sortWithinPartitions("range", "guest", F.col("id").asc_nulls_first(), "h").drop("h")


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``OUT``: each document's digest, that of its edited text, and its likeness to that and to the next document."""

    def judged(now, then):
        """One row: ``now`` and ``then`` are (id, text, codes) of a document and of the next one."""
        changed = edited(now[1], then[1])
        c = codes(changed)
        return now[0], len(now[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), digest(now[2]), digest(c), likeness(now[2], c), likeness(now[2], then[2])

    def run(batches):
        held = None
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part, out = b.slice(at, 512), []
                for guest, i, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if guest and held is None:
                        continue  # only the first guest of a range follows its last row
                    row = (i, text, codes(text))
                    if held is not None:
                        out.append(judged(held, row))
                    held = None if guest else row
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(ARROW)], names=ARROW.names)

    return in_ranges(docs, id_col, text_col).mapInArrow(run, OUT)


ARROW = pa.schema([(f.name, {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.dataType.simpleString()]) for f in OUT])


def query(spark, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents"))
