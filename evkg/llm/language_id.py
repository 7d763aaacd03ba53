"""Language ID by prediction by partial matching over bytes.

For each language a tree of byte contexts, of order 0 to ``ORDER``, is counted on a bounded sample of its
labelled texts (A-Z lower-cased).  A byte that a context has not seen costs an escape and is coded by the next shorter
context, with the bytes already seen excluded (escape method C); below order 0 all 256 bytes are equally
likely.  Contexts of more than ``WHOLE`` bytes that were seen only once are pruned.  The statistics are then frozen:
the exact code length of each string in a tree, and the cost of leaving each context, are sorted arrays.  A text
costs the sum over its bytes: the longest string ending there that a tree holds, and the escapes of the longer
contexts.  The cheapest language wins; its score is its posterior probability when all languages are
equally likely beforehand.

The arrays of ``BLOCK`` languages are merged, so a string is looked up once for all of them: 8 bytes and 4 a language for
each string of the block; memory grows in proportion to the number of languages.  Every label is learned, from
``PER_LANGUAGE`` pieces of its texts at most: a text of over ``MOST_CHARS`` characters makes several pieces, each of which
may be drawn.  A block is trained in one task and kept in a file that executors fetch.

Defined results: null text, or text without a letter, is ``und`` with score 0; so is all text if
nothing is labelled; ties go to the alphabetically first language; of several texts of one id and label that with
the smallest hash is learned from; texts are judged whole; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import DBL, LONG, STR, drawn, pick, pieces_of, schema, stored, table

ORDER, WHOLE = 4, 2
#: At most so many pieces of labelled documents of a language are fitted, those with the smallest hashes, of so many characters.
PER_LANGUAGE, MOST_CHARS = 300, 20_000
#: Languages whose arrays are merged.
BLOCK = 16
LETTER = re.compile(r"[^\W\d_]")
#: Bytes that are judged at once.
PART = 1 << 20


def keys(text: bytes, order: int = ORDER) -> np.ndarray:
    """For each byte the number that it and the ``order`` bytes before it make; a text begins after blanks."""
    s = np.frombuffer(b" " * order + text.lower(), np.uint8).astype(np.int64)
    at = np.zeros(len(s) - order, np.int64)
    for i in range(order + 1):
        at = (at << 8) | s[i : len(s) - order + i]
    return at


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``known``, and whether they are there."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


class Trees:
    """Levels by order: sorted strings of order + 1 bytes with their bits by language, sorted contexts with the bits
    of leaving them.  A context that a language lacks costs it nothing."""

    def __init__(self, width: int, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.width, self.levels = width, levels

    def bits(self, strings: np.ndarray, order: int) -> np.ndarray:
        """Bits of the last byte after the ones before it, by language."""
        out = np.zeros((len(strings), self.width))
        left = np.arange(len(strings))
        for k in range(min(order, len(self.levels) - 1), -1, -1):
            known, cost, contexts, leave = self.levels[k]
            own = strings[left] & ((1 << 8 * (k + 1)) - 1)
            at, there = _find(known, own)
            out[left[there]] += cost[at[there]]
            left, own = left[~there], own[~there]
            at, there = _find(contexts, own >> 8)
            out[left[there]] += leave[at[there]]
        out[left] += 8.0
        return out


def tree(texts: list[bytes], order: int = ORDER, whole: int = WHOLE) -> Trees:
    """The context tree of one language."""
    every = np.concatenate([keys(t, order) for t in texts]) if texts else np.zeros(0, np.int64)
    out = Trees(1, [])
    for k in range(order + 1):
        strings, n = np.unique(every & ((1 << 8 * (k + 1)) - 1), return_counts=True)
        if k > whole:
            ctx, place = np.unique(strings >> 8, return_inverse=True)
            total = np.bincount(place, n, len(ctx))
            strings, n = strings[total[place] > 1], n[total[place] > 1]
        ctx, place = np.unique(strings >> 8, return_inverse=True)
        total, kinds = np.bincount(place, n, len(ctx)), np.bincount(place, minlength=len(ctx))
        lower = np.exp2(-out.bits(strings, k - 1)[:, 0])
        full = kinds == 256
        cost = -np.log2(n / (total + np.where(full, 0, kinds))[place])
        rest = np.maximum(1 - np.bincount(place, lower, len(ctx)), 1e-300)  # what the excluded bytes leave
        leave = np.where(full, 0.0, -np.log2(kinds / (total + kinds)) + np.log2(rest))
        out.levels.append((strings, cost[:, None], ctx, leave[:, None]))
    return out


def merge(trees: list[Trees]) -> Trees:
    """One tree with the bits of all languages at each string and context that any of them has."""
    levels = []
    for k in range(max((len(t.levels) for t in trees), default=0)):
        strings = np.unique(np.concatenate([t.levels[k][0] for t in trees]))
        contexts = np.unique(np.concatenate([t.levels[k][2] for t in trees]))
        leave = np.zeros((len(contexts), len(trees)), np.float32)
        for i, t in enumerate(trees):
            leave[np.searchsorted(contexts, t.levels[k][2]), i] = t.levels[k][3][:, 0]
        cost = np.stack([t.bits(strings, k)[:, 0] for t in trees], 1).astype(np.float32)
        levels.append((strings, cost, contexts, leave))
    return Trees(len(trees), levels)


def train(rows: list[tuple[str, bytes]]):
    """``(languages, trees)`` or None."""
    rows = sorted(rows)
    langs = sorted({k for k, _ in rows})
    return (langs, merge([tree([t for k, t in rows if k == lang]) for lang in langs])) if langs else None


def costs(texts: list[bytes], trees: Trees) -> np.ndarray:
    """Bits of each text by language; each distinct string of a part is looked up once."""
    total = np.zeros((len(texts), trees.width))
    held, size = [], 0

    def judge():
        code, distinct = pd.factorize(np.concatenate([k for _, k in held]))
        bits = trees.bits(distinct, ORDER)[code]
        starts = np.cumsum([0] + [len(k) for _, k in held[:-1]])
        np.add.at(total, [i for i, _ in held], np.add.reduceat(bits, starts))

    for i, text in enumerate(texts):
        for at in range(0, len(text), PART):
            head = max(0, at - ORDER)
            held.append((i, keys(text[head : at + PART])[at - head :]))
            size += len(held[-1][1])
            if size >= PART:
                judge()
                held, size = [], 0
    if held:
        judge()
    return total


def predict(texts: list[str | None], models: list) -> list[tuple[str, float]]:
    """Language and score of each text, by models of blocks of languages."""
    models = sorted((m for m in models if m is not None), key=lambda m: m[0])
    out = [("und", 0.0)] * len(texts)
    asked = [i for i, t in enumerate(texts) if t and models and LETTER.search(t)]
    if asked:
        raw = [texts[i].encode("utf-8", "surrogatepass") for i in asked]
        langs, c = [lang for m in models for lang in m[0]], np.concatenate([costs(raw, m[1]) for m in models], 1)
        best = c.argmin(1)
        p = 1 / np.exp2(np.clip(c.min(1, keepdims=True) - c, -1000, 0)).sum(1)
        for i, b, s in zip(asked, best.tolist(), p.tolist(), strict=True):
            out[i] = (langs[b], s)
    return out


def fit(train_on: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most: int = MOST_CHARS):
    """The models of all blocks, as a broadcast variable that names their files."""
    known = pick(train_on, id=id_col, text=text_col, lang=lang_col).where("text IS NOT NULL AND lang IS NOT NULL").select("id", F.col("text").cast("string"), F.col("lang").cast("string"))
    some = drawn(pieces_of(known, most), known.select("id", "text"), "lang", per_language, most)
    langs = known.select("lang").distinct().select("lang", F.floor((F.row_number().over(Window.orderBy("lang")) - 1) / F.lit(BLOCK)).alias("block"))  # one row a label

    def run(rows: pa.Table) -> pa.Table:
        learned = zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist(), strict=True)
        return pa.table({"model": pa.array([pickle.dumps(train([(k, t.encode("utf-8", "surrogatepass")) for k, t in learned]))], pa.binary())})

    return stored(some.join(F.broadcast(langs), "lang").groupBy("block").applyInArrow(run, "model binary"))


def identify(docs: DataFrame, train_on: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """``(doc_id, lang_pred, score)``; learns from the texts and labels of ``train_on`` alone."""
    sent = fit(train_on, id_col, text_col, lang_col, per_language)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                got = predict(part.column(1).to_pylist(), sent.value.open())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    src = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return src.mapInArrow(run, schema(doc_id=LONG, lang_pred=STR, score=DBL))


def fold(id_col: str, n: int):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, docs.where(fold("doc_id", 4) != 2))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
