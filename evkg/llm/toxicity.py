"""Toxicity by class-conditional Kneser-Ney models.

Two language models, of toxic and of ordinary text, are counted on a bounded sample of labelled
documents.  A word's probability discounts its own count in the class and gives what is left to a
character model of the class; that one discounts strings of four and three characters and backs off to
continuation counts which both classes share.  So a rare or unseen expression is judged by the strings it
is made of, and what neither class knows cancels out.

A word is spelt along a tree of word beginnings as far as that goes, then by the character model.  A document is judged by the log-likelihood ratios of its three highest words (distinct ones, each
up to ``HIGHEST``) and by the ratio of the whole text over its length; a logistic curve, fitted on parts of
the sample that the models have not counted, turns these four into a probability.

Defined results: null text is empty; a text without a word has the score of zeros; labels other than
0 and 1 are ignored, of several labels of one document the highest counts and of several texts of one id that
with the smallest hash; without both classes every score is 0; texts are judged whole (of longer ones than ``MOST_CHARS``
pieces are learned from); an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DBL, LONG, drawn, pick, pieces_of, schema, stored, table
from .language_id import fold

SYMBOLS = 40
WORD = re.compile(r"[^\W\d_]+")
END = re.compile(r"[.!?\n]+")
#: At most so many pieces of labelled documents of each class are fitted, those with the smallest hashes, of so many characters.
PER_CLASS, MOST_CHARS = 3_000, 100_000
DISCOUNT = 0.75
#: What is taken from a word's count; over one, so that a word seen once says no more than its spelling.
WORD_DISCOUNT = 1.5
#: Bytes of a word's beginning that are counted.
DEPTH = 8
#: Ratios of so many distinct words are kept by a worker before it begins anew.
KEPT = 250_000
FEATURES = 4


#: A ratio of a word above this says no more than this; part of the model.
HIGHEST = 12.0


def symbol_map(texts: list[bytes], symbols: int) -> np.ndarray:
    """Bytes to symbols: the commonest by themselves, the last symbol for the rest."""
    n = sum(np.bincount(np.frombuffer(t.lower(), np.uint8), minlength=256) for t in texts) + np.zeros(256, np.int64)
    to = np.full(256, symbols - 1, np.uint8)
    common = [b for b in np.argsort(-n, kind="stable").tolist() if n[b]][: symbols - 1]
    to[common] = np.arange(len(common))
    return to


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def strings(ws: list[str], to: np.ndarray, order: int = 3):
    """Numbers of the ``order + 1`` strings of each word, ends included, and where each word begins."""
    raw = np.frombuffer(("\0" * order + ("\0" * order).join(ws) + "\0").encode("utf-8", "surrogatepass"), np.uint8)
    s = np.where(raw == 0, 0, to[raw].astype(np.int32) % (SYMBOLS - 1) + 1)
    at = np.zeros(len(s) - order, np.int32)
    for i in range(order + 1):
        at = at * SYMBOLS + s[i : len(s) - order + i]
    inside = (s[order:] > 0) | (s[order - 1 : -1] > 0)
    first = (s[order:] > 0) & (s[order - 1 : -1] == 0)
    return at[inside], np.flatnonzero(first[inside])


def _discounted(c: np.ndarray, lower: np.ndarray, d: float = DISCOUNT) -> np.ndarray:
    """Kneser-Ney step: ``c`` by context and symbol, ``lower`` already by the same rows."""
    n, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
    return np.where(n > 0, (np.maximum(c - d, 0) + d * kinds * lower) / np.maximum(n, 1), lower)


def char_models(per_class: list[Counter], to: np.ndarray) -> list[np.ndarray]:
    """Log probability of each string's last symbol, for each class."""
    counts = []
    for words_of in per_class:
        c = np.zeros(SYMBOLS**4)
        if words_of:
            ws = sorted(words_of)
            at, first = strings(ws, to)
            size = np.diff(np.append(first, len(at)))
            np.add.at(c, at, np.repeat([words_of[w] for w in ws], size))
        counts.append(c)
    both = (sum(counts) > 0).astype(np.float64)
    # Shared: how many longer strings continue to this one, whatever the class.
    pair = (both.reshape(SYMBOLS, SYMBOLS, SYMBOLS, SYMBOLS).sum(0) > 0).sum(0).astype(np.float64)
    single = (pair > 0).sum(0) + 0.5
    shared = _discounted(pair, np.tile(single / single.sum(), (SYMBOLS, 1)))
    out = []
    for c in counts:
        three = (c.reshape(SYMBOLS, -1) > 0).sum(0).reshape(-1, SYMBOLS).astype(np.float64)  # continuation counts
        p = _discounted(three, np.tile(shared, (SYMBOLS, 1)))
        out.append(np.log(_discounted(c.reshape(-1, SYMBOLS), np.tile(p, (SYMBOLS, 1)))).reshape(-1))
    return out


def sentences(text: str | None) -> list[tuple[str, ...]]:
    return [t for t in (tuple(WORD.findall(x)) for x in END.split(text.lower())) if t] if text else []


class Model:
    """Log-likelihood ratios of words, toxic over ordinary.

    Each distinct sentence of a class counts once, so that copies of a document don't pass for habits.
    A word is spelt along the tree of word beginnings (up to ``DEPTH`` bytes, counted in distinct
    words) as far as it is known, and by the character model from there on.
    """

    def __init__(self, toxic: list[list[tuple[str, ...]]], ordinary: list[list[tuple[str, ...]]]):
        counts = [Counter(w for s in {s for t in texts for s in t} for w in s) for texts in (toxic, ordinary)]
        coded = [[w.encode("utf-8", "surrogatepass") for w in c] for c in counts]
        self.to = symbol_map([w for c in coded for w in c], SYMBOLS - 1)
        chars = char_models([Counter(dict.fromkeys(c, 1)) for c in counts], self.to)
        self.chars = (chars[0] - chars[1]).astype(np.float32)
        self.tree = self._tree(coded, chars)
        known = sorted(set().union(*counts))
        left = [max(1.0, sum(min(n, WORD_DISCOUNT) for n in c.values())) for c in counts]
        self.fresh = float(np.subtract(*[np.log(x / max(1, sum(c.values()))) for x, c in zip(left, counts, strict=True)]))
        self.known: dict[str, float] = {}
        if known:
            spelt = np.exp(self._spell(known, chars))
            total = []
            for k, c in enumerate(counts):
                own = np.array([c[w] for w in known], np.float64)
                total.append(np.log((np.maximum(own - WORD_DISCOUNT, 0) + left[k] * spelt[k]) / max(1, sum(c.values()))))
            self.known = dict(zip(known, (total[0] - total[1]).tolist(), strict=True))
        self.cache = dict(self.known)

    def _tree(self, coded: list[list[bytes]], chars: list[np.ndarray]) -> dict[bytes, tuple]:
        """Beginning to (log probabilities by class, log probabilities of leaving the tree by class)."""
        begun = [Counter(w[:i] for w in ws for i in range(min(DEPTH, len(w)) + 1)) for ws in coded]
        both = begun[0] + begun[1]
        keep = {p for p, n in both.items() if n > 1}
        kids = [Counter(p[:-1] for p in c if p) for c in begun]
        tree: dict[bytes, tuple] = {}
        for p in sorted(keep, key=lambda p: (len(p), p)):
            cum = [0.0, 0.0]
            if p:
                s = [0, 0, 0, *(int(x) % (SYMBOLS - 1) + 1 for x in self.to[np.frombuffer(p, np.uint8)])][-4:]
                at = ((s[0] * SYMBOLS + s[1]) * SYMBOLS + s[2]) * SYMBOLS + s[3]
                up = tree[p[:-1]][0]
                for k in (0, 1):
                    q, n = math.exp(chars[k][at]), begun[k][p[:-1]]
                    step = (max(begun[k][p] - DISCOUNT, 0) + DISCOUNT * max(1, kids[k][p[:-1]]) * q) / n if n else q
                    cum[k] = up[k] + math.log(step)
            leave = [math.log(DISCOUNT * kids[k][p] / begun[k][p]) if kids[k][p] else 0.0 for k in (0, 1)]
            tree[p] = (tuple(cum), tuple(leave))
        return tree

    def _spell(self, ws: list[str], tables: list[np.ndarray]) -> np.ndarray:
        """Log probability of each word by class, without the word counts."""
        at, first = strings(ws, self.to)
        last = np.append(first[1:], len(at))
        tree, depth, base = self.tree, np.zeros(len(ws), np.int64), np.zeros((2, len(ws)))
        for i, w in enumerate(ws):
            w = w.encode("utf-8", "surrogatepass")
            for k in range(min(DEPTH, len(w)), -1, -1):
                got = tree.get(w[:k])
                if got:
                    depth[i] = k
                    out = k < min(DEPTH, len(w))
                    base[:, i] = got[0][0] + out * got[1][0], got[0][1] + out * got[1][1]
                    break
        for k, t in enumerate(tables):
            sums = np.concatenate([[0.0], np.cumsum(t[at], dtype=np.float64)])
            base[k] += sums[last] - sums[first + depth]
        return base

    def learn(self, fresh: list[str]) -> None:
        """Ratios of words that the sample has not shown."""
        if fresh:
            spelt = self._spell(fresh, [self.chars])
            self.cache.update(zip(fresh, (spelt[0] - spelt[1] + self.fresh).tolist(), strict=True))

    def features(self, texts: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(texts), FEATURES))
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            if len(self.cache) > KEPT + len(self.known):
                self.cache = dict(self.known)
            self.learn(sorted(set().union(*part) - self.cache.keys()))
            get = self.cache.__getitem__
            for i, t in enumerate(part):
                if t:
                    top = [0.0, 0.0, 0.0, *sorted(map(get, set(t)))[-3:]]
                    r = np.fromiter(map(get, t), np.float64, len(t))
                    out[at + i] = *(min(x, HIGHEST) for x in top[-3:]), 20 * r.sum() / (sum(map(len, t)) + len(t))
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 60):
    """Weights and scales of a logistic curve over standardised features."""
    mid, dev = x.mean(0), x.std(0) + 1e-6
    z = np.concatenate([(x - mid) / dev, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    keep = np.array([ridge] * (z.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (p - y) + keep * w)
        w = w - step / max(1.0, float(np.abs(step).max()) / 2)
    return w, mid, dev


def train(rows: list[tuple[str, int]]):
    """Model and curve, or None without both classes."""
    rows = sorted(set(rows))
    one: dict[str, str] = {}  # a word that occurs again is held once
    texts, y = [[tuple(one.setdefault(w, w) for w in s) for s in sentences(t)] for t, _ in rows], np.array([k for _, k in rows])
    if len(rows) == 0 or min((y == 1).sum(), (y == 0).sum()) < 4:
        return None
    part = np.array([hashlib.md5(t.encode("utf-8", "surrogatepass")).digest()[0] % 2 for t, _ in rows])
    x = np.zeros((len(rows), FEATURES))
    for k in (0, 1):  # each half is judged by models of the other
        rest, own = part != k, np.flatnonzero(part == k)
        by = Model(*[[t for t, m in zip(texts, rest & (y == c), strict=True) if m] for c in (1, 0)])
        x[own] = by.features([[w for s in texts[i] for w in s] for i in own])
    w, mid, dev = logistic(x, y.astype(np.float64))
    return Model(*[[t for t, c in zip(texts, y, strict=True) if c == k] for k in (1, 0)]), w, mid, dev


def score(models: list, texts: list[str | None]) -> np.ndarray:
    model = next(iter(models), None)  # none of no rows
    if model is None:
        return np.zeros(len(texts))
    by, w, mid, dev = model
    x = by.features([words(t) for t in texts])
    return 1 / (1 + np.exp(-np.clip((x - mid) / dev @ w[:-1] + w[-1], -30, 30)))


def sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, most: int = MOST_CHARS) -> DataFrame:
    """``(text, y)`` of the labelled documents that are learned from; drawn among the labels that have a document."""
    marks = pick(labels, id=id_col, y=label_col).where("y IN (0, 1) AND id IS NOT NULL").groupBy(F.col("id").cast("long").alias("id")).agg(F.max(F.col("y").cast("int")).alias("y"))
    src = pick(docs, id=id_col, text=text_col).where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return drawn(pieces_of(src, most).join(marks, "id"), src, "y", per_class, most).select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS):
    """A model from the labelled documents, as a broadcast variable that names its file.  The bounded sample meets in
    one task, which trains and writes the model to the shared folder, where executors fetch it: it is many times
    its size in the driver's memory when collected, so the driver holds neither texts nor counts nor the model."""

    def run(batches):
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows))], pa.binary())], names=["model"])

    return stored(sampled(docs, labels, id_col, text_col, label_col, per_class).repartition(1).mapInArrow(run, "model binary"))


def scores(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for each row of ``docs``."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                p = score(model.value.open(), b.column(1).slice(at, 512).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 512), pa.array(p, pa.float64())], names=["doc_id", "score"])

    src = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return src.mapInArrow(run, schema(doc_id=LONG, score=DBL))


def drop_toxic(docs: DataFrame, model, text_col: str = "text", at: float = 0.5) -> DataFrame:
    """The rows whose score is below ``at``, all columns as they are."""
    place = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield part.filter(pa.array(score(model.value.open(), part.column(place).to_pylist()) < at))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    out = scores(docs, fit(docs, labels.where(fold("doc_id", 5) != 0)))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
