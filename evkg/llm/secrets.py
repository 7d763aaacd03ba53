"""Secret scans: base rules, and a character convolutional network over every other candidate.

One pass over the whole texts finds the base spans and the candidates (token-like runs of ``LEAST_RUN``
or more characters) with the characters around them.  Networks are trained here, in numpy, on all distinct
findings and runs: these are dealt to shards by hash, each shard makes a pass over its own, the networks of the
shards are averaged (weights and moments of Adam) and the next of ``PASSES`` passes starts there.  Positives are the
base findings with what the rules look for taken away (the keyword and sign before a value, the fixed prefix of an
access key), as they stand and as the same bytes written in other alphabets, so what is left to learn is how a
secret looks.  Negatives are runs at least ``FAR`` characters from any base span.  Each kind of finding, or each
part where one kind is all there is, is judged by a network that has not seen it; on those outputs, of all rows,
the curve (Platt) is fitted and the threshold is the highest that keeps the wanted recall.  Every candidate that no
base span touches is then read by a network that learned from all positives and from all negatives but those of
its part, as a secret without a rule is among the negatives; those above the threshold are spans of kind ``cnn``;
base spans stay.

Defined results: null text is empty; an empty table gives an empty one; repeated rows are scanned
each; texts and candidates of any length are read whole (long candidates in overlapping windows, of
which the highest score counts; all are fitted, with the weight of one run together); other columns are
ignored.  Below 8 positives or negatives nothing is added.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DBL, LONG, STR, cut, pick, schema, table

#: The base rules and the least lengths of what they must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the same as all runs, less those that are short
KINDS = ("assign", "access", "hex")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
#: Least characters of a run that is a candidate.
LEAST_RUN = 12
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{%d,}" % LEAST_RUN)

AROUND = 24
WINDOW = 96
#: Characters between a negative and the next base span, at least.
FAR = 64
#: Windows of a chunk, at least, and runs of a shard, at least; no more shards than so many, which then grow.
CHUNK = 4_096
MOST_SHARDS = 128
#: Passes over all rows; fewer than ``FEW`` rows are passed more often, up to the second number.
PASSES, MOST_PASSES, FEW = 4, 16, 65_536
#: Rows of one step, at most.
MOST_BATCH = 512
#: Parts of the negatives; each is judged by a network that learned from the others.
PARTS = 4
RECALL = 0.98


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` sorted by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _join(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def findings(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, str, str, int]]:
    """``(left, body, right, kind)`` of base findings without what their rule looks for; a run of hex digits
    counts from 20 characters on, where it is no number of a card, and once."""
    out, until = [], -1
    for s, k, e in spans:
        at = ASSIGN.match(text, s).start(2) if k == 0 else s + 4 if k == 1 else s
        if at >= until and (k < 2 or e - s >= 20):
            out.append((text[max(0, s - AROUND) : s], text[at:e], text[e : e + AROUND], k))
            until = e
    return out


def others(text: str, spans: list[tuple[int, int, int]]):
    """``(start, end, far)`` of the runs that no base span touches."""
    i = 0
    until = -FAR  # end of the base spans that begin before the run
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while i < len(spans) and spans[i][0] < e:
            until = max(until, spans[i][2])
            i += 1
        if until <= s:
            yield s, e, s - until >= FAR and (i == len(spans) or spans[i][0] - e >= FAR)


_RUN = [("start", pa.int64()), ("end", pa.int64()), ("left", pa.string()), ("body", pa.string()), ("right", pa.string()), ("kind", pa.int64())]
_RUN_SPARK = T.StructType([T.StructField(n, LONG if t == pa.int64() else STR) for n, t in _RUN])
_FOUND = T.StructType([T.StructField("doc_id", LONG), T.StructField("base", STR), T.StructField("runs", T.ArrayType(_RUN_SPARK))])


def _scan(batches):
    """Base spans, findings (by kind) and other runs (kind -1, or -2 where a base span is near)."""
    for b in batches:
        base, runs = [], []
        for t in b.column(1):
            text = t.as_py() or ""
            spans = base_spans(text)
            base.append(_join((s, KINDS[k], e) for s, k, e in spans))
            own = [dict(zip("start end left body right kind".split(), (-1, -1, *f), strict=True)) for f in findings(text, spans)]
            own += [{"start": s, "end": e, "left": text[max(0, s - AROUND) : s], "body": text[s:e], "right": text[e : e + AROUND], "kind": -1 if far else -2} for s, e, far in others(text, spans)]
            runs.append(own)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.string()), pa.array(runs, pa.list_(pa.struct(_RUN)))], names=["doc_id", "base", "runs"])


# ---- the network -------------------------------------------------------------------------------
#: Character classes: 0 pads, the rest of ASCII by itself, one for others.
_CODES = 98


def encode(left: str, body: str, right: str) -> list[np.ndarray]:
    """Windows of codes, each with ``AROUND`` characters on either side of its part of the candidate; a second
    half of the codes marks the candidate's own characters."""
    code = lambda s, add: [add + (min(max(ord(c) - 31, 1), 96) if 31 <= ord(c) < 127 else 97) for c in s]
    left, right = code(left[-AROUND:], 0), code(right[:AROUND], 0)
    x = [0] * (AROUND - len(left)) + left + code(body, _CODES) + right
    x = np.array(x + [0] * WINDOW, np.int64)
    return [x[at : at + WINDOW] for at in range(0, max(1, len(body)), WINDOW - 2 * AROUND)]


class CharCNN:
    """Embedding, one convolution, maximum over positions, one dense unit; trained with Adam.

    ``flat`` holds the weights and the two moments of Adam, ``t`` its steps, so that networks can be averaged.
    """

    def __init__(self, dim: int = 8, filters: int = 24, width: int = 5, seed: int = 7, state: tuple[np.ndarray, float] | None = None):
        r = np.random.default_rng(seed)
        self.w, self.dim = width, dim
        first = [r.normal(0, 0.3, (2 * _CODES, dim)), r.normal(0, (width * dim) ** -0.5, (width * dim, filters)), np.zeros(filters), r.normal(0, filters**-0.5, filters), np.zeros(1)]
        p = np.concatenate([v.ravel() for v in first])
        self.flat, self.t = (np.array(state[0]), float(state[1])) if state else (np.stack([p, 0 * p, 0 * p]), 0.0)
        at = np.cumsum([0] + [v.size for v in first])
        self.p = {k: self.flat[0, i:j].reshape(v.shape) for k, v, i, j in zip("EKcvo", first, at, at[1:], strict=False)}

    def maps(self, x: np.ndarray) -> np.ndarray:
        """Row, position, filter; what a code adds to a filter from each place of the convolution is looked up."""
        add = (self.p["E"] @ self.p["K"].reshape(self.w, self.dim, -1)).astype(np.float32)
        used = np.flatnonzero(x.any(0))
        x = x[:, : (used[-1] + 1 if len(used) else 0) + self.w].astype(np.intp)  # beyond, all is padding
        n = x.shape[1] - self.w + 1
        z = np.take(add[0], x[:, :n], axis=0)
        more = np.empty_like(z)
        for k in range(1, self.w):
            z += np.take(add[k], x[:, k : k + n], axis=0, out=more, mode="clip")
        return z

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = [np.maximum(self.maps(x[i : i + 64]).max(1) + self.p["c"], 0) @ self.p["v"] + self.p["o"][0] for i in range(0, len(x), 64)]
        return np.concatenate(out) if out else np.zeros(0)

    def fit(self, x: np.ndarray, y: np.ndarray, share: np.ndarray, weight: np.ndarray, order: np.ndarray, lr: float = 0.01):
        """One pass over the rows in ``order``, in steps of equal shares, so that a run of many windows doesn't make it longer."""
        f = len(self.p["c"])
        k = np.arange(self.w)
        upto = np.cumsum(share[order])
        n = int(round(upto[-1])) if len(order) else 0
        steps = max(1, n // min(MOST_BATCH, max(64, n // 48)))
        for rows in np.split(order, np.searchsorted(upto, np.arange(1, steps) * (upto[-1] / steps), "right")) if n else ():
            if not len(rows):
                continue
            xb, yb = x[rows], y[rows]
            z = self.maps(xb)
            top = z.argmax(1)
            best = np.maximum(np.take_along_axis(z, top[:, None], 1)[:, 0] + self.p["c"], 0)
            out = best @ self.p["v"] + self.p["o"][0]
            g = share[rows] * weight[yb] * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - yb) / (upto[-1] / steps)
            db = (g[:, None] * self.p["v"]) * (best > 0)
            code = xb[np.arange(len(rows))[:, None, None], top[:, :, None] + k]  # row, filter, place
            slot = (k * (2 * _CODES) + code) * f + np.arange(f)[:, None]
            add = np.bincount(slot.ravel(), np.repeat(db.ravel(), self.w), self.w * 2 * _CODES * f).reshape(self.w, 2 * _CODES, f)
            conv = self.p["K"].reshape(self.w, self.dim, f)
            grad = np.concatenate([v.ravel() for v in ((add @ conv.transpose(0, 2, 1)).sum(0), self.p["E"].T @ add, db.sum(0), best.T @ g, g.sum(keepdims=True))])
            self.t += 1
            w, m, s = self.flat
            m += 0.1 * (grad - m)
            s += 0.001 * (grad * grad - s)
            w -= lr * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.999**self.t)) + 1e-8)
        return self


def platt(z: np.ndarray, y: np.ndarray, times: np.ndarray | None = None, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps of bounded length with a small ridge; row i counts ``times[i]``."""
    w, x = np.array([1.0, 0.0]), np.stack([z, np.ones_like(z)], 1)
    times = np.ones(len(z)) if times is None else times
    yes, no = times[y == 1].sum(), times[y == 0].sum()
    goal = np.where(y == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (times * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (times * (p - goal)) + 1e-2 * (w - [1.0, 0.0]))
        w = w - step / max(1.0, float(np.abs(step).max()))
    return float(w[0]), float(w[1])


def rewritten(body: str) -> list[str]:
    """The bytes of a secret in hex digits, in other alphabets, so that no single one passes for the mark of secrets."""
    if not re.fullmatch("[0-9a-fA-F]{16,}", body):
        return []
    raw = bytes.fromhex(body[: len(body) // 2 * 2])
    return [base64.urlsafe_b64encode(raw).decode().rstrip("="), base64.b32encode(raw).decode().rstrip("=").lower() if raw[0] % 2 else body.upper()]


def groups_of(n: dict[int, int]) -> tuple[list[int], int] | None:
    """The kinds that make a group each and the number of groups, of distinct runs by kind; None without both classes."""
    if min(sum(v for k, v in n.items() if k >= 0), n.get(-1, 0)) < 8:
        return None
    kinds = [k for k in range(len(KINDS)) if n.get(k, 0) >= 8]
    return kinds, len(kinds) if len(kinds) > 1 else 2


def part(body: str, groups: int) -> int:
    """By the text of a run alone, so that a secret that leaks into many documents is in one group."""
    return hashlib.md5(body.encode("utf-8", "surrogatepass")).digest()[0] % groups


def packed(runs, kinds: list[int], groups: int):
    """``(x, y, group, row, tally)`` in chunks of ``CHUNK`` windows or more, of ``(left, body, right, kind)``: all windows of
    each run (and of a finding in other alphabets), its class, its group and part, its number in the chunk; ``tally`` counts rows by class, group and part."""
    x, y, of, row, n = [], [], [], [], 0

    def chunk():
        first = np.flatnonzero(np.diff(row, prepend=-1))
        tally = np.bincount(np.array(y)[first] * groups * PARTS + np.array(of)[first], minlength=2 * groups * PARTS)
        return np.array(x, np.uint8), np.array(y, np.uint8), np.array(of, np.uint8), np.array(row, np.int32), tally

    for left, body, right, kind in runs:
        g = kinds.index(kind) if len(kinds) > 1 and kind in kinds else part(body, groups)
        g = g * PARTS + part(body, PARTS)
        for b in (body, *(rewritten(body) if kind >= 0 else ())):
            windows = encode(left, b, right)
            x += windows
            y += [int(kind >= 0)] * len(windows)
            of += [g] * len(windows)
            row += [n] * len(windows)
            n += 1
        if len(x) >= CHUNK:
            yield chunk()
            x, y, of, row, n = [], [], [], [], 0
    if x:
        yield chunk()


def learned(y: np.ndarray, of: np.ndarray, net: int, groups: int) -> np.ndarray:
    """The rows that a network learns from: all but a group, or, by the last ``PARTS`` networks, all but the negatives of a part."""
    return of // PARTS != net if net < groups else (of % PARTS != net - groups) | (y == 1)


def classes(tally: np.ndarray, net: int) -> np.ndarray:
    """Rows by class that a network learns from."""
    y, of = np.indices(tally.shape)
    return (tally * learned(y, of, net, tally.shape[1] // PARTS)).sum(1)


def one_pass(chunks, states: list, tally: np.ndarray, turn: int) -> tuple[list, int]:
    """The networks after a pass over the chunks of a shard, and its windows."""
    nets, seen = [CharCNN(state=s) for s in states], 0
    for at, (x, y, of, row) in enumerate(chunks):
        share = 1 / np.bincount(row)[row]  # a run counts once, however long
        order = np.random.default_rng((11, turn, at)).permutation(len(x))
        seen += len(x)
        for g, net in enumerate(nets):
            n = classes(tally, g)
            if n.min() > 0:
                own = learned(y, of, g, tally.shape[1] // PARTS)
                net.fit(x, y, share, 0.5 * n.sum() / n, order[own[order]])
    return [(net.flat, net.t) for net in nets], seen


def unseen(chunk, states: list, tally: np.ndarray):
    """Class and logit of the rows of a chunk, the highest of a row's windows, by the network that has not seen its group;
    rounded down to a 1,024th, so that all rows can be counted in a bounded table."""
    x, y, of, row = chunk
    z = np.zeros(len(x))
    for g, state in enumerate(states[:-PARTS]):
        if classes(tally, g).min() > 0:
            own = ~learned(y, of, g, len(states) - PARTS)
            z[own] = CharCNN(state=state).logits(x[own])
    first = np.flatnonzero(np.diff(row, prepend=-1))
    return y[first].astype(np.int64), np.floor(np.clip(np.maximum.reduceat(z, first), -30, 30) * 1024).astype(np.int64)


def learn(turn, count, tally: np.ndarray, recall: float):
    """``(weights by part, slope, offset, threshold)``: ``turn(states, i)`` gives the networks of each shard after a pass over all of its rows and
    its windows, and the next pass starts at their mean; ``count(states)`` gives ``(class, logit, rows)`` of all rows."""
    nets = tally.shape[1] // PARTS + PARTS
    states = [(CharCNN().flat, 0.0)] * nets
    for i in range(min(MOST_PASSES, max(PASSES, -(-FEW // int(tally.sum()))))):
        shards = turn(states, i)
        n = sum(seen for _, seen in shards)
        states = [(sum(s[g][0] * (seen / n) for s, seen in shards), sum(s[g][1] * seen for s, seen in shards) / n) for g in range(nets)]
    y, z, times = (np.array(v) for v in zip(*sorted(count(states)), strict=True))
    z = z / 1024
    a, b = platt(z, y, times)
    p = 1 / (1 + np.exp(-np.clip(a * z[y == 1] + b, -30, 30)))
    order = np.argsort(p, kind="stable")
    upto = np.cumsum(times[y == 1][order])
    weights = [states[g][0][0] if classes(tally, g).min() > 0 else None for g in range(nets - PARTS, nets)]
    return weights, a, b, float(p[order][np.searchsorted(upto, int((1 - recall) * upto[-1]), "right")])


def train(positives: list[tuple[str, str, str, int]], negatives: list[tuple[str, str, str]], recall: float = RECALL):
    """The model of the given runs as one shard, or None without both classes; positives end with their kind."""
    runs = sorted({*positives, *((*r[:3], -1) for r in negatives)})
    if (made := groups_of(Counter(r[3] for r in runs))) is None:
        return None
    chunks = list(packed(runs, *made))
    tally = sum(c[4] for c in chunks).reshape(2, -1)
    chunks = [c[:4] for c in chunks]
    count = lambda states: [(*k, n) for k, n in Counter((int(y), int(z)) for c in chunks for y, z in zip(*unseen(c, states, tally), strict=True)).items()]
    return learn(lambda states, i: [one_pass(chunks, states, tally, i)], count, tally, recall)


def score(model, rows: list[tuple[str, str, str]]) -> np.ndarray:
    """By the network that has not learned from the run as one that is no secret; 0 where there is none."""
    of, out = np.array([part(r[1], len(model[0])) for r in rows], np.int64), np.zeros(len(rows))
    for g, weights in enumerate(model[0]):
        if weights is None or not (of == g).any():
            continue
        net = CharCNN()
        net.flat[0] = weights
        windows = [encode(*rows[i]) for i in np.flatnonzero(of == g)]
        z = net.logits(np.array([w for ws in windows for w in ws], np.uint8))
        z = np.maximum.reduceat(z, np.cumsum([0] + [len(w) for w in windows[:-1]]))
        out[of == g] = 1 / (1 + np.exp(-np.clip(model[1] * z + model[2], -30, 30)))
    return out


_ARROW_CHUNK = pa.schema([("shard", pa.int64()), *((n, pa.binary()) for n in ("x", "y", "of", "row")), ("tally", pa.list_(pa.int64()))])
_CHUNK = T.StructType([T.StructField("shard", LONG), *(T.StructField(n, T.BinaryType()) for n in ("x", "y", "of", "row")), T.StructField("tally", T.ArrayType(LONG))])
_STATE = T.StructType([T.StructField("shard", LONG), T.StructField("flat", T.BinaryType()), T.StructField("t", T.ArrayType(DBL)), T.StructField("seen", LONG)])


def _chunks(batches):
    """``(shard, (x, y, group, row))`` of packed rows."""
    for b in batches:
        for r in b.to_pylist():
            yield r["shard"], (np.frombuffer(r["x"], np.uint8).reshape(-1, WINDOW), np.frombuffer(r["y"], np.uint8), np.frombuffer(r["of"], np.uint8), np.frombuffer(r["row"], np.int32))


def train_all(runs: DataFrame, recall: float = RECALL):
    """``train`` of all distinct runs of a table ``(left, body, right, kind)``.

    The runs are dealt to shards by hash, each in the order of its hashes, so the model does not depend on how the table is split.
    """
    runs = runs.distinct()
    n = {r["kind"]: r["count"] for r in runs.groupBy("kind").count().collect()}
    if (made := groups_of(n)) is None:
        return None
    groups, shards = made[1], max(1, min(MOST_SHARDS, sum(n.values()) // CHUNK))
    spark = runs.sparkSession

    def pack(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("shard", "left", "body", "right", "kind")), strict=True))
        for shard, own in groupby(rows, lambda r: r[0]):
            for *arrays, tally in packed((r[1:] for r in own), *made):
                yield pa.RecordBatch.from_pylist([dict(zip(_CHUNK.names, (shard, *(v.tobytes() for v in arrays), tally.tolist()), strict=True))], _ARROW_CHUNK)

    rank = F.xxhash64("left", "body", "right")
    dealt = runs.select(F.pmod(rank, F.lit(shards)).alias("shard"), "left", "body", "right", "kind", rank.alias("rank")).repartition(shards, "shard")
    chunks = cut(dealt.sortWithinPartitions("shard", "rank", "left", "body", "right", "kind").mapInArrow(pack, _CHUNK))
    tally = np.array(chunks.agg(*[F.sum(F.col("tally")[i]) for i in range(2 * groups * PARTS)]).first()).reshape(2, -1)

    def turn(states, i):
        sent = spark.sparkContext.broadcast(states)

        def run(batches):
            for shard, own in groupby(_chunks(batches), lambda r: r[0]):
                after, seen = one_pass((c for _, c in own), sent.value, tally, i)
                yield pa.RecordBatch.from_pydict({"shard": [shard], "flat": [np.stack([f for f, _ in after]).tobytes()], "t": [[t for _, t in after]], "seen": [seen]})

        got = sorted(chunks.drop("tally").mapInArrow(run, _STATE).collect(), key=lambda r: r["shard"])
        sent.unpersist()
        return [(list(zip(np.frombuffer(r["flat"]).reshape(groups + PARTS, 3, -1), r["t"], strict=True)), r["seen"]) for r in got]

    def count(states):
        sent = spark.sparkContext.broadcast(states)

        def run(batches):
            for _, chunk in _chunks(batches):
                y, z = unseen(chunk, sent.value, tally)
                (y, z), times = np.unique(np.stack([y, z]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_pydict({"y": y, "z": z, "n": times})

        return [tuple(r) for r in chunks.drop("tally").mapInArrow(run, schema(y=LONG, z=LONG, n=LONG)).groupBy("y", "z").agg(F.sum("n")).collect()]

    return learn(turn, count, tally, recall)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_cnn)``, a row for each row of ``docs``."""
    src = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = cut(src.mapInArrow(_scan, _FOUND))
    each = found.select(F.explode("runs").alias("r")).select("r.left", "r.body", "r.right", "r.kind")
    model = train_all(each.where("kind >= -1"), recall)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        model = sent.value
        for b in batches:
            base, runs = b.column("base").to_pylist(), b.column("runs").to_pylist()
            asked = [(i, c) for i, cs in enumerate(runs) for c in cs or () if c["kind"] < 0] if model else []
            extra: dict[int, list] = {}
            if asked:
                for (i, c), p in zip(asked, score(model, [(c["left"], c["body"], c["right"]) for _, c in asked]), strict=True):
                    if p >= model[3]:
                        extra.setdefault(i, []).append((c["start"], "cnn", c["end"]))
            out = {"doc_id": b.column("doc_id"), "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": [], "n_cnn": []}
            for i, text in enumerate(base):
                spans = [(int(s), k, int(e)) for k, s, e in (x.split(":") for x in text.split(",") if x)]
                for k in KINDS:
                    out[f"n_{k}"].append(sum(x[1] == k for x in spans))
                out["base_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                more = extra.get(i, [])
                out["n_cnn"].append(len(more))
                out["spans"].append(_join(sorted(spans + more, key=lambda x: (x[0], (*KINDS, "cnn").index(x[1])))) if more else text)
            yield pa.RecordBatch.from_pydict(out)

    return found.mapInArrow(judge, schema(doc_id=LONG, n_assign=LONG, n_access=LONG, n_hex=LONG, base_sha256=STR, spans=STR, n_cnn=LONG))


def query(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
