"""Second implementations, in plain Python, of what SQL can't express: mixing as a whole, and toxicity's words, features and curve."""

import math
import random
import re
from collections import Counter

import numpy as np
import xxhash

from evkg.llm import mixing, toxicity


def _mixed(docs, targets, budget, seed=20):
    """``{doc_id: (cell, tokens, probability, kept)}``: raking of a whole three-way array, and saturation cell after cell."""
    told = []
    for doc_id, text, lang, source in docs:
        topic = next((n for n, p in mixing.TOPICS if text is not None and re.search(p, text)), "general")
        told.append((doc_id, (source or "unknown", lang or "unknown", topic), len(re.findall(r"[^ \t-\r]+", text or ""))))
    names = [sorted({c[k] for _, c, _ in told}) for k in range(3)]
    seen = np.zeros([len(n) for n in names])
    for _, cell, n in told:
        seen[tuple(names[k].index(cell[k]) for k in range(3))] += n
    w = seen / seen.sum()
    goals = []
    for k, axis in enumerate(mixing.AXES):
        want = np.array([targets[axis].get(n, targets[axis].get("*", 0.0)) for n in names[k]])
        goals.append(want / want.sum())
    for _ in range(2000):
        for k in range(3):
            now = w.sum(tuple({0, 1, 2} - {k}))
            w = w * np.divide(goals[k], now, out=np.zeros_like(now), where=now > 0).reshape([-1 if j == k else 1 for j in range(3)])
    # Cells whose documents are all kept come first: those with the fewest tokens for their share.
    left, share, p = budget * seen.sum(), w.sum(), np.ones_like(seen)
    order = sorted(np.argwhere((w > 0) & (seen > 0)).tolist(), key=lambda i: seen[tuple(i)] / w[tuple(i)])
    p[(seen > 0) & (w == 0)] = 0
    for n, i in enumerate(map(tuple, order)):
        if left / share * w[i] < seen[i]:  # none from here on is full
            for j in map(tuple, order[n:]):
                p[j] = left / share * w[j] / seen[j]
            break
        left, share = left - seen[i], share - w[i]
    out = {}
    for doc_id, cell, n in told:
        at = tuple(names[k].index(cell[k]) for k in range(3))
        first = xxhash.xxh64_intdigest(("" if doc_id is None else str(doc_id)).encode(), 42)
        drawn = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), first) % (1 << 40) / (1 << 40)
        out.setdefault(doc_id, []).append((cell, n, float(p[at]), drawn < p[at]))
    return out


def test_mixing_as_a_whole(spark):
    at = "/root/testdata/sf0.01"
    want = _mixed([tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text", "lang", "source").collect()], mixing.TARGETS, mixing.BUDGET)
    got = mixing.query(spark, at).collect()
    assert len(got) == sum(map(len, want.values())) and 0 < sum(r["kept"] for r in got) < len(got)
    for r in got:
        cell, tokens, p, kept = want[r["doc_id"]][0]
        assert (r["source"], r["lang"], r["topic"]) == cell and r["tokens"] == tokens
        assert math.isclose(r["probability"], p, rel_tol=1e-6, abs_tol=1e-9) and r["kept"] == kept


def test_mixing_of_long_texts(spark):
    rows = [(i, "word " * n, "en", f"s{i % 2}") for i, n in enumerate((3, 500_000, 7, 11))] + [(4, "", "en", "s0"), (5, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["tokens"] for r in mixing.mix(df).collect()}
    assert got == {0: 3, 1: 500_000, 2: 7, 3: 11, 4: 0, 5: 0}


class _Words:
    """Ratios of words by formula: discounted counts, then a tree of beginnings, then characters."""

    def __init__(self, classes, model):
        self.counts = [Counter(w for s in {s for t in texts for s in t} for w in s) for texts in classes]
        self.begun = [Counter(w.encode()[:i] for w in c for i in range(min(toxicity.DEPTH, len(w.encode())) + 1)) for c in self.counts]
        self.kids = [Counter(p[:-1] for p in b if p) for b in self.begun]
        self.to = model.to
        coded = [Counter(dict.fromkeys(c, 1)) for c in self.counts]
        self.chars = [t.reshape([toxicity.SYMBOLS] * 4) for t in toxicity.char_models(coded, self.to)]

    def char(self, k, word, i):
        """Log probability of a word's byte, or of its end, after the three before it."""
        s = [0, 0, 0] + [int(self.to[b]) + 1 for b in word] + [0]
        return float(self.chars[k][tuple(s[i : i + 4])])

    def path(self, k, p):
        if not p:
            return 0.0
        up, q = p[:-1], math.exp(self.char(k, p, len(p) - 1))
        n = self.begun[k][up]
        step = (max(self.begun[k][p] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * max(1, self.kids[k][up]) * q) / n if n else q
        return self.path(k, up) + math.log(step)

    def spelt(self, k, word):
        b = word.encode()
        deep = min(toxicity.DEPTH, len(b))
        at = next((i for i in range(deep, -1, -1) if self.begun[0][b[:i]] + self.begun[1][b[:i]] > 1), None)
        out = sum(self.char(k, b, i) for i in range(at or 0, len(b) + 1))
        if at is not None:
            out += self.path(k, b[:at])
            if at < deep and self.kids[k][b[:at]]:
                out += math.log(toxicity.DISCOUNT * self.kids[k][b[:at]] / self.begun[k][b[:at]])
        return out

    def ratio(self, word):
        out = []
        for k, c in enumerate(self.counts):
            left = max(1.0, sum(min(n, toxicity.WORD_DISCOUNT) for n in c.values()))
            own = max(c[word] - toxicity.WORD_DISCOUNT, 0)
            out.append(math.log(own + left * math.exp(self.spelt(k, word))) - math.log(max(1, c.total())))
        return out[0] - out[1]


def _texts(seed, n, shared, own):
    draw = random.Random(seed)
    return [" ".join(draw.choice(own if draw.random() < 0.2 else shared) + draw.choice(["", ".", ""]) for _ in range(draw.randrange(1, 40))) for _ in range(n)]


def test_toxicity_words_and_features():
    shared, bad, fine = "the a cat dog goes home ächzt bridge bridges bridgehead".split(), "idiot idiots stupid stupidly stu".split(), "kind kindly friend friendship".split()
    classes = [[toxicity.sentences(t) for t in _texts(k, 40, shared, own)] for k, own in enumerate((bad, fine))]
    model = toxicity.Model(*classes)
    plain = _Words(classes, model)
    assert set(model.known) == set(plain.counts[0]) | set(plain.counts[1])
    for w, r in model.known.items():
        assert math.isclose(r, plain.ratio(w), abs_tol=1e-6), w
    fresh = ["idiotic", "stupidest", "kindness", "bridg", "zzz", "ä", "friendshipfriendship", "q"]
    texts = [[], ["zzz"], *[t.lower().replace(".", " ").split() for t in _texts(9, 300, [*shared, *fresh], bad)], ["the"] * 50_000]
    got = model.features(texts)
    ratio = {w: plain.ratio(w) for w in {w for t in texts for w in t}}
    for t, x in zip(texts, got, strict=True):
        top = sorted(ratio[w] for w in set(t))[-3:]
        want = [min(v, toxicity.HIGHEST) for v in [0.0, 0.0, 0.0, *top][-3:]]
        mean = 20 * sum(ratio[w] for w in t) / sum(len(w) + 1 for w in t) if t else 0.0
        np.testing.assert_allclose(x, [*want, mean], atol=2e-4)


def test_toxicity_curve():
    """The curve's weights are where the penalised likelihood is flat, measured by differences."""
    draw = np.random.default_rng(3)
    y = (draw.random(400) < 0.4).astype(float)
    x = draw.normal(size=(400, 4)) * [1, 5, 0.1, 2] + np.outer(y, [1, 3, 0, -1])
    w, mid, dev = toxicity.logistic(x, y)

    def loss(w):
        z = ((x - x.mean(0)) / (x.std(0) + 1e-6)) @ w[:4] + w[4]
        return np.logaddexp(0, z).sum() - (y * z).sum() + 0.25 * (w[:4] ** 2).sum() + 5e-4 * w[4] ** 2

    np.testing.assert_allclose(mid, x.mean(0))
    for i in range(5):
        e = np.eye(5)[i] * 1e-4
        assert abs(loss(w + e) - loss(w - e)) / 2e-4 < 1e-3 and loss(w + 100 * e) > loss(w) < loss(w - 100 * e)
