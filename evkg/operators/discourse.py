"""Relations by trained discourse parsing of explicit connectives.

A document's connectives are judged in five steps, each a linear model over named features of words, tags and the
constituency parse: is a phrase a connective here; does its first argument stand in the same sentence (SS) or in the one
before (PS); which constituents (SS) or clauses (PS) make its arguments; which sense does it have.  The features
are those of the published shallow discourse parsers.  No model comes with the library: ``examples`` makes
training rows of sentences with known relations, and ``fit`` trains on them.

Each sentence is a row that carries the one before it, so that no task holds a document.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evkg.operators import graph, relations, trees
from evkg.schema import CONNECTIVES

STEPS = ("connective", "position", "constituent", "first", "second", "sense")
#: Features that a model knows at most, and labels that a step may have.
VOCABULARY, LABELS = 1 << 17, 64
#: Rows of features that are scored at once.
ROWS = 10_000
FOUND = "doc string, sent_idx int, connective string, indices array<int>, arg1_idx int, arg1 array<int>, arg2 array<int>, sense string"


class Sentence:
    """Tokens, tags and parse of one sentence."""

    def __init__(self, tokens, tags, parse):
        self.tokens, self.tags, self.parse = list(tokens), list(tags), parse
        self.nodes = trees.spans(parse)
        self.known: dict = {}

    def once(self, make, at, *more):
        """``make(self, at, *more)``, made once for each list of words: the steps and constituents of a connective ask for the same."""
        key = (make, *at, *more)
        if key not in self.known:
            self.known[key] = make(self, at, *more)
        return self.known[key]

    def at(self, values: list[str], i: int) -> str:
        return values[i] if 0 <= i < len(values) else "NONE"

    def over(self, node):
        """A node's parent."""
        return next((x for x in self.nodes if node and x[0] == node[0] - 1 and x[2] <= node[2] and node[3] <= x[3]), None)

    def around(self, indices):
        """The lowest node over all of the words."""
        lo, hi = min(indices), max(indices)
        return next((x for x in reversed(self.nodes) if x[2] <= lo and hi < x[3]), None)

    def own(self, indices):
        """The highest node over these words alone, else the lowest over all of them."""
        exact = next((x for x in self.nodes if x[2] == min(indices) and x[3] == max(indices) + 1), None)
        return exact or self.around(indices)


def _label(node) -> str:
    return node[1] if node else "NONE"


def _own(s: Sentence, at: list[int]):
    return s.own(at)


def _beside(s: Sentence, at: list[int], where: str) -> list[tuple]:
    """Siblings of a connective's own node."""
    own = s.once(_own, at)
    return trees.siblings(s.parse, own, where) if own else []


def _named(features: dict[str, str]) -> list[str]:
    return [f"{k}={v}" for k, v in features.items()]


def _basic(s: Sentence, at: list[int]) -> list[str]:
    """Words, tags and neighbours of a connective."""
    lo, hi = at[0], at[-1]
    word, tag = " ".join(s.at(s.tokens, i) for i in at), "_".join(s.at(s.tags, i) for i in at)
    out = {"C": word, "low": word.lower(), "pos": tag, "prev+C": f"{s.at(s.tokens, lo - 1)}|{word}", "C+next": f"{word}|{s.at(s.tokens, hi + 1)}"}
    for name, i in (("prev", lo - 1), ("prev2", lo - 2), ("next", hi + 1)):
        out |= {f"{name}word": s.at(s.tokens, i), f"{name}pos": s.at(s.tags, i), f"{name}pos+pos": f"{s.at(s.tags, i)}|{tag}"}
    return _named(out)


def _categories(s: Sentence, at: list[int]) -> list[str]:
    """Categories of a connective's node and those around it, each two of them, and its path to the root."""
    own = s.once(_own, at)
    left, right = s.once(_beside, at, "left"), s.once(_beside, at, "right")
    one = {"self": _label(own), "parent": _label(s.over(own)), "left": _label(left[-1] if left else None), "right": _label(right[0] if right else None)}
    two = {f"{a}+{b}": f"{one[a]}|{one[b]}" for a, b in itertools.combinations(one, 2)}
    word = " ".join(s.at(s.tokens, i) for i in at).lower()
    path = trees.path_to_root(s.parse, at[0]) if s.nodes else []
    return _named(one | two | {f"C+{k}": f"{word}|{v}" for k, v in one.items()} | {"path": ">".join(path), "short": ">".join(trees.compressed(path))})


def _place(s: Sentence, i: int) -> str:
    return ("start", "middle", "end")[min(2, 3 * i // max(1, len(s.tokens)))]


def describe(step: str, s: Sentence, at: list[int], part=None, before: str = "NONE", after: str = "NONE", text: Sentence | None = None) -> list[str]:
    """Named features of a connective, or of a constituent (its node) or clause (its words, in the sentence ``text``) beside it."""
    basic = s.once(_basic, at)
    if step in ("connective", "sense"):
        return basic + s.once(_categories, at)
    low = " ".join(s.at(s.tokens, i) for i in at).lower()
    if step == "position":
        out = {"place": _place(s, at[0]), "C+place": f"{low}|{_place(s, at[0])}"}
    elif step == "constituent":
        own = s.once(_own, at)
        way = trees.node_path(s.parse, own, part)
        side = "left" if part[2] < at[0] else "right"
        lefts, rights = (len(s.once(_beside, at, w)) for w in ("left", "right"))
        out = {"way": way, "side": side, "lefts": str(lefts), "rights": str(rights), "side+lefts": f"{side}|{lefts > 1}", "way+lefts": f"{way}|{lefts > 1}", "C+side": f"{low}|{side}", "label": part[1], "beside": trees.relative_position(s.parse, own, part)}
    else:
        text = text or s
        words = [text.tokens[i].lower() for i in part]
        out = {"first": words[0], "last": words[-1], "before": before, "after": after, "verb": str(any(text.tags[i].startswith("VB") for i in part))}
        out |= {"where": _place(text, part[0]), "side": "left" if text is not s or part[0] < at[0] else "right", "C+first": f"{low}|{words[0]}"}
    return basic + _named(out)


def parallel(at: list[int]) -> bool:
    """Whether a connective's words don't stand together."""
    return any(b - a > 1 for a, b in itertools.pairwise(at))


def constituents(s: Sentence, at: list[int]) -> list[tuple]:
    """The nodes beside a connective's own node and beside all over it, and those parts of it without its words."""
    node = s.around(at)
    if node is None:
        return []
    out = [] if len(at) == 1 else [x for x in s.nodes if x[0] == node[0] + 1 and node[2] <= x[2] and x[3] <= node[3] and not any(x[2] <= i < x[3] for i in at)]
    while node is not None and s.over(node) is not None:
        out += trees.siblings(s.parse, node)
        node = s.over(node)
    return out


def between(s: Sentence, at: list[int]) -> tuple[list[int], list[int]]:
    """Arguments of a connective of two parts: between its parts, and after the last."""
    gap = next(a for a, b in itertools.pairwise(at) if b - a > 1)
    return trees.strip(s.tokens, list(range(gap + 1, next(i for i in at if i > gap)))), trees.strip(s.tokens, list(range(at[-1] + 1, len(s.tokens))))


def filled(s: Sentence, words: list[int]) -> list[int]:
    """An argument with the punctuation inside it and none at its ends."""
    words = sorted(set(words))
    if len(words) < 2:
        return words
    gaps = [range(a + 1, b) for a, b in itertools.pairwise(words)]
    more = [i for g in gaps if all(s.tokens[i] in trees.PUNCTUATION for i in g) for i in g]
    return trees.strip(s.tokens, sorted([*words, *more]))


def without(s: Sentence, words: list[int], rejected: list[tuple[int, ...]]) -> list[int]:
    """What is left of an argument when clauses are taken out of it, each rest without punctuation at its ends."""
    for clause in rejected:
        gone = set(clause)
        cut = next((n for n, i in enumerate(words) if i in gone), len(words))
        head, tail = words[:cut], [i for i in words[cut:] if i not in gone]
        words = trees.strip(s.tokens, head) + trees.strip(s.tokens, tail)
    return words


def _clauses(s: Sentence, at: list[int], cut: bool):
    """Clauses with their neighbours' words: ``(words, last word before, first word after)``."""
    found = trees.clauses(s.tokens, s.parse, set(at) if cut else ())
    return [(list(c), s.at(s.tokens, c[0] - 1).lower(), s.at(s.tokens, c[-1] + 1).lower()) for c in found]


class Linear:
    """A linear model over named features; unknown ones count for nothing.

    Rows of features become columns of a sparse matrix in one look-up for a block of ``ROWS`` rows, and all labels of the
    block are scored in one product, so that memory holds one block's features whatever the number of rows.
    """

    def __init__(self, labels, known, weights, base):
        self.labels, self.base = list(labels), np.asarray(base)
        self.names = pd.Index(sorted(known, key=known.get), dtype=object)
        self.weights = np.ascontiguousarray(np.asarray(weights).T)  # a row for each feature

    def sparse(self, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Columns of the known features, row after row, each once a row, and where each row begins and the last ends."""
        each = [list(dict.fromkeys(r)) for r in rows]
        at = self.names.get_indexer(list(itertools.chain.from_iterable(each)))
        row = np.repeat(np.arange(len(each)), [len(r) for r in each])[at >= 0]
        return at[at >= 0], np.append(0, np.bincount(row, minlength=len(each)).cumsum())

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        """A row of scores by label for each row of features."""
        columns, ends = self.sparse(rows)
        out = np.tile(self.base, (len(rows), 1))
        some = np.flatnonzero(np.diff(ends))
        if len(some):
            out[some] += np.add.reduceat(self.weights[columns], ends[some], axis=0)
        return out

    def predict(self, rows) -> list[str]:
        """The best label of each row of features, the first of equal ones."""
        return [self.labels[i] for block in itertools.batched(rows, ROWS) for i in self.scores(list(block)).argmax(1)]


def _fit_step(own: DataFrame, step: str, vocabulary: int, ridge: float) -> Linear | None:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    labels = sorted(r["label"] for r in own.select("label").distinct().limit(LABELS + 1).collect())
    if len(labels) > LABELS:
        raise ValueError(f"more than {LABELS} labels of {step}")
    if len(labels) < 2:
        return Linear(labels, {}, np.zeros((1, 0)), np.zeros(1)) if labels else None
    words = CountVectorizer(inputCol="features", outputCol="x", vocabSize=vocabulary, binary=True).fit(own)
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")) - 1
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=ridge, maxIter=100, family="multinomial").fit(words.transform(own).withColumn("y", number.cast("double")))
    return Linear(labels, {w: i for i, w in enumerate(words.vocabulary)}, model.coefficientMatrix.toArray(), model.interceptVector.toArray())


def _gathered(rows: DataFrame) -> DataFrame:
    """Kept rows in as few partitions as ``ROWS`` rows each need: training passes over them a few hundred times, and a pass takes a task for each partition, empty or not."""
    return rows.coalesce(max(1, -(-rows.count() // ROWS)))


def fit(rows: DataFrame, steps=STEPS, vocabulary: int = VOCABULARY, ridge: float = 0.01) -> dict[str, Linear]:
    """A model for each step from ``(step, features, label)``; at most ``vocabulary`` features of a step, the commonest, come to the driver.

    A step without rows is left out, one with a single label always gives it.
    """
    rows = rows.select("step", "features", "label").persist()  # each step reads it several times
    try:
        few = _gathered(rows)
        out = {step: _fit_step(few.where(F.col("step") == step).select("features", "label"), step, vocabulary, ridge) for step in steps}
    finally:
        rows.unpersist()
    return {step: model for step, model in out.items() if model}


def _rows(sentences: DataFrame, table, occurrences: DataFrame | None = None) -> DataFrame:
    """Sentences with connective candidates, and the tokens, tags and parse of the one before.  With ``occurrences``
    sentences that hold none count as empty."""
    own = sentences.select("doc", "sent_idx", "sid", "tokens", "pos_tags", "parse")
    if occurrences is not None:
        own = own.join(occurrences.select("sid").distinct().withColumn("has", F.lit(True)), "sid", "left")
    else:
        own = own.withColumn("has", F.lit(True))
    kept = F.when(F.col("has"), F.struct("tokens", "pos_tags", "parse"))
    own = own.withColumn("prev", F.lag(kept).over(Window.partitionBy("doc").orderBy("sent_idx"))).where("has")
    one = own.withColumn("found", relations.phrases(F.col("tokens"), table)).where(F.size("found") > 0)
    return one.select("sid", "doc", F.col("sent_idx").cast("int").alias("sent_idx"), "tokens", "pos_tags", "parse", F.col("prev.tokens").alias("p_tokens"), F.col("prev.pos_tags").alias("p_tags"), F.col("prev.parse").alias("p_parse"), F.col("found.connective").alias("names"), F.col("found.indices").alias("places"))


def _read(r) -> tuple[Sentence, Sentence | None, list]:
    s = Sentence(r.tokens, r.pos_tags, r.parse)
    prev = Sentence(r.p_tokens, r.p_tags, r.p_parse) if r.p_tokens is not None else None
    return s, prev, sorted((name, sorted(int(i) for i in at)) for name, at in zip(r.names, r.places, strict=True))


def _text(r) -> tuple:
    """All that a sentence is judged by: its words, tags and parse, and those of the one before."""
    return tuple(r.tokens), tuple(r.pos_tags), r.parse, None if r.p_tokens is None else (tuple(r.p_tokens), tuple(r.p_tags), r.p_parse)


def examples(sentences: DataFrame, known: DataFrame, table=CONNECTIVES) -> DataFrame:
    """``(step, features, label)`` of sentences all of whose relations are ``known``: ``(sid, indices, arg1_sid, arg1, arg2, sense)``."""
    gold = known.groupBy("sid").agg(F.collect_list(F.struct("indices", (F.col("arg1_sid") == F.col("sid")).alias("same"), "arg1", "arg2", "sense")).alias("gold"))
    rows = _rows(sentences, table).join(gold, "sid", "left")

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                s, prev, found = _read(r)
                gold = {tuple(sorted(int(i) for i in g["indices"])): g for g in (r.gold if r.gold is not None else [])}
                for _, at in found:
                    g = gold.get(tuple(at))
                    out.append(("connective", describe("connective", s, at), str(int(g is not None))))
                    if g is None:
                        continue
                    args = [{int(i) for i in g[a]} for a in ("arg1", "arg2")]
                    out.append(("position", describe("position", s, at), "SS" if g["same"] else "PS"))
                    out.append(("sense", describe("sense", s, at), g["sense"]))
                    if g["same"] and not parallel(at):
                        for x in constituents(s, at):
                            own = {i for i in range(x[2], x[3]) if s.tokens[i] not in trees.PUNCTUATION}
                            which = next((str(n) for n, a in enumerate(args, 1) if own and own <= a), "0")
                            out.append(("constituent", describe("constituent", s, at, x), which))
                    elif not g["same"] and prev is not None:
                        for step, arg, text, cut in (("first", args[0], prev, False), ("second", args[1], s, True)):
                            out += [(step, describe(step, s, at, c, x, y, text), str(int(bool(set(c) & arg)))) for c, x, y in _clauses(text, at, cut)]
            yield pd.DataFrame(out, columns=["step", "features", "label"])

    return rows.mapInPandas(run, "step string, features array<string>, label string")


def _without_rejected(text: Sentence, whole: list[int], told: list[tuple[list[int], str]], nearest: int) -> list[int]:
    """An argument of clauses: all words but those of rejected clauses, or the ``nearest`` clause where none is left."""
    kept = without(text, whole, [tuple(c) for c, label in told if label == "0"]) if told else []
    return kept or (told[nearest][0] if told else [])


def judge(models: dict[str, Linear], cases: list[tuple]) -> list[tuple | None]:
    """``(whether the first argument is in the same sentence, first, second, sense)`` or None for each phrase
    ``(sentence, the one before or None, words)``.  Each step scores all phrases that reach it together."""

    def say(step, asked):
        return models[step].predict(describe(step, *a) for a in asked) if step in models else [None] * len(asked)

    def spread(step, asked):
        """Labels of several things of each case, ``{case: [(thing, label)]}``."""
        out: dict[int, list] = {}
        for (n, thing, *_), label in zip(asked, say(step, [a for _, _, *a in asked]), strict=True):
            out.setdefault(n, []).append((thing, label))
        return out

    here = lambda ns: [(cases[n][0], cases[n][2]) for n in ns]
    yes = [n for n, x in enumerate(say("connective", here(range(len(cases))))) if x == "1"]
    same = {n: x != "PS" for n, x in zip(yes, say("position", here(yes)), strict=True)}
    args = {n: between(cases[n][0], cases[n][2]) for n in yes if same[n] and parallel(cases[n][2])}
    inside = [n for n in yes if same[n] and n not in args]
    told = spread("constituent", [(n, x, s, at, x) for n in inside for s, _, at in [cases[n]] for x in constituents(s, at)])
    for n in inside:
        args[n] = tuple(filled(cases[n][0], [i for x, label in told.get(n, []) if label == k for i in range(x[2], x[3])]) for k in "12")
    across = [n for n in yes if not same[n] and cases[n][1] is not None]
    first = spread("first", [(n, c, s, at, c, x, y, prev) for n in across for s, prev, at in [cases[n]] for c, x, y in _clauses(prev, at, False)])
    second = spread("second", [(n, c, s, at, c, x, y, s) for n in across for s, _, at in [cases[n]] for c, x, y in _clauses(s, at, True)])
    for n in across:
        s, prev, at = cases[n]
        rest = trees.strip(s.tokens, list(range(at[0]))) + trees.strip(s.tokens, list(range(at[-1] + 1, len(s.tokens))))
        before = trees.strip(prev.tokens, list(range(len(prev.tokens))))
        args[n] = (_without_rejected(prev, before, first.get(n, []), -1), _without_rejected(s, rest, second.get(n, []), 0))
    both = [n for n in yes if n in args and all(args[n])]
    out: list[tuple | None] = [None] * len(cases)
    for n, sense in zip(both, say("sense", here(both)), strict=True):
        if sense not in (None, "None"):
            out[n] = (same[n], *args[n], sense)
    return out


def parse(sentences: DataFrame, models: dict[str, Linear], occurrences: DataFrame | None = None, table=CONNECTIVES) -> DataFrame:
    """``(doc, sent_idx, connective, indices, arg1_idx, arg1, arg2, sense)`` of the connectives with both arguments and a sense."""
    sent = sentences.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for b in batches:
            rows = [(_text(r), r) for r in b.itertuples(index=False)]
            # Equal sentences after equal ones are judged once.
            asked = [(text, name, s, prev, at) for text, r in dict(rows).items() for s, prev, found in [_read(r)] for name, at in found]
            told: dict = {}
            for (text, name, _, _, at), got in zip(asked, judge(sent.value, [x[2:] for x in asked]), strict=True):
                if got:
                    told.setdefault(text, []).append((name, at, *got))
            out = [(r.doc, r.sent_idx, name, at, r.sent_idx - (not same), *rest) for text, r in rows for name, at, same, *rest in told.get(text, ())]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])

    return _rows(sentences, table, occurrences).drop("sid").mapInPandas(run, FOUND)


def edges(found: DataFrame, placed: DataFrame, similarity, threshold: float = 0.8) -> DataFrame:
    """``(doc, head_idx, sent_idx, hid, tid, sense, weight, head_sid, tail_sid)`` by the sentences of both arguments, the second of which is the
    connective's: its weight of one is shared by all pairs of
    eventualities ``(doc, sent_idx, eid, places)``, with ``sid`` if they have one, that match its arguments by ``similarity`` of word places."""
    conn = F.struct("doc", "sent_idx", "indices", "sense", "arg1_idx").alias("conn")
    side = lambda name, i, words: F.struct(F.lit(name).alias("side"), F.struct("doc", F.col(i).alias("sent_idx")).alias("sent"), F.col(words).alias("words"))
    # Both arguments in one join: what was found is made once.
    args = found.select(conn, F.explode(F.array(side("h", "arg1_idx", "arg1"), side("t", "sent_idx", "arg2"))).alias("x")).select(F.struct("conn", "x.side").alias("conn"), "x.sent", "x.words")
    sid = F.col("sid") if "sid" in placed.columns else F.lit(None).cast("string")
    occ = placed.select(F.struct("doc", F.col("sent_idx").cast("int").alias("sent_idx")).alias("sent"), F.struct("eid", sid.alias("sid")).alias("eid"), F.col("places").alias("words"))
    matched = graph.argument_match(args, occ, similarity, threshold)
    of = lambda name: F.collect_list(F.when(F.col("conn.side") == name, F.col("eid")))
    both = matched.groupBy(F.col("conn.conn").alias("conn")).agg(of("h").alias("heads"), of("t").alias("tails"))
    weight = F.lit(1.0) / (F.size("heads") * F.size("tails"))
    pairs = both.where("size(tails) > 0").select("conn", "tails", weight.alias("weight"), F.explode("heads").alias("h")).select("conn", "h", "weight", F.explode("tails").alias("t"))
    return pairs.select("conn.doc", F.col("conn.arg1_idx").alias("head_idx"), "conn.sent_idx", F.col("h.eid").alias("hid"), F.col("t.eid").alias("tid"), F.col("conn.sense").alias("sense"), "weight", F.col("h.sid").alias("head_sid"), F.col("t.sid").alias("tail_sid"))
