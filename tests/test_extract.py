"""The extraction plan against the rules for one sentence, on random parses."""

import random

import pytest
from pyspark.sql import functions as F

from evkg.functions import ids
from evkg.operators import extract, trees
from evkg.operators.rules import MODIFIERS, PATTERNS

SHAPE = "sid string, tokens array<string>, lemmas array<string>, pos_tags array<string>, ners array<string>, dependencies array<struct<gov:int,dep:string,dpt:int>>, parse string, connective_idx array<int>"
LABELS = sorted({label for p in PATTERNS.values() for _, label, _ in p.core}) * 3 + ["aux", "det", "case", "case", "compound", "compound", "compound:prt", "mark", "ccomp", "advcl", "punct", "strange", "nmod:tmod", "nmod:after", "auxpass", "neg", *MODIFIERS[:6]]
COLUMNS = ("eid", "pattern", "words", "pos_tags", "verbs", "skeleton_words", "skeleton_pos", "phrases", "skeleton_phrases", "position", "raw_idx", "phrase_at", "skeleton_at", "dependencies")


def parses(n, seed=1):
    rng = random.Random(seed)
    for k in range(n):
        size = rng.randrange(1, 9)
        tags = [rng.choice(["VB", "VBZ", "NN", "JJ", "IN", "PRP", "NNP"]) for _ in range(size)]
        words = [rng.choice(["be", "go", "Ärger", "|", "x\"y", "\U0001f600", "cat", "who", "no", "we"]) if rng.random() < 0.9 else "who" for _ in range(size)]
        if rng.random() < 0.7:  # around one verb, so that patterns fit
            verb = rng.randrange(size)
            tags[verb] = "VB"
            edges = {(rng.choice([verb, verb, rng.randrange(size)]), rng.choice(LABELS), rng.randrange(size)) for _ in range(rng.randrange(1, 8))}
        else:
            edges = {(rng.randrange(size), rng.choice(LABELS), rng.randrange(size)) for _ in range(rng.randrange(0, 12))}
        p = rng.choice(list(PATTERNS.values()))
        if rng.random() < 0.7 and size >= len({w for g, _, t in p.core for w in (g, t)}):  # a pattern's core, as it is
            at = dict(zip(sorted({w for g, _, t in p.core for w in (g, t)}), rng.sample(range(size), size), strict=False))
            tags[at["V1"]] = "VBD"
            edges = {(at[g], label, at[t]) for g, label, t in p.core} | set(rng.sample(sorted(edges), min(len(edges), 2)))
        edges = sorted(edges, key=lambda e: (e[0], e[2], e[1]))
        yield f"s{k}", words, [w.upper() for w in words], tags, ["O"] * size, edges


def key(sid, e):
    flat = lambda x: tuple(map(flat, x)) if isinstance(x, list | tuple) else x
    return (sid, *(flat(e[c]) for c in COLUMNS))


def rows(df):
    return sorted((key(r["sid"], {**r.asDict(), "dependencies": [tuple(d) for d in r["dependencies"]]}) for r in df.collect()), key=str)


@pytest.mark.parametrize("skip", [(), ("who",)])
def test_random_parses(spark, skip):
    data = list(parses(3_000))
    df = spark.createDataFrame([(*d, None, None) for d in data], SHAPE)
    want = [key(sid, e) for sid, t, m, p, _, d in data for e in extract.eventualities(t, m, p, d, skip)]
    assert len({w[2] for w in want}) > 15 and rows(extract.extract(df, skip=skip)) == sorted(want, key=str)


def test_random_clauses(spark):
    """Clauses by separators, connectives and subordinate clauses; places are those of the whole sentence."""
    rng = random.Random(5)
    data = []
    for sid, t, m, p, n, d in parses(2_500, 7):
        t = [rng.choice([",", ";"]) if rng.random() < 0.08 else w for w in t]
        a = rng.randrange(len(t))
        tree = "(ROOT " + " ".join(f"(X {i})" for i in range(a)) + " (SBAR " + " ".join(f"(X {i})" for i in range(a, len(t))) + "))"
        data.append((sid, t, m, p, n, d, rng.choice([None, tree]), rng.sample(range(len(t)), 1) if rng.random() < 0.3 else None))
    want = []
    for sid, t, m, p, _, d, tree, conn in data:
        seen = set()
        for clause in trees.clauses(t, tree, set(conn or ())):
            to = {j: i for i, j in enumerate(clause)}
            inner = [(to[g], x, to[y]) for g, x, y in d if g in to and y in to]
            for e in extract.eventualities([t[i] for i in clause], [m[i] for i in clause], [p[i] for i in clause], inner, ()):
                e["raw_idx"] = [clause[i] for i in e["raw_idx"]]
                e["position"] = sum(e["raw_idx"]) / len(e["raw_idx"]) if e["raw_idx"] else 0.0
                if (e["eid"], tuple(e["raw_idx"])) not in seen:
                    seen.add((e["eid"], tuple(e["raw_idx"])))
                    want.append(key(sid, e))
    got = rows(extract.extract(spark.createDataFrame(data, SHAPE), clause_split=True))
    assert len(want) > 200 and got == sorted(want, key=str)


def test_no_python_in_plan(spark):
    df = spark.createDataFrame([(*d, None, None) for d in parses(3)], SHAPE)
    plan = extract.extract(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert extract.extract(df.where("false")).count() == 0


def test_mentions(spark):
    """Mentions whose first and last words an eventuality has, by its own places."""
    said = "the old New York Times of Paris hired us".split()
    deps = [(7, "nsubj", 4), (4, "compound", 2), (4, "compound", 3), (4, "amod", 1), (4, "nmod:of", 6), (6, "case", 5), (7, "dobj", 8)]
    mentions = [(2, 5, "New York Times", "ORGANIZATION", "u1", "The New York Times"), (6, 7, "Paris", "CITY", None, "Paris"), (0, 2, "the old", "X", None, None)]
    shape = SHAPE.replace("parse string, connective_idx array<int>", f"mentions {extract.MENTIONS}")
    df = spark.createDataFrame([("a", said, said, "DT JJ NNP NNP NNP IN NNP VBD PRP".split(), ["O"] * 9, deps, mentions)], shape)
    got = extract.extract(df).first()
    assert got["words"] == "old new york times of paris hired us".split() and got["phrases"][1] == "new york times" and got["phrase_pos"][1] == "NNP"
    assert [tuple(m) for m in got["mentions"]] == [(1, 4, "new york times", "ORGANIZATION", "u1", "The New York Times"), (5, 6, "paris", "CITY", None, "Paris")]


def test_ids_of_other_scripts(spark):
    words = [["a", 'é"\\', "\U0001f600x\n\t\x7f", "\x01\b\f\r"], ["ß"], ["", "a b", "日本"]]
    df = spark.createDataFrame([(w, ["T"] * len(w), [(0, "n:\u00e9", 0)]) for w in words], "w array<string>, t array<string>, d array<struct<gov:int,dep:string,dpt:int>>")
    assert [r["e"] for r in df.select(ids.eid("w", "t", "d").alias("e")).collect()] == [ids.eid_of(w, ["T"] * len(w), [(0, "n:\u00e9", 0)]) for w in words]
    assert df.select(ids.eid(F.col("w"), F.col("t"), F.col("d"))).count() == 3
