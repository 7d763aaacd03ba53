"""Discourse parsing: batched scores against plain sums, tree operations, and accuracy on documents that training has not seen."""

import random

import numpy as np

from evkg.operators import discourse, trees

TABLE = {"Reason": ("because",), "Result": ("so",), "Contrast": ("but",), "Condition": ("if",)}
SHAPE = "doc string, sent_idx int, sid string, tokens array<string>, pos_tags array<string>, parse string"
GOLD = "sid string, indices array<int>, arg1_sid string, arg1 array<int>, arg2 array<int>, sense string"


def test_scores_of_a_batch():
    draw = random.Random(5)
    known = {f"f{i}": i for i in range(500)}
    weights, base = np.random.default_rng(5).normal(size=(7, 500)), np.arange(7) / 10
    model = discourse.Linear("abcdefg", known, weights, base)
    rows = [[f"f{draw.randrange(700)}" for _ in range(draw.randrange(12))] for _ in range(discourse.ROWS + 321)]
    plain = np.array([base + sum((weights[:, known[f]] for f in set(r) if f in known), np.zeros(7)) for r in rows])
    assert [] in rows and any(len(set(r)) < len(r) for r in rows)
    np.testing.assert_allclose(model.scores(rows), plain, atol=1e-12)
    assert model.predict(rows) == ["abcdefg"[i] for i in plain.argmax(1)] and model.predict([]) == []
    columns, ends = model.sparse([["f3", "f3", "x"], [], ["f1", "f2"]])
    assert columns.tolist() == [3, 1, 2] and ends.tolist() == [0, 1, 1, 3]
    assert discourse.Linear(["only"], {}, np.zeros((1, 0)), np.zeros(1)).predict([["f1"], []]) == ["only", "only"]


def test_subtree_and_position():
    tree = "(ROOT (S (NP (PRP we)) (VP (VBP sell) (NP (NN bread))) (. .)))"
    by = {x[1]: x for x in trees.spans(tree) if x[1] != "NP"}
    assert trees.subtree(tree, [0, 2]) == "(ROOT (S (NP (PRP we)) (VP (NP (NN bread)))))"
    assert trees.subtree(tree, range(4)) == tree and trees.subtree(tree, []) == trees.subtree(None, [0]) == ""
    assert trees.relative_position(tree, by["VBP"], by["NN"]) == "right" and trees.relative_position(tree, by["NN"], by["PRP"]) == "left"
    assert trees.relative_position(tree, by["VP"], by["NN"]) == trees.relative_position(tree, by["NN"], by["S"]) == trees.relative_position(tree, by["VP"], by["VP"]) == "middle"


#: Words of training and of new documents; only function words are common to both.
WORDS = (
    {"NN": "dog cat farmer teacher boat garden letter".split(), "VBP": "see want paint carry leave open".split(), "JJ": "old green tired quiet".split()},
    {"NN": "singer miner bridge kettle window pilot".split(), "VBP": "hold break clean follow visit".split(), "JJ": "small loud happy wet".split()},
)


def _leaf(tag, word):
    return f"({tag} {word})", [(word, tag)]


def _node(label, *parts):
    return f"({label} {' '.join(p for p, _ in parts)})", [x for _, ws in parts for x in ws]


def _noun(draw, words):
    pick = lambda tag: _leaf(tag, draw.choice(words[tag]))
    kind = draw.randrange(3)
    if kind == 0:
        return _node("NP", _leaf("PRP", draw.choice(["we", "they", "you"])))
    return _node("NP", _leaf("DT", "the"), *([pick("JJ")] if kind == 2 else []), pick("NN"))


def _verb(draw, words):
    verb = _leaf("VBP", draw.choice(words["VBP"]))
    if draw.random() < 0.2:  # no connective
        return _node("VP", verb, _node("ADJP", _leaf("RB", "so"), _leaf("JJ", draw.choice(words["JJ"]))))
    return _node("VP", verb, *([_noun(draw, words)] if draw.random() < 0.6 else []))


def _documents(seed, n, words):
    """Documents of three sentences: reason, condition, contrast, result in the next sentence, or none."""
    draw, rows, known = random.Random(seed), [], []
    stop = _leaf(".", ".")
    for d in range(n):
        for k in (1, 2, 3):
            sid = f"{seed}-{d}|{k}"
            a, v, b = _noun(draw, words), _verb(draw, words), _node("S", _noun(draw, words), _verb(draw, words))
            size = lambda *parts: sum(len(p[1]) for p in parts)
            kind = draw.choice(["because", "if", "but", "so", "none"] if k > 1 else ["because", "if", "but", "none"])
            x = _node("S", a, v, stop)
            if kind == "because":
                x = _node("S", a, _node("VP", v, _node("SBAR", _leaf("IN", "because"), b)), stop)
                at = size(a, v)
                found = (at, sid, range(at), range(at + 1, at + 1 + size(b)), "Reason")
            elif kind == "if":
                x = _node("S", _node("SBAR", _leaf("IN", "if"), b), _leaf(",", ","), a, v, stop)
                at = size(b) + 2
                found = (0, sid, range(at, at + size(a, v)), range(1, 1 + size(b)), "Condition")
            elif kind == "but":
                x = _node("S", _node("S", a, v), _leaf(",", ","), _leaf("CC", "but"), b, stop)
                at = size(a, v) + 1
                found = (at, sid, range(at - 1), range(at + 1, at + 1 + size(b)), "Contrast")
            elif kind == "so":
                x = _node("S", _node("ADVP", _leaf("RB", "so")), a, v, stop)
                found = (0, f"{seed}-{d}|{k - 1}", range(len(rows[-1][3]) - 1), range(1, 1 + size(a, v)), "Result")
            tokens, tags = map(list, zip(*x[1], strict=True))
            rows.append((f"{seed}-{d}", k, sid, tokens, tags, f"(ROOT {x[0]})"))
            if kind != "none":
                at, other, one, two, sense = found
                clean = lambda ids, own: [i for i in ids if own[i] not in trees.PUNCTUATION]
                before = rows[-2][3] if other != sid else tokens
                known.append((sid, [at], other, clean(one, before), clean(two, tokens), sense))
    return rows, known


def test_unseen_documents(spark):
    rows, known = _documents(1, 150, WORDS[0])
    learned = discourse.examples(spark.createDataFrame(rows, SHAPE), spark.createDataFrame(known, GOLD), TABLE)
    models = discourse.fit(learned)
    assert set(models) == set(discourse.STEPS)
    rows, known = _documents(2, 150, WORDS[1])
    new = spark.createDataFrame(rows, SHAPE)
    found = {(r["doc"], r["sent_idx"], tuple(r["indices"])): r for r in discourse.parse(new, models, table=TABLE).collect()}
    gold = {(s.split("|")[0], int(s.split("|")[1]), tuple(at)): (int(o.split("|")[1]), a, b, sense) for s, at, o, a, b, sense in known}
    right = {k for k in found if k in gold}
    assert len(right) >= 0.95 * len(found) and len(right) >= 0.95 * len(gold)
    share = lambda same: sum(same(found[k], gold[k]) for k in right) / len(right)
    words = lambda s, ids: [i for i in ids if i < len(s) and s[i] not in trees.PUNCTUATION]
    text = {(r[0], r[1]): r[3] for r in rows}
    assert share(lambda r, g: r["sense"] == g[3]) >= 0.95 and share(lambda r, g: r["arg1_idx"] == g[0]) >= 0.95
    assert share(lambda r, g: words(text[r["doc"], r["arg1_idx"]], r["arg1"]) == g[1]) >= 0.9
    assert share(lambda r, g: words(text[r["doc"], r["sent_idx"]], r["arg2"]) == g[2]) >= 0.9
    # one row at a time gives the same
    own = [discourse.Sentence(*r[3:]) for r in rows]
    cases = [(own[i], own[i - 1] if r[1] > 1 else None, [n]) for i, r in enumerate(rows) for n, w in enumerate(r[3]) if w in ("because", "if", "but", "so")]
    assert [discourse.judge(models, [c])[0] for c in cases] == discourse.judge(models, cases) and discourse.judge(models, []) == []
