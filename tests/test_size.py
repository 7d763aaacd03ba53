"""What must not grow: partitions, plans and comparisons."""

import time

from pyspark.sql import functions as F

from evkg.operators import discourse, extract, linking, relations
from evkg.plans import facade, made

OCCURRENCES = "sid string, eid string, position double, raw_idx array<int>"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_many_phrases(spark):
    """Phrases without common words are not compared with one another."""
    words = ["And", "so", "x"] * 8_000 + ["in", "other", "words"]
    df = spark.createDataFrame([("a", words)], "sid string, tokens array<string>")
    began = time.time()
    table = {"Conjunction": ["and"], "Result": ["so"], "Restatement": ["in other words", "other words"]}
    got = relations.candidates(df, table).groupBy("connective").count().collect()
    assert {r["connective"]: r["count"] for r in got} == {"and": 8_000, "so": 8_000, "in other words": 1} and time.time() - began < 60


def test_contested_phrases(spark):
    """Phrases that share words, against plain comparison in order."""
    table = {"A": ["a", "a b", "b..a"], "B": ["b a b", "b"]}
    texts = ["a b a b b a", "b a b a b", "a", "", "b c a a b", "b b a c b a b"]
    got = {}
    for r in relations.candidates(spark.createDataFrame([(t, t.split()) for t in texts], "sid string, tokens array<string>"), table).collect():
        got.setdefault(r["sid"], []).append((r["connective"], tuple(r["indices"])))
    for t in texts:
        low, every = t.split(), []
        for sense, cs in table.items():
            for c in cs:
                one, two = ([p.split() for p in c.split("..")] + [[]])[:2]
                at = lambda w: [i for i in range(len(low)) if w and low[i : i + len(w)] == w]  # noqa: B023, E731
                run = lambda i, w: list(range(i, i + len(w)))
                found = [run(i, one) + run(j, two) for i in at(one) for j in at(two) if j >= i + len(one)] if two else [run(i, one) for i in at(one)]
                every += [(-len(x), -x[0], sense, c, x) for x in found]
        kept = []
        for x in sorted(every):
            if not any(set(x[4]) & set(y[4]) for y in kept):
                kept.append(x)
        assert sorted(got.get(t, [])) == sorted((x[3], tuple(x[4])) for x in kept)


def test_one_extraction(spark):
    """With models the steps after it read what was extracted; seed relations read occurrences once."""
    sents = made._talk(spark.createDataFrame([("d", "ann")], "doc string, n string"), F.col("n"))
    found = facade.relations_of(sents, extract.extract(sents, clause_split=True), made.TALK_TABLE, {})
    assert "nsubjpass" not in _plan(found) and {r["sense"] for r in found.collect()} == {"Co_Occurrence"}
    occ = spark.createDataFrame([("d|1", "e", 0.5, [0, 1]), ("d|1", "f", 3.5, [3, 4])], OCCURRENCES)
    within = relations.within(sents, occ, made.TALK_TABLE)
    assert _plan(within).count("LogicalRDD [sid") == 1
    assert [(r["hid"], r["tid"], r["sense"]) for r in within.collect()] == [("e", "f", "Reason")]


def test_rows_of_discourse(spark):
    """Phrases come with their sentence, by the documents' partitions alone."""
    sents = extract.dealt(made._talk(spark.createDataFrame([("d", "ann")], "doc string, n string"), F.col("n")), "doc")
    assert discourse._rows(sents, made.TALK_TABLE)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_dealt(spark, sf):
    """The sentences of a file of one row group are extracted by many tasks."""
    assert made.sentences(spark, sf, made.SENTENCES).rdd.getNumPartitions() == made._parts(spark, sf).rdd.getNumPartitions() == 8


def test_persons_in_batches(spark):
    """Names of many documents reach Python together; a person with one known mention needs no candidates of others."""
    rows = spark.createDataFrame([("d", "Ann", "PERSON"), ("d", "Ann Lee", "PERSON"), ("d", "Ann", "PERSON"), (None, "Lee", "PERSON"), ("d", None, "PERSON"), ("d", "Bo", "CITY")], "doc string, mention string, ner string")
    found = linking.same_persons(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsIn" not in plan and "ArrowEvalPython" in plan
    assert sorted(map(tuple, found.collect()), key=str) == [("d", "Ann Lee", "Ann"), ("d", "Ann", "Ann"), (None, "Lee", "Lee")]
    table = lambda data, shape: spark.createDataFrame(data, shape)
    known = table([("Ann", "e1", 0.4), ("Ann", "e2", 0.6), ("Lee", "e3", 1.0)], "mention string, entity string, freq double")
    none, pages = table([], "entity string"), table([("Ann Lee Ray", "e4")], "mention string, entity string")
    docs = table([("d", "Ann", "PERSON"), ("d", "Ann Lee", "PERSON"), ("f", "Ann", "PERSON"), ("f", "Ann Lee Ray", "PERSON"), ("f", "Lee", "CITY")], "doc string, mention string, ner string")
    got = {(r["doc"], r["mention"]): r["entity"] for r in linking.link(docs, known, pages, none, none).collect()}
    assert got == {("d", "Ann"): "e2", ("d", "Ann Lee"): "e2", ("f", "Ann"): "e4", ("f", "Ann Lee Ray"): "e4", ("f", "Lee"): "e3"}


def test_equal_sentences_are_judged_once(spark, monkeypatch):
    """Sentences of the same words after the same ones are judged once in a batch; each keeps its own relations."""
    asked = []
    monkeypatch.setattr(discourse, "judge", lambda models, cases: asked.append(len(cases)) or [(at[0] > 0, at, [len(s.tokens)], "S") for s, _, at in cases])
    sents = made._talk(spark.createDataFrame([(f"d{i:02}", n) for i, n in enumerate(("ann", "bo") * 20)], "doc string, n string"), F.col("n"))
    batches, rows = [], discourse._rows(sents, made.TALK_TABLE).drop("sid")
    local = type("Rows", (), {"drop": lambda self, c: self, "mapInPandas": lambda self, run, shape: batches.extend(run([rows.toPandas()]))})
    monkeypatch.setattr(discourse, "_rows", lambda *a: local())
    discourse.parse(sents, {})
    told = batches[0]
    # "because" of the first sentence and "so" twice of the last, for two names
    assert asked == [6] and len(told) == 40 * 3
    got = sorted((r.doc, r.sent_idx, r.connective, tuple(r.indices), r.arg1_idx) for r in told.itertuples())
    assert got == sorted((f"d{i:02}", *x) for i in range(40) for x in ((1, "because", (2,), 1), (3, "so", (0,), 2), (3, "so", (3,), 3)))


def test_shared_features(monkeypatch):
    """What several steps ask of a connective is worked out once, and a repeat gives the same."""
    s = discourse.Sentence("we sleep because it rain".split(), "PRP VBP IN PRP VBP".split(), "(ROOT (S (NP (PRP we)) (VP (VBP sleep) (SBAR (IN because) (S (NP (PRP it)) (VP (VBP rain)))))))")
    calls, basic = [], discourse._basic
    monkeypatch.setattr(discourse, "_basic", lambda *a: calls.append(a) or basic(*a))
    said = [discourse.describe("constituent", s, [2], x) for x in discourse.constituents(s, [2])]
    assert discourse.describe("sense", s, [2]) == discourse.describe("connective", s, [2]) and len(calls) == 1
    assert said == [discourse.describe("constituent", s, [2], x) for x in discourse.constituents(s, [2])] and len(said) > 1
    assert discourse.describe("sense", s, [1])[0] == "C=sleep" and len(calls) == 2


def test_few_training_rows(spark):
    """Training passes over as many partitions as its rows fill, however many they come in."""
    rows = spark.range(30).repartition(40).persist()
    assert discourse._gathered(rows).rdd.getNumPartitions() == 1 and discourse._gathered(rows).count() == 30
    assert discourse._gathered(rows.where("false")).count() == 0
    more = spark.range(discourse.ROWS * 3 + 1).repartition(40)
    assert discourse._gathered(more).rdd.getNumPartitions() == 4
    rows.unpersist()


def test_triples_stay_where_they_are_made(spark, sf):
    """Posts are moved with their heads alone: no triple, of which each head of a post has many, is shuffled or sorted unless its post has too many."""
    from evkg.plans import catalog

    plan = catalog.dialogue_inference(spark, sf)._jdf.queryExecution().executedPlan().toString()
    # both parts of the union, few and many triples: the explode stands above the only shuffle, and edges come from the table of heads
    assert plan.count("Generate explode") == plan.count("Exchange hashpartitioning") == 2 and "l_linenumber" not in plan
    one, two = plan.split("Generate explode")[1:]
    assert "Exchange hashpartitioning(post" in one and "Exchange hashpartitioning(post" in two and "Exchange hash" not in plan.split("Generate explode")[0]


def test_inference_by_hand(spark):
    """All triples of posts with few, those of the smallest draws where there are more, against plain Python; nulls and repeats of posts, heads without triples."""
    table = lambda data, shape: spark.createDataFrame(data, shape)
    senses = ["Reason", "Result", "Co_Occurrence", "Contrast"]
    edges = [(h, t, s, float(1 + (i * 7 + j * 5 + n) % 6)) for i, h in enumerate("abcd") for j, t in enumerate("vwxyz") for n, s in enumerate(senses) if (i + j * n) % 4]
    edges += [("e", "v", "Co_Occurrence", 9.0), ("f", "none", "Reason", 9.0), ("f", "v", "Reason", 1.0), ("g", None, "Reason", 5.0), (None, "v", "Reason", 5.0)]
    nodes = table([(x,) for x in "abcdefgvwxyz"] * 2, "eid string")
    posts = [(1, "a"), (1, "a"), (1, "b"), (1, "c"), (2, "d"), (3, "e"), (3, "f"), (4, "g"), (5, None), (None, "a"), (6, "q"), (1, "d")]
    draws = {(r["hid"], r["tid"], r["sense"]): r["d"] for r in table(edges, "hid string, tid string, sense string, weight double").select("hid", "tid", "sense", F.xxhash64("hid", "tid", "sense", F.lit(3)).alias("d")).collect()}
    for k, cap in ((3, 5), (2, 1_000_000), (5, 1)):
        want = []
        for post in {p for p, _ in posts}:
            rows = []
            for h in {e for p, e in posts if p == post and e}:
                total = {}
                for a, t, _, x in edges:
                    if a == h:
                        total[t] = total.get(t, 0) + x
                best = sorted(total, key=lambda t: (-total[t], t or ""))[:k]  # noqa: B023
                rows += [(post, h, s, t) for a, t, s, _ in edges if a == h and t in best and t in "abcdefgvwxyz" and s != "Co_Occurrence"] if None not in best else []
            want += sorted(rows, key=lambda r: draws[r[1], r[3], r[2]])[:cap]
        got = linking.inference(table(posts, "post int, eid string"), nodes, table(edges, "hid string, tid string, sense string, weight double"), k, cap, 3)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str), (k, cap)
