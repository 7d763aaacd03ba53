"""Ids, extraction, conceptualization, sources and streams on hand-made rows."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from evkg.functions import ids, text
from evkg.operators import concepts, extract, graph, lookup, trees
from evkg.sources import corpus
from evkg.streaming import upsert

ARMY = ("My army will find your boat .", "my army will find you boat .", "PRP$ NN MD VB PRP$ NN .", [(1, "nmod:poss", 0), (3, "nsubj", 1), (3, "aux", 2), (3, "dobj", 5), (3, "punct", 6), (5, "nmod:poss", 4)])
SURE = (
    "In the meantime , I 'm sure we could find you suitable accommodations .", "in the meantime , I be sure we could find you suitable accommodation .", "IN DT NN , PRP VBP JJ PRP MD VB PRP JJ NNS .",
    [(2, "case", 0), (2, "det", 1), (6, "nmod:in", 2), (6, "punct", 3), (6, "nsubj", 4), (6, "cop", 5), (6, "ccomp", 9), (6, "punct", 13), (9, "nsubj", 7), (9, "aux", 8), (9, "iobj", 10), (9, "dobj", 12), (12, "amod", 11)],
)


PARSE = "(ROOT (S (PP (IN In) (NP (DT the) (NN meantime))) (, ,) (NP (PRP I)) (VP (VBP 'm) (ADJP (JJ sure) (SBAR (S (NP (PRP we)) (VP (MD could) (VP (VB find) (NP (PRP you)) (NP (JJ suitable) (NNS accommodations)))))))) (. .)))"


@pytest.mark.parametrize(("words", "tags", "want"), [("i think", "PRP VBP", "269dda803d3ec7cea532a0cb1ccda7c855a0c222"), ("i ordered", "PRP VBD", "9a557e7b3187e7629dd58ef08d59763a934777aa"), ("they looked", "PRP VBD", "5f9816d1ded488fee20664808c8cdbd954743a1c")])
def test_node_ids(spark, words, tags, want):
    df = spark.createDataFrame([(words.split(), tags.split(), [(1, "nsubj", 0)])], "w array<string>, t array<string>, d array<struct<gov:int,dep:string,dpt:int>>")
    assert df.select(ids.eid("w", "t", "d")).first()[0] == want


def test_concept_ids(spark):
    df = spark.createDataFrame([("meat have flavor",), ("__PERSON__0 like inorganic-contaminant",)], "w string").select(ids.cid(F.split("w", " ")))
    assert [r[0] for r in df.collect()] == ["5a49d855f23b29d0a769d638a0944c0d35815ca9", "86e7181b3e449dd70dd9bd0eebcca5b73b432a8c"]


def sentences(spark):
    rows = [(f"d|{i}", t.split(), m.split(), p.split(), d) for i, (t, m, p, d) in enumerate((ARMY, SURE))]
    return spark.createDataFrame(rows, "sid string, tokens array<string>, lemmas array<string>, pos_tags array<string>, dependencies array<struct<gov:int,dep:string,dpt:int>>")


def test_extraction(spark):
    got = {(r["sid"], " ".join(r["words"]), r["pattern"]) for r in extract.extract(sentences(spark)).collect()}
    assert ("d|0", "my army will find you boat", "s-v-o") in got
    assert ("d|1", "we could find you suitable accommodation", "s-v-o-o") in got
    assert not [g for g in got if "meantime ," in g[1]]
    assert extract.eventualities(["who", "runs"], ["who", "run"], ["WP", "VBZ"], [(1, "nsubj", 0)]) == []
    halves = {(r["sid"], " ".join(r["words"]), tuple(r["raw_idx"])) for r in extract.extract(sentences(spark).withColumn("parse", F.when(F.col("sid") == "d|1", F.lit(PARSE))), clause_split=True).collect()}
    assert ("d|1", "i be sure", (4, 5, 6)) in halves and ("d|1", "we could find you suitable accommodation", (7, 8, 9, 10, 11, 12)) in halves


# One sentence for each pattern: words, tags, edges, what comes out.
BY_PATTERN = [
    ("they go out", "PRP VBP RP", [(1, "nsubj", 0), (1, "compound:prt", 2)], "s-v", "they go out"),
    ("they see two dogs", "PRP VBP CD NNS", [(1, "nsubj", 0), (1, "dobj", 3), (3, "nummod", 2)], "s-v-o", "they see two dogs"),
    ("they give me food", "PRP VBP PRP NN", [(1, "nsubj", 0), (1, "iobj", 2), (1, "dobj", 3)], "s-v-o-o", "they give me food"),
    ("it be two good", "PRP VBZ CD JJ", [(3, "nsubj", 0), (3, "cop", 1), (3, "dep", 2)], "s-be-a", "it be good"),
    ("it be a dog", "PRP VBZ DT NN", [(3, "nsubj", 0), (3, "cop", 1), (3, "det", 2)], "s-be-o", "it be a dog"),
    ("they want to be good", "PRP VBP TO VB JJ", [(1, "nsubj", 0), (1, "xcomp", 4), (4, "mark", 2), (4, "cop", 3)], "s-v-be-a", "they want to be good"),
    ("they want to be king", "PRP VBP TO VB NN", [(1, "nsubj", 0), (1, "xcomp", 4), (4, "mark", 2), (4, "cop", 3)], "s-v-be-o", "they want to be king"),
    ("they want to eat food", "PRP VBP TO VB NN", [(1, "nsubj", 0), (1, "xcomp", 3), (3, "mark", 2), (3, "dobj", 4)], "s-v-v-o", "they want to eat food"),
    ("they want to go", "PRP VBP TO VB", [(1, "nsubj", 0), (1, "xcomp", 3), (3, "mark", 2)], "s-v-v", "they want to go"),
    ("they feel good", "PRP VBP JJ", [(1, "nsubj", 0), (1, "xcomp", 2)], "s-v-a", "they feel good"),
    ("they be see", "PRP VBD VBN", [(2, "nsubjpass", 0), (2, "auxpass", 1)], "spass-v", "they be see"),
    ("they ask him to eat food", "PRP VBP PRP TO VB NN", [(1, "nsubj", 0), (1, "dobj", 2), (1, "xcomp", 4), (4, "mark", 3), (4, "dobj", 5)], "s-v-o-v-o", "they ask him eat food"),
    ("they make him be good", "PRP VBP PRP VB JJ", [(1, "nsubj", 0), (1, "dobj", 2), (1, "xcomp", 4), (4, "cop", 3)], "s-v-o-be-a", "they make him be good"),
    ("they make him be king", "PRP VBP PRP VB NN", [(1, "nsubj", 0), (1, "dobj", 2), (1, "xcomp", 4), (4, "cop", 3)], "s-v-o-be-o", "they make him be king"),
    ("they be ask to eat food", "PRP VBD VBN TO VB NN", [(2, "nsubjpass", 0), (2, "auxpass", 1), (2, "xcomp", 4), (4, "mark", 3), (4, "dobj", 5)], "spass-v-v-o", "they be ask eat food"),
    ("they be give food", "PRP VBD VBN NN", [(2, "nsubjpass", 0), (2, "auxpass", 1), (2, "dobj", 3)], "spass-v-o", "they be give food"),
    ("there be a dog", "EX VBZ DT NN", [(1, "expl", 0), (1, "nsubj", 3), (3, "det", 2)], "there-be-o", "there be a dog"),
    ("they ask him to give me food", "PRP VBP PRP TO VB PRP NN", [(1, "nsubj", 0), (1, "dobj", 2), (1, "xcomp", 4), (4, "mark", 3), (4, "iobj", 5), (4, "dobj", 6)], "s-v-o-v-o-o", "they ask him give me food"),
    ("it be good after lunch", "PRP VBZ JJ IN NN", [(2, "nsubj", 0), (2, "cop", 1), (2, "nmod:after", 4), (4, "case", 3)], "s-be-a", "it be good"),
]


@pytest.mark.parametrize("case", BY_PATTERN, ids=lambda c: c[3])
def test_patterns(case):
    words, tags, edges, pattern, want = case
    got = [(g["pattern"], " ".join(g["words"])) for g in extract.eventualities(words.split(), words.split(), tags.split(), edges)]
    assert (pattern, want) in got


def test_match_rules():
    said = lambda words, tags, edges: [" ".join(g["words"]) for g in extract.eventualities(words.split(), words.split(), tags.split(), edges)]
    within = [(1, "nsubj", 0), (1, "ccomp", 3), (3, "nsubj", 2), (3, "xcomp", 5), (5, "mark", 4), (5, "dobj", 6)]
    assert said("i say they want to eat food", "PRP VBP PRP VBP TO VB NN", within) == ["i say"]  # no s-v-v-o inside a clause of saying
    # a leading preposition goes, with its edges; only the first case word of the last modifier comes along
    lead = [(2, "nsubj", 1), (1, "case", 0), (2, "nmod:to", 5), (5, "case", 3), (5, "case", 4)]
    assert said("of dogs go up to town", "IN NNS VBP IN TO NN", lead) == ["dogs go up town"]
    assert trees.segments(4, [(2, "compound", 0), (2, "compound", 1), (3, "nsubj", 2)]) == [(2, 0, 2), (3, 3, 3)]
    assert trees.segments(4, [(3, "compound", 0), (3, "compound", 2)]) == [(0, 0, 0), (1, 1, 1), (2, 2, 3)]
    assert trees.strip([",", "a", ",", "b", "."], [0, 1, 2, 3, 4]) == [1, 2, 3]
    assert trees.lowest_common(PARSE, [7, 8]) == "S" and trees.path_to_root(PARSE, 4) == ["PRP", "NP", "S", "ROOT"]
    # an edge outside the allow-list of the verb rejects
    assert extract.eventualities("they go x".split(), "they go x".split(), ["PRP", "VBP", "NN"], [(1, "nsubj", 0), (1, "strange", 2)]) == []


def test_seed_form(spark):
    df = spark.createDataFrame([(["he", "meet", "paris", "and", "rome", "paris", "she"], ["O", "O", "CITY", "O", "CITY", "CITY", "O"])], "w array<string>, n array<string>")
    assert df.select(concepts.seed_form(F.col("w"), F.col("n"))).first()[0] == ["__PERSON__0", "meet", "__CITY__0", "and", "__CITY__1", "__CITY__0", "__PERSON__1"]


def test_conceptualize(spark):
    tax = spark.createDataFrame([("food", "bread", 10), ("carbohydrate", "bread", 3), ("product", "bread", 1), ("food", "egg", 6), ("animal product", "egg", 2)], "concept string, instance string, freq long")
    nodes = spark.createDataFrame([("e1", "s-v-o", ["i", "eat", "bread"], ["PRP", "VBP", "NN"], ["O"] * 3), ("e2", "s-v", ["he", "run"], ["PRP", "VBZ"], ["O"] * 2), ("e3", "s-v-o", ["egg", "beat", "egg", "bread"], ["NN", "VBP", "NN", "NN"], ["O"] * 4)], "eid string, pattern string, skeleton_phrases array<string>, skeleton_pos array<string>, skeleton_ners array<string>")
    got = {(r["eid"], " ".join(r["words"])): r["score"] for r in concepts.conceptualize(nodes, tax, 2).collect()}
    assert got["e1", "__PERSON__0 eat food"] == pytest.approx(10 / 14) and got["e2", "__PERSON__0 run"] == 1.0
    best = {"food beat food bread": 6 / 8, "egg beat egg food": 10 / 14, "food beat food food": 6 / 8 * 10 / 14, "animal-product beat animal-product bread": 2 / 8}
    assert {k[1]: v for k, v in got.items() if k[0] == "e3"} == pytest.approx(best)  # the four best of eight


def test_similarity(spark):
    df = spark.createDataFrame([(["i", "eat", "egg"], ["you", "eat"]), (["i"], ["you"]), ([], [])], "a array<string>, b array<string>")
    assert [tuple(r) for r in df.select(text.jaccard(F.col("a"), F.col("b")), text.simpson(F.col("a"), F.col("b"))).collect()] == [(0.5, 0.5), (0.0, 0.0), (0.0, 0.0)]


def test_upsert_is_order_free(spark):
    old = spark.createDataFrame([("a", 1.0, "p")], "k string, v double, pattern string")
    new = spark.createDataFrame([("a", 2.0, "z"), ("b", 1.0, "q"), ("b", 1.0, "q")], "k string, v double, pattern string")
    want = [("a", 3.0, "p"), ("b", 2.0, "q")]
    assert sorted(map(tuple, lookup.upsert(old, new, ["k"], ["v"]).collect())) == want
    assert sorted(map(tuple, lookup.upsert(old, new.orderBy(F.desc("k")), ["k"], ["v"]).collect())) == want


def test_sentence_pairs(spark, tmp_path):
    """The pairs of sentences that ``build`` writes: one sentence for co-occurrence, two for neighbours."""
    from evkg.plans import build

    texts = (("he left", "PRP VBD", [(1, "nsubj", 0)]), ("thus she wins", "RB PRP VBZ", [(2, "nsubj", 1)]), ("we go , they stay", "PRP VBP , PRP VBP", [(1, "nsubj", 0), (1, "parataxis", 4), (4, "nsubj", 3)]))
    rows = [(f"{d}|{i}", d, i, t, t.split(), t.split(), p.split(), e) for d in ("a", "b") for i, (t, p, e) in enumerate(texts)]
    sents = spark.createDataFrame(rows, "sid string, doc string, sent_idx int, text string, tokens array<string>, lemmas array<string>, pos_tags array<string>, dependencies array<struct<gov:int,dep:string,dpt:int>>")
    got = build.build(sents, spark.createDataFrame([], "concept string, instance string, freq long"), str(tmp_path))
    kinds = {r["rid"]: r["sense"] for r in got["edges"].collect()}
    pairs = sorted((kinds[r["rid"]], r["head_sid"], r["tail_sid"]) for r in got["edge_sources"].collect())
    assert pairs == [("Co_Occurrence", "a|2", "a|2"), ("Co_Occurrence", "b|2", "b|2"), ("Result", "a|0", "a|1"), ("Result", "b|0", "b|1")]
    assert tuple(graph.crossing_share(got["edge_sources"]).first()) == (4, 2, 0.5)
    from evkg.plans import facade

    again = facade.found_again(got["edge_sources"].where("head_sid LIKE 'a%'"), sents)
    assert sorted(r["sense"] for r in again.collect()) == ["Co_Occurrence", "Result"]
    gone = facade.found_again(got["edge_sources"], sents.where("sent_idx <> 1"))
    assert [r["sense"] for r in gone.collect()] == ["Co_Occurrence"]  # a neighbour is missing
    told = facade.triplets(got["occurrences"], got["relation_occurrences"]).where("head_sid = 'a|0'").collect()
    assert [(r["head"], r["sense"], r["tail"]) for r in told] == [("he left", "Result", "she wins")]
    types = build.type_counts(got["occurrences"]).where("at = 0").groupBy("ner").agg(F.sum("n").alias("n")).collect()
    assert [tuple(r) for r in types] == [("O", 8.0)]
    table = facade.connectives(spark.createDataFrame([("Result", "thus"), ("Result", "so"), ("Reason", "as")], "sense string, connective string"))
    assert table == {"Reason": ("as",), "Result": ("so", "thus")}
    said = {(r["head_text"], r["tail_text"]) for r in graph.with_texts(got["edge_sources"], sents).collect()}
    assert said == {("he left", "thus she wins"), ("we go , they stay", "we go , they stay")}


def test_slices_in_ranges(spark, tmp_path):
    """The same slices for any number of ranges, with hubs, slices that span ranges, and either limit first."""
    import hashlib
    import random

    rng = random.Random(4)
    name = lambda x: hashlib.sha1(str(x).encode()).hexdigest()
    pairs = {(name(rng.randrange(300)), name(rng.choice([rng.randrange(20), rng.randrange(900)]))) for _ in range(1_500)} | {(name(h), name(t)) for h in (7, 8) for t in range(400)}
    by = {}
    for h, t in sorted(pairs):
        by.setdefault(h, set()).add(t)
    edges = spark.createDataFrame(sorted(pairs), "hid string, tid string")
    edges = edges.union(edges.limit(100)).withColumn("rid", F.concat("hid", "tid"))  # an edge of two senses counts once
    nodes = spark.createDataFrame([(name(x),) for x in range(950)], "eid string")
    for most_nodes, most_edges in ((40, 1_000), (10_000, 60), (90, 110), (1, 1), (10_000, 100_000), (600, 700)):
        want, now, held, count = {}, 0, set(), 0
        for h in sorted(by):
            if len(held) >= most_nodes or count >= most_edges:
                now, held, count = now + 1, set(), 0
            held |= {h, *by[h]}
            count += len(by[h])
            want[h] = now
        for ranges in (1, 5, 64):
            alone, heads = graph.slices(nodes, edges, most_nodes, most_edges, ranges)
            assert {r["hid"]: r["slice"] for r in heads.collect()} == want, (most_nodes, most_edges, ranges)
    assert alone.count() == len({name(x) for x in range(950)} - set(by) - {t for own in by.values() for t in own})
    graph.write_slices(edges.dropDuplicates(["rid"]), graph.slices(nodes, edges, 600, 700, 4)[1], str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/edges").count() == len(pairs) and spark.read.parquet(f"{tmp_path}/nodes").select("slice").distinct().count() == max(want.values()) + 1
    assert graph.slices(nodes, edges.where("false"), 5, 5, 3)[1].count() == 0


def test_connective_weights(spark):
    occ = spark.createDataFrame([(1, "a", ["x", "y"]), (1, "b", ["x", "y", "z"]), (1, "c", ["q"])], "sent int, eid string, words array<string>")
    arg = lambda w: spark.createDataFrame([("c1", 1, w)], "conn string, sent int, words array<string>")
    h, t = (graph.argument_match(arg(w), occ, text.simpson) for w in (["x", "y"], ["q"]))
    assert sorted(map(tuple, graph.spread(h, t, "Reason").collect())) == [("a", "c", "Reason", 0.5), ("b", "c", "Reason", 0.5)]


def test_update_operators(spark):
    df = spark.createDataFrame([("a", 8.0), ("b", 1.0)], "k string, v double")
    d = spark.createDataFrame([("a", 2.0), ("a", 2.0)], "k string, delta double")
    got = {op: {r["k"]: r["v"] for r in lookup.apply_updates(df, "k", d, "v", op).collect()} for op in "+-*/="}
    assert {op: v["a"] for op, v in got.items()} == {"+": 12.0, "-": 4.0, "*": 32.0, "/": 2.0, "=": 2.0} and all(v["b"] == 1.0 for v in got.values())


def test_sources(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.txt").write_text("One.\nTwo.\n\nThree.\n.START\nFour.")
    assert [r["text"] for r in corpus.read_paragraphs(spark, str(tmp_path / "raw")).orderBy("para_idx").collect()] == ["One.\nTwo.", "Three.", "Four."]
    (tmp_path / "parsed").mkdir()
    rows = [{"text": t[0], "tokens": t[0].split(), "lemmas": t[1].split(), "pos_tags": t[2].split(), "dependencies": t[3]} for t in (ARMY, SURE)]
    (tmp_path / "parsed" / "a.jsonl").write_text("\n".join(map(json.dumps, [{"sentence_lens": [2, 3]}, *rows])) + "\n")
    (tmp_path / "parsed" / "b.jsonl").write_text("")
    parsed = corpus.read_parsed(spark, str(tmp_path / "parsed")).orderBy("sent_idx").collect()
    assert [(r["sent_idx"], r["para_idx"], r["dependencies"][0]["dep"]) for r in parsed] == [(1, 0, "nmod:poss"), (2, 1, "case")] and parsed[0]["sid"].endswith("|1")
    assert [r["path"][-7:] for r in corpus.unparsed(spark, str(tmp_path / "parsed")).collect()] == ["b.jsonl"]
    (tmp_path / "tax.tsv").write_text("food\tbread\t10\n")
    assert tuple(corpus.read_taxonomy(spark, str(tmp_path / "tax.tsv")).first()) == ("food", "bread", 10)
    with sqlite3.connect(tmp_path / "kg.db") as con:
        con.execute("create table Eventualities(_id text primary key, frequency real)")
        con.executemany("insert into Eventualities values (?, ?)", [(f"e{i}", float(i)) for i in range(100)])
    got = corpus.read_sqlite(spark, str(tmp_path / "kg.db"), "Eventualities", "_id string, frequency double")
    assert got.count() == 100 and got.agg(F.sum("frequency")).first()[0] == 4950.0


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1.0), ("b", 2.0)], "eid string, frequency double").write.parquet(src)
    stream = spark.readStream.schema("eid string, frequency double").parquet(src)
    for more in (False, True):
        if more:
            spark.createDataFrame([("a", 5.0)], "eid string, frequency double").write.mode("append").parquet(src)
        q = upsert.write_sums(stream, ["eid"], "frequency", str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted(map(tuple, upsert.read_sums(spark, str(tmp_path / "out"), ["eid"], "frequency").collect())) == [("a", 6.0), ("b", 2.0)]


def test_seed_relations(spark):
    from evkg.operators import relations

    rows = [("d|0", "d", 0, "i leave because he comes".split(), [(1, "advcl:because", 4)]), ("d|1", "d", 1, "thus she wins".split(), [(2, "nsubj", 1)]), ("d|2", "d", 2, "i leave instead he comes".split(), [(1, "advcl", 4)])]
    sents = spark.createDataFrame(rows, "sid string, doc string, sent_idx int, tokens array<string>, dependencies array<struct<gov:int,dep:string,dpt:int>>")
    occ = spark.createDataFrame([("d|0", "leave", 0.5, [0, 1]), ("d|0", "come", 3.5, [3, 4]), ("d|1", "win", 1.5, [1, 2]), ("d|2", "leave", 0.5, [0, 1]), ("d|2", "come", 3.5, [3, 4])], "sid string, eid string, position double, raw_idx array<int>")
    said = lambda df: [(r["hid"], r["tid"], r["sense"]) for r in df.collect()]
    assert said(relations.within(sents, occ)) == [("leave", "come", "Reason")]  # ``instead`` between them joins nothing
    assert relations.across(sents, occ).count() == 0  # the first sentence has two eventualities

    def pair(first, second, hp, tp):
        s = spark.createDataFrame([("a", "d", 0, first.split()), ("b", "d", 1, second.split())], "sid string, doc string, sent_idx int, tokens array<string>")
        return said(relations.across(s, spark.createDataFrame([("a", "h", hp), ("b", "t", tp)], "sid string, eid string, position double")))

    assert pair("he left", "thus she wins", 0.5, 1.5) == [("h", "t", "Result")]
    assert pair("he left " + "x " * 20, "thus she wins", 0.5, 1.5) == []  # too far from one another
    assert pair("he left so", "she wins", 0.5, 0.5) == [("h", "t", "Result")]  # in the first sentence
    assert pair("he left", "she wins instead", 0.5, 0.5) == [("h", "t", "ChosenAlternative")]
    assert pair("he left", "Thus she wins", 0.5, 1.5) == []  # as it is written
    longest = relations.candidates(spark.createDataFrame([("x", "in other words at the same time so".split())], "sid string, tokens array<string>"))
    assert sorted(r["indices"] for r in longest.collect()) == [[0, 1, 2], [3, 4, 5, 6], [7]]


def test_texts(spark):
    df = spark.createDataFrame([("see example.com now", True), ("mail a@b.com", False), ("no dot", False), ("http://x.y", True), ("u.s. and p.m.", False)], "t string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", text.has_url(F.col("t")).alias("got")).collect())
    long = "a" * 30 + ". " + "b" * 30 + "\n\n" + "c" * 30 + "\n" + "d" * 20 + ", " + "e" * 30
    got = spark.createDataFrame([(long,)], "t string").select(text.short_pieces(F.col("t"), 40)).first()[0]
    assert got == ["a" * 30 + ".", "b" * 30, "c" * 30, "d" * 20, "e" * 30]


def test_parser_is_given(spark):
    from evkg.plans import facade

    def parser(t):
        w = t.split()
        return [{"text": t, "tokens": w, "lemmas": w, "pos_tags": ["PRP", "VBP"], "ners": ["O"] * 2, "parse": None, "dependencies": [(0, "ROOT", 2), (2, "nsubj", 1)]}]

    paras = spark.createDataFrame([("a", 0, "we go"), ("a", 1, "they run"), ("b", 0, "we go"), ("c", 0, "i rest")], "doc string, para_idx int, text string")
    sents = facade.parse_text(paras, parser, done=spark.createDataFrame([("c",)], "doc string"))
    assert sorted((r["sid"], r["dependencies"][0]["gov"]) for r in sents.collect()) == [("a|1", 1), ("a|2", 1), ("b|1", 1)]
    found, related = facade.eventualities_and_relations(sents)
    assert found.count() == 3 and related.count() == 0
    assert sorted(r["frequency"] for r in facade.eventualities(sents, in_order=False).collect()) == [1.0, 2.0]
    with pytest.raises(ValueError):
        facade.eventualities(sents, "other")


def test_processed(spark):
    """Degrees, the highest of them, events, then names: a graph of five."""
    from evkg.operators import post

    said = {"a": "i see you", "b": "he run", "c": "be quiet", "A": "hub", "e": "they see 3 dog", "f": "lone"}
    nodes = spark.createDataFrame([(k, v.split(), 2.0) for k, v in said.items()], "eid string, words array<string>, frequency double")
    pairs = [("a", "b"), ("b", "a"), ("a", "c"), ("c", "a"), ("a", "e"), ("e", "a"), ("b", "c"), ("c", "b")] + [p for k in "abce" for p in (("A", k), (k, "A"))]
    edges = spark.createDataFrame([(h, t, "Reason", 1.0) for h, t in pairs], "hid string, tid string, sense string, weight double")
    n, e = post.processed(nodes, edges, 1, 100, 1)
    assert sorted(map(tuple, e.collect())) == sorted([("PersonX see PersonZ", "PersonY run", "Reason", 1.0), ("PersonY see PersonZ", "PersonX run", "Reason", 1.0), ("PersonX run", "PersonY see PersonZ", "Reason", 1.0), ("PersonY run", "PersonX see PersonZ", "Reason", 1.0)])
    assert {r["words"] for r in n.collect()} == {"PersonX see PersonZ", "PersonY see PersonZ", "PersonX run", "PersonY run"}
    t = spark.createDataFrame([("a$b$c$d",), ("a",)], "t string").select(text.split_triple(F.col("t")).alias("x")).collect()
    assert [tuple(r["x"]) for r in t] == [("a", "b", "c$d"), ("a", None, None)]


def test_name_persons(spark):
    from evkg.operators import post

    df = spark.createDataFrame([(["i", "see", "he"], ["he", "thank", "my", "and", "they"]), ([], ["i"]), (["we", "they", "you"], [])], "h array<string>, t array<string>")
    got = [r["p"] for r in df.select(post.name_persons(F.col("h"), F.col("t")).alias("p")).collect()]
    assert got[0]["head"] == ["PersonX", "see", "PersonY"] and got[0]["tail"] == ["PersonY", "thank", "PersonX", "and", "PeopleX"]
    assert got[1]["tail"] == ["PersonX"] and got[2]["head"] == ["PeopleX", "PeopleY", "PersonX"]
    words = spark.createDataFrame([("if you go", False), ("be quiet", False), ("he leave", True), ("-lsb- he leave", False)], "w string, want boolean")
    assert all(r["want"] == r["got"] for r in words.select("want", post.keep_event(F.split("w", " ")).alias("got")).collect())
    edges = spark.createDataFrame([("a", "b", s, 1.0) for s in ("Reason", "Result", "Conjunction", "Contrast")], "hid string, tid string, sense string, weight double")
    ways = {k: sorted((r["eid"], r["sense"]) for r in post.by_direction(edges, k).collect()) for k in post.DIRECTIONS}
    assert ways["effect"] == [("a", "Conjunction"), ("a", "Result"), ("b", "Conjunction"), ("b", "Reason")]
    assert ways["cause"] == [("a", "Conjunction"), ("a", "Reason"), ("b", "Conjunction"), ("b", "Result")] and len(ways["stative"]) == 6


def test_tree_paths():
    nodes = trees.spans("(ROOT (S (NP (PRP we)) (VP (VBP sell) (NP (NN bread))) (. .)))")
    by = {x[1]: x for x in nodes if x[1] != "NP"}
    tree = "(ROOT (S (NP (PRP we)) (VP (VBP sell) (NP (NN bread))) (. .)))"
    assert [x[1] for x in trees.siblings(tree, by["VP"])] == ["NP", "."] and [x[1] for x in trees.siblings(tree, by["VP"], "left")] == ["NP"]
    assert [x[1] for x in trees.siblings(tree, by["VP"], "right")] == ["."] and trees.siblings(tree, by["ROOT"]) == []
    assert trees.node_path(tree, by["PRP"], by["NN"]) == "PRP>NP>S<VP<NP<NN" and trees.node_path(tree, by["NN"], by["VP"]) == "NN>NP>VP"
    assert trees.compressed(["a", "a", "b", "a"]) == ["a", "b", "a"] and trees.compressed([]) == []


def test_paths_and_paragraphs(spark, tmp_path):
    (tmp_path / "raw" / "in").mkdir(parents=True)
    (tmp_path / "raw" / "in" / "a.b.txt").write_text("x" * 30 + "\n" + "y.START z\n")
    (tmp_path / "raw" / "b.txt").write_text(".START 1\nOne\r\n\r\n \nTwo\n.START")
    read = lambda most: sorted((r["path"][-5:], r["para_idx"], r["text"]) for r in corpus.read_paragraphs(spark, str(tmp_path / "raw"), most).collect())
    assert read(20) == sorted([("b.txt", 0, "x" * 30), ("b.txt", 1, "y.START z"), ("b.txt", 0, "One"), ("b.txt", 1, "Two")])
    assert [x[2] for x in read(100) if x[2].startswith("x")] == ["x" * 30 + "\ny.START z"]
    paths = corpus.list_paths(spark, str(tmp_path / "raw"), "txt")
    corpus.write_paths(paths, str(tmp_path / "list"))
    root = paths.orderBy("path").first()["path"].rsplit("/", 1)[0]
    assert sorted(r["name"] for r in corpus.read_paths(spark, str(tmp_path / "list"), root).collect()) == ["b.txt", "in/a.b.txt"]
    names = spark.createDataFrame([("a/x.b.txt",), ("x",)], "p string").select(corpus.change_extension(F.col("p")))
    assert [r[0] for r in names.collect()] == ["a/x.b.jsonl", "jsonl"]


def test_store(spark, tmp_path):
    from evkg.sources import store

    nodes = spark.createDataFrame([("a", "we go", 1.0), ("b", "they go", 2.0)], "eid string, words string, frequency double")
    store.write({"nodes": nodes}, str(tmp_path / "kg"))
    for mode in store.MODES:
        with store.Store(spark, str(tmp_path / "kg"), mode, "words") as kg:
            assert kg.names() == ["nodes"] and kg.table("nodes").where("words = 'we go'").first()["eid"] == "a"
            assert bool(kg.held) == (mode != "insert")
    with store.Store(spark, str(tmp_path / "kg"), "memory") as kg:
        kg.append("nodes", nodes.limit(1))
        assert kg.table("nodes").count() == 3
    for wrong in ({"mode": "x"}, {"grain": "x"}, {"kind": "mongo"}):
        with pytest.raises(ValueError):
            store.Store(spark, str(tmp_path / "kg"), **wrong)
    corpus.write_sqlite(nodes.withColumn("l", F.split("words", " ")), str(tmp_path / "kg.db"), "Nodes")
    with sqlite3.connect(tmp_path / "kg.db") as con:
        assert con.execute('SELECT eid, frequency, l FROM "Nodes" ORDER BY eid').fetchall() == [("a", 1.0, '["we","go"]'), ("b", 2.0, '["they","go"]')]


def test_parsed_files(spark, tmp_path):
    sents = sentences(spark).withColumns({"doc": F.lit("d"), "sent_idx": F.substring("sid", 3, 9).cast("int"), "para_idx": F.substring("sid", 3, 9).cast("int"), "text": F.array_join("tokens", " ")})
    corpus.write_parsed_files(sents, str(tmp_path / "p"))
    back = corpus.read_parsed(spark, str(tmp_path / "p")).orderBy("sent_idx").collect()
    assert [(r["text"], r["para_idx"], r["sent_idx"]) for r in back] == [(ARMY[0], 0, 1), (SURE[0], 1, 2)]
    assert [tuple(x) for x in back[0]["dependencies"]] == ARMY[3] and corpus.unparsed(spark, str(tmp_path / "p")).count() == 0
    corpus.write_parsed(sents, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


TABLE = {"Reason": ("because", "if..then"), "Result": ("so",)}


def _talk(names):
    """Documents of three sentences: one with its reason, one with its result in the next, which has a phrase that is none."""
    rows, known = [], []
    for i, n in enumerate(names):
        texts = (
            (f"{n} stay because it rain .", "NN VBP IN PRP VBP .", f"(ROOT (S (NP (NN {n})) (VP (VBP stay) (SBAR (IN because) (S (NP (PRP it)) (VP (VBP rain))))) (. .)))"),
            (f"{n} sleep .", "NN VBP .", f"(ROOT (S (NP (NN {n})) (VP (VBP sleep)) (. .)))"),
            (f"so {n} like so much .", "RB NN VBP RB JJ .", f"(ROOT (S (RB so) (NP (NN {n})) (VP (VBP like) (ADJP (RB so) (JJ much))) (. .)))"),
        )
        rows += [(f"d{i}", k, f"d{i}|{k}", t.split(), p.split(), x) for k, (t, p, x) in enumerate(texts, 1)]
        known += [(f"d{i}|1", [2], f"d{i}|1", [0, 1], [3, 4], "Reason"), (f"d{i}|3", [0], f"d{i}|2", [0, 1], [1, 2, 3, 4], "Result")]
    return rows, known


def test_discourse(spark):
    from evkg.operators import discourse

    shape, gold = "doc string, sent_idx int, sid string, tokens array<string>, pos_tags array<string>, parse string", "sid string, indices array<int>, arg1_sid string, arg1 array<int>, arg2 array<int>, sense string"
    rows, known = _talk(["ann", "bo", "cy"])
    learned = discourse.examples(spark.createDataFrame(rows, shape), spark.createDataFrame(known, gold), TABLE).cache()
    counts = {(r["step"], r["label"]): r["count"] for r in learned.groupBy("step", "label").count().collect()}
    assert counts[("connective", "1")] == 6 and counts[("connective", "0")] == 3 and counts[("position", "SS")] == counts[("position", "PS")] == 3
    assert counts[("constituent", "1")] == 6 and counts[("constituent", "2")] == 3  # noun and verb before, clause after
    models = discourse.fit(learned)
    assert set(models) == set(discourse.STEPS) and models["sense"].labels == ["Reason", "Result"]
    rows, known = _talk(["dee", "ed"])
    new = spark.createDataFrame(rows, shape)
    got = sorted((r["doc"], r["sent_idx"], r["indices"], r["arg1_idx"], r["arg1"], r["arg2"], r["sense"]) for r in discourse.parse(new, models, table=TABLE).collect())
    assert got == sorted((s[:2], int(s[3:]), at, int(t[3:]), a, b, sense) for s, at, t, a, b, sense in known)
    places = [("d0", 1, "e1", [0, 1]), ("d0", 1, "e2", [3, 4]), ("d0", 2, "e3", [0, 1]), ("d0", 3, "e4", [1, 2]), ("d0", 3, "e5", [2, 3])]
    placed = spark.createDataFrame(places, "doc string, sent_idx int, eid string, places array<int>")
    edges = discourse.edges(discourse.parse(new, models, table=TABLE), placed, text.simpson)
    assert sorted(map(tuple, edges.select("hid", "tid", "sense", "weight").collect())) == [("e1", "e2", "Reason", 1.0), ("e3", "e4", "Result", 0.5), ("e3", "e5", "Result", 0.5)]
    some = spark.createDataFrame([("d0|3",)], "sid string")  # sentences without eventualities count as empty
    assert discourse.parse(new, models, some, TABLE).count() == 0
    assert discourse.parse(new.where("false"), models, table=TABLE).count() == 0 and discourse.fit(learned.where("false")) == {}
    s = discourse.Sentence("if it rain , then we stay .".split(), "IN PRP VBP , RB PRP VBP .".split(), None)
    assert discourse.parallel([0, 4]) and discourse.between(s, [0, 4]) == ([1, 2], [5, 6]) and discourse.constituents(s, [0]) == []
    assert discourse.without(s, [0, 1, 2, 3, 4, 5, 6], [(1, 2)]) == [0, 4, 5, 6] and discourse.filled(s, [2, 4]) == [2, 3, 4]


def test_build(spark, tmp_path):
    from evkg.plans import build

    sents = sentences(spark).withColumn("doc", F.lit("d")).withColumn("sent_idx", F.substring("sid", 3, 9).cast("int")).withColumn("ners", F.transform("tokens", lambda t: F.when(t == "boat", "CITY").otherwise("O")))
    twice = sents.union(sents.withColumn("sid", F.concat(F.lit("e"), "sid")).withColumn("doc", F.lit("e")))
    tax = spark.createDataFrame([("building", "accommodation", 3), ("place", "accommodation", 1)], "concept string, instance string, freq long")
    got = build.build(twice, tax, str(tmp_path), 2.0, 2.0, 1.0, 2)
    nodes = {" ".join(r["words"]): r for r in got["nodes"].collect()}
    assert {"my army will find you boat", "we could find you suitable accommodation"} <= nodes.keys() and all(r["frequency"] == 2.0 for r in nodes.values())
    assert nodes["my army will find you boat"]["ners"] == ["O"] * 5 + ["CITY"]
    ids = {r["eid"] for r in nodes.values()}
    edges = got["edges"].collect()
    assert all(r["hid"] in ids and r["tid"] in ids and r["weight"] >= 2.0 for r in edges) and got["core_edges"].count() == len(edges)
    named = {" ".join(r["words"]): r["weight"] for r in got["concepts"].collect()}
    assert named["__PERSON__0 find __PERSON__1 building"] == pytest.approx(2 * 3 / 4) and any("__CITY__0" in w for w in named)
    held = got["node_sources"].groupBy("eid").agg(F.count("*").alias("n")).collect()
    assert [r["n"] for r in held] == [2] * len(nodes)  # a row for each sentence of a node
    pairs = {tuple(r) for r in got["edge_sources"].select("head_sid", "tail_sid").collect()}
    assert pairs and all(a.rsplit("|", 1)[0] == b.rsplit("|", 1)[0] for a, b in pairs)
    texts = graph.with_texts(got["edge_sources"], twice.withColumn("text", F.array_join("tokens", " ")))
    assert texts.count() == got["edge_sources"].count() and graph.crossing_share(got["edge_sources"]).first()["n"] == len(got["edge_sources"].collect())
    assert set(got) == {"occurrences", "relation_occurrences", "nodes", "edges", "core_nodes", "core_edges", "concept_pairs", "concepts", "concept_edges", "node_sources", "edge_sources"}
    assert build.build(twice.where("false"), tax, str(tmp_path / "none"))["concept_edges"].count() == 0
