"""The link driver on hand-made names, and groups of names against all pairs."""

import random
import time

import pandas as pd

from evkg.functions.text import has_word
from evkg.operators import linking


def brute(names):
    """Groups by looking at all pairs until nothing changes."""
    least = {n: n for n in names}
    holds = lambda a, b: f" {b} " in f" {a} "
    changed = True
    while changed:
        changed = False
        for a in names:
            for b in names:
                if (holds(a, b) or holds(b, a)) and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    return [least[n] for n in names]


def test_one_person(spark):
    rng = random.Random(1)
    for _ in range(200):
        names = list({" ".join(rng.choice(["ann", "lee", "roy", "bo", "", "li"]) for _ in range(rng.randrange(1, 5))) for _ in range(12)})
        assert linking.one_person(names) == brute(names)
    many = [f"n{i} m{i % 700}" for i in range(4_300)] + [f"m{i}" for i in range(700)]
    begun = time.perf_counter()
    assert len(set(linking.one_person(many))) == 700 and time.perf_counter() - begun < 1
    rows = spark.createDataFrame([(a, b, f" {b} " in f" {a} ") for a in names for b in names], "a string, b string, want boolean")
    assert rows.where(has_word(rows["a"], rows["b"]) != rows["want"]).count() == 0


def test_link(spark):
    shape = "sid string, doc string, mentions array<struct<start:int,end:int,text:string,ner:string,link:string,entity:string>>"
    m = lambda text, ner: (0, 1, text, ner, None, None)
    rows = [
        ("a|1", "a", [m("Ann", "PERSON"), m("the bank of rome", "ORGANIZATION"), m("Nobody", "PERSON")]),
        ("a|2", "a", [m("Ann Lee", "PERSON"), m("september", "DATE"), m("Mercury", "LOCATION")]),
        ("b|1", "b", [m("Ann", "PERSON"), m("Venus", "LOCATION"), m("Lee", "CITY")]),
        ("c|1", "c", []),
        ("d|1", "d", None),
    ]
    sents = spark.createDataFrame(rows, shape)
    known = [("Ann", "Ann A", 0.5), ("Ann", "Ann B", 0.5), ("Ann Lee", "Ann B", 0.9), ("The Bank of Rome", "Bank", 0.2), ("Sept.", "September", 0.7), ("Mercury", "Mercury (names)", 1.0), ("Mercury", "Planet", 1.0), ("Mercury", "Metal", 1.0), ("Venus", "Venus (names)", 0.6), ("Lee", "Lee P", 0.6), ("Lee", "Lee City", 0.6)]
    dictionary = spark.createDataFrame(known, "mention string, entity string, freq double")
    redirects = spark.createDataFrame([("Venus", "Star")], "mention string, entity string")
    one = lambda *xs: spark.createDataFrame([(x,) for x in xs], "entity string")
    out = linking.link_sentences(sents, dictionary, redirects, one("Mercury (names)", "Venus (names)"), one("Lee P"), ["the", "of"], "w/")
    got = {r["sid"]: None if r["mentions"] is None else [(x["text"], x["entity"], x["link"]) for x in r["mentions"]] for r in out.collect()}
    # Ann is Ann Lee in the first document: of the shares 0.5 and 0.9 their mean counts
    assert got["a|1"] == [("Ann", "Ann B", "w/Ann B"), ("the bank of rome", None, None), ("Nobody", None, None)]
    assert got["a|2"] == [("Ann Lee", "Ann B", "w/Ann B"), ("september", "September", "w/September"), ("Mercury", "Metal", "w/Metal")]
    assert got["b|1"] == [("Ann", "Ann A", "w/Ann A"), ("Venus", "Star", "w/Star"), ("Lee", "Lee City", "w/Lee City")]
    assert got["c|1"] == [] and got["d|1"] is None and out.columns == sents.columns
    assert linking.link_sentences(sents.where("false"), dictionary, redirects, one("x"), one("y")).count() == 0


def test_pair_lookup(spark):
    rng = random.Random(2)
    posts = [(i, [rng.choice("abcdef") for _ in range(rng.randrange(5))]) for i in range(60)]
    triples = [(a, "r", b) for a in "abcdefg" for b in "abcdefg"]
    got = sorted(map(tuple, linking.pair_lookup(spark.createDataFrame(triples, "a string, r string, b string"), spark.createDataFrame(posts, "post int, tokens array<string>")).collect()))
    assert got == sorted((p, a, r, b) for p, t in posts for a, r, b in triples if a != b and a in t and b in t)
    assert isinstance(linking.one_person(pd.Series([], dtype=str).tolist()), list)
