"""Very long texts, and odd rows through the stages of the pipeline."""

import hashlib
import random

import pytest
from test_pairs import brute_leaks, brute_print

from evkg.llm import chat_format, decontamination, simhash_dedup, url_filter

SHAPE = "doc_id long, text string"


def _long(seed, n):
    draw = random.Random(seed)
    return [f"{draw.choice('abcdefgh')}{draw.randrange(40_000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def long_docs():
    """A text of 200,000 words, that with one word changed, with its end cut off, another, and one word of a million letters."""
    ws = _long(1, 200_000)
    edited = [*ws[:100_000], "Edited", *ws[100_001:]]
    return [(1, " ".join(ws)), (2, " ".join(edited)), (3, " ".join(ws[:120_000])), (4, " ".join(_long(2, 200_000))), (5, "x" * 1_000_000), (6, "")]


def test_long_fingerprints(spark, long_docs):
    got = {r["id"]: r for r in simhash_dedup.simhash_components(spark.createDataFrame(long_docs, SHAPE)).collect()}
    want = {i: brute_print(t) for i, t in long_docs}
    assert {i: r["f0"] % (1 << 64) for i, r in got.items()} == want
    assert all((got[i]["component"] == got[j]["component"]) or (a ^ b).bit_count() > 2 for i, a in want.items() for j, b in want.items())


def test_long_near_copies(spark, long_docs):
    left = simhash_dedup.drop_near_duplicates(spark.createDataFrame(long_docs, SHAPE))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4, 5, 6]  # the third shares 0.6


def test_long_leaks(spark, long_docs):
    ws = long_docs[0][1].split(" ")
    items = [(10, " ".join(ws[150_000:150_060])), (11, " ".join(ws[:30])), (12, " ".join(ws[-7:])), (13, " ".join(_long(3, 40))), (14, "x" * 1_000_000)]
    got = decontamination.find_leaks(spark.createDataFrame(long_docs, SHAPE), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert found == {(1, 10), (2, 10), (1, 11), (2, 11), (3, 11), (1, 12), (2, 12), (5, 14)}
    short = [(i, t) for i, t in long_docs if i in (5, 6)] + [(7, " ".join(ws[149_900:150_100]))]
    got = decontamination.find_leaks(spark.createDataFrame(short, SHAPE), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == set(brute_leaks(short, items)) == {(7, 10), (5, 14)}


def test_long_conversation(spark):
    said = "</s>[INST] & < " * 100_000
    rows = [(1, 0, "user", said), (1, 1, "assistant", said[::-1])] + [(2, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(20_000)]
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for k, n in ((1, 2), (2, 20_000)):
        own = [r for r in rows if r[0] == k]
        assert got[k]["n_turns"] == n and got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in own).encode()).hexdigest()
        assert got[k]["loss_sha256"] == hashlib.sha256("".join(r[3] for r in own if r[2] == "assistant").encode()).hexdigest()


def test_long_pages(spark):
    links = "".join(f'<link rel="canonical" href="http://b.example/{i}"> text ' for i in range(500))
    pages = [(1, "http://com.example.org/es/" + "p" * 50_000, "y" * 2_000_000 + links), (2, "http://b.example/499", ""), (3, "http://c.example/", "z" * 2_000_000)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got[1]["path"]) == 50_004 and [got[i]["verdict"] for i in (1, 2, 3)] == ["block", "block", "allow"]


def test_stages_of_odd_rows(spark, sf):
    """Null ids, texts, sources and languages, repeated rows and ids, long texts, and columns named like the stages' own."""
    import corpus_pipeline as p

    text = " ".join(_long(5, 60_000))
    rows = [(1, text, "en", "src0"), (1, text, "en", "src0"), (2, text + " more", None, None), (3, None, "de", "src1"), (4, "", None, "src1"), (None, "of no id " * 9, "en", None), (5, "five words are here now", "xx", "src9"), (5, "another text of the same id", "en", "src0")]
    names = "weight", "kept", "tokens", "score", "f0", "item", "component_id", "topic"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", *[f"'{n}' as {n}" for n in names])
    before = docs.collect()
    seen = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf)
        found = out.collect()
        assert out.columns[: len(docs.columns)] == docs.columns
        assert all(r in before for r in (x[: len(docs.columns)] for x in found))  # rows come out as they are
        seen[name] = sorted((r["doc_id"] or 0, (r["text"] or "")[:9]) for r in found)
    whole = sorted((r[0] or 0, (r[1] or "")[:9]) for r in before)
    assert seen["sharding"] == whole and seen["toxicity"] == whole and seen["decontamination"] == whole
    # the second is a near copy, the fourth as empty as the third; the row without an id (0) stays
    assert [i for i, _ in seen["simhash"]] == [0, 1, 1, 3, 5, 5]
