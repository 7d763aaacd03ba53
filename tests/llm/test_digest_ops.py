"""Fingerprints, filter audit and fill-in-middle against plain Python and DuckDB."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest

from evkg.llm import fill_middle, filter_audit, fingerprint, sharding
from evkg.llm.common import table


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def oracle(sf, sql):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], sorted(cur.fetchall(), key=str)


@pytest.mark.parametrize("module", [filter_audit, fill_middle])
def test_sql(spark, module):
    sf = "/root/testdata/sf0.01"
    got = module.query(spark, sf)
    names, want = oracle(sf, module.ORACLE)
    assert names == got.columns and rows(got) == want


def test_sharding_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = sharding.query(spark, sf)
    names, want = oracle(sf, sharding.oracle())
    assert names == got.columns and rows(got) == want


# Fingerprints.


def plain_codes(text):
    """Codes of a text, one triplet after the other."""
    raw = text.encode()
    n = Counter()
    for i in range(len(raw)):
        a, b, c = (raw[j] if j >= 0 else 0 for j in (i - 2, i - 1, i))
        h = (a << 16 | b << 8 | c) * 0x9E3779B1 % 2**32
        h = (h ^ h >> 15) * 0x85EBCA77 % 2**32
        n[(h >> 16) % 1024] += 1
    ordered = sorted(n[k] for k in range(1024))
    quartiles = [ordered[255], ordered[511], ordered[767]]
    return [min(255, round(8 * np.log2(len(raw) + 1)))] + [sum(n[k] > q for q in quartiles) for k in range(1024)]


def plain_digest(codes):
    return f"{codes[0]:02x}" + "".join(f"{sum(c << s for c, s in zip(codes[i : i + 4], (6, 4, 2, 0), strict=True)):02x}" for i in range(1, 1025, 4))


def plain_likeness(a, b):
    return max(0.0, 1 - (sum(abs(x - y) for x, y in zip(a[1:], b[1:], strict=True)) / 1024 + 0.2 * min(abs(a[0] - b[0]), 16) / 16) / 1.25)


def brute(docs):
    docs = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        a, b, c = map(plain_codes, (t, changed, following))
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), plain_digest(a), plain_digest(b), plain_likeness(a, b), plain_likeness(a, c)))
    return sorted(out, key=str)


def same(got, want):
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(x - y) < 1e-12 for g, w in zip(got, want, strict=True) for x, y in zip(g[5:], w[5:], strict=True))


def test_fingerprints(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    out = fingerprint.query(spark, sf)
    got = rows(out)
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    same(got, brute(docs))
    assert sum(g[5] > g[6] for g in got) > 0.97 * len(got)  # copies may follow their source
    alone = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(table(spark, sf, "documents")).collect()}
    assert alone == {g[0]: g[3] for g in got}


@pytest.mark.parametrize("partitions", ["1", "3", "50"])
def test_fingerprint_edges(spark, partitions):
    """Nulls, empty and very long texts, copies, few rows in many ranges, clashing columns."""
    long = "ein langer Text, \U0001f600 " * 60_000
    data = [(7, None, 1), (3, "", 1), (None, "no id", 1), (9, long, 1), (10, long, 1), (-4, "a", 1), (11, "b\U0001f600c", 1), (12, "same " * 50, 1), (13, "same " * 50, 1), (2**40, "\0\t\n", 1)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(data, "doc_id long, text string, range int").selectExpr("*", "1 as guest", "2 as h")
        got = rows(fingerprint.compare_neighbours(df))
        same(got, brute([d[:2] for d in data]))
        of = {g[0]: g for g in got}
        assert of[9][3] == of[10][3] and of[9][6] == of[12][6] == of[12][5] == 1.0 and of[7][3] == of[3][3]
        one = df.where("doc_id = 9")
        same(rows(fingerprint.compare_neighbours(one)), brute([(9, long)]))
        assert rows(fingerprint.compare_neighbours(df.where("false"))) == []
        # Repeated ids and rows: each row has a neighbour, and all of them make one ring.
        again = spark.createDataFrame([(1, "x" * 9), (1, "y" * 9), (1, "y" * 9), (2, "z" * 9)] * 3, "doc_id long, text string").repartition(4)
        out = fingerprint.compare_neighbours(again).collect()
        assert len(out) == 12 and sum(r["doc_id"] == 2 for r in out) == 3 and sum(r["near_next"] == 1 for r in out) == 9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fingerprint_parts(monkeypatch):
    """Long texts are counted in parts; likeness is symmetric, 1 for equals, and falls with the edit."""
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "döner", "\U0001f600"]) + str(rng.randrange(500)) for _ in range(3_000))
    whole = fingerprint.codes(text)
    few = fingerprint.codes(text[:1_000])
    for part in (1, 2, 3, 7, 1_000):
        monkeypatch.setattr(fingerprint, "PART", part)
        assert (fingerprint.codes(text[:1_000]) == few).all()
    monkeypatch.undo()
    assert whole.tolist() == plain_codes(text)
    other = "".join(rng.choice("qwertzuiop ") for _ in text)
    near = [fingerprint.likeness(whole, fingerprint.codes(text[: int(len(text) * k)] + other[int(len(text) * k) :])) for k in (1, 0.9, 0.5, 0)]
    assert near[0] == 1 and near == sorted(near, reverse=True)
    d = fingerprint.digest(whole)
    assert (fingerprint.undigest(d) == whole).all() and fingerprint.compare(d, fingerprint.digest(few)) == fingerprint.compare(fingerprint.digest(few), d)


# Filter audit.


def brute_audit(docs, labels):
    good, toxic = ({i for i, *m in labels if m[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = {}
    for n, (i, t, s) in enumerate(docs):
        t = t or ""
        w = re.findall(r"[^ \t-\r]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        fails[n] = (s or "", i, {k for k, v in f.items() if v})
    out = {}
    for part in {f[0] for f in fails.values()}:
        own = [(i, f) for p, i, f in fails.values() if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left, gone = list(own), []
            for step, x in enumerate(order, 1):
                removed = [r for r in left if x in r[1]]
                redundant = sum(x in r[1] for r in gone)
                left, gone = [r for r in left if x not in r[1]], gone + removed
                shapley[x] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, sum(r[1] == {x} for r in own), sum(r[0] in good for r in removed), sum(r[0] in toxic for r in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return sorted(((*k, *v) for k, v in out.items()), key=str)


def test_audit_edges(spark):
    """Nulls, empty and very long texts, copies over parts, repeated rows and labels, clashing columns, many parts."""
    many = " ".join(f"w{i}" for i in range(300))
    base = [many, many + " $", "ABC " * 3, "", None, "x y z " * 100, many.upper(), "long words " * 100_000, "Zeile  eins " + many]
    docs = [(i, base[i % len(base)], [None, "", "hot", "hot", f"p{i % 5}"][i % 5]) for i in range(90)]
    docs += [(i, t, "hot") for i in (3, 17) for t in (base[i % len(base)],)] + [(None, many, "hot"), (None, None, None), (None, many, "hot"), (3, "another text of an id", "q")]
    labels = [(i, *((1, 0) if i % 2 else (0, 1))) for i in range(0, 90, 3)] + [(3, None, 1), (3, 0, 0), (None, 1, 1), (4, None, None), (5, 1, 7)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as part", "2 as mask", "3 as good", "4 as h", "5 as key").repartition(5)
    m = spark.createDataFrame(labels, "doc_id long, quality long, toxic long").selectExpr("*", "9 as text", "8 as good")
    assert rows(filter_audit.audit(filter_audit.masks(d, m))) == brute_audit(docs, labels)
    assert rows(filter_audit.audit(filter_audit.masks(d.where("false"), m))) == []
    bare = rows(filter_audit.audit(filter_audit.masks(d, m.where("false"))))
    assert bare == brute_audit(docs, [])


def test_parity_sums():
    """The sums of all sets of filters give back the cells."""
    n = np.random.default_rng(1).integers(0, 10**12, 32)
    sums = [sum(int(n[m]) * (-1) ** bin(m & s).count("1") for m in range(32)) for s in range(32)]
    assert (filter_audit.invert(np.array(sums)) == n).all()
    keys, of = filter_audit.steps()
    assert len(keys) == len(set(keys)) == 600
    for letter in "ABCDE":  # closed form against the sum over all orders
        at = [i for i, k in enumerate(keys) if k[0][k[1] - 1] == letter]
        assert (of["removed"][at].sum(0) == of["shapley"][at[0]]).all()


# Fill in the middle.

TOKEN = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def brute_middle(i, text):
    text = text or ""
    toks = TOKEN.findall(text)
    assert "".join(toks) == text
    n, h = len(toks), hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return i, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(toks[:a]), "".join(toks[a:b]), "".join(toks[b:])
    return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "\t\n", "a", " a", "a ", "x<P>y", "<", "<<", "P>", "<S", "a <\n< S> <M >", "  a\u0085b c", "\U0001f600 \U0001f600\r\n", "wörter " * 60_000, "\x0b\x0c\x1c\x1d"]
    texts += ["".join(rng.choice("ab< \n\tあPSM>") for _ in range(rng.randrange(40))) for _ in range(400)]
    data = [(i * 7 % 1_000 if i % 50 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as output", "2 as form", "3 as n").repartition(3)
    out = fill_middle.fill_middle(df)
    assert rows(out) == sorted((brute_middle(*d) for d in data), key=str)
    assert {r["form"] for r in out.collect()} == {"plain", "psm", "spm"}
    back = out.select("doc_id", fill_middle.restored(fill_middle.F.col("output"), fill_middle.F.col("form")).alias("text"))
    assert rows(back) == sorted(((i, t or "") for i, t in data), key=str)
    assert fill_middle.fill_middle(df.where("false")).count() == 0
    assert {r["form"] for r in fill_middle.fill_middle(df, changed=0).collect()} == {"plain"}
