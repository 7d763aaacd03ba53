"""Near-duplicates, embeddings, decontamination, components and the pipeline against brute force."""

import random
import re

import numpy as np
import xxhash

from evkg.llm import common, decontamination, embedding_dedup, simhash_dedup
from evkg.llm.common import table
from evkg.llm.graph import connected_components


def roots_of(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(250)]
    links += [(7, 7)] + links[:20]
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    want = roots_of({n for k in links for n in k}, links)
    assert got == {n: v for n, v in want.items() if n in got} and {n for a, b in links if a != b for n in (a, b)} == set(got)
    words = connected_components(spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string"))
    assert {tuple(x) for x in words.collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    assert connected_components(words.where("false").selectExpr("node as a", "root as b")).count() == 0


def brute_print(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 40
    more = [(-1, None), (-2, ""), (-3, "One"), (-4, "one \t two\x0b"), (-5, "\u00c4 b\u00a0c d"), (-6, base), (-7, base + "x"), (-7, base + "x"), (None, base), (-8, "w%d " * 3 % (1, 2, 3)), (-9, " ".join(map(str, range(90_000))))]
    df = docs.union(spark.createDataFrame(more, "doc_id long, text string")).selectExpr("*", "1 as component", "2 as n")
    got = [tuple(r) for r in simhash_dedup.simhash_components(df).select("id", "f0", "component").collect()]
    texts = [(r["doc_id"], brute_print(r["text"])) for r in df.collect()]
    key = lambda x: str(x)
    assert sorted(((i, f % 2**64) for i, f, _ in got), key=key) == sorted(texts, key=key)
    fps = sorted({f for _, f in texts})
    roots = roots_of(fps, [(a, b) for n, a in enumerate(fps) for b in fps[n + 1 :] if (a ^ b).bit_count() <= 2])
    least = {}
    for i, f in texts:
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    assert all(c == least[roots[f % 2**64]] for _, f, c in got)
    assert simhash_dedup.simhash_components(df.where("false")).count() == 0


def test_compare_is_exact():
    r = np.random.default_rng(5)
    core = r.integers(0, 2**64, 40, dtype=np.uint64)
    x = r.permutation(np.unique(np.concatenate([core, core ^ np.uint64(1), core ^ np.uint64(6), r.integers(0, 2**64, 400, dtype=np.uint64)])))
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if int(x[i] ^ x[j]).bit_count() <= 3}
    i, j, *_ = simhash_dedup.compare([x], [x], 3, True, rows=16, most=8)
    n = range(len(x))
    assert roots_of(n, want) == roots_of(n, list(zip(i.tolist(), j.tolist(), strict=True)))
    half = len(x) // 2
    i, j, *_ = simhash_dedup.compare([x[:half]], [x[half:]], 3, False, rows=16, most=8)
    got = roots_of(n, list(zip(i.tolist(), (j + half).tolist(), strict=True)))
    assert got == roots_of(n, [(a, b) for a, b in want if a < half <= b])
    steps = set(simhash_dedup.count_offsets(2))
    for a, b in [(int(x[a]), int(x[b])) for a, b in want if int(x[a] ^ x[b]).bit_count() <= 2]:
        t = [sum((v >> 16 * q & 0xFFFF).bit_count() * 32**q for q in range(4)) for v in (a, b)]
        assert t[0] - t[1] in steps or t[1] - t[0] in steps


def test_large_tiles(spark, monkeypatch):
    r = random.Random(5)
    seeds = [r.getrandbits(63) for _ in range(20)]
    prints = sorted({r.choice(seeds) ^ 1 << r.randrange(60) for _ in range(300)})
    nodes = spark.createDataFrame([(f, f, (i % 50 == 0,)) for i, f in enumerate(prints)], "id long, f0 long, tile struct<t:boolean>")
    links = [(a, b) for n, a in enumerate(prints) for b in prints[n + 1 :] if (a ^ b).bit_count() <= 2 and (prints.index(a) % 50 == 0) == (prints.index(b) % 50 == 0)]
    want = roots_of(prints, links)
    for most in (100, 0):  # the table of large tiles is broadcast, or joined with salts
        monkeypatch.setattr(simhash_dedup, "BROADCAST_TILES", most)
        got = simhash_dedup.tile_links(nodes, 1, 2, lambda t: simhash_dedup.F.array(t), chunk=40).select("a", "b").collect()
        assert roots_of(prints, [tuple(x) for x in got]) == want


def test_forests_are_disjoint():
    r = np.random.default_rng(4)
    x = [r.integers(0, 1 << 8, 60).astype(np.uint64) for _ in range(2)]
    i, j, d, f = simhash_dedup.compare(x, x, 7, True, rows=16, most=50, forests=3, part=4)
    bits = [np.bitwise_count(w[:, None] ^ w[None]).astype(int) for w in x]
    near = {(a, b) for a, b in np.argwhere((sum(bits) <= 7) & (bits[0] <= 4) & (bits[1] <= 4)).tolist() if a < b}
    got = [set(zip(i[f == k].tolist(), j[f == k].tolist(), strict=True)) for k in range(3)]
    rest = set(near)
    for own in got:
        assert own <= rest and roots_of(range(60), own) == roots_of(range(60), rest)
        rest -= own
    assert (d == sum(bits)[i, j]).all() and sum(map(len, got)) < len(near)


def brute_near(texts, k=5):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, set()).update([b" ".join(w[j : j + k]) for j in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else [b""])
    ids = sorted(sets)
    return roots_of(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])


def test_near_duplicates(spark):
    r = random.Random(9)
    texts = [(i, " ".join(r.choices(["w%d" % j for j in range(900)], k=r.randrange(60, 300)))) for i in range(120)]
    for i in range(120, 260):
        w = texts[r.randrange(120)][1].split()
        for _ in range(max(1, len(w) // 100)):
            w[r.randrange(len(w))] = "changed%d" % i
        texts.append((i, " ".join(w)))
    texts += [(300, ""), (301, None), (302, "a b"), (303, "A  b"), (5, texts[5][1])]
    df = spark.createDataFrame([*texts, (None, "a b")], "doc_id long, text string").selectExpr("*", "1 as component")
    got = {x["id"]: x["component"] for x in simhash_dedup.near_duplicates(df).collect()}
    want = brute_near(texts)
    assert got.keys() == want.keys() and np.mean([got[k] == want[k] for k in want]) > 0.99
    assert all(want[k] == want[got[k]] for k in got)  # what is grouped is near
    kept = simhash_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} == {*(k for k in got if got[k] == k), None}
    assert simhash_dedup.drop_near_duplicates(df.where("false")).count() == 0


def test_near_duplicates_of_table(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)  # the way beyond the bound; the other tests take the broadcast
    got = {x["id"]: x["component"] for x in simhash_dedup.near_duplicates(docs).collect()}
    want = brute_near([(x["doc_id"], x["text"]) for x in docs.collect()])
    again = [k for k in want if want[k] != k]
    assert np.mean([got[k] == want[k] for k in again]) > 0.99 and all(got[k] == k for k in want if k not in again)


def template_family(n, seed):
    """Texts of one template, similar at about 0.71, in pairs that are similar at 0.84 to 0.86."""
    r = random.Random(seed)
    base = ["t%d" % j for j in range(250)]
    out = []
    for i in range(n):
        own = [f"o{i}x{j}" for j in range(50)]
        copy = own.copy()
        copy[25:] = [f"c{i}x{j}" for j in range(r.randrange(22, 26))]
        out += [" ".join(base + own), " ".join(base + copy)]
    return list(enumerate(out))


def test_near_duplicates_of_template(spark, monkeypatch):
    texts = template_family(250, 1)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute_near(texts)
    assert len(set(want.values())) == 250  # only the copies are near
    for chunk in (simhash_dedup.SET_CHUNK, 20_000):  # the family in one chunk, and in several
        monkeypatch.setattr(simhash_dedup, "SET_CHUNK", chunk)
        got = {x["id"]: x["component"] for x in simhash_dedup.near_duplicates(df).collect()}
        assert got == want


def test_embeddings(spark):
    rows = [tuple(x) for x in table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding", "label").collect()]
    r = np.random.default_rng(2)
    v = np.array(rows[0][1])
    for i in range(40):
        x = v + r.normal(0, 0.02 * np.linalg.norm(v), 64)
        rows.append((10**6 + i, [float(y) for y in x], rows[0][2]))
    odd = [(-1, None, 1), (-2, [0.0] * 64, 1), (-3, [float("nan")] * 64, 1), (-4, rows[3][1], None), (-5, [float("inf")] + [1.0] * 63, 1), (-6, [], 1), (-7, [2.0 * x for x in rows[4][1]], rows[4][2]), (-8, [None] + [1.0] * 63, 1), (None, rows[5][1], rows[5][2]), (-9, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as n_links", "2 as id")
    got = {x["vec_id"]: tuple(x)[1:] for x in embedding_dedup.link_embeddings(df).collect()}
    good = [x for x in rows + odd if x[0] is not None and x[1] and len(x[1]) == 64 and x[2] is not None and None not in x[1] and np.isfinite(x[1]).all() and any(x[1])]
    links, most = [], {}
    for label in {x[2] for x in good}:
        own = [x for x in good if x[2] == label]
        m = np.array([x[1] for x in own], np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        i, j = np.nonzero(np.triu(m @ m.T >= 0.98, 1))
        links += [(own[a][0], own[b][0]) for a, b in zip(i, j, strict=True)]
    for a, b in links:
        most[a], most[b] = most.get(a, 0) + 1, most.get(b, 0) + 1
    found = sum(x[0] for x in got.values())
    assert found >= 0.97 * 2 * len(links) and all(x[0] <= most.get(k, 0) for k, x in got.items())
    want = roots_of([x[0] for x in rows + odd if x[0] is not None], links)
    assert np.mean([got[k][1] == want[k] for k in want]) > 0.99
    assert all(got[k][:2] == (0, k) and got[k][2] for k in (-1, -2, -3, -4, -5, -6, -8, -9)) and got[None][:2] == (0, None)
    split = {x["vec_id"]: tuple(x)[1:] for x in embedding_dedup.link_embeddings(df, chunk=90).collect()}
    assert split == got  # bins in many parts
    assert len(got) == len(rows) + len(odd) and embedding_dedup.link_embeddings(df.where("false")).count() == 0


def brute_leaks(docs, items):
    w = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    sh = lambda x: [tuple(x[i : i + 5]) for i in range(len(x) - 4)] if len(x) >= 5 else [tuple(x)] if x else []
    iw = {i: w(t) for i, t in items}
    df = {}
    for x in iw.values():
        for s in set(sh(x)):
            df[s] = df.get(s, 0) + 1
    n, out = len([x for x in iw.values() if x]), {}
    weight = lambda s, i: np.log1p(n / df[s]) if s in i else np.log1p(n)
    for d, t in docs:
        x = w(t)
        have = set(sh(x))
        for i, y in iw.items():
            own = set(sh(y))
            if not y or (len(y) >= 5 and not own & have):
                continue
            for at in range(max(1, len(x) - len(y) + 1)):
                win = set(sh(x[at : at + len(y)]))
                s = sum(weight(g, own) for g in own & win) / sum(weight(g, own) for g in own | win)
                if s >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), s)
    return out


def test_decontamination(spark):
    docs = [(x["doc_id"], x["text"]) for x in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    items = [(x["item_id"], x["text"]) for x in table(spark, "/root/testdata/sf0.01", "benchmark").collect()]
    long = items[0][1].split()
    docs += [(-1, None), (-2, ""), (-3, items[1][1].upper()), (-4, "so: " + " ".join([*long[:9], "other", *long[10:]]) + " end"), (-5, "tiny one"), (-3, items[1][1].upper()), (-6, " ".join(long[: len(long) // 2])), (-7, "foo " * 40_000 + items[2][1])]
    items += [(900, None), (901, ""), (902, "Tiny, one!"), (902, "Tiny, one!")]
    docs += [(-8, "so a Tiny one, " + "and more " * 9 + "tiny ONE"), (-9, "a zzq b"), (-10, "pa pe pi po"), (-11, "pa pe pi po pu"), (-12, "pa pe pi"), (-13, "tiny and one")]
    items += [(903, "zzq"), (904, "pa pe pi po")]
    d = spark.createDataFrame([*docs, (None, items[0][1])], "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as s")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontamination.find_leaks(d, b).collect()}
    want = brute_leaks([x for x in docs if x[0] != -7], items)
    assert got.pop((-7, items[2][0])) == 1.0
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert {(-3, items[1][0]), (-5, 902), (-8, 902), (-9, 903), (-10, 904), (-11, 904)} <= set(want) and not {(-12, 904), (-13, 902)} & set(want)
    assert not [k for k in want if k[0] == -6]
    kept = decontamination.drop_contaminated(d, b)
    assert kept.columns == d.columns and kept.count() == len(docs) + 1 - sum(i in {k[0] for k in got} | {-7} for i, _ in docs)
    assert decontamination.find_leaks(d.where("false"), b).count() == 0 and decontamination.find_leaks(d, b.where("false")).count() == 0


def test_leaks_of_edited_items(spark):
    r = random.Random(8)
    fresh = lambda n: ["".join(r.choices("abcdefghij", k=9)) for _ in range(n)]
    prompt = fresh(24)
    items = [(i, prompt + fresh(25)) for i in range(60)] + [(100 + i, fresh(r.randrange(50, 60))) for i in range(100)]
    docs = [(i, w[20:]) for i, w in items[:60]]  # own part of an item with a shared prompt, shorter than it
    for i, w in items[60:]:
        docs.append((i, fresh(40) + [*w[:25], "changed", *w[26:]] + fresh(40)))  # a word of a long item is another
    turned = fresh(90)
    items.append((900, turned))
    docs += [(900, fresh(9) + turned[45:] + turned[:45] + fresh(9)), (901, fresh(80) + turned[30:60]), (901, items[70][1])]  # turned halves; too little; an id with two texts
    docs, items = ([(i, " ".join(w)) for i, w in x] for x in (docs, items))
    got = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in got.collect()}
    want = brute_leaks(docs, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert len(want) == 162 and {(5, 5), (900, 900), (901, 110)} <= want.keys()


def test_shared_prompt(spark, monkeypatch):
    """A prompt that all items share brings no document together with all of them; the items themselves are found."""
    r = random.Random(9)
    fresh = lambda n: ["".join(r.choices("abcdefghij", k=8)) for _ in range(n)]
    prompt = fresh(30)
    items = [(i, " ".join(prompt + fresh(20))) for i in range(3_000)]
    docs = [(i, " ".join(fresh(20) + prompt + fresh(20))) for i in range(200)] + [(1_000 + i, " ".join(fresh(5)) + " " + items[i][1]) for i in range(0, 3_000, 100)]
    rows, real = [], decontamination.cut

    def counted(df):
        rows.append((df.columns, real(df)))
        return rows[-1][1]

    monkeypatch.setattr(decontamination, "cut", counted)
    got = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x["doc_id"], x["item_id"]) for x in got.collect()} == {(1_000 + i, i) for i in range(0, 3_000, 100)}
    pairs = [df.count() for columns, df in rows if columns == ["doc_id", "doc", "item"]]
    assert pairs and pairs[0] < 2 * 30  # not 230 documents x 3,000 items


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = table(spark, sf, "documents")
    out = p.run(spark, sf)
    assert out.columns == [*docs.columns, "slot", "shard"]
    step = p.toxic(spark, docs, sf)
    assert step.columns == docs.columns and step.schema == docs.schema
    step = p.near_copies(spark, step, sf)
    step = p.leaks(spark, step, sf)
    step = p.shards(spark, p.mixed(spark, step, sf), sf)
    key = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert key(out) == key(step)
    empty = docs.where("false")
    for _, stage in p.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
