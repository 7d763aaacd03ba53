"""Queries over parses and graphs that are made of the test tables' rows, and the same in DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from evkg.functions import text
from evkg.functions.ids import rid
from evkg.operators import concepts, discourse, extract, graph, linking, lookup, persons, post, relations, sampling
from evkg.plans import tpch
from evkg.plans.registry import query
from evkg.plans.tpch import load
from evkg.sources import steps

DEPENDENCIES = "array<struct<gov:int,dep:string,dpt:int>>"
#: Sentences about a brand (``*``): tokens, lemmas, tags, edges, bracketed parse.
SENTENCES = (
    ("they were seen with *", "they be see with *", "PRP VBD VBN IN NNP", [(2, "nsubjpass", 0), (2, "auxpass", 1), (2, "nmod:with", 4), (4, "case", 3)], None),
    ("they want to go to *", "they want to go to *", "PRP VBP TO VB TO NNP", [(1, "nsubj", 0), (1, "xcomp", 3), (3, "mark", 2), (3, "nmod:to", 5), (5, "case", 4)], None),
    ("it is good after *", "it be good after *", "PRP VBZ JJ IN NNP", [(2, "nsubj", 0), (2, "cop", 1), (2, "nmod:after", 4), (4, "case", 3)], None),
    ("heart attacks kill *", "heart attack kill *", "NN NNS VBP NNP", [(1, "compound", 0), (2, "nsubj", 1), (2, "dobj", 3)], None),
)
#: What the rules make of them: pattern, words, tags, edges, skeleton words, skeleton phrases.
EXPECTED = (
    ("spass-v", "they be see with *", "PRP VBD VBN IN NNP", [(2, "nsubjpass", 0), (2, "auxpass", 1), (2, "nmod:with", 4), (4, "case", 3)], "they see", "they|see"),
    ("s-v-v", "they want to go to *", "PRP VBP TO VB TO NNP", [(1, "nsubj", 0), (1, "xcomp", 3), (3, "mark", 2), (3, "nmod:to", 5), (5, "case", 4)], "they want go", "they|want|go"),
    ("s-be-a", "it be good", "PRP VBZ JJ", [(2, "nsubj", 0), (2, "cop", 1)], "it be good", "it|be|good"),
    ("s-v-o", "heart attack kill *", "NN NNS VBP NNP", [(1, "compound", 0), (2, "nsubj", 1), (2, "dobj", 3)], "attack kill *", "heart attack|kill|*"),
)
CLAUSES = (
    "we sell * because they want it", "we sell * because they want it", "PRP VBP NNP IN PRP VBP PRP",
    [(1, "nsubj", 0), (1, "dobj", 2), (1, "advcl:because", 5), (5, "mark", 3), (5, "nsubj", 4), (5, "dobj", 6)],
    "(ROOT (S (NP (PRP we)) (VP (VBP sell) (NP (NNP *)) (SBAR (IN because) (S (NP (PRP they)) (VP (VBP want) (NP (PRP it))))))))",
)
HALVES = (("s-v-o", "we sell *", "PRP VBP NNP", [(1, "nsubj", 0), (1, "dobj", 2)]), ("s-v-o", "they want it", "PRP VBP PRP", [(1, "nsubj", 0), (1, "dobj", 2)]))


def _sentence(template, brand) -> dict:
    tokens, lemmas, tags, edges, parse = template
    words = lambda x: F.split(F.replace(F.lit(x), F.lit("*"), brand), " ")
    deps = F.array(*[F.struct(F.lit(g).alias("gov"), F.lit(d).alias("dep"), F.lit(t).alias("dpt")) for g, d, t in edges])
    return {"tokens": words(tokens), "lemmas": words(lemmas), "pos_tags": words(tags), "dependencies": deps.cast(DEPENDENCIES), "parse": F.lit(parse).cast("string")}


def sentences(s, d, templates):
    """A sentence for each part: its size picks the template, its brand is the name in it."""
    part = extract.dealt(load(s, d, "part").select(F.col("p_partkey").cast("string").alias("sid"), "p_size", "p_brand"))
    made = [F.struct(*[c.alias(n) for n, c in _sentence(t, F.col("p_brand")).items()]) for t in templates]
    pick = F.get(F.array(*made), (F.col("p_size") % len(templates)).cast("int"))
    return part.select("sid", pick.alias("x")).select("sid", "x.*")


def _sql(value: str) -> str:
    """A text with the brand in the place of the star."""
    return "replace('" + value.replace("'", "''") + "', '*', lower(p_brand))"


def _eid(words: str, tags: str, edges) -> str:
    w, t = words.split(), tags.split()
    return "sha1(" + _sql(json.dumps([[[[g, w[g], t[g]], x, [p, w[p], t[p]]] for g, x, p in edges], w, t])) + ")"


_EXTRACTED = " UNION ALL ".join(
    f"SELECT p_partkey::VARCHAR AS sid, {_eid(w, t, e)} AS eid, '{p}' AS pattern, {_sql(w)} AS words, {_sql(sk)} AS skeleton, {_sql(ph)} AS phrases FROM part WHERE p_size % {len(EXPECTED)} = {i}" for i, (p, w, t, e, sk, ph) in enumerate(EXPECTED)
)


@query(_EXTRACTED, False)
def extract_eventualities(s, d):
    out = extract.extract(sentences(s, d, SENTENCES))
    return out.select("sid", "eid", "pattern", F.array_join("words", " ").alias("words"), F.array_join("skeleton_words", " ").alias("skeleton"), F.array_join("skeleton_phrases", "|").alias("phrases"))


@query(f"SELECT sid, eid, pattern, words FROM ({_EXTRACTED})", False)
def sql_eventualities(s, d):
    from evkg.plans import facade

    facade.register(s)
    sentences(s, d, SENTENCES).createOrReplaceTempView("parsed_sentences")
    return s.sql("SELECT sid, eid, pattern, array_join(words, ' ') AS words FROM parsed_sentences, LATERAL eventualities(tokens, lemmas, pos_tags, dependencies, NULL)")


@query(f"SELECT eid, count(*)::DOUBLE AS frequency, any_value(pattern) AS pattern FROM ({_EXTRACTED}) GROUP BY 1", False)
def merged_eventualities(s, d):
    return extract.merged(extract.extract(sentences(s, d, SENTENCES))).select("eid", "frequency", "pattern")


@query(" UNION ALL ".join(f"SELECT p_partkey::VARCHAR AS sid, {_eid(w, t, e)} AS eid, '{p}' AS pattern, {_sql(w)} AS words, {at}.0::DOUBLE AS position FROM part" for (p, w, t, e), at in zip(HALVES, (1, 5), strict=True)), False)
def extract_by_clauses(s, d):
    out = extract.extract(sentences(s, d, (CLAUSES,)), clause_split=True)
    return out.select("sid", "eid", "pattern", F.array_join("words", " ").alias("words"), "position")


@query(f"SELECT {_eid(*HALVES[0][1:])} AS hid, {_eid(*HALVES[1][1:])} AS tid, 'Reason' AS sense, count(*) AS n FROM part GROUP BY ALL", False)
def seed_within(s, d):
    made = sentences(s, d, (CLAUSES,))
    return relations.within(made, extract.extract(made, clause_split=True)).groupBy("hid", "tid", "sense").agg(F.count("*").alias("n"))


#: Sentences of orders by key: tokens, place of the only eventuality.
NEIGHBOURS = (("they left so", 0.5), ("she wins", 0.5), ("thus he runs instead", 1.5), ("well and good it has been for us all here now", 9.0))


@query(f"""WITH t(k, tokens, pos) AS (VALUES {", ".join(f"({i}, string_split('{t}', ' '), {p}::DOUBLE)" for i, (t, p) in enumerate(NEIGHBOURS))}),
 o AS (SELECT o_custkey AS doc, o_orderkey AS k, tokens, pos, 'e' || (o_orderkey % {len(NEIGHBOURS)}) AS eid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders JOIN t ON o_orderkey % {len(NEIGHBOURS)} = t.k),
 p AS (SELECT a.eid AS hid, b.eid AS tid, a.pos AS hp, len(a.tokens) + b.pos AS tp, list_concat(a.tokens, b.tokens) AS w FROM o a JOIN o b ON a.doc = b.doc AND b.i = a.i + 1),
 x(sense, word) AS (VALUES ('Result', 'so'), ('Result', 'thus'), ('ChosenAlternative', 'instead'), ('Conjunction', 'and'))
 SELECT hid, tid, sense, count(*) AS n FROM (SELECT DISTINCT p.rowid AS no, hid, tid, sense FROM (SELECT *, row_number() OVER () AS rowid FROM p) p, x
   WHERE list_contains(w, word) AND tp - hp < 10 AND CASE WHEN word = 'instead' THEN list_position(w, word) - 1 > tp ELSE list_position(w, word) - 1 > hp AND list_position(w, word) - 1 < tp END) GROUP BY ALL""", False)
def seed_across(s, d):
    k = (F.col("o_orderkey") % len(NEIGHBOURS)).cast("int")
    tokens = F.get(F.array(*[F.split(F.lit(t), " ") for t, _ in NEIGHBOURS]), k)
    rows = load(s, d, "orders").select(F.col("o_orderkey").alias("sid"), F.col("o_custkey").alias("doc"), F.struct("o_orderdate", "o_orderkey").alias("sent_idx"), tokens.alias("tokens"), F.concat(F.lit("e"), k).alias("eid"), F.get(F.array(*[F.lit(p) for _, p in NEIGHBOURS]), k).alias("position"))
    return relations.across(rows, rows.select("sid", "eid", "position")).groupBy("hid", "tid", "sense").agg(F.count("*").alias("n"))


_PAIRS = f"""WITH t(k, tokens, pos) AS (VALUES {", ".join(f"({i}, string_split('{t}', ' '), {p}::DOUBLE)" for i, (t, p) in enumerate(NEIGHBOURS))}),
 o AS (SELECT o_custkey AS doc, o_orderkey AS sid, k, tokens, pos, 'e' || k AS eid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders JOIN t ON o_orderkey % {len(NEIGHBOURS)} = t.k),
 x(sense, word) AS (VALUES ('Result', 'so'), ('Result', 'thus'), ('ChosenAlternative', 'instead'), ('Conjunction', 'and')),
 p AS (SELECT a.eid AS hid, b.eid AS tid, a.sid AS head_sid, b.sid AS tail_sid, array_to_string(a.tokens, ' ') AS head_text, array_to_string(b.tokens, ' ') AS tail_text, list_concat(a.tokens, b.tokens) AS w, a.pos AS hp, len(a.tokens) + b.pos AS tp
       FROM o a JOIN o b ON a.doc = b.doc AND b.i = a.i + 1 WHERE a.k <> 3 AND b.k <> 3),
 s AS (SELECT DISTINCT hid, tid, head_sid, tail_sid, head_text, tail_text FROM p, x WHERE list_contains(w, word) AND tp - hp < 10 AND CASE WHEN word = 'instead' THEN list_position(w, word) - 1 > tp ELSE list_position(w, word) - 1 > hp AND list_position(w, word) - 1 < tp END
       UNION ALL SELECT 'e3', 'f3', sid, sid, array_to_string(tokens, ' '), array_to_string(tokens, ' ') FROM o WHERE k = 3)"""


def _paired(s, d):
    """Sentences of orders with one eventuality each, two in the last of ``NEIGHBOURS``, and the relations found in them."""
    from evkg.plans import facade

    k = (F.col("o_orderkey") % len(NEIGHBOURS)).cast("int")
    said = F.get(F.array(*[F.lit(t) for t, _ in NEIGHBOURS]), k)
    rows = load(s, d, "orders").select(F.col("o_orderkey").alias("sid"), F.col("o_custkey").alias("doc"), F.struct("o_orderdate", "o_orderkey").alias("sent_idx"), said.alias("text"), F.split(said, " ").alias("tokens"), F.array().cast(DEPENDENCIES).alias("dependencies"), k.alias("k"))
    one = lambda name, at: F.struct(F.concat(F.lit(name), "k").alias("eid"), at.cast("double").alias("position"), F.array().cast("array<int>").alias("raw_idx"))
    own = F.array(one("e", F.get(F.array(*[F.lit(p) for _, p in NEIGHBOURS]), F.col("k"))))
    own = F.when(F.col("k") == len(NEIGHBOURS) - 1, F.concat(own, F.array(one("f", F.lit(9.5))))).otherwise(own)
    return rows, facade.relations_of(rows, rows.select("sid", F.explode(own).alias("x")).select("sid", "x.*"))


@query(_PAIRS + " SELECT sha1(hid || '$' || tid) AS rid, head_sid, tail_sid, head_text, tail_text FROM s", False)
def edge_sources(s, d):
    rows, found = _paired(s, d)
    return graph.with_texts(graph.edge_sources(found), rows)


@query(_PAIRS + " SELECT count(*) AS n, CAST(sum(CASE WHEN head_sid <> tail_sid THEN 1 ELSE 0 END) AS BIGINT) AS crossing, round(avg(CASE WHEN head_sid <> tail_sid THEN 1.0 ELSE 0.0 END), 6) AS share FROM s", False)
def found_crossing_share(s, d):
    return graph.crossing_share(graph.edge_sources(_paired(s, d)[1])).withColumn("share", F.round("share", 6))


@query(f"SELECT p_partkey::VARCHAR AS sid, CAST(len(string_split(w, ' ')) - 1 AS INTEGER) AS start, lower(p_brand) AS mention FROM part, (VALUES {', '.join(f'({i}, {chr(39)}{x[1]}{chr(39)})' for i, x in enumerate(EXPECTED))}) v(i, w) WHERE p_size % {len(EXPECTED)} = i AND contains(w, '*')", False)
def eventuality_mentions(s, d):
    made = sentences(s, d, SENTENCES)
    last = F.size("tokens")
    told = F.struct((last - 1).alias("start"), last.alias("end"), F.element_at("tokens", -1).alias("text"), F.lit("ORGANIZATION").alias("ner"), F.lit(None).cast("string").alias("link"), F.element_at("tokens", -1).alias("entity"))
    out = extract.extract(made.withColumn("mentions", F.array(told)))
    return out.select("sid", F.explode("mentions").alias("m")).select("sid", "m.start", F.col("m.text").alias("mention"))


# ---- arguments, phrases, connectives ---------------------------------------------------------------


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS sent, l_linenumber AS eid, CASE WHEN l_linenumber % 2 = 0 THEN ['x', 'y'] ELSE ['z'] END AS w FROM lineitem),
 h AS (SELECT sent, eid, count(*) OVER (PARTITION BY sent) AS n FROM e WHERE w[1] = 'x'), t AS (SELECT sent, eid, count(*) OVER (PARTITION BY sent) AS n FROM e WHERE w[1] = 'z')
 SELECT h.eid AS hid, t.eid AS tid, round(sum(1.0 / (h.n * t.n)), 6)::DOUBLE AS weight FROM h JOIN t USING (sent) GROUP BY ALL""", False)
def argument_match(s, d):
    words = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("z")))
    occ = load(s, d, "lineitem").select(F.col("l_orderkey").alias("sent"), F.col("l_linenumber").alias("eid"), words.alias("words")).distinct()
    conn = occ.select(F.col("sent").alias("conn"), "sent").distinct()
    arg = lambda w: graph.argument_match(conn.withColumn("words", F.array(*[F.lit(x) for x in w])), occ, text.simpson)
    return graph.spread(arg(["x", "y"]), arg(["z"]), "Reason").groupBy("hid", "tid").agg(F.round(F.sum("weight"), 6).alias("weight"))


@query("""WITH a AS (SELECT p_partkey AS k, list_filter(range(8), lambda x: (p_size >> x) % 2 = 1) AS arg, range(p_size % 8) AS own FROM part)
 SELECT k, round(coalesce(len(list_intersect(arg, own)) / nullif(len(list_distinct(list_concat(arg, own))), 0), 0), 6) AS jaccard, list_contains(list_intersect(arg, own), 3) AS linked, list_transform(range(8), lambda x: CASE WHEN list_contains(arg, x) THEN '1' ELSE '0' END).array_to_string('') AS bits FROM a""", False)
def argument_overlap(s, d):
    arg = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda x: F.col("p_size").bitwiseAND(F.pow(F.lit(2), x).cast("int")) > 0)
    own = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda x: x < F.col("p_size") % 8)
    edges = F.array(F.struct(F.lit(9).alias("gov"), F.lit("mark").alias("dep"), F.lit(3).alias("dpt")))
    rows = load(s, d, "part").select(F.col("p_partkey").alias("k"), arg.alias("arg"), own.alias("own"))
    return rows.select("k", F.round(text.index_overlap(F.col("arg"), F.col("own")), 6).alias("jaccard"), text.linked(edges, F.array(F.lit(9)), F.col("arg"), F.col("own")).alias("linked"), F.array_join(F.transform(text.one_hot(F.col("arg"), 8), lambda x: x.cast("string")), "").alias("bits"))


@query("SELECT p_partkey AS k, p_name AS said, CASE WHEN contains(p_name, 'red') THEN true ELSE false END AS last FROM part", False)
def bracketed_text(s, d):
    parts = F.split("p_name", " ")
    made = F.concat(F.lit(" {"), parts[0], F.lit("}_[subject] {"), parts[1], F.lit(" || thing}_[verb]"))
    rows = load(s, d, "part").select(F.col("p_partkey").alias("k"), text.bracketed(made).alias("x"), parts.alias("w"))
    return rows.select("k", text.bracketed_text(F.col("x")).alias("said"), text.ends_with(F.reverse("w"), "red").alias("last"))


@query("""WITH w AS (SELECT p_partkey AS sid, CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS k FROM part)
 SELECT sid, 'either..or' AS connective, '0,2' AS indices FROM w WHERE k = 1 UNION ALL SELECT sid, 'in other words', '1,2,3' FROM w WHERE k = 2 UNION ALL SELECT sid, 'or', '0' FROM w WHERE k = 2 UNION ALL SELECT sid, 'so', '1' FROM w WHERE k = 3""", False)
def connective_phrases(s, d):
    said = F.get(F.array(*[F.split(F.lit(x), " ") for x in ("Either we or they", "or in other words", "and so they")]), (F.col("p_size") % 3).cast("int"))
    rows = load(s, d, "part").select(F.col("p_partkey").alias("sid"), said.alias("tokens"))
    table = {"Alternative": ["or", "either..or"], "Restatement": ["in other words", "other words"], "Result": ["so"]}
    return relations.candidates(rows, table).select("sid", "connective", F.array_join(F.transform("indices", lambda i: i.cast("string")), ",").alias("indices"))


# ---- concepts ---------------------------------------------------------------------------------------


@query(""", f AS (SELECT sha1(instance) AS eid, replace(concept, ' ', '-') || ' buy __PERSON__0 ' || replace(concept, ' ', '-') AS w, score FROM top)
 SELECT eid, sha1(w) AS cid, w AS words, round(score, 6) AS score FROM f""")
def conceptualize(s, d):
    brand = F.col("p_brand")
    nodes = load(s, d, "part").select("p_brand").distinct().select(F.sha1(brand).alias("eid"), F.lit("s-v-o-o").alias("pattern"), F.array(brand, F.lit("buy"), F.lit("him"), brand).alias("skeleton_phrases"), F.split(F.lit("NNP VBP PRP NNP"), " ").alias("skeleton_pos"), F.split(F.lit("O O O O"), " ").alias("skeleton_ners"))
    return concepts.conceptualize(nodes, tpch.taxonomy(s, d), 2).select("eid", "cid", F.array_join("words", " ").alias("words"), F.round("score", 6).alias("score"))


@query("SELECT c_custkey AS eid, '__CITY__0 see __CITY__1 and __PERSON__0 see __CITY__0' AS words, 1.0::DOUBLE AS score FROM customer", False)
def seed_concepts(s, d):
    own = lambda x: F.concat(F.lit(x), F.col("c_custkey"))
    nodes = load(s, d, "customer").select(F.col("c_custkey").alias("eid"), F.lit("p").alias("pattern"), F.array(own("a"), F.lit("see"), own("b"), F.lit("and"), F.lit("she"), F.lit("see"), own("a")).alias("phrases"), F.split(F.lit("CITY O CITY O O O CITY"), " ").alias("phrase_ners"))
    return concepts.seed_concepts(nodes).select("eid", F.array_join("words", " ").alias("words"), "score")


@query("SELECT n.cid, n.eid, nodes.words, frequency FROM pairs n JOIN nodes USING (eid) WHERE n.concept = 'PROMO'")
def instantiate(s, d):
    p = tpch.pairs(s, d)
    return concepts.instantiate(p, tpch.nodes(s, d), p.where("concept = 'PROMO'")).select("cid", "eid", "words", "frequency")


@query("SELECT e.rid, e.weight FROM edges e WHERE sense = 'Result' AND hid IN (SELECT eid FROM pairs WHERE cid = sha1('PROMO')) AND tid IN (SELECT eid FROM pairs WHERE cid = sha1('LARGE'))")
def explain_concept_edge(s, d):
    name = lambda x: F.sha1(F.lit(x))
    return concepts.explain(tpch.edges(s, d), tpch.pairs(s, d), name("PROMO"), name("LARGE"), "Result").select("rid", "weight")


# ---- graphs, tables -----------------------------------------------------------------------------------


@query(", k AS (SELECT eid, pattern FROM nodes), x AS (SELECT sense, weight FROM edges WHERE hid = sha1('Brand#11') AND tid IN (SELECT eid FROM k WHERE pattern = (SELECT pattern FROM k WHERE eid = sha1('Brand#22'))) UNION ALL SELECT sense, weight FROM edges WHERE tid = sha1('Brand#22') AND hid IN (SELECT eid FROM k WHERE pattern = (SELECT pattern FROM k WHERE eid = sha1('Brand#11')))) SELECT sense, sum(weight) AS weight FROM x GROUP BY 1")
def loose_relation(s, d):
    nodes = tpch.nodes(s, d).withColumn("skeleton_words", F.lit("same"))
    name = lambda x: F.sha1(F.lit(x))
    return graph.loose_relation(tpch.edges(s, d), nodes, name("Brand#11"), name("Brand#22"))


@query("""WITH n AS (SELECT o_custkey AS eid, count(*)::DOUBLE AS frequency, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS s FROM orders GROUP BY 1), m AS (SELECT * FROM n WHERE eid % 2 = 0)
 SELECT n.eid, n.frequency + coalesce(m.frequency, 0) AS frequency, n.s || coalesce(',' || m.s, '') AS sources FROM n LEFT JOIN m USING (eid)""", False)
def merge_sources(s, d):
    n = load(s, d, "orders").groupBy(F.col("o_custkey").alias("eid")).agg(F.count("*").cast("double").alias("frequency"), F.array_sort(F.collect_list("o_orderkey")).alias("sources"))
    m = n.where("eid % 2 = 0")
    parts = lambda x: (x.select("eid", "frequency"), x.select("eid", "sources"))
    rows, sources = graph.merge_with_sources(parts(n), parts(m), key="eid", value="frequency")
    return rows.join(sources, "eid").select("eid", "frequency", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 3 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS crossing, round(sum(CASE WHEN o_orderkey % 3 > 0 THEN 1 ELSE 0 END) / count(*), 6)::DOUBLE AS share FROM orders", False)
def crossing_share(s, d):
    sources = load(s, d, "orders").select(F.lit(0).alias("head_sid"), (F.col("o_orderkey") % 3).alias("tail_sid"))
    return graph.crossing_share(sources).withColumn("share", F.round("share", 6))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey < 15 UNION ALL SELECT n_nationkey, lower(n_name) FROM nation WHERE n_nationkey >= 15", False)
def insert_rows(s, d):
    n = load(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    news = n.withColumn("name", F.lower("name"))
    return lookup.insert(n.where("k < 15"), news.union(news), "k")


@query("SELECT c_custkey, round(CASE WHEN s IS NULL THEN c_acctbal ELSE c_acctbal + s END, 2) AS added, round(coalesce(m, c_acctbal), 2) AS assigned FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS s, max(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey", False)
def update_operators(s, d):
    deltas = load(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("delta"))
    c = load(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("added"), F.col("c_acctbal").alias("assigned"))
    out = lookup.apply_updates(lookup.apply_updates(c, "c_custkey", deltas, "added", "+"), "c_custkey", deltas, "assigned", "=")
    return out.select("c_custkey", F.round("added", 2).alias("added"), F.round("assigned", 2).alias("assigned"))


@query("SELECT p_partkey, p_name, p_brand, p_size FROM part", False)
def codec_round_trip(s, d):
    part = load(s, d, "part").select("p_partkey", F.split("p_name", " ").alias("p_name"), "p_brand", "p_size")
    back = lookup.decode(lookup.encode(part, ["p_name"], ["p_partkey"]), ["p_name"], "p_brand string, p_size int")
    return back.select("p_partkey", F.array_join("p_name", " ").alias("p_name"), "p_brand", "p_size")


@query(", r AS (SELECT h.words AS head, t.words AS tail, weight FROM edges JOIN nodes h ON hid = h.eid JOIN nodes t ON tid = t.eid WHERE sense = 'Contrast') SELECT DISTINCT tail AS eid, head AS other FROM r WHERE tail IN ('Brand#11', 'Brand#12')")
def word_predecessors(s, d):
    _, e = graph.by_words(tpch.nodes(s, d), tpch.edges(s, d))
    wanted = s.createDataFrame([("Brand#11",), ("Brand#12",)], "eid string")
    return lookup.neighbours(e.withColumnsRenamed({"head": "hid", "tail": "tid"}), wanted, ["Contrast"], False)


@query("SELECT words, sum(frequency) AS frequency FROM nodes GROUP BY 1")
def word_frequencies(s, d):
    return graph.by_words(tpch.nodes(s, d), tpch.edges(s, d))[0]


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY sense ORDER BY md5(rid || '|0'), rid) AS r FROM edges WHERE weight >= 2) SELECT sense, rid FROM r WHERE r <= 5")
def checked_sample(s, d):
    return sampling.checked(tpch.edges(s, d), "sense", 5, F.col("weight") >= 2).select("sense", "rid")


# ---- entities -----------------------------------------------------------------------------------------


@query("SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'Sep|Sep.|Sept|Sept.' WHEN 1 THEN 'new york of the east|New York of the East' ELSE 'May|May.' END AS names FROM customer", False)
def mention_aliases(s, d):
    said = F.get(F.array(F.lit("september"), F.lit("new york of the east"), F.lit("May")), (F.col("c_custkey") % 3).cast("int"))
    rows = load(s, d, "customer").select(F.col("c_custkey").alias("k"), said.alias("m"))
    return rows.select("k", F.array_join(linking.aliases(F.col("m"), ["of", "the"]), "|").alias("names"))


@query("SELECT c_custkey AS doc, m AS mention, CASE WHEN m = 'Bo' THEN 'Bo' ELSE 'Ann' END AS person FROM customer, (VALUES ('Ann'), ('Ann Lee'), ('Lee'), ('Bo'), ('Lee Roy')) t(m)", False)
def same_persons(s, d):
    names = F.array(*[F.lit(x) for x in ("Ann", "Ann Lee", "Lee", "Bo", "Lee Roy", "Lee")])
    rows = load(s, d, "customer").select(F.col("c_custkey").alias("doc"), F.explode(names).alias("mention"), F.lit("PERSON").alias("ner"))
    return linking.same_persons(rows)


#: Names in texts: a word with a capital, and such a word with the one after it.
ONE, TWO = "[A-Z][a-z]+", "[A-Z][a-z]+ [a-z]+"


@query(f"""WITH one AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '{ONE}')) AS mention FROM documents),
 m AS (SELECT DISTINCT doc_id AS doc, unnest(list_concat(regexp_extract_all(text, '{TWO}'), regexp_extract_all(text, '{ONE}'))) AS mention FROM documents),
 dict AS (SELECT mention, entity, least(1.0, n / sum(n) OVER (PARTITION BY mention)) AS freq FROM (SELECT mention, source AS entity, count(*) AS n FROM one WHERE source IS NOT NULL GROUP BY ALL)),
 two AS (SELECT DISTINCT mention, string_split(mention, ' ')[1] AS a, string_split(mention, ' ')[2] AS b FROM m WHERE contains(mention, ' ')),
 red AS (SELECT DISTINCT a || ' ' || upper(b[1]) || b[2:] AS alias, 'page ' || b[1] AS entity FROM two WHERE length(mention) % 5 = 0),
 cand AS (SELECT mention, entity, freq FROM dict UNION ALL SELECT two.mention, red.entity, 1.0 FROM two JOIN red ON red.alias = a || ' ' || upper(b[1]) || b[2:]),
 likely AS (SELECT mention, entity FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY freq DESC, entity) AS r FROM cand) WHERE r = 1),
 typed AS (SELECT doc, m.mention, length(m.mention) % 3 <> 0 OR coalesce(entity = 'src1', false) AS p FROM m LEFT JOIN likely USING (mention)),
 grp AS (SELECT t.doc, t.mention, coalesce(f.mention, t.mention) AS person FROM typed t LEFT JOIN typed f ON f.doc = t.doc AND f.p AND f.mention = string_split(t.mention, ' ')[1] WHERE t.p),
 shared AS (SELECT doc, person, entity, list_reduce(list(freq ORDER BY mention), lambda x, y: (x + y) / 2) AS freq FROM grp JOIN cand USING (mention) GROUP BY ALL),
 every AS (SELECT doc, person AS k, true AS p, entity, freq FROM shared UNION ALL SELECT NULL, mention, false, entity, freq FROM cand),
 best AS (SELECT doc, k, p, CASE WHEN v <> 'src0' THEN v WHEN abs(f - 1) < 1e-4 THEN nxt END AS entity FROM (SELECT doc, k, p, arg_min(entity, (-freq, entity)) AS v, max(freq) AS f, min(CASE WHEN abs(freq - 1) < 1e-4 AND entity <> 'src0' THEN entity END) AS nxt FROM every GROUP BY ALL))
 SELECT t.doc, t.mention, b.entity FROM typed t LEFT JOIN grp g ON g.doc = t.doc AND g.mention = t.mention LEFT JOIN best b ON b.p = t.p AND b.k = CASE WHEN t.p THEN g.person ELSE t.mention END AND (NOT t.p OR b.doc = t.doc)""", False)
def entity_links(s, d):
    docs = load(s, d, "documents")
    names = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    mentions = docs.select(F.col("doc_id").alias("doc"), F.explode(F.concat(names(TWO), names(ONE))).alias("mention")).distinct()
    mentions = steps.kept(mentions.withColumn("ner", F.when(F.length("mention") % 3 != 0, "PERSON").otherwise("CITY")))  # the texts are searched once
    counts = docs.where("source IS NOT NULL").select(F.explode(names(ONE)).alias("mention"), F.col("source").alias("entity")).groupBy("mention", "entity").agg(F.count("*").alias("n"))
    w = F.split("mention", " ")
    redirects = mentions.where(F.contains("mention", F.lit(" ")) & (F.length("mention") % 5 == 0)).select(F.concat_ws(" ", w[0], F.initcap(w[1])).alias("mention"), F.concat(F.lit("page "), F.substring(w[1], 1, 1)).alias("entity")).distinct()
    one = lambda x: s.range(1).select(F.lit(x).alias("entity"))
    out = linking.link(mentions, linking.mention_dictionary(counts), redirects, one("src0"), one("src1"))
    return out.select("doc", "mention", "entity")


@query("SELECT c_custkey AS doc, 'Ann' AS person, 'e1' AS entity, 0.375::DOUBLE AS freq FROM customer UNION ALL SELECT c_custkey, 'Ann', 'e2', 1.0 FROM customer", False)
def shared_candidates(s, d):
    c = load(s, d, "customer").select(F.col("c_custkey").alias("doc"))
    explode = lambda df, rows, names: df.select("doc", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])).alias("x")).select("doc", "x.*")
    persons = explode(c, [("Ann", "Ann"), ("Ann Lee", "Ann"), ("Lee", "Ann")], ("mention", "person"))
    cands = explode(c, [("Ann", "e1", 1.0), ("Ann Lee", "e1", 0.0), ("Lee", "e1", 0.25), ("Lee", "e2", 1.0)], ("mention", "entity", "freq"))
    return linking.shared_candidates(cands, persons)


@query("SELECT sha1(sha1(c_name) || '$' || sha1(c_mktsegment)) AS rid, c_name || '$' || c_mktsegment AS triple, c_custkey FROM customer", False)
def triples(s, d):
    c = load(s, d, "customer")
    return c.select(rid(F.sha1("c_name"), F.sha1("c_mktsegment")).alias("rid"), F.concat_ws("$", "c_name", "c_mktsegment").alias("triple"), "c_custkey")


# ---- persons, directions, places ----------------------------------------------------------------------

#: Head and tail; with persons and groups named; with the persons of an edge between persons named.
PERSONS = (
    ("i see he", "you thank my friend and we", "PersonX see PersonZ", "PersonY thank PersonX friend and PeopleX", "PersonX see PersonZ", "PersonY thank my friend and we"),
    ("it make she cry", "they tell she and we", "it make PersonX cry", "PeopleX tell PersonX and PeopleY", "it make she cry", "they tell she and we"),
    ("he call he", "it ring and you hear i", "PersonX call PersonX", "it ring and PersonY hear PersonZ", "PersonX call PersonX", "it ring and PersonY hear PersonZ"),
    ("you he i she guy man", "guy go", "PersonX PersonZ PersonA PersonB PersonY man", "PersonY go", "PersonX PersonZ i she PersonY man", "PersonY go"),
    ("rain fall", "road be wet", "rain fall", "road be wet", "rain fall", "road be wet"),
)


def _person_pairs(s, d):
    one = F.get(F.array(*[F.struct(F.split(F.lit(x[0]), " ").alias("head"), F.split(F.lit(x[1]), " ").alias("tail")) for x in PERSONS]), (F.col("c_custkey") % len(PERSONS)).cast("int"))
    return load(s, d, "customer").select(F.col("c_custkey").alias("k"), one.alias("x")).select("k", "x.*")


def _person_sql(head: int, tail: int) -> str:
    rows = ", ".join(f"({i}, '{x[head]}', '{x[tail]}')" for i, x in enumerate(PERSONS))
    return f"SELECT c_custkey AS k, h AS head, t AS tail FROM customer JOIN (VALUES {rows}) v(i, h, t) ON c_custkey % {len(PERSONS)} = i"


def _said(df, named):
    return df.withColumn("p", named(F.col("head"), F.col("tail"))).select("k", F.array_join("p.head", " ").alias("head"), F.array_join("p.tail", " ").alias("tail"))


@query(_person_sql(2, 3), False)
def person_names(s, d):
    return _said(_person_pairs(s, d), post.name_persons)


@query(_person_sql(4, 5), False)
def subject_names(s, d):
    return _said(_person_pairs(s, d), post.name_subjects)


@query(f"""WITH own AS ({_person_sql(0, 1)}), named AS ({_person_sql(2, 3)}), freq AS (SELECT w, count(*)::DOUBLE AS f FROM (SELECT head AS w FROM own UNION ALL SELECT tail FROM own) GROUP BY 1),
 ends AS (SELECT o.head AS w, n.head AS words FROM own o JOIN named n USING (k) UNION ALL SELECT o.tail, n.tail FROM own o JOIN named n USING (k)),
 twins AS (SELECT w, words FROM ends UNION ALL SELECT w, replace(replace(replace(words, 'PersonX', '?'), 'PersonY', 'PersonX'), '?', 'PersonY') FROM ends) SELECT words, sum(f) AS frequency FROM twins JOIN freq USING (w) GROUP BY 1""", False)
def person_nodes(s, d):
    e = _person_pairs(s, d)
    nodes = e.select(F.explode(F.array("head", "tail")).alias("words")).groupBy("words").agg(F.count("*").cast("double").alias("frequency"))
    return post.regraph_nodes(e, nodes)


@query(""", c AS (SELECT hid AS eid, tid AS other, sense, weight FROM edges WHERE sense IN ('Succession', 'Condition', 'Reason', 'Synchronous', 'Conjunction')
 UNION ALL SELECT tid, hid, sense, weight FROM edges WHERE sense IN ('Precedence', 'Result', 'Synchronous', 'Conjunction')) SELECT eid, sense, count(*) AS n, sum(weight) AS weight FROM c GROUP BY ALL""")
def causes(s, d):
    return post.by_direction(tpch.edges(s, d), "cause").groupBy("eid", "sense").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query(", c AS (SELECT hid AS eid, sense FROM edges WHERE sense IN ('Reason', 'Result') UNION ALL SELECT tid, sense FROM edges WHERE sense IN ('Reason', 'Result')) SELECT eid, sense, count(*) AS n FROM c GROUP BY ALL")
def stative_neighbours(s, d):
    return post.by_direction(tpch.edges(s, d), "stative").groupBy("eid", "sense").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 1", False)
def usable_texts(s, d):
    texts = ("{Someone_A}_[subject] {buys||sells}_[verb] {Something_A}_[object]", "{Someone_A}_[subject] {sees}_[verb] {Someone_E}_[object]", "{Someone_E}_[subject] {Someone_B}_[subject] {rest}_[verb]")
    one = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("c_custkey") % 3).cast("int"))
    return load(s, d, "customer").where(post.usable(one)).select("c_custkey")


_NEAR = "last_value(CASE WHEN t <> 'NO' THEN {c} END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY s, i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"


@query(f"""WITH r AS (SELECT l_suppkey AS doc, l_orderkey AS s, l_linenumber AS i, min(l_returnflag || l_linestatus) AS t FROM lineitem GROUP BY 1, 2, 3)
 SELECT doc, s AS sent_idx, i AS tok_idx, coalesce({_NEAR.format(c="s")}, -1) AS near_sent, coalesce({_NEAR.format(c="i")}, -1) AS near_tok, {_NEAR.format(c="t")} AS near FROM r""", False)
def previous_token(s, d):
    place = [F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("sent_idx"), F.col("l_linenumber").alias("tok_idx")]
    rows = load(s, d, "lineitem").groupBy(*place).agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("token"))
    return lookup.near_tokens(rows, ["NO"]).select("doc", "sent_idx", "tok_idx", "near_sent", "near_tok", "near")


@query(", n AS (SELECT * FROM nodes WHERE frequency >= 2.0) SELECT rid, sense, weight FROM edges JOIN tot USING (rid, hid, tid) WHERE total >= 1.0001 AND hid IN (SELECT eid FROM n) AND tid IN (SELECT eid FROM n)")
def merged_core(s, d):
    return graph.core_edges(tpch.edges(s, d), graph.core_nodes(tpch.nodes(s, d), 2.0), 1.0001).select("rid", "sense", "weight")


_CONCEPT_EDGES = ", ce AS (SELECT sha1(h.cid || '$' || t.cid) AS rid, h.cid AS hid, t.cid AS tid, sense, sum(weight * h.score * t.score) AS weight FROM edges e JOIN pairs h ON e.hid = h.eid JOIN pairs t ON e.tid = t.eid WHERE h.cid <> t.cid GROUP BY ALL), first AS (SELECT min(cid) AS c FROM pairs)"


@query(_CONCEPT_EDGES + " SELECT rid, tid, round(sum(weight), 4) AS total FROM ce WHERE hid = (SELECT c FROM first) AND tid IN (SELECT cid FROM pairs) GROUP BY ALL")
def concept_successors(s, d):
    pairs = tpch.pairs(s, d)
    nodes = pairs.select(F.col("cid").alias("eid")).distinct()
    own = pairs.agg(F.min("cid").alias("hid"))  # one row
    edges = concepts.concept_edges(tpch.edges(s, d), pairs).join(F.broadcast(own), "hid", "left_semi")
    return lookup.successors(nodes, edges).select("rid", "tid", F.round("total", 4).alias("total"))


@query(_CONCEPT_EDGES + " SELECT concept, sense, round(sum(weight), 4) AS weight FROM ce JOIN (SELECT DISTINCT cid, concept FROM pairs) ON tid = cid WHERE hid = (SELECT c FROM first) AND concept LIKE 'PROMO%' GROUP BY ALL")
def concept_relations(s, d):
    pairs = tpch.pairs(s, d)
    wanted = pairs.select("cid", "concept").distinct().where(F.startswith("concept", F.lit("PROMO")))
    own = pairs.agg(F.min("cid").alias("hid"))
    edges = concepts.concept_edges(tpch.edges(s, d), pairs).join(F.broadcast(own), "hid", "left_semi")
    return lookup.exact(edges, wanted, {"tid": "cid"}).groupBy("concept", "sense").agg(F.round(F.sum("weight"), 4).alias("weight"))


# ---- persons by parse -----------------------------------------------------------------------------------


def _in(word: str, words) -> str:
    return f"{word} IN ({', '.join(repr(w) for w in words)})"


def _like(a: str, b: str) -> str:
    """Whether two words are one person's."""
    return f"({a} = {b} OR {' OR '.join(f'({_in(a, ws)} AND {_in(b, ws)})' for ws in persons.SAME)})"


def _label(k: str, word: str) -> str:
    return f"CASE WHEN {_in(word, persons.POSSESSIVE)} THEN '[P{k}''s]' ELSE '[P{k}]' END"


#: First and second three words of texts as subject, verb and object; words of even length are persons' names.
_TRIPLES = f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents),
 n AS (SELECT doc_id, 0 AS half, w[1] AS a, w[2] AS b, w[3] AS c FROM w WHERE len(w) >= 6 UNION ALL SELECT doc_id, 1, w[4], w[5], w[6] FROM w WHERE len(w) >= 6),
 p AS (SELECT *, length(a) % 2 = 0 OR {_in("a", (*persons.INDEFINITE, *persons.SUBJECTS))} AS pa, length(c) % 2 = 0 OR {_in("c", persons.INDEFINITE)} AS pc FROM n),
 q AS (SELECT *, CASE WHEN pa THEN {_label("0", "a")} ELSE a END || ' ' || b || ' ' || CASE WHEN pc AND pa AND NOT {_like("a", "c")} THEN {_label("1", "c")} WHEN pc THEN {_label("0", "c")} ELSE c END AS name FROM p)"""


def _named_graph(s, d):
    words = load(s, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("w")).where(F.size("w") >= 6)
    name = lambda k: F.sha1(F.array_join(F.slice("w", k, 3), " "))
    own = words.select(F.explode(F.array(F.slice("w", 1, 3), F.slice("w", 4, 3))).alias("words")).groupBy("words").agg(F.count("*").cast("double").alias("frequency"))
    deps = F.array(*[F.struct(F.lit(1).alias("gov"), F.lit(x).alias("dep"), F.lit(t).alias("dpt")) for x, t in (("nsubj", 0), ("dobj", 2))]).cast(DEPENDENCIES)
    types = F.transform("words", lambda w: F.when(F.length(w) % 2 == 0, "PERSON").otherwise("O"))
    nodes = own.select(F.sha1(F.array_join("words", " ")).alias("eid"), "frequency", "words", F.split(F.lit("NN VB NN"), " ").alias("pos_tags"), types.alias("ners"), F.array().cast(extract.MENTIONS).alias("mentions"), deps.alias("skeleton_dependencies"), deps.alias("dependencies"))
    edges = words.groupBy(name(1).alias("hid"), name(4).alias("tid")).agg(F.count("*").cast("double").alias("weight")).withColumn("sense", F.lit("Result"))
    return persons.regraph(nodes, edges)


@query(_TRIPLES + " SELECT name, count(*)::DOUBLE AS frequency, count(DISTINCT a || ' ' || b || ' ' || c) AS forms FROM q GROUP BY 1", False)
def parsed_person_nodes(s, d):
    return _named_graph(s, d)[0]


@query(_TRIPLES + " SELECT h.name AS head, t.name AS tail, 'Result' AS sense, count(*)::DOUBLE AS weight FROM q h JOIN q t ON h.doc_id = t.doc_id AND h.half = 0 AND t.half = 1 GROUP BY ALL", False)
def parsed_person_edges(s, d):
    return _named_graph(s, d)[1]


_AGREE = ", ".join(f"CASE WHEN h.p{x} AND t.p{y} AND {_like('h.' + x, 't.' + y)} THEN 'H_P' || {'0' if x == 'a' else 'h.no'} || '=T_P' || {'0' if y == 'a' else 't.no'} END" for x in "ac" for y in "ac")


@query(_TRIPLES + f""", r AS (SELECT *, CASE WHEN pa AND NOT {_like("a", "c")} THEN 1 ELSE 0 END AS no FROM q)
 SELECT DISTINCT head, tail, pair FROM (SELECT h.name AS head, t.name AS tail, unnest([{_AGREE}]) AS pair FROM r h JOIN r t ON h.doc_id = t.doc_id AND h.half = 0 AND t.half = 1) WHERE pair IS NOT NULL""", False)
def person_alignments(s, d):
    pairs = _named_graph(s, d)[2]
    return pairs.select("head", "tail", F.explode("same").alias("x")).select("head", "tail", F.concat_ws("=", "x.a", "x.b").alias("pair")).distinct()


# ---- discourse parsing --------------------------------------------------------------------------------

#: A document of three sentences about a name (``*``): tokens, lemmas, tags, edges, parse.
TALK = (
    ("* stay because it rain .", "* stay because it rain .", "NN VBP IN PRP VBP .", [(1, "nsubj", 0), (1, "advcl", 4), (4, "mark", 2), (4, "nsubj", 3)], "(ROOT (S (NP (NN *)) (VP (VBP stay) (SBAR (IN because) (S (NP (PRP it)) (VP (VBP rain))))) (. .)))"),
    ("* sleep .", "* sleep .", "NN VBP .", [(1, "nsubj", 0)], "(ROOT (S (NP (NN *)) (VP (VBP sleep)) (. .)))"),
    ("so * dream so much .", "so * dream so much .", "RB NN VBP RB RB .", [(2, "nsubj", 1), (2, "advmod", 4)], "(ROOT (S (RB so) (NP (NN *)) (VP (VBP dream) (ADVP (RB so) (RB much))) (. .)))"),
)
TALK_TABLE = {"Reason": ("because",), "Result": ("so",)}


def _talk(rows, name):
    """The three sentences of each row of ``(doc, <name>)``."""
    all_ = F.array(*[F.struct(F.lit(k).alias("sent_idx"), *[c.alias(n) for n, c in _sentence(t, name).items()]) for k, t in enumerate(TALK, 1)])
    parse = F.replace(F.col("x.parse"), F.lit("*"), name)
    out = rows.withColumn("x", F.explode(all_)).select("doc", "x.*", parse.alias("named")).withColumn("parse", F.col("named")).drop("named")
    return out.withColumn("sid", F.concat_ws("|", "doc", "sent_idx"))


def _trained(s):
    """Models that are trained on a few named documents."""
    own = _talk(s.createDataFrame([(f"d{i}", n) for i, n in enumerate(("ann", "bo", "cy"))], "doc string, n string"), F.col("n"))
    gold = [x for i in range(3) for x in ((f"d{i}|1", [2], f"d{i}|1", [0, 1], [3, 4], "Reason"), (f"d{i}|3", [0], f"d{i}|2", [0, 1], [1, 2, 3, 4], "Result"))]
    known = s.createDataFrame(gold, "sid string, indices array<int>, arg1_sid string, arg1 array<int>, arg2 array<int>, sense string")
    return discourse.fit(discourse.examples(own, known, TALK_TABLE))


def _parts(s, d):
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    return _talk(extract.dealt(load(s, d, "part").select(F.col("p_partkey").cast("string").alias("doc"), brand.alias("n")), "doc"), F.col("n"))


@query("""SELECT p_partkey::VARCHAR AS doc, v.* FROM part, (VALUES (1, 'because', '2', 1, '0,1', '3,4', 'Reason'), (3, 'so', '0', 2, '0,1', '1,2,3,4', 'Result')) v(sent_idx, connective, indices, arg1_idx, arg1, arg2, sense)""", False)
def discourse_connectives(s, d):
    found = discourse.parse(_parts(s, d), _trained(s), table=TALK_TABLE)
    said = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",").alias(c)
    return found.select("doc", "sent_idx", "connective", said("indices"), "arg1_idx", said("arg1"), said("arg2"), "sense")


_BRAND = "lower(replace(p_brand, '#', ''))"
_HALF = {
    w.split()[1]: _eid(w, t, e).replace("lower(p_brand)", _BRAND)
    for w, t, e in (("* stay", "NN VBP", [(1, "nsubj", 0)]), ("it rain", "PRP VBP", [(1, "nsubj", 0)]), ("* sleep", "NN VBP", [(1, "nsubj", 0)]), ("* dream much", "NN VBP RB", [(1, "nsubj", 0), (1, "advmod", 2)]))
}


@query(f"""SELECT hid, tid, sense, sum(w) AS weight FROM (SELECT {_HALF["stay"]} AS hid, {_HALF["rain"]} AS tid, 'Reason' AS sense, 1.0::DOUBLE AS w FROM part UNION ALL SELECT {_HALF["stay"]}, {_HALF["rain"]}, 'Co_Occurrence', 1.0 FROM part
 UNION ALL SELECT {_HALF["sleep"]}, {_HALF["dream"]}, 'Result', 1.0 FROM part) GROUP BY ALL""", False)
def discourse_relations(s, d):
    from evkg.plans import facade

    sents = _parts(s, d)
    out = facade.relations_of(sents, extract.extract(sents, clause_split=True), TALK_TABLE, _trained(s))
    return out.groupBy("hid", "tid", "sense").agg(F.sum("weight").alias("weight"))
