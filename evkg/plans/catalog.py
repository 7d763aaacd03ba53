"""Queries over the test tables, one for each operator, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evkg.functions import text
from evkg.functions.ids import rid
from evkg.operators import concepts, graph, linking, lookup, post, relations, sampling, stats
from evkg.plans import tpch
from evkg.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from evkg.plans.tpch import load
from evkg.schema import PRONOUNS, SENSES


def r6(c):
    return F.round(c, 6)


#: The brand whose neighbourhood is asked for.
BRAND = "Brand#11"

# ---- scans, lookups, updates ---------------------------------------------------------------------


@query("SELECT eid, words, frequency, pattern FROM nodes")
def node_merge(s, d):
    return tpch.nodes(s, d)


@query("SELECT rid, hid, tid, sense, weight FROM edges")
def edge_merge(s, d):
    return tpch.edges(s, d)


@query(f"SELECT t.rid, n.eid, n.words, n.frequency, t.total FROM tot t JOIN nodes n ON t.tid = n.eid WHERE t.hid = sha1('{BRAND}')")
def related_nodes(s, d):
    return lookup.related(tpch.nodes(s, d), tpch.edges(s, d), F.sha1(F.lit(BRAND))).select("rid", "eid", "words", "frequency", "total")


@query(", ids(ord, key) AS (VALUES (0, 'Brand#11'), (1, 'none'), (2, 'Brand#23'), (3, 'Brand#11')) SELECT ord, sha1(key) AS eid, words, frequency FROM ids LEFT JOIN nodes ON eid = sha1(key)")
def multi_get_nodes(s, d):
    ids = s.createDataFrame([(0, "Brand#11"), (1, "none"), (2, "Brand#23"), (3, "Brand#11")], "ord int, key string").select("ord", F.sha1("key").alias("eid"))
    return lookup.multi_get(tpch.nodes(s, d), ids, "eid").select("ord", "eid", "words", "frequency")


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand = 'Brand#11' AND p_size = 1 ORDER BY p_partkey LIMIT 20", False)
def keys_equal(s, d):
    return lookup.by_keys(load(s, d, "part"), {"p_brand": "Brand#11", "p_size": 1, "unknown": 1}, ["p_partkey"], False, 20).select("p_partkey", "p_brand", "p_size")


@query("SELECT p_partkey FROM part WHERE false", False)
def keys_empty(s, d):
    return lookup.by_keys(load(s, d, "part"), {"unknown": 1}).select("p_partkey")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 25", False)
def ordered_top(s, d):
    return lookup.ranked(load(s, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], True, 25)


@query("SELECT t.rid, t.hid, t.tid, t.total FROM tot t WHERE t.hid = sha1('Brand#11') AND t.tid IN (sha1('Brand#12'), sha1('Brand#13'))")
def exact_relations(s, d):
    wanted = s.createDataFrame([("Brand#11", "Brand#12"), ("Brand#11", "Brand#13"), ("none", "Brand#13")], "h string, t string").select(rid(F.sha1("h"), F.sha1("t")).alias("rid"))
    return lookup.totals(tpch.edges(s, d)).join(F.broadcast(wanted), "rid", "left_semi")


@query("SELECT eid, words, frequency + coalesce((SELECT count(*) * 2.0 FROM supplier WHERE words = 'Brand#' || (1 + s_nationkey // 5) || (1 + s_nationkey % 5)), 0) AS frequency FROM nodes")
def upsert_nodes(s, d):
    sup = load(s, d, "supplier").select(F.concat(F.lit("Brand#"), 1 + F.floor(F.col("s_nationkey") / 5), 1 + F.col("s_nationkey") % 5).alias("words"))
    base = tpch.nodes(s, d).select("eid", "words", "frequency")
    news = sup.select(F.sha1("words").alias("eid"), "words", F.lit(2.0).alias("frequency")).join(base.select("eid"), "eid", "left_semi")
    return lookup.upsert(base, news, ["eid", "words"], ["frequency"])


@query("SELECT c_custkey, round(c_acctbal - coalesce((SELECT sum(o_totalprice) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'), 0), 2) AS c_acctbal FROM customer", False)
def bulk_update(s, d):
    deltas = load(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("delta"))
    out = lookup.apply_updates(load(s, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", deltas, "c_acctbal", "-")
    return out.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), ' ') AS context FROM events", False)
def context_frame(s, d):
    sents = load(s, d, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("sent_idx"), F.col("event_type").alias("text"))
    return lookup.context(sents, 2).select(F.col("sent_idx").alias("event_id"), F.array_join("context", " ").alias("context"))


# ---- filters ----------------------------------------------------------------------------------


@query("SELECT eid, frequency FROM nodes WHERE frequency >= (SELECT avg(frequency) FROM nodes)")
def core_nodes(s, d):
    return graph.above_mean(tpch.nodes(s, d)).select("eid", "frequency")


@query(", keep AS (SELECT eid FROM nodes WHERE frequency >= (SELECT avg(frequency) FROM nodes)) SELECT e.rid, e.sense, e.weight FROM edges e JOIN tot USING (rid) WHERE total >= 3 AND e.hid IN (SELECT eid FROM keep) AND e.tid IN (SELECT eid FROM keep)")
def core_edges(s, d):
    return graph.core_edges(tpch.edges(s, d), graph.above_mean(tpch.nodes(s, d)), 3).select("rid", "sense", "weight")


@query(", th(threshold) AS (SELECT unnest([50.0, 30.0, 20.0, 10.0, 5.0, 3.0])::DOUBLE) SELECT threshold, (SELECT count(*) FROM nodes WHERE frequency >= threshold) AS n_nodes, (SELECT count(*) FROM tot JOIN nodes h ON hid = h.eid JOIN nodes t ON tid = t.eid WHERE least(h.frequency, t.frequency) >= threshold) AS n_edges FROM th")
def threshold_sweep(s, d):
    return graph.sweep(tpch.nodes(s, d), tpch.edges(s, d), [50, 30, 20, 10, 5, 3])


@query("SELECT DISTINCT hid AS eid, tid AS other FROM edges WHERE sense IN ('Reason', 'Result') AND hid IN (sha1('Brand#11'), sha1('Brand#22'))")
def neighbours_by_sense(s, d):
    ids = s.createDataFrame([("Brand#11",), ("Brand#22",)], "w string").select(F.sha1("w").alias("eid"))
    return lookup.neighbours(tpch.edges(s, d), ids, ["Reason", "Result"])


@query("SELECT DISTINCT tid AS eid, hid AS other FROM edges WHERE sense = 'Contrast' AND tid = sha1('Brand#23')")
def predecessors(s, d):
    ids = s.createDataFrame([("Brand#23",)], "w string").select(F.sha1("w").alias("eid"))
    return lookup.neighbours(tpch.edges(s, d), ids, ["Contrast"], False)


@query("SELECT c_custkey AS eid FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)", False)
def singleton_nodes(s, d):
    nodes = load(s, d, "customer").select(F.col("c_custkey").alias("eid"))
    edges = load(s, d, "orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("hid"), F.col("o_custkey").alias("tid"))
    return graph.singletons(nodes, edges)


@query(", p AS (SELECT DISTINCT hid, tid FROM edges), deg AS (SELECT eid, (SELECT count(*) FROM p WHERE hid = eid) AS outs, (SELECT count(*) FROM p WHERE tid = eid) AS ins FROM nodes) SELECT eid, outs, ins FROM deg WHERE outs > 5 AND outs < 1000 AND ins > 5 AND ins < 1000")
def degree_filter(s, d):
    return graph.degree_filter(tpch.nodes(s, d), tpch.edges(s, d)).select("eid", F.col("outs").cast("long").alias("outs"), F.col("ins").cast("long").alias("ins"))


@query("SELECT c_custkey AS eid, count(*) AS degree FROM (SELECT DISTINCT o_custkey AS c_custkey, o_orderpriority AS x FROM orders) GROUP BY 1 ORDER BY degree DESC, sha1(c_custkey::VARCHAR) LIMIT 15", False)
def top_degree(s, d):
    e = load(s, d, "orders").select(F.sha1(F.col("o_custkey").cast("string")).alias("hid"), F.concat(F.lit("p"), "o_orderpriority").alias("tid"), "o_custkey")
    top = graph.top_degree(e, 15 + 5, e.select(F.col("tid").alias("eid")).distinct()).orderBy(F.col("degree").desc(), "eid").limit(15)
    return top.join(e.select(F.col("hid").alias("eid"), "o_custkey").distinct(), "eid").select(F.col("o_custkey").alias("eid"), F.col("degree").cast("long").alias("degree"))


@query(r"SELECT page_id, regexp_matches(url, 'https?://|www\.') AS is_url, regexp_matches(url, '[0-9]') AS digit FROM pages", False)
def url_digit_flags(s, d):
    return load(s, d, "pages").select("page_id", text.has_url(F.col("url")).alias("is_url"), text.has_digit(F.col("url")).alias("digit"))


# ---- joins ------------------------------------------------------------------------------------


@query("SELECT hid, tid, count(*) AS n FROM raw GROUP BY ALL")
def cooccurrence(s, d):
    return tpch.raw_edges(s, d).groupBy("hid", "tid").agg(F.count("*").alias("n"))


@query(", nxt AS (SELECT o_orderkey AS sent, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders), one AS (SELECT sent, min(eid) AS eid FROM occ GROUP BY sent HAVING count(*) = 1) SELECT h.eid AS hid, t.eid AS tid, count(*) AS weight FROM nxt JOIN one h ON nxt.sent = h.sent JOIN one t ON nxt.next = t.sent GROUP BY ALL")
def adjacent_sentences(s, d):
    pairs = graph.adjacent(tpch.sentences(s, d), ["o_orderdate", "sent"])
    out = graph.adjacent_edges(tpch.occurrences(s, d), pairs)
    return out.groupBy("hid", "tid").agg(F.count("*").alias("weight"))


@query("""SELECT user_id AS doc, event_id // 100 AS sent_idx, event_id % 100 AS tok_idx, coalesce(x // 100, -1) AS near_sent, coalesce(x % 100, -1) AS near_tok, near
 FROM (SELECT *, last_value(CASE WHEN event_type <> 'click' THEN event_id END IGNORE NULLS) OVER w AS x, last_value(CASE WHEN event_type <> 'click' THEN event_type END IGNORE NULLS) OVER w AS near
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))""", False)
def event_sequence(s, d):
    e = load(s, d, "events").select(F.col("user_id").alias("doc"), F.floor(F.col("event_id") / 100).alias("sent_idx"), (F.col("event_id") % 100).alias("tok_idx"), F.col("event_type").alias("token"))
    return lookup.near_tokens(e, ["click"]).drop("token").withColumn("near_sent", F.col("near_sent").cast("long")).withColumn("near_tok", F.col("near_tok").cast("long"))


@query("SELECT n.cid, count(DISTINCT n.eid) AS n FROM pairs n JOIN nodes USING (eid) GROUP BY 1")
def instances_of_concept(s, d):
    return concepts.instances(tpch.pairs(s, d), tpch.nodes(s, d))


@query("SELECT e.sense, sum(e.weight) AS weight, count(*) AS n FROM edges e WHERE e.hid IN (SELECT eid FROM nodes WHERE words < 'Brand#3') AND e.tid IN (SELECT eid FROM nodes WHERE words >= 'Brand#3') GROUP BY 1")
def category_pairs(s, d):
    n = tpch.nodes(s, d)
    return graph.relate(tpch.edges(s, d), n.where("words < 'Brand#3'").select("eid"), n.where("words >= 'Brand#3'").select("eid"))


@query("SELECT o_orderkey AS rid, 'c' || o_custkey AS head_sid, 'n' || (o_custkey % 25) AS tail_sid, c_name AS head_text, n_name AS tail_text FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = o_custkey % 25 WHERE o_totalprice > 300000", False)
def provenance_join(s, d):
    c, n = load(s, d, "customer"), load(s, d, "nation")
    sents = c.select(F.concat(F.lit("c"), "c_custkey").alias("sid"), F.col("c_name").alias("text")).union(n.select(F.concat(F.lit("n"), "n_nationkey"), "n_name"))
    sources = load(s, d, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("rid"), F.concat(F.lit("c"), "o_custkey").alias("head_sid"), F.concat(F.lit("n"), F.col("o_custkey") % 25).alias("tail_sid"))
    return graph.with_texts(sources, sents)


@query("""WITH k AS (SELECT p_name, list_distinct(string_split(p_name, ' ')) AS w FROM (SELECT DISTINCT p_name FROM part)),
 i AS (SELECT p_name, unnest(w) AS t, len(w) AS n FROM k)
 SELECT a.p_name AS key, count(*) AS n FROM (SELECT x.p_name, y.p_name AS other FROM i x JOIN i y ON x.t = y.t GROUP BY x.p_name, y.p_name, x.n HAVING count(*) = x.n) a GROUP BY 1""", False)
def token_containment(s, d):
    k = load(s, d, "part").select(F.col("p_name").alias("key"), F.split("p_name", " ").alias("tokens")).distinct()
    return linking.contained(k, k.withColumnRenamed("key", "post")).groupBy("key").agg(F.count("*").alias("n"))


# ---- aggregates -------------------------------------------------------------------------------


@query("SELECT pattern, sum(frequency) AS frequency, count(*) AS n FROM nodes GROUP BY 1")
def pattern_stats(s, d):
    return stats.per_pattern(tpch.nodes(s, d))


@query(", o AS (SELECT flag AS dataset, pattern, eid, sum(frequency) AS f FROM occ GROUP BY ALL) SELECT CASE WHEN grouping(dataset) = 1 THEN 'overall' ELSE dataset END AS dataset, pattern, sum(f) AS frequency, count(DISTINCT eid) AS n FROM o GROUP BY GROUPING SETS ((dataset, pattern), (pattern))")
def dataset_stats(s, d):
    return stats.per_dataset(tpch.occurrences(s, d).withColumnRenamed("flag", "dataset"))


_ORDER = "CASE sense " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(SENSES)) + " END"


@query(f", m AS (SELECT sense, count(*) AS n_major FROM (SELECT rid, sense, row_number() OVER (PARTITION BY rid ORDER BY sense = 'Co_Occurrence', weight DESC, {_ORDER}) AS r FROM edges) WHERE r = 1 GROUP BY 1) SELECT e.sense, sum(weight) AS weight, count(DISTINCT rid) AS n, coalesce(any_value(n_major), 0) AS n_major FROM edges e LEFT JOIN m USING (sense) GROUP BY 1")
def sense_stats(s, d):
    return stats.per_sense(tpch.edges(s, d))


@query("SELECT rid, " + ", ".join(f"coalesce(sum(weight) FILTER (sense = '{x}'), 0) AS {x}" for x in SENSES) + " FROM edges GROUP BY rid")
def wide_relations(s, d):
    return graph.to_wide(tpch.edges(s, d)).drop("hid", "tid")


@query("SELECT rid, hid, tid, sense, weight FROM edges")
def wide_long_round_trip(s, d):
    return graph.to_long(graph.to_wide(tpch.edges(s, d)))


@query("SELECT hid, sense, tid, count(*) AS n FROM (SELECT *, unnest(range(CAST(weight AS BIGINT))) FROM edges) GROUP BY ALL")
def relation_triplets(s, d):
    return graph.to_triplets(tpch.edges(s, d)).groupBy("hid", "sense", "tid").agg(F.count("*").alias("n"))


@query(r"SELECT lang, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(lower(text), '\p{L}+'))) AS BIGINT) AS n_tokens FROM documents GROUP BY 1", False)
def token_stats(s, d):
    return stats.sizes(load(s, d, "documents"), text.tokens(F.col("text")))


@query(r"WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents), t AS (SELECT word, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, word LIMIT 100) SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS id FROM t", False)
def vocabulary(s, d):
    w = load(s, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("word"))
    return stats.vocabulary(w, 100).withColumn("id", F.col("id").cast("long"))


@query("SELECT eid, sum(f) AS frequency FROM (SELECT eid, frequency AS f FROM nodes UNION ALL SELECT eid, frequency * 2 FROM nodes WHERE words > 'Brand#2') GROUP BY 1")
def merge_graphs(s, d):
    n = tpch.nodes(s, d).select("eid", "words", "frequency")
    other = n.where("words > 'Brand#2'").withColumn("frequency", F.col("frequency") * 2)
    return graph.merge_graphs(n, other, keys=["eid"], value="frequency")


@query(""", t AS (SELECT h.words AS head, sense, t.words AS tail FROM edges JOIN nodes h ON hid = h.eid JOIN nodes t ON tid = t.eid),
 x AS (SELECT 'event' AS kind, head AS value FROM t UNION ALL SELECT 'event', tail FROM t UNION ALL SELECT 'relation', sense FROM t UNION ALL SELECT 'triple', head || '$' || sense || '$' || tail FROM t)
 SELECT kind, value, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS r FROM (SELECT kind, value, count(*) AS n FROM x GROUP BY ALL)) WHERE r <= 10""")
def triple_counters(s, d):
    n = tpch.nodes(s, d).select("eid", "words")
    rows = tpch.edges(s, d).join(n.toDF("hid", "head"), "hid").join(n.toDF("tid", "tail"), "tid")
    return stats.counters(rows, 10)


@query(""", w AS (SELECT cid, sum(score * frequency) AS weight FROM pairs JOIN nodes USING (eid) GROUP BY 1), ce AS (SELECT DISTINCT h.cid AS hid, t.cid AS tid FROM edges e JOIN pairs h ON e.hid = h.eid JOIN pairs t ON e.tid = t.eid WHERE h.cid <> t.cid),
 th(threshold) AS (SELECT unnest([1.0, 100.0, 200.0, 400.0])::DOUBLE) SELECT threshold, (SELECT count(*) FROM w WHERE weight >= threshold) AS n_nodes, (SELECT count(*) FROM ce JOIN w h ON ce.hid = h.cid JOIN w t ON ce.tid = t.cid WHERE least(h.weight, t.weight) >= threshold) AS n_edges FROM th""")
def concept_sweep(s, d):
    pairs = tpch.pairs(s, d)
    return concepts.sweep(concepts.concept_weights(pairs, tpch.nodes(s, d)), concepts.concept_edges(tpch.edges(s, d), pairs), [1, 100, 200, 400])


@query("SELECT h.words AS head, t.words AS tail, sense, sum(weight) AS weight FROM edges JOIN nodes h ON hid = h.eid JOIN nodes t ON tid = t.eid GROUP BY ALL")
def merged_words(s, d):
    return graph.by_words(tpch.nodes(s, d), tpch.edges(s, d))[1]


@query("SELECT l_returnflag, l_linenumber AS common FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_linenumber) AS r FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE r = 1", False)
def mode_with_ties(s, d):
    return stats.commonest(load(s, d, "lineitem"), "l_returnflag", "l_linenumber")



@query("SELECT l_orderkey % 7 AS k, count(DISTINCT l_partkey) AS parts, round(100.0 * sum(CASE WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN 1 ELSE 0 END) / count(*), 6) AS share FROM lineitem GROUP BY 1", False)
def conditional_shares(s, d):
    early = F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")
    return stats.shares(load(s, d, "lineitem"), F.col("l_orderkey") % 7, "l_partkey", early).withColumn("share", r6(F.col("share")))



# ---- order, top-k, sets -------------------------------------------------------------------------


@query("""WITH n AS (SELECT p_partkey AS eid, list_distinct(string_split(p_name, ' ')) AS w, p_retailprice AS frequency, p_brand, p_type FROM part),
 f AS (SELECT *, CASE WHEN p_brand = 'Brand#11' AND p_type = 'none' THEN 0 WHEN p_brand = 'Brand#11' THEN 1 ELSE 2 END AS grain FROM n WHERE p_brand = 'Brand#11' OR p_type = 'STANDARD'),
 s AS (SELECT eid, frequency, len(list_intersect(w, ['small', 'red'])) / (len(w) + 2 - len(list_intersect(w, ['small', 'red']))) AS sim FROM f WHERE grain = (SELECT min(grain) FROM f))
 SELECT eid, round(sim, 6) AS similarity, frequency FROM s WHERE sim >= 0.1 ORDER BY sim DESC, frequency DESC, eid DESC LIMIT 10""", False)
def partial_match(s, d):
    part = load(s, d, "part").select(F.col("p_partkey").alias("eid"), F.split("p_name", " ").alias("words"), F.col("p_retailprice").alias("frequency"), F.concat_ws("/", "p_brand", "p_type").alias("fine"), F.col("p_brand").alias("mid"), F.col("p_type").alias("coarse"))
    out = lookup.partial_match(part, ["small", "red"], {"fine": "Brand#11/none", "mid": "Brand#11", "coarse": "STANDARD"}, 0.1, 10)
    return out.select("eid", r6(F.col("similarity")).alias("similarity"), "frequency")


@query("SELECT instance, replace(concept, ' ', '-') AS concept, round(score, 6) AS score, rank FROM top")
def top_concepts(s, d):
    out = concepts.top_concepts(concepts.scores(tpch.taxonomy(s, d)), 2)
    return out.select("instance", "concept", r6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT p_type, p_partkey FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3", False)
def top_per_group(s, d):
    return sampling.top(load(s, d, "part").select("p_type", "p_partkey", "p_retailprice"), "p_type", [F.col("p_retailprice").desc(), F.col("p_partkey")], 3).select("p_type", "p_partkey")



@query("SELECT p_type, p_partkey FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY md5(p_partkey || '|0'), p_partkey) AS r FROM part) WHERE r <= 5", False)
def stratified_sample(s, d):
    return sampling.per_group(load(s, d, "part").select("p_type", "p_partkey"), "p_type", "p_partkey", 5)


@query(""", h AS (SELECT hid, count(DISTINCT rid) AS n, row_number() OVER (ORDER BY hid) AS i FROM edges GROUP BY 1),
 cut(i, hid, slice, held) AS (SELECT i, hid, 0, n FROM h WHERE i = 1 UNION ALL SELECT h.i, h.hid, CASE WHEN held >= 60 THEN slice + 1 ELSE slice END, CASE WHEN held >= 60 THEN n ELSE held + n END FROM cut JOIN h ON h.i = cut.i + 1)
 SELECT hid, CAST(slice AS BIGINT) AS slice FROM cut""")
def graph_slices(s, d):
    return graph.slices(tpch.nodes(s, d), tpch.edges(s, d), 1000, 60)[1].select("hid", "slice")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT sha1('c' || o_custkey) AS hid, sha1('p' || (o_orderkey % 97)) AS tid FROM orders),
 h AS (SELECT hid, list_append(list(tid), hid) AS w, count(*) AS n, row_number() OVER (ORDER BY hid) AS i FROM e GROUP BY 1),
 cut(i, hid, slice, held, edges) AS (SELECT i, hid, 0, w, n FROM h WHERE i = 1 UNION ALL
   SELECT h.i, h.hid, CASE WHEN len(held) >= 60 OR edges >= 150 THEN slice + 1 ELSE slice END, CASE WHEN len(held) >= 60 OR edges >= 150 THEN w ELSE list_distinct(list_concat(held, w)) END, CASE WHEN len(held) >= 60 OR edges >= 150 THEN n ELSE edges + n END
   FROM cut JOIN h ON h.i = cut.i + 1)
 SELECT hid, CAST(slice AS BIGINT) AS slice FROM cut""", False)
def parallel_slices(s, d):
    name = lambda kind, c: F.sha1(F.concat(F.lit(kind), c))
    edges = load(s, d, "orders").select(name("c", F.col("o_custkey")).alias("hid"), name("p", F.col("o_orderkey") % 97).alias("tid"))
    nodes = edges.select(F.col("hid").alias("eid")).distinct()
    return graph.slices(nodes, edges, 60, 150, 8)[1].select("hid", "slice")


@query("SELECT sha1(c_custkey::VARCHAR) AS eid, CAST((row_number() OVER (ORDER BY sha1(c_custkey::VARCHAR)) - 1) // 40 AS BIGINT) AS slice FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)", False)
def lone_slices(s, d):
    name = lambda c: F.sha1(F.col(c).cast("string"))
    edges = load(s, d, "orders").where("o_orderkey % 7 = 0").select(name("o_custkey").alias("hid"), name("o_custkey").alias("tid"), F.lit("r").alias("rid"))
    return graph.slices(load(s, d, "customer").select(name("c_custkey").alias("eid")), edges, 40, 40)[0]


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", False)
def set_intersect(s, d):
    return load(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(load(s, d, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0", False)
def set_except(s, d):
    return load(s, d, "customer").select(F.col("c_custkey").alias("k")).subtract(load(s, d, "orders").where("o_orderkey % 7 = 0").select("o_custkey"))


# ---- concepts ---------------------------------------------------------------------------------


@query("SELECT concept, instance, round(score, 6) AS score, round(freq / nc / ni, 9) AS pmi FROM score")
def taxonomy_scores(s, d):
    t = tpch.taxonomy(s, d)
    pmi = concepts.scores(t, "pmi").select("concept", "instance", F.round("score", 9).alias("pmi"))
    return concepts.scores(t).select("concept", "instance", r6(F.col("score")).alias("score")).join(pmi, ["concept", "instance"])


@query("SELECT pid, cid, eid, round(score, 6) AS score FROM pairs")
def concept_pairs(s, d):
    return tpch.pairs(s, d).select("pid", "cid", "eid", r6(F.col("score")).alias("score"))


@query("SELECT sha1(h.cid || '$' || t.cid) AS rid, h.cid AS hid, t.cid AS tid, sense, round(sum(weight * h.score * t.score), 4) AS weight FROM edges e JOIN pairs h ON e.hid = h.eid JOIN pairs t ON e.tid = t.eid WHERE h.cid <> t.cid GROUP BY ALL")
def concept_edges(s, d):
    return concepts.concept_edges(tpch.edges(s, d), tpch.pairs(s, d)).withColumn("weight", F.round("weight", 4))


@query("SELECT cid, round(sum(score * frequency), 4) AS weight FROM pairs JOIN nodes USING (eid) GROUP BY 1")
def concept_weights(s, d):
    return concepts.concept_weights(tpch.pairs(s, d), tpch.nodes(s, d)).withColumn("weight", F.round("weight", 4))


@query("SELECT count(DISTINCT concept) AS concepts, count(DISTINCT instance) AS instances, CAST(sum(freq) AS BIGINT) AS freq FROM tax")
def taxonomy_size(s, d):
    return concepts.sizes(tpch.taxonomy(s, d))


@query("""WITH t AS (SELECT n_name AS instance, r_name AS concept FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region)
 SELECT a.instance, 1 AS step, a.concept FROM t a WHERE a.instance IN (SELECT n_name FROM nation) UNION ALL SELECT a.instance, 2, b.concept FROM t a JOIN t b ON a.concept = b.instance WHERE a.instance IN (SELECT n_name FROM nation)""", False)
def concept_chain(s, d):
    n, r = load(s, d, "nation"), load(s, d, "region")
    t = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("concept"), F.col("n_name").alias("instance"), F.lit(1).alias("freq"))
    t = t.union(r.select(F.lit("WORLD"), "r_name", F.lit(1)))
    hyphens = lambda c: F.replace(c, F.lit(" "), F.lit("-"))
    named = t.select(hyphens("concept").alias("concept"), hyphens("instance").alias("instance"), "freq")
    out = concepts.chain(concepts.scores(named), n.select(hyphens("n_name").alias("instance")), 3)
    back = lambda c: F.replace(c, F.lit("-"), F.lit(" ")).alias(c)
    return out.select(back("instance"), "step", back("concept"))


# ---- functions ---------------------------------------------------------------------------------


@query("SELECT c_custkey, sha1(c_name) AS cid, sha1(sha1(c_name) || '$' || sha1(c_mktsegment)) AS pid FROM customer", False)
def ids(s, d):
    return load(s, d, "customer").select("c_custkey", F.sha1("c_name").alias("cid"), rid(F.sha1("c_name"), F.sha1("c_mktsegment")).alias("pid"))


@query(r"SELECT doc_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g'), '(?i)<ref(.*?)>', ' ', 'g'), 'https?://[^\s]+|www\.[^\s]+', '<url>', 'g'), '\s+', ' ', 'g'))) AS n FROM documents", False)
def clean_text(s, d):
    return load(s, d, "documents").select("doc_id", F.length(text.clean(F.col("text"))).cast("long").alias("n"))


@query(f"""WITH w AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '\\p{{L}}+')), lambda x: x NOT IN ({", ".join(f"'{p}'" for p in PRONOUNS)})) AS w FROM benchmark)
 SELECT a.item_id AS x, b.item_id AS y, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS jaccard, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6) AS simpson FROM w a JOIN w b ON b.item_id = a.item_id + 1""", False)
def overlap(s, d):
    w = load(s, d, "benchmark").select("item_id", text.tokens(F.col("text")).alias("w"))
    other = w.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"))
    both = text.jaccard(F.col("w"), F.col("v")), text.simpson(text.content_words("w"), text.content_words("v"))
    return w.join(other, "item_id").select(F.col("item_id").alias("x"), (F.col("item_id") + 1).alias("y"), r6(both[0]).alias("jaccard"), r6(both[1]).alias("simpson"))


# ---- relations, rewriting, linking ---------------------------------------------------------------


@query(r"""WITH u AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents)
 SELECT CASE word WHEN 'and' THEN 'Conjunction' WHEN 'or' THEN 'Alternative' WHEN 'so' THEN 'Result' WHEN 'but' THEN 'Contrast' WHEN 'if' THEN 'Condition' END AS sense, word, count(*) AS n FROM u WHERE word IN ('and', 'or', 'so', 'but', 'if') GROUP BY ALL""", False)
def connective_candidates(s, d):
    table = {"Conjunction": ["and"], "Alternative": ["or"], "Result": ["so"], "Contrast": ["but"], "Condition": ["if"]}
    sents = load(s, d, "documents").select(F.col("doc_id").alias("sid"), text.tokens(F.col("text")).alias("tokens"))
    return relations.candidates(sents, table).groupBy("sense", F.col("connective").alias("word")).agg(F.count("*").alias("n"))


@query(r"""WITH e AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part)
 SELECT p_partkey FROM e WHERE len(w) > 0 AND NOT (len(w) <= 2 AND list_has_any(w, ['red', 'small'])) AND w[1] NOT IN ('blue', 'large') AND NOT list_has_any(w, ['green'])""", False)
def event_filter(s, d):
    w = F.split(F.lower("p_name"), " ")
    return load(s, d, "part").where(post.keep_event(w, ("red", "small"), ("blue", "large"), ("green",))).select("p_partkey")


@query("""WITH a AS (SELECT 'user' AS w UNION SELECT 'x'), e AS (SELECT role, count(*)::DOUBLE AS weight FROM conversations GROUP BY 1)
 SELECT 'PersonX ' || role AS head, 'PersonY reply' AS tail, 'Reason' AS sense, weight FROM e UNION ALL SELECT 'PersonY ' || role, 'PersonX reply', 'Reason', weight FROM e""", False)
def person_regraph(s, d):
    e = load(s, d, "conversations").groupBy("role").agg(F.count("*").cast("double").alias("weight"))
    rows = e.select(F.array(F.lit("i"), "role").alias("head"), F.array(F.lit("you"), F.lit("reply")).alias("tail"), F.lit("Reason").alias("sense"), "weight")
    return post.regraph(rows)


@query("WITH l AS (SELECT p_brand AS mention, p_type AS entity, count(*) AS n FROM part GROUP BY ALL) SELECT mention, entity, round(least(1.0, n / sum(n) OVER (PARTITION BY mention)), 6) AS freq FROM l", False)
def mention_dictionary(s, d):
    out = linking.mention_dictionary(load(s, d, "part").groupBy(F.col("p_brand").alias("mention"), F.col("p_type").alias("entity")).agg(F.count("*").alias("n")))
    return out.withColumn("freq", r6(F.col("freq")))


@query("WITH l AS (SELECT p_brand AS mention, p_type AS entity, count(*) AS n FROM part GROUP BY ALL) SELECT mention, entity FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY n DESC, entity) AS r FROM l) WHERE r = 1", False)
def best_entities(s, d):
    counts = load(s, d, "part").groupBy(F.col("p_brand").alias("mention"), F.col("p_type").alias("entity")).agg(F.count("*").alias("n"))
    return linking.best_entities(counts.select("mention").distinct(), linking.mention_dictionary(counts)).select("mention", "entity")


@query(", ps AS (SELECT DISTINCT o_orderkey AS post, sha1(p_brand) AS eid FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hid ORDER BY total DESC, tid) AS r FROM tot) WHERE r <= 2) SELECT post, b.hid, e.sense, b.tid FROM ps JOIN b ON ps.eid = b.hid JOIN edges e ON e.hid = b.hid AND e.tid = b.tid WHERE e.sense <> 'Co_Occurrence'")
def dialogue_inference(s, d):
    posts = tpch.occurrences(s, d).select(F.col("sent").alias("post"), "eid")
    return linking.inference(posts, tpch.nodes(s, d), tpch.edges(s, d), 2, 1_000_000)


@query("""WITH p AS (SELECT DISTINCT p_partkey AS post, unnest(string_split(p_name, ' ')) AS t FROM part), n AS (SELECT DISTINCT p_name FROM part), x AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM n WHERE contains(p_name, ' '))
 SELECT p.post, x.a, 'r' AS r, x.b FROM x JOIN p ON p.t = x.a JOIN p q ON q.post = p.post AND q.t = x.b WHERE a <> b""", False)
def word_pairs(s, d):
    part = load(s, d, "part")
    w = F.split("p_name", " ")
    triples = part.where(F.contains("p_name", F.lit(" "))).select(w[0].alias("a"), F.lit("r").alias("r"), w[1].alias("b")).distinct()
    return linking.pair_lookup(triples, part.select(F.col("p_partkey").alias("post"), w.alias("tokens")))


@query("SELECT count(DISTINCT c_custkey) AS posts, count(DISTINCT o_custkey) AS covered, count(DISTINCT o_orderpriority) AS heads FROM customer LEFT JOIN orders ON c_custkey = o_custkey", False)
def coverage(s, d):
    posts = load(s, d, "customer").select(F.col("c_custkey").alias("post"))
    return linking.coverage(posts, load(s, d, "orders").select(F.col("o_custkey").alias("post"), F.col("o_orderpriority").alias("hid")))


from evkg.plans import made  # noqa: E402, F401  (registers its queries)
