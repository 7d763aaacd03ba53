"""From text or parses to eventualities and relations, in the two presets of rules.

The parser is a function of the caller: text to parsed sentences; it runs on the executors, in batches.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evkg.functions import text
from evkg.operators import discourse, extract, graph, relations
from evkg.schema import CLAUSE_WORDS, CONNECTIVES
from evkg.sources import steps

PARSED = "doc string, para_idx int, sent_idx int, text string, tokens array<string>, lemmas array<string>, pos_tags array<string>, ners array<string>, parse string, dependencies array<struct<gov:int,dep:string,dpt:int>>"
#: ``seed``: rules on whole sentences, questions and clauses of wh-words left out; ``discourse``: rules on clauses.
PRESETS = ("seed", "discourse")


def normalise(sentence: dict) -> dict:
    """A parse with 1-based edges and a root as 0-based edges without it, by governor and dependent."""
    edges = sorted({(g - 1, d, t - 1) for g, d, t in sentence["dependencies"] if g > 0 and d != "ROOT"}, key=lambda e: (e[0], e[2]))
    return {**sentence, "dependencies": [{"gov": g, "dep": d, "dpt": t} for g, d, t in edges]}


def parse_text(paragraphs: DataFrame, parser: Callable[[str], list[dict]], most: int = 1024, done: DataFrame | None = None) -> DataFrame:
    """Sentences of ``(doc, para_idx, text)``: cleaned, cut into pieces a parser can take, parsed; documents of ``done``
    are left out.  ``sent_idx`` counts within the document."""
    todo = paragraphs.join(done.select("doc").distinct(), "doc", "left_anti") if done is not None else paragraphs
    pieces = todo.select("doc", "para_idx", F.posexplode(text.short_pieces(text.clean(F.col("text"), keep_lines=True), most)).alias("piece", "text"))

    def run(batches):
        for b in batches:
            rows = [
                {"doc": d, "para_idx": p, "sent_idx": i, "piece": piece, **{k: s.get(k) for k in ("text", "tokens", "lemmas", "pos_tags", "ners", "parse", "dependencies")}}
                for d, p, piece, t in zip(b["doc"], b["para_idx"], b["piece"], b["text"], strict=True) for i, s in enumerate(map(normalise, parser(t)))
            ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in shape.split(", ")])

    shape = f"{PARSED}, piece int"
    out = pieces.mapInPandas(run, shape)
    w = F.row_number().over(graph.Window.partitionBy("doc").orderBy("para_idx", "piece", "sent_idx"))
    return out.withColumn("sent_idx", w).drop("piece").withColumn("sid", F.concat_ws("|", "doc", "sent_idx"))


def eventualities(sentences: DataFrame, preset: str = "seed", in_order: bool = True) -> DataFrame:
    """Occurrences by sentence and position, or one row an eventuality with its frequency."""
    if preset not in PRESETS:
        raise ValueError(f"preset must be one of {PRESETS}")
    out = extract.extract(sentences, clause_split=preset == "discourse")
    return out if in_order else extract.merged(out)


def relations_of(sentences: DataFrame, occurrences: DataFrame, table=CONNECTIVES, models=None, similarity=text.simpson, threshold: float = 0.8) -> DataFrame:
    """``(hid, tid, sense, weight, head_sid, tail_sid)``: co-occurrence, and relations inside sentences and between neighbours; by
    seed connectives, or with trained ``models`` (``operators.discourse``) by discourse parsing, of sentences with ``doc``."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be between 0 and 1")
    if models is not None:  # five steps read them, and each would hold the whole plan of the extraction
        occurrences = steps.kept(occurrences.select("sid", "eid", "position", "raw_idx"))
    placed = occurrences.select(F.col("sid").alias("sent"), "eid", F.col("position").alias("pos"))
    both = graph.cooccurrence(placed).select("hid", "tid", "sense", "weight", F.col("sent").alias("head_sid"), F.col("sent").alias("tail_sid"))
    if models is None:
        return both.unionByName(relations.within(sentences, occurrences, table)).unionByName(relations.across(sentences, occurrences, table))
    own = occurrences.join(sentences.select("sid", "doc", "sent_idx"), "sid").select("sid", "doc", "sent_idx", "eid", F.col("raw_idx").alias("places"))
    found = discourse.parse(sentences, models, occurrences, table)
    return both.unionByName(discourse.edges(found, own, similarity, threshold).select(*both.columns))


def eventualities_and_relations(sentences: DataFrame, preset: str = "seed", models=None) -> tuple[DataFrame, DataFrame]:
    found = eventualities(sentences, preset)
    return found, relations_of(sentences, found, models=models)


def triplets(occurrences: DataFrame, found: DataFrame) -> DataFrame:
    """``(head_sid, tail_sid, head, sense, tail, weight)`` of found relations, as joined words; ``to_json`` of its rows is the JSON form."""
    said = occurrences.groupBy("eid").agg(F.array_join(F.any_value("words"), " ").alias("said"))
    out = found.join(said.toDF("hid", "head"), "hid").join(said.toDF("tid", "tail"), "tid")
    return out.select("head_sid", "tail_sid", "head", "sense", "tail", "weight")


def found_again(sources: DataFrame, sentences: DataFrame, preset: str = "seed", table=CONNECTIVES, models=None) -> DataFrame:
    """``(rid, sense)`` that the sentences of ``sources`` (``rid, head_sid, tail_sid``) still yield: only these are extracted again."""
    sids = sources.select(F.explode(F.array("head_sid", "tail_sid")).alias("sid")).distinct()
    own = sentences.join(sids, "sid", "left_semi")
    found = relations_of(own, eventualities(own, preset), table, models)
    named = found.select(graph.rid("hid", "tid").alias("rid"), "sense", "head_sid", "tail_sid")
    return named.join(sources, ["rid", "head_sid", "tail_sid"], "left_semi").select("rid", "sense").distinct()


EVENTUALITY = "eid string, pattern string, words array<string>, pos_tags array<string>, position double, raw_idx array<int>"


class _Eventualities:
    """One sentence to its eventualities, for SQL."""

    def eval(self, tokens, lemmas, pos_tags, dependencies, skip=None):
        edges = [(e["gov"], e["dep"], e["dpt"]) for e in dependencies or ()]
        for e in extract.eventualities(list(tokens), list(lemmas), list(pos_tags), edges, CLAUSE_WORDS if skip is None else tuple(skip)):
            yield e["eid"], e["pattern"], e["words"], e["pos_tags"], float(e["position"]), e["raw_idx"]


def register(spark) -> None:
    """Makes ``eventualities(tokens, lemmas, pos_tags, dependencies, skip)`` a table function of the session's SQL, for lateral
    joins with any table of sentences; ``skip`` are the words whose sentences are left out, null for those of the rules."""
    spark.udtf.register("eventualities", F.udtf(_Eventualities, returnType=EVENTUALITY))


def connectives(table: DataFrame) -> dict[str, tuple[str, ...]]:
    """A table ``(sense, connective)``, some hundred rows, as the relation operators take it."""
    out: dict[str, tuple[str, ...]] = {}
    for r in table.select("sense", "connective").distinct().orderBy("sense", "connective").collect():
        out[r["sense"]] = (*out.get(r["sense"], ()), r["connective"])
    return out
