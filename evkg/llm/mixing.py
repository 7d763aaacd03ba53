"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic).  The cells are raked: their weights are scaled to the
source, language and topic marginals in turn until all three hold.  A cell's documents are then sampled
with a probability in proportion to raked over observed tokens, calibrated so that the expected tokens
are the budget (a probability stops at one, the rest makes up for it).  Whether a document is kept depends
on a hash of its id alone, so a run can be repeated.

A target left out is the observed share to the power of ``FLATTEN``; in a given one ``*`` stands for each value that
it does not name.  Topics are lexical: the first pattern that a text matches.  Cells are few (sources x languages x
topics); up to ``DRIVER_CELLS`` they are raked on the driver, more of them by DataFrame joins; both ways take the same
steps and stop at the same gap of the marginals.  Where the targets contradict one another (no cell holds what they
ask for), raking stops after ``ROUNDS`` with the last axis fitted and warns of the gap that is left.

Defined results: null source or language is ``unknown``; null text has no words and topic ``general``;
targets of values that don't occur are left out and the rest is scaled to one; a value without a target gets
none; a target that names no observed value counts as left out; rows without an id are sampled by the hash of the
empty string; repeated rows are kept or dropped together; an empty table gives an empty one; other columns are kept
by ``sample``, whatever their names; long texts are counted whole, and one cell may hold any part of the rows.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, remove, table, unused, written

FLATTEN = 0.7
BUDGET = 0.5
ROUNDS, CLOSE = 60, 1e-9
#: Halvings of the interval in which the sampling factor lies.
HALVINGS = 64
DRIVER_CELLS = 50_000
AXES = ("source", "lang", "topic")
#: The given targets: all sources alike, shares of the languages and of the topics.
TARGETS = {
    "source": {"*": 1.0},
    "lang": {"en": 0.4, "de": 0.18, "fr": 0.18, "es": 0.18, "*": 0.06},
    "topic": {"general": 0.85, "web": 0.05, "contact": 0.05, "legal": 0.05},
}
#: Topics and what a text of it holds; the first that fits, else ``general``.
TOPICS = (("legal", r"(?i)\b(?:licen[sc]e|copyright|warranty|permission)"), ("web", r"(?i)https?://|\bcookies?\b|\bclick here\b"), ("contact", r"@[a-z0-9-]+\.[a-z]|\b\d{3}[-. ]\d{3,4}\b"))


def topic_of(text: Column, topics=TOPICS) -> Column:
    out = F.lit("general")
    for name, pattern in reversed(topics):
        out = F.when(F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False)), F.lit(name)).otherwise(out)
    return out


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topics=TOPICS) -> DataFrame:
    """``(doc_id, source, lang, topic, tokens)``."""
    src = pick(docs, doc_id=id_col, text=text_col, source=source_col, lang=lang_col)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c)
    return src.select("doc_id", named("source"), named("lang"), topic_of(F.col("text"), topics).alias("topic"), F.coalesce(F.regexp_count("text", F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long").alias("tokens"))


def shares(observed: dict[str, float], target: dict[str, float] | None, flatten: float = FLATTEN) -> dict[str, float]:
    """Target shares over the observed values; they sum to one."""
    given = {k: float(target.get(k, target.get("*", 0.0))) for k in observed} if target else {}
    want = given if sum(given.values()) > 0 else {k: (v**flatten if v > 0 else 0.0) for k, v in observed.items()}
    total = sum(want.values())
    return {k: v / total for k, v in want.items()}


def _warn(gap: float) -> None:
    if gap >= 1e-6:
        warnings.warn(f"raking left a gap of {gap:.3g} in a marginal: the targets contradict one another", stacklevel=3)


def rake(cells: list[tuple], tokens: list[float], targets: dict[str, dict[str, float] | None] | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """Raked shares of the cells, on the driver."""
    seen = np.array(tokens, np.float64)
    w = seen / max(seen.sum(), 1e-300)
    codes, goals = [], []
    for i, axis in enumerate(AXES):
        names = sorted({c[i] for c in cells})
        code = np.array([names.index(c[i]) for c in cells])
        have = dict(zip(names, np.bincount(code, w, len(names)).tolist(), strict=True))
        want = shares(have, (targets or {}).get(axis))
        codes.append(code)
        goals.append(np.array([want[n] for n in names]))
    off = 0.0
    for _ in range(rounds):
        off = 0.0
        for code, goal in zip(codes, goals, strict=True):
            now = np.bincount(code, w, len(goal))
            off = max(off, float(np.abs(now - goal).max()))
            w = w * np.where(now > 0, goal / np.where(now > 0, now, 1), 0)[code]
        if off < CLOSE:
            break
    _warn(off)
    return w


def rake_frame(cells: DataFrame, targets: dict[str, dict[str, float] | None] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``(source, lang, topic, tokens, w)``: the same steps for more cells than the driver should hold."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    now = cells.withColumn("w", F.col("tokens") / F.lit(float(total)))
    goals = {}
    for axis in AXES:
        have = now.groupBy(axis).agg(F.sum("w").alias("have"))
        given, goal = (targets or {}).get(axis), have.withColumn("goal", F.pow("have", F.lit(FLATTEN)))
        if given:
            rows = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], "_k string, _v double")
            asked = have.join(F.broadcast(rows), F.col(axis) == F.col("_k"), "left").withColumn("goal", F.coalesce("_v", F.lit(float(given.get("*", 0.0)))))
            goal = asked if asked.agg(F.sum("goal")).first()[0] else goal
        whole = goal.agg(F.sum("goal")).first()[0] or 1
        goals[axis] = cut(goal.select(axis, (F.col("goal") / F.lit(float(whole))).alias("goal")))
    off, path, made, spark = 0.0, None, [], cells.sparkSession
    for _ in range(rounds):
        off = 0.0
        for axis in AXES:
            have, have_path = written(now.groupBy(axis).agg(F.sum("w").alias("have")).join(goals[axis], axis))
            made.append(have_path)
            off = max(off, float(have.agg(F.max(F.abs(F.col("have") - F.col("goal")))).first()[0] or 0))
            now = now.join(have, axis).withColumn("w", F.when(F.col("have") > 0, F.col("w") * F.col("goal") / F.col("have")).otherwise(0.0)).select(*AXES, "tokens", "w")
        now, path = written(now, path)
        while made:
            remove(spark, made.pop())
        if off < CLOSE:
            break
    _warn(off)
    return now


def calibrate(tokens: np.ndarray, shares_: np.ndarray, budget: float) -> float:
    """``c`` such that ``sum of tokens * min(1, c * share / tokens)`` is the budget, or all that can be had."""
    rate = np.where(tokens > 0, shares_ / np.maximum(tokens, 1e-300), 0.0)
    can = tokens[rate > 0].sum()
    goal = min(budget, can)
    low, high = 0.0, 1.0 / rate[rate > 0].min() if (rate > 0).any() else 0.0
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        low, high = (mid, high) if (tokens * np.minimum(1, mid * rate)).sum() < goal else (low, mid)
    return high


def cell_rates(described: DataFrame, targets=None, budget: float = BUDGET, driver_cells: int = DRIVER_CELLS, rounds: int = ROUNDS) -> DataFrame:
    """``(source, lang, topic, weight, probability)`` for each cell."""
    spark = described.sparkSession
    cells = cut(described.groupBy(*AXES).agg(F.sum("tokens").cast("double").alias("tokens")))
    n = cells.count()
    if n <= driver_cells:
        rows = sorted(tuple(r) for r in cells.collect())
        tokens = np.array([r[3] for r in rows], np.float64)
        if tokens.sum() <= 0:
            return cells.select(*AXES, F.lit(0.0).alias("weight"), F.lit(1.0).alias("probability"))
        w = rake([r[:3] for r in rows], tokens.tolist(), targets, rounds)
        c = calibrate(tokens, w, budget * tokens.sum())
        out = [(*r[:3], float(s * tokens.sum() / r[3]) if r[3] else 0.0, float(min(1.0, c * s / r[3])) if r[3] else 1.0) for r, s in zip(rows, w, strict=True)]
        return spark.createDataFrame(out, "source string, lang string, topic string, weight double, probability double")
    raked = cut(rake_frame(cells, targets, rounds))
    total = raked.agg(F.sum("tokens")).first()[0]
    rate = F.col("w") / F.col("tokens")
    low, high = 0.0, float(raked.where("w > 0").agg(F.max(1 / rate)).first()[0] or 0)
    can = float(raked.where("w > 0").agg(F.sum("tokens")).first()[0] or 0)
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        got = raked.agg(F.sum(F.when(F.col("tokens") > 0, F.col("tokens") * F.least(F.lit(1.0), F.lit(mid) * rate)))).first()[0]
        low, high = (mid, high) if got < min(budget * total, can) else (low, mid)
    some = F.col("tokens") > 0
    return raked.select(*AXES, F.when(some, rate * F.lit(float(total))).otherwise(0.0).alias("weight"), F.when(some, F.least(F.lit(1.0), F.lit(high) * rate)).otherwise(1.0).alias("probability"))


def unit(key: Column, seed: int = 20) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def mix(docs: DataFrame, targets=None, budget: float = BUDGET, driver_cells: int = DRIVER_CELLS, **cols: str) -> DataFrame:
    """``(doc_id, source, lang, topic, tokens, weight, probability, kept)``, a row for each row of ``docs``."""
    described = cut(describe(docs, **cols))
    rates = cell_rates(described, targets, budget, driver_cells).select(*[F.col(a).alias(f"_{a}") for a in AXES], "weight", "probability")
    on = [F.col(a) == F.col(f"_{a}") for a in AXES]
    # No more cells than the driver has held, else a join that AQE can split.
    few = F.broadcast if rates.count() <= driver_cells else (lambda x: x)
    out = described.join(few(rates), on)
    return out.select("doc_id", *AXES, "tokens", "weight", "probability", (unit(F.col("doc_id")) < F.col("probability")).alias("kept"))


def sample(docs: DataFrame, targets=None, budget: float = BUDGET, driver_cells: int = DRIVER_CELLS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The sampled rows of ``docs``, all columns as they are; no join on ids."""
    described = describe(docs, id_col, text_col, source_col, lang_col)
    cell_name, p_name = unused(docs, "_cell", "_p")
    rates = cell_rates(described, targets, budget, driver_cells).select(F.struct(*AXES).alias(cell_name), F.col("probability").alias(p_name))
    rates = cut(rates)
    lower = {c.lower(): c for c in docs.columns}
    of = lambda c: docs[f"`{lower[c.lower()]}`"] if c.lower() in lower else F.lit(None).cast("string")
    named = lambda c, n: F.coalesce(of(c).cast("string"), F.lit("unknown")).alias(n)
    cell = F.struct(named(source_col, "source"), named(lang_col, "lang"), topic_of(of(text_col)).alias("topic"))
    few = F.broadcast if rates.count() <= driver_cells else (lambda x: x)
    return docs.join(few(rates), (cell == rates[cell_name]) & (unit(of(id_col)) < rates[p_name]), "left_semi")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents with their probability under the given targets."""
    return mix(table(spark, sf_dir, "documents"), TARGETS)
