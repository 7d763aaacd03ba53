"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation (level is 0 or 1)::

    conversation = "<s:" level ">" turn*
    turn         = "[INST]" role "[/INST]" text "</s>"

Level 0 writes roles and texts as they are.  The rendered string is parsed again by the same
grammar; where a recovered turn differs from its source, or a text holds a control string, the
conversation is rendered again at level 1, which replaces ``&``, ``<`` and ``[`` by the references
``&amp;``, ``&lt;`` and ``&lbr;``.  No control string survives that, and it is undone exactly, so the
loop ends there at the latest; ``identical`` reports the last comparison.

Defined results: rows are ordered by turn, then role, then text (ties, repeats: all kept); a null
role or text is empty; a null turn comes first; a null conv_id is a conversation of its own; an empty
table gives an empty one; other columns are ignored.  The turns of one conversation meet in one row,
as the formatted text is one string, so long texts and long conversations are formatted whole within one row's bound of
2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: The template's control strings.
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
HEAD = ("<s:0>", "<s:1>")
CONTROL = (OPEN, CLOSE, END, "<s>", *HEAD)
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lbr;"))


def escape(text: Column) -> Column:
    for raw, ref in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(ref))
    return text


def unescape(text: Column) -> Column:
    for raw, ref in reversed(ESCAPES):
        text = F.replace(text, F.lit(ref), F.lit(raw))
    return text


def render(turns: Column, level: int) -> Column:
    code = escape if level else (lambda c: c)
    parts = F.transform(turns, lambda t: F.concat(F.lit(OPEN), code(t["role"]), F.lit(CLOSE), code(t["text"]), F.lit(END)))
    return F.concat(F.lit(HEAD[level]), F.array_join(parts, ""))


def _split(text: Column, mark: str) -> Column:
    return F.split(text, "\\Q" + mark + "\\E", -1)


def parse(formatted: Column) -> Column:
    """Turns of a formatted string, or null where it is not in the grammar."""
    body = F.substring(formatted, len(HEAD[0]) + 1, 2_147_483_647)
    raised = F.startswith(formatted, F.lit(HEAD[1]))
    pieces = _split(body, END)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)  # what follows the last end mark is empty
    fields = F.transform(pieces, lambda p: _split(p, CLOSE))
    clean = lambda c: F.when(raised, unescape(c)).otherwise(c)
    turns = F.transform(
        fields,
        lambda f: F.struct(clean(F.substring(f[0], len(OPEN) + 1, 2_147_483_647)).alias("role"), clean(F.try_element_at(f, F.lit(2))).alias("text")),
    )
    inner = lambda f: F.concat(F.substring(f[0], len(OPEN) + 1, 2_147_483_647), F.lit("\n"), F.try_element_at(f, F.lit(2)))
    sound = F.forall(fields, lambda f: (F.size(f) == 2) & F.startswith(f[0], F.lit(OPEN)) & ~_holds_control(inner(f)))
    ok = F.endswith(formatted, F.lit(END)) | (F.length(formatted) == len(HEAD[0]))
    return F.when(sound & ok, turns)


def _holds_control(text: Column) -> Column:
    held = F.lit(False)
    for c in CONTROL:
        held = held | F.contains(text, F.lit(c))
    return held


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, formatted, level, turns, identical)``: the text, and the turns read back from it."""
    rows = pick(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), empty("role").alias("role"), empty("text").alias("text")))).alias("rows"))
    chats = chats.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("source"))
    plain = chats.withColumn("plain", render(F.col("source"), 0))
    checked = plain.withColumn("fits", F.coalesce(parse(F.col("plain")) == F.col("source"), F.lit(False)))
    done = checked.withColumn("formatted", F.when(F.col("fits"), F.col("plain")).otherwise(render(F.col("source"), 1)))
    back = done.withColumn("turns", parse(F.col("formatted")))
    return back.select("conv_id", "formatted", F.when(F.col("fits"), 0).otherwise(1).alias("level"), "turns", F.coalesce(F.col("turns") == F.col("source"), F.lit(False)).alias("identical"))


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """All text under the loss mask: each text of ``role`` once, in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")


def digest(chats: DataFrame) -> DataFrame:
    turns = F.col("turns")
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.withColumn("_loss", loss_text(turns)).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: DuckDB; the extra conversation is built in.
ORACLE = """
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, contains(role || chr(10) || text, '[INST]') OR contains(role || chr(10) || text, '[/INST]') OR contains(role || chr(10) || text, '</s>')
         OR contains(role || chr(10) || text, '<s>') OR contains(role || chr(10) || text, '<s:0>') OR contains(role || chr(10) || text, '<s:1>') AS bad,
         length(role) + length(text) + 6 + 7 + 4 AS plain,
         length(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '[', '&lbr;')) + 6 + 7 + 4 AS raised
  FROM src
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(5 + CASE WHEN bool_or(bad) THEN sum(raised) ELSE sum(plain) END AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("x"))
    extra = extra.select(F.lit(-7).cast("long").alias("conv_id"), F.col("x.turn").cast("long").alias("turn"), F.col("x.role").alias("role"), F.lit(said).alias("text"))
    rows = pick(table(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text").union(extra)
    return digest(format_chats(rows))
