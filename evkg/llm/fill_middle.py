"""Fill-in-middle transformation.

A text is decoded to an array of UTF-32 code points.  Each is a blank or not; where a blank follows a code point that is
none, a token ends, and one ends at the end of the text (a token is a run of other code points with the blanks before
it, or the blanks at the end).  Two hashes of the document's id pick how many tokens the prefix and what comes before
the suffix have; a third one decides whether the text is changed at all, a fourth one the form: ``<P>`` prefix ``<S>``
suffix ``<M>`` middle (psm), or ``<S>`` suffix ``<P>`` prefix ``<M>`` middle (spm).

A text that holds a mark stays plain, and every mark begins with the only ``<`` in it, so no mark can arise where pieces
meet: ``restored`` undoes a form exactly.

Defined results: null text is empty, an empty text stays plain with no tokens; a null id is hashed as the empty string;
repeated rows give equal rows; texts are read whole; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LONG, STR, pick, schema, table

#: Marks of the pieces.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, those that are changed; of 100 changed ones, those that begin with the suffix.
CHANGED, SPM, SEED = 50, 80, 42


def ends(points: np.ndarray) -> np.ndarray:
    """Where tokens end."""
    blank = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    inner = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.append(inner, len(points)) if len(points) else inner


def numbers(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four unsigned numbers of 32 bits, made of a document's id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(doc_id: int | None, text: str, seed: int = SEED, changed: int = CHANGED, spm: int = SPM) -> tuple:
    """``(n, form, prefix, middle, output)``, the middle ones in code points, null if plain."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = ends(points)
    n, (h1, h2, h3, h4) = len(at), numbers(doc_id, seed)
    if not text or h3 % 100 >= changed or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (int(at[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    piece = lambda x: x.tobytes().decode("utf-32-le", "surrogatepass")
    prefix, middle, suffix = piece(points[:a]), piece(points[a:b]), piece(points[b:])
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, changed: int = CHANGED, spm: int = SPM) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` of each row."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                ids = b.column(0).slice(at, 512)
                got = [transform(i, t or "", seed, changed, spm) for i, t in zip(ids.to_pylist(), b.column(1).slice(at, 512).to_pylist(), strict=True)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds))], names=names)

    src = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("string"))
    return src.mapInArrow(run, schema(doc_id=LONG, n=LONG, form=STR, prefix_chars=LONG, middle_chars=LONG, output=STR))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    piece = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(piece(1), piece(3), piece(2))).when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(output)


#: DuckDB.
ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS toks,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT *, len(toks) AS n, ('0x' || h[1:8])::UBIGINT % (len(toks) + 1) AS k1, ('0x' || h[9:16])::UBIGINT % (len(toks) + 1) AS k2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::UBIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || h[25:32])::UBIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), v AS (
  SELECT *, array_to_string(toks[1:least(k1, k2)], '') AS prefix, array_to_string(toks[least(k1, k2) + 1:greatest(k1, k2)], '') AS middle, array_to_string(toks[greatest(k1, k2) + 1:], '') AS suffix FROM u
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM v
"""


def query(spark, sf_dir: str) -> DataFrame:
    out = fill_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
