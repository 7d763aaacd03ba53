"""Identifiers of nodes, edges, concepts and pairs."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def rid(hid: Column | str, tid: Column | str) -> Column:
    """Edge id: SHA-1 of both node ids with a dollar sign between."""
    return F.sha1(F.concat_ws("$", hid, tid))


pid = rid  # a concept-instance pair is named the same way, from cid and eid


def cid(words: Column | str) -> Column:
    """Concept id: SHA-1 of the words joined by blanks."""
    return F.sha1(F.array_join(words, " "))


def sid(path: Column | str, line: Column | str) -> Column:
    return F.concat_ws("|", path, line)


def eid_of(words, pos_tags, dependencies) -> str:
    """Node id of an eventuality whose dependencies are ``(governor, label, dependent)`` indexes of its words."""
    point = lambda i: [int(i), words[i], pos_tags[i]]
    edges = [[point(g), d, point(t)] for g, d, t in dependencies]
    return hashlib.sha1(json.dumps([edges, list(words), list(pos_tags)]).encode()).hexdigest()


def _json_text(text: Column) -> Column:
    """A string as JSON writes it in ASCII; other signs become references by UTF-16 unit."""
    hexed = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n.cast("int")), 4, "0")))
    rest = lambda n: n - 0x10000

    def one(c: Column) -> Column:
        n = F.ascii(c)
        pair = F.concat(hexed(F.shiftright(rest(n), 10) + 0xD800), hexed(rest(n).bitwiseAND(F.lit(0x3FF)) + 0xDC00))
        out = F.when(n > 0xFFFF, pair).otherwise(hexed(n))
        for raw, said in (("\"", '\\"'), ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
            out = F.when(c == raw, F.lit(said)).otherwise(out)
        return F.when(F.rlike(c, F.lit(_PLAIN)), c).otherwise(out)

    full = F.array_join(F.transform(F.split(text, ""), one), "")
    return F.concat(F.lit('"'), F.when(F.rlike(text, F.lit(_PLAIN)), text).otherwise(full), F.lit('"'))


_PLAIN = r"\A[ !#-\[\]-~]*\z"


def eid(words: Column | str, pos_tags: Column | str, dependencies: Column | str) -> Column:
    """``eid_of`` as an expression."""
    words, pos_tags, dependencies = (F.col(c) if isinstance(c, str) else c for c in (words, pos_tags, dependencies))
    listed = lambda xs: F.concat(F.lit("["), F.array_join(xs, ", "), F.lit("]"))
    point = lambda i: F.concat(F.lit("["), i.cast("string"), F.lit(", "), _json_text(F.get(words, i)), F.lit(", "), _json_text(F.get(pos_tags, i)), F.lit("]"))
    edges = F.transform(dependencies, lambda e: F.concat(F.lit("["), point(e["gov"]), F.lit(", "), _json_text(e["dep"]), F.lit(", "), point(e["dpt"]), F.lit("]")))
    return F.sha1(listed(F.array(listed(edges), listed(F.transform(words, _json_text)), listed(F.transform(pos_tags, _json_text)))))
