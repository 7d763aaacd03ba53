"""Constituency parses as spans, and the clauses of a sentence."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import groupby

# Tokens that end a clause, and tokens that are stripped from both ends of one.
SEPARATORS = frozenset([".", ",", ":", ";", "?", "!", "~", "-", "..", "...", "--", "---"])
PUNCTUATION = frozenset(list("!\"#&'*+,-..../:;<=>?@[\\]^_`|~") + ["``", "''", "-LCB-", "-LRB-"])


@lru_cache(maxsize=256)
def spans(parse: str | None) -> tuple[tuple[int, str, int, int], ...]:
    """``(depth, label, first leaf, last leaf + 1)`` of the inner nodes of a bracketed parse, level by level."""
    out, open_, leaf = [], [], 0
    for part in re.findall(r"\(|\)|[^\s()]+", parse or ""):
        if part == "(":
            open_.append([None, leaf])
        elif part == ")":
            if open_:
                label, first = open_.pop()
                out.append((len(open_), label or "", first, leaf))
        elif open_ and open_[-1][0] is None:
            open_[-1][0] = part
        else:
            leaf += 1
    return tuple(sorted(out, key=lambda s: (s[0], s[2])))


def path_to_root(parse: str, leaf: int) -> list[str]:
    """Labels of the nodes over a leaf, from below."""
    return [label for _, label, a, b in reversed(spans(parse)) if a <= leaf < b]


def lowest_common(parse: str, leaves: list[int]) -> str | None:
    """Label of the lowest node over all of the leaves."""
    return next((label for _, label, a, b in reversed(spans(parse)) if a <= min(leaves) and max(leaves) < b), None)


def siblings(parse: str, node: tuple, side: str = "both") -> list[tuple[int, str, int, int]]:
    """The other children of a node's parent, all or those on its ``left`` or ``right``."""
    depth, _, first, end = node
    over = next(((a, b) for d, _, a, b in spans(parse) if d == depth - 1 and a <= first and end <= b), None)
    if over is None:
        return []
    own = [x for x in spans(parse) if x[0] == depth and over[0] <= x[2] and x[3] <= over[1] and x != node]
    return [x for x in own if side == "both" or (x[2] < first) == (side == "left")]


def node_path(parse: str, one: tuple, two: tuple) -> str:
    """Labels from one node up to the lowest common one (``>``) and down to the other (``<``)."""
    line = lambda node: [x for x in reversed(spans(parse)) if x[0] <= node[0] and x[2] <= node[2] and node[3] <= x[3]]
    up, down = line(one), line(two)
    top = next(x for x in up if x in down)
    rise, fall = up[: up.index(top) + 1], down[: down.index(top)]
    return ">".join(x[1] for x in rise) + "".join(f"<{x[1]}" for x in reversed(fall))


def relative_position(parse: str, one: tuple, two: tuple) -> str:
    """Where the second node stands: ``left`` or ``right`` of the first, or ``middle`` where one is over the other or both are one."""
    if two[3] <= one[2]:
        return "left"
    return "right" if one[3] <= two[2] else "middle"


def subtree(parse: str | None, leaves) -> str:
    """The bracketed parse of these leaves and of the nodes over them; of none an empty text, of all the parse itself."""
    wanted, out, leaf = set(leaves), [[]], 0
    for part in re.findall(r"\(|\)|[^\s()]+", parse or ""):
        if part == "(":
            out.append([])
        elif part == ")":
            if len(out) > 1:
                own = out.pop()
                if len(own) > 1:  # a label alone has lost its leaves
                    out[-1].append(f"({' '.join(own)})")
        elif len(out) > 1 and not out[-1]:
            out[-1].append(part)
        else:
            if leaf in wanted:
                out[-1].append(part)
            leaf += 1
    return " ".join(out[0])


def compressed(labels: list[str]) -> list[str]:
    """A path without repeats of a label in a row."""
    return [label for label, _ in groupby(labels)]


def strip(tokens: list[str], clause: list[int]) -> list[int]:
    """A clause without punctuation at either end."""
    lo, hi = 0, len(clause)
    while lo < hi and tokens[clause[lo]] in PUNCTUATION:
        lo += 1
    while lo < hi and tokens[clause[hi - 1]] in PUNCTUATION:
        hi -= 1
    return clause[lo:hi]


def clauses(tokens: list[str], parse: str | None, connectives=()) -> list[tuple[int, ...]]:
    """Distinct clauses: the sentence is cut at separators and connectives, each piece is stripped, and the first
    subordinate clause (SBAR) that covers a part of it is taken out of it."""
    pieces, own = [], []
    for i, t in enumerate(tokens):
        if t in SEPARATORS or i in connectives:
            pieces.append(own)
            own = []
        else:
            own.append(i)
    out, tree = [], [(a, b) for _, label, a, b in spans(parse) if label == "SBAR"]
    for piece in [*pieces, own]:
        piece = strip(tokens, piece)
        if not piece:
            continue
        inside = ([i for i in piece if a <= i < b] for a, b in tree)
        part = next((x for x in inside if 0 < len(x) < len(piece)), None)
        out += sorted([tuple(part), tuple(i for i in piece if i not in set(part))]) if part else [tuple(piece)]
    return sorted(set(out))


def segments(n: int, edges) -> list[tuple[int, int, int]]:
    """Phrases ``(head, first, last)`` of ``n`` words: words joined by compound edges where they stand together, all
    others by themselves.  A compound comes at its head, a piece of one that is torn apart at its first word."""
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    pairs = [(g, t) for g, d, t in edges if d.startswith("compound")]
    for g, t in pairs:
        up[root(g)] = root(t)
    groups: dict[int, list[int]] = {}
    for i in sorted({i for p in pairs for i in p}):
        groups.setdefault(root(i), []).append(i)
    told = {t for _, t in pairs}
    out = [(i, i, i) for i in range(n) if all(i not in g for g in groups.values())]
    for g in groups.values():
        runs: list[list[int]] = []
        for i in g:
            if runs and runs[-1][-1] == i - 1:
                runs[-1].append(i)
            else:
                runs.append([i])
        whole = len(runs) == 1
        out += [(next((i for i in r if i not in told), r[0]) if whole else r[0], r[0], r[-1]) for r in runs]
    return sorted(out)


def entity_type(types) -> str:
    """The commonest type but O of a word, from one type or counts of types."""
    if isinstance(types, str):
        return types
    return next((t for t, _ in Counter(types).most_common() if t != "O"), "O")
