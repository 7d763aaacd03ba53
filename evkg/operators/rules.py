"""The eventuality patterns: which edges make one, which may join it, which its words may have besides."""

from __future__ import annotations

from dataclasses import dataclass, field

# Labels of a modifier (its first ``case`` word comes with it).
MODIFIERS = (
    "nmod:near", "nmod:into", "nmod:for", "nmod:around", "nmod:with", "nmod:poss", "nmod:inside", "nmod:at", "nmod:outside_of",
    "nmod:than", "nmod:from", "nmod:in", "nmod:on", "nmod:to", "nmod:away_from", "amod:as", "nmod:down", "nmod:up", "nmod:tmod",
    "nmod:along", "nmod:over", "nmod:out_of", "nmod:of", "nmod:without", "nmod:by", "nmod:through", "nmod:about", "nmod:agent",
)
# Further labels that join a verb, and a noun.
VERB = ("advmod", "neg", "aux", "compound:prt")
NOUN = ("acl", "amod", "neg", "nummod", "compound", "det", "nmod:poss", "mark", "det:qmod", "case")
# Labels that a verb may have besides without being part of the eventuality.
BESIDES = (
    "ccomp", "parataxis", "conj:but", "advcl", "dep", "cc", "punct", "mark", "conj:and", "advcl:to", "advcl:though", "advcl:after",
    "advcl:if", "advcl:while", "advcl:as", "advcl:for", "advcl:in", "advcl:since", "advcl:from", "advcl:before", "advcl:because",
    "advcl:based_on", "advcl:with", "advcl:although", "advcl:by", "advcl:so", "advcl:at", "advcl:on", "advcl:upon", "advcl:until",
    'advcl:"s', "advcl:instead_of", "advcl:despite", "advcl:through", "advcl:unless", "advcl:in_order", "advcl:ago",
)
TIMES = ("nmod:tmod", "nmod:after")


@dataclass(frozen=True)
class Pattern:
    """``core`` edges (governor, label, dependent), in order; ``modified`` words; ``joins`` labels that join a word;
    ``besides`` labels that a word may have besides, any other rejects; words that no ``ccomp`` edge may lead to."""

    core: tuple[tuple[str, str, str], ...]
    modified: tuple[str, ...]
    joins: dict[str, tuple[str, ...]]
    besides: dict[str, tuple[str, ...]]
    no_ccomp: tuple[str, ...] = field(default=())


SUBJECT, OBJECT = ("V1", "nsubj", "S1"), ("V1", "dobj", "O1")
# The patterns, in order.
PATTERNS: dict[str, Pattern] = {
    "s-v": Pattern((SUBJECT,), ("V1", "S1"), {"S1": (*NOUN, "compound:prt"), "V1": (*VERB, "mark")}, {"V1": BESIDES}),
    "s-v-o": Pattern((SUBJECT, OBJECT), ("V1", "S1", "O1"), {"V1": VERB, "S1": NOUN, "O1": NOUN}, {"V1": (*BESIDES, "aux")}),
    "s-v-o-o": Pattern((SUBJECT, OBJECT, ("V1", "iobj", "O2")), ("V1", "S1", "O1", "O2"), {"S1": NOUN, "O1": NOUN, "O2": NOUN, "V1": VERB}, {"V1": BESIDES}),
    "s-be-a": Pattern(
        (("A1", "cop", "V1"), ("A1", "nsubj", "S1")), ("A1", "S1"),
        {"A1": ("acl", "advmod", "neg", "aux", "compound:prt", "det", "amod", "compound", "nmod:poss", "det:qmod", "case"), "S1": NOUN},
        {"A1": (*BESIDES, *TIMES, "nsubj:xsubj", "nmod:npmod")},
    ),
    "s-v-be-a": Pattern((SUBJECT, ("V1", "xcomp", "A1"), ("A1", "cop", "V2")), ("A1", "V1", "S1"), {"V1": (*VERB, "mark"), "A1": NOUN, "S1": NOUN}, {"V1": (*BESIDES, *TIMES, "nsubj:xsubj")}),
    "s-v-v-o": Pattern(
        (SUBJECT, ("V1", "xcomp", "V2"), ("V2", "dobj", "O1")), ("O1", "S1", "V1", "V2"), {"V1": (*VERB, "mark"), "V2": (*VERB, "mark"), "O1": NOUN, "S1": NOUN},
        {"V1": (*BESIDES, *TIMES, "nsubj:xsubj"), "V2": (*BESIDES, *TIMES, "nsubj:xsubj")}, ("V1", "V2"),
    ),
    "s-v-v": Pattern(
        (SUBJECT, ("V1", "xcomp", "V2")), ("V2", "S1", "V1"), {"V1": (*VERB, "mark"), "V2": (*VERB, "mark"), "S1": NOUN},
        {"V1": (*BESIDES, *TIMES, "nsubj:xsubj"), "V2": (*BESIDES, *TIMES, "nsubj:xsubj")},
    ),
    "spass-v": Pattern((("V1", "nsubjpass", "S1"),), ("V1", "S1"), {"S1": NOUN, "V1": (*VERB, "auxpass", "mark")}, {"V1": (*BESIDES, *TIMES)}),
    "s-v-o-v-o": Pattern(
        (SUBJECT, OBJECT, ("V1", "xcomp", "V2"), ("V2", "dobj", "O2")), ("S1", "V1", "V2", "O1", "O2"), {"V1": VERB, "V2": VERB, "S1": NOUN, "O1": NOUN, "O2": NOUN},
        {"V1": BESIDES, "V2": (*BESIDES, "nsubj:xsubj")},
    ),
    "s-v-o-be-a": Pattern(
        (SUBJECT, OBJECT, ("V1", "xcomp", "A1"), ("A1", "cop", "V2")), ("S1", "V1", "V2", "O1", "A1"),
        {"V1": VERB, "V2": VERB, "A1": ("acl", "advmod", "neg", "aux", "compound:prt"), "S1": NOUN, "O1": NOUN}, {"V1": BESIDES, "V2": BESIDES},
    ),
    "spass-v-v-o": Pattern(
        (("V1", "nsubjpass", "S1"), ("V1", "xcomp", "V2"), ("V2", "dobj", "O1")), ("S1", "V1", "V2", "O1"), {"V1": (*VERB, "auxpass"), "V2": VERB, "S1": NOUN, "O1": NOUN},
        {"V1": BESIDES, "V2": BESIDES},
    ),
    "spass-v-o": Pattern((("V1", "nsubjpass", "S1"), OBJECT), ("S1", "V1", "O1"), {"V1": (*VERB, "auxpass"), "S1": NOUN, "O1": NOUN}, {"V1": BESIDES}),
    "there-be-o": Pattern((SUBJECT, ("V1", "expl", "E1")), ("S1", "V1"), {"V1": (*VERB, "auxpass"), "S1": NOUN}, {"V1": BESIDES}),
    "s-v-o-v-o-o": Pattern(
        (SUBJECT, OBJECT, ("V1", "xcomp", "V2"), ("V2", "dobj", "O2"), ("V2", "iobj", "O3")), ("S1", "V1", "V2", "O1", "O2", "O3"),
        {"V1": VERB, "V2": VERB, "S1": NOUN, "O1": NOUN, "O2": NOUN, "O3": NOUN}, {"V1": BESIDES, "V2": (*BESIDES, "nsubj:xsubj")},
    ),
}
# Patterns that the tag of the predicate splits: label, its end (0 governor, 2 dependent), tag to pattern.
SPLITS = {
    "s-v-v": ("xcomp", 2, {"VB": "s-v-v", "JJ": "s-v-a"}),
    "s-v-be-a": ("xcomp", 2, {"JJ": "s-v-be-a", "NN": "s-v-be-o"}),
    "s-be-a": ("cop", 0, {"JJ": "s-be-a", "NN": "s-be-o"}),
    "s-v-o-be-a": ("xcomp", 2, {"JJ": "s-v-o-be-a", "NN": "s-v-o-be-o"}),
}
