"""Schemas and fixed values of the knowledge graph."""

from __future__ import annotations

# Senses, in the order of the wide relation table.
SENSES = (
    "Precedence", "Succession", "Synchronous", "Reason", "Result", "Condition", "Contrast", "Concession",
    "Conjunction", "Instantiation", "Restatement", "ChosenAlternative", "Alternative", "Exception", "Co_Occurrence",
)
# Personal pronouns and possessives that a similarity of words ignores.
PRONOUNS = (
    "i", "I", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themself", "themselves",
)
# Entity types of mentions, entity types that become concepts, words that stand for a person.
MENTION_TYPES = ("CITY", "ORGANIZATION", "COUNTRY", "STATE_OR_PROVINCE", "LOCATION", "NATIONALITY", "PERSON")
CONCEPT_TYPES = ("TIME", "DATE", "DURATION", "MONEY", "PERCENT", "NUMBER", "COUNTRY", "STATE_OR_PROVINCE", "CITY", "NATIONALITY", "PERSON", "RELIGION", "URL")
PERSON_WORDS = ("he", "she", "i", "him", "her", "me", "woman", "man", "boy", "girl", "you", "we", "they")
# Words that make a sentence a question or a subordinate clause.
CLAUSE_WORDS = ("when", "who", "what", "where", "how", "why", "which", "When", "Who", "What", "Where", "How", "Why", "Which", "?")
# Connectives of the seed rules.
CONNECTIVES = {
    "Precedence": ("before",), "Succession": ("after",), "Synchronous": ("meanwhile", "at the same time"), "Reason": ("because",),
    "Result": ("so", "thus", "therefore"), "Condition": ("if",), "Contrast": ("but", "however"), "Concession": ("although",),
    "Conjunction": ("and", "also"), "Instantiation": ("for example", "for instance"), "Restatement": ("in other words",),
    "Alternative": ("or", "unless"), "ChosenAlternative": ("instead",), "Exception": ("except",),
}

DEPENDENCY = "struct<gov:int,dep:string,dpt:int>"
SENTENCES = (
    "sid string, doc string, sent_idx int, text string, tokens array<string>, lemmas array<string>, pos_tags array<string>, ners array<string>, "
    f"parse string, dependencies array<{DEPENDENCY}>, mentions array<struct<start:int,end:int,text:string,ner:string,link:string,entity:string>>"
)
NODES = "eid string, frequency double, pattern string, verbs array<string>, skeleton_words array<string>, words array<string>"
EDGES = "rid string, hid string, tid string, sense string, weight double"
TAXONOMY = "concept string, instance string, freq long"
PAIRS = "pid string, cid string, eid string, pattern string, score double"
