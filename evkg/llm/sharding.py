"""Sharding by a permutation-filled lookup table, in DataFrame functions only.

Each shard has a preference order of the slots of a prime-sized table (offset and step taken from two
hashes of its name); shards take turns claiming their next free slot until the table is full.  A row
is placed by the slot of its key's hash: one broadcast join with the slot table, whose size is the
prime and never grows with the data.  Shards own equal numbers of slots to within one, and a change of
the shard list moves few keys.

Defined results: a null key goes to the slot of the empty string; repeated keys share a shard; empty
tables stay empty; all columns of the input are kept, whatever their names (the two new names are
parameters; where the input has such a column already, the new one replaces it).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, table, unused

#: Slots: a prime far above a hundred times the number of shards.
SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards, slots: int = SLOTS) -> list[int]:
    """Slot to index of its shard."""
    shards = list(shards)
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, one at least, no more than slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be prime")
    at = [_hash(s, "offset") % slots for s in shards]
    step = [_hash(s, "step") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return owner


def slot(key: Column, slots: int = SLOTS) -> Column:
    """First 15 hex digits of the key's MD5, modulo the table size."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % F.lit(slots)


def assign_shards(df: DataFrame, key_col: str = "doc_id", shards=SHARDS, slots: int = SLOTS, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    owner = lookup_table(shards, slots)
    kept = df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in (slot_name.lower(), shard_name.lower())])
    at, name = unused(df, "_slot", "_shard")
    names = df.sparkSession.createDataFrame([(i, shards[owner[i]]) for i in range(slots)], f"{at} int, {name} string")
    key = kept[f"`{key_col}`"] if key_col.lower() in {c.lower() for c in kept.columns} else df[f"`{key_col}`"]
    placed = kept.join(F.broadcast(names), slot(key, slots).cast("int") == names[at])
    return placed.select(*[kept[f"`{c}`"] for c in kept.columns], names[at].alias(slot_name), names[name].alias(shard_name))


def oracle(shards=SHARDS, slots: int = SLOTS) -> str:
    """DuckDB; the table is filled by its rule."""
    owner = lookup_table(shards, slots)
    return f"""
WITH t AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::UBIGINT % {slots} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(CAST(([{", ".join(map(str, owner))}])[slot + 1] AS VARCHAR), 3, '0') AS shard FROM t
"""


def query(spark, sf_dir: str) -> DataFrame:
    return assign_shards(pick(table(spark, sf_dir, "documents"), doc_id="doc_id"))
