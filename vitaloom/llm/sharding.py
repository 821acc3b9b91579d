"""Placement of rows on shards through a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: ``(offset + j * skip) mod size``, both from
its name's hash. The shards take turns, each claiming the first slot of its order that is still free, until the table
is full. A row goes to the shard that owns the slot of its key's hash. When a shard leaves, its slots are shared out
and hardly any other slot changes hands.

The table's size is a parameter bounded by ``MAX_SLOTS`` and does not depend on the data, which is what makes its
broadcast safe. Placing a row is one hash and one look-up in the JVM: no shuffle, and no key can be hot.
"""

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaloom.llm.common import without

SLOTS = 8191
MAX_SLOTS = 1_000_003
# Hexadecimal digits of the MD5 that make a hash: 60 bits, so it is a positive long everywhere.
HASH_DIGITS = 15


def text_hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:HASH_DIGITS], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[str]:
    """Owner of every slot. ``slots`` is prime, at least the number of shards and at most ``MAX_SLOTS``.

    A prime size makes every skip visit all slots. Names must be distinct; their order decides who claims first.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and there must be one")
    if not is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"the number of slots must be prime, from the number of shards up to {MAX_SLOTS}")
    nxt = [text_hash(f"offset:{s}") % slots for s in shards]
    skip = [text_hash(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    owner: list[str | None] = [None] * slots
    claimed = 0
    while True:
        for i, name in enumerate(shards):
            while owner[nxt[i]] is not None:
                nxt[i] = (nxt[i] + skip[i]) % slots
            owner[nxt[i]] = name
            claimed += 1
            if claimed == slots:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key; null keys share the slot of the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS, *, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """Add ``slot`` and ``shard`` to every row of ``df``.

    Rows are neither dropped nor merged: repeated rows and equal keys get the same shard. Null keys go where the empty
    text goes. Columns of ``df`` that have the names of the new ones are replaced. An empty table stays empty.
    """
    table = df.sparkSession.createDataFrame(list(enumerate(lookup_table(shards, slots))), f"`{slot}` int, `{shard}` string")
    placed = df.withColumn(slot, slot_of(F.col(f"`{key}`"), slots))
    kept = without(placed, shard) if shard.lower() != key.lower() else placed
    return kept.join(F.broadcast(table), slot)
