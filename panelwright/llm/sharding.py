"""Placing rows on shards by a permutation-filled lookup table."""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The table is broadcast; this bounds it to about 20 MB.
MAX_SLOTS = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int) -> list[int]:
    """The shard (its position in ``shards``) of every slot.

    A shard's preference order is ``offset + j * skip`` modulo the prime number of slots. In turns,
    each shard claims its next preferred slot that is free, so shares differ by one slot at most and
    few slots change hands when a shard comes or goes.
    """
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be some distinct names, no more than slots")
    if not _is_prime(slots) or slots > MAX_SLOTS:
        raise ValueError(f"slots must be a prime up to {MAX_SLOTS}")
    at = [xxhash.xxh64_intdigest(s, seed=1) % slots for s in shards]
    skip = [xxhash.xxh64_intdigest(s, seed=2) % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def place(df: DataFrame, shards: list[str], slots: int = 65537, key: str = "doc_id") -> DataFrame:
    """Add ``slot`` and ``shard`` to every row: one hash and one lookup in a broadcast table, no shuffle.

    Rows with equal keys (as text) share a shard, as do all rows with a null key. Repeated rows are
    kept, an empty table stays empty; columns named ``slot`` or ``shard``, in any case, are replaced (one that is the key is used first).
    """
    spark = df.sparkSession
    filled = ",".join(map(str, fill_table(shards, slots)))
    names = F.split(F.lit("\x1f".join(shards)), "\x1f")
    table = spark.range(1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("slot", "i")).select(
        "slot", F.element_at(names, F.col("i").cast("int") + 1).alias("shard")
    )
    others = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    placed = df.select(*others, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(slots)).cast("int").alias("slot"))
    return placed.join(F.broadcast(table), "slot").select(*others, "slot", "shard")


def write_sharded(placed: DataFrame, path: str) -> None:
    """One folder a shard; a shard's rows are written by the tasks that hold them, without a shuffle."""
    placed.write.partitionBy("shard").parquet(path)
