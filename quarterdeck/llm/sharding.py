"""Operator 9: placement of keys on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table (an offset and a step from
its name's hash). Shards take turns, each claiming the first free slot in its order, until the table is
full; so each holds as many slots as any other, give or take one, and adding or removing a shard moves
few other slots. The table's size is a parameter, never the data's, so it is broadcast; a key's shard
is then one lookup of its hash modulo the size.

Defined results: a null key hashes as the empty string; repeated keys get the same shard; no rows give no
rows; columns of the input are kept, and a new one whose name is taken gets an underscore; ties can't occur; a key of any
length or type is hashed as text. A hot key's rows go to one shard by definition, but placed() doesn't move rows, and
written() writes a shard's rows from wherever they are.
"""

import hashlib
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.storage import free_name

SLOTS = 8191
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


@cache
def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> tuple[int, ...]:
    """The shard's number for each slot; slots is a prime, at least as large as the number of shards."""
    if not shards or slots < len(shards) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("a prime number of slots, no fewer than the shards, is needed")
    orders = []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        orders.append((int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1))
    table, turn, filled = [-1] * slots, [0] * len(shards), 0
    while True:
        for k, (offset, step) in enumerate(orders):
            slot = (offset + turn[k] * step) % slots
            while table[slot] >= 0:
                turn[k] += 1
                slot = (offset + turn[k] * step) % slots
            table[slot] = k
            turn[k] += 1
            filled += 1
            if filled == slots:
                return tuple(table)


def placed(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with slot and shard_id after its columns."""
    spark = df.sparkSession
    slot, shard, entry = (free_name(x, df.columns) for x in ("slot", "shard_id", "_entry"))
    table = spark.createDataFrame([(k, x) for k, x in enumerate(lookup_table(shards, slots))], f"{entry} long, {shard} int")
    digest = F.substring(F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")), 1, 15)
    rows = df.select("*", (F.conv(digest, 16, 10).cast("long") % slots).alias(slot))
    return rows.join(F.broadcast(table), F.col(slot) == F.col(entry)).drop(entry)


def written(df: DataFrame, key: str, path: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, files: int = 1) -> None:
    """Writes df as Parquet with a folder for each shard, of about `files` files."""
    rows = placed(df, key, shards, slots)
    slot, shard = rows.columns[-2:]
    # dealt by shard and a number of the row, so that a hot shard is written by several tasks
    dealt = rows.withColumn(free_name("_deal", rows.columns), F.pmod(F.monotonically_increasing_id(), F.lit(files)))
    dealt.repartition(len(shards) * files, shard, dealt.columns[-1]).drop(dealt.columns[-1], slot).write.partitionBy(shard).parquet(path)


def oracle(table: str, key: str) -> str:
    """DuckDB SQL for placed(): the same lookup over the table of shards by slot."""
    entries = ", ".join(map(str, lookup_table()))
    slot = f"CAST('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS}"
    return f"WITH t AS (SELECT [{entries}] AS entry) SELECT {key}, {slot} AS slot, CAST(entry[{slot} + 1] AS INTEGER) AS shard_id FROM {table}, t"
