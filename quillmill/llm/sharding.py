"""Sharding by a permutation-filled lookup table (Maglev's way) with broadcast placement.

Each shard has its own permutation of the table's prime number of slots. Shards take turns claiming
their next preferred free slot until the table is full, so loads differ by at most one turn and
losing a shard moves few keys between the others. A row's slot is a hash of its key; the
table, of fixed size, is broadcast, so placement costs one lookup and no shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import whole_row

TABLE_SIZE = 65537
#: Tables beyond this many slots are refused: the table is broadcast.
MOST_SLOTS = 1 << 20
SHARDS = tuple((f"shard-{i:03d}", 1) for i in range(64))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: tuple[tuple[str, int], ...] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """Shard number of every slot. ``shards``: (name, turns a round)."""
    if not _is_prime(size) or size > MOST_SLOTS:
        raise ValueError("the table size must be a prime of at most MOST_SLOTS")
    if not shards or any(turns < 1 for _, turns in shards) or len({n for n, _ in shards}) < len(shards):
        raise ValueError("shards need distinct names and at least one turn each")
    table = [-1] * size
    place, stride = [], []
    for name, _ in shards:
        digest = hashlib.md5(name.encode()).digest()
        place.append(int.from_bytes(digest[:8], "big") % size)
        stride.append(int.from_bytes(digest[8:], "big") % (size - 1) + 1)
    free = size
    while free:
        for i, (_, turns) in enumerate(shards):
            for _ in range(min(turns, free)):
                while table[place[i]] >= 0:
                    place[i] = (place[i] + stride[i]) % size
                table[place[i]] = i
                free -= 1
    return table


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 52 bits of its MD5 modulo the table size; null counts as empty."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % size).cast("int")


def place_documents(docs: DataFrame, shards: tuple[tuple[str, int], ...] = SHARDS, size: int = TABLE_SIZE, key: str = "doc_id") -> DataFrame:
    """``doc_id, slot, shard, shard_name`` for each row, repeated ones included.

    Equal keys share a shard; null and empty keys share one as well. Texts and other columns are not looked at, so
    null, empty or very long ones change nothing. An empty table gives no rows.
    """
    spark = docs.sparkSession
    table = lookup_table(shards, size)
    slots = spark.createDataFrame([(s, i, shards[i][0]) for s, i in enumerate(table)], "slot int, shard int, shard_name string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), slot(F.col(key), size).alias("slot"))
    return rows.join(F.broadcast(slots), "slot").select("doc_id", "slot", "shard", "shard_name")


def write_shards(docs: DataFrame, path: str, shards: tuple[tuple[str, int], ...] = SHARDS, size: int = TABLE_SIZE, files_per_shard: int = 4) -> str:
    """Write the rows under one folder a shard, in ``files_per_shard`` tasks each; returns the name of the folders' column.

    That is ``shard``, with underscores after it if the table has such a column. Repeated rows and rows with a null id
    share a shard, and a hash of the whole row deals a shard's rows over its tasks. An empty table writes no rows.
    """
    name = "shard"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    table = lookup_table(shards, size)
    slots = docs.sparkSession.createDataFrame(list(enumerate(table)), "slot int, number int")
    placed = docs.select(slot(F.col("doc_id"), size).alias("slot"), whole_row(docs).alias("row")).join(F.broadcast(slots), "slot")
    task = F.col("number") * files_per_shard + F.pmod(F.xxhash64("row"), F.lit(files_per_shard)).cast("int")
    dealt = placed.repartitionById(len(shards) * files_per_shard, task)
    dealt.select("row.*", F.col("number").alias(name)).write.partitionBy(name).parquet(path)
    return name


def sharding_sql(shards: tuple[tuple[str, int], ...] = SHARDS, size: int = TABLE_SIZE) -> str:
    table = ",".join(map(str, lookup_table(shards, size)))
    names = ",".join(n for n, _ in shards)
    return f"""
WITH t AS (SELECT unnest(string_split('{table}', ','))::INTEGER AS shard, unnest(range({size}))::INTEGER AS slot),
n AS (SELECT unnest(string_split('{names}', ',')) AS shard_name, unnest(range({len(shards)}))::INTEGER AS shard),
d AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT % {size})::INTEGER AS slot FROM documents)
SELECT d.doc_id, d.slot, t.shard, n.shard_name FROM d JOIN t USING (slot) JOIN n USING (shard)
"""
