"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has CELLS places. Every shard owns `nodes` virtual nodes on it, at places given by its own number alone; a row's place comes
from its key, and its shard is that of the next node clockwise. A shard takes at most its bound; rows over it continue clockwise
to the next shard with room. With the tight bound (slack 0) shards hold the same number of rows, one apart at most. Adding a shard
moves the rows of the arcs it takes over, and the few that its room lets back.

All rows of one cell walk the same way round, so the walk is done on counts: the driver reads one count per cell (CELLS is fixed, the
number doesn't grow with the rows) and returns, per cell, how many rows in the order of their hashes go to which shard and from which slot
on. Rows are numbered inside their cell, so no task sees more than its cells. Equal keys are counted together before the shuffle,
numbered as one, and dealt out again, so repeated keys don't pile up in one task.
"""
import hashlib

from pyspark.sql import DataFrame, Window, functions as F

from tocsin.llm.shared import keep

CELL_BITS = 14
CELLS = 1 << CELL_BITS
NODES = 128


def owners(shards: int, nodes: int = NODES) -> list[list[int]]:
    """For each cell, the shard of the next node clockwise; nodes in one cell stand in the order of their hashes. Returned as
    the ring's nodes (cell, shard), sorted."""
    ring = []
    for s in range(shards):
        for v in range(nodes):
            h = int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:8], "big")
            ring.append((h, s))
    return [[h >> (64 - CELL_BITS), s] for h, s in sorted(ring)]


def bounds(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """The most rows of each shard: equal shares (the first ones take what is left over), times 1 + slack."""
    if slack > 0:
        return [-int(-(rows * (1 + slack)) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: dict[int, int], shards: int, nodes: int = NODES, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """(cell, lo, hi, shard, first slot): rows lo..hi-1 of a cell go to the shard. First every cell fills its own shard in ring order; then
    what didn't fit continues clockwise."""
    ring, room = owners(shards, nodes), bounds(sum(counts.values()), shards, slack)
    used, out, over, at = [0] * shards, [], [], 0

    def give(cell, lo, n, shard):
        n = min(n, room[shard])
        if n:
            out.append((cell, lo, lo + n, shard, used[shard]))
            used[shard] += n
            room[shard] -= n
        return n

    for cell in sorted(counts):
        while at < len(ring) and ring[at][0] < cell:
            at += 1
        took = give(cell, 0, counts[cell], ring[at % len(ring)][1])
        if took < counts[cell]:
            over.append((cell, took, at))
    for cell, lo, node in over:
        while lo < counts[cell]:
            node += 1
            lo += give(cell, lo, counts[cell] - lo, ring[node % len(ring)][1])
    return out


def shard(df: DataFrame, shards: int, key: list[str], nodes: int = NODES, slack: float = 0.0) -> DataFrame:
    """The key columns of every row with shard and slot (gapless from 0 in each shard); one row for each row of df.

    Keys may be null and may repeat; rows of an equal key are alike and take neighbouring slots. An empty table gives no rows. Other
    columns aren't read, so their names can't clash. The hash of the key, then the key itself, orders the rows of a cell, so reruns agree."""
    spark = df.sparkSession
    rows = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumn("_h", F.xxhash64(*[F.col(f"_k{i}") for i in range(len(key))]))
    rows = rows.withColumn("_cell", F.shiftrightunsigned("_h", 64 - CELL_BITS).cast("int"))
    in_cell = Window.partitionBy("_cell").orderBy(F.col("_h"), *[F.col(f"_k{i}").asc_nulls_first() for i in range(len(key))])
    rows = keep(rows.withColumn("_upto", F.sum("_n").over(in_cell)), "shard-rows")
    counts = {r["_cell"]: r["_m"] for r in rows.groupBy("_cell").agg(F.max("_upto").alias("_m")).toLocalIterator()}
    parts = spark.createDataFrame(walk(counts, shards, nodes, slack), "_c int, _lo long, _hi long, _shard int, _from long")
    # at most a row per cell and shard boundary: bounded by CELLS and shards, so it is broadcast
    lo = F.col("_upto") - F.col("_n")
    met = rows.join(F.broadcast(parts), (F.col("_cell") == F.col("_c")) & (lo < F.col("_hi")) & (F.col("_upto") > F.col("_lo")))
    first, last = F.greatest(lo, F.col("_lo")), F.least(F.col("_upto"), F.col("_hi"))
    slots = met.withColumn("_slot", F.explode(F.sequence(F.col("_from") + first - F.col("_lo"), F.col("_from") + last - F.col("_lo") - 1)))
    return slots.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(key)], F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes, null none, plus 8) and text_crc32 of every row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
