"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every document has a place on a ring of 64-bit positions, by the hash of its id, and belongs to the next virtual node
clockwise. No shard takes more than ``ceil((1 + slack) * documents / shards)``; what overflows goes on clockwise to the
next virtual node whose shard has room. Only counts per virtual node (as many as the ring has, whatever the corpus)
reach the driver; which documents overflow follows from their rank on the ring, a running sum over the distinct ids of each
virtual node with how often each occurs. So an id that a third of all rows have (or a null one) is one row there; its rows
are made again from its count, ``CHUNK`` of them in a task.

Defined results: a null doc_id hashes to one fixed place and is bounded like all others; rows that repeat an id are
keys of their own at the same place, of which those that tie may change places; texts of any length aren't read; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the virtual nodes in order, and the shard of each."""
    if shards < 1 or vnodes < 1:
        raise ValueError("shards and vnodes must be positive")
    at = np.array([xxhash.xxh64_intdigest(f"shard-{s}/{v}") for s in range(shards) for v in range(vnodes)], np.uint64).view(np.int64)
    order = np.argsort(at, kind="stable")
    return at[order], np.repeat(np.arange(shards), vnodes)[order]


def place(counts: np.ndarray, owner: np.ndarray, shards: int, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Fills the shards: (segment, first rank, last rank, shard, hops) for each run of keys.

    Virtual nodes first take their own keys, in the ring's order; then what is left over of each goes one node
    clockwise, again and again, until all have a place.
    """
    room = np.full(shards, capacity, np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    waiting = [(int(s), 0, int(n)) for s, n in enumerate(counts) if n]  # segment, keys placed, keys left
    hops = 0
    while waiting:
        left = []
        for s, done, n in waiting:
            shard = int(owner[(s + hops) % len(owner)])
            take = int(min(n, room[shard]))
            if take:
                room[shard] -= take
                out.append((s, done + 1, done + take, shard, hops))
            if n > take:
                left.append((s, done + take, n - take))
        waiting, hops = left, hops + 1
    return out


CHUNK = 1 << 20

SEG = pa.schema([("doc_id", pa.int64()), ("position", pa.int64()), ("segment", pa.int32())])


def assign(docs: DataFrame, shards: int = 64, vnodes: int = 128, slack: float = 0.05, id_col: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, position, segment, shard, hops): the shard of every document and how many virtual nodes it was passed on."""
    spark = docs.sparkSession
    at, owner = ring(shards, vnodes)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            position = b.column(1).to_numpy(zero_copy_only=False)
            segment = np.searchsorted(at, position, side="left") % len(at)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(segment.astype(np.int32))], schema=SEG)

    keys = docs.select(F.col(id_col).cast("long").alias("doc_id")).withColumn("position", F.xxhash64("doc_id"))
    located = keys.mapInArrow(locate, "doc_id long, position long, segment int")
    counts = np.zeros(len(at), np.int64)
    for r in located.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["segment"]] = r["n"]
    capacity = int(np.ceil((1 + slack) * counts.sum() / shards))
    runs = spark.createDataFrame(
        place(counts, owner, shards, capacity),
        T.StructType([T.StructField(n, T.IntegerType() if n in ("s", "shard", "hops") else T.LongType()) for n in ("s", "low", "high", "shard", "hops")]),
    )
    keys = located.groupBy("segment", "position", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("segment").orderBy("position", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = keys.withColumn("last", F.sum("n").over(before)).withColumn("first", F.col("last") - F.col("n") + 1)
    placed = ranked.join(F.broadcast(runs), (F.col("segment") == F.col("s")) & (F.col("first") <= F.col("high")) & (F.col("last") >= F.col("low")))
    placed = placed.withColumn("times", F.least("last", "high") - F.greatest("first", "low") + 1)
    out = ("doc_id", "position", "segment", "shard", "hops")
    few = placed.where(F.col("times") <= chunk).select(*out, "times")
    many = placed.where(F.col("times") > chunk).select(*out, "times", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {chunk}"))).alias("k"))
    many = many.repartition("doc_id", "shard", "k").select(*out, F.least(F.lit(chunk), F.col("times") - F.col("k") * chunk).alias("times"))
    return few.unionByName(many).select(*out, F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("__copy")).select(*out)
