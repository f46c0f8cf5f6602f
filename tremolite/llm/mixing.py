"""Mixing sources to target weights: word streams packed into blocks, multinomial shard counts, permuted block indices.

The words of a source lie end to end in a pseudorandom document order and are cut into blocks of fixed length. Each output shard
draws its number of blocks per source from a multinomial over what is left of the targets; slot numbers run through one keyed
permutation of the source's block numbers per pass, so a pass takes every block once and no block is taken more often than
passes begun. Slots and blocks then meet in a join on (source, block number).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.sinks import materialized
from .common import WORD, prepare, table

NAME = "op6_mixing"
ORACLE = None
c, lit = F.col, F.lit
BLOCK, REPEATS, SEED = 64, 3.0, 20
BROADCAST_SOURCES = 20_000
SLOTS_PER_SHARD, MOST_SHARDS, BUCKET = 1 << 16, 4096, 1024


def fill_targets(sizes: Sequence[int], weights: Sequence[float], repeats: float = REPEATS) -> list[float]:
    """Shares of the total by weight; a share stops at `repeats` times its source's size, the excess is shared again by weight."""
    targets, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        whole = sum(weights[i] for i in free)
        share = {i: left * weights[i] / whole for i in free}
        above = [i for i in free if share[i] > repeats * sizes[i]]
        if not above:
            for i in free:
                targets[i] = share[i]
            break
        for i in above:
            targets[i] = repeats * sizes[i]
            left -= targets[i]
        free = [i for i in free if i not in set(above)]
    return targets


def draw_shards(quotas: Sequence[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks per shard and source: multinomial draws over what remains, so that the columns add up to the quotas."""
    left, rng = np.array(quotas, np.int64), np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((shards, len(left)), np.int64)
    for k in range(shards):
        want = int(left.sum()) // (shards - k)
        if k == shards - 1:
            out[k] = left
        while k < shards - 1 and (missing := want - int(out[k].sum())) > 0:
            rest = left - out[k]
            out[k] = np.minimum(left, out[k] + rng.multinomial(missing, rest / rest.sum()))
        left = left - out[k]
    return out


def permute(index: np.ndarray, size: int, key: int, rounds: int = 4) -> np.ndarray:
    """A keyed permutation of 0..size-1: a balanced Feistel network, walked until it is back in range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [np.frombuffer(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "<u8")[0] for r in range(rounds)]

    def once(x):
        a, b = x >> np.uint64(half), x & low
        for k in keys:
            f = (b ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(32)) & low)
        return a << np.uint64(half) | b

    x = once(index.astype(np.uint64))
    while (out := x >= np.uint64(size)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, shard, first, n, blocks, key) -> one row per slot with its block number."""
    for b in batches:
        for r in b.to_pylist():
            for at in range(r["first"], r["first"] + r["n"], 1 << 16):
                slot = np.arange(at, min(at + (1 << 16), r["first"] + r["n"]))
                block, turn = np.zeros(len(slot), np.int64), slot // r["blocks"]
                for t in np.unique(turn):
                    block[turn == t] = permute(slot[turn == t] % r["blocks"], r["blocks"], hash((r["key"], int(t))))
                n = len(slot)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["sid"], np.int32)), pa.array(np.full(n, r["shard"], np.int32)), pa.array(slot), pa.array(block)],
                                                 names=["sid", "shard", "slot", "block"])


class Mix:
    """The plan and its parts: `sized` (a row per document), `pieces` (documents in blocks), `slots` (blocks in shards)."""

    def __init__(self, sized: DataFrame, pieces: DataFrame, slots: DataFrame):
        self.sized, self.pieces, self.slots = sized, pieces, slots

    # slots come out of a small plan, so their estimated size says nothing: the hint keeps them from being broadcast
    def taken(self) -> DataFrame:
        """Columns of `sized` plus `_mix_taken`: the words of each document that the mix holds, repeats counted."""
        held = self.slots.hint("merge").join(self.pieces, ["sid", "block"]).groupBy("_mix_row").agg(F.sum("words").alias("_mix_taken"))
        return self.sized.join(held, "_mix_row", "left").withColumn("_mix_taken", F.coalesce("_mix_taken", lit(0)).cast("bigint"))

    def texts(self, text: str) -> DataFrame:
        """The mix itself: (shard, source slot, block, text); `sized` must have kept the texts."""
        words = F.regexp_extract_all(F.coalesce(c(text), lit("")), lit(WORD), lit(0))
        own = self.pieces.join(self.sized.select("_mix_row", words.alias("all")), "_mix_row")
        cut = own.select("sid", "block", "at", F.array_join(F.slice("all", (c("skip") + 1).cast("int"), c("words").cast("int")), " ").alias("t"))
        block = cut.groupBy("sid", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), " ").alias("text"))
        return self.slots.hint("merge").join(block, ["sid", "block"])


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weight: Callable[[int], float] = lambda i: 1.0 + i % 3,
        block: int = BLOCK, repeats: float = REPEATS, seed: int = SEED, carry: bool = True) -> Mix:
    """Plan a mix whose total is the size of all documents in words.

    Sources are ordered by code point, null last; `weight` maps that number to a weight. One row per source reaches the driver,
    as a mix names its sources; nothing of the documents does. Null and empty texts have size 0 and are never taken. Repeated
    rows and equal ids each have their own place. No documents: no rows. Runs agree: orders and draws are keyed by hashes.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.drop("_mix_sid", "_mix_source_size", "_mix_target", "_mix_taken")  # columns of these names are replaced
    kept = docs.columns if carry else [doc_id]
    size = F.coalesce(F.regexp_count(c(text), lit(WORD)), lit(0)).cast("bigint")
    sized = docs.withColumns({"_mix_size": size, "_mix_source": c(source).cast("string"), "_mix_hash": F.xxhash64(c(doc_id), c(text)), "_mix_row": F.monotonically_increasing_id()})
    sized = materialized(sized.select(*kept, *[x for x in sized.columns if x.startswith("_mix_")]), "sized")
    found = sorted(sized.groupBy("_mix_source").agg(F.sum("_mix_size").alias("size"), F.count(lit(1)).alias("n")).collect(), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r["size"] for r in found]
    targets = fill_targets(sizes, [weight(i) for i in range(len(found))], repeats)
    blocks = [-(-x // block) for x in sizes]
    quotas = [min(round(t * b / x), int(repeats * b)) if x else 0 for t, b, x in zip(targets, blocks, sizes, strict=True)]
    shards = max(1, min(MOST_SHARDS, sum(quotas) // SLOTS_PER_SHARD))
    drawn = draw_shards(quotas, shards, seed)
    first = drawn.cumsum(0) - drawn
    rows = [(i, k, int(first[k, i]), int(drawn[k, i]), blocks[i], seed * 1_000_003 + i) for k in range(shards) for i in range(len(found)) if drawn[k, i]]
    plan = spark.createDataFrame(rows, "sid int, shard int, first long, n long, blocks long, key long")
    slots = plan.repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(_slots, "sid int, shard int, slot long, block long")
    named = spark.createDataFrame([(i, r[0], int(r["size"]), float(t)) for i, (r, t) in enumerate(zip(found, targets, strict=True))],
                                  "_mix_sid int, _name string, _mix_source_size long, _mix_target double")
    # a row per source: counted above, so sent to every task while they are few, which keeps texts out of a shuffle by source
    named = F.broadcast(named) if len(found) <= BROADCAST_SOURCES else named
    sized = sized.join(named, c("_mix_source").eqNullSafe(c("_name"))).drop("_name")
    buckets = max(1, sum(r["n"] for r in found) // BUCKET)
    placed = sized.where("_mix_size > 0").select("_mix_row", c("_mix_sid").alias("sid"), "_mix_size", "_mix_hash", F.pmod("_mix_hash", lit(buckets)).alias("bucket"))
    fill = placed.groupBy("sid", "bucket").agg(F.sum("_mix_size").alias("n"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    fill = fill.select("sid", "bucket", F.coalesce(F.sum("n").over(before), lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("_mix_hash", "_mix_size", "_mix_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum("_mix_size").over(inside), lit(0))).join(fill, ["sid", "bucket"]).withColumn("start", c("start") + c("base"))
    spread = placed.withColumn("block", F.explode(F.sequence(F.floor(c("start") / block), F.floor((c("start") + c("_mix_size") - 1) / block))))
    low, high = F.greatest("start", c("block") * block), F.least(c("start") + c("_mix_size"), (c("block") + 1) * block)
    pieces = spread.select("_mix_row", "sid", "block", low.alias("at"), (low - c("start")).alias("skip"), (high - low).alias("words"))
    return Mix(sized, pieces, slots)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, carry=False).taken().select("doc_id", c("_mix_size").alias("size"), c("_mix_source_size").alias("source_size"),
                                                 c("_mix_target").alias("target"), c("_mix_taken").alias("taken"))
