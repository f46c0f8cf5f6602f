"""Permutation importance with repeats, and the vote for features that matter in several folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import scalar as sc
from ..operators import ordered as od, sinks as sk

c, lit = F.col, F.lit
PRIME = 2147483647  # products of two residues stay within 64 bits
ROUNDS = 16
BLOCK = 1 << 14  # ranks that meet their permuted values in one group
HELD = 1 << 20  # values that a task packs together
NULL = 0x7FF800004E554C4C  # the bits that stand for a null value: a NaN that no sum makes


def _mix(x: Column) -> Column:
    """A residue scattered by two squarings."""
    for a, b in ((48271, 11), (69621, 7)):
        x = (x * lit(a) + lit(b)) % lit(PRIME)
        x = x * x % lit(PRIME)
    return x


def round_keys(draw: Column) -> Column:
    """The keys of one permutation: per round the sum of its pairs, and factor and offset of the bit."""
    x = lambda k: draw * lit(ROUNDS) + k
    one = lambda k: F.struct(_mix(x(k)).alias("pair"), _mix(x(k) + lit(1000003)).alias("factor"), _mix(x(k) + lit(2000003)).alias("offset"))
    return F.transform(F.sequence(lit(1).cast("long"), lit(ROUNDS).cast("long")), one)


def shuffled(i: Column, n: Column, keys: Column) -> Column:
    """Where a keyed permutation of 0..n-1 puts i. A round pairs i with (pair - i) mod n and swaps the two or not, by a bit
    drawn for the larger: each round is its own inverse, so any n has a permutation and nothing is sorted."""
    def round_(at: Column, k: Column) -> Column:
        mate = F.pmod(k["pair"] - at, n)
        return F.when((F.greatest(at, mate) % lit(PRIME) * k["factor"] + k["offset"]) % lit(PRIME) % 2 == 1, mate).otherwise(at)
    return F.aggregate(keys, i.cast("long"), round_)


def _draw_keys(draw: int) -> list[tuple[int, int, int]]:
    """`round_keys` of one permutation as plain numbers."""
    def mix(x: int) -> int:
        for a, b in ((48271, 11), (69621, 7)):
            x = (x * a + b) % PRIME
            x = x * x % PRIME
        return x
    return [tuple(mix(draw * ROUNDS + k + add) for add in (0, 1000003, 2000003)) for k in range(1, ROUNDS + 1)]


def _sent(features: Sequence[str], keys: Sequence[str], repeats: int):
    """Every row once per feature and repeat, with the feature's value and the rank that `shuffled` gives it: whole batches round by
    round, as the column form costs a few microseconds a row and permutation."""
    draws = [(d, _draw_keys(d), features[d // repeats]) for d in range(len(features) * repeats)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, n = batch.column("_rk").to_numpy().astype(np.int64) - 1, batch.column("_n").to_numpy().astype(np.int64)
            if not len(n):
                continue
            large = n.max() > PRIME
            n = n[0] if n.min() == n.max() else n
            for draw, rounds, feature in draws:
                at = start
                for pair, factor, offset in rounds:
                    mate = pair % n - at
                    mate = np.where(mate < 0, mate + n, mate)
                    x = np.maximum(at, mate)
                    at = np.where(_odd((x % PRIME if large else x) * factor + offset), mate, at)
                cols = [*[batch.column(k) for k in keys], pa.array(np.full(len(at), draw, dtype=np.int64)), batch.column(feature), pa.array(at + 1)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "_draw", "_v", "_rk"])
    return run


def _odd(x: np.ndarray) -> np.ndarray:
    """Whether the residue of numbers below 2^62 + 2^31 is odd, without a division: 2^31 leaves 1."""
    for _ in range(2):
        x = (x & PRIME) + (x >> 31)
    return ((x & 1) == 1) ^ (x >= PRIME)  # one PRIME may be left, an odd number


def _packed(features: Sequence[str], keys: Sequence[str], repeats: int):
    """What `_sent` yields, by key and block of ranks: one row per block with the ranks' places, the draws and the values as bytes."""
    sent = _sent(features, keys, repeats)

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        rank = t["_rk"].to_numpy() - 1
        block = rank // BLOCK
        segment = t.select(keys).to_pandas().groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy() * (block.max() + 1) + block if keys else block
        order = np.argsort(segment.astype(np.uint16) if segment.max() < 1 << 16 else segment, kind="stable")
        segment = segment[order]
        start = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        bits = t["_v"].to_numpy().view(np.int64)
        bits = np.where(t["_v"].is_null().to_numpy(), NULL, bits) if t["_v"].null_count else bits
        cut = np.append(start, len(order))

        def as_bytes(x: np.ndarray) -> pa.Array:
            ends = (cut * x.itemsize).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x[order]))])
        first = pa.array(order[start])
        cols = [*[t[k].take(first).combine_chunks() for k in keys], pa.array(block[order[start]].astype(np.int64))]
        cols += [as_bytes(x) for x in ((rank % BLOCK).astype(np.uint16), t["_draw"].to_numpy().astype(np.int32), bits)]
        return pa.RecordBatch.from_arrays(cols, names=[*keys, "_block", "_at", "_draws", "_values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in sent(batches):
            held.append(b)
            count += b.num_rows
            if count >= HELD:
                yield pack(held)
                held, count = [], 0
        if held:
            yield pack(held)
    return run


def _unpacked(features: Sequence[str], repeats: int):
    """The rows of one block once as they are (draw -1) and once per draw, with the values that were sent to their ranks."""
    draws = len(features) * repeats

    def run(rows: pa.Table, sent: pa.Table) -> pa.Table:
        whole = lambda name, kind: np.frombuffer(b"".join(sent[name].to_pylist()), dtype=kind)
        n, at, draw, bits = rows.num_rows, whole("_at", np.uint16), whole("_draws", np.int32), whole("_values", np.int64)
        if len(bits) != draws * n:
            raise RuntimeError(f"{len(bits)} permuted values for {n} rows and {draws} draws")
        row = np.empty(BLOCK, dtype=np.int64)
        row[(rows["_rk"].to_numpy() - 1) % BLOCK] = np.arange(n)
        got = np.empty((draws, n), dtype=np.int64)
        got[draw, row[at]] = bits
        rows = rows.drop_columns(["_rk", "_n", "_block"]).combine_chunks()
        out = []
        for d in range(-1, draws):
            t = rows
            if d >= 0:
                k, null = t.schema.get_field_index(features[d // repeats]), got[d] == NULL
                t = t.set_column(k, t.schema.field(k), pa.array(got[d].view(np.float64), mask=null if null.any() else None, from_pandas=False))
            out.append(t.append_column("_draw", pa.array(np.full(n, d, dtype=np.int64))))
        return pa.concat_tables(out)
    return run


def _by_score(rows: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """AUC and log loss per key from the counts of each distinct score."""
    y = c(label).cast("long")
    g = sk.materialized(rows.groupBy(*keys, "_s").agg(F.sum(y).alias("_p"), F.sum(1 - y).alias("_m")), "scores")
    curve = od.running(g.withColumn("_desc", -c("_s")), keys, "_desc", {"tp": c("_p")})
    area = F.sum(c("_m") * (c("tp") + c("tp") - c("_p"))) / lit(2.0)
    both = F.sum("_p") * F.sum("_m").cast("double")
    loss = F.sum(c("_p") * sc.log_loss_term(lit(1), c("_s")) + c("_m") * sc.log_loss_term(lit(0), c("_s")))
    return curve.groupBy(*keys).agg(F.when(both == 0, lit(0.5)).otherwise(F.try_divide(area, both)).alias("auc"), (loss / F.sum(c("_p") + c("_m"))).alias("loss"))


def permutation_importance(df: DataFrame, features: Sequence[str], label: str, score: Callable[[DataFrame], DataFrame], order: str, tie: str,
                           keys: Sequence[str] = (), repeats: int = 5) -> DataFrame:
    """Loss of AUC and gain of log loss when one feature is permuted among the rows of its key, over `repeats` permutations.

    `score` adds the column `_s` (a probability) to a frame. All features and repeats are one plan: rows are ranked once
    by (`order`, `tie`), every row sends each feature to its permuted rank, packed by blocks of ranks, and each block is
    scored once per draw. Features are doubles or become such; `std` is the deviation over the repeats.
    """
    keys = list(keys)
    plain = df.withColumns({f: c(f).cast("double") for f in features})
    r = sk.materialized(od.ranked(plain, keys, order, [tie], "_rk", total="_n"), "ranked")
    which = F.floor(c("_draw") / lit(repeats)).cast("int")
    block = F.floor((c("_rk") - 1) / lit(BLOCK)).alias("_block")
    here = r.select("*", block)
    fields = here.select(*keys, "_block").schema.fields + [T.StructField(x, T.BinaryType()) for x in ("_at", "_draws", "_values")]
    sent = r.select(*keys, "_rk", "_n", *features).mapInArrow(_packed(list(features), keys, repeats), T.StructType(fields))
    schema = T.StructType([*plain.schema.fields, T.StructField("_draw", T.LongType())])
    by = [*keys, "_block"]
    every = here.select(*plain.columns, "_rk", "_n", "_block").groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(_unpacked(list(features), repeats), schema)
    s = sk.materialized(_by_score(score(every).select(*keys, "_draw", label, "_s"), [*keys, "_draw"], label), "importance")
    name = F.get(F.array(*[lit(f) for f in features]), which)
    g = s.where("_draw >= 0").groupBy(*keys, name.alias("feature")).agg(
        *[f(x).alias(f"{x}_{n}") for x in ("auc", "loss") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    base = s.where("_draw < 0").select(*keys, c("auc").alias("baseline"), c("loss").alias("baseline_loss"))
    g = g.join(base, keys) if keys else g.crossJoin(F.broadcast(base))  # one row
    return g.select(*keys, "feature", "baseline", c("auc_mean").alias("permuted"), (c("baseline") - c("auc_mean")).alias("importance"), c("auc_std").alias("std"),
                    "baseline_loss", c("loss_mean").alias("permuted_loss"), (c("loss_mean") - c("baseline_loss")).alias("importance_loss"), c("loss_std").alias("std_loss"))


def stable_features(df: DataFrame, features: Sequence[str], label: str, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], day: str, tie: str,
                    folds: int = 3, min_folds: int = 2, min_importance: float = 0.001, share: float = 0.8, repeats: int = 5) -> DataFrame:
    """Features whose importance exceeds `min_importance` in at least `min_folds` of the expanding folds of the first `share` of the rows.

    `fit(train)` returns a function that adds `_s`. A fold needs 10 positives to train and 5 to test. Permutations run
    inside the test part of each fold.
    """
    early = od.ranked(df, [], day, [tie], "_early", total="_all").where(c("_early") <= F.floor(c("_all") * lit(share)))
    early = sk.materialized(early.drop("_early", "_all"), "early")
    lo, hi = early.agg(F.min(day), F.max(day)).first()
    if lo is None:
        raise ValueError("no rows")
    width = (hi - lo) / (folds + 1)
    out = None
    for k in range(folds):
        edge = lo + width * (k + 1)
        train, test = early.where(c(day) < edge), early.where((c(day) >= edge) & (c(day) < edge + width))
        if (train.agg(F.sum(label)).first()[0] or 0) < 10 or (test.agg(F.sum(label)).first()[0] or 0) < 5:
            continue
        got = permutation_importance(test, features, label, fit(train), day, tie, repeats=repeats).withColumn("fold", lit(k))
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("no fold has enough positives")
    votes = F.count_if(c("importance") > min_importance)
    return out.groupBy("feature").agg(F.count(lit(1)).alias("folds"), votes.alias("votes"), F.avg("importance").alias("mean_importance"), (votes >= min_folds).alias("stable"))
