"""Near-duplicate vectors by NN-descent.

Equal vectors are one node. Random hyperplanes deal the nodes into leaves, several times over; the nearest of a leaf are the first
neighbour lists. Each round joins the neighbours (and reverse neighbours) of every node with each other and keeps the best; a
list whose members all reach the threshold is saturated and grows. Rounds end when hardly a link is new; an audit compares a fixed
sample with all vectors, and more leaves and rounds follow while it misses links (a warning tells if the last one still does). Links of
the lists give components, with links that connect each leaf, since a list full of nearer members holds none to another group; inside a
component all members are then compared in blocks, so that link counts are whole however large a group of copies is.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.sinks import materialized
from .common import prepare, table
from .graph import components

NAME = "op4_embedding_dedup"
ORACLE = None
c, lit = F.col, F.lit
THRESHOLD, SEED = 0.95, 11
NEIGHBOURS, MOST, LEAF, TREES, ROUNDS = 10, 40, 256, 6, 4
#: Vectors of the audit, and the recall it asks for before the search ends; rows of one block of the final comparison.
AUDIT, RECALL, AUDITS, BLOCK = 1024, 0.99, 3, 1024
_LIST = "a long, b long, sim double, fresh boolean"


def _matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packer(kind: str):
    def run(x: pa.Array) -> pa.Array:
        return pa.array([np.asarray(v, kind).tobytes() for v in x.to_pylist()], pa.binary())
    return F.arrow_udf(run, "binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int, most: int | None = None) -> Iterator[list[tuple]]:
    """Runs of rows with equal first `keys` columns, cut into runs of at most `most` rows."""
    now, held = None, []
    for b in batches:
        for row in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if row[:keys] != now or (most and len(held) >= most):
                if held:
                    yield held
                now, held = row[:keys], []
            held.append(row)
    if held:
        yield held


def _batches(rows: Iterator[tuple[np.ndarray, ...]], names: list[str], size: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += len(r[0])
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=names)


def _leaves(kind: str, depth: int, trees: range):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(dim, v, vec) -> (dim, tree, code, v, vec), once per tree."""
        for b in batches:
            dims = b.column(0).to_numpy()
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                x = _matrix(own.column(2), int(dim), kind)
                for t in trees:
                    planes = np.random.Generator(np.random.PCG64([SEED, t, int(dim)])).standard_normal((int(dim), depth))
                    code = ((x @ planes > 0) @ (1 << np.arange(depth, dtype=np.int64))).astype(np.int64)
                    n = len(x)
                    yield pa.RecordBatch.from_arrays([own.column(0), pa.array(np.full(n, t, np.int32)), pa.array(code), own.column(1), own.column(2)], names=["dim", "tree", "code", "v", "vec"])
    return run


def _best(own: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k largest of each row of `sim`, and all (to MOST) that reach the threshold."""
    n = len(own)
    np.fill_diagonal(sim, -2)
    take = min(n - 1, MOST)
    order = np.argpartition(-sim, take - 1, axis=1)[:, :take] if take < n - 1 else np.argsort(-sim, axis=1)[:, :take]
    s = np.take_along_axis(sim, order, 1)
    rank = np.argsort(np.argsort(-s, axis=1), axis=1)
    ok = (rank < k) | (s >= THRESHOLD)
    i, j = np.nonzero(ok)
    return own[i], own[order[i, j]], s[i, j], np.ones(len(i), bool)


def _inside(kind: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for rows in _groups(batches, 3, 2 * LEAF):
                if len(rows) > 1:
                    x = _unit(np.frombuffer(b"".join(r[4] for r in rows), kind).reshape(len(rows), -1).astype(np.float64))
                    yield _best(np.array([r[3] for r in rows]), x @ x.T, k)
        yield from _batches(found(), ["a", "b", "sim", "fresh"])
    return run


def _connect(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of a leaf that connect all that its pairs at the threshold connect; full lists do not hold them back."""
        def found():
            for rows in _groups(batches, 3, 2 * LEAF):
                v = np.array([r[3] for r in rows])
                x = _unit(np.frombuffer(b"".join(r[4] for r in rows), kind).reshape(len(rows), -1).astype(np.float64))
                near, open_ = x @ x.T >= THRESHOLD, np.ones(len(v), bool)
                for s in range(len(v)):
                    waiting = [s] if open_[s] else []
                    open_[s] = False
                    while waiting:
                        p = waiting.pop()
                        more = np.flatnonzero(near[p] & open_)
                        if len(more):
                            open_[more] = False
                            waiting.extend(more.tolist())
                            yield np.full(len(more), v[p]), v[more]
        yield from _batches(found(), ["a", "b"])
    return run


def _trim(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by (a, sim descending, b, old first): the first k different b of each a, more while they reach the threshold."""
        out: list[tuple] = []
        now, seen, n = None, set(), 0
        for b in batches:
            for row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if row[0] != now:
                    now, seen, n = row[0], set(), 0
                if row[1] not in seen and (n < k or (n < MOST and row[2] >= THRESHOLD)):
                    seen.add(row[1])
                    n += 1
                    out.append(row)
            if len(out) > 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["a", "b", "sim", "fresh"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["a", "b", "sim", "fresh"])
    return run


def _trimmed(lists: DataFrame, k: int) -> DataFrame:
    return lists.repartition("a").sortWithinPartitions("a", F.desc("sim"), "b", "fresh").mapInArrow(_trim(k), _LIST)


def _meet(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(p, m, fresh, kth, vec): members of p's lists against each other; pairs that better a list and are new."""
        def found():
            for rows in _groups(batches, 1):
                one = {r[1]: r for r in rows} if len(rows) > 1 else {}
                fresh = {r[1] for r in rows if r[2]}
                if len(one) < 2 or not fresh:
                    continue
                m = np.array(list(one))
                x = _unit(np.frombuffer(b"".join(r[4] for r in one.values()), kind).reshape(len(m), -1).astype(np.float64))
                s = x @ x.T
                new = np.array([v in fresh for v in one])
                better = (s > np.array([r[3] for r in one.values()])[:, None]) & (new[:, None] | new[None, :]) & ~np.eye(len(m), dtype=bool)
                i, j = np.nonzero(better)
                if len(i):
                    yield m[i], m[j], s[i, j], np.ones(len(i), bool)
        yield from _batches(found(), ["a", "b", "sim", "fresh"])
    return run


def descend(nodes: DataFrame, lists: DataFrame, kind: str, k: int, rounds: int) -> DataFrame:
    """Rounds of neighbours-of-neighbours joins; the lists of the last one."""
    for _ in range(rounds):
        reverse = _trimmed(lists.select(c("b").alias("a"), c("a").alias("b"), "sim", "fresh"), k)
        meet = lists.unionByName(reverse).select(c("a").alias("p"), c("b").alias("m"), "fresh")
        kth = lists.groupBy(c("a").alias("v")).agg(F.min("sim").alias("kth"), F.count(lit(1)).alias("n")).select("v", F.when(c("n") < k, -2.0).otherwise(c("kth")).alias("kth"))
        full = nodes.select("v", "vec").join(kth, "v", "left").select(c("v").alias("m"), F.coalesce("kth", lit(-2.0)).alias("kth"), "vec")
        meet = meet.join(full, "m").select("p", "m", "fresh", "kth", "vec").repartition("p").sortWithinPartitions("p")
        better = meet.mapInArrow(_meet(kind), _LIST)
        lists = materialized(_trimmed(lists.withColumn("fresh", lit(False)).unionByName(better), k), "neighbours")
        near = c("sim") >= THRESHOLD
        changed, total = lists.agg(F.count_if(near & c("fresh")), F.count_if(near)).first()
        if changed <= 0.01 * total:
            break
    return lists


def _count(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(component, i, j, left, v, weight, vec): links between block i (left) and block j of a component, as sums per node."""
        def found():
            for rows in _groups(batches, 3):
                parts = [[r for r in rows if r[3] is side] for side in (True, False)]
                if not parts[0] or not parts[1]:
                    continue
                (x, v, w), (y, u, z) = ((_unit(np.frombuffer(b"".join(r[6] for r in p), kind).reshape(len(p), -1).astype(np.float64)),
                                         np.array([r[4] for r in p]), np.array([r[5] for r in p])) for p in parts)
                near = (x @ y.T >= THRESHOLD) & (v[:, None] != u[None, :])
                yield v, near @ z
                if rows[0][1] != rows[0][2]:
                    yield u, w @ near
        yield from _batches(found(), ["v", "n"])
    return run


def _sees(sample: dict, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for b in batches:
                dims = b.column(0).to_numpy()
                for dim in set(dims.tolist()) & set(sample):
                    own = b.filter(pa.array(dims == dim))
                    ids, x = sample[dim]
                    v = own.column(1).to_numpy()
                    i, j = np.nonzero((_unit(_matrix(own.column(2), dim, kind)) @ x.T >= THRESHOLD) & (v[:, None] != ids[None, :]))
                    if len(i):
                        yield ids[j], v[i]
        yield from _batches(found(), ["a", "b"])
    return run


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = NEIGHBOURS) -> DataFrame:
    """One row per input row: vec_id, `_emb_links` (other rows linked directly), `_emb_component` (smallest vec_id in reach).

    A null or empty vector, a zero vector and one with a null or non-finite component has no links and its own vec_id as component.
    Vectors of different length never link. Equal vectors link with each other and are searched once. Repeated rows and equal
    ids stay separate rows; a null vec_id is the smallest only where there is no other. No vectors: no rows. Links are found
    approximately (audited to RECALL on AUDIT nodes); each reported one is exact.
    """
    spark = prepare(vectors.sparkSession)
    kind = "<f8" if "double" in dict(vectors.dtypes)[embedding] else "<f4"
    x = c(embedding)
    good = (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0)
    rows = vectors.select(c(vec_id).alias("vec_id"), F.when(F.coalesce(good, lit(False)), x).alias("x"))
    nodes = rows.where(c("x").isNotNull()).groupBy("x").agg(F.min("vec_id").alias("least"), F.count(lit(1)).alias("weight"))
    # sorted ids: a node keeps its number whatever the partitions
    nodes = nodes.select(F.xxhash64(F.transform("x", lambda e: e.cast("double")), lit(SEED)).alias("h"), "x", "least", "weight")
    nodes = materialized(nodes.select(F.monotonically_increasing_id().alias("v"), F.size("x").alias("dim"), "h", "x", _packer(kind)(c("x")).alias("vec"), "least", "weight"), "vectors")
    n = nodes.count()
    depth = max(1, math.ceil(math.log2(max(2, n / LEAF))))
    sample: dict = {}
    for r in nodes.orderBy("h", "v").select("dim", "v", "vec").limit(AUDIT).collect():
        sample.setdefault(r["dim"], []).append((r["v"], bytes(r["vec"])))
    sample = {d: (np.array([v for v, _ in s]), _unit(np.frombuffer(b"".join(b for _, b in s), kind).reshape(len(s), -1).astype(np.float64))) for d, s in sample.items()}
    bare = nodes.select("dim", "v", "vec")
    truth = materialized(bare.mapInArrow(_sees(sample, kind), "a long, b long"), "audit")
    lists = group = held = None
    for audit in range(AUDITS):
        trees = range(audit * TREES, (audit + 1) * TREES)
        leaves = bare.mapInArrow(_leaves(kind, depth, trees), "dim int, tree int, code long, v long, vec binary")
        leaves = leaves.repartitionByRange("dim", "tree", "code", "v").sortWithinPartitions("dim", "tree", "code", "v")
        first = leaves.mapInArrow(_inside(kind, k), _LIST)
        across = leaves.mapInArrow(_connect(kind), "a long, b long").distinct()
        held = materialized(across if held is None else across.unionByName(held), "leaf-links")
        lists = materialized(_trimmed(first if lists is None else first.unionByName(lists), k), "neighbours")
        lists = descend(nodes, lists, kind, k, ROUNDS)
        group = components(lists.where(c("sim") >= THRESHOLD).select("a", "b").unionByName(held))
        of = lambda side: group.select(c("node").alias(side), c("component").alias(f"g_{side}"))
        seen = truth.join(of("a"), "a", "left").join(of("b"), "b", "left").groupBy("a").agg(F.avg(F.coalesce(c("g_a") == c("g_b"), lit(False)).cast("int")).alias("r"))
        recall = seen.agg(F.avg("r")).first()[0]  # mean over vectors, so that one large group does not speak for all
        if recall is None or recall >= RECALL:
            break
    else:
        warnings.warn(f"op4: recall of the last audit is {recall:.4f}, less than {RECALL}", stacklevel=2)
    member = materialized(group.select(c("node").alias("v"), "component").join(nodes.select("v", "vec", "least", "weight"), "v"), "members")
    sizes = member.groupBy("component").agg(F.ceil(F.count(lit(1)) / BLOCK).cast("int").alias("blocks"), F.min("least").alias("smallest"))
    dealt = member.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("v"), c("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(lit(0), c("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    sides = F.when(c("own") == c("other"), F.array(lit(True), lit(False))).otherwise(F.array(c("own") < c("other")))
    dealt = dealt.select("component", low.alias("i"), high.alias("j"), F.explode(sides).alias("left"), "v", "weight", "vec")
    counts = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(_count(kind), "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
    named = member.select("v", "component").join(sizes.select("component", "smallest"), "component").join(counts, "v").select("v", "n", "smallest")
    done = nodes.join(named, "v", "left").select(c("x").alias("_x"), (F.coalesce("n", lit(0)) + c("weight") - 1).alias("n"), F.coalesce("smallest", "least").alias("g"))
    return rows.join(done, rows["x"] == done["_x"], "left").select(
        "vec_id", F.coalesce("n", lit(0)).cast("bigint").alias("_emb_links"), F.when(c("x").isNull(), c("vec_id")).otherwise(c("g")).alias("_emb_component"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", c("_emb_links").alias("n_links"), c("_emb_component").alias("component_id"), (c("vec_id") == c("_emb_component")).alias("kept"))
