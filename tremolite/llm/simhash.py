"""SimHash near-duplicates by the general pigeonhole principle.

The 64 bits are grouped into parts of correlated bits. For a distance of t over m parts any thresholds t_i >= -1 with sum t - m + 1
lose no pair: were part i farther apart than t_i in every part, the whole would differ in more than t bits. Part sizes are even;
thresholds (and m itself) come from dynamic programming over measured key frequencies. Each fingerprint probes, per part, all
keys within t_i bits; fingerprints that meet under one key are compared in full.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.sinks import materialized
from .common import pieces, prepare, raw_texts, table
from .graph import components

NAME = "op2_simhash"
ORACLE = None
c, lit = F.col, F.lit
SEED, SHINGLE, DISTANCE, BITS = 42, 4, 4, 64
#: Cost of comparing two fingerprints, in units of moving one row.
COMPARE = 0.02
#: Fingerprints of one key that are compared in one task; more are cut into blocks, and all pairs of blocks compared.
BLOCK = 20_000
_POPCOUNT = np.array([bin(x).count("1") for x in range(1 << 16)], np.uint8)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x) if hasattr(np, "bitwise_count") else _POPCOUNT[x.view(np.uint16)].reshape(-1, 4).sum(1)


def fingerprint(raw: bytes | None, size: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of lower-cased word shingles; no words: 0; fewer words than a shingle: the words as one."""
    votes, total, carry = np.zeros(BITS, np.int64), 0, []
    for piece in pieces((raw or b"").lower()):
        words = carry + piece.split()
        if len(words) >= size:
            shingles = map(b" ".join, zip(*[itertools.islice(words, i, None) for i in range(size)], strict=False))
            h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64, len(words) - size + 1)
            for at in range(0, len(h), 1 << 16):
                part = h[at:at + (1 << 16)]
                votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(h)
            carry = words[1 - size:]
        else:
            carry = words
    if not total and carry:
        h = xxhash.xxh64_intdigest(b" ".join(carry), SEED)
        votes, total = np.array([h >> i & 1 for i in range(BITS)], np.int64), 1
    bits = np.packbits(votes * 2 > total, bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(text: pa.Array) -> pa.Array:
    return pa.array(map(fingerprint, raw_texts(text)), pa.int64())


def simhash(text: Column) -> Column:
    return F.arrow_udf(_fingerprints, "long")(text)


# ---- planning: which bits go together, and how far each part is probed ----

def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how often two bits agree, as 4096 rows."""
    same, n = np.zeros((BITS, BITS)), 0
    for b in batches:
        fp = b.column(0).to_numpy().astype("<i8")
        x = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32) * 2 - 1
        same += x.T @ x
        n += len(fp)
    if n:
        yield pa.RecordBatch.from_pydict({"cell": np.arange(BITS * BITS), "v": np.rint(same).astype(np.int64).ravel()})


def group_bits(agreement: np.ndarray, m: int) -> list[int]:
    """m bit masks of near-equal size, correlated bits together: the strongest free bit draws those that agree with it most."""
    tie = np.abs(agreement) - np.diag(np.diag(np.abs(agreement)))
    free, masks = list(range(BITS)), []
    for i in range(m):
        take = [max(free, key=lambda b: (tie[b, free].sum(), -b))]
        size = BITS // m + (i < BITS % m)
        while len(take) < size:
            take.append(max((b for b in free if b not in take), key=lambda b: (tie[b, take].sum(), -b)))
        free = [b for b in free if b not in take]
        masks.append(sum(1 << b for b in take))
    return masks


def reach(width: int, t: int) -> int:
    """Keys within t bits of a key of `width` bits."""
    return sum(math.comb(width, d) for d in range(t + 1))


def allocate(n: int, widths: list[int], pairs: list[float], distance: int) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost with the sum that the principle asks for. pairs: rows that meet in a part at threshold 0."""
    best = {0: (0.0, [])}
    for w, p in zip(widths, pairs, strict=True):
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, min(distance, w) + 1):
                more = 0.0 if t < 0 else n * (reach(w, t) + (t > 0)) + COMPARE * p * reach(w, t)
                if spent + t not in step or cost + more < step[spent + t][0]:
                    step[spent + t] = (cost + more, [*chosen, t])
        best = step
    return best[distance - len(widths) + 1]


def plan(fps: DataFrame, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(mask, threshold) per part, from statistics over all distinct fingerprints; at most 4096 counts reach the driver."""
    agree = np.zeros((BITS, BITS))
    for r in fps.mapInArrow(_bit_counts, "cell long, v long").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        agree[divmod(r["cell"], BITS)] = r["v"]
    n = int(agree[0, 0])
    options = {m: group_bits(agree, m) for m in range(2, distance + 2)}
    masks = sorted({x for o in options.values() for x in o})
    keys = fps.select(F.explode(F.array(*[F.struct(lit(i).alias("part"), c("fp").bitwiseAND(lit(_signed(x))).alias("key")) for i, x in enumerate(masks)])).alias("k"))
    met = keys.groupBy("k").agg(F.count(lit(1)).alias("n")).groupBy("k.part").agg(F.sum((c("n") * c("n")).cast("double")).alias("pairs"))
    pairs = {masks[r["part"]]: r["pairs"] for r in met.collect()}
    priced = {m: allocate(n, [x.bit_count() for x in o], [pairs.get(x, 0.0) for x in o], distance) for m, o in options.items()}
    m = min(priced, key=lambda k: (priced[k][0], k))
    return [(x, t) for x, t in zip(options[m], priced[m][1], strict=True) if t >= 0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


# ---- probing and verifying ----

def probe_masks(mask: int, t: int) -> list[int]:
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    return [_signed(sum(x)) for d in range(1, t + 1) for x in itertools.combinations(bits, d)]


def _spread(own: np.ndarray, fp: np.ndarray, distance: int) -> list[np.ndarray]:
    """Links of one key's rows that connect all that is linked: breadth first, each row compared with those not yet reached."""
    left, links = np.unique(fp), []
    starts = np.unique(own)
    waiting: list[int] = []
    reached = np.zeros(len(left), bool)
    for s in starts:
        i = int(np.searchsorted(left, s))
        if reached[i]:
            continue
        reached[i] = True
        waiting.append(i)
        while waiting:
            p = waiting.pop()
            open_ = np.flatnonzero(~reached)
            if not len(open_):
                waiting.clear()
                break
            near = open_[popcount(left[open_] ^ left[p]) <= distance]
            reached[near] = True
            waiting.extend(near.tolist())
            if len(near):
                links.append(np.stack([np.full(len(near), left[p]), left[near]], 1))
    return links


def _verify(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (key columns, own first). Whole keys are compared at once; the last key waits for the next batch."""
        held: list[np.ndarray] = []

        def links(group: np.ndarray, own: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            ends = np.r_[starts[1:], len(group)]
            n_own = np.add.reduceat(own.astype(np.int64), starts)
            out: list[np.ndarray] = []
            big = ((ends - starts) * n_own > 4096) & (n_own > 0)
            for s, e, k in zip(starts[big], ends[big], n_own[big], strict=True):
                out += _spread(fp[s:s + k], fp[s:e], distance)
            end_of, is_big = np.repeat(ends, ends - starts), np.repeat(big, ends - starts)
            i = np.flatnonzero(own & ~is_big)
            lag = 1
            while len(i := i[i + lag < end_of[i]]):
                ok = popcount(fp[i] ^ fp[i + lag]) <= distance
                ok &= fp[i] != fp[i + lag]
                if ok.any():
                    out.append(np.stack([fp[i[ok]], fp[i[ok] + lag]], 1))
                lag += 1
            if out:
                x = np.unique(np.sort(np.concatenate(out).view(np.int64), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

        for b in batches:
            now = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64), b.column(2).to_numpy()])
            held.append(now)
            if held[0][0, 0] == now[0, -1]:
                continue
            rows = np.concatenate(held, 1)
            cut = int(np.flatnonzero(rows[0] != rows[0, -1])[-1]) + 1
            yield from links(rows[0, :cut], rows[1, :cut] > 0, rows[2, :cut].view(np.uint64))
            held = [rows[:, cut:]]
        if held:
            rows = np.concatenate(held, 1)
            yield from links(rows[0], rows[1] > 0, rows[2].view(np.uint64))
    return run


def linked(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect every two that differ in `distance` bits or fewer."""
    rows = []
    for i, (mask, t) in enumerate(plan(fps, distance)):
        key = c("fp").bitwiseAND(lit(_signed(mask)))
        rows.append(fps.select(lit(i).alias("part"), key.alias("key"), lit(True).alias("own"), "fp"))
        if t:
            probes = F.explode(F.array(*[lit(x) for x in probe_masks(mask, t)]))
            rows.append(fps.select("fp", probes.alias("x")).select(lit(i).alias("part"), key.bitwiseXOR(c("x")).alias("key"), lit(False).alias("own"), "fp"))
    met = rows[0]
    for r in rows[1:]:
        met = met.unionByName(r)
    # keys with very many fingerprints of their own: blocks against blocks
    crowded = met.where("own").groupBy("part", "key").agg(F.count(lit(1)).alias("n")).where(c("n") > BLOCK).select(
        "part", "key", F.ceil(c("n") / BLOCK).cast("int").alias("blocks"))
    crowded = materialized(crowded, "crowded")
    group = F.xxhash64("part", "key")
    if crowded.isEmpty():
        met = met.select(group.alias("g"), "own", "fp")
    else:
        met = met.join(crowded, ["part", "key"], "left").withColumn("blocks", F.coalesce("blocks", lit(1)))
        mine = F.pmod(F.xxhash64("fp"), c("blocks")).cast("int")
        met = met.withColumn("other", F.explode(F.sequence(lit(0), c("blocks") - 1)))
        met = met.select(F.when(c("blocks") == 1, group).when(c("own"), F.xxhash64("part", "key", mine, "other")).otherwise(F.xxhash64("part", "key", "other", mine)).alias("g"), "own", "fp").unionByName(
            met.where((c("blocks") > 1) & c("own")).select(F.xxhash64("part", "key", "other", mine).alias("g"), lit(False).alias("own"), "fp"))
    met = met.repartition("g").sortWithinPartitions("g", F.desc("own"))
    return met.mapInArrow(_verify(distance), "a long, b long")


def _grouped(docs: DataFrame, doc_id: str, text: str, distance: int, carry: bool) -> tuple[DataFrame, DataFrame]:
    """`docs` with fingerprint and row number, written once; and the group and its smallest doc_id per fingerprint."""
    prepare(docs.sparkSession)
    docs = docs.drop("_sim_key", "_sim_group", "_sim_component")  # columns of these names are replaced
    kept = docs.columns if carry else [doc_id]
    marked = docs.withColumns({"_sim_fp": simhash(c(text)), "_sim_row": F.monotonically_increasing_id()})
    marked = materialized(marked.select(*[x for x in kept if x not in ("_sim_fp", "_sim_row")], "_sim_fp", "_sim_row"), "simhash")
    least = materialized(marked.groupBy(c("_sim_fp").alias("fp")).agg(F.min(doc_id).alias("least")), "fingerprints")
    found = components(linked(least.select("fp"), distance))
    member = least.join(found, least["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("g"), "least")
    smallest = member.groupBy("g").agg(F.min("least").alias("_sim_component"))
    return marked, member.join(smallest, "g").select(c("fp").alias("_sim_key"), c("g").alias("_sim_group"), "_sim_component")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, carry: bool = True) -> DataFrame:
    """`docs` (`carry`: else only doc_id) plus `_sim_row` (a row number), `_sim_fp` (fingerprint), `_sim_group` (a fingerprint that
    names the group) and `_sim_component` (smallest doc_id that links reach).

    Null and empty texts have the fingerprint zero and link like any other. Equal texts share a fingerprint and count once in
    the search. A null doc_id is never the smallest unless it is alone, then the component is null. Repeated rows all stay.
    An empty table gives no rows. Nothing is left out: all fingerprints that lie within the distance end in one component.
    """
    marked, member = _grouped(docs, doc_id, text, distance, carry)
    return marked.join(member, marked["_sim_fp"] == member["_sim_key"]).drop("_sim_key")


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id (nulls last), of repeated ones any one."""
    marked, member = _grouped(docs, doc_id, text, distance, carry=True)
    # ids and fingerprints decide; texts move once, to meet the rows that stay
    narrow = marked.select(c(doc_id).alias("d"), "_sim_fp", "_sim_row").join(member, c("_sim_fp") == c("_sim_key"))
    keep = narrow.groupBy("_sim_group").agg(F.min(F.struct(c("d").isNull().alias("z"), "d", c("_sim_row").alias("r"))).alias("_k"))
    keep = keep.select(c("_k.r").alias("_sim_keep"))
    return marked.join(keep, marked["_sim_row"] == keep["_sim_keep"], "left_semi").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=False)
    return found.select("doc_id", F.lpad(F.lower(F.hex("_sim_fp")), 16, "0").alias("fingerprint"), c("_sim_component").alias("component_id"))
