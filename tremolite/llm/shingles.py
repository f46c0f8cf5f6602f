"""Near-duplicates by word shingles: Jaccard similarity of at least 0.8 on five words, verified.

Every distinct set of shingles has BANDS keys of ROWS minimum hashes each; sets that share a key are candidates (a pair of similarity
s shares none with probability (1 - s^ROWS)^BANDS, 5e-8 at 0.8). Texts whose SimHash fingerprints link (op2, 4 bits) are candidates too.
Candidates that hang together are compared in full, all against all, in blocks; only verified pairs link.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.sinks import materialized
from . import simhash
from .common import pieces, prepare, raw_texts
from .graph import components

c, lit = F.col, F.lit
SHINGLE, SIMILARITY = 5, (4, 5)
SEED, ROWS, BANDS = 42, 4, 32
#: Sets of a candidate group that are compared in one task; larger groups are cut into blocks, and all pairs of blocks compared.
BLOCK = 512
_RNG = np.random.Generator(np.random.PCG64(SEED))
_A, _B = (_RNG.integers(0, 1 << 63, ROWS * BANDS, np.uint64) for _ in range(2))
_A |= np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(raw: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased word shingles; no words: none; fewer words than a shingle: the words as one."""
    found, carry = [np.empty(0, np.uint64)], []
    for piece in pieces((raw or b"").lower()):
        words = carry + piece.split()
        if len(words) >= size:
            grams = map(b" ".join, zip(*[itertools.islice(words, i, None) for i in range(size)], strict=False))
            found.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, itertools.repeat(SEED)), np.uint64, len(words) - size + 1)))
            carry = words[1 - size:]
        else:
            carry = words
    if len(found) == 1 and carry:
        return np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)
    return found[1] if len(found) == 2 else np.unique(np.concatenate(found))


def band_keys(h: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys of a set."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):
        least = np.minimum(least, (h[at:at + 4096, None] * _A + _B).min(0))
    m = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = (key ^ (key >> np.uint64(29))) * _MIX + m[:, i]
    return key ^ (key >> np.uint64(32))


def _sketch(text: pa.Array) -> pa.Array:
    """The set as one 64-bit number, and its band keys as bytes."""
    sets, keys = [], []
    for raw in raw_texts(text):
        h = shingles(raw)
        sets.append(xxhash.xxh3_64_intdigest(h.tobytes()))
        keys.append(band_keys(h).tobytes())
    return pa.StructArray.from_arrays([pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(keys, pa.binary())], names=["set", "keys"])


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, keys) -> (k, a, null) for the first set of each key in this part of the rows, (any, a, b) for others that share it."""
    def out(sets: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
        s, k = np.repeat(np.concatenate(sets), BANDS), np.concatenate(keys)
        order = np.lexsort((s, k))
        s, k = s[order], k[order]
        new = np.r_[True, k[1:] != k[:-1]]
        a = s[new][np.cumsum(new) - 1]
        links = np.unique(np.stack([a, s], 1)[a != s], axis=0)
        n = int(new.sum())
        b = pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(links[:, 1])])
        return pa.RecordBatch.from_arrays([pa.array(np.r_[k[new], links[:, 1]]), pa.array(np.r_[s[new], links[:, 0]]), b], names=["k", "a", "b"])

    sets, keys, n = [], [], 0
    for batch in batches:
        if batch.num_rows:
            sets.append(batch.column(0).to_numpy())
            keys.append(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64))
            n += len(sets[-1])
        if n >= 1 << 15:
            yield out(sets, keys)
            sets, keys, n = [], [], 0
    if n:
        yield out(sets, keys)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by k: sets of one key link to its first; links found before pass."""
    last_k, first = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        done = batch.filter(batch.column(2).is_valid())
        yield pa.RecordBatch.from_arrays([done.column(1), done.column(2)], names=["a", "b"])
        rows = batch.filter(batch.column(2).is_null())
        k, a = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        if not len(k):
            continue
        new = np.r_[k[0] != last_k, k[1:] != k[:-1]]
        at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        to = np.where(at < 0, first if first is not None else 0, a[np.maximum(at, 0)])
        last_k, first = k[-1], to[-1]
        x = np.stack([to, a], 1)[to != a]
        yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])


def _spread(ids: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Links that connect all sets similar enough: breadth first, each set counted against those not yet reached."""
    size = np.array([len(x) for x in sets])
    reached, waiting = np.zeros(len(ids), bool), []
    held = np.empty(0, np.int64)
    up, down = SIMILARITY
    for s in range(len(ids)):
        if reached[s]:
            continue
        reached[s] = True
        waiting.append(s)
        while waiting:
            p = waiting.pop()
            left = np.flatnonzero(~reached)
            if not len(left):
                return
            if not len(held) or len(left) * 2 < len(held):  # the index of shingles holds open sets only, and some that were since reached
                held = left
                of, h = np.repeat(held, size[held]), np.concatenate([sets[i] for i in held])
                order = np.argsort(h, kind="stable")
                of, h = of[order], h[order]
            lo, hi = np.searchsorted(h, sets[p], "left"), np.searchsorted(h, sets[p], "right")
            n = hi - lo
            take = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
            both = np.bincount(of[take], minlength=len(ids))
            near = left[both[left] * down >= (size[p] + size[left] - both[left]) * up]
            if len(near):
                reached[near] = True
                waiting.extend(near.tolist())
                yield ids[p], ids[near]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, set, text) sorted by group -> links (a, b)."""
    def links(ids: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a, b in _spread(np.array(ids, np.int64), sets):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), a)), pa.array(b)], names=["a", "b"])

    now, ids, sets = None, [], []
    for batch in batches:
        for g, v, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), strict=True):
            if g != now:
                yield from links(ids, sets)
                now, ids, sets = g, [], []
            ids.append(v)
            sets.append(shingles(raw))
    yield from links(ids, sets)


def _fingerprinted(marked: DataFrame) -> DataFrame:
    """Links (a, b) between sets of texts whose SimHash fingerprints op2 links: each to the least of its group."""
    fps = materialized(marked.select(c("_near_fp").alias("fp")).distinct(), "fingerprints")
    linked = components(simhash.linked(fps))
    sets = marked.select("_near_set", "_near_fp").distinct().join(linked, c("_near_fp") == c("node"), "left").select("_near_set", F.coalesce("component", "_near_fp").alias("g"))
    return sets.join(sets.groupBy("g").agg(F.min("_near_set").alias("b")), "g").select(c("_near_set").alias("a"), "b")


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id (nulls last), of repeated ones any one.

    Documents link when the sets of their shingles have a Jaccard similarity of 0.8 or more; groups are what links reach. Null texts
    and those without words are equal. Each link is exact (shingles and sets count as equal when their 64-bit hashes are).
    """
    prepare(docs.sparkSession)
    sketch = F.arrow_udf(_sketch, "set long, keys binary")
    marked = docs.withColumns({"_near_row": F.monotonically_increasing_id(), "_near": sketch(c(text)), "_near_fp": simhash.simhash(c(text))})
    marked = materialized(marked.select(*docs.columns, "_near_row", "_near_fp", c("_near.set").alias("_near_set"), c("_near.keys").alias("_near_keys")), "shingles")
    met = marked.select("_near_set", "_near_keys").mapInArrow(_apart, "k long, a long, b long").repartition("k").sortWithinPartitions("k")
    group = materialized(components(met.mapInArrow(_candidates, "a long, b long").unionByName(_fingerprinted(marked))), "candidates")
    blocks = group.groupBy("component").agg(F.ceil(F.count(lit(1)) / BLOCK).cast("int").alias("blocks"))
    one = marked.groupBy(c("_near_set").alias("node")).agg(F.min("_near_row").alias("row"))
    dealt = group.join(blocks, "component").join(one, "node")
    own, other = F.pmod(F.xxhash64("node"), c("blocks")).cast("int"), c("other")
    others = F.when(c("blocks") == 1, F.array(lit(0))).otherwise(F.array_remove(F.sequence(lit(0), c("blocks") - 1), own))
    dealt = dealt.select("node", "row", "component", own.alias("own"), F.explode(others).alias("other"))
    dealt = dealt.select("node", "row", F.xxhash64("component", F.least("own", other), F.greatest("own", other)).alias("g"))
    texts = marked.select(c("_near_row").alias("row"), c(text).alias("text")).join(dealt, "row").select("g", "node", "text")
    found = components(texts.repartition("g").sortWithinPartitions("g").mapInArrow(_verified, "a long, b long"))
    rows = marked.select(c(doc_id).alias("d"), "_near_set", c("_near_row").alias("r")).join(found, c("_near_set") == c("node"), "left")
    keep = rows.groupBy(F.coalesce("component", "_near_set").alias("g")).agg(F.min(F.struct(c("d").isNull().alias("z"), "d", "r")).alias("_k"))
    return marked.join(keep.select(c("_k.r").alias("_near_keep")), c("_near_row") == c("_near_keep"), "left_semi").select(*docs.columns)
