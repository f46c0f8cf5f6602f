"""Removal of repeated passages with prefix-partitioned suffix trees.

A passage of WINDOW words repeats where two suffixes of the corpus share a node at least that deep. Not every suffix is filed: of
the GRAM-word prefixes inside a window the one with the least hash is its anchor, which equal windows share, so a suffix stands
for all windows anchored at its start (about one suffix in eight words). Suffixes are partitioned by the hash of that prefix
into groups of memory size; a group that grows beyond it is split again by longer prefixes (the hash of the whole window).
Within a group the sorted windows are the nodes of the needed depth; a node with two leaves is a repeat, and all leaves but
the first in (doc_id, position) are reported. Each map task does the same over its own texts first, so a passage that
stands in a third of all documents is sent once per task.

Words count as equal when their 64-bit hashes are. Windows count as equal when the 64-bit prefix hash and 48 bits of a polynomial
over all word hashes are; windows that differ in one word never collide in the full 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.sinks import materialized
from .common import pieces, prepare, raw_texts, table

NAME = "op9_substring_dedup"
c, lit = F.col, F.lit
WINDOW, GRAM = 20, 5
SPAN = WINDOW - GRAM + 1
#: Bytes of text that a map task takes into memory at once; bytes of one group of suffixes; ways a large group is split.
TEXT_BYTES, GROUP_BYTES, WAYS = 2 << 20, 6 << 20, 64
#: Text that one group of suffixes stands for on average.
TEXT_PER_GROUP = 1 << 20
NO_ID = (1 << 63) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


_POWERS = np.array([pow(int(_BASE), n, 1 << 64) for n in range(256)], np.uint64)


def word_ids(raw: bytes) -> np.ndarray:
    """64-bit hashes of the white-space separated words."""
    b = np.frombuffer(raw, np.uint8)
    inside = ~_IS_SPACE[b]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    letters = b[inside].astype(np.uint64) + np.uint64(1)
    size = ends - starts
    at = np.r_[0, np.cumsum(size)[:-1]]
    rel = np.arange(len(letters)) - np.repeat(at, size)
    power = _POWERS[rel & 255]
    if (far := rel > 255).any():  # words of over 256 bytes: the power in two steps
        high = rel[far] >> 8
        steps = np.array([_power(int(h) << 8) for h in np.unique(high)], np.uint64)
        power[far] *= steps[np.searchsorted(np.unique(high), high)]
    return _mix(np.add.reduceat(letters * power, at) ^ size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _shift(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([x[n:], np.zeros(min(n, len(x)), x.dtype)])


def windows_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per position: hash of the window that starts there, position and hash of its anchor. Positions too near the end are junk."""
    h = {1: ids}
    for n in (2, 4, 8, 16):
        h[n] = h[n // 2] * _power(n // 2) + _shift(h[n // 2], n // 2)
    whole, gram = h[16] * _power(4) + _shift(h[4], 16), _mix(h[4] * _power(1) + _shift(h[1], 4))
    least, where = gram, np.arange(len(ids), dtype=np.int64)
    for n in (1, 2, 4, 8):
        other, there = _shift(least, n), _shift(where, n)
        less = other < least
        least, where = np.where(less, other, least), np.where(less, there, where)
    return whole, where, least


def _runs(x: np.ndarray) -> np.ndarray:
    """Ascending numbers as (first, last) pairs."""
    if not len(x):
        return np.empty((0, 2), np.int32)
    cut = np.flatnonzero(np.diff(x) != 1)
    return np.stack([x[np.r_[0, cut + 1]], x[np.r_[cut, len(x) - 1]]], 1).astype(np.int32)


_ANCHOR = np.dtype([("key", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("pos", "<i4"), ("mask", "<u2")])


def _pack(key, doc, tag, pos, off, low) -> bytes:
    """Windows (sorted by doc, tag, pos, key) as bytes: a record per anchor, then 6 bytes per window."""
    new = np.flatnonzero(np.r_[True, (np.diff(pos) != 0) | (np.diff(doc) != 0) | (np.diff(tag) != 0)])
    rec = np.empty(len(new), _ANCHOR)
    for n, x in (("key", key), ("doc", doc), ("tag", tag), ("pos", pos)):
        rec[n] = x[new]
    rec["mask"] = np.bitwise_or.reduceat(np.left_shift(1, off.astype(np.int64)), new)
    six = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return np.uint32(len(rec)).tobytes() + rec.tobytes() + six.tobytes()


def _unpack(blob: bytes):
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    rec = np.frombuffer(blob, _ANCHOR, n, 4)
    six = np.frombuffer(blob, np.uint8, offset=4 + n * _ANCHOR.itemsize).reshape(-1, 6)
    low = np.zeros((len(six), 8), np.uint8)
    low[:, :6] = six
    which, bit = np.nonzero(np.unpackbits(rec["mask"].astype(">u2").view(np.uint8).reshape(-1, 2), axis=1))  # larger offsets first: ascending starts
    return rec["key"][which], rec["doc"][which], rec["tag"][which], rec["pos"][which], (SPAN - 1 - bit).astype(np.int8), low.view("<u8").ravel()


_SCHEMA = pa.schema([("bucket", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("data", pa.binary())])
_DDL = "bucket long, doc long, tag long, data binary"
FOUND = -1


def _emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 1024):
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows[at:at + 1024], strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _found_rows(doc, tag, start) -> list[tuple]:
    """Reported windows by document: (FOUND, doc, tag, runs of starts)."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start = doc[order], tag[order], start[order]
    cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(tag) != 0)) + 1
    return [(FOUND, int(doc[a]), int(tag[a]), _runs(np.unique(start[a:b])).tobytes()) for a, b in zip(np.r_[0, cut], np.r_[cut, len(doc)], strict=True) if b > a]


def _map(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for doc, tag, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw_texts(b.column(2)), strict=True):
                base, carry = 0, []
                for piece in pieces(raw or b""):
                    text = b" ".join([*carry, piece])
                    ids = word_ids(text)
                    if len(ids) >= WINDOW:
                        held.append((doc, tag, base, ids))
                        size += len(text)
                    carry = text.rsplit(None, WINDOW - 1)[-(WINDOW - 1):] if len(ids) >= WINDOW else text.split()
                    base += len(ids) - len(carry)
                    if size >= TEXT_BYTES:
                        yield from _emit(_local(held, buckets))
                        held, size = [], 0
        if held:
            yield from _emit(_local(held, buckets))
    return run


def _local(held: list[tuple], buckets: int) -> list[tuple]:
    """Windows of some texts: those seen earlier in them are reported, the first of each kind goes to its group."""
    held.sort(key=lambda x: x[:3])
    sizes = np.array([len(x[3]) for x in held])
    ids = np.concatenate([x[3] for x in held])
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    whole, where, least = windows_of(ids)
    valid = np.concatenate([np.arange(n) <= n - WINDOW for n in sizes])
    at = np.flatnonzero(valid)
    owner = np.repeat(np.arange(len(held)), sizes)[at]
    doc, tag = np.array([x[0] for x in held])[owner], np.array([x[1] for x in held])[owner]
    start = at - begin[owner] + np.array([x[2] for x in held])[owner]
    whole, key, off = whole[at], least[at], where[at] - at
    order = np.argsort(whole, kind="stable")
    same = np.r_[False, whole[order][1:] == whole[order][:-1]]
    first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    later = np.zeros(len(at), bool)
    later[order] = same & ((doc[order] != doc[first]) | (start[order] != start[first]))
    copy = np.zeros(len(at), bool)
    copy[order] = same
    rows = _found_rows(doc[later], tag[later], start[later])
    keep = ~copy
    key, doc, tag, pos, off, low = key[keep], doc[keep], tag[keep], (start + off)[keep], off[keep], (_mix(whole) & np.uint64((1 << 48) - 1))[keep]
    # anchors are the least of their neighbours, so their hashes crowd near zero: hashed again, groups are even
    bucket = ((_mix(key ^ _BASE) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    return rows + _split(bucket, key, doc, tag, pos, off, low)


def _split(bucket, key, doc, tag, pos, off, low) -> list[tuple]:
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.diff(b)) + 1
    out = []
    for s, e in zip(np.r_[0, cut], np.r_[cut, len(b)], strict=True):
        if e > s:
            o = order[s:e]
            out.append((int(b[s]), None, None, _pack(key[o], doc[o], tag[o], pos[o], off[o], low[o])))
    return out


def _group(level: int):
    def resolve(blobs: list[bytes]) -> list[tuple]:
        key, doc, tag, pos, off, low = (np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True))
        order = np.argsort(key ^ (low * _BASE))
        same = (key[order][1:] == key[order][:-1]) & (low[order][1:] == low[order][:-1])
        hit = order[np.r_[False, same] | np.r_[same, False]]
        if not len(hit):
            return []
        start = pos[hit] - off[hit]
        order = np.lexsort((start, doc[hit], low[hit], key[hit]))
        hit, start = hit[order], start[order]
        k, w, d = key[hit], low[hit], doc[hit]
        same = np.r_[False, (k[1:] == k[:-1]) & (w[1:] == w[:-1])]
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(hit))))
        later = same & ((d != d[first]) | (start != start[first]))
        return _found_rows(d[later], tag[hit][later], start[later])

    def longer(bucket: int, blobs: list[bytes]) -> list[tuple]:
        """The windows of a group that is too large, dealt by the next bits of their own hash."""
        out = []
        for x in blobs:
            key, doc, tag, pos, off, low = _unpack(x)
            bits = (low >> np.uint64(6 * level) & np.uint64(WAYS - 1)).astype(np.int64)
            out += _split(bucket * WAYS + bits, key, doc, tag, pos, off, low)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, large = None, [], 0, False
        for b in batches:
            for bucket, doc, tag, data in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if doc is not None:
                    yield from _emit([(FOUND, doc, tag, data)])
                    continue
                if bucket != now:
                    if held:
                        yield from _emit(resolve(held))
                    now, held, size, large = bucket, [], 0, False
                held.append(data)
                size += len(data)
                if level < 8 and (large or size > GROUP_BYTES):
                    large = True
                    yield from _emit(longer(bucket, held))
                    held = []
        if held:
            yield from _emit(resolve(held))
    return run


def repeats(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, tag, data): starts of windows that also start earlier, as runs of int32 pairs; tag is the hash of the text."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    own = docs.select(F.coalesce(c(doc_id), lit(NO_ID)).cast("bigint").alias("doc"), F.xxhash64(text).alias("tag"), c(text).alias("text")).where(F.length("text") > 2 * WINDOW - 2)
    rows, found = own.mapInArrow(_map(-(-total // TEXT_PER_GROUP) or 1), _DDL), None
    for level in range(9):
        rows = rows.repartition("bucket", "doc").sortWithinPartitions("bucket").mapInArrow(_group(level), _DDL)
        rows = materialized(rows, "repeats")
        done = rows.where(c("bucket") == FOUND)
        found = done if found is None else found.unionByName(done)
        rows = rows.where(c("bucket") != FOUND)
        if rows.isEmpty():
            break
    return found.select("doc", "tag", "data")


def _cut(text: pa.Array, found: pa.Array) -> pa.Array:
    words_n, removed_n, kept_text = [], [], []
    for raw, blobs in zip(raw_texts(text), found.to_pylist(), strict=True):
        words = (raw or b"").split()
        n = len(words)
        if blobs:
            runs = np.concatenate([np.frombuffer(x, "<i4").reshape(-1, 2) for x in blobs])
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, runs[:, 0], 1)
            np.add.at(step, runs[:, 1] + WINDOW, -1)
            words = list(compress(words, (np.cumsum(step[:n]) == 0).tolist()))
        words_n.append(n)
        removed_n.append(n - len(words))
        kept_text.append(b" ".join(words).decode("utf-8", "replace"))
    return pa.StructArray.from_arrays([pa.array(words_n, pa.int64()), pa.array(removed_n, pa.int64()), pa.array(kept_text, pa.string())], names=["n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` plus `_sub.n_words`, `_sub.n_removed` and `_sub.kept` (the kept words, joined by one space).

    Each word is removed that a window of WINDOW words covers whose sequence also starts earlier: in a smaller doc_id, or earlier
    in the same document; windows are judged on the input. Null and empty texts have no words. A null doc_id comes after all
    others. Rows that repeat doc_id and text are one document and share its result; other rows of one doc_id compare by
    position. An empty table gives no rows. Long texts are read in overlapping pieces.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("_sub_doc", "_sub_tag", "_sub_found")
    found = repeats(docs, doc_id, text).groupBy(c("doc").alias("_sub_doc"), c("tag").alias("_sub_tag")).agg(F.collect_list("data").alias("_sub_found"))
    mine = docs.withColumns({"_sub_key": F.coalesce(c(doc_id), lit(NO_ID)).cast("bigint"), "_sub_hash": F.xxhash64(text)})
    both = mine.join(found, (c("_sub_key") == c("_sub_doc")) & (c("_sub_hash") == c("_sub_tag")), "left")
    cut = F.arrow_udf(_cut, "struct<n_words:bigint,n_removed:bigint,kept:string>")
    return both.withColumn("_sub", cut(c(text), c("_sub_found"))).drop("_sub_key", "_sub_hash", "_sub_doc", "_sub_tag", "_sub_found")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", c("_sub.n_words").alias("n_words"), c("_sub.n_removed").alias("n_removed"), F.sha2(c("_sub.kept"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, CAST(len(w) - 18 AS BIGINT))) AS s FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g FROM p),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM g) WHERE k > 1),
cut AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
n AS (SELECT doc_id, list(i) AS gone FROM cut GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id)
"""
