"""Benchmark decontamination as a prefix-filtered set join with windows of item words.

A window is found only where all its words stand, so its rarest word is a sufficient prefix: words are ordered by their count over
all documents, each window is filed under its rarest word and that word's place in it. A document position holding such a word
proposes the windows filed there; the place and the lengths of window and document bound where one could lie, and the full
word sequence decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.sinks import materialized
from .common import pieces, prepare, raw_texts, table

NAME = "op5_decontaminate"
c, lit = F.col, F.lit
WINDOW, SHARE = 13, 20
#: Bytes of benchmark text that one broadcast index is built from; larger benchmarks are processed in several blocks.
INDEX_BYTES = 8 << 20
#: A-Z become a-z; digits, a-z and all bytes of non-ASCII characters stay; everything else separates words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORDS).split()


def _counter(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = vocabulary.value, Counter()
        for b in batches:
            for raw in raw_texts(b.column(0)):
                for piece in pieces(raw or b""):
                    seen.update(filter(known.__contains__, words_of(piece)))
        if seen:
            yield pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.binary()), "n": pa.array(seen.values(), pa.int64())})
    return run


def build_index(items: list[tuple[str, bytes]], rarity: dict[bytes, int], window: int = WINDOW) -> dict:
    """rarest word -> [(place, length, {window: item ids})]"""
    filed: dict[bytes, dict[tuple[int, int], dict[bytes, list[str]]]] = {}
    for item, raw in items:
        words = words_of(raw)
        size = min(window, len(words))
        for s in range(len(words) - size + 1 if size else 0):
            part = words[s:s + size]
            place = min(range(size), key=lambda i: (rarity.get(part[i], 0), part[i], i))
            owners = filed.setdefault(part[place], {}).setdefault((place, size), {}).setdefault(b" ".join(part), [])
            if item not in owners:
                owners.append(item)
    return {w: [(place, size, windows) for (place, size), windows in sorted(x.items())] for w, x in filed.items()}


def search(raw: bytes | None, index: dict, window: int = WINDOW) -> tuple[int, list[int], list[str]]:
    """Number of words; hit words as merged runs [from, to, from, to ...]; items with an occurring window."""
    hits, items, base, carry = [], set(), 0, []
    for piece in pieces(raw or b""):
        words = carry + words_of(piece)
        n = len(words)
        for i in [i for i, w in enumerate(words) if w in index]:
            for place, size, windows in index[words[i]]:
                s = i - place
                if s >= 0 and s + size <= n and (owners := windows.get(b" ".join(words[s:s + size]))):
                    hits.append((base + s, base + s + size))
                    items.update(owners)
        carry = words[max(0, n - window + 1):]
        base += n - len(carry)
    runs: list[int] = []
    for s, e in sorted(hits):
        if runs and s <= runs[-1]:
            runs[-1] = max(runs[-1], e)
        else:
            runs += [s, e]
    return base + len(carry), runs, sorted(items)


def _searcher(index):
    def run(text: pa.Array) -> pa.Array:
        found = [search(raw, index.value) for raw in raw_texts(text)]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64())),
                                           pa.array([x[2] for x in found], pa.list_(pa.string()))], names=["n_words", "runs", "items"])

    return F.arrow_udf(run, "struct<n_words:bigint,runs:array<bigint>,items:array<string>>")


def _merge_runs(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        pairs, runs = sorted([*zip(x[::2], x[1::2], strict=True), *zip(y[::2], y[1::2], strict=True)]), []
        for s, e in pairs:
            if runs and s <= runs[-1]:
                runs[-1] = max(runs[-1], e)
            else:
                runs += [s, e]
        out.append(runs)
    return pa.array(out, pa.list_(pa.int64()))


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` plus `_bench_words`, `_bench_runs` (hit words as runs), `_bench_items` (ids as sorted strings), `_bench_bad`.

    A document is bad if it has hit words and they are at least a twentieth of its words. Null and empty texts have no words and
    are clean; items without words are never found; a null item_id reads `null`. Items that share a window all count. Repeated
    rows are judged one by one; without documents or items there are no rows or no hits. The benchmark is indexed in blocks of
    at most about INDEX_BYTES of text; only such a block is broadcast, and documents meet the blocks one after the other.
    """
    spark = prepare(docs.sparkSession)
    items = benchmark.select(F.coalesce(c(item_id).cast("string"), lit("null")).alias("id"), c(item_text).alias("t")).where(F.length("t") > 0)
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-total // INDEX_BYTES) or 1
    out = docs
    for k in range(blocks):
        own = [(r["id"], r["t"].encode()) for r in items.where(F.pmod(F.xxhash64("id", "t"), lit(blocks)) == k).collect()]
        known = spark.sparkContext.broadcast({w for _, raw in own for w in words_of(raw)})
        counts = docs.select(text).mapInArrow(_counter(known), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        rarity = {bytes(r["word"]): r["n"] for r in counts.collect()} if own else {}
        index = spark.sparkContext.broadcast(build_index(own, rarity))
        new = out.withColumn("_bench_new", _searcher(index)(c(text)))
        if k == 0:
            out = new.withColumns({"_bench_words": c("_bench_new.n_words"), "_bench_runs": c("_bench_new.runs"), "_bench_items": c("_bench_new.items")})
        else:
            new = materialized(new, "decontaminate")
            out = new.withColumns({"_bench_runs": F.arrow_udf(_merge_runs, "array<bigint>")(c("_bench_runs"), c("_bench_new.runs")),
                                   "_bench_items": F.array_sort(F.array_union("_bench_items", "_bench_new.items"))})
        out = out.drop("_bench_new")
    return out.withColumn("_bench_bad", (hit_words() > 0) & (SHARE * hit_words() >= c("_bench_words")))


def hit_words():
    return F.aggregate(F.transform("_bench_runs", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), lit(0).cast("bigint"), lambda s, x: s + x)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", c("_bench_words").alias("n_words"), hit_words().alias("n_hit"), F.size("_bench_items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("_bench_items", ","), 256).alias("items_sha256"), c("_bench_bad").alias("contaminated"))


_TOKENS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
ORACLE = f"""
WITH items AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_TOKENS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS s FROM items)),
sizes AS (SELECT DISTINCT n FROM win),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TOKENS} AS w FROM documents),
p AS (SELECT r, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS s FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT r, s, n, item_id FROM (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM p) JOIN win USING (n, g)),
words AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS i FROM (SELECT DISTINCT r, s, n FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN its USING (r)
"""
