"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

from tremolite.llm import spelling


def plain_counts(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def cut_forms(w):
    return {w[:i] + w[i + 1:] for i in range(len(w))}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) == 1:
        return a in cut_forms(b)
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1


def plain(rows):
    n = plain_counts(rows)
    filed = {}
    for w in n:
        for x in cut_forms(w) | {w} if len(w) < 400 else {w[:5], w[-5:], w[1:6]}:
            filed.setdefault(x, []).append(w)
    near = {w: set() for w in n}
    for group in filed.values():
        for a in group:
            near[a].update(b for b in group if is_near(a, b))
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        top = w
        while form[top] is not None:
            top = form[top]
        out.add((w, form[w], top, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def found(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_given_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    want = plain(rows)
    assert found(spelling.query(spark, "/root/testdata/sf0.01")) == want and sum(r[1] is not None for r in want) > 100


@pytest.mark.parametrize("held", [200_000, 7])
def test_planted_cases(spark, monkeypatch, held):
    monkeypatch.setattr(spelling, "HELD", held)
    rng = random.Random(5)
    words = ["".join(rng.choices("abé", k=rng.randrange(4, 8))) for _ in range(300)] + ["aaaaa", "aaaa", "aaaaaa", "ÀBCDE", "àbcde", "strasse×", "×÷×÷×"]
    long = ["".join(rng.choices("xyz", k=k)) for k in (253, 254, 255, 256, 257, 258, 600)]
    long += [w[:k] + "q" + w[k + d:] for w in long for k in (0, 100, len(w) - 1) for d in (0, 1)] + [w[:9] + w[10:] for w in long]
    rows = [(i % 50 if i % 9 else None, rng.choice([" ", ", ", "\n", "1", "ж"]).join(rng.choices(words, k=60))) for i in range(120)]
    rows += [(1000 + i, " ".join(long[k] for k in range(len(long)) for _ in range(1 + (k % 5) ** 2))) for i in range(3)]
    rows += [(1, None), (2, ""), (3, "  "), (4, "common "), *[(9, "again again word")] * 3]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, n int").repartition(7)
    want = plain(rows)
    assert found(spelling.group_spellings(df)) == want
    assert max(len(r[0]) for r in want) >= 600 and any(r[1] and len(r[0]) > 256 for r in want)


def test_ranges_split_between_batches():
    import pyarrow as pa
    rows = sorted((w[i + 1:] + "$" + w[:i], w[i], True, 5, None) for w in ("abcde", "xbcde", "abcdx", "axcde", "abxde") for i in range(5))
    schema = pa.schema([("key", pa.string()), ("x", pa.string()), ("first", pa.bool_()), ("n", pa.int64()), ("ref", pa.string())])
    got = [Counter(r["ref"] for b in spelling._scan(iter(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema).to_batches(size)))
                   for r in b.to_pylist()) for size in (1, 2, 3, 100)]
    assert got[0] == got[1] == got[2] == got[3] and got[0]["abcde"] == 4


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_spellings(empty).count() == 0
    one = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert spelling.group_spellings(one).count() == 0
