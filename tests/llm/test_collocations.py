"""Phrases against brute force, tries against dictionaries."""

import random
from collections import Counter

import numpy as np
import pytest

from tremolite.llm import collocations as col


def plain(rows, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for x in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(x, "\n")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    some = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= 10}
    out = []
    for (lang, p), a in some.items():
        if any(x == lang and len(q) > len(p) and p in (q[:-1], q[1:]) and 100 * b >= 50 * a for (x, q), b in some.items()):
            continue
        score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    place = Counter()
    for r in out:
        place[r[0]] += 1
        if place[r[0]] <= top:
            yield r[0], place[r[0]], *r[1:]


def texts(rng, n):
    words = [f"w{i}" for i in range(30)] + ["The", "THE", "é", "É", "\x01x", "漢字"]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", "\n", "\r\n", "?"]
    base = "".join(rng.choice(words) + rng.choice(ends) for _ in range(40))
    return [base if rng.random() < 0.2 else "".join(rng.choices(words, range(len(words), 0, -1))[0] + rng.choice(ends) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("held,block,sent", [(4_000_000, 4 << 20, 64 << 20), (25, 600, 9000)])
def test_like_brute_force(spark, monkeypatch, held, block, sent):
    monkeypatch.setattr(col, "HELD", held)
    monkeypatch.setattr(col, "HELD_BYTES", 64 if held < 100 else 1 << 20)
    monkeypatch.setattr(col, "BLOCK_BYTES", block)
    monkeypatch.setattr(col, "BROADCAST_BYTES", sent)
    rng = random.Random(6)
    rows = [(rng.choice(["en", "en", "d'e\\", None]), t) for t in texts(rng, 300)] + [("en", None), ("fr", ""), (None, " . "), ("xx", "a b c " * 9), ("xy", "aa bb cc. " * 10)]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "lang string, text string, n int, phrase string").repartition(4)
    want = list(plain(rows, 40))
    assert sorted(tuple(r) for r in col.mine(df, top=40).collect()) == sorted(want) and len({r[0] for r in want}) == 4


def test_empty(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert col.mine(none).count() == 0
    assert col.mine(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")).count() == 0


def test_trie_like_a_dictionary():
    rng = random.Random(7)
    for size, n in ((5, 20), (300, 3000), (70_000, 60_000)):
        words = [b"%d" % i for i in range(size)]
        phrases = sorted({tuple(words[min(int(rng.expovariate(8 / size)), size - 1)] for _ in range(rng.choice([2, 3]))) for _ in range(n)})
        trie = col.Trie([list(p) for p in phrases])
        tokens = [w for _ in range(4000) for w in (*rng.choice(phrases), rng.choice([*words[:3], b"?"]))]
        number = {w.encode(): i for i, w in enumerate(trie.words.to_pylist())}
        ids = np.array([number.get(w, -1) for w in tokens])
        for fresh in (0, 2):
            want = Counter(tuple(tokens[i:i + k]) for k in (2, 3) for i in range(len(tokens) - k + 1) if i + k - 1 >= fresh)
            assert trie.count(ids, fresh, len(phrases)).tolist() == [want[p] for p in phrases]


def test_exact_scores(spark):
    a, left, right = 9_999_999_999_999, 9_999_999_999_999, 9_999_999_999_998
    df = spark.createDataFrame([(a, left, right), (7, 7, 49), (10, 30, 70)], "a long, l long, r long")
    got = [r[0] for r in df.select(col._score(df["a"], df["l"], df["r"])).collect()]
    assert got == [1000000 * x * x // (y * z) for x, y, z in [(a, left, right), (7, 7, 49), (10, 30, 70)]]
