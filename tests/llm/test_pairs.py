"""SimHash and embedding near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tremolite.llm import embedding_dedup, graph, simhash


def plain_fingerprint(text):
    words = bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode()).split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(n, linked):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x
    for a, b in linked:
        top[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_fingerprints_and_groups(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    base = " ".join(rng.choices(words, k=400))
    texts = [None, "", " \t\n", "One", "one two THREE", "a b c d", "A B C D", base, base.upper(), base + " x", "é ü x  y z ÀB" * 9]
    for _ in range(150):
        t = base.split()
        t[rng.randrange(400)] = "new"
        texts.append(" ".join(t))
    texts += [" ".join(rng.choices(words, k=rng.randrange(1, 80))) for _ in range(100)] + [base] * 30 + ["z " * 3 * 200_000]
    docs = spark.createDataFrame([(None if i == 7 else i // 2, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, fp string, n int").repartition(3)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    prints = [plain_fingerprint(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    comp = plain_components(len(texts), near)
    ids = [None if i == 7 else i // 2 for i in range(len(texts))]
    least = {}
    for i, g in enumerate(comp):
        if ids[i] is not None:
            least[g] = min(least.get(g, 1 << 60), ids[i])
    for r in got:
        assert r["_sim_fp"] % (1 << 64) == prints[r["n"]]
        assert r["_sim_component"] == least.get(comp[r["n"]])
    kept = simhash.survivors(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(comp))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.survivors(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [20_000, 40])
def test_no_link_is_lost(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    skew = (base & np.uint64(0xFFFF)) | np.uint64(0x123456789AB0000)  # most bits alike: crowded keys
    near = [x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, d, replace=False))) for x in base[:200] for d in (1, 3, 4, 5)]
    fps = np.unique(np.concatenate([base, skew, np.array(near, np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash.linked(df)
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 4).count() == 0
    got = {r["node"]: r["component"] for r in graph.components(links).collect()}
    d = np.bitwise_count(fps[:, None] ^ fps[None, :])
    comp = plain_components(len(fps), [(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 4)) if j < i])
    signed = fps.view(np.int64).tolist()
    groups = {}
    for x, g in zip(signed, comp):
        groups.setdefault(g, set()).add(got.get(x, x))
    assert all(len(x) == 1 for x in groups.values()) and len({next(iter(x)) for x in groups.values()}) == len(groups)


def test_thresholds_add_up():
    for m in range(2, 6):
        widths = [64 // m + (i < 64 % m) for i in range(m)]
        for n in (10, 10_000, 10_000_000):
            _, t = simhash.allocate(n, widths, [n * n / 2 ** w + n for w in widths], 4)
            assert sum(t) == 4 - m + 1 and min(t) >= -1
    masks = simhash.group_bits(np.random.default_rng(0).normal(size=(64, 64)), 3)
    assert sum(masks) == (1 << 64) - 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2001 + i) for i in range(40)] + [(5, 5)]
    want = plain_components(3000, edges)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == touched and all(got[x] == want[x] for x in touched)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 50)
    rng = np.random.default_rng(3)
    rows = [rng.normal(size=16) for _ in range(300)]
    centre = rng.normal(size=16)
    rows += [centre + rng.normal(size=16) * 0.12 for _ in range(120)] + [rows[i] + rng.normal(size=16) * 0.1 for i in range(60)] + [rows[0]] * 25 + [2 * rows[1]]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    data = [(i, [float(v) for v in np.asarray(x, np.float32)], 0, 1.0) for i, x in enumerate(rows)] + [(1000 + i, x, 1, 1.0) for i, x in enumerate(odd)] + [(None, [float(v) for v in np.asarray(rows[2], np.float32)], 0, 0.0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, v double")
    got = {r["vec_id"]: (r["_emb_links"], r["_emb_component"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(data)
    x = np.array([np.asarray(r, np.float32) for r in rows] + [np.asarray(rows[2], np.float32)], np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    ids = [*range(len(rows)), None]
    comp = plain_components(len(x), [(int(i), int(j)) for i, j in zip(*np.nonzero(s)) if j < i])
    right = sum(got[ids[i]] == (int(s[i].sum()) - 1, comp[i]) for i in range(len(x)))
    assert right >= 0.99 * len(x)
    assert all(got[ids[i]][0] <= int(s[i].sum()) - 1 for i in range(len(x)))
    assert [got[1000 + i] for i in range(6)] == [(0, 1000 + i) for i in range(6)] and got[1006] == got[1007] == (1, 1006)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_table(spark):
    path = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = dict(zip([r["vec_id"] for r in rows], ((u @ u.T >= 0.95).sum(1) - 1).tolist()))
    got = embedding_dedup.query(spark, path).collect()
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got)
    assert all(r["n_links"] <= links[r["vec_id"]] for r in got) and found >= 0.95 * sum(links.values())


def test_embeddings_of_table_with_planted_copies(spark):
    """The table itself holds no pair at 0.95; here every third vector has a near copy and one has a group of 150, on both sides of the threshold."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    rng = np.random.default_rng(6)
    near = lambda x, far: np.asarray(x, np.float64) + rng.normal(size=len(x)) * far * np.linalg.norm(x) / np.sqrt(len(x))
    made = [near(r["embedding"], rng.choice([0.05, 0.2, 0.3, 0.4])) for r in rows[::3]] + [near(rows[1]["embedding"], 0.15) for _ in range(150)]
    top = max(r["vec_id"] for r in rows)
    extra = spark.createDataFrame([(top + 1 + i, [float(v) for v in np.asarray(x, np.float32)], 0) for i, x in enumerate(made)], "vec_id long, embedding array<float>, label int")
    both = df.select("vec_id", "embedding", "label").unionByName(extra)
    x = np.array([np.asarray(r["embedding"], np.float32) for r in rows] + [np.asarray(v, np.float32) for v in made], np.float64)
    ids = [r["vec_id"] for r in rows] + [top + 1 + i for i in range(len(made))]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = u @ u.T
    s = cosine >= 0.95
    want = dict(zip(ids, (s.sum(1) - 1).tolist()))
    assert sum(v > 0 for v in want.values()) > 200 and ((cosine > 0.9) & ~s).any()
    comp = plain_components(len(x), [(int(i), int(j)) for i, j in zip(*np.nonzero(s)) if j < i])
    got = {r["vec_id"]: (r["_emb_links"], r["_emb_component"]) for r in embedding_dedup.near_duplicates(both).collect()}
    assert set(got) == set(want)
    assert all(got[k][0] <= n for k, n in want.items()) and sum(got[k][0] for k in want) >= 0.99 * sum(want.values())
    assert sum(got[k][1] == ids[comp[i]] for i, k in enumerate(ids)) >= 0.99 * len(ids)
