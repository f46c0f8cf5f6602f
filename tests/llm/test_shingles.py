"""Near-duplicates by shingles against brute force."""

import random

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tremolite.llm import shingles, simhash


def sets_of(text):
    w = bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode()).split()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def groups(texts, candidates):
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x
    sets = [sets_of(t) for t in texts]
    for i, j in candidates:
        a, b = sets[i], sets[j]
        if a == b or 5 * len(a & b) >= 4 * len(a | b):
            top[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [512, 7])
def test_similarity_groups(spark, monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK", block)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "One", "one", "a b c d", "A b C d", "a b c d e", "x a b c d e"]
    for n in (60, 250):
        for _ in range(8):
            base = rng.choices(words, k=n)
            for cut in range(1, 9):  # similarities from above 0.8 to below
                t = list(base)
                for _ in range(cut * n // 250 + 1):
                    t[rng.randrange(n)] = "new"
                texts.append(" ".join(t))
    texts += [texts[-1]] * 5 + [" ".join(rng.choices(words, k=rng.randrange(1, 80))) for _ in range(80)]
    want = groups(texts, [(i, j) for i in range(len(texts)) for j in range(i)])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = shingles.survivors(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(want)
    assert shingles.survivors(docs.limit(0)).count() == 0


def test_stage_finds_similar_documents(spark):
    """Every pair of similarity 0.8 or more: pairs that share one shingle at least, by brute force."""
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows.sort(key=lambda r: r["doc_id"])
    texts = [r["text"] for r in rows]
    filed, pairs = {}, set()
    for i, t in enumerate(texts):
        for s in sets_of(t) or ["none"]:
            pairs.update((i, j) for j in filed.get(s, ()))
            filed.setdefault(s, []).append(i)
    want = {rows[g]["doc_id"] for g in groups(texts, pairs)}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r[0] for r in corpus_pipeline.near_duplicates(spark, docs, None).select("doc_id").collect()}
    assert got == want


def test_keys_miss_hardly_any(spark):
    rng = random.Random(5)
    missed = 0
    for _ in range(300):
        h = [rng.getrandbits(64) for _ in range(222)]
        a, b = (shingles.np.array(sorted(h[:200] + x), shingles.np.uint64) for x in (h[200:211], h[211:]))
        b = shingles.np.array(sorted(set(b.tolist()) - set(h[:14])), shingles.np.uint64)
        missed += not (shingles.band_keys(a) == shingles.band_keys(b)).any()
    assert missed == 0



def test_stage_takes_candidates_by_simhash(spark, monkeypatch):
    """Fingerprints that link bring candidates; a linked pair that is not similar enough stays apart."""
    rng, real, seen = random.Random(11), simhash.linked, []
    monkeypatch.setattr(simhash, "linked", lambda fps: seen.append(sorted(r[0] for r in fps.collect())) or real(fps))
    while True:  # one word in the middle of a short text changes five shingles
        words = [f"v{rng.randrange(9999)}" for _ in range(24)]
        a, b = " ".join(words), " ".join([*words[:12], "changed", *words[13:]])
        if ((simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())) & (1 << 64) - 1).bit_count() <= 4:
            break
    long = " ".join(f"u{i}" for i in range(200))
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate([a, b, long, long + " more"])], "doc_id long, text string, source string")
    assert {r[0] for r in corpus_pipeline.near_duplicates(spark, docs, None).collect()} == {0, 1, 2}
    assert seen == [sorted({simhash.fingerprint(t.encode()) for t in (a, b, long, long + " more")})]
