"""Decontamination, repeated passages, mixing, quality, archives and the pipeline against plain versions."""

import gzip
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tremolite.llm import cnn_quality, common, decontaminate, mixing, substring_dedup, warc
from tremolite.operators.sinks import scratch


def sentence(rng, n, words=200):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def plain_words(text):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.mark.parametrize("index_bytes,piece", [(8 << 20, 1 << 20), (300, 64)])
def test_decontamination(spark, monkeypatch, index_bytes, piece):
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", index_bytes)
    whole = common.pieces
    monkeypatch.setattr(decontaminate, "pieces", lambda raw: whole(raw, piece))
    rng = random.Random(4)
    items = [(i, sentence(rng, 30)) for i in range(20)] + [(30, "Short ITEM é"), (31, None), (32, "..."), (33, sentence(rng, 13)), (34, "short item É"), (None, "nameless item words")]
    items += [(50, items[0][1]), (7, items[7][1])]
    take = lambda i, a, n: " ".join((items[i][1] or "").split()[a:a + n])
    docs = [None, "", "  ", sentence(rng, 400), take(0, 0, 30), "x. " + take(1, 5, 13).upper().replace(" ", ", "), take(1, 5, 12), sentence(rng, 300) + " " + take(2, 3, 13) + " tail", "a short item é b",
            take(3, 0, 14) + " " + take(3, 1, 14) + " " + sentence(rng, 5), sentence(rng, 3000) + " " + take(4, 0, 30), "nameless item words", take(0, 0, 30)]
    df = spark.createDataFrame([(i % 11, t, 1, "x") for i, t in enumerate(docs)], "doc_id long, text string, n_words int, word string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_items(df, bench).select("text", "_bench_words", decontaminate.hit_words().alias("hit"), "_bench_items", "_bench_bad").collect()
    assert len(got) == len(docs)
    for r in got:
        w, hit, found = plain_words(r["text"]), set(), set()
        for item, text in items:
            iw = plain_words(text)
            size = min(13, len(iw))
            for s in range(len(iw) - size + 1 if size else 0):
                for p in range(len(w) - size + 1):
                    if w[p:p + size] == iw[s:s + size]:
                        hit |= set(range(p, p + size))
                        found.add("null" if item is None else str(item))
        assert (r["_bench_words"], r["hit"], r["_bench_items"], r["_bench_bad"]) == (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    assert decontaminate.find_items(df, bench.limit(0)).where("_bench_bad").count() == 0 and decontaminate.find_items(df.limit(0), bench).count() == 0


def plain_cut(rows):
    first, out = {}, []
    words = [(d if d is not None else 1 << 62, i, (t or "").encode().split()) for i, (d, t) in enumerate(rows)]
    for d, _, w in words:
        for s in range(len(w) - 19):
            k = tuple(w[s:s + 20])
            first[k] = min(first.get(k, (d, s)), (d, s))
    for d, i, w in words:
        gone = {j for s in range(len(w) - 19) if first[tuple(w[s:s + 20])] < (d, s) for j in range(s, s + 20)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_repeated_passages(spark, monkeypatch, small):
    if small:  # many groups of texts, groups that overflow several times, pieces of few words
        monkeypatch.setattr(substring_dedup, "TEXT_BYTES", 5000)
        monkeypatch.setattr(substring_dedup, "TEXT_PER_GROUP", 30_000)
    rng = random.Random(6)
    common_passage, other = sentence(rng, 60), sentence(rng, 25)
    rows = [(None, common_passage), (0, None), (1, ""), (2, sentence(rng, 19)), (3, common_passage), (4, "x " + common_passage + " y"), (5, " ".join(common_passage.split()[10:40])), (6, "a " * 200), (6, "a " * 200),
            (7, sentence(rng, 100) + " " + other), (8, other + "\t\n" + sentence(rng, 10) + "  " + other), (9, "é " * 30 + " z " * 25), (10, " ".join(["long" * 200] * 45)), (11, sentence(rng, 20000, 5000)), (12, other)]
    rows += [(100 + i, sentence(rng, rng.randrange(1, 60), 40) + " " + common_passage) for i in range(80)] + [(1, other), (3, common_passage)]
    df = spark.createDataFrame([(*r, "c", i) for i, r in enumerate(rows)], "doc_id long, text string, data string, n int").repartition(4)
    want = plain_cut(rows)
    got = substring_dedup.remove_repeats(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["_sub"]["n_words"], r["_sub"]["n_removed"], r["_sub"]["kept"]) == want[r["n"]], rows[r["n"]][0]
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_crowded_prefixes(monkeypatch):
    """A group beyond its memory is dealt again by longer prefixes, level by level, to the same result."""
    import pyarrow as pa
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 2000)
    rng = random.Random(8)
    head = sentence(rng, 12)
    rows = [(i, 0, (head + " " + sentence(rng, 15, 6) + " " + head).encode()) for i in range(60)]
    batch = pa.RecordBatch.from_pydict({"doc": [r[0] for r in rows], "tag": [0] * len(rows), "text": pa.array([r[2].decode() for r in rows])})
    level, found, todo = 0, Counter(), list(substring_dedup._map(1)([batch]))
    while todo:
        left = []
        flat = sorted((r for b in todo for r in b.to_pylist()), key=lambda r: r["bucket"])
        out = substring_dedup._group(level)(iter([pa.RecordBatch.from_pylist(flat, schema=substring_dedup._SCHEMA)]))
        for r in (r for b in out for r in b.to_pylist()):
            if r["bucket"] == substring_dedup.FOUND:
                for a, b in np.frombuffer(r["data"], "<i4").reshape(-1, 2):
                    found.update((r["doc"], int(s)) for s in range(a, b + 1))
            else:
                left.append(r)
        todo = [pa.RecordBatch.from_pylist(left, schema=substring_dedup._SCHEMA)] if left else []
        level += 1
    first = {}
    for d, _, t in rows:
        w = t.split()
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s:s + 20]), (d, s))
    want = {(d, s) for d, _, t in rows for s in range(len(t.split()) - 19) if first[tuple(t.split()[s:s + 20])] != (d, s)}
    assert set(found) == want and level > 1


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["big"] * 6 + ["Mid", "mid", "ß", None]), sentence(rng, rng.randrange(0, 120))) for i in range(900)] + [(5000, "tiny", "one two"), (5001, "none", ""), (5002, "none", None), (3, "big", "again " * 40), (None, "big", "x " * 3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int")
    once = mixing.mix(df).taken().collect()
    again = mixing.mix(df.repartition(7)).taken().collect()
    key = lambda x: sorted((r["doc_id"] or -1, r["text"] or "", r["_mix_size"], r["_mix_taken"]) for r in x)
    assert len(once) == len(rows) and key(once) == key(again)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, mixing.fill_targets([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))])))
    taken = Counter()
    for r in once:
        assert r["_mix_size"] == len((r["text"] or "").split()) and r["_mix_source_size"] == sizes[r["source"]] and r["_mix_target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["_mix_taken"] <= 3 * r["_mix_size"]
        taken[r["source"]] += r["_mix_taken"]
    for s in names:
        assert abs(taken[s] - targets[s]) <= 2 * mixing.BLOCK + 0.01 * targets[s], (s, taken[s], targets[s])
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    m = mixing.mix(df)
    text = m.texts("text")
    assert text.agg(F.sum(F.size(F.split("text", " ")))).first()[0] == sum(taken.values())
    assert mixing.mix(df.limit(0)).taken().count() == 0


def test_mixing_parts():
    for n in (1, 2, 3, 64, 1000, 4097):
        assert sorted(mixing.permute(np.arange(n), n, 99).tolist()) == list(range(n))
    drawn = mixing.draw_shards([1000, 0, 17, 50_000], 9)
    assert drawn.sum(0).tolist() == [1000, 0, 17, 50_000] and (drawn >= 0).all() and drawn.sum(1).max() - drawn.sum(1).min() <= 9
    assert mixing.fill_targets([10, 0, 1000], [1, 2, 3]) == pytest.approx([30, 0, 980])


def test_quality(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = cnn_quality.query(spark, path).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert len(got) > 500 and np.mean([r[0] == r[1] for r in got]) > 0.97
    net = cnn_quality.train(docs, labels)
    edge = [None, "", "x", "\0" * 50, "ok words here. " * 30_000, "Su " * 5000, "The word is here", "The word is here"]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(edge)], "doc_id long, text string, score double")
    rows = cnn_quality.score(df, net).collect()
    assert all(0 <= r["_quality"] <= 1 for r in rows) and rows[0]["_quality"] == rows[1]["_quality"] and rows[6]["_quality"] == rows[7]["_quality"]
    alone = {r["doc_id"]: cnn_quality.probability(net, [(r["text"] or "").encode()])[0] for r in rows}
    assert all(abs(alone[r["doc_id"]] - r["_quality"]) < 1e-5 for r in rows)
    tail = "The plain text of it is good and long. " * 200
    assert cnn_quality.probability(net, [(tail + "XX## $$%% " * 4000).encode()])[0] < cnn_quality.probability(net, [tail.encode()])[0]
    assert cnn_quality.score(df.limit(0), net).count() == 0
    assert cnn_quality.fit([], np.array([], np.float32)).shift[0] == 0


@pytest.mark.parametrize("group_bytes,roll", [(16 << 20, 4 << 20), (40_000, 3000)])
def test_archives(spark, group_bytes, roll):
    rng = random.Random(9)
    same = "<p>" + "copy é " * 300 + "</p>"
    rows = [(i, f"http://h/{i}", sentence(rng, rng.randrange(0, 400))) for i in range(60)] + [(100 + i, None if i % 2 else "http://a b\r\nX: y/ ", same) for i in range(40)] + [(200 + i, "u", "short") for i in range(30)]
    rows += [(None, "n", None), (None, "n", same), (139, "dup", same), (300, "z", ""), (301, None, None), (302, "big", "b" * 3_000_000), (303, "q", "WARC/1.1\r\n\r\n" * 200), (303, "q", "WARC/1.1\r\n\r\n" * 200)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    root = scratch(spark, "warc-test")
    manifest = warc.write_warc(df, root, group_bytes, roll).collect()
    got = warc.read_warc(spark, root).collect()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    top = {}
    for p, _, t in rows:
        top[sha(t)] = max(top.get(sha(t), -1), -1 if p is None else p)
    want, used = Counter(), set()
    for p, _, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        n, d = len((t or "").encode()), sha(t)
        answer = n < 1000 or ((-1 if p is None else p) == top[d] and d not in used)
        if answer and n >= 1000:
            used.add(d)
        want[(p, n, d, "response" if answer else "revisit", None if answer else top[d])] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert sum(r["records"] for r in manifest) == len(rows) and len({r["record_id"] for r in got}) >= len(rows) - 1
    other = scratch(spark, "warc-test")
    assert {(r["file"], r["sha1"]) for r in warc.write_warc(df.repartition(5), other, group_bytes, roll).collect()} == {(r["file"], r["sha1"]) for r in manifest}
    for r in manifest:
        raw = open(f"{root.removeprefix('file://')}/{r['file']}", "rb").read()
        assert hashlib.sha1(raw).hexdigest() == r["sha1"] and gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
    empty = scratch(spark, "warc-test")
    assert warc.write_warc(df.limit(0), empty).count() == 0 and warc.read_warc(spark, empty).count() == 0


def test_pipeline(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({"_quality": F.lit("mine"), "size": F.lit(1)})
    odd = spark.createDataFrame([(None, None, None, None, None, "m", 2), (-5, "", "en", "s", 0, "m", 2), (-5, "", "en", "s", 0, "m", 2)], docs.schema)
    now = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        root = scratch(spark, "stage-test")
        stage(spark, now, path).write.parquet(root)
        after = spark.read.parquet(root)
        if name != "mix":
            assert after.columns == now.columns
            assert after.count() <= now.count()
        now = after
    assert 0 < now.count() < docs.count() and now.where("mix_taken <= 0").count() == 0
    assert "mine" in {r[0] for r in now.select("_quality").distinct().collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0
