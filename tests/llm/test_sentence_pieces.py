"""Ids and texts against the sentencepiece library, and the agenda against a plain merge loop."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tremolite.llm import sentence_pieces as sp

PATH = public_tokenizers.path(sp.MODEL)
MODEL = sp.read_model(PATH)
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
HARD = ["", " ", "   ", "▁", "a▁ ▁b", " lead and  two   spaces ", "tab\tnew\nline\r\n", "漢字かな交じり文 🎉🎉 é é", "\x00\x01", "<s> </s> <unk> <0x41>", "1234567890,5%",
        "don't 'quoted' x_y-z/(a)[b]{c}", "a" * 500, "ab" * 4000, "ÀÉÎõü×÷", "ᚠᛇᚻ ﬁ ①", "end "]


def mixed(rng, n):
    return "".join(rng.choice(["the ", "ing", "tion ", "é", "▁", " ", "  ", "\n", "7", "zq", "漢", "😀", "Über", ".", "'s"]) for _ in range(n))


@pytest.mark.parametrize("part", [1 << 20, 50])
def test_like_the_library(monkeypatch, part):
    monkeypatch.setattr(sp, "PART", part)
    rng = random.Random(1)
    texts = HARD + [mixed(rng, rng.randrange(400)) for _ in range(200)]
    ids = sp.encoder(MODEL, check=False)(pa.array([*texts, None]))
    assert ids.to_pylist() == [*LIB.encode(texts), []]
    assert sp.decoder(MODEL)(ids).to_pylist() == [*LIB.decode(LIB.encode(texts)), ""]


def test_agenda_like_a_plain_loop():
    v, rng = sp.Vocabulary(MODEL), random.Random(2)
    for _ in range(400):
        text = rng.choice(["", "▁"]) + "".join(rng.choices("thenioasrd", k=rng.randrange(1, 40)))
        parts = list(text)
        while True:
            pairs = [(v.order[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in v.order]
            if not pairs:
                break
            i = min(pairs)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        assert v._merge_short(text) == parts and [x for x in v._merge_long(text) if x] == parts


def test_segments_span_no_piece():
    v = sp.Vocabulary(MODEL)
    pairs = {p[i:i + 2] for p in v.pieces for i in range(len(p) - 1)}
    for text in [*HARD, mixed(random.Random(3), 5000)]:
        normal = v.normal(text)
        cut = v.segments(normal)
        assert "".join(cut) == normal and not any(a[-1] + b[0] in pairs for a, b in zip(cut, cut[1:], strict=False))


def test_any_ids_decode_like_the_library():
    rng = random.Random(4)
    lists = [rng.choices(range(300), k=rng.randrange(12)) for _ in range(300)] + [rng.choices(range(32000), k=30) for _ in range(100)] + [[259], [1, 259, 259], [0, 5], [2], [5, 259, 5]]
    assert sp.decoder(MODEL)(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == [LIB.decode(x) for x in lists]


@pytest.mark.parametrize("lone", [True, False])
def test_check_finds_wrong_ids(monkeypatch, lone):
    broken = sp.Vocabulary(MODEL)
    assert broken.lone == "\n"
    if not lone:
        broken.lone = None
    monkeypatch.setitem(sp._READY, MODEL, (broken, sp._Cache(broken)))
    assert sp.encoder(MODEL)(pa.array(HARD)).to_pylist() == LIB.encode(HARD)
    broken.order = {k: -v for k, v in broken.order.items()}
    with pytest.raises(ValueError, match="differ"):
        sp.encoder(MODEL)(pa.array(["a strange tokenisation"]))


def test_small_cache(monkeypatch):
    monkeypatch.setattr(sp, "KEPT", 3)
    monkeypatch.setattr(sp, "KEPT_SIZE", 6)
    monkeypatch.setitem(sp._READY, MODEL, (v := sp.Vocabulary(MODEL), sp._Cache(v)))
    assert sp.encoder(MODEL)(pa.array(HARD)).to_pylist() == LIB.encode(HARD) and len(sp._READY[MODEL][1]) <= 3 >= len(sp._READY[MODEL][1].older)


def test_tables(spark):
    rows = [(i, t, "kept", i) for i, t in enumerate([*HARD, None, "long words " * 200_000])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids int")
    got = sp.decode(sp.encode(df, PATH), PATH)
    assert got.columns == df.columns
    for r in got.collect():
        want = LIB.encode(rows[r["doc_id"]][1] or "")
        assert r["ids"] == want and r["decoded"] == LIB.decode(want)
    assert sp.decode(sp.encode(df.limit(0), PATH), PATH).count() == 0
    assert sp.query(spark, "/root/testdata/sf0.001").count() == 200
