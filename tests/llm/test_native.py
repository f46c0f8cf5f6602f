"""URL filter, chat formatting and personal data against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tremolite.llm import chat, pii, url_filter

URLS = [None, "", "no scheme/x", "http://", "http://com/en/", "https://EXAMPLE.com/en/7x", "http://a.b.example.com/en/6?x=/en/7", "http://notexample.com/en/7",
        "http://example.net/de/8#f", "http://example.net/de/9", "http://x.org/es", "http://x.org/es/", "http://user@example.com:80/en/1", "a://b://c/en/",
        "http://com.com/en/" + "y" * 5000, "http://" + "a." * 300 + "net/de/8", "http://example.com/en/7", "http://example.com/en/7", "http://org?/es/", "http://ÄB.com/en/ü"]


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in host)
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "key", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, rule int")
    got = url_filter.judge(pages, url_filter.rule_table(spark, url_filter.RULES)).collect()
    assert len(got) == len(URLS)
    for r in got:
        assert (r["_url_host"], r["_url_path"], r["_url_rule"], r["_url_verdict"]) == plain_rule(r["url"])
    none = url_filter.judge(pages, spark.createDataFrame([], "host string, path string, verdict string"))
    assert {r["_url_verdict"] for r in none.collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark, url_filter.RULES)).count() == 0


def test_url_precedence(spark):
    rules = spark.createDataFrame([("a.com", "/x", "allow"), ("a.com", "/x", "block"), ("com", "/x/yyyy", "allow"), ("b.com", "", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://a.com/x/yyyy"), (3, "http://z.b.com"), (4, "http://b.com/q")], "page_id long, url string")
    got = {r["page_id"]: (r["_url_rule"], r["_url_verdict"]) for r in url_filter.judge(pages, rules).collect()}
    assert got == {1: ("a.com/x", "block"), 2: ("com/x/yyyy", "allow"), 3: ("b.com", "block"), 4: ("b.com", "block")}


CHATS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "a <|user|> b"), (1, 2, "user", "</s>\n<\\/s>"), (1, 3, "assistant", "x <|+|> <\\\\|y"), (1, 4, "assistant", None), (1, 5, "assistant", "é😀<"),
    (2, 0, "we|>ird", "|+|>"), (2, 0, "we|>ird", "|+|>"), (2, None, "<|>", "tail <"), (2, 0, None, "<"), (2, 1, "assistant", "|"), (None, 0, "assistant", "lone"), (None, 1, "+", "plus"),
    (3, 0, "user", ""), (4, 9, "user", "<" + "\\" * 3000 + "|" + "z" * 20000),
]


def plain_turns(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {k: [(r, t) for *_, r, t in sorted(v)] for k, v in out.items()}


def test_chat_round_trip(spark):
    long = [(5, i, "assistant" if i % 3 else "user", f"turn {i} </s>") for i in range(1500)]
    df = spark.createDataFrame([(*r, "extra") for r in CHATS + long], "conv_id long, turn long, role string, text string, formatted string")
    got = chat.format_chats(df).select("conv_id", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = plain_turns(CHATS + long)
    assert len(got) == len(want)
    for r in got:
        turns = want[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["loss"] == [t for role, t in turns if role == "assistant"]
        assert [len(r["formatted"][s["start"]:s["end"]]) for s in r["loss_spans"]] == [s["end"] - s["start"] for s in r["loss_spans"]]
        assert r["formatted"].count("</s>\n") == sum(1 for a, b in zip([(None, "")] + turns, turns) if a[0] != b[0])
    assert chat.format_chats(df.limit(0)).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(d):
    total = sum(int(x) if i % 2 == 0 else (int(x) * 2 - 9 if int(x) > 4 else int(x) * 2) for i, x in enumerate(reversed(d)))
    return total % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x or "0") <= 255 for x in m.group().split(".")) if kind == "ip" else False,
                  "card": 16 <= len(d) <= 19 and plain_luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [None, "", " ", "a@b.c_d@e.f@g.h", "x a.b+c@d-e.com.", "@a.b a@b a@b.c", "1.2.3.4.5.6.7.8 300.1.1.1 0000255.001.0.9 1.2.3", "é😀 4111 1111 1111 1111 x", "4111-1111-1111-11111", "41111111111111112345678",
         "+1 (555) 010-9999 +1234567 +12345678 +1((((((( 2+3 44444444", "DE89 3704 0044 0532 0130 00", "IBAN GB82 WEST 1234 5698 7654 32!", "ssn 123-45-6789 and 987-65-4321", "call 378282246310005", "visa card 378282246310005",
         "9" * 30000, "a" * 30000 + "@", "a." * 20000, "1 2-3" * 5000, "+1" + " (" * 20000, "x@y.z " * 400 + "4111111111111111"]


def test_personal_data(spark):
    docs = spark.createDataFrame([(i % 5, t, "spans") for i, t in enumerate(TEXTS)] , "doc_id long, text string, spans string")
    base = [k.name for k in pii.KINDS if k.base]
    for r in pii.find_spans(docs).collect():
        got = [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["_pii"] if s["kind"] in base]
        assert got == plain_base(r["text"] or ""), (r["text"] or "")[:80]
        raw = (r["text"] or "").encode()
        for s in r["_pii"]:
            assert raw[s["byte_start"]:s["byte_end"]].decode() == r["text"][s["start"]:s["end"]]
    kinds = {(r["text"] or "")[:20]: {s["kind"] for s in r["_pii"]} for r in pii.find_spans(docs).collect()}
    assert "iban" in kinds["DE89 3704 0044 0532 "] and "iban" in kinds["IBAN GB82 WEST 1234 "]
    assert kinds["ssn 123-45-6789 and "] == {"ssn"} and kinds["call 378282246310005"] == set() and kinds["visa card 3782822463"] == {"card_short"}
    clean = {r["text"] for r in pii.redact(docs).collect()}
    assert None in clean and "" in clean and "é😀 <CARD> x" in clean and "ssn <SSN> and 987-65-4321" in clean and "<EMAIL> " * 400 + "<CARD>" in clean
    assert pii.redact(docs).columns == docs.columns
    assert pii.find_spans(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_personal_data_of_table(spark, sf):
    for r in pii.query(spark, f"/root/testdata/{sf}").join(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), "doc_id").collect():
        want = plain_base(r["text"] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x.split(":")[0] in BASE] == want or not want
        assert [r[f"n_{k}"] for k in BASE] == [sum(x.startswith(k + ":") for x in want) for k in BASE]
