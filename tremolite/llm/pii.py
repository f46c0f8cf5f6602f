"""Personal data with column functions only: patterns propose spans, checksums confirm them, words in front adjust the score.

All patterns use possessive or single-character repetition and look behind for the start of a run, so they run in linear time
and constant stack on any text; for the base kinds they return what the plain pattern would, leftmost and non-overlapping.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

NAME = "op3_pii"
ORACLE = None
c, lit = F.col, F.lit

_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
NEAR = 40


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Checksum of the digits in `number`: every second digit from the right is doubled, nines are cast out."""
    marks = F.split(F.reverse(digits(number)), "")
    values = F.transform(marks, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(values, lit(0), lambda s, v: s + F.coalesce(v, lit(0))) % 10 == 0


def mod97(account: Column) -> Column:
    """Checksum of an international account number: the first four characters go last, letters count as 10 to 35."""
    plain = F.replace(account, lit(" "), lit(""))
    marks = F.split(F.concat(F.substr(plain, lit(5)), F.substring(plain, 1, 4)), "")
    step = lambda s, x: F.when(x.rlike("[0-9]"), (s * 10 + x.cast("int")) % 97).when(x == "", s).otherwise((s * 100 + F.ascii(x) - 55) % 97)
    return F.aggregate(marks, lit(0), step) == 1


def _between(x: Column, low: int, high: int) -> Column:
    return F.length(digits(x)).between(low, high)


@dataclass(frozen=True)
class Kind:
    """`hint`: a cheap test whether a text can hold the pattern. `sure`: the validator. `score`: of a confirmed span, before context."""

    name: str
    pattern: str
    hint: str
    sure: Callable[[Column], Column]
    score: float
    words: str
    base: bool = False


KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: lit(True), 0.8, "mail|contact|write", True),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), 0.6, "ip|address|server|host", True),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])", "", luhn, 0.7, "card|visa|credit|pay", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", lambda m: _between(m, 8, 15), 0.7, "phone|call|tel|mobile|fax", True),
    # added by the method: a span below the threshold is dropped
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", mod97, 0.7, "iban|account|bank|konto"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", lambda m: lit(True), 0.3, "ssn|social|security"),
    Kind("card_short", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}+(?![ -]?[0-9])", "", luhn, 0.4, "card|visa|amex|credit"),
)
THRESHOLD, CONTEXT = 0.6, 0.3
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,byte_start:bigint,byte_end:bigint,score:double>>"


def _spans(k: Kind) -> Column:
    """Confirmed spans of one kind, from the matches and the gaps between them."""
    pairs = F.zip_with(F.slice(c(f"_gap_{k.name}"), 1, F.size(c(f"_hit_{k.name}"))), c(f"_hit_{k.name}"), lambda g, m: F.struct(g.alias("g"), m.alias("m")))

    def step(s, x):
        start, bstart = s["at"] + F.length(x["g"]), s["byte_at"] + F.octet_length(x["g"])
        end, bend = start + F.length(x["m"]), bstart + F.octet_length(x["m"])
        near = F.lower(F.substring(x["g"], -NEAR, NEAR)).rlike(rf"\b(?:{k.words})")
        score = lit(k.score) + F.when(near, CONTEXT).otherwise(0.0)
        keep = k.sure(x["m"]) & (lit(True) if k.base else score >= THRESHOLD)
        span = F.struct(lit(k.name).alias("kind"), start.alias("start"), end.alias("end"), bstart.alias("byte_start"), bend.alias("byte_end"),
                        F.least(score, lit(1.0)).alias("score"))
        return F.struct(end.alias("at"), bend.alias("byte_at"), F.when(keep, F.array_append(s["out"], span)).otherwise(s["out"]).alias("out"))

    start = F.struct(lit(0).cast("bigint").alias("at"), lit(0).cast("bigint").alias("byte_at"), F.expr(f"CAST(array() AS {_SPAN})").alias("out"))
    return F.when(F.size(c(f"_hit_{k.name}")) > 0, F.aggregate(pairs, start, step, lambda s: s["out"])).otherwise(F.expr(f"CAST(array() AS {_SPAN})"))


def find_spans(docs: DataFrame, text: str = "text", out: str = "_pii") -> DataFrame:
    """`docs` plus `out`: per row an array of spans (kind, start, end, byte_start, byte_end, score), by kind, then start.

    Start and end count code points, the byte positions UTF-8 bytes; ends are exclusive. Null and empty texts have an empty
    array. Other columns pass through, repeated rows are judged one by one, an empty table stays empty.
    """
    x = F.coalesce(c(text), lit(""))
    none = F.expr("CAST(array() AS array<string>)")
    hints = {k.name: x.contains(k.hint) if k.hint else x.rlike("[0-9]{2}|[0-9][ -][0-9]") for k in KINDS}
    df = docs.withColumns({f"_hit_{k.name}": F.when(hints[k.name], F.regexp_extract_all(x, lit(k.pattern), lit(0))).otherwise(none) for k in KINDS})
    df = df.withColumns({f"_gap_{k.name}": F.when(F.size(f"_hit_{k.name}") > 0, F.split(x, k.pattern, -1)).otherwise(none) for k in KINDS})
    df = df.withColumns({f"_span_{k.name}": _spans(k) for k in KINDS})
    return df.withColumn(out, F.concat(*[c(f"_span_{k.name}") for k in KINDS])).drop(*[f"_{p}_{k.name}" for p in ("hit", "gap", "span") for k in KINDS])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every span of personal data replaced by its kind in angle brackets; overlapping spans become one.

    A null text stays null. The text is cut by byte position, so each piece is copied once whatever the length.
    """
    found = find_spans(docs, text, "_pii")
    ordered = F.array_sort(F.transform(c("_pii"), lambda s: F.struct(s["byte_start"].alias("s"), s["byte_end"].alias("e"), s["kind"].alias("k"))))

    def merge(acc, x):
        last = F.element_at(acc, -1)
        joined = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["k"].alias("k"))
        overlaps = (F.size(acc) > 0) & (F.try_element_at(acc, lit(-1))["e"] > x["s"])
        return F.when(overlaps, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, lit(0))), F.array(joined))).otherwise(F.array_append(acc, x))

    empty = F.expr("CAST(array() AS array<struct<s:bigint,e:bigint,k:string>>)")
    raw = c(text).cast("binary")
    found = found.withColumn("_cut", F.aggregate(ordered, empty, merge))
    cut = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    end_before = lambda i: F.coalesce(F.try_element_at(c("_cut"), F.when(i > 0, i).otherwise(F.size(c("_cut")) + 1))["e"], lit(0))
    parts = F.transform(c("_cut"), lambda s, i: F.concat(cut(end_before(i), s["s"]), lit("<"), F.upper(s["k"]), lit(">")))
    tail = cut(F.element_at(c("_cut"), -1)["e"], F.octet_length(raw).cast("bigint"))
    clean = F.when(F.size("_cut") > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(c(text))
    return found.withColumn(text, clean).drop("_cut", "_pii")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = [k.name for k in KINDS if k.base]
    count = lambda kind: F.size(F.filter(c("_pii"), lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in base],
                        F.sha2(show(F.filter(c("_pii"), lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), show(c("_pii")).alias("spans"))
