"""Spelling variants by permuterm rotations.

A word of L letters has L + 1 rotations of the word with a terminator behind it. A rotation that ends in the letter x is filed under
its prefix without x, and every rotation is filed under itself. Then all words that differ in that letter alone stand in one
prefix range (replacements), and so does the word that lacks it (insertions, deletions). A range holds at most one word per letter of the
alphabet and the word without it: 91 members, whatever the input. The rotations are sorted, the ranges scanned, and
per member one row leaves a range: how many near words it has there and the most frequent of them.

Rotations of over PLAIN symbols are filed by a 122-bit fingerprint, so a word of any length costs memory in proportion to it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.sinks import materialized
from .common import pieces, prepare, raw_texts, table

NAME = "op11_spelling"
ORACLE = None  # SQL here has no crc32
c, lit = F.col, F.lit
#: Contract values: noise divisor, least length in code points, least count, how often a form must stand for a word.
NOISE, LEAST, SEEN, FACTOR = 97, 5, 3, 2
END, PLAIN = "$", 256
#: Distinct words that a map task holds before it hands over their counts.
HELD = 200_000

# One byte per code point (Latin-1): A-Z to a-z, letters stay, all else is a gap.
_LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 0xC0 else 32 for x in range(256))


def runs(raw: bytes) -> list[bytes]:
    """Maximal runs of letters, A-Z lower-cased, in Latin-1; code points beyond it are gaps."""
    return raw.decode("utf-8", "replace").encode("latin-1", "replace").translate(_LETTERS).split()


def noised(run: bytes, prefix: int) -> bytes:
    """The run, less one letter where the checksum of document and run says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def emit():
        words = pa.array([w.decode("latin-1") for w in total], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], names=["word", "n"])

    for b in batches:
        for doc, raw in zip(b.column(0).to_pylist(), raw_texts(b.column(1)), strict=True):
            prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for piece in pieces(raw or b""):
                for run, n in Counter(runs(piece)).items():
                    if len(run) >= LEAST and len(word := noised(run, prefix)) >= LEAST:
                        total[word] += n
                if len(total) >= HELD:
                    yield emit()
                    total.clear()
    yield emit()


def count_words(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(word, n) of the words seen SEEN times or more; tasks send one row per distinct word."""
    own = docs.select(c(doc_id).cast("string").alias("doc"), c(text).cast("string").alias("text"))
    return own.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(c("n") >= SEEN)


_ROTATION = "key string, x string, first boolean, n long, ref string"
_MOD, _BASES = (1 << 61) - 1, (0x1F3D5B79A2C4E680, 0x0A5C3E7192B4D6F8)


def _long_rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of `rotations` for long words: fingerprints of the rotations come from those of the word's prefixes."""
    schema = pa.schema([("key", pa.string()), ("x", pa.string()), ("first", pa.bool_()), ("n", pa.int64()), ("ref", pa.string())])

    def rows(word, n):
        size, ref = len(word), reference(word)
        sums, powers = [], []
        for base in _BASES:
            s, p = [0], [1]
            for ch in word:
                s.append((s[-1] * base + ord(ch)) % _MOD)
                p.append(p[-1] * base % _MOD)
            sums.append(s)
            powers.append([*p, p[-1] * base % _MOD])

        def key(start, stop):  # word[start:] + END + word[:stop]
            if size - start + 1 + stop <= PLAIN:
                return word[start:] + END + word[:stop]
            prints = []
            for base, s, p in zip(_BASES, sums, powers, strict=True):
                tail = (s[size] - s[start] * p[size - start]) % _MOD
                prints.append(((tail * base + ord(END)) * p[stop] + s[stop]) % _MOD)
            return f"#{size - start + 1 + stop}:{prints[0]:x}:{prints[1]:x}"

        for i in range(size + 1):
            yield key(i, i), "", False, n, ref
            if i:
                yield key(i, i - 1), word[i - 1], i == 1 or word[i - 2] != word[i - 1], n, ref

    for b in batches:
        held = []
        for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for row in rows(word, n):
                held.append(row)
                if len(held) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def reference(word: str) -> str:
    """What stands for a word in rotations and ranges: long words go by their digest."""
    return word if len(word) < PLAIN else "#" + hashlib.sha256(word.encode()).hexdigest()


def rotations(words: DataFrame) -> DataFrame:
    """(key, x, first, n, ref): every rotation under itself (x empty) and under its prefix without its last letter x.

    `first`: no equal letter stands in front of x, so a word and the one without x meet in one range only. `ref` names a long
    word; a short one is told by key and x.
    """
    w = c("word")
    at = F.explode(F.sequence(lit(0), F.length(w))).alias("i")
    turned = words.where(F.length(w) < PLAIN).select("word", "n", at).select(
        F.concat(F.substr(w, c("i") + 1), lit(END), F.left(w, c("i"))).alias("r"), "n", "i")
    last = F.right("r", lit(1))
    none = lit(None).cast("string")
    filed = F.array(F.struct(c("r").alias("key"), lit("").alias("x"), lit(False).alias("first"), c("n"), none.alias("ref")),
                    F.when(c("i") > 0, F.struct(F.left("r", F.length("r") - 1).alias("key"), last.alias("x"),
                                                (F.left(F.right("r", lit(2)), lit(1)) != last).alias("first"), c("n"), none.alias("ref"))))
    short = turned.select(F.inline(F.array_compact(filed)))
    long = words.where(F.length(w) >= PLAIN).select("word", "n")
    return short if long.isEmpty() else short.unionByName(long.mapInArrow(_long_rotations, _ROTATION))


_NEAR = "ref string, near long, form_n long, form string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rotations to the near words of each range; a range may go on in the next batch."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        t = t.combine_chunks()
        key = t.column("key").chunk(0) if t.num_rows else None
        if not t.num_rows:
            continue
        same = pc.equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
        new = [0, *((~same).nonzero()[0] + 1).tolist()]
        held = t.slice(new[-1])
        yield _ranges(t.slice(0, new[-1]), new[:-1], new[1:])
    if held is not None:
        yield _ranges(held, [0], [held.num_rows])


def _ranges(t: pa.Table, starts: list[int], ends: list[int]) -> pa.RecordBatch:
    out: list[tuple] = []
    several = [(s, e) for s, e in zip(starts, ends, strict=True) if e - s > 1]
    if several:
        keep = [i for s, e in several for i in range(s, e)]
        key, x, first, n, ref = (col.to_pylist() for col in t.take(keep).columns)
        at = 0
        for s, e in several:
            to = at + e - s
            tail, _, head = key[at].partition(END)
            names = [r or head + y + tail for r, y in zip(ref[at:to], x[at:to], strict=True)]
            out += _near(names, x[at:to], first[at:to], n[at:to], key[at].startswith("#"))
            at = to
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["ref", "near", "form_n", "form"])


def _near(names, x, first, n, long) -> Iterator[tuple]:
    """Per member the number of near words in this range and the best; per link where words go by digest, which has no order."""
    best = sorted(range(len(names)), key=lambda i: (-n[i], names[i]))
    plain, ready = len(names) - x.count(""), sum(first)
    for i, name in enumerate(names):
        near = plain - 1 + (plain < len(names) and first[i]) if x[i] else ready
        if not near:
            continue
        links = (j for j in best if j != i and (x[j] or first[i] if x[i] else first[j]))
        if long:
            yield from ((name, 1, n[j], names[j]) for j in links)
        else:
            j = next(links)
            yield name, near, n[j], names[j]


def variants(words: DataFrame) -> DataFrame:
    """(word, n) plus n_near, form and form_n: a word's most frequent near word, if it stands FACTOR times as often or more."""
    rows = rotations(words)
    near = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_scan, _NEAR)
    long = words.where(F.length("word") >= PLAIN)
    if not long.isEmpty():
        near = materialized(near, "near")
        full = long.select(F.concat(lit("#"), F.sha2("word", 256)).alias("ref"), c("word").alias("_full"))
        for x in ("ref", "form"):
            near = near.join(full.withColumnRenamed("ref", x), x, "left").withColumn(x, F.coalesce("_full", x)).drop("_full")
    best = near.groupBy(c("ref").alias("word")).agg(F.sum("near").alias("n_near"), F.min(F.struct((-c("form_n")).alias("n"), c("form").alias("w"))).alias("_best"))
    both = words.select("word", "n").join(best, "word", "left")
    fits = -c("_best.n") >= FACTOR * c("n")
    return both.select("word", "n", F.coalesce("n_near", lit(0)).cast("long").alias("n_near"), F.when(fits, c("_best.w")).alias("form"), F.when(fits, -c("_best.n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, by pointer doubling. Counts double along a chain, so six rounds reach the end of any."""
    now = forms.where("form IS NOT NULL").select("word", c("form").alias("root"))
    for _ in range(8):
        now = materialized(now, "roots")
        step = now.select(c("word").alias("root"), c("root").alias("_next"))
        joined = now.join(step, "root", "left")
        if now.join(step, "root", "left_semi").isEmpty():
            return now
        now = joined.select("word", F.coalesce("_next", "root").alias("root"))
    raise RuntimeError("a chain of forms did not end")


def group_spellings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Words are maximal runs of letters (A-Z lower-cased, U+00C0 to U+00FF as they are) of LEAST code points seen SEEN times in whole
    texts. Null and empty texts have none; a null id counts as an empty one; repeated rows count again; texts of any length are read in
    pieces cut at white space. Near words of equal count go by code-point order. Other columns are not read, so their names can't
    clash. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    words = materialized(count_words(docs, doc_id, text), "words")
    forms = materialized(variants(words), "forms")
    return forms.join(roots(forms), "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = group_spellings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")
