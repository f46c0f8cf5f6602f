"""Phrase collocations: level-wise candidates, counted by double-array tries.

Words are counted first. A candidate of k words is a phrase whose both parts of k - 1 words are frequent and whose own support can reach
the least count; tasks report support capped at that count, which says whether a phrase may be frequent, not how frequent it is.
Frequent shorter phrases are known to the tasks by a bitmap of fixed size: a collision only lets a candidate
more through. The candidates are dealt into blocks of bounded size, a task builds a double-array trie of each, and the tries are broadcast, as many at
a time as a fixed number of bytes holds. Over every text all positions go through the trie at once, a level per word; the
states that accept are counted per task and the counts summed.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.sinks import materialized
from .common import prepare, raw_texts, table

NAME = "op13_collocations"
c, lit = F.col, F.lit
#: Contract values: longest phrase, least count, share of a longer phrase that drops a shorter one (per cent), rows per language.
LONGEST, LEAST, SWALLOWED, TOP = 3, 10, 50, 2000
#: Words and bytes that a task takes at once; bytes of phrases in a block; bytes of tries broadcast together; bits of the bitmap.
HELD, HELD_BYTES, BLOCK_BYTES, BROADCAST_BYTES, BITS = 500_000, 6 << 20, 4 << 20, 64 << 20, 1 << 27
#: Phrases whose counts travel together.
PAGE = 4096
STOP = "."
_FOLD = bytes(x + 32 if 65 <= x <= 90 else 46 if x in b".,;:!?\n\x0b\x0c\r" else 32 if x == 9 else x for x in range(256))


# --- texts to arrays of word numbers ------------------------------------------------------------------------------------


class Chunk:
    """Some texts of one language: `words` (distinct), `ids` per place (-1 between pieces), `fresh`: the first place not counted before."""

    def __init__(self, lang: str, tokens: list[pa.Array], fresh: int = 0):
        coded = pa.chunked_array(tokens, pa.string()).combine_chunks().dictionary_encode()
        self.lang, self.words, self.fresh = lang, coded.dictionary, fresh
        ids = coded.indices.to_numpy().astype(np.int64)
        self.ids = np.where(ids == pc.index(coded.dictionary, STOP).as_py(), -1, ids)

    def numbered(self, known: pa.Array) -> np.ndarray:
        """Per place the number of its word among the `known`, else -1."""
        place = pc.fill_null(pc.index_in(self.words, value_set=known), -1).to_numpy().astype(np.int64)
        return np.append(place, -1)[self.ids]


def tokens_of(folded: pa.Array) -> pa.Array:
    """The words of all texts in a row, a STOP at every end of a piece."""
    parts = pc.ascii_split_whitespace(pc.replace_substring(folded, STOP, f" {STOP} ")).flatten()
    return parts.filter(pc.greater(pc.binary_length(parts), 0))


def _fold(texts: pa.Array) -> pa.Array:
    _, offsets, data = texts.buffers()
    return pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_FOLD)), offset=texts.offset)


def _cut(raw: bytes, size: int) -> Iterator[bytes]:
    """The folded text in parts that end behind a space or a stop."""
    at = 0
    while at < len(raw):
        to = at + size
        if to < len(raw):
            ends = [x + 1 for x in (raw.find(b" ", to), raw.find(STOP.encode(), to)) if x >= 0]
            to = min(ends, default=len(raw))
        yield raw[at:to]
        at = to


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Texts (lang, text) in chunks of at most about HELD words; a phrase that spans two chunks of a text ends in the second."""
    stop, part_bytes = pa.array([STOP]), HELD_BYTES // 4
    held: dict[str, list[pa.Array]] = {}
    words = size = 0
    for b in batches:
        texts = b.column(1)
        long = pc.greater(pc.binary_length(texts), part_bytes)
        short = b.filter(pc.invert(long))
        for lang in pc.unique(short.column(0)).to_pylist():
            mine = _fold(short.column(1).filter(pc.equal(short.column(0), lang)))
            new = tokens_of(pc.binary_join_element_wise(mine, STOP, " "))
            held.setdefault(lang, []).append(new)
            words, size = words + len(new), size + mine.nbytes
        if words >= HELD or size >= HELD_BYTES:
            yield from (Chunk(x, t) for x, t in held.items())
            held, words, size = {}, 0, 0
        for lang, raw in zip(b.column(0).filter(long).to_pylist(), raw_texts(texts.filter(long)), strict=True):
            begun = []  # the last words of what was counted of this text
            for part in _cut(raw.translate(_FOLD), part_bytes):
                new = [*begun, tokens_of(pa.array([part], pa.binary()).cast(pa.string()))]
                yield Chunk(lang, new, sum(map(len, begun)))
                begun = [pa.concat_arrays(new)[-(LONGEST - 1):]]
            held.setdefault(lang, []).append(stop)
    yield from (Chunk(x, t) for x, t in held.items())
    pa.default_memory_pool().release_unused()


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(c(lang).cast("string"), lit("und")).alias("lang"), c(text).cast("string").alias("text")).where("text IS NOT NULL")


def _rows(lang: str, phrases: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(n), 50_000):
        some = n[at:at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(some)), phrases.slice(at, 50_000), pa.array(some, pa.int64())], names=["lang", "phrase", "n"])


# --- words, candidates --------------------------------------------------------------------------------------------------


def _count_words(batches):
    for chunk in chunks(batches):
        seen = chunk.ids[chunk.fresh:]
        n = np.bincount(seen[seen >= 0], minlength=len(chunk.words))
        keep = np.flatnonzero(n)
        yield from _rows(chunk.lang, chunk.words.take(pa.array(keep)), n[keep])


def _prints(lang: str, words: list[bytes]) -> np.ndarray:
    start = zlib.crc32(lang.encode() + b"\n")
    return np.array([zlib.crc32(w, start) for w in words], np.uint64)


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The bit of a pair of words from their prints; that of a word is its print modulo BITS."""
    x = (first << np.uint64(32) | second) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(32)) % np.uint64(BITS)


def _bits_of(batches):
    """The bits of phrases of one or two words."""
    for b in batches:
        out = []
        for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            p = _prints(lang, phrase.encode().split(b" "))
            out.append(int(p[0]) % BITS if len(p) == 1 else int(_mixed(p[:1], p[1:])[0]))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["at"])


def bitmap(phrases: DataFrame) -> bytes:
    """The phrases (lang, phrase) as BITS bits; pages of 4 kB are made by Spark, the driver puts at most BITS / 8 bytes in place."""
    at = phrases.select("lang", "phrase").mapInArrow(_bits_of, "at long").select((c("at") + 1).alias("at"))  # Spark numbers bits from 1
    pages = at.groupBy(F.bitmap_bucket_number("at").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = bytearray(max(BITS // 8, 4096))
    for r in pages.toLocalIterator():
        out[(r["page"] - 1) * 4096:r["page"] * 4096] = r["bits"]
    return bytes(out)


def _set(bits: bytes, at: np.ndarray) -> np.ndarray:
    return (np.frombuffer(bits, np.uint8)[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _candidates(length: int, words, pairs=None):
    """Distinct phrases of `length` words of a chunk whose parts may all be frequent, with their support capped at LEAST."""
    def run(batches):
        for chunk in chunks(batches):
            ids, prints = chunk.ids, _prints(chunk.lang, chunk.words.cast(pa.binary()).to_pylist())
            ok = np.append(_set(words.value, prints % np.uint64(BITS)), False)[ids]  # the last entry is that of -1
            two = np.flatnonzero(ok[:-1] & ok[1:])
            if length == 2:
                two = two[two + 1 >= chunk.fresh]
                key, n = np.unique(ids[two] << 32 | ids[two + 1], return_counts=True)
                parts = key >> 32, key & 0xFFFFFFFF
            else:
                pair = np.zeros(len(ids), bool)
                pair[two] = _set(pairs.value, _mixed(prints[ids[two]], prints[ids[two + 1]]))
                three = np.flatnonzero(pair[:-1] & pair[1:])
                three = three[three + 2 >= chunk.fresh]
                key, place = np.unique(ids[three] << 32 | ids[three + 1], return_inverse=True)
                long, n = np.unique(place << 32 | ids[three + 2], return_counts=True)
                first = key[long >> 32]
                parts = first >> 32, first & 0xFFFFFFFF, long & 0xFFFFFFFF
            for at in range(0, len(n), 200_000):
                some = slice(at, at + 200_000)
                phrases = pc.binary_join_element_wise(*[chunk.words.take(pa.array(p[some])) for p in parts], " ")
                yield from _rows(chunk.lang, phrases, np.minimum(n[some], LEAST))
    return run


# --- tries --------------------------------------------------------------------------------------------------------------


class Trie:
    """A double-array trie over word numbers. Child of state s by digit d: slot base[s] ^ d, if check[slot] == s.

    The states of first words are the words' own numbers; each further word is a step per digit of its number to the base 256,
    so that a family has at most 256 children and stays in one page of the arrays. `leaf` numbers the phrases by their state.
    """

    def __init__(self, phrases: list[list[bytes]]):
        often = Counter(w for p in phrases for w in p)
        number = {w: i for i, w in enumerate(sorted(often, key=lambda w: (-often[w], w)))}
        self.words = pa.array(number, pa.binary()).cast(pa.string())
        self.digits = 1 + (len(self.words) > 1 << 8) + (len(self.words) > 1 << 16) + (len(self.words) > 1 << 24)
        length = np.array([len(p) for p in phrases])
        path = np.full((len(phrases), LONGEST), -1, np.int64)
        for i, p in enumerate(phrases):
            path[i, :len(p)] = [number[w] for w in p]
        self.base, self.check = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self._extend(len(self.words))
        self.check[:] = -3  # kept for first words
        self.check[np.unique(path[:, 0])] = -2
        state, rng = path[:, 0].copy(), np.random.default_rng(0)
        for k in range(1, LONGEST):
            at = np.flatnonzero(length > k)
            for digit in self._split(path[at, k]):
                edge, back = np.unique(state[at] << 8 | digit, return_inverse=True)
                if len(edge):
                    self._place(edge >> 8, edge & 255, rng)
                    state[at] = (self.base[edge >> 8] ^ (edge & 255))[back]
        self.leaf = np.full(len(self.check), -1, np.int32)
        self.leaf[state] = np.arange(len(phrases))

    def _split(self, word: np.ndarray) -> list[np.ndarray]:
        return [word >> 8 * j & 255 for j in reversed(range(self.digits))]

    def _extend(self, slots: int) -> None:
        more = -(-slots // 256) * 256
        self.base, self.check = np.r_[self.base, np.zeros(more, np.int32)], np.r_[self.check, np.full(more, -1, np.int32)]

    def _place(self, parent: np.ndarray, digit: np.ndarray, rng) -> None:
        """Bases for all parents: families of equal size try random places together, large families first; of two that meet the first stays."""
        start = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        count = np.diff(np.r_[start, len(parent)])
        self._extend(len(parent) + len(parent) // 4)
        for n in np.unique(count)[::-1].tolist():
            left, tries = start[count == n], 0
            while len(left):
                digits = digit[left[:, None] + np.arange(n)]
                if tries and tries % 8 == 0:
                    self._extend(n * len(left))
                tries += 1
                free = np.flatnonzero(self.check == -1)
                if not len(free):
                    continue
                slots = (free[rng.integers(0, len(free), len(left))] ^ digits[:, 0])[:, None] ^ digits
                fits = (self.check[slots] == -1).all(1)
                owner = np.repeat(np.flatnonzero(fits), n)
                _, first = np.unique(slots[fits].ravel(), return_index=True)
                lost = np.ones(len(owner), bool)
                lost[first] = False
                fits[owner[lost]] = False
                self.check[slots[fits]] = parent[left[fits]][:, None]
                self.base[parent[left[fits]]] = slots[fits, 0] ^ digits[fits, 0]
                left = left[~fits]

    def count(self, ids: np.ndarray, fresh: int, phrases: int) -> np.ndarray:
        """How often each phrase stands in `ids` with its last word at `fresh` or later; all places advance together."""
        at = np.flatnonzero(ids >= 0)
        at = at[self.check[ids[at]] == -2]
        state, out = ids[at], np.zeros(phrases, np.int64)
        for k in range(1, LONGEST):
            go = at + k < len(ids)
            at, state = at[go], state[go]
            go = ids[at + k] >= 0
            at, state = at[go], state[go]
            for j in reversed(range(self.digits)):
                slot = self.base[state] ^ (ids[at + k] >> 8 * j & 255)
                go = self.check[slot] == state
                at, state = at[go], slot[go]
            leaf = self.leaf[state[at + k >= fresh]]
            out += np.bincount(leaf[leaf >= 0], minlength=phrases)
        return out


_TRIES = "block long, lang string, phrases long, size long, trie binary"


def _build(batches):
    """Rows (block, lang, phrase) sorted by block to one trie per block; phrases are numbered in byte order."""
    now, held = None, []

    def made():
        phrases = sorted(x.encode() for x in held)
        data = pickle.dumps(Trie([p.split(b" ") for p in phrases]), 5)
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([len(phrases)]), pa.array([len(data)]), pa.array([data], pa.binary())],
                                          names=["block", "lang", "phrases", "size", "trie"])

    for b in batches:
        for block, lang, phrase in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if (block, lang) != now:
                if held:
                    yield made()
                now, held = (block, lang), []
            held.append(phrase)
    if held:
        yield made()


def blocks(candidates: DataFrame) -> DataFrame:
    """`candidates` (lang, phrase) plus `block`: each language is dealt by the phrase's hash into blocks of about BLOCK_BYTES."""
    sizes = candidates.groupBy("lang").agg(F.sum(F.octet_length("phrase") + 16).alias("_bytes"))
    ways = F.ceil(c("_bytes") / BLOCK_BYTES).cast("long")
    return candidates.join(sizes, "lang").withColumn("block", F.pmod(F.xxhash64("phrase"), ways)).drop("_bytes")


def _count(tries: list):
    def run(batches):
        ready: dict[str, list] = {}
        for block, lang, phrases, trie in (x.value for x in tries):
            ready.setdefault(lang, []).append((block, phrases, trie))
        total = {}
        for chunk in chunks(batches):
            for block, phrases, trie in ready.get(chunk.lang, ()):
                n = trie.count(chunk.numbered(trie.words), chunk.fresh, phrases)
                key = chunk.lang, block
                total[key] = total[key] + n if key in total else n
        rows = []
        for (lang, block), n in total.items():
            for part in range(0, len(n), PAGE):
                page = n[part:part + PAGE]
                if (keep := np.flatnonzero(page)).size:
                    rows.append((lang, block, part // PAGE, keep.astype("<u2").tobytes(), page[keep].tobytes()))
        for at in range(0, len(rows), 200):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at:at + 200], strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                                             names=["lang", "block", "page", "places", "counts"])
    return run


_PAGES = "lang string, block long, page long, places binary, counts binary"


def _add_pages(batches):
    """Pages of counts, sorted by (lang, block, page), to one row per phrase with its sum."""
    now, total = None, np.zeros(PAGE, np.int64)

    def made():
        keep = np.flatnonzero(total)
        lang, block, page = now
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(keep)), pa.repeat(pa.scalar(block, pa.int64()), len(keep)), pa.array(keep + page * PAGE), pa.array(total[keep])],
                                          names=["lang", "block", "number", "n"])

    for b in batches:
        for lang, block, page, places, counts in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if (lang, block, page) != now:
                if now is not None:
                    yield made()
                now, total = (lang, block, page), np.zeros(PAGE, np.int64)
            total[np.frombuffer(places, "<u2")] += np.frombuffer(counts, np.int64)
    if now is not None:
        yield made()


def count_phrases(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(lang, phrase, n) of all candidates (lang, phrase): one pass over the texts per BROADCAST_BYTES of tries."""
    spark = texts.sparkSession
    dealt = materialized(blocks(candidates), "candidates")
    tries = dealt.select("block", "lang", "phrase").repartition("lang", "block").sortWithinPartitions("lang", "block").mapInArrow(_build, _TRIES)
    tries = materialized(tries, "tries")
    passes, size = [[]], 0
    for r in tries.select("lang", "block", "size").orderBy("lang", "block").toLocalIterator():
        if passes[-1] and size + r["size"] > BROADCAST_BYTES:
            passes.append([])
            size = 0
        passes[-1].append((r["lang"], r["block"]))
        size += r["size"]
    counted = None
    for some in passes:
        if not some:
            break
        wanted = " OR ".join("(lang = '{}' AND block = {})".format(a.replace("\\", "\\\\").replace("'", "\\'"), b) for a, b in some)
        rows = tries.where(wanted).select("block", "lang", "phrases", "trie").toLocalIterator()
        sent = [spark.sparkContext.broadcast((r["block"], r["lang"], r["phrases"], pickle.loads(r["trie"]))) for r in rows]
        pages = texts.mapInArrow(_count(sent), _PAGES).repartition("lang", "block", "page").sortWithinPartitions("lang", "block", "page")
        n = materialized(pages.mapInArrow(_add_pages, "lang string, block long, number long, n long"), "counts")
        for b in sent:
            b.destroy()
        counted = n if counted is None else counted.unionByName(n)
    if counted is None:
        return candidates.select("lang", "phrase", lit(0).cast("long").alias("n")).limit(0)
    numbers = dealt.repartition("lang", "block").sortWithinPartitions("lang", "block", "phrase").mapInArrow(_number, "lang string, block long, number long, phrase string")
    return numbers.join(counted, ["lang", "block", "number"]).select("lang", "phrase", "n")


def _number(batches):
    """The place of each phrase in its block, rows being sorted."""
    now, at = None, 0
    for b in batches:
        cols = {x: b.column(x) for x in ("lang", "block", "phrase")}
        place = []
        for key in zip(cols["lang"].to_pylist(), cols["block"].to_pylist(), strict=True):
            now, at = key, at + 1 if key == now else 0
            place.append(at)
        yield pa.RecordBatch.from_arrays([cols["lang"], cols["block"], pa.array(place, pa.int64()), cols["phrase"]], names=["lang", "block", "number", "phrase"])


# --- scores -------------------------------------------------------------------------------------------------------------


SALTS = 8


def _look_up(df: DataFrame, part: str, counts: DataFrame, out: str) -> DataFrame:
    """`df` plus the count of its phrase part; a part that begins very many phrases is spread by a salt."""
    salted = counts.select("lang", c("phrase").alias(part), c("n").alias(out), F.explode(F.sequence(lit(0).cast("long"), lit(SALTS - 1).cast("long"))).alias("_salt"))
    return df.withColumn("_salt", F.pmod(F.xxhash64("phrase"), lit(SALTS))).join(salted, ["lang", part, "_salt"]).drop("_salt")


def _score(a, left, right):
    """floor(1000000 a a / (left right)), exact to 38 digits."""
    big = lambda x: x.cast("decimal(16,0)")
    return F.call_function("div", (big(a) * big(a) * lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)"), big(left) * big(right)).cast("long")


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", top: int = TOP) -> DataFrame:
    """The `top` phrases per language: lang, rank, phrase, a, l, r, n, score.

    Phrases of 2 to LONGEST words inside a piece of text, counted in whole texts, overlaps included; those seen LEAST times or more
    are candidates. A null language is `und`; null and empty texts have no words but make no language; repeated rows count again;
    ties go by count, then by the phrase's bytes. Texts of any length are read in parts. Other columns are not read,
    so their names can't clash. An empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    texts = _texts(docs, lang, text)
    words = materialized(texts.mapInArrow(_count_words, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    often = words.where(c("n") >= LEAST)
    known = [spark.sparkContext.broadcast(bitmap(often))]
    found = []
    for length in range(2, LONGEST + 1):
        new = texts.mapInArrow(_candidates(length, *known), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        found.append(materialized(new.where(c("n") >= LEAST).select("lang", "phrase"), "level"))
        known.append(spark.sparkContext.broadcast(bitmap(found[-1])))
    for b in known:
        b.destroy()
    counts = materialized(count_phrases(texts, found[0].unionByName(found[1])), "phrases")
    w = F.split("phrase", " ")
    size = F.size(w)
    two = counts.where(size == 2).withColumns({"w1": w[0], "w2": w[1]})
    three = counts.where(size == 3).withColumns({"w1": w[0], "w3": w[2], "p1": F.concat_ws(" ", w[0], w[1]), "p2": F.concat_ws(" ", w[1], w[2])})
    swallow = three.select("lang", F.explode(F.array("p1", "p2")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("_longer"))
    two = two.join(swallow, ["lang", "phrase"], "left").where("_longer IS NULL OR 100 * _longer < %d * n" % SWALLOWED)
    two = _look_up(_look_up(two.withColumnRenamed("n", "a"), "w1", often, "l"), "w2", often, "r").withColumn("score", _score(c("a"), c("l"), c("r")))
    pairs = counts.where(size == 2)
    for part, source, out in (("w1", often, "l1"), ("p2", pairs, "r1"), ("p1", pairs, "l2"), ("w3", often, "r2")):
        three = _look_up(three, part, source, out)
    cut = lambda k: F.struct(_score(c("n"), c(f"l{k}"), c(f"r{k}")).alias("score"), lit(k).alias("k"), c(f"l{k}").alias("l"), c(f"r{k}").alias("r"))
    three = three.withColumn("_cut", F.least(cut(1), cut(2))).select("lang", "phrase", c("n").alias("a"), c("_cut.l").alias("l"), c("_cut.r").alias("r"), c("_cut.score").alias("score"))
    scored = two.select(*three.columns).unionByName(three)
    return first_rows(scored, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def first_rows(scored: DataFrame, top: int) -> DataFrame:
    """`rank` and the first `top` rows per language; each of 64 slices of a language first keeps its own `top`."""
    order = (c("score").desc(), c("a").desc(), c("phrase"))
    slim = scored.withColumn("_slice", F.pmod(F.xxhash64("phrase"), lit(64)))
    slim = slim.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).where(c("_place") <= top)
    return slim.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(c("rank") <= top).drop("_slice", "_place")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
v AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM v, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
q AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
s AS (SELECT q.lang, q.phrase, q.k, q.a, j, x.a AS l, y.a AS r, (1000000 * q.a::HUGEINT * q.a::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM q) q
  JOIN f x ON x.lang = q.lang AND x.k = q.j AND x.phrase = array_to_string(w[1:j], ' ')
  JOIN f y ON y.lang = q.lang AND y.k = q.k - q.j AND y.phrase = array_to_string(w[j + 1:], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM s) WHERE o = 1),
longer AS (SELECT lang, part, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM q WHERE k = 3) GROUP BY lang, part),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, encode(b.phrase)) AS rank
  FROM b LEFT JOIN longer ON b.k = 2 AND longer.lang = b.lang AND longer.part = b.phrase WHERE longer.a IS NULL OR 100 * longer.a < 50 * b.a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o JOIN t USING (lang) WHERE rank <= 2000
"""
