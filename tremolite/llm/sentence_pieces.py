"""Encoding to and decoding from merge-type SentencePiece vocabularies.

A text's symbols are merged pair by pair in the order of an agenda: the adjacent pair whose piece scores highest goes first, of
equal scores the leftmost. No merge crosses a place that no piece of the vocabulary spans, so a text falls into segments there (a run
of space marks with the word behind it, or one symbol that no longer piece contains); each distinct segment of a task is merged
once and kept in a bounded cache. With every Arrow batch the sentencepiece library encodes the segments merged for it, and the ids must
agree; of a vocabulary without a symbol that keeps segments apart it encodes the whole texts.
"""

from __future__ import annotations

import codecs
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import prepare, raw_texts, table

NAME = "op12_sentence_pieces"
ORACLE = None
c, lit = F.col, F.lit
MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Segments that a task remembers, symbols of the longest one kept, bytes of text handled at once.
KEPT, KEPT_SIZE, PART = 250_000, 64, 1 << 20

codecs.register_error("tremolite_each", lambda e: ("�", e.start + 1))


def _segment_pattern(long: list[str]) -> str:
    """Matches the segments between places that no piece spans. Symbols belong to one class if a chain of pieces joins them."""
    if any(MARK in p.lstrip(MARK) for p in long):
        return "(?s:.+)"
    top: dict[str, str] = {}

    def find(x):
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    for p in long:
        symbols = p.lstrip(MARK)
        for a, b in zip(symbols, symbols[1:] or symbols, strict=False):
            top[find(a)] = find(b)
    classes: dict[str, list[str]] = {}
    for x in top:
        classes.setdefault(find(x), []).append(x)
    by_size = sorted((sorted(x) for x in classes.values()), key=len, reverse=True)
    sets = [*by_size[:5], [x for rest in by_size[5:] for x in rest]]
    some = "|".join(f"[{''.join(map(re.escape, x))}]+" for x in sets if x)
    return f"{MARK}+(?:{some})?|{some}|(?s:.)" if some else f"{MARK}+|(?s:.)"


class Vocabulary:
    """Pieces, scores and special ids of a model file, and the segments it allows."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(lib.vocab_size())
        special = [i for i in ids if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)]
        if any(lib.is_unused(i) for i in ids):
            raise ValueError("vocabularies with unused pieces are not handled")
        self.pieces = {lib.id_to_piece(i): i for i in ids if i not in set(special)}
        self.order = {p: -lib.get_score(i) for p, i in self.pieces.items()}
        self.bytes = {int(lib.id_to_piece(i)[3:5], 16): i for i in special if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        # what the normaliser does to spaces, seen from outside; anything beyond it is left to the library
        self.prefix = lib.normalize("a") == MARK + "a"
        self.plain = all(lib.normalize(x) == MARK * self.prefix + x.replace(" ", MARK) for x in (" a  b ", "\t　ﬁ① Á­​Ａ"))
        long = [p for p in self.pieces if len(p) > 1]
        self.segments = re.compile(_segment_pattern(long)).findall
        # a symbol that joins nothing, put in front of a segment to see it encoded alone
        self.lone = next((x for x in "\n\x00\x01" if self.plain and not any(x in p for p in long)), None) if not any(MARK in p.lstrip(MARK) for p in long) else None
        self.text = [b"" if lib.is_control(i) else " ⁇ ".encode() if lib.is_unknown(i) else bytes([int(lib.id_to_piece(i)[3:5], 16)]) if lib.is_byte(i)
                     else lib.id_to_piece(i).replace(MARK, " ").encode() for i in ids]
        self.control = np.array([lib.is_control(i) for i in ids])
        self.marked = np.array([x.startswith(b" ") and not lib.is_unknown(i) for i, x in enumerate(self.text)]) & self.prefix

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment: an agenda of adjacent pairs by score, then place."""
        out: list[int] = []
        for s in (self._merge_short if len(segment) <= KEPT_SIZE else self._merge_long)(segment):
            if s in self.pieces:
                out.append(self.pieces[s])
            elif s and self.bytes:
                out += [self.bytes[b] for b in s.encode()]
            elif s:
                out.append(self.unknown)
        return out

    def _merge_short(self, segment: str) -> list[str]:
        """The agenda as a plain list, an entry per symbol and its right neighbour: least first, the leftmost of equals."""
        last, get, symbols = float("inf"), self.order.get, list(segment)
        agenda = [get(a + b, last) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda and (best := min(agenda)) < last:
            at = agenda.index(best)
            symbols[at] += symbols.pop(at + 1)
            del agenda[at]
            if at < len(agenda):
                agenda[at] = get(symbols[at] + symbols[at + 1], last)
            if at:
                agenda[at - 1] = get(symbols[at - 1] + symbols[at], last)
        return symbols

    def _merge_long(self, segment: str) -> list[str]:
        """The agenda as a heap, for segments of any length."""
        order, symbols = self.order, list(segment)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        agenda = [(order[p], i, i + 1, p) for i in range(len(symbols) - 1) if (p := symbols[i] + symbols[i + 1]) in order]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != len(piece):
                continue  # one of the two was merged before
            symbols[left], symbols[right] = piece, ""
            after[left] = follow = after[right]
            if follow < len(symbols):
                before[follow] = left
                if (p := piece + symbols[follow]) in order:
                    heapq.heappush(agenda, (order[p], left, follow, p))
            lead = before[left]
            if lead >= 0 and (p := symbols[lead] + piece) in order:
                heapq.heappush(agenda, (order[p], lead, left, p))
        return symbols

    def normal(self, text: str) -> str:
        if not self.plain:
            return self.library.normalize(text)
        return MARK * (self.prefix and bool(text)) + text.replace(" ", MARK)


class _Cache(dict):
    """Segment to the bytes of its ids, in two generations: when the younger is full the older goes. `fresh`: merged since the last check."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older, self.fresh = vocabulary, {}, []

    def __missing__(self, segment):
        raw = self.older.get(segment)
        if raw is None:
            ids = self.vocabulary.merge(segment)
            self.fresh.append((segment, ids))
            raw = array("i", ids).tobytes()
        if len(segment) <= KEPT_SIZE:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[segment] = raw
        return raw

    def check(self) -> None:
        """The library's ids of the segments merged since the last call, many in one text with the lone symbol between them."""
        library, lone, fresh = self.vocabulary.library, self.vocabulary.lone, self.fresh
        self.fresh, front, between = [], library.encode(lone), self.vocabulary.merge(lone)
        for at in range(0, len(fresh), 500):
            some = fresh[at:at + 500]
            ours = list(front[:-len(between)])
            for _, ids in some:
                ours += between
                ours += ids
            _agree(some[0][0], ours, library.encode(lone + lone.join(x for x, _ in some)))


def _agree(text: str, ours: list[int], theirs: list[int]) -> None:
    if ours != theirs:
        raise ValueError(f"ids differ from the library's at or behind the text {text[:80]!r}")


def _parts(text: str, whole: bool) -> Iterator[str]:
    """A long text cut at single spaces: the mark in front of the next part stands for the space that falls away."""
    at = 0
    while not whole and len(text) - at > PART:
        cut = text.find(" ", at + PART)
        while cut > 0 and (text[cut - 1] in (" ", MARK) or text[cut + 1:cut + 2] in (" ", MARK, "")):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


_READY: dict[bytes, tuple[Vocabulary, _Cache]] = {}


def _ready(model: bytes) -> tuple[Vocabulary, _Cache]:
    """One vocabulary and cache per Python worker."""
    if model not in _READY:
        vocabulary = Vocabulary(model)
        _READY[model] = vocabulary, _Cache(vocabulary)
    return _READY[model]


def _list_array(values: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(values), np.intc)))


def encoder(model: bytes, check: bool = True):
    """An Arrow function from texts to lists of ids. With `check`, every segment merged for a batch must equal what the library makes of it."""
    def encode(texts: pa.Array) -> pa.Array:
        vocabulary, cache = _ready(model)
        whole = not (vocabulary.plain and vocabulary.prefix)
        parts, owner = [], []
        for i, raw in enumerate(raw_texts(texts)):
            for part in _parts((raw or b"").decode("utf-8", "replace"), whole):
                parts.append(part)
                owner.append(i)
        ids = [b"".join(map(cache.__getitem__, vocabulary.segments(vocabulary.normal(x)))) for x in parts]
        if check and vocabulary.lone is not None:
            cache.check()
        elif check:
            for part, raw in zip(parts, ids, strict=True):
                _agree(part, np.frombuffer(raw, np.intc).tolist(), vocabulary.library.encode(part))
        cache.fresh.clear()
        out = [b""] * len(texts)
        for i, x in zip(owner, ids, strict=True):
            out[i] = out[i] + x if out[i] else x
        return _list_array(out)
    return encode


def decoder(model: bytes):
    """An Arrow function from lists of ids to texts."""
    def decode(lists: pa.Array) -> pa.Array:
        vocabulary, _ = _ready(model)
        size = np.array([len(x) for x in vocabulary.text])
        begin, pool = np.r_[0, np.cumsum(size)[:-1]], np.frombuffer(b"".join(vocabulary.text), np.uint8)
        out: list[str] = []
        for one in lists:
            ids = np.asarray(one.values.to_numpy(zero_copy_only=False), np.int64) if one.is_valid else np.empty(0, np.int64)
            text = []
            for at in range(0, len(ids), 1 << 20):
                some = ids[at:at + (1 << 20)]
                n = size[some]
                ends = np.cumsum(n)
                where = np.repeat(begin[some] - (ends - n), n) + np.arange(ends[-1])
                text.append(pool[where].tobytes())
            raw = b"".join(text)
            first = ids[~vocabulary.control[ids]][:1]
            if len(first) and vocabulary.marked[first[0]]:
                raw = raw[1:]
            out.append(raw.decode("utf-8", "tremolite_each"))
        return pa.array(out, pa.string())
    return decode


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids", check: bool = True) -> DataFrame:
    """`docs` plus `out`: the ids of the whole text, array<int>, without begin and end ids.

    The model file at `path` is read on the driver and travels with the function (half a megabyte). Null and empty texts have no
    ids. Long texts are taken in parts, cut where a mark can stand for the space. Rows are independent, so repeats
    and an empty table need no care; a column `out` of the input is replaced, other columns pass through.
    """
    return docs.withColumn(out, ids_of(c(text).cast("string"), read_model(path), check))


def ids_of(text: Column, model: bytes, check: bool = True) -> Column:
    return F.arrow_udf(encoder(model, check), "array<int>")(text)


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`docs` plus `out`: the text of the ids. Null and empty lists give an empty text; each byte that is no UTF-8 becomes U+FFFD."""
    return docs.withColumn(out, F.arrow_udf(decoder(read_model(path)), "string")(c(ids)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(MODEL)
    both = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", c("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
