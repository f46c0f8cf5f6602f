"""Text quality by a byte-level convolutional network in NumPy.

Bytes are embedded, each with one more bit that says whether the GRAM bytes ending there occurred within the last REACH bytes (plain
filters can't see that a word is said again). Learned filters of WIDTH bytes run over the whole text in steps of STRIDE, their responses are max-pooled in
chunks of two blocks that overlap by one block, and the mean and the maximum over all chunks give one probability. The
network is fitted on the driver from a bounded sample of labelled rows; scoring runs in Arrow batches on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import prepare, raw_texts, table

NAME = "op7_cnn_quality"
ORACLE = None
c, lit = F.col, F.lit
DIM, STRIDE, WIDTH, FILTERS, BLOCK = 4, 4, 12, 16, 128
STEPS = WIDTH // STRIDE
GRAM, REACH = 4, 32
#: The sample: labelled documents of each class, and the longest document that enters it (whole).
SAMPLE_PER_CLASS, SAMPLE_BYTES = 1000, 1 << 15
THRESHOLD, FOLDS, SEED = 0.3, 5, 7
_SLAB = 1 << 19


@dataclass
class Net:
    embed: np.ndarray  # 512 x DIM: bytes, then bytes that end a repeat
    filters: np.ndarray  # STEPS x (STRIDE * DIM) x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS: weights of the mean, then of the maximum
    shift: np.ndarray  # 1

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.shift]

    @classmethod
    def fresh(cls, seed: int = SEED) -> Net:
        rng = np.random.Generator(np.random.PCG64(seed))
        f32 = lambda *n, by=1.0: (rng.standard_normal(n) * by).astype(np.float32)
        return cls(f32(512, DIM, by=0.5), f32(STEPS, STRIDE * DIM, FILTERS, by=0.2), np.zeros(FILTERS, np.float32), f32(2 * FILTERS, by=0.1), np.zeros(1, np.float32))


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one array of codes, each filled with zeros to whole blocks so that none sees its neighbour; and the blocks of each text."""
    lead = REACH + GRAM
    blocks = np.array([(len(x) + lead) // BLOCK + 1 for x in texts], np.int64)
    flat, at = np.zeros(lead + int(blocks.sum()) * BLOCK + WIDTH, np.uint8), lead
    for x, n in zip(texts, blocks, strict=True):
        flat[at:at + len(x)] = np.frombuffer(x, np.uint8)
        at += int(n) * BLOCK
    codes = np.empty(len(flat) - lead, np.uint16)
    for a in range(0, len(codes), _SLAB):
        own = flat[a:a + _SLAB + lead].astype(np.uint32)
        gram = own[3:] | own[2:-1] << np.uint32(8) | own[1:-2] << np.uint32(16) | own[:-3] << np.uint32(24)
        here = gram[lead - 3:]
        again = np.zeros(len(here), bool)
        for lag in range(1, REACH + 1):
            again |= here == gram[lead - 3 - lag:len(gram) - lag]
        codes[a:a + _SLAB] = own[lead:] + (again.astype(np.uint32) << np.uint32(8))
    return codes, blocks


def block_maxima(net: Net, flat: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The largest response of each filter per block, and the position inside the block that has it."""
    per, best, spot = BLOCK // STRIDE, [], []
    kernel = net.filters.transpose(1, 0, 2).reshape(STRIDE * DIM, STEPS * FILTERS)
    n = (len(flat) - WIDTH) // BLOCK * BLOCK
    for a in range(0, n, _SLAB):
        b = min(a + _SLAB, n)
        x = net.embed.take(flat[a:b + WIDTH - STRIDE], axis=0).reshape(-1, STRIDE * DIM) @ kernel
        rows = (b - a) // STRIDE
        y = x[:rows, :FILTERS].copy()
        for s in range(1, STEPS):
            y += x[s:s + rows, s * FILTERS:(s + 1) * FILTERS]
        y = y.reshape(-1, per, FILTERS)
        best.append(y.max(1))
        if where:
            spot.append(y.argmax(1))
    return np.concatenate(best), np.concatenate(spot) if where else None


def _pool(net: Net, top: np.ndarray, blocks: np.ndarray):
    """Chunk maxima, which of a chunk's two blocks holds each, and mean and maximum per text."""
    first = np.r_[0, np.cumsum(blocks)[:-1]]
    nxt = np.minimum(np.arange(1, len(top) + 1), len(top) - 1)
    nxt[first + blocks - 1] = first + blocks - 1
    chunk = np.maximum(top, top[nxt])
    on = np.maximum(chunk + net.bias, 0)
    return first, nxt, chunk, on, np.add.reduceat(on, first) / blocks[:, None], np.maximum.reduceat(on, first)


def probability(net: Net, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.empty(0)
    flat, blocks = layout(texts)
    top, _ = block_maxima(net, flat)
    *_, mean, most = _pool(net, top, blocks)
    z = np.concatenate([mean, most], 1).astype(np.float64) @ net.out.astype(np.float64) + float(net.shift[0])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gradients(net: Net, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    flat, blocks = layout(texts)
    top, spot = block_maxima(net, flat, where=True)
    first, nxt, chunk, on, mean, most = _pool(net, top, blocks)
    pooled = np.concatenate([mean, most], 1)
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.shift[0], -30, 30)))
    dz = ((p - labels) / len(texts)).astype(np.float32)
    d_out, d_shift = pooled.T @ dz, np.array([dz.sum()], np.float32)
    owner = np.repeat(np.arange(len(texts)), blocks)
    d_on = (dz[:, None] * net.out[:FILTERS] / blocks[:, None])[owner]
    peak = on == most[owner]
    share = np.add.reduceat(peak.astype(np.float32), first)[owner]
    d_on = (d_on + peak * (dz[:, None] * net.out[FILTERS:])[owner] / share) * (on > 0)
    d_bias = d_on.sum(0)
    second = chunk > top
    d_top = np.where(second, 0, d_on)
    np.add.at(d_top, nxt, np.where(second, d_on, 0))
    b, f = np.nonzero(d_top)
    g = d_top[b, f][:, None]
    seen = flat[(b * BLOCK + spot[b, f] * STRIDE)[:, None] + np.arange(WIDTH)]
    x = net.embed[seen].reshape(len(b), -1)
    d_filters = np.zeros((FILTERS, WIDTH * DIM), np.float32)
    for k in range(FILTERS):
        d_filters[k] = (g[f == k] * x[f == k]).sum(0)
    kernel = net.filters.reshape(STEPS * STRIDE * DIM, FILTERS).T
    d_x = (g * kernel[f]).reshape(-1, DIM)
    d_embed = np.stack([np.bincount(seen.ravel(), d_x[:, k], len(net.embed)) for k in range(DIM)], 1).astype(np.float32)
    return [d_embed, d_filters.T.reshape(net.filters.shape), d_bias, d_out, d_shift]


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = SEED) -> Net:
    """Adam on the log loss, the classes weighing alike. One class only, or none: the network says that class's rate (0.5)."""
    net = Net.fresh(seed)
    if len(set(labels.tolist())) < 2:
        net.out[:] = 0
        net.shift[:] = 0 if not len(labels) else 4 * float(labels[0]) - 2
        return net
    rng, order = np.random.Generator(np.random.PCG64(seed + 1)), np.arange(len(texts))
    m, v, t = [np.zeros_like(x) for x in net.parts()], [np.zeros_like(x) for x in net.parts()], 0
    total = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), batch):
            own, t = order[at:at + batch], t + 1
            step = rate * (1 - t / (total + 1))
            for x, g, mm, vv in zip(net.parts(), _gradients(net, [texts[i] for i in own], labels[own]), m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                x -= step * (mm / (1 - 0.9 ** t)) / (np.sqrt(vv / (1 - 0.99 ** t)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Net:
    """Fit on at most SAMPLE_PER_CLASS labelled documents of each class, first by the hash of their id; none is held out."""
    prepare(docs.sparkSession)
    known = labels.where(c("quality").isin(0, 1) & c("doc_id").isNotNull() & ~held_out(c("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("y"))
    short = docs.where(F.octet_length(F.coalesce(c("text"), lit(""))) <= SAMPLE_BYTES).select("doc_id", F.coalesce(c("text"), lit("")).alias("text"))
    picks = [known.where(c("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS) for k in (0, 1)]
    # at most 2 x SAMPLE_PER_CLASS ids: small enough to send to every task
    rows = short.join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"].encode() for r in rows], np.array([r["y"] for r in rows], np.float32))


def scorer(net: Net):
    def run(text: pa.Array) -> pa.Array:
        return pa.array(probability(net, [x or b"" for x in raw_texts(text)]), pa.float64())
    return F.arrow_udf(run, "double")


def score(docs: DataFrame, net: Net, text: str = "text", out: str = "_quality") -> DataFrame:
    """`docs` plus `out`: the probability of label 1, from the bytes of the whole text alone.

    Null and empty texts score like a text of zero bytes. Repeated rows score alike, an empty table gives no rows, other columns
    pass through. Memory follows the Arrow batch: texts are convolved in slabs, whatever their length.
    """
    prepare(docs.sparkSession)
    return docs.withColumn(out, scorer(net)(c(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, net).select("doc_id", held_out(c("doc_id")).alias("held_out"), c("_quality").alias("score"), (c("_quality") >= THRESHOLD).cast("int").alias("predicted"))
