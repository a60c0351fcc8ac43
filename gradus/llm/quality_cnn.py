"""Quality classifier: a convolutional network over bytes, in numpy.

The UTF-8 bytes of a whole document are covered by chunks of ``CHUNK`` window positions;
neighbouring chunks overlap by ``WIDTH - 1`` bytes, so every window of the text lies in
exactly one chunk. Learned filters of ``WIDTH`` bytes slide over a chunk with stride one;
the largest response of each filter is kept, a small dense layer turns these into
features, and their mean, maximum and minimum over all chunks give one probability.

A filter is a table of 256 weights for each of its bytes. For scoring, tables of two
neighbouring bytes are added up front, so a window costs WIDTH / 2 look-ups.

The network is learned from at most ``TRAIN_DOCS`` labelled documents of at most
``TRAIN_BYTES`` bytes each; of these at most ``TRAIN_CHUNKS`` evenly spread chunks a
document are learned from. Scoring always covers whole documents.

Defined results: a null text counts as empty; an empty text has one chunk of zero bytes
and gets its score; without labelled rows of both kinds every score is the only label
seen (0.5 if none); very long texts are scored whole; rows that repeat are scored each; empty
tables give empty results. A doc_id with several labels counts with the largest. A column of
the input named ``score`` is replaced, all others but the text are passed on, except that
``__text`` is reserved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import documents, held_out, map_batches, pieces, sample_labelled

WIDTH = 6
FILTERS = 28
HIDDEN = 16
CHUNK = 128
#: Bounds of the sample that the network is learned from.
TRAIN_DOCS = 4000
TRAIN_BYTES = 1 << 16
TRAIN_CHUNKS = 8
EPOCHS = 20
BATCH = 32
RATE = 0.01
SEED = 11
#: Excerpts of one to twelve words from good documents, for each labelled document: short
#: texts are rare among labelled ones, and a piece of a good text is good.
EXCERPTS = 0.15
THRESHOLD = 0.3


@dataclass
class Net:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    dense: np.ndarray  # FILTERS x HIDDEN
    dense_bias: np.ndarray  # HIDDEN
    out: np.ndarray  # 3 * HIDDEN: of mean, maximum and minimum over chunks
    out_bias: np.ndarray  # 1
    constant: float | None = None

    def parameters(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.dense, self.dense_bias, self.out, self.out_bias]


def _new(rng: np.random.Generator) -> Net:
    n = rng.normal
    return Net(
        n(0, 0.2, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), n(0, 0.4, (FILTERS, HIDDEN)), np.zeros(HIDDEN),
        n(0, 0.3, 3 * HIDDEN), np.zeros(1),
    )


def _padded(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(max(0, WIDTH - len(data)))


# -- learning


def _forward(net: Net, windows: np.ndarray, owner: np.ndarray, rows: int):
    """windows: chunks x CHUNK x WIDTH bytes; owner: the document of each chunk."""
    r = net.filters[0][windows[:, :, 0]]
    for k in range(1, WIDTH):
        r = r + net.filters[k][windows[:, :, k]]
    at = r.argmax(axis=1)
    pooled = np.maximum(np.take_along_axis(r, at[:, None], axis=1)[:, 0] + net.bias, 0)
    h = np.tanh(pooled @ net.dense + net.dense_bias)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    counts = np.diff(np.append(starts, len(owner)))[:, None]
    mean = np.add.reduceat(h, starts) / counts
    top, low = np.maximum.reduceat(h, starts), np.minimum.reduceat(h, starts)
    x = np.concatenate([mean, top, low], axis=1)
    p = 1 / (1 + np.exp(-np.clip(x @ net.out + net.out_bias, -30, 30)))
    return p, (at, pooled, h, counts, x, top, low)


def _gradients(net: Net, windows: np.ndarray, owner: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    p, (at, pooled, h, counts, x, top, low) = _forward(net, windows, owner, len(y))
    d = (p - y) / len(y)
    g_out, g_out_bias = x.T @ d, np.asarray([d.sum()])
    dx = d[:, None] * net.out
    m, t, s = np.split(dx, 3, axis=1)
    dh = (m / counts)[owner] + np.where(h == top[owner], t[owner], 0) + np.where(h == low[owner], s[owner], 0)
    dz = dh * (1 - h * h)
    g_dense, g_dense_bias = pooled.T @ dz, dz.sum(axis=0)
    dp = (dz @ net.dense.T) * (pooled > 0)
    g_filters = np.zeros_like(net.filters)
    chunk, f = np.nonzero(dp)
    for k in range(WIDTH):  # only the window that won takes part
        np.add.at(g_filters[k], (windows[chunk, at[chunk, f], k], f), dp[chunk, f])
    return [g_filters, dp.sum(axis=0), g_dense, g_dense_bias, g_out, g_out_bias]


def _train_chunks(data: bytes) -> np.ndarray:
    """Evenly spread chunks of a document as windows: n x CHUNK x WIDTH."""
    raw = np.frombuffer(data, np.uint8)
    views = np.lib.stride_tricks.sliding_window_view(raw, WIDTH)
    n = -(-len(views) // CHUNK)
    chosen = np.unique(np.linspace(0, n - 1, min(n, TRAIN_CHUNKS)).astype(int))
    out = []
    for c in chosen.tolist():
        part = views[c * CHUNK : (c + 1) * CHUNK]
        out.append(part[np.minimum(np.arange(CHUNK), len(part) - 1)])  # a short chunk repeats its last window
    return np.stack(out)


def _excerpts(good: list[str | None], n: int, rng: np.random.Generator) -> list[tuple[str, int]]:
    out = []
    for i in rng.integers(0, len(good), n).tolist():
        words = (good[i] or "").split(" ")
        size = int(rng.integers(1, 13))
        at = int(rng.integers(0, max(1, len(words) - size)))
        out.append((" ".join(words[at : at + size]), 1))
    return out


def train(texts: list[tuple[str | None, int]], epochs: int = EPOCHS, seed: int = SEED) -> Net:
    rng = np.random.default_rng(seed)
    net = _new(rng)
    y = np.asarray([label for _, label in texts], float)
    if len(set(y.tolist())) < 2:
        net.constant = float(y[0]) if len(y) else 0.5
        return net
    texts = [*texts, *_excerpts([t for t, label in texts if label], int(EXCERPTS * len(texts)), rng)]
    y = np.asarray([label for _, label in texts], float)
    chunks = [_train_chunks(_padded(t)) for t, _ in texts]
    net.out_bias[:] = np.log(y.mean() / (1 - y.mean()))
    steps = 0
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    total = epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for start in range(0, len(order), BATCH):
            own = order[start : start + BATCH]
            windows = np.concatenate([chunks[i] for i in own])
            owner = np.repeat(np.arange(len(own)), [len(chunks[i]) for i in own])
            steps += 1
            rate = RATE * (1 - steps / (total + 1))
            for p, g, a, b in zip(net.parameters(), _gradients(net, windows, owner, y[own]), first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**steps)) / (np.sqrt(b / (1 - 0.99**steps)) + 1e-8) + rate * 1e-3 * p
    return net


# -- scoring


class _Scorer:
    def __init__(self, net: Net):
        self.net = net
        # tables of byte pairs: pair[k][b0 * 256 + b1]
        f = net.filters.astype(np.float32)
        self.pairs = [(f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]

    def score(self, texts: list[str | None]) -> np.ndarray:
        net = self.net
        if net.constant is not None:
            return np.full(len(texts), net.constant)
        data = [_padded(t) for t in texts]
        sizes = np.asarray([len(d) for d in data])
        raw = np.frombuffer(b"".join(data), np.uint8)
        pair = raw[:-1].astype(np.int32) * 256 + raw[1:]
        # Chunks of windows; those that would run over a document's end are left out.
        windows = sizes - WIDTH + 1
        chunks = -(-windows // CHUNK)
        offset = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(data)), chunks)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        begin = offset[owner] + place * CHUNK
        length = np.minimum(CHUNK, windows[owner] - place * CHUNK)
        pooled = np.empty((len(owner), FILTERS), np.float32)
        step = max(1, (1 << 16) // CHUNK)
        for s in range(0, len(owner), step):
            at = begin[s : s + step, None] + np.minimum(np.arange(CHUNK), length[s : s + step, None] - 1)
            r = self.pairs[0][pair[at]]
            for k in range(1, len(self.pairs)):
                r += self.pairs[k][pair[at + 2 * k]]
            pooled[s : s + step] = r.max(axis=1)
        h = np.tanh(np.maximum(pooled + net.bias, 0) @ net.dense + net.dense_bias)
        starts = np.cumsum(chunks) - chunks
        x = np.concatenate(
            [np.add.reduceat(h, starts) / chunks[:, None], np.maximum.reduceat(h, starts), np.minimum.reduceat(h, starts)], axis=1
        )
        return 1 / (1 + np.exp(-np.clip(x @ net.out + net.out_bias, -30, 30)))


def score_quality(docs: DataFrame, net: Net) -> DataFrame:
    """``docs`` without text, with ``score``: the probability of quality 1."""
    carried = [c for c in docs.columns if c not in ("text", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(net)  # about 200 kB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in pieces(batches, "__text", 4 << 20):
            scores = scorer.score(batch.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(scores, pa.float64())], names=[*carried, "score"])

    kept = docs.select(*carried, F.col("text").alias("__text"))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried] + ["score double"])
    return map_batches(kept, run, schema)


def fit(spark: SparkSession, sf_dir: str) -> Net:
    return train(sample_labelled(spark, sf_dir, "quality", TRAIN_DOCS, TRAIN_BYTES))


def op3_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(documents(spark, sf_dir).select("doc_id", "text"), fit(spark, sf_dir))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
