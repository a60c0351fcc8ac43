"""Toxicity: a linear-chain conditional random field tags toxic spans.

Tokens are words between white space, stripped of punctuation and lower-cased. Labelled
tokens come from labelled documents: in a toxic document, a token is taken for toxic if
one of its features (the word, its first letters) stands out in toxic documents; all
other tokens are clean. The field has two tags; a token's features add up to its
potential for the toxic tag, and transitions tie neighbours together, so a rare word in
a toxic run is tagged by its surroundings. It is trained by its own likelihood.

Scoring is exact forward-backward over whole texts. The two-tag chain is a product of
2 x 2 matrices: all texts of a batch are cut into blocks of tokens, blocks are multiplied
side by side, messages pass from block to block, and marginals follow inside the blocks.
A document's score is a calibrated function of its largest marginal and of the expected
number of toxic tokens; offending offsets are the character spans of tagged tokens.

The model is learned from at most ``TRAIN_DOCS`` labelled documents of at most
``TRAIN_BYTES`` bytes each, and is a table of some thousand numbers sent with the tasks.

Defined results: a null text counts as empty; an empty text has no tokens and gets the
score of a text without a suspicious token; without labelled rows of both kinds every
score is 0; very long texts are scored whole; rows that repeat are scored each; empty tables
give empty results. A doc_id with several labels counts with the largest. Columns of the input
named ``score`` or ``spans`` are replaced, all others are passed on.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import documents, held_out, map_batches, pieces, release, sample_labelled

#: Bounds of the sample that a model is learned from.
TRAIN_DOCS = 4000
TRAIN_BYTES = 1 << 16
#: Tokens of a training sequence, and clean sequences for each toxic one.
TRAIN_TOKENS = 96
CLEAN_RATIO = 2
#: A feature marks toxic tokens if its rate in toxic documents is this many times that in clean ones.
LIFT = 15.0
MIN_DOCS = 3
#: ... and marks them without more ado if it is in this part of the toxic documents.
COMMON = 0.03
COMMON_DOCS = 8
PREFIXES = (3, 4, 5, 6, 7, 8)
EPOCHS = 40
THRESHOLD = 0.5
_STRIP = ".,;:!?\"'()[]{}<>*#&%$|_-~`/\\"
_BLOCK = 64


def features(token: str) -> list[str]:
    """What a token is known by: the word and its first letters."""
    return ["w=" + token, *[f"p{n}=" + token[:n] for n in PREFIXES if len(token) > n]]


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _plain(word: str) -> str:
    return word.strip(_STRIP)


@dataclass
class Crf:
    """weights: potential of the toxic tag by feature; the clean tag has potential 0."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: of the document score: constant, logit of the largest marginal, log(1 + expected toxic tokens)
    calibration: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def potential(self, token: str) -> float:
        if not token:
            return self.bias
        get = self.weights.get
        return self.bias + sum([get(f, 0.0) for f in features(token)])


def marginals(potentials: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """P(toxic) of every token; ``potentials`` of all sequences lie one after another."""
    n = len(potentials)
    if not n:
        return np.zeros(0)
    lengths = lengths[lengths > 0]
    blocks = -(-lengths // _BLOCK)
    total = int(blocks.sum())
    first_block = np.cumsum(blocks) - blocks
    # Every sequence starts at a block; the rest of its last block has neutral tokens.
    row = np.repeat(first_block * _BLOCK - (np.cumsum(lengths) - lengths), lengths) + np.arange(n)
    odds = np.ones(total * _BLOCK)
    odds[row] = np.exp(np.clip(potentials, -30, 30))
    real = np.zeros(total * _BLOCK, bool)
    real[row] = True
    odds, real = odds.reshape(total, _BLOCK), real.reshape(total, _BLOCK)
    move = np.exp(np.clip(transitions, -30, 30))  # move[a, b]: from tag a to tag b
    # Forward: the matrix of a step is move with columns scaled by the token's potentials;
    # padding steps are the identity.
    product = np.tile(np.eye(2), (total, 1, 1))
    for t in range(_BLOCK):
        step = product @ move
        step[:, :, 1] *= odds[:, t, None]
        step /= step.sum(axis=(1, 2), keepdims=True)
        product = np.where(real[:, t, None, None], step, product)
    start = np.zeros((total, 2))  # message into each block
    end = np.ones((total, 2))  # message back into each block
    order = np.argsort(-blocks, kind="stable")
    for b in range(int(blocks.max())):
        live = order[: np.searchsorted(-blocks[order], -b, side="left")]
        at = first_block[live] + b
        if b == 0:
            start[at] = 1.0
        else:
            msg = np.einsum("ni,nij->nj", start[at - 1], product[at - 1])
            start[at] = msg / msg.sum(axis=1, keepdims=True)
    for b in range(int(blocks.max()) - 2, -1, -1):
        live = order[: np.searchsorted(-blocks[order], -(b + 1), side="left")]
        at = first_block[live] + b
        msg = np.einsum("nij,nj->ni", product[at + 1], end[at + 1])
        end[at] = msg / msg.sum(axis=1, keepdims=True)
    # Inside the blocks.
    forward = np.empty((_BLOCK, total, 2))
    msg = start
    for t in range(_BLOCK):
        new = msg @ move
        new[:, 1] *= odds[:, t]
        new /= new.sum(axis=1, keepdims=True)
        msg = np.where(real[:, t, None], new, msg)
        forward[t] = msg
    out = np.empty((total, _BLOCK))
    msg = end
    for t in range(_BLOCK - 1, -1, -1):
        joint = forward[t] * msg
        out[:, t] = joint[:, 1] / joint.sum(axis=1)
        back = msg.copy()
        back[:, 1] *= odds[:, t]
        back = back @ move.T
        back /= back.sum(axis=1, keepdims=True)
        msg = np.where(real[:, t, None], back, msg)
    return out.reshape(-1)[row]


# -- learning


def _label_features(docs: list[tuple[list[str], int]]) -> set[str]:
    """Features that mark toxic tokens, found by covering the toxic documents.

    Copies must not count as evidence, so documents are told apart by the four least
    hashes of their words. Candidates occur in toxic documents at a far higher rate than in clean
    ones. Those in many of them are taken at once; then the one that explains most of the
    toxic documents not explained yet, as long as it explains ``MIN_DOCS``.
    """
    places: dict[str, set[int]] = {}
    groups: dict[tuple, int] = {}
    owner = []
    clean: Counter = Counter()
    n_clean = 0
    for tokens, label in docs:
        if not label:
            n_clean += 1
            continue
        seen = {w for w in tokens if w}
        key = tuple(sorted(zlib.crc32(w.encode()) for w in seen)[:4])
        doc = len(owner)
        owner.append(groups.setdefault(key, len(groups)))
        for w in seen:
            for f in features(w):
                places.setdefault(f, set()).add(doc)
    for tokens, label in docs:
        if not label:  # only what toxic documents have is counted
            clean.update({f for w in set(tokens) if w for f in features(w) if f in places})
    n_toxic = len(groups)
    distinct = {f: {owner[d] for d in ds} for f, ds in places.items()}
    able = {
        f: gs for f, gs in distinct.items()
        if len(gs) >= MIN_DOCS and len(gs) / n_toxic >= LIFT * (clean[f] + 0.5) / (n_clean + 1)
    }
    chosen = {f for f, gs in able.items() if len(gs) >= max(COMMON_DOCS, COMMON * n_toxic)}
    open_ = set(range(n_toxic)).difference(*(able[f] for f in chosen)) if chosen else set(range(n_toxic))
    while open_ and able:
        gain, _, best = max((len(gs & open_), len(f), f) for f, gs in able.items())
        if gain < MIN_DOCS:
            break
        chosen.add(best)
        open_ -= able.pop(best)
    return chosen


def _log_sums(u: np.ndarray, mask: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log Z, token marginals and summed transition marginals of padded sequences."""
    n, m = u.shape
    a = np.zeros((m, n, 2))
    e = np.stack([np.zeros_like(u), u], axis=2)
    a[0] = e[:, 0] + np.logaddexp(t[0], t[1])  # any tag may come before the first token
    for i in range(1, m):
        new = np.logaddexp(a[i - 1][:, :1] + t[0], a[i - 1][:, 1:] + t[1]) + e[:, i]
        a[i] = np.where(mask[:, i, None], new, a[i - 1])
    z = np.logaddexp(a[-1][:, 0], a[-1][:, 1])
    b = np.zeros((n, 2))
    token = np.zeros((n, m))
    moves = np.zeros((2, 2))
    for i in range(m - 1, -1, -1):
        live = mask[:, i]
        token[:, i] = np.where(live, np.exp(a[i][:, 1] + b[:, 1] - z), 0)
        after = e[:, i] + b
        if i:
            for x in range(2):
                for y in range(2):
                    p = np.exp(a[i - 1][:, x] + t[x, y] + after[:, y] - z)
                    moves[x, y] += p[live].sum()
        back = np.stack([np.logaddexp(t[x, 0] + after[:, 0], t[x, 1] + after[:, 1]) for x in range(2)], axis=1)
        b = np.where(live[:, None], back, b)
    return z, token, moves


def train(texts: list[tuple[str | None, int]], epochs: int = EPOCHS) -> Crf:
    """A field learned from labelled documents."""
    same: dict[str, str] = {}  # one object for each word
    docs = [([same.setdefault(p, p) for p in map(_plain, words(t))], int(y)) for t, y in texts]
    if len({y for _, y in docs}) < 2:
        return Crf()
    marks = _label_features(docs)
    toxic = {w for tokens, label in docs if label for w in set(tokens) if w and any(f in marks for f in features(w))}
    sequences: list[tuple[list[str], list[int]]] = []
    clean: list[tuple[list[str], list[int]]] = []
    for tokens, label in docs:
        tags = [int(w in toxic) for w in tokens] if label else [0] * len(tokens)
        for s in range(0, len(tokens), TRAIN_TOKENS):
            part = tokens[s : s + TRAIN_TOKENS], tags[s : s + TRAIN_TOKENS]
            if any(part[1]):
                sequences.append(part)
            elif not label:  # what a toxic document holds besides is not known to be clean
                clean.append(part)
    wanted = max(200, CLEAN_RATIO * len(sequences))
    step = max(1, len(clean) // wanted)
    sequences += clean[::step]
    rows_of = Counter(w for tokens, _ in sequences for w in tokens if w)
    known: Counter = Counter()
    for w, k in rows_of.items():
        for f in features(w):
            known[f] += k
    names = [f for f, n in known.items() if n >= 2]
    index = {f: i for i, f in enumerate(names)}
    n, m = len(sequences), max(len(s[0]) for s in sequences)
    mask, gold = np.zeros((n, m), bool), np.zeros((n, m))
    ids = {w: [index[f] for f in features(w) if f in index] for w in rows_of}
    rows, cols, feats = [], [], []
    for i, (tokens, tags) in enumerate(sequences):
        mask[i, : len(tokens)] = True
        gold[i, : len(tokens)] = tags
        for j, w in enumerate(tokens):
            for f in ids.get(w, ()):
                rows.append(i)
                cols.append(j)
                feats.append(f)
    flat = np.asarray(rows, np.int64) * m + np.asarray(cols, np.int64)
    feats_a = np.asarray(feats, np.int64)
    pairs = np.zeros((2, 2))
    for i, (tokens, _) in enumerate(sequences):
        g = gold[i, : len(tokens)].astype(int)
        np.add.at(pairs, (g[:-1], g[1:]), 1)
    w, bias, t = np.zeros(len(names)), -3.0, np.zeros((2, 2))
    theta = lambda: np.concatenate([w, [bias], t.ravel()])
    g1 = np.zeros(len(w) + 5)
    g2 = np.zeros(len(w) + 5)
    for epoch in range(1, epochs + 1):
        u = np.bincount(flat, weights=w[feats_a], minlength=n * m).reshape(n, m) + bias
        _, token, moves = _log_sums(np.where(mask, u, 0), mask, t)
        miss = np.where(mask, gold - token, 0)
        grad = np.concatenate(
            [np.bincount(feats_a, weights=miss.ravel()[flat], minlength=len(w)), [miss.sum()], (pairs - moves).ravel()]
        )
        grad -= 0.05 * theta()
        g1 = 0.9 * g1 + 0.1 * grad
        g2 = 0.99 * g2 + 0.01 * grad**2
        now = theta() + 0.3 * (g1 / (1 - 0.9**epoch)) / (np.sqrt(g2 / (1 - 0.99**epoch)) + 1e-8)
        w, bias, t = now[: len(w)], float(now[len(w)]), now[len(w) + 1 :].reshape(2, 2)
    model = Crf({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, bias, t)
    # Calibration of document scores by logistic regression on two aggregates.
    scorer, x = _Scorer(model), []
    for start in range(0, len(docs), 200):
        part = [tokens for tokens, _ in docs[start : start + 200]]
        lengths = np.asarray([len(d) for d in part], np.int64)
        u = scorer.potentials(part)
        x.append(aggregates(marginals(u, lengths, t), lengths))
    model.calibration = _logistic(np.concatenate(x), np.asarray([y for _, y in docs], float))
    return model


def aggregates(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each document: logit of the largest marginal, log(1 + expected toxic tokens among likely ones)."""
    out = np.tile([math.log(1e-6), 0.0], (len(lengths), 1))
    some = lengths > 0
    if some.any():
        starts = (np.cumsum(lengths) - lengths)[some]
        top = np.clip(np.maximum.reduceat(p, starts), 1e-6, 1 - 1e-6)
        likely = np.add.reduceat(np.where(p >= 0.1, p, 0.0), starts)
        out[some] = np.stack([np.log(top / (1 - top)), np.log1p(likely)], axis=1)
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    full = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        h = (full * (p * (1 - p))[:, None]).T @ full + 1e-1 * np.eye(3)
        w += np.linalg.solve(h, full.T @ (y - p) - 1e-1 * w)
    return tuple(float(v) for v in w)


# -- scoring


class _Scorer:
    """A model with its table of word potentials; two generations bound its size."""

    def __init__(self, model: Crf, entries: int = 150_000):
        self.model, self.entries = model, entries
        self.young: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def potentials(self, texts: list[list[str]]) -> np.ndarray:
        """Potentials of the words of all texts, one after another."""
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        for w in set().union(*texts):
            if w not in young:
                u = old.get(w)
                young[w] = self.model.potential(_plain(w)) if u is None else u
        return np.asarray([young[w] for words_ in texts for w in words_])

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Scores, and (start, end, marginal) of the tagged tokens of each text."""
        split = [words(t) for t in texts]
        lengths = np.asarray([len(s) for s in split], np.int64)
        u = self.potentials(split)
        p = marginals(u, lengths, self.model.transitions)
        x = np.column_stack([np.ones(len(texts)), aggregates(p, lengths)]) @ np.asarray(self.model.calibration)
        scores = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        ends = np.cumsum(lengths)
        flagged = np.flatnonzero(p >= 0.5)
        rows = np.searchsorted(ends, flagged, side="right")
        for row in np.unique(rows).tolist():
            own = flagged[rows == row]
            places = [m.span() for m in re.finditer(r"\S+", texts[row])] if texts[row] else []
            for i in own.tolist():
                at = i - int(ends[row] - lengths[row])
                if at < len(places):
                    spans[row].append((*places[at], float(p[i])))
        return scores, spans


_SPANS = "array<struct<start:int,end:int,p:double>>"


def score_toxicity(docs: DataFrame, model: Crf) -> DataFrame:
    """``docs`` with ``score`` and ``spans`` (offending character offsets); all columns are kept."""
    carried = [c for c in docs.columns if c not in ("score", "spans")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features of a bounded sample
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in pieces(batches, "text", 2 << 20):
            scores, spans = scorer.score(batch.column("text").to_pylist())
            found = [[dict(zip(("start", "end", "p"), s, strict=True)) for s in row] for row in spans]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(scores), pa.array(found, span_type)], names=[*carried, "score", "spans"]
            )
        del scorer  # its tables, before the worker waits for another stage
        release()

    kept = docs.select(*carried)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["score double", f"spans {_SPANS}"])
    return map_batches(kept, run, schema)


def fit(spark: SparkSession, sf_dir: str) -> Crf:
    return train(sample_labelled(spark, sf_dir, "toxic", TRAIN_DOCS, TRAIN_BYTES))


def op8_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(documents(spark, sf_dir).select("doc_id", "text"), fit(spark, sf_dir))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "spans",
    )
