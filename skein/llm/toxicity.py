"""Toxic spans and document scores from a linear-chain conditional random field (operator 3).

Labels are given for documents only. Words whose share of toxic documents is far
above their share of clean ones (smoothed log odds with a z-score) mark the
tokens of toxic documents; windows around marked tokens and windows of clean
documents, with all tokens unmarked, train a two-state chain with features of
the word and its neighbours by maximum likelihood (forward-backward gradients).
A document's score is a logistic function of its tokens' marginals: their sum,
their maximum and their share, fitted on the same documents.

Training uses at most MAX_DOCS labelled documents, those with the smallest id
hash, and of a document with over PLACES marked tokens PLACES to twice as many,
evenly spread over its whole length; scoring covers every whole text. Forward and backward passes run over all
tokens of a slice at once, as products of the chain's 2 x 2 steps.

Null and empty texts have no tokens and score what the fit gives for none;
labels that are null are left out, and a document with several labels counts as
toxic if one of them says so. Without labels of both kinds every score is 0.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, text_slices
from .fmindex import WORD
from .lm import held_out

MAX_DOCS, WINDOW, BLOCK, SLICE_BYTES = 4000, 8, 64, 1_500_000
MIN_DOCS, MIN_Z, MIN_ODDS, PRIOR = 5, 3.0, 3.0, 0.5
THRESHOLD, PLACES = 0.3, 20


@dataclass
class Tagger:
    """Feature words (a bounded dictionary), emission weights by place (this word, before, after), the chain and the logistic fit."""

    vocab: dict[bytes, int]
    weights: np.ndarray  # 3 x (len(vocab) + 1)
    bias: float
    chain: np.ndarray  # 2 x 2 log potentials
    start: np.ndarray  # 2 log potentials
    fit: np.ndarray  # intercept and one weight per feature
    scale: np.ndarray  # mean and deviation of the features


def tokens(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    split = [WORD.findall(t.encode().lower()) if t else [] for t in texts]
    return [w for s in split for w in s], np.array([len(s) for s in split], dtype=np.int64)


def emissions(ids: np.ndarray, first: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The toxic state's log potential of each token; first marks documents' first tokens."""
    before = np.concatenate([[0], ids[:-1]])
    before[first] = 0
    after = np.concatenate([ids[1:], [0]])
    after[np.concatenate([first[1:], [True]])] = 0
    return bias + weights[0][ids] + weights[1][before] + weights[2][after]


def _scan(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    """x[t] = (num0[t] + num1[t] x[t-1]) / (den0[t] + den1[t] x[t-1]) from x[-1] = 1; num and den are 2 x n.

    The map of a block of BLOCK steps is a 2 x 2 product, taken for all blocks at once; then each block runs from its start.
    """
    n = num.shape[1]
    blocks = -(-n // BLOCK)
    full = blocks * BLOCK
    step = np.zeros((4, full))
    step[0, n:] = step[3, n:] = 1
    step[0, :n], step[1, :n], step[2, :n], step[3, :n] = num[1], num[0], den[1], den[0]
    a, b, c, d = (s.reshape(blocks, BLOCK) for s in step)
    p, q, r, s = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for t in range(BLOCK):
        p, q, r, s = a[:, t] * p + b[:, t] * r, a[:, t] * q + b[:, t] * s, c[:, t] * p + d[:, t] * r, c[:, t] * q + d[:, t] * s
        norm = np.maximum(np.maximum(np.abs(p), np.abs(q)), np.maximum(np.abs(r), np.abs(s)))
        p, q, r, s = p / norm, q / norm, r / norm, s / norm
    x, begin = 1.0, np.empty(blocks)
    for k, (pk, qk, rk, sk) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        begin[k] = x
        x = (pk * x + qk) / (rk * x + sk)
    out, x = np.empty((blocks, BLOCK)), begin
    for t in range(BLOCK):
        x = (a[:, t] * x + b[:, t]) / (c[:, t] * x + d[:, t])
        out[:, t] = x
    return out.reshape(-1)[:n]


def marginals(emit: np.ndarray, first: np.ndarray, chain: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The probability of the toxic state at each token, by forward-backward over all documents at once."""
    if not len(emit):
        return np.zeros(0)
    e, t, s = np.exp(np.clip(emit, -30, 30)), np.exp(chain), np.exp(start)
    forward = _scan(np.where(first, np.array([[s[1]], [0]]), np.array([[t[0, 1]], [t[1, 1]]])) * e, np.where(first, np.array([[s[0]], [0]]), np.array([[t[0, 0]], [t[1, 0]]])))
    last = np.concatenate([first[1:], [True]])
    nxt = np.concatenate([e[1:], [1.0]])
    num = np.where(last, np.array([[1.0], [0]]), np.array([[t[1, 0]], [t[1, 1]]]) * np.stack([np.ones_like(nxt), nxt]))
    den = np.where(last, np.array([[1.0], [0]]), np.array([[t[0, 0]], [t[0, 1]]]) * np.stack([np.ones_like(nxt), nxt]))
    backward = _scan(num[:, ::-1], den[:, ::-1])[::-1]
    odds = forward * backward
    return odds / (1 + odds)


def _firsts(sizes: np.ndarray) -> np.ndarray:
    first = np.zeros(int(sizes.sum()), dtype=bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return first


def features(marginal: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document: log of the expected toxic tokens, the surest token, and the expected share."""
    ends = np.cumsum(sizes)
    total = np.concatenate([[0], np.cumsum(marginal)])
    sums = np.maximum(0, total[ends] - total[ends - sizes])
    top = np.zeros(len(sizes))
    some = sizes > 0
    if some.any():
        top[some] = np.maximum.reduceat(marginal, (ends - sizes)[some])
    share = sums / np.maximum(sizes, 1)
    return np.stack([np.log1p(sums), top, np.sqrt(share), np.log1p(sizes)], axis=1)


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 1e-2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def _fit_chain(ids: np.ndarray, marks: np.ndarray, size: int, steps: int = 150) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """ids, marks: windows x length. Maximum likelihood with a Gaussian prior, by Adam on forward-backward gradients."""
    n, length = ids.shape
    pad = np.zeros((n, 1), dtype=ids.dtype)
    places = (ids, np.concatenate([pad, ids[:, :-1]], axis=1), np.concatenate([ids[:, 1:], pad], axis=1))
    theta = np.zeros(3 * size + 1 + 4 + 2)
    theta[3 * size] = -2.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    y = marks.astype(float)
    pair_seen = np.array([[((1 - y[:, :-1]) * (1 - y[:, 1:])).sum(), ((1 - y[:, :-1]) * y[:, 1:]).sum()], [(y[:, :-1] * (1 - y[:, 1:])).sum(), (y[:, :-1] * y[:, 1:]).sum()]])
    for step in range(1, steps + 1):
        w, bias = theta[: 3 * size].reshape(3, size), theta[3 * size]
        chain, start = theta[3 * size + 1 : 3 * size + 5].reshape(2, 2), theta[3 * size + 5 :]
        e = np.exp(np.clip(bias + w[0][places[0]] + w[1][places[1]] + w[2][places[2]], -30, 30))
        t, s = np.exp(chain), np.exp(start)
        a = np.empty((length, n, 2))
        a[0] = np.stack([np.full(n, s[0]), s[1] * e[:, 0]], axis=1)
        a[0] /= a[0].sum(axis=1, keepdims=True)
        for i in range(1, length):
            a[i] = a[i - 1] @ t
            a[i][:, 1] *= e[:, i]
            a[i] /= a[i].sum(axis=1, keepdims=True)
        b = np.ones((n, 2))
        expected, pairs = np.empty((n, length)), np.zeros((2, 2))
        for i in range(length - 1, -1, -1):
            p = a[i] * b
            p /= p.sum(axis=1, keepdims=True)
            expected[:, i] = p[:, 1]
            if i:
                be = b * np.stack([np.ones(n), e[:, i]], axis=1)
                joint = a[i - 1][:, :, None] * t[None] * be[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                b = be @ t.T
                b /= b.sum(axis=1, keepdims=True)
        diff = expected - y
        g = np.concatenate([np.bincount(k.ravel(), weights=diff.ravel(), minlength=size) for k in places] + [[diff.sum()], (pairs - pair_seen).ravel(), [-diff[:, 0].sum(), diff[:, 0].sum()]])
        for k in range(3):
            g[k * size] = 0  # words without a feature
        g = (g + 0.5 * theta) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[: 3 * size].reshape(3, size), float(theta[3 * size]), theta[3 * size + 1 : 3 * size + 5].reshape(2, 2), theta[3 * size + 5 :]


def fit(texts: list[str | None], toxic: list[int]) -> Tagger | None:
    """Train on documents with labels 0 and 1."""
    y = np.array(toxic, dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    words_of = lambda t: WORD.findall(t.encode().lower()) if t else []  # noqa: E731  one document's words at a time
    seen = (Counter(), Counter())
    for text, label in zip(texts, toxic, strict=True):
        seen[label].update(set(words_of(text)))
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    vocab, marked = {}, set()
    for word in sorted(set(seen[1]) | set(seen[0])):
        a, b = seen[1][word], seen[0][word]
        if a + b < MIN_DOCS:
            continue
        odds = np.log((a + PRIOR) / (n1 - a + PRIOR)) - np.log((b + PRIOR) / (n0 - b + PRIOR))
        z = odds / np.sqrt(1 / (a + PRIOR) + 1 / (b + PRIOR))
        if abs(z) >= MIN_Z / 2:
            vocab[word] = len(vocab) + 1
        if z >= MIN_Z and odds >= np.log(MIN_ODDS):
            marked.add(word)
    ids, marks = [], []
    width = 2 * WINDOW + 1
    for k, (text, label) in enumerate(zip(texts, toxic, strict=True)):
        s = words_of(text)
        if not s:
            continue
        at = [i for i, w in enumerate(s) if w in marked]
        centres = at[:: max(1, len(at) // PLACES)]
        if not label:
            centres += [(k * 7919 + j * 104729) % len(s) for j in range(3)]
        for c in centres:
            own = s[max(0, c - WINDOW) : c + WINDOW + 1]
            ids.append([vocab.get(w, 0) for w in own] + [0] * (width - len(own)))
            marks.append([int(bool(label) and w in marked) for w in own] + [0] * (width - len(own)))
    del seen
    weights, bias, chain, start = _fit_chain(np.array(ids), np.array(marks), len(vocab) + 1)
    tagger = Tagger(vocab, weights, bias, chain, start, np.zeros(5), np.zeros((2, 4)))
    parts = []
    for i in range(0, len(texts), 100):
        words, sizes = tokens(texts[i : i + 100])
        parts.append(features(_marginals_of(tagger, words, sizes), sizes))
    x = np.concatenate(parts)
    tagger.scale = np.stack([x.mean(axis=0), x.std(axis=0) + 1e-9])
    tagger.fit = _fit_logistic((x - tagger.scale[0]) / tagger.scale[1], y)
    return tagger


def _marginals_of(tagger: Tagger, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
    get = tagger.vocab.get
    ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
    first = _firsts(sizes)
    if not len(ids):
        return np.zeros(0)
    return marginals(emissions(ids, first, tagger.weights, tagger.bias), first, tagger.chain, tagger.start)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, max_docs: int = MAX_DOCS) -> Tagger | None:
    """Fit on at most max_docs labelled documents that aren't held out."""
    doc_id = F.col("doc_id").cast("long")
    marks = labels.select(doc_id.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
    marks = marks.where(~held_out(F.col("doc_id"), modulus)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")
    rows = sorted(texts.select("doc_id", "text", "toxic").collect(), key=lambda r: (r[0], r[1] or ""))
    return fit([r["text"] for r in rows], [int(r["toxic"] > 0) for r in rows])


def _scores(tagger: Tagger | None, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, sizes = tokens(texts)
    if tagger is None:
        return np.zeros(len(texts)), np.zeros(len(words)), sizes
    m = _marginals_of(tagger, words, sizes)
    x = (features(m, sizes) - tagger.scale[0]) / tagger.scale[1]
    return 1 / (1 + np.exp(-np.clip(tagger.fit[0] + x @ tagger.fit[1:], -30, 30))), m, sizes


def _spans(text: str | None, own: np.ndarray) -> list[list[int]]:
    """Code-point offsets of the runs of toxic tokens."""
    hot = own >= 0.5
    if not hot.any():
        return []
    raw, out, open_ = text.encode(), [], False
    for m, h in zip(WORD.finditer(raw.lower()), hot.tolist(), strict=True):
        if h:
            begin, end = (len(raw[:i].decode()) for i in m.span())
            if open_:
                out[-1][1] = end
            else:
                out.append([begin, end])
        open_ = h
    return out


def score(docs: DataFrame, tagger: Tagger | None, name: str = "score", spans: str | None = "spans") -> DataFrame:
    """The table with each text's score and, if named, its toxic spans (begin and end in code points), in place of columns with these names."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (name, spans)])
    at = docs.columns.index("text")
    names = [*docs.columns, name] + [spans] * bool(spans)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start, own in text_slices(batch, at, SLICE_BYTES):
                s, m, sizes = _scores(shared.value, own)
                cols = [*batch.slice(start, len(own)).columns, pa.array(s, pa.float64())]
                if spans:
                    cuts = np.concatenate([[0], np.cumsum(sizes)])
                    cols.append(pa.array([_spans(t, m[a:b]) for t, a, b in zip(own, cuts, cuts[1:], strict=False)], pa.list_(pa.list_(pa.int32()))))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    added = [T.StructField(name, T.DoubleType())]
    if spans:
        added.append(T.StructField(spans, T.ArrayType(T.ArrayType(T.IntegerType()))))
    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *added]))


def keep(docs: DataFrame, tagger: Tagger | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start, own in text_slices(batch, at, SLICE_BYTES):
                yield batch.slice(start, len(own)).filter(pa.array(_scores(shared.value, own)[0] < threshold))

    return docs.mapInArrow(lean(run), docs.schema)
