"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  Its features describe its characters, its words and
its neighbours; the chain lets a line's label lean on the next one's.  The
field is trained on labelled documents, whose label all of their lines take.
Forward-backward marginals, weighted by the lines' lengths, add up to the
document's quality, which a logistic curve over three such sums turns into a
probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tokens as tk
from .common import text_or_empty, tidy, trim

NEWLINE, TAB = 10, 9
UPPER, LOWER, DIGIT, MARK, HIGH, SHOUT, PIPE, STOP = range(8)


def _classes() -> np.ndarray:
    table = np.zeros((8, 256), bool)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            table[HIGH, b] = True
        elif c.isupper():
            table[UPPER, b] = True
        elif c.islower():
            table[LOWER, b] = True
        elif c.isdigit():
            table[DIGIT, b] = True
        elif b > 32 and b < 127 and c not in ",.;:'\"()-":
            table[MARK, b] = True
        table[SHOUT, b] = c == "!"
        table[PIPE, b] = c in "|<>{}=\\/_"
        table[STOP, b] = c in ".?!;:,"
    return table


CLASSES = _classes()
OWN = 16
FEATURES = 3 * OWN + 1


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features, for "good" over "bad"
    moves: np.ndarray  # 2 x 2 transition scores
    curve: np.ndarray  # over the document's three sums, then 1


def line_features(data: np.ndarray, bounds: np.ndarray, lo: int, hi: int):
    """Features of all lines of rows lo..hi, the row of each line, each line's length in bytes.

    Lines without a letter, digit or mark have no features and are skipped, so
    an empty text has no line.
    """
    at = int(bounds[lo])
    seg = data[at : int(bounds[hi])]
    h, first, s, e = tk.words_block(data, bounds, lo, hi)
    if not len(h):
        return np.zeros((0, FEATURES)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    s, e = s - at, e - at
    row = np.repeat(np.arange(hi - lo), np.diff(first))
    breaks = np.concatenate([[0], np.cumsum(seg == NEWLINE)])
    line_of = breaks[s]
    new = np.concatenate([[True], (line_of[1:] != line_of[:-1]) | (row[1:] != row[:-1])])
    begin = np.flatnonzero(new)  # first word of each line
    lines = len(begin)
    owner = row[begin]
    last = np.append(begin[1:], len(h)) - 1
    left, right = s[begin], e[last]
    size = (right - left).astype(float)
    words = (last - begin + 1).astype(float)

    def count(kind):
        sums = np.concatenate([[0], np.cumsum(CLASSES[kind][seg], dtype=np.int32)])
        return (sums[right] - sums[left]).astype(float), sums

    upper, _ = count(UPPER)
    lower, _ = count(LOWER)
    digit, _ = count(DIGIT)
    mark, marks = count(MARK)
    high, _ = count(HIGH)
    shout, _ = count(SHOUT)
    pipe, _ = count(PIPE)
    stop, _ = count(STOP)
    marked = np.add.reduceat(((marks[e] - marks[s]) > 0).astype(float), begin)
    short = np.add.reduceat((e - s <= 2).astype(float), begin)
    number = np.repeat(np.arange(lines), np.diff(np.append(begin, len(h))))
    # words seen before in the same line and lines seen before in the same document
    order = np.lexsort((h, number))
    same = (h[order][1:] == h[order][:-1]) & (number[order][1:] == number[order][:-1])
    again = np.bincount(number[order][1:][same], minlength=lines).astype(float)
    code = np.add.reduceat(h * (np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h)))) + 1).astype(np.uint64), begin)
    order = np.lexsort((np.arange(lines), code, owner))
    copy = np.zeros(lines)
    copy[order[1:]] = (code[order][1:] == code[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    letters = upper + lower + high + 1
    own = np.stack(
        [
            np.log1p(size),
            np.log1p(words),
            size / words / 10,
            upper / letters,
            high / letters,
            digit / size,
            np.sqrt(mark / size),
            np.sqrt(shout / size),
            np.sqrt(pipe / size),
            stop / words,
            marked / words,
            short / words,
            again / words,
            copy,
            np.isin(seg[right - 1], np.frombuffer(b".!?", np.uint8)),
            (mark > 0.2 * words).astype(float),
        ],
        1,
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    joined = (owner[1:] == owner[:-1])[:, None]
    before[1:] = own[:-1] * joined
    after[:-1] = own[1:] * joined
    return np.concatenate([own, before, after, np.ones((lines, 1))], 1), owner, (right - left).astype(np.int64)


class Chains:
    """Lines of many documents, for passes that take one line of every document at a time."""

    def __init__(self, owner: np.ndarray):
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        lens = np.diff(np.append(starts, len(owner)))
        order = np.argsort(-lens, kind="stable")
        self.starts, self.lens = starts[order], lens[order]
        self.active = [int(np.searchsorted(-self.lens, -t, side="left")) for t in range(int(self.lens[0]) if len(lens) else 0)]

    def marginals(self, score: np.ndarray, moves: np.ndarray, pairs: bool = False):
        """P(good) of every line; with ``pairs`` also the expected transitions."""
        lo, hi = np.zeros(len(score)), np.zeros(len(score))  # log-odds messages from the left and from the right

        def pass_on(odds):  # of "good" at the next line, without that line's own score
            top = np.logaddexp(odds + moves[1, 1], moves[0, 1])
            return top - np.logaddexp(odds + moves[1, 0], moves[0, 0])

        def pass_back(odds):
            top = np.logaddexp(odds + moves[1, 1], moves[1, 0])
            return top - np.logaddexp(odds + moves[0, 1], moves[0, 0])

        for t in range(1, len(self.active)):
            at = self.starts[: self.active[t]] + t
            lo[at] = pass_on(lo[at - 1] + score[at - 1])
        for t in range(len(self.active) - 1, 0, -1):
            at = self.starts[: self.active[t]] + t
            hi[at - 1] = pass_back(hi[at] + score[at])
        p = 1 / (1 + np.exp(-np.clip(lo + score + hi, -500, 500)))
        if not pairs:
            return p
        inner = np.ones(len(score), bool)
        inner[self.starts] = False
        j = np.flatnonzero(inner)
        i = j - 1
        a, b = lo[i] + score[i], hi[j] + score[j]
        parts = np.stack([np.full(len(j), moves[0, 0]), moves[0, 1] + b, moves[1, 0] + a, moves[1, 1] + a + b])
        parts = np.exp(parts - parts.max(0))
        return p, (parts / parts.sum(0)).sum(1).reshape(2, 2), j


def _document(p: np.ndarray, owner: np.ndarray, size: np.ndarray, rows: int) -> np.ndarray:
    """Length-weighted sums of the marginals by document: the log-odds of their mean, the mean of their log-odds, the lowest mean of three lines."""
    weight = np.bincount(owner, size, rows)
    full = weight > 0
    safe = np.maximum(weight, 1)
    logit = lambda x: np.log(np.clip(x, 1e-4, 1 - 1e-4) / np.clip(1 - x, 1e-4, 1))
    mean = np.bincount(owner, size * p, rows) / safe
    odds = np.bincount(owner, size * logit(p), rows) / safe
    w, v = size.astype(float), size * p
    joined = owner[1:] == owner[:-1]
    w3, v3 = w.copy(), v.copy()
    w3[1:] += w[:-1] * joined
    v3[1:] += v[:-1] * joined
    w3[:-1] += w[1:] * joined
    v3[:-1] += v[1:] * joined
    low = np.ones(rows)
    np.minimum.at(low, owner, v3 / w3)
    out = np.stack([logit(mean), odds, logit(low), np.ones(rows)], 1)
    out[~full] = [0, 0, 0, 1]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (p - y) + l2 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * max(l2, 1e-6)
        w = w - np.linalg.solve(hess, grad)
    return w


def fit(texts: list[bytes], labels: np.ndarray, steps: int = 200, l2: float = 1e-3) -> Model:
    """Train on labelled texts; deterministic for the same rows in the same order."""
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    labels = np.asarray(labels, float)
    if not len(data) or labels.min() == labels.max():
        rate = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), np.zeros((2, 2)), np.array([0, 0, 0, np.log(rate / (1 - rate))]))
    parts = [line_features(data, bounds, lo, hi) + (lo,) for lo, hi in tk.blocks(bounds)]
    x = np.concatenate([p[0] for p in parts])
    owner = np.concatenate([p[1] + p[3] for p in parts])
    size = np.concatenate([p[2] for p in parts])
    mean, scale = x.mean(0), x.std(0)
    mean[-1], scale[scale < 1e-6] = 0, 1
    x = np.clip((x - mean) / scale, -6, 6)
    y = labels[owner]
    chains = Chains(owner)
    weights, moves = np.zeros(FEATURES), np.zeros((2, 2))
    lines = np.bincount(owner, minlength=len(texts))
    per = 1 / np.maximum(lines[owner], 1) ** 0.5  # long documents do not outweigh the others
    m = [np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)]
    for t in range(1, steps + 1):
        p, pair, j = chains.marginals(x @ weights, moves, pairs=True)
        seen = np.bincount((2 * y[j - 1] + y[j]).astype(np.int64), minlength=4).reshape(2, 2)
        grad = np.concatenate([x.T @ ((p - y) * per) / per.sum() + l2 * weights, ((pair - seen) / len(y)).ravel() + l2 * moves.ravel()])
        m[0] = 0.9 * m[0] + 0.1 * grad
        m[1] = 0.99 * m[1] + 0.01 * grad * grad
        step = 0.1 * m[0] / (1 - 0.9**t) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-8) * (1 - t / (steps + 1)) ** 0.5
        weights, moves = weights - step[:FEATURES], np.clip(moves - step[FEATURES:].reshape(2, 2), -2.5, 2.5)
    p = chains.marginals(x @ weights, moves)
    return Model(mean, scale, weights, moves, _logistic(_document(p, owner, size, len(texts)), labels))


def train(labelled: DataFrame) -> Model:
    """(doc_id, text, label 0/1), bounded in rows and bytes by its caller, as learn() does -> Model, trained on the driver."""
    rows = labelled.select("doc_id", text_or_empty().alias("text"), F.col("label").cast("int").alias("label")).where("label is not null").collect()
    rows = sorted(((r.doc_id, r.text.encode(), r.label) for r in rows), key=lambda r: (r[0], r[2], r[1]))
    model = fit([r[1] for r in rows], np.array([r[2] for r in rows])) if rows else fit([], np.zeros(1))
    del rows
    trim()
    return model


def _marginals(model: Model, data, bounds, lo, hi):
    x, owner, size = line_features(data, bounds, lo, hi)
    if not len(x):
        return np.zeros(0), owner, size
    x = np.clip((x - model.mean) / model.scale, -6, 6)
    return Chains(owner).marginals(x @ model.weights, model.moves), owner, size


def _score(shared):
    @tidy
    def run(batches):
        model = shared.value
        for batch in batches:
            data, bounds = tk.utf8(batch.column(1))
            out = np.zeros(batch.num_rows)
            for lo, hi in tk.blocks(bounds):
                p, owner, size = _marginals(model, data, bounds, lo, hi)
                out[lo:hi] = 1 / (1 + np.exp(-np.clip(_document(p, owner, size, hi - lo) @ model.curve, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> doc_id, score: the probability of good quality.

    Null, empty and blank texts have no line and get the curve's constant.  Each
    row is scored by itself: ties, repeated rows and a null doc_id change nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 150 numbers
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_score(shared), "doc_id long, score double")


def _lines(shared):
    @tidy
    def run(batches):
        model = shared.value
        for batch in batches:
            data, bounds = tk.utf8(batch.column(1))
            for lo, hi in tk.blocks(bounds):
                p, owner, size = _marginals(model, data, bounds, lo, hi)
                first = np.searchsorted(owner, owner)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner + lo)), pa.array(np.arange(len(owner)) - first), pa.array(size), pa.array(p)], names=["doc_id", "line", "n_bytes", "good"]
                )

    return run


def line_labels(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> doc_id, line (number among its lines that are not blank), n_bytes, good: each line's marginal."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_lines(shared), "doc_id long, line long, n_bytes long, good double")
