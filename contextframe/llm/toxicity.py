"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag is labelled.  A sentence's
score is logistic in the weight of its strongest word, so that weak words do not
add up; a document is toxic unless all of its sentences are clean (noisy-or),
and the likelihood of the documents' labels trains the weights, which then tell
where a toxic document offends.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import tokens as tk
from .common import checkpoint, let_go, text_or_empty, tidy, trim

#: Bytes that part words: all ASCII but letters, digits and the apostrophe.
APART = np.array([b < 128 and not (chr(b).isalnum() or b == 39) for b in range(256)])
STOP = np.zeros(256, bool)
STOP[[10, 13, 33, 46, 59, 63]] = True
#: A word's first bytes are features of their own, so forms of one stem are known by it.
HEADS = (4, 5, 6)
#: Chance reaches this likelihood ratio once in 10,000 words.
LEAST_GAIN = 15.1
NEVER = -40.0  # the log-odds of what does not happen


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


def _sentences(data, bounds, lo, hi):
    """Features of each word of rows lo..hi, the sentence of each word, the row of each sentence, each word's byte range."""
    h, first, s, e = tk.words_block(data, bounds, lo, hi, lower=True, space=APART, heads=HEADS)
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64), s, e
    at = int(bounds[lo])
    stops = np.concatenate([[0], np.cumsum(STOP[data[at : int(bounds[hi])]])])
    row = np.repeat(np.arange(hi - lo), np.diff(first))
    part = stops[s - at]
    new = np.concatenate([[True], (part[1:] != part[:-1]) | (row[1:] != row[:-1])])
    sentence = np.cumsum(new) - 1
    return h, sentence, row[new], s, e


def _softplus(z):
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def _found(h, words):
    k = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return k, (words[k] == h) & (h != 0)


def _word_scores(h, model):
    """A word scores as the strongest of its features."""
    k, hit = _found(h, model.words)
    return np.where(hit, model.weights[k], 0.0).max(1) if len(h) else np.zeros(0)


def _sentence_scores(h, sentence, model):
    """The log-odds of each sentence: the bias and its strongest word's weight."""
    if not len(h):
        return np.zeros(0)
    return model.bias + np.maximum.reduceat(_word_scores(h, model), np.flatnonzero(np.diff(sentence, prepend=-1)))


def _distinct(batches):
    """text, label -> a row for each distinct feature of a text: feature, label."""
    for batch in batches:
        data, bounds = tk.utf8(batch.column(0))
        label = batch.column(1).to_numpy()
        for lo, hi in tk.blocks(bounds):
            h, first, _, _ = tk.words_block(data, bounds, lo, hi, lower=True, space=APART, heads=HEADS)
            sets = [np.unique(h[first[k] : first[k + 1]]) for k in range(hi - lo)]
            owner = np.repeat(np.arange(lo, hi), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(label[owner], pa.int32())], names=["feature", "label"])


def _gather(words):
    """text, label -> label, sentences (their number), features of each word that has any, and the sentence of each."""

    @tidy
    def run(batches):
        for batch in batches:
            data, bounds = tk.utf8(batch.column(0))
            cols = [[], [], []]
            for lo, hi in tk.blocks(bounds):
                h, sentence, owner, _, _ = _sentences(data, bounds, lo, hi)
                k, hit = _found(h, words.value)
                at = np.flatnonzero(hit.any(1))
                features = np.where(hit, k, len(words.value))[at].astype(np.int32)
                cut = np.searchsorted(owner, np.arange(hi - lo + 1))
                part = np.searchsorted(sentence[at], cut)
                for d in range(hi - lo):
                    r = slice(part[d], part[d + 1])
                    cols[0].append(int(cut[d + 1] - cut[d]))
                    cols[1].append(features[r].tobytes())
                    cols[2].append((sentence[at[r]] - cut[d]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["label", "sentences", "features", "places"])

    return run


def fit(rows, words: np.ndarray, own: np.ndarray, steps: int = 200) -> Model:
    """Train on (label, number of sentences, features of words, their sentences); deterministic for the same rows.

    ``own`` is each feature's log-odds of a toxic document by itself; weights
    begin there and are drawn towards it as by a normal prior of variance 1, so
    few documents do not leave words unlearned that others explain away.
    """
    rows = [r for r in rows if r[1]]
    y = np.array([r[0] for r in rows], float)
    mean = max(np.mean([r[1] for r in rows] or [1]), 1)
    if not len(words) or not len(rows) or y.min() == y.max():
        return Model(np.zeros(1, np.uint64), np.zeros(1), NEVER if not len(rows) or y.min() < 1 else -NEVER)
    count = np.array([r[1] for r in rows])
    first = np.cumsum(count) - count
    k = np.concatenate([np.frombuffer(r[2], np.int32).reshape(-1, 1 + len(HEADS)) for r in rows])
    sent = np.concatenate([np.frombuffer(r[3], np.int32) + f for r, f in zip(rows, first, strict=True)])
    doc_of = np.repeat(np.arange(len(rows)), count)
    bias = float(np.log(np.expm1(-np.log1p(-0.02) / mean)))
    prior = np.append(own - bias, 0.0)
    weights = prior.copy()
    m = [np.zeros(len(words) + 2), np.zeros(len(words) + 2)]
    each = np.arange(len(k))
    begin = np.flatnonzero(np.diff(sent, prepend=-1))
    held = np.diff(np.append(begin, len(sent)))  # words of each sentence that has any
    for t in range(1, steps + 1):
        best = k[each, weights[k].argmax(1)]
        own_score = weights[best]
        top = np.maximum.reduceat(own_score, begin) if len(begin) else np.zeros(0)
        leads = own_score == np.repeat(top, held)
        z = np.full(len(doc_of), bias)
        z[sent[begin]] += top
        clean = np.exp(-np.bincount(doc_of, _softplus(z), len(rows)))
        pull = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0)
        dz = pull[doc_of] / (1 + np.exp(-np.clip(z, -500, 500)))
        grad = np.append(np.bincount(best, dz[sent] * leads, len(words) + 1) + (weights - prior), dz.sum()) / len(rows)
        grad[len(words)] = 0  # the place of no feature
        m[0] = 0.9 * m[0] + 0.1 * grad
        m[1] = 0.99 * m[1] + 0.01 * grad * grad
        step = 0.1 * m[0] / (1 - 0.9**t) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-8) * (1 - t / (steps + 1)) ** 0.5
        weights -= step[:-1]
        bias -= step[-1]
    return Model(words, weights[:-1], float(bias))


def train(labelled: DataFrame, max_docs: int = 8000, max_words: int = 4096, min_docs: int = 4) -> Model:
    """(doc_id, text, label 0/1) -> Model.

    At most ``max_docs`` labelled documents, those with the least hash of
    doc_id, are used, copies once; rows with a null label are left out.  Words and heads of
    words that are likelier in toxic documents than chance would have it are
    picked on the executors, and only their places reach the driver.  Without
    such words no sentence is toxic, however many there are; every one is if all
    labels are toxic.
    """
    some = labelled.where("label is not null").select("doc_id", text_or_empty().alias("text"), F.col("label").cast("int").alias("label"))
    some = checkpoint(some.orderBy(F.xxhash64(F.col("doc_id")), "doc_id", "label").limit(max_docs).select("text", "label").dropDuplicates(["text", "label"]))
    all_, bad = some.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    rate = bad / max(all_, 1)
    words, own = np.zeros(0, np.uint64), np.zeros(0)
    if 0 < rate < 1:
        here, ill = F.col("n"), F.col("ill")
        part = lambda x, p: F.when(x > 0, x * F.log(x / (here * p))).otherwise(0.0)
        counted = some.mapInArrow(_distinct, "feature long, label int").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ill"))
        gain = 2 * (part(ill, rate) + part(here - ill, 1 - rate))
        picked = counted.where((here >= min_docs) & (ill > here * rate) & (F.col("feature") != 0)).select("feature", gain.alias("gain"), "n", "ill").where(F.col("gain") >= LEAST_GAIN)
        found = sorted((r.feature % (1 << 64), r.n, r.ill) for r in picked.orderBy(F.desc("gain"), "feature").limit(max_words).collect())
        words = np.array([f[0] for f in found], np.uint64)
        own = np.array([np.log((f[2] + 0.5) / (f[1] - f[2] + 1.5)) for f in found])
    rows = []
    if len(words):
        shared = some.sparkSession.sparkContext.broadcast(words)
        rows = sorted((tuple(map(lambda v: bytes(v) if isinstance(v, bytearray) else v, r)) for r in some.mapInArrow(_gather(shared), "label int, sentences long, features binary, places binary").collect()))
    else:
        rows = [(r.label, 1, b"", b"") for r in some.select("label").collect()]
    model = fit(rows, words, own)
    del rows
    trim()
    let_go(labelled.sparkSession)
    return model


def _score(model):
    @tidy
    def run(batches):
        for batch in batches:
            data, bounds = tk.utf8(batch.column(1))
            out = np.zeros(batch.num_rows)
            for lo, hi in tk.blocks(bounds):
                h, sentence, owner, _, _ = _sentences(data, bounds, lo, hi)
                z = _sentence_scores(h, sentence, model.value)
                out[lo:hi] = -np.expm1(-np.bincount(owner, _softplus(z), hi - lo))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> doc_id, score: the probability that some sentence is toxic.

    Null, empty and wordless texts have no sentence and score 0.  Every row is
    scored by itself: repeated rows and a null doc_id change nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # max_words weights at most
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_score(shared), "doc_id long, score double")


def _offending(model, threshold):
    @tidy
    def run(batches):
        for batch in batches:
            data, bounds = tk.utf8(batch.column(1))
            cols = [[], [], [], []]
            for lo, hi in tk.blocks(bounds):
                h, sentence, owner, s, e = _sentences(data, bounds, lo, hi)
                p = 1 / (1 + np.exp(-_sentence_scores(h, sentence, model.value)))
                begin = np.flatnonzero(np.diff(sentence, prepend=-1))
                end = np.append(begin[1:], len(h)) - 1
                first = np.searchsorted(owner, owner)
                for k in np.flatnonzero(p >= threshold):
                    for c, v in zip(cols, (int(owner[k]) + lo, int(k - first[k]), data[s[begin[k]] : e[end[k]]].tobytes().decode(errors="replace"), float(p[k])), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64())],
                names=["doc_id", "sentence", "text", "score"],
            )

    return run


def offending_sentences(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text) -> doc_id, sentence (number within the document), text, score: sentences at or over ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        _offending(shared, threshold), "doc_id long, sentence long, text string, score double"
    )


def held_out_part(parts: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def learn(docs: DataFrame, labels: DataFrame, column: str, max_docs: int = 8000, max_bytes: int = 64 << 20) -> DataFrame:
    """Labelled training rows, doc_id, text, label: those whose crc32(doc_id) mod 3 is not 1.

    Bounded to ``max_docs`` documents and ``max_bytes`` of text in all, in the
    order of a hash of doc_id; the first one comes whatever its size.  Of a
    doc_id's labels the smallest counts, of its texts the smallest, so reruns
    learn from the same rows.
    """
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("label is not null and doc_id is not null").where(held_out_part(3) != 1)
    some = some.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    some = checkpoint(some)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = ids.join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # max_docs rows at most
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("upto", upto).where((F.col("upto") <= max_bytes) | (F.col("upto") == F.octet_length("text"))).select("doc_id", "text", "label")


def _below(shared, threshold, at):
    @tidy
    def run(batches):
        for batch in batches:
            data, bounds = tk.utf8(batch.column(at))
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi in tk.blocks(bounds):
                h, sentence, owner, _, _ = _sentences(data, bounds, lo, hi)
                z = _sentence_scores(h, sentence, shared.value)
                keep[lo:hi] = -np.expm1(-np.bincount(owner, _softplus(z), hi - lo)) < threshold
            yield batch.filter(pa.array(keep))

    return run


def below(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows, with all of their columns, whose ``text`` scores under ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_below(shared, threshold, docs.columns.index("text")), docs.schema)
