"""Held-out accuracy of the trained operators, and the pipeline's stages against their operators."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contextframe.llm import mixing, neardup, quality, substring, toxicity
from contextframe.llm import tokens as tk
from contextframe.llm.queries import op5_quality, op10_toxicity

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("query, label", [(op5_quality, "quality"), (op10_toxicity, "toxic")])
def test_held_out(spark, query, label):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = query(spark, DATA).join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(label).alias("y")).collect()
    y, score = np.array([r.y for r in rows]), np.array([r.score for r in rows])
    assert ((score >= 0) & (score <= 1)).all()
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.9
    assert np.mean([r.predicted == r.y for r in rows]) > 0.9


def test_offending_sentences(spark):
    rows = [(i, f"All is well here n{i}. {'You filthy grub.' if i % 3 == 0 else 'It is fine.'} Then on we go.", int(i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.train(df)
    found = toxicity.offending_sentences(df, model).collect()
    assert {(r.doc_id, r.sentence, r.text) for r in found} == {(i, 1, "You filthy grub") for i in range(0, 90, 3)}
    scores = {r.doc_id: r.score for r in toxicity.score(df.select("doc_id", F.when(F.col("doc_id") > 2, F.col("text")).alias("text")), model).collect()}
    assert scores[0] == 0 and scores[3] > 0.7 and scores[4] < 0.5
    assert {r.doc_id for r in toxicity.below(df, model).collect()} == {i for i in range(90) if i % 3}


def test_models_without_both_labels(spark):
    df = spark.createDataFrame([(1, "a b", 1), (2, None, 1)], "doc_id long, text string, label int")
    for module in (quality, toxicity):
        assert module.score(df, module.train(df)).count() == 2
        assert module.score(df, module.train(df.limit(0))).count() == 2
        assert module.score(df.limit(0), module.train(df)).count() == 0


def test_toxicity_without_evidence(spark):
    """Few labels tell no words apart: then long documents are not toxic for their length."""
    rows = [(i, f"Sentence one of n{i}. " * 200, int(i < 2)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    assert max(r.score for r in toxicity.score(df, toxicity.train(df)).collect()) < 0.1
    assert min(r.score for r in toxicity.score(df, toxicity.train(df.withColumn("label", F.lit(1)))).collect()) > 0.9


def test_line_labels(spark):
    model = quality.fit([b"fine words here.\nand more of them.", b"BUY!! NOW!!\nBUY!! NOW!!"] * 20, np.array([1, 0] * 20))
    df = spark.createDataFrame([(1, "fine words here.\nand more.\n\nBUY!! NOW!!\nBUY!! NOW!!")], "doc_id long, text string")
    lines = {r.line: r.good for r in quality.line_labels(df, model).collect()}
    assert len(lines) == 4 and lines[0] > lines[3]


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    owner = np.array([0, 0, 0, 1, 2, 2])
    score, moves = rng.normal(size=6), rng.normal(size=(2, 2))
    got, pairs, _ = quality.Chains(owner).marginals(score, moves, pairs=True)
    want, expected = np.zeros(6), np.zeros((2, 2))
    for doc in range(3):
        at = np.flatnonzero(owner == doc)
        total, good, moved = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for bits in range(1 << len(at)):
            y = [bits >> k & 1 for k in range(len(at))]
            w = np.exp(sum(score[i] for i, b in zip(at, y) if b) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
            for a, b in zip(y, y[1:]):
                moved[a, b] += w
        want[at] = good / total
        expected += moved / total
    assert np.allclose(got, want) and np.allclose(pairs, expected)


def test_toxicity_scores_against_a_plain_version(spark):
    """Noisy-or over sentences that score as their strongest word, word by word in Python."""
    words = ["grub", "filthy", "rot"]
    hashes = tk.words(np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, 15]), True)[0]
    order = np.argsort(hashes)
    weights = dict(zip(words, (2.0, 3.0, -1.0), strict=True))
    model = toxicity.Model(hashes[order], np.array([weights[words[k]] for k in order]), -4.0)
    texts = ["You filthy grub! Go. Rot", "all is well", "", None, "grub\ngrub. FILTHY; rot rot?", "rot"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(docs, model).collect():
        clean = 1.0
        for sentence in re.split(r"[\n\r!.;?]", (texts[r.doc_id] or "").lower()):
            if found := re.findall(r"[a-z0-9']+", sentence):
                clean *= 1 - 1 / (1 + np.exp(4.0 - max(max(weights.get(w, 0.0), 0.0) for w in found)))
        assert r.score == pytest.approx(1 - clean)


def test_line_features_against_a_plain_version():
    """The features of a line by themselves, from strings."""
    texts = ["Buy NOW!! ok\n\nBuy NOW!! ok\n 12 a a |x| ...", "", "One line.", "é à\t~~ b"]
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    x, owner, size = quality.line_features(np.frombuffer(b"".join(raw), np.uint8), bounds, 0, len(raw))
    k = 0
    for doc, text in enumerate(texts):
        lines = [w for w in (line.encode().split() for line in text.split("\n")) if w]
        for n, words in enumerate(lines):
            line = next(x for x in [l.encode().strip(b" \t") for l in text.split("\n")] if x.split() == words)
            count = lambda f, part=line: sum(bool(f(bytes([b]))) for b in part)
            mark = lambda b: 32 < b[0] < 127 and not b.isalnum() and b not in b",.;:'\"()-"
            upper, lower, high = count(bytes.isupper), count(bytes.islower), count(lambda b: b[0] > 127)
            some = len(words)
            want = [
                np.log1p(len(line)), np.log1p(some), len(line) / some / 10, upper / (upper + lower + high + 1), high / (upper + lower + high + 1), count(bytes.isdigit) / len(line),
                (count(mark) / len(line)) ** 0.5, (line.count(b"!") / len(line)) ** 0.5, (count(lambda b: b in b"|<>{}=\\/_") / len(line)) ** 0.5, count(lambda b: b in b".?!;:,") / some,
                sum(any(mark(bytes([b])) for b in w) for w in words) / some, sum(len(w) <= 2 for w in words) / some, (some - len(set(words))) / some, float(words in lines[:n]), float(line[-1:] in b".!?"), float(count(mark) > 0.2 * some),
            ]
            assert owner[k] == doc and size[k] == len(line) and x[k, : quality.OWN] == pytest.approx(want)
            if n:
                assert (x[k, quality.OWN : 2 * quality.OWN] == x[k - 1, : quality.OWN]).all()
            k += 1
    assert k == len(x)


def test_learning_is_bounded_and_repeatable(spark):
    rows = [(i, f"text {i} {'x' * 100}") for i in range(200)] + [(8, "another text"), (6, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(8, 0), (7, None)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learn = lambda d, **more: sorted(map(tuple, toxicity.learn(d, labels, "quality", **more).collect()))
    got = learn(docs)
    assert got == learn(docs.repartition(7)) and len(got) == len({r[0] for r in got}) and (8, "another text", 0) in got
    few = learn(docs, max_bytes=1000)
    assert 0 < len(few) < 20 and set(few) < set(got) and len(learn(docs, max_docs=9)) == 9 and len(learn(docs, max_bytes=1)) == 1


def test_pipeline_of_awkward_tables(spark, tmp_path):
    """Nulls everywhere, repeated rows, columns whose names clash with those of the operators; and no rows at all."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    more = ["label", "score", "hits", "row", "cid", "key", "taken_id", "taken_copies", "mix_id", "strip_id", "size", "part", "kept_id"]
    wide = base.select("*", *(F.lit(k).alias(c) for k, c in enumerate(more)))
    null = wide.limit(1).select(*(F.lit(None).cast(t).alias(c) for c, t in wide.dtypes))
    for name, docs in (("some", wide.union(wide.limit(3)).union(null).union(null)), ("none", wide.limit(0))):
        for stage, run in corpus_pipeline.STAGES:
            out = run(spark, docs, "/root/testdata/sf0.001")
            assert stage == "packing" or out.dtypes == wide.dtypes
            out.write.parquet(f"{tmp_path}/{name}/{stage}")
            docs = spark.read.parquet(f"{tmp_path}/{name}/{stage}")
        assert docs.isEmpty() == (name == "none")


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], DATA)
        out.write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    for df in seen[1:-1]:
        assert df.columns == docs.columns
    ids = [sorted(r.doc_id for r in df.select("doc_id").collect()) for df in seen[:-1]]
    scores = op10_toxicity(spark, DATA)
    assert ids[1] == sorted(r.doc_id for r in scores.where("score < 0.7").collect())
    assert ids[2] == sorted(r.doc_id for r in neardup.near_duplicates(seen[1], 5).where("kept").collect())
    assert ids[3] == ids[2]
    want = {r.doc_id: r.kept for r in substring.remove_repeats(seen[2], with_text=True).where("n_removed > 0").collect()}
    before = {r.doc_id: r.text for r in seen[2].collect()}
    assert {r.doc_id: r.text for r in seen[3].collect()} == before | want
    copies = {r.doc_id: r.copies for r in mixing.mix_documents(seen[3]).collect()}
    assert ids[4] == sorted(i for i, n in copies.items() for _ in range(n))
    packed = seen[5].where("piece = 0").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in packed} == {i: n for i, n in copies.items() if n}
