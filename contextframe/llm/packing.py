"""Pattern packing by non-negative least squares.

Token sequences of bounded length are filled from the length histogram alone.
Patterns of one to three lengths that fill a sequence exactly are enumerated,
their repeat counts fitted to the histogram by non-negative least squares and
rounded down; what remains is packed best-fit decreasing.  The plan depends on
the sequence length only, not on the number of documents.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import checkpoint, text_or_empty

END_ID = 2
_encoders: dict = {}


def encoder(path: str):
    """The byte-level BPE of a tokenizer file, its added tokens included: they have one id wherever a text holds them.

    The ``.tiktoken`` file beside a ``.json`` one holds the same vocabulary as
    ranks and gives the same ids at four times the speed; it is used where it
    exists, unless added tokens match in a way that ranks cannot state.
    """
    if path not in _encoders:
        import json
        import os

        ranks = path.removesuffix(".json") + ".tiktoken"
        added = []
        if os.path.exists(ranks):
            with open(path, encoding="utf-8") as spec:
                added = json.load(spec).get("added_tokens") or []
        names = [t["content"] for t in added]
        plain = not any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")) and not any(a != b and a in b for a in names for b in names)
        if os.path.exists(ranks) and plain:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={t["content"]: t["id"] for t in added})
            _encoders[path] = lambda text: own.encode(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            _encoders[path] = lambda text: own.encode(text, add_special_tokens=False).ids
    return _encoders[path]


def _pieces(path: str, limit: int):
    def run(batches):
        encode = encoder(path)
        for batch in batches:
            ids, cols = batch.column(0), [[] for _ in range(5)]
            for k, text in enumerate(batch.column(1)):
                seq = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                n = len(seq)
                count = -(-n // limit)
                head = n - limit * (count - 1)
                raw = seq.tobytes()
                for p in range(count):
                    start = 0 if p == 0 else head + limit * (p - 1)
                    size = head if p == 0 else limit
                    for c, v in zip(cols, (k, p, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)])), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def tokenize(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32: a row per piece of ``limit`` tokens at most.

    A null text counts as empty and gives one piece that holds the end id alone.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        _pieces(tokenizer, limit), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def patterns(limit: int, most: int = 3) -> np.ndarray:
    """Rows of ``most`` lengths, padded with 0, in descending order, that add up to ``limit``."""
    out = [np.array([[limit, 0, 0]])]
    if most > 1:
        a = np.arange(-(-limit // 2), limit)
        out.append(np.stack([a, limit - a, np.zeros_like(a)], 1))
    if most > 2:
        a, b = np.meshgrid(np.arange(1, limit), np.arange(1, limit), indexing="ij")
        c = limit - a - b
        ok = (a >= b) & (b >= c) & (c > 0)
        out.append(np.stack([a[ok], b[ok], c[ok]], 1))
    return np.concatenate(out)


def fit(hist: np.ndarray, pats: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts >= 0 that minimise the weighted squared misfit of the histogram.

    Accelerated projected gradient; misfit of length n is weighed by n / limit,
    so long documents, which are hard to place, are fitted first.
    """
    limit = len(hist) - 1
    weight = np.arange(limit + 1) / limit
    weight[0] = 0
    total = max(float(hist.sum()), 1.0)
    goal = hist / total * weight
    flat = pats.ravel()
    usable = (hist[pats] + (pats == 0) * 1).min(1) > 0
    pats, flat = pats[usable], pats[usable].ravel()
    if not len(pats):
        return np.zeros(len(usable))

    def apply(x):
        y = np.bincount(flat, np.repeat(x, pats.shape[1]), limit + 1)
        return y * weight

    def back(r):
        return (r * weight)[pats].sum(1)

    v = np.ones(len(pats))
    for _ in range(20):
        v = back(apply(v))
        v /= np.linalg.norm(v) or 1.0
    rate = 1.0 / max(float(np.linalg.norm(back(apply(v)))) * 1.01, 1e-12)
    x = z = np.zeros(len(pats))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, z - rate * back(apply(z) - goal))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    out = np.zeros(len(usable))
    out[usable] = x * total
    return out


def best_fit(hist: np.ndarray, plan: list) -> None:
    """Pack what is left of the histogram best-fit decreasing; works on counts of equal bins."""
    limit = len(hist) - 1
    bins: dict[int, dict[tuple, int]] = defaultdict(dict)  # by room: contents -> how many
    room = np.zeros(limit + 1, bool)
    for size in range(limit, 0, -1):
        left = int(hist[size])
        while left:
            fits = np.flatnonzero(room[size:])
            if not len(fits):
                each = limit // size
                if left >= each:
                    contents, n = (size,) * each, left // each
                else:
                    contents, n = (size,) * left, 1
                left -= n * len(contents)
            else:
                at = int(fits[0]) + size
                contents, have = next(iter(bins[at].items()))
                each = min(at // size, left)
                n = min(have, left // each)
                if n == have:
                    del bins[at][contents]
                    room[at] = bool(bins[at])
                else:
                    bins[at][contents] = have - n
                contents, left = contents + (size,) * each, left - n * each
            free = limit - sum(contents)
            bins[free][contents] = bins[free].get(contents, 0) + n
            room[free] = free > 0
    for group in bins.values():
        plan += group.items()


def make_plan(hist: np.ndarray) -> list[tuple[tuple, int]]:
    """(contents, repeats): every length of the histogram is placed exactly as often as it occurs."""
    limit = len(hist) - 1
    left = hist.astype(np.int64).copy()
    pats = patterns(limit)
    counts = fit(hist.astype(float), pats)
    plan: list = []
    for k in np.argsort(-counts, kind="stable"):
        n = int(counts[k] + 1e-6)
        if n < 1:
            break
        contents = tuple(int(v) for v in pats[k] if v)
        need = np.bincount(contents, minlength=limit + 1)
        used = np.flatnonzero(need)
        n = min(n, int((left[used] // need[used]).min()))
        if n > 0:
            left[used] -= n * need[used]
            plan.append((contents, n))
    best_fit(left, plan)
    return plan


def _slots(plan, limit: int):
    """By length: first rank, sequence and offset of each run of equal slots."""
    by: dict[int, list] = defaultdict(list)
    rank = defaultdict(int)
    base = 0
    for contents, n in plan:
        at = 0
        for size in contents:
            by[size].append((rank[size], base, at))
            rank[size] += n
            at += size
        base += n
    return {size: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for size, rows in by.items()}


def _place(slots):
    def run(batches):
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                first, base, place = slots.value[int(s)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                seq[at], off[at] = base[k] + rank[at] - first[k], place[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, limit: int = 1024, salts: int = 512) -> DataFrame:
    """Add sequence_id and offset to pieces of 1..limit tokens.

    Only the histogram (``limit`` numbers) reaches the driver, and the plan that
    goes back is bounded by ``limit`` as well.  Pieces are ranked within their
    length over ``salts`` parts of each length, so a length that a third of all
    pieces share is dealt out too.  No pieces give no rows; equal rows are
    pieces of their own.
    """
    session = pieces.sparkSession
    pieces = checkpoint(pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")))
    parts = checkpoint(pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    hist = np.zeros(limit + 1, np.int64)
    for row in parts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        hist[row.length] = row.n
    slots = session.sparkContext.broadcast(_slots(make_plan(hist), limit))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        pieces.withColumn("at", F.row_number().over(within))
        .join(offsets, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("at") - 1).alias("rank"))
    )
    return ranked.mapInArrow(_place(slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    return pack(tokenize(docs, tokenizer, limit), limit)
