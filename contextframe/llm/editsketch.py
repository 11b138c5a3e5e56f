"""Document fingerprints by randomised edit embedding.

A walk reads a text while writing a longer string: at step j it writes the
current character and moves on if a random bit shared by all texts, the one of
step j and that character, is set.  Texts at a small edit distance fall into
step again and write strings at a small Hamming distance.  A fingerprint samples
the written string at ``BINS`` shared random steps, one byte for each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tokens as tk
from .common import let_go, stored, text_or_empty, tidy
from .graph import components

BINS = 128
PERIOD = 4096
KINDS = 256
CONTEXT = 4
WORD = 7  # bytes of a fingerprint that verification compares at a time; as a long it is not negative
BLOCK_CHARS = 6 << 20


def _leaps(seed: int = 11) -> np.ndarray:
    """Steps that the walk spends on a character of each kind, by the step at which it arrives."""
    bits = np.random.default_rng(seed).random((KINDS, PERIOD)) < 0.5
    bits[:, -1] = True
    out = np.empty((KINDS, PERIOD), np.int64)
    wait = np.ones(KINDS, np.int64)
    for t in list(range(PERIOD - 1, -1, -1)):
        wait = np.where(bits[:, t], 1, wait + 1)
        out[:, t] = wait
    return out.ravel()


def _records(seed: int = 12, upto: int = 1 << 44, width: int = 64) -> np.ndarray:
    """By bin, the steps at which a shared random sequence falls to a new low.

    The last of them below L is uniform over the first L steps, and the same
    for two lengths but for the share by which they differ.
    """
    rng = np.random.default_rng(seed)
    out = np.full((BINS, width), upto, np.int64)
    for b in range(BINS):
        at, low = 0, rng.random()
        for k in range(width):
            out[b, k] = at
            at += int(rng.geometric(max(low, 1e-13)))
            low *= rng.random()
            if at >= upto:
                break
    return out


LEAPS = _leaps()
RECORDS = _records()
BIN_SEEDS = tk.mix(np.arange(1, BINS + 1, dtype=np.uint64))


def _walk(kinds: np.ndarray, starts: np.ndarray, lens: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The step after each character, for many texts laid end to end; ``begin`` is each walk's first step."""
    after = np.empty(len(kinds), np.int64)
    order = np.argsort(-lens, kind="stable")
    starts, falling, t = starts[order], -lens[order], begin[order].copy()
    base = kinds.astype(np.int64) * PERIOD
    n = len(t)
    for i in range(int(lens.max()) if len(lens) else 0):
        while n and falling[n - 1] > -(i + 1):
            n -= 1
        at = starts[:n] + i
        t[:n] += LEAPS[base[at] + (t[:n] & (PERIOD - 1))]
        after[at] = t[:n]
    return after


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _kinds(points: np.ndarray) -> np.ndarray:
    return ((points * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)


def _sample(after: np.ndarray, points: np.ndarray) -> np.ndarray:
    """A byte for each bin: a hash of the characters from where the walk is at the bin's step."""
    if not len(points):
        return np.zeros(BINS, np.uint8)
    last = (RECORDS < after[-1]).sum(1) - 1
    at = np.searchsorted(after, RECORDS[np.arange(BINS), last], side="right")
    x = BIN_SEEDS.copy()
    for k in range(CONTEXT):
        p = np.minimum(at + k, len(points) - 1)
        x = (x ^ np.where(at + k < len(points), points[p], 0).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    return (x >> np.uint64(16)).astype(np.uint8)


def _walked(points: list[np.ndarray], begin: np.ndarray) -> list[np.ndarray]:
    """Walks of many texts, in blocks of bounded size."""
    out, lo = [], 0
    sizes = np.array([len(p) for p in points], np.int64)
    ends = np.cumsum(sizes)
    while lo < len(points):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK_CHARS, side="right")))
        lens = sizes[lo:hi]
        starts = np.cumsum(lens) - lens
        after = _walk(_kinds(np.concatenate(points[lo:hi])), starts, lens, begin[lo:hi])
        out += [after[s : s + n] for s, n in zip(starts, lens, strict=True)]
        lo = hi
    return out


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    points = [_points(t) for t in texts]
    return [_sample(a, p) for a, p in zip(_walked(points, np.zeros(len(points), np.int64)), points, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def with_edits(texts: list[str]):
    """For all texts but the last: fingerprint, edited text, its fingerprint; and the last text's fingerprint.

    An edited text is the text with its last half replaced by as much of the
    next one.  Both share the walk over the first half.
    """
    points = [_points(t) for t in texts]
    walks = _walked(points, np.zeros(len(points), np.int64))
    prints = [_sample(a, p) for a, p in zip(walks, points, strict=True)]
    cut = [len(p) - len(p) // 2 for p in points[:-1]]
    tails = [b[: len(a) // 2] for a, b in zip(points[:-1], points[1:], strict=True)]
    begin = np.array([w[c - 1] if c else 0 for w, c in zip(walks, cut)], np.int64)
    ends = _walked(tails, begin)
    edited = []
    for k, (c, tail, end) in enumerate(zip(cut, tails, ends, strict=True)):
        edited.append(_sample(np.concatenate([walks[k][:c], end]), np.concatenate([points[k][:c], tail])))
    changed = [a[:c] + b[: len(a) // 2] for a, b, c in zip(texts[:-1], texts[1:], cut)]
    return prints, changed, edited


PACKED = pa.Codec("zstd", compression_level=1)
ROW = [("kind", pa.int8()), ("doc_id", pa.int64()), ("place", pa.int64()), ("text", pa.large_string())]


def _pack(rows: pa.RecordBatch) -> bytes:
    """Rows of one block as one compressed blob: texts travel once, and small."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions()) as out:
        out.write_batch(rows)
    raw = sink.getvalue()
    return raw.size.to_bytes(8, "little") + PACKED.compress(raw, asbytes=True)


def _unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(PACKED.decompress(blob[8:], int.from_bytes(blob[:8], "little"))).read_all()


def _deal(bounds: np.ndarray, least: int):
    """Send each row to its block, and the row that follows a block's last to that block as well."""

    @tidy
    def run(batches):
        for batch in batches:
            key = batch.column(1).to_numpy()
            block = np.searchsorted(bounds, key, side="right")
            first = np.isin(key, bounds) & (block > 0)
            fringe = np.flatnonzero(first)
            round_ = np.flatnonzero(key == least)
            rows = np.concatenate([np.arange(len(key)), fringe, round_])
            to = np.concatenate([block, block[fringe] - 1, np.full(len(round_), len(bounds))])
            kind = np.concatenate([np.zeros(len(key), np.int8), np.ones(len(fringe), np.int8), np.full(len(round_), 2, np.int8)])
            order = np.argsort(to, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(to[order])) + 1, len(order))
            blocks, blobs, lo = [], [], 0
            for hi in ends:
                at = order[lo:hi]
                got = batch.take(pa.array(rows[at]))
                columns = [pa.array(kind[at]), *(got.column(i).cast(t) for i, (_, t) in enumerate(ROW[1:]))]
                blocks.append(int(to[at[0]]))
                blobs.append(_pack(pa.RecordBatch.from_arrays(columns, schema=pa.schema(ROW))))
                lo = hi
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(blobs, pa.binary())], names=["block", "blob"])

    return run


def _block(packed: pa.Table) -> pa.Table:
    table = pa.concat_tables([_unpack(b.as_py()) for b in packed.column("blob")])
    table = table.sort_by([("kind", "ascending"), ("place", "ascending"), ("text", "ascending")])
    kind = table.column("kind").to_numpy()
    own = int((kind == 0).sum())
    texts = [t.as_py() for t in table.column("text").slice(0, min(len(table), own + 1))]
    if own == 0:
        texts = []
    elif len(texts) == own:  # no block follows and none began: cannot be, the first row always comes round
        raise ValueError("a block lacks the row that follows it")
    out = [[] for _ in range(7)]
    lo = 0
    while lo < own:
        hi, chars = lo, 0
        while hi < own and (hi == lo or chars < BLOCK_CHARS):
            chars += len(texts[hi])
            hi += 1
        prints, changed, edited = with_edits(texts[lo : hi + 1])
        for k in range(hi - lo):
            row = (
                len(texts[lo + k]),
                hashlib.sha256(changed[k].encode()).hexdigest(),
                prints[k].tobytes().hex(),
                edited[k].tobytes().hex(),
                likeness(prints[k], edited[k]),
                likeness(prints[k], prints[k + 1]),
            )
            for c, v in zip(out[1:], row, strict=True):
                c.append(v)
        lo = hi
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.table([table.column("doc_id").slice(0, own).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(out[1:], kinds, strict=True))], names=names)


def fingerprint_and_edit(docs: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents follow each other by doc_id, the first one follows the last, and
    a lone document follows itself.  Null doc_ids come first, equal ones are
    ordered by text.  A null text is empty; an empty text has the fingerprint of
    zeros.  Blocks of neighbours are cut at quantiles of doc_id, so texts are
    shuffled once; only the cuts reach the driver.
    """
    first = -(1 << 63)
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(first)).alias("place"), text_or_empty().alias("text")
    )
    facts = source.agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("place").alias("least")).first()
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if facts.least is None:
        return docs.sparkSession.createDataFrame([], schema)
    blocks = max(1, -(-int(facts.bytes or 0) // block_bytes))
    cuts: list = []
    if blocks > 1:
        at = [k / blocks for k in range(1, blocks)]
        cuts = source.select("place").agg(F.percentile_approx("place", at, 20 * blocks).alias("cuts")).first().cuts
    bounds = np.unique(np.array([c for c in cuts if c > facts.least], np.int64))
    dealt = source.mapInArrow(_deal(bounds, facts.least), "block long, blob binary")
    return dealt.groupBy("block").applyInArrow(_block, schema)


def _bytes_apart(x):
    """How many bytes of a long are not zero."""
    for shift in (4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
    return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))


def near_pairs(prints: DataFrame, least: float = 0.7, rounds: int = 2) -> DataFrame:
    """(doc_id, fingerprint) -> src, dst, likeness: bit-sampled banding, then verification.

    Chains of pairs join whatever a chain of pairs of likeness ``least`` or more
    joins.  The bands part the bytes into one set more than the bytes by which
    such a pair may differ, so it agrees in all bytes of at least one band.  In
    each bucket a leader is compared with the others; documents that pairs
    already join are not compared again, and what is still apart after
    ``rounds`` such passes is compared completely.  Equal fingerprints are one
    class and pair with its first document only.  Likeness is that of the
    fingerprints; the texts are not read.
    """
    fewest = int(np.ceil(least * BINS - 1e-9))
    classes = stored(
        prints.where("fingerprint is not null and doc_id is not null")
        .groupBy("fingerprint")
        .agg(F.min("doc_id").alias("rep"))
        .withColumn("words", F.array(*(F.conv(F.substring("fingerprint", 2 * i + 1, 2 * WORD), 16, 10).cast("long") for i in range(0, BINS, WORD))))
    )
    bands = np.array_split(np.random.default_rng(13).permutation(BINS), BINS - fewest + 1)
    keys = [F.xxhash64(F.lit(b), *(F.substring("fingerprint", int(2 * p + 1), 2) for p in band)) for b, band in enumerate(bands)]
    keyed = classes.select("rep", F.explode(F.array(*keys)).alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    member = stored(keyed.join(shared, "key"))
    words = classes.select("rep", "words")

    def alike(a: str, b: str):
        return F.lit(BINS) - sum((_bytes_apart(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(-(-BINS // WORD))), F.lit(0))

    links = labels = None
    for turn in range(rounds + 1):
        let_go(prints.sparkSession)
        if labels is None:
            now = member.withColumn("label", F.col("rep"))
        else:
            now = member.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
            mixed = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
            now = stored(now.join(mixed, "key", "left_semi"))
        if now.isEmpty():
            break
        if turn < rounds:
            order = F.col("rep") if turn == 0 else F.xxhash64("rep", F.lit(turn))
            lead = now.groupBy("key").agg(F.min_by(F.struct("rep", "label"), order).alias("lead"))
            pairs = now.join(lead, "key").where("label <> lead.label").select(F.least("rep", "lead.rep").alias("src"), F.greatest("rep", "lead.rep").alias("dst")).distinct()
            pairs = pairs.join(words.toDF("src", "a"), "src").join(words.toDF("dst", "b"), "dst").select("src", "dst", alike("a", "b").alias("same")).where(F.col("same") >= fewest)
        else:
            wide = now.join(words, "rep")
            x, y = wide.toDF("src", "key", "la", "a"), wide.toDF("dst", "key", "lb", "b")
            pairs = x.join(y, "key").where((F.col("src") < F.col("dst")) & (F.col("la") != F.col("lb")) & (alike("a", "b") >= fewest)).select("src", "dst", alike("a", "b").alias("same"))
        found = stored(pairs.groupBy("src", "dst").agg((F.max("same") / BINS).alias("likeness")))
        links = found if links is None else links.union(found)
        if turn < rounds and not links.isEmpty():
            labels = components(links)
    copies = prints.join(classes, "fingerprint").where("doc_id <> rep").select(F.col("rep").alias("src"), F.col("doc_id").alias("dst"), F.lit(1.0).alias("likeness"))
    return copies if links is None else links.union(copies)


def near_groups(prints: DataFrame, least: float = 0.8, broadcast_ids: int = 1_000_000) -> DataFrame:
    """(doc_id, fingerprint, ...) -> the same with near_group: the smallest doc_id that chains of near_pairs() join it to.

    A document that is near no other is a group of its own; a null doc_id has no
    group.  ``prints`` is read more than once, so it should be a stored table.
    Groups are joined by a broadcast of at most ``broadcast_ids`` rows, and by a
    shuffle beyond.
    """
    labels = components(near_pairs(prints.select("doc_id", "fingerprint"), least).select("src", "dst")).toDF("near_id", "near_group")
    few = labels.limit(broadcast_ids + 1).count() <= broadcast_ids
    out = prints.join(F.broadcast(labels) if few else labels, prints.doc_id == F.col("near_id"), "left")
    return out.select(*prints.columns, F.coalesce("near_group", "doc_id").alias("near_group"))
