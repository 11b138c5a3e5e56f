"""Language-model scores of an interpolated modified Kneser-Ney model of three words.

Counting goes in passes, each over the triples whose middle word's hash lies in
one range, so that no more than a share of them is on its way at a time.  Tasks
count their own triples and deal them, by ranges of the triple's hash, to shards
that add the counts up, write them, and pass on what they know of the pairs
(first, middle) as contexts and (middle, last) as words after one; a second
exchange adds that up and writes it, and a last one does the same by word.  No
exchange is keyed by a word or a pair, so common ones burden no task.

Files are sorted arrays of hashes in the shared folder: 32 bits and 16 bits of a
hash's place in the file's range, a byte for each count, and a list of the
larger counts.  Contexts that occur once are not written, as their pairs are.
Workers map the files into memory.
"""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tokens as tk
from .common import checkpoint_dir, discard, let_go, stored, text_or_empty, tidy, trim

START, END = np.uint64(0x5F3759DF5F3759DF), np.uint64(0xC0FFEE00C0FFEE01)
FLUSH = 1 << 20
SHARD_BYTES = 6 << 20  # of text whose triples one task adds up in a pass
SCORE_CHUNK = 2 << 20
MOST_MAPPED = 16_384  # files that a worker keeps mapped
LARGE = 255
PACKED = pa.Codec("zstd", compression_level=1)


# ---- files in the folder that all executors share


def _local(folder: str) -> str | None:
    u = urlparse(folder)
    return u.path if u.scheme in ("", "file") else None


def _write(folder: str, name: str, raw: bytes) -> None:
    """Whole or not at all; a task that runs twice writes the same bytes twice."""
    own = f"{name}.{uuid.uuid4().hex}.part"
    if (path := _local(folder)) is not None:
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{own}", "wb") as out:
            out.write(raw)
        os.replace(f"{path}/{own}", f"{path}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{own}") as out:
        out.write(raw)
    store.move(f"{path}/{own}", f"{path}/{name}")


def _mapped(handle) -> np.ndarray:
    """A file's bytes, mapped into memory without holding its descriptor, where Python can do without."""
    size = os.fstat(handle.fileno()).st_size
    if not size:
        return np.zeros(0, np.uint8)
    try:
        whole = mmap.mmap(handle.fileno(), size, access=mmap.ACCESS_READ, trackfd=False)
    except TypeError:  # before Python 3.13
        whole = mmap.mmap(handle.fileno(), size, access=mmap.ACCESS_READ)
    return np.frombuffer(whole, np.uint8)


def _read(folder: str, name: str) -> np.ndarray | None:
    """One file's bytes, mapped into memory; from a remote store through a copy without a name."""
    if (path := _local(folder)) is not None:
        if not os.path.exists(f"{path}/{name}"):
            return None
        with open(f"{path}/{name}", "rb") as have:
            return _mapped(have)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
        return None
    with tempfile.TemporaryFile() as copy, store.open_input_stream(f"{path}/{name}") as have:
        while chunk := have.read(8 << 20):
            copy.write(chunk)
        copy.flush()
        return _mapped(copy)


def _cut(k: int, parts: int) -> int:
    return (k << 64) // parts


def _ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of ``parts`` equal ranges of hashes within sorted keys."""
    cuts = np.array([_cut(k, parts) for k in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])


def _place(keys: np.ndarray, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading 48 bits of where hashes stand in range ``part`` of ``parts``, as 32 and 16 bits; in the hashes' order."""
    low, wide = _cut(part, parts), _cut(part + 1, parts) - _cut(part, parts)
    place = (keys - np.uint64(low)) >> np.uint64(max((wide - 1).bit_length() - 48, 0))
    return (place >> np.uint64(16)).astype(np.uint32), (place & np.uint64(0xFFFF)).astype(np.uint16)


def _file(keys: np.ndarray, values: list[np.ndarray], part: int, parts: int) -> bytes:
    """Sorted hashes of one range with their counts."""
    high, low = _place(keys, part, parts)
    values = np.stack(values, 1)
    over = np.flatnonzero((values >= LARGE).any(1))
    small = np.minimum(values, LARGE).astype(np.uint8)
    small[over, 0] = LARGE
    head = np.array([len(keys), len(over)], np.int64)
    return b"".join(np.ascontiguousarray(x).tobytes() for x in (head, values[over].astype(np.int64), over.astype(np.int64), high, low, small))


class _Sorted:
    """One file, mapped: values of hashes."""

    def __init__(self, raw: np.ndarray | None, width: int, part: int, parts: int):
        self.n, self.width, self.part, self.parts = 0, width, part, parts
        if raw is None or not len(raw):
            return
        self.n, m = (int(x) for x in raw[:16].view(np.int64))
        at = 16

        def take(count, kind):
            nonlocal at
            size = count * np.dtype(kind).itemsize
            out = raw[at : at + size].view(kind)
            at += size
            return out

        self.large, self.over = take(m * width, np.int64).reshape(m, width), take(m, np.int64)
        self.high, self.low, self.small = take(self.n, np.uint32), take(self.n, np.uint16), take(self.n * width, np.uint8).reshape(self.n, width)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """A row of values for each key, zeros where there is none."""
        out = np.zeros((len(keys), self.width), np.int64)
        if not self.n:
            return out
        high, low = _place(keys, self.part, self.parts)
        at, open_ = np.searchsorted(self.high, high), np.arange(len(keys))
        while len(open_):
            open_ = open_[at[open_] < self.n]
            open_ = open_[self.high[at[open_]] == high[open_]]
            hit = self.low[at[open_]] == low[open_]
            found = open_[hit]
            rows = self.small[at[found]].astype(np.int64)
            large = rows[:, 0] == LARGE
            if large.any():
                rows[large] = self.large[np.searchsorted(self.over, at[found[large]])]
            out[found] = rows
            open_ = open_[~hit]
            at[open_] += 1
        return out


def _pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return tk.mix(tk.mix(v) * np.uint64(3) + w)


def _triple_hash(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return tk.mix(_pair_hash(u, v) * np.uint64(5) + w)


NO_WORDS = _pair_hash(np.array([START]), np.array([START]))[0]


def _pass_of(v: np.ndarray, passes: int) -> np.ndarray:
    """Which pass counts the triples around a word."""
    return ((tk.mix(v ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)) * np.uint64(passes)) >> np.uint64(32)


def _sequence(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, middle, last) word of every triple: rows have two STARTs before their words and END after them."""
    rows = len(first) - 1
    out = np.full(len(h) + 3 * rows, START, np.uint64)
    row = np.repeat(np.arange(rows), np.diff(first))
    out[np.arange(len(h)) + 3 * row + 2] = h
    out[first[1:] + 3 * np.arange(rows) + 2] = END
    last = np.ones(len(out), bool)
    begin = first[:-1] + 3 * np.arange(rows)
    last[begin] = last[begin + 1] = False
    at = np.flatnonzero(last)
    return out[at - 2], out[at - 1], out[at]


# ---- counting

BLOB = "part int, blob binary"


def _squeeze(*columns: np.ndarray) -> bytes:
    raw = b"".join([np.array([len(c) for c in columns], np.int64).tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns)])
    return len(raw).to_bytes(8, "little") + PACKED.compress(raw, asbytes=True)


def _expand(blobs, *kinds) -> list[np.ndarray]:
    """The columns of all blobs, end to end."""
    out = [[] for _ in kinds]
    for blob in blobs:
        blob = blob.as_py()
        raw = PACKED.decompress(blob[8:], int.from_bytes(blob[:8], "little"))
        at = 8 * len(kinds)
        for o, n, kind in zip(out, np.frombuffer(raw, np.int64, len(kinds)), kinds, strict=True):
            o.append(np.frombuffer(raw, kind, n, at))
            at += int(n) * np.dtype(kind).itemsize
    return [np.concatenate(o) if o else np.zeros(0, k) for o, k in zip(out, kinds, strict=True)]


def _blobs(parts, blobs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, and where in it each distinct key begins."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _sums(order, at, *values) -> list[np.ndarray]:
    return [np.add.reduceat(v[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64) for v in values]


def _spectrum(count: np.ndarray) -> list[np.ndarray]:
    """Whether counts are 1, 2, and more."""
    return [count == 1, count == 2, count > 2]


def _count_triples(turn: int, passes: int, shards: int):
    """doc_id, text -> blobs of this pass's triples with their counts, by shard."""

    def flush(held):
        u, v, w = (np.concatenate(c) for c in zip(*held, strict=True))
        key = _triple_hash(u, v, w)
        order, at = _groups(key)
        count = np.diff(np.append(at, len(key)))
        pick = order[at]
        key, u, v, w = key[pick], u[pick], v[pick], w[pick]
        cut = _ranges(key, shards)
        parts, blobs = [], []
        for s in range(shards):
            if cut[s] == cut[s + 1]:
                continue
            r = slice(cut[s], cut[s + 1])
            by = np.lexsort((u[r], v[r]))  # equal words side by side are smaller
            parts.append(s)
            blobs.append(_squeeze(u[r][by], v[r][by], w[r][by], count[r][by].astype(np.uint32)))
        return _blobs(parts, blobs)

    @tidy
    def run(batches):
        held, n = [], 0
        for batch in batches:
            data, bounds = tk.utf8(batch.column(1))
            for lo, hi in tk.blocks(bounds):
                h, first, _, _ = tk.words_block(data, bounds, lo, hi, lower=True)
                triples = _sequence(h, first)
                mine = np.flatnonzero(_pass_of(triples[1], passes) == turn)
                held.append(tuple(c[mine] for c in triples))
                n += len(mine)
                if n >= FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return run


def _trimmed(run):
    """A function over a group that gives its memory back."""

    def inner(table: pa.Table) -> pa.Table:
        out = run(table)
        trim()
        return out

    return inner


def _add_triples(folder: str, turn: int, shards: int, parts: int):
    """The blobs of one shard -> its file; blobs of its contexts and of its pairs, by part; the counts of its counts."""

    @_trimmed
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("part")[0].as_py()
        u, v, w, count = _expand(table.column("blob"), np.uint64, np.uint64, np.uint64, np.uint32)
        key = _triple_hash(u, v, w)
        order, at = _groups(key)
        (count,) = _sums(order, at, count)
        pick = order[at]
        u, v, w = u[pick], v[pick], w[pick]
        _write(folder, f"triples-{turn}-{shard}", _file(key[pick], [count], shard, shards))
        pieces = []
        key = _pair_hash(u, v)
        order, at = _groups(key)
        pieces.append((key[order[at]], [key[order[at]], *_sums(order, at, count, *_spectrum(count))]))
        key = _pair_hash(v, w)
        order, at = _groups(key)
        pick = order[at]
        # behind the start of a text, a pair counts as often as it occurs; else, how many words precede it
        kinds, raw = _sums(order, at, np.ones(len(key), np.int64), count)
        pieces.append((key[pick], [v[pick], w[pick], np.where(v[pick] == START, raw, kinds), raw]))
        cuts = [_ranges(k, parts) for k, _ in pieces]
        out = [(-1, _squeeze(np.array([(count == k).sum() for k in (1, 2, 3, 4)], np.int64)))]
        out += [(p, _squeeze(*(c[cut[p] : cut[p + 1]] for cut, (_, cols) in zip(cuts, pieces, strict=True) for c in cols))) for p in range(parts)]
        return pa.Table.from_batches([_blobs(*zip(*out, strict=True))])

    return run


def _add_pairs(folder: str, turn: int, parts: int, words: int):
    """The blobs of one part -> files of its contexts and its pairs; blobs of what it knows of each word; the counts of its counts."""

    @_trimmed
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part == -1:
            (counts,) = _expand(table.column("blob"), np.int64)
            return pa.Table.from_batches([_blobs([-1], [_squeeze(counts.reshape(-1, 4).sum(0))])])
        ctx, total, once, twice, more, v, w, adjusted, raw = _expand(table.column("blob"), np.uint64, *[np.int64] * 4, np.uint64, np.uint64, np.int64, np.int64)
        order, at = _groups(ctx)
        ctx, known = ctx[order[at]], _sums(order, at, total, once, twice, more)
        several = np.flatnonzero((known[0] > 1) | (ctx == NO_WORDS))  # pairs say of the others that they occur once
        _write(folder, f"contexts-{turn}-{part}", _file(ctx[several], [k[several] for k in known], part, parts))
        del total, once, twice, more, ctx, known
        key = _pair_hash(v, w)
        order, at = _groups(key)
        pick = order[at]
        adjusted, raw = _sums(order, at, adjusted, raw)
        v, w = v[pick], w[pick]
        _write(folder, f"pairs-{turn}-{part}", _file(key[pick], [adjusted], part, parts))
        order, at = _groups(v)
        of_v = [v[order[at]], *_sums(order, at, adjusted, *_spectrum(adjusted))]
        order, at = _groups(w)
        of_w = [w[order[at]], *_sums(order, at, raw, np.ones(len(w), np.int64))]
        cuts = _ranges(of_v[0], words), _ranges(of_w[0], words)
        out = [(-2, _squeeze(np.array([(adjusted == k).sum() for k in (1, 2, 3, 4)], np.int64)))]
        out += [(p, _squeeze(*(c[cut[p] : cut[p + 1]] for cut, cols in zip(cuts, (of_v, of_w), strict=True) for c in cols))) for p in range(words)]
        return pa.Table.from_batches([_blobs(*zip(*out, strict=True))])

    return run


FACTS = "part int, facts array<long>"


def _add_words(folder: str, parts: int):
    """The blobs of one part of the words -> its file, and numbers for the model's discounts."""

    @_trimmed
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part < 0:
            (counts,) = _expand(table.column("blob"), np.int64)
            facts = counts.reshape(-1, 4).sum(0)
        else:
            v, total, once, twice, more, w, raw, before = _expand(table.column("blob"), np.uint64, *[np.int64] * 4, np.uint64, np.int64, np.int64)
            none_v, none_w = np.zeros(len(w), np.int64), np.zeros(len(v), np.int64)
            key = np.concatenate([v, w])
            order, at = _groups(key)
            known = _sums(order, at, *(np.concatenate([c, none_v]) for c in (total, once, twice, more)), *(np.concatenate([none_w, c]) for c in (raw, before)))
            key = key[order[at]]
            _write(folder, f"words-{part}", _file(key, known, part, parts))
            raw, before = known[4], known[5]
            # tokens, kinds, rows, kinds of pairs, and the counts of how many words precede one
            facts = np.array([raw.sum(), (before > 0).sum(), raw[key == END].sum(), before.sum(), *((before == k).sum() for k in (1, 2, 3, 4)), (before > 2).sum()], np.int64)
        return pa.table([pa.array([part], pa.int32()), pa.array([facts.tolist()], pa.list_(pa.int64()))], names=["part", "facts"])

    return run


@dataclass(frozen=True)
class Model:
    folder: str
    passes: int
    shards: int  # of triples, in each pass
    parts: int  # of contexts and pairs, in each pass
    words: int
    tokens: int  # training tokens, ends included
    kinds: int  # distinct ones
    pairs: int  # distinct pairs
    discounts: tuple  # of triples' counts 1, 2, 3 and more
    pair_discounts: tuple
    word_discounts: tuple  # of the numbers of preceding words
    word_rest: float  # probability that the words' own distribution leaves to unseen words


def _discounts(n1, n2, n3, n4) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; halves where there are too few counts."""
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(float(min(max(x, 0.05), k + 0.95)) for k, x in enumerate(d))


def train(docs: DataFrame, passes: int = 6) -> Model | None:
    """(doc_id, text) -> a model in the shared folder; None for no rows.

    A null text is an empty one: an end alone.  Nothing is pruned and every text
    is read once in each pass; only counts of counts reach the driver.  After a
    pass, the driver asks for a garbage collection, which lets Spark delete that
    pass's shuffle files.
    """
    spark = docs.sparkSession
    source = docs.select("doc_id", text_or_empty().alias("text"))
    size = source.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    if not size.rows:
        return None
    folder = f"{checkpoint_dir(spark).rstrip('/')}/kneser-ney-{uuid.uuid4().hex}"
    shards = max(2, -(-int(size.bytes or 0) // (SHARD_BYTES * passes)))
    parts, words = max(1, shards // 2), max(2, shards // 2)
    known = []
    for turn in range(passes):
        triples = source.mapInArrow(_count_triples(turn, passes, shards), BLOB).groupBy("part").applyInArrow(_add_triples(folder, turn, shards, parts), BLOB)
        known.append(stored(triples.groupBy("part").applyInArrow(_add_pairs(folder, turn, parts, words), BLOB)))
        del triples
        let_go(spark)
    every = known[0]
    for more in known[1:]:
        every = every.union(more)
    facts = {r.part: r.facts for r in every.groupBy("part").applyInArrow(_add_words(folder, words), FACTS).collect()}
    discard(*known)
    of_triples, of_pairs = facts.pop(-1, [0] * 4), facts.pop(-2, [0] * 4)
    tokens, kinds, _, pairs, m1, m2, m3, m4, more = np.sum(list(facts.values()), 0).tolist()
    d = _discounts(m1, m2, m3, m4)
    rest = (d[0] * m1 + d[1] * m2 + d[2] * more) / max(pairs, 1)
    return Model(folder, passes, shards, parts, words, tokens, kinds, pairs, _discounts(*of_triples), _discounts(*of_pairs), d, rest)


# The model of no rows: the one kind of unseen words has probability 1.
EMPTY = Model("", 1, 0, 0, 0, 0, 0, 0, *[_discounts(0, 0, 0, 0)] * 3, 1.0)

# ---- scoring

_open: dict = {}


class Arrays:
    """The arrays of a model, split by passes and ranges of hashes; files are mapped when they are first looked into."""

    WIDTH = {"triples": 1, "contexts": 4, "pairs": 1, "words": 6}

    def __init__(self, model: Model):
        self.model = model
        self.files: dict = {}

    @staticmethod
    def of(model: Model) -> Arrays:
        if model.folder not in _open:
            _open.clear()
            _open[model.folder] = Arrays(model)
        return _open[model.folder]

    def file(self, name: str, kind: str, part: int, parts: int) -> _Sorted:
        if name not in self.files:
            if len(self.files) >= MOST_MAPPED:
                self.files.clear()
            self.files[name] = _Sorted(_read(self.model.folder, name), self.WIDTH[kind], part, parts)
        return self.files[name]

    def find(self, kind: str, keys: np.ndarray, parts: int, turn: int | None = None) -> np.ndarray:
        """A row of values for each key, zeros where there is none."""
        out = np.zeros((len(keys), self.WIDTH[kind]), np.int64)
        order = np.argsort(keys)
        ordered = keys[order]
        cut = _ranges(ordered, parts) if parts else [0]
        for k in range(parts):
            if cut[k] < cut[k + 1]:
                name = f"{kind}-{k}" if turn is None else f"{kind}-{turn}-{k}"
                out[order[cut[k] : cut[k + 1]]] = self.file(name, kind, k, parts).find(ordered[cut[k] : cut[k + 1]])
        return out


def _less(count: np.ndarray, discounts: tuple) -> np.ndarray:
    return np.maximum(count - np.array([0, *discounts])[np.minimum(count, 3)], 0)


def _rest(stats: np.ndarray, discounts: tuple) -> np.ndarray:
    """What contexts, by their total and their counts of ones, twos and more, leave to the shorter context; all if they are unknown."""
    left = sum(d * stats[:, k] for k, d in enumerate(discounts, 1))
    return np.where(stats[:, 0] > 0, left / np.maximum(stats[:, 0], 1), 1.0)


def _score_block(arrays: Arrays, h: np.ndarray, first: np.ndarray):
    """(tokens, known tokens, base score, score) of each row."""
    m = arrays.model
    rows = len(first) - 1
    u, v, w = _sequence(h, first)
    size = np.diff(first) + 1
    row = np.repeat(np.arange(rows), size)
    kinds, code = np.unique(np.concatenate([v, w]), return_inverse=True)
    of_v, of_w = code[: len(v)], code[len(v) :]
    known = arrays.find("words", kinds, m.words)
    seen = known[of_w, 4]
    base = np.log10((seen + 0.5) / (m.tokens + 0.5 * (m.kinds + 1)))
    one = _less(known[:, 5], m.word_discounts) / max(m.pairs, 1) + m.word_rest / (m.kinds + 1)
    keys = {"triples": _triple_hash(u, v, w), "contexts": _pair_hash(u, v), "pairs": _pair_hash(v, w)}
    got = {kind: np.zeros((len(v), arrays.WIDTH[kind]), np.int64) for kind in keys}
    turns = _pass_of(v, m.passes)
    for turn in range(m.passes if m.shards else 0):
        at = np.flatnonzero(turns == turn)
        for kind, parts in (("triples", m.shards), ("contexts", m.parts), ("pairs", m.parts)):
            got[kind][at] = arrays.find(kind, keys[kind][at], parts, turn)
    context = got["contexts"]
    # a context without a row of its own occurs once if it was a pair: the one before, in the same text
    once = np.zeros(len(v), bool)
    once[1:] = (got["pairs"][:-1, 0] > 0) & (row[1:] == row[:-1])
    context[once & (context[:, 0] == 0)] = (1, 1, 0, 0)
    two = _less(got["pairs"][:, 0], m.pair_discounts) / np.maximum(known[:, 0], 1)[of_v] + _rest(known, m.pair_discounts)[of_v] * one[of_w]
    three = _less(got["triples"][:, 0], m.discounts) / np.maximum(context[:, 0], 1) + _rest(context, m.discounts) * two
    return size, np.bincount(row, seen > 0, rows).astype(np.int64), np.bincount(row, base, rows), np.bincount(row, np.log10(three), rows)


def _score(model: Model):
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    @tidy
    def run(batches):
        arrays = Arrays.of(model)
        for batch in batches:
            data, bounds = tk.utf8(batch.column(1))
            for lo, hi in tk.blocks(bounds, SCORE_CHUNK):
                h, first = tk.words(data, bounds[lo : hi + 1], lower=True)
                got = _score_block(arrays, h, first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(x) for x in got)], names=names)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, n_known, base_score, score (log10 probabilities of the text and its end).

    Each row is scored by itself, so repeated rows, ties and null ids change
    nothing; a null or empty text is an end alone.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        _score(model), "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """Adds perplexity by token to scored rows."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
