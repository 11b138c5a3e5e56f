"""The operators against brute force on small tables with awkward rows."""

import os
import random
import subprocess
import sys
import time
import zlib
from collections import Counter
from hashlib import sha256
from html.parser import HTMLParser
from math import exp, log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from contextframe.llm import editsketch, hamming, html_text, kneser_ney, mixing, neardup, packing, substring
from contextframe.llm.queries import op3_edit_fingerprint, op8_kneser_ney, tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, n int, key string, size long, rank int, block int"


def text(rng, words, vocab=3000):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(words))


def awkward(seed=0, n=60):
    """Near and exact copies, shared passages, null, empty and blank texts, a long one, a repeated row, a null id."""
    rng = random.Random(seed)
    passage = text(rng, 40)
    texts = [text(rng, rng.randrange(1, 120)) for _ in range(n)]
    for _ in range(n // 2):
        words = rng.choice(texts).split()
        for _ in range(max(1, len(words) // 30)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
        texts.append(" ".join(words))
    texts += [f"{text(rng, 9)} {passage}\n{text(rng, 7)}" for _ in range(8)] + texts[:5] + [None, "", " \t\n", "one", "One", "ä ö ü", "two words", "Two  WORDS", text(rng, 6000), "\U0001f600 " * 9]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(3 * i, texts[k]) for i, k in enumerate(order)]


@pytest.fixture(scope="module")
def rows():
    return awkward()


def frame(spark, rows, more=True):
    """A table with extra columns whose names clash with those the operators use."""
    sources = ["a", "b", "a", "a", None, "cé"]
    full = [(i, t, "en", sources[k % 6], len(t or ""), 1, 0.5, 7, "k", 1, 2, 3) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS).repartition(3)


def words(t, lower=False):
    b = (t or "").encode()
    return [w.decode() for w in (b.lower() if lower else b).split()]


# ---- packing


def brute_pieces(rows, limit):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        count = -(-len(ids) // limit)
        head = len(ids) - limit * (count - 1)
        cuts = [0, *(head + limit * k for k in range(count))]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            yield i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())


@pytest.mark.parametrize("limit", [1024, 64])
def test_packing(spark, rows, limit):
    rows = [*rows, rows[0], (None, "x y")]
    got = [tuple(r) for r in packing.pack_documents(frame(spark, rows), tokenizer_path(), limit).collect()]
    assert sorted((r[:5] for r in got), key=str) == sorted(brute_pieces(rows, limit), key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r[5], []).append((r[6], r[3]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    least = -(-sum(r[3] for r in got) // limit)
    assert len(sequences) <= least * 1.03 + 1
    assert packing.pack_documents(frame(spark, []), tokenizer_path(), limit).count() == 0


def test_added_tokens_have_one_id(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["<|endoftext|>", "one  <|endoftext|>  two<|endoftext|><|endoftext|>\n", "<|endoftext |> <|ENDOFTEXT|> <|endoftext|", "ä<|endoftext|>\U0001f600"]
    tok = Tokenizer.from_file(tokenizer_path())
    alone = tmp_path / "alone.json"  # no ranks beside it
    alone.write_bytes(open(tokenizer_path(), "rb").read())
    for t in texts:
        want = tok.encode(t, add_special_tokens=False).ids
        assert list(packing.encoder(tokenizer_path())(t)) == want == list(packing.encoder(str(alone))(t))
    assert list(packing.encoder(tokenizer_path())(texts[0])) == [50256]
    rows = list(enumerate(texts))
    got = [tuple(r)[:5] for r in packing.pack_documents(frame(spark, rows), tokenizer_path(), 64).collect()]
    assert sorted(got) == sorted(brute_pieces(rows, 64))


def test_plan_places_every_length():
    rng = np.random.default_rng(1)
    for _ in range(4):
        hist = np.bincount(rng.integers(1, 129, 5000), minlength=129)
        plan = packing.make_plan(hist)
        used = Counter()
        for contents, n in plan:
            assert sum(contents) <= 128 and n > 0
            for c in contents:
                used[c] += n
        assert used == Counter({k: int(v) for k, v in enumerate(hist) if v})
        total = int((hist * np.arange(129)).sum())
        assert sum(n for _, n in plan) <= -(-total // 128) * 1.02 + 1


# ---- mixing


def plain_targets(totals, weights=(5, 2, 1), cap=3):
    order = sorted(k for k in totals if k is not None) + [None] * (None in totals)
    weight = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    out, open_, left = {}, list(order), sum(totals.values())
    while open_:
        share = {k: left * weight[k] / sum(weight[j] for j in open_) for k in open_}
        over = [k for k in open_ if share[k] > cap * totals[k]]
        if not over:
            return out | share
        for k in over:
            out[k] = cap * totals[k]
            left -= out[k]
        open_ = [k for k in open_ if k not in out]
    return out


@pytest.mark.parametrize("totals", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 100, None: 190}, {}, {"a": 0}, {"a": 1, "b": 1, "c": 0, "\U0001f600": 5000, "\uffff": 7, "z": 900}])
def test_targets(spark, totals):
    got = mixing.targets(spark.createDataFrame(list(totals.items()), "source string, total long"))
    assert {r.source: r.goal for r in got.collect()} == pytest.approx(plain_targets(totals))


def test_many_sources(spark, monkeypatch):
    """More sources than are broadcast; none of them is a row of the driver's."""
    rng = random.Random(8)
    rows = [(i, f"s{i % 700}", rng.randrange(0, 60)) for i in range(3000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    total = Counter()
    for _, s, n in rows:
        total[s] += n
    want, taken = plain_targets(dict(total)), Counter()
    for r in mixing.mix(sized, broadcast_sources=10).collect():
        taken[r.source] += r.taken
        assert r.target == pytest.approx(want[r.source]) and r.taken <= 3 * r.size
    assert sum(abs(taken[s] - want[s]) for s in total) <= 0.05 * sum(total.values())  # four short documents to a source


def test_rates_against_a_plain_solver(spark):
    """The copies of a source's sizes are those of exponentially tilted rates that meet its target."""
    rng = random.Random(3)
    rows = [(i, "ab"[i % 5 > 0], rng.choice([5, 20, 80, 200])) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    for source in "ab":
        mine = [r for r in got if r.source == source]
        hist, goal = Counter(r.size for r in mine), mine[0].target
        tokens = lambda t: sum(n * s * min(3.0, exp(t * s)) for s, n in hist.items())
        low, high = -1.0, 1.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if tokens(mid) < goal else (low, mid)
        taken = Counter()
        for r in mine:
            taken[r.size] += r.copies
        for s, n in hist.items():
            assert abs(taken[s] - n * min(3.0, exp(low * s))) <= 0.02 * n + 2


def test_mixing(spark, rows):
    rows = [*rows, rows[3], (None, "x y z")]
    df = frame(spark, rows)
    got = mixing.mix_documents(df).collect()
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((i, len(words(t))) for i, t in rows if i is not None)
    total = Counter()
    taken = Counter()
    for r in got:
        total[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and r.taken == (r.copies * r.size if r.size else 0)
    want = plain_targets(dict(total))
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(want[r.source])
    for s in total:
        assert abs(taken[s] - want[s]) <= max(3, 0.01 * want[s]), s
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(df.repartition(5)).collect()))
    assert mixing.mix_documents(frame(spark, [])).count() == 0
    assert mixing.mix_documents(frame(spark, [(1, None), (2, "")])).count() == 2


def test_repeat_by_mix(spark, rows):
    df = frame(spark, rows).selectExpr("*", "1 as mix_id", "2 as taken_copies", "'c' as mix_copy", "3 as total")
    copies = {r.doc_id: r.copies for r in mixing.mix_documents(df).collect()}
    out = mixing.repeat_by_mix(df)
    assert out.dtypes == df.dtypes
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in copies.items() if v})


# ---- edit embedding


def test_fingerprints(spark, rows):
    df = frame(spark, rows)
    got = {r.doc_id: r for r in editsketch.fingerprint_and_edit(df, block_bytes=4000).collect()}
    assert len(got) == len(rows)
    order = sorted((i, t or "") for i, t in rows)
    prints = {}
    for (i, t), (j, u) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        (alone,) = editsketch.fingerprints([edited])
        assert alone.tobytes().hex() == r.edited_fingerprint
        assert r.near_next == pytest.approx(np.mean([a == b for a, b in zip(bytes.fromhex(r.fingerprint), bytes.fromhex(got[j].fingerprint))]))
        assert r.near_edited == pytest.approx(np.mean([a == b for a, b in zip(bytes.fromhex(r.fingerprint), bytes.fromhex(r.edited_fingerprint))]))
    same = {r.fingerprint for r in got.values()}
    assert len(same) >= len(set(prints)) - 2
    assert editsketch.fingerprint_and_edit(frame(spark, [])).count() == 0
    (alone,) = editsketch.fingerprint_and_edit(frame(spark, [(5, "abcdef")])).collect()
    assert alone.near_next == 1.0 and alone.edited_sha256 == sha256(b"abcabc").hexdigest()


def test_likeness_follows_edits():
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefghij klmnop") for _ in range(4000))
    seen = []
    for edits in (0, 4, 40, 4000):
        chars = list(base)
        for _ in range(edits):
            at = rng.randrange(len(chars))
            chars[at : at + rng.randrange(2)] = rng.choice("abcdefgh")
        seen.append(editsketch.likeness(*editsketch.fingerprints([base, "".join(chars)])))
    assert seen[0] == 1.0 and seen == sorted(seen, reverse=True) and seen[1] > 0.5 and seen[-1] < 0.2


def test_near_pairs(spark):
    rng = random.Random(4)
    base = text(rng, 400)
    texts = [base, base, base.replace("w1 ", "w2 "), text(rng, 400), text(rng, 400)]
    prints = spark.createDataFrame([(i, f.tobytes().hex()) for i, f in enumerate(editsketch.fingerprints(texts))], "doc_id long, fingerprint string")
    pairs = {(r.src, r.dst) for r in editsketch.near_pairs(prints).collect()}
    assert (0, 1) in pairs and not pairs & {(0, 3), (0, 4), (3, 4)}


def test_near_pairs_of_a_template(spark):
    """Against all pairs: an unrelated text of the same template leads nearly every bucket, and pairs just reach the least likeness."""
    rng = np.random.default_rng(8)
    template = rng.integers(0, 256, 128, dtype=np.uint8)
    prints = []

    def changed(base, n):
        out = base.copy()
        at = rng.choice(128, n, replace=False)
        out[at] += rng.integers(1, 256, n, dtype=np.uint8)
        return out

    for _ in range(30):
        one = changed(template, 64)
        prints += [one, changed(one, 38), changed(one, 39), changed(one, 25)]
    prints = [prints[k] for k in rng.permutation(len(prints))] + [prints[0]]
    n = len(prints)

    def joined(pairs):
        label = list(range(n))
        for a, b in pairs:
            x, y = sorted((label[a], label[b]))
            label = [x if k == y else k for k in label]
        return label

    pairs = editsketch.near_pairs(spark.createDataFrame([(i, f.tobytes().hex()) for i, f in enumerate(prints)], "doc_id long, fingerprint string")).collect()
    for r in pairs:
        assert r.likeness == editsketch.likeness(prints[r.src], prints[r.dst]) >= 0.7
    want = joined([(a, b) for a in range(n) for b in range(a) if editsketch.likeness(prints[a], prints[b]) >= 0.7])
    assert joined([(r.src, r.dst) for r in pairs]) == want and 1 < len(set(want)) < n


def test_near_groups(spark, tmp_path):
    """The query's groups are those of all pairs of fingerprints, compared one by one; they find most edited copies."""
    rng = random.Random(12)
    base = [text(rng, 120) for _ in range(25)]
    rows, origin = [], {}
    for k, t in enumerate(base):
        for c in range(4):
            part = t.split()
            for _ in range(c):
                part[rng.randrange(len(part))] = f"q{rng.randrange(99)}"
            origin[len(rows)] = k
            rows.append((len(rows), " ".join(part)))
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.near_group) for r in op3_edit_fingerprint(spark, str(tmp_path)).collect()}
    prints = [np.frombuffer(bytes.fromhex(got[i][0]), np.uint8) for i in range(len(rows))]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if editsketch.likeness(prints[a], prints[b]) >= 0.8:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert [got[i][1] for i in range(len(rows))] == label
    assert all(origin[i] == origin[label[i]] for i in origin)
    assert sum(label[i] != i for i in origin) >= 0.6 * 75  # of 75 copies with up to three words changed
    frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op3_edit_fingerprint(spark, f"{tmp_path}/none").count() == 0


# ---- near duplicates


def brute_components(rows, width, threshold=80):
    sets = {}
    for i, t in rows:
        w = words(t, lower=True)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    ids = sorted(sets)
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    label[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, rows, width):
    got = neardup.near_duplicates(frame(spark, [*rows, rows[7], (None, "lone text of no one")]), width).collect()
    want = brute_components(rows, width)
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    assert len({c for _, c in want.values()}) < len(want)
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_chain_of_near_copies(spark):
    """Members of a bucket that are unlike its first member are still compared with each other."""
    rng = random.Random(9)
    base = text(rng, 300).split()
    rows = []
    for i in range(40):
        for k in range(12):
            base[(i * 12 + k) % 300] = f"y{rng.randrange(9999)}"
        rows.append((i, " ".join(base)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows), 2).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 2).items()}


def test_first_of_each(spark, rows):
    out = neardup.first_of_each(frame(spark, [*rows, rows[7]]), 2)
    kept = [r.doc_id for r in out.collect()]
    assert sorted(kept) == sorted(i for i, (_, c) in brute_components(rows, 2).items() if i == c)


def test_hot_bucket_of_texts_that_differ(spark):
    """One template in many texts: the table's buckets are large, few pairs are links, and chains hold some of them."""
    rng = random.Random(4)
    passage = text(rng, 60)
    rows = [(i, f"{passage} {text(rng, rng.randrange(2, 30))}") for i in range(150)]
    for i in range(150, 210):
        part = rows[rng.randrange(i)][1].split()
        for _ in range(rng.randrange(1, 9)):
            part[rng.randrange(len(part))] = f"z{rng.randrange(999)}"
        rows.append((i, " ".join(part)))
    for width in (2, 5):
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows), width).collect()}
        want = {i: c for i, (_, c) in brute_components(rows, width).items()}
        assert got == want and 20 < len(set(want.values())) < 200


def test_repeated_ids_with_other_texts(spark):
    rng = random.Random(5)
    a, b, c = (text(rng, 50) for _ in range(3))
    rows = [(1, a), (1, b), (2, f"{b} more"), (3, f"{c} more"), (4, c), (4, c), (4, a)]
    got = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(frame(spark, rows), 2).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 1), (4, 3), (4, 3)]
    kept = neardup.first_of_each(frame(spark, rows), 2).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept)) == [(1, min(a, b)), (3, f"{c} more")]


# ---- HTML

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="cookie-notice">We use cookies, a very long notice about nothing at all.</div>
<article><h1>Head &amp; tail</h1><p>First  <b>bold</b>\n text &lt;p&gt;.<br>next<p>Second.</p><div class="ad">Buy</div><p>Short.</p><aside>side</aside><p>Last one.</p>
<section class="comments"><p>reader says something long enough to matter, surely</p></section></article><form><p>mail</p></form><footer>&copy; foot</footer></body></html>"""


def test_html():
    assert html_text.main_text(PAGE) == "Head & tail\nFirst bold text <p>. next\nSecond.\nShort.\nLast one."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>a</nav>") == ""
    bare = "<body><ul><li><a href=x>home</a></li></ul><p>" + "long text " * 20 + "</p><p>more text here, too</p><div id=footer>bye</div>"
    assert html_text.main_text(bare) == ("long text " * 20).strip() + "\nmore text here, too"
    assert html_text.main_text("<article><p>unclosed <!-- a <p> b") == "unclosed"
    assert html_text.surge_points(PAGE)


def test_article_element_does_not_choose_the_text():
    body = [f"Paragraph {k} of the main text, which stands in a plain element." for k in range(6)]
    page = "<body><div>" + "".join(f"<p>{t}</p>" for t in body) + "</div><div class=ad><p>x<p>x<p>x</div><article><p>A teaser of another page.</p></article>"
    assert html_text.main_text(page) == "\n".join([*body, "A teaser of another page."])


@pytest.mark.parametrize("around", ["{}", "<div>{}</div>", "<article>{}</article>"])
def test_short_and_linked_parts_are_kept(around):
    advert = "<div class=ad><p>Buy<p>this<p>now</div>"
    body = [f"Paragraph {k} of the body, " + "which is long, " * 9 for k in range(20)]
    linked = "A whole paragraph of the text that is one link"
    parts = [
        ("<p>Short lead.", "Short lead."),
        (advert, None),
        *((f"<p>{t}</p>", t.strip()) for t in body[:10]),
        (f"<p><a href=x>{linked}</a></p>", linked),
        ("<ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a><li><a href=4>Four</a></ul>", "One\nTwo\nThree\nFour"),
        *((f"<p>{t}</p>", t.strip()) for t in body[10:]),
        (advert, None),
        (f"<p><a href=y>{linked}.</a></p>", linked + "."),
        (advert, None),
        ("<p>See also <a href=z>this other page</a></p>", "See also this other page"),
    ]
    menu = "<div><ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>About us</a></ul></div>"
    page = "<body>" + menu + around.format("".join(p for p, _ in parts)) + menu + "</body>"
    assert html_text.main_text(page) == "\n".join(t for _, t in parts if t)


def test_left_out_end_tags():
    article = "<article><p>One<p>Two</article>"
    assert html_text.main_text(f"<head><title>t</title><body>{article}") == "One\nTwo"
    assert html_text.main_text(f"<head><meta charset=utf-8><title>t</title><script>x</script>{article}") == "One\nTwo"
    for name in ("button", "object", "select", "canvas", "svg", "math", "audio", "video", "noscript", "template"):
        assert html_text.main_text(f"<body><div><p>Zero</p><{name} id=x>skip</div>{article}") == "Zero\nOne\nTwo", name
        assert html_text.main_text(f"<body><p>Ze<{name}>skip</{name}>ro{article}") == "Zero\nOne\nTwo", name
        assert html_text.main_text(f"<body><p>Zero<{name}>skip{article}") == ("Zero" if name == "template" else "Zero\nOne\nTwo"), name
    assert html_text.main_text(f"<body><ul><li>Zero<button>skip<li>Half</ul>{article}") == "Zero\nHalf\nOne\nTwo"
    assert html_text.main_text(f"<body><noscript><div>a<p>b</div>c<button>d</button>e</noscript>{article}") == "One\nTwo"


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert sorted(r.n_chars for r in got) == [0, len(html_text.main_text(PAGE)), len(html_text.main_text(PAGE))]
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page", ["<div>" * 32_000 + "</ul>" * 32_000, '<a "' * 30_000, '<a ="' * 30_000, "<" * 200_000, "<!--" * 50_000, "<a href='\"" * 30_000 + "'", "<p title='x>one</p>" * 20_000, "<script" * 50_000]
)
def test_markup_without_ends_takes_linear_time(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 2


class PlainArticle(HTMLParser):
    """The blocks of the article element, by the standard library's parser and no weights."""

    BLOCK = frozenset("p div article section h1 h2 h3 h4 h5 h6 ul ol li table tr td th blockquote pre dl dt dd figure hr header footer nav aside form".split())
    APART = frozenset("nav footer aside form script style noscript template button select".split())

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.depth = self.apart = 0
        self.blocks = [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self.blocks.append("")
        self.depth += tag == "article"
        self.apart += self.depth > 0 and tag in self.APART
        if tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.blocks.append("")
        self.apart -= self.depth > 0 and tag in self.APART
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth and not self.apart:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(b for b in (" ".join(x.split()) for x in self.blocks) if b)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_pages_against_a_plain_reading(spark):
    """With the article element and class names, without either, the text is the article's."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    want = {r.page_id: PlainArticle(r.html).text() for r in pages.collect()}
    views = {1.0: F.col("html"), 0.999: F.regexp_replace("html", "</?article[^>]*>", ""), 0.95: F.regexp_replace("html", r'\s(class|id|role)="[^"]*"', "")}
    for share, html in views.items():
        got = html_text.extract(pages.withColumn("html", html)).collect()
        assert sum(r.text == want[r.page_id] for r in got) >= share * len(want)


def test_class_names_say_little():
    law = '<article><h1>Law</h1><section class="legal-analysis"><p>body text of it</p></section><p class="comment-free">more</p><div class="ad-box left">buy</div><p>end</p></article>'
    assert html_text.main_text(law) == "Law\nbody text of it\nmore\nend"
    assert html_text.main_text('<article><p title="x>one</p><p>two</p></article>') == "one\ntwo"


# ---- Hamming search


def test_search_is_exact(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    codes = [(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(9))) & (1 << 64) - 1 for b in base * 15)]
    codes += [(1000 + i, codes[0][1]) for i in range(30)]
    table = spark.createDataFrame([(i, [c]) for i, c in codes], "id long, code array<long>")
    queries = table.where("id % 20 = 0").selectExpr("id as query_id", "code")
    got = {(r.query_id, r["rank"]): (r.id, r.distance) for r in hamming.search(table, queries, 10).collect()}
    for q, c in codes:
        if q % 20 == 0:
            near = sorted((bin((c ^ x) & (1 << 64) - 1).count("1"), i) for i, x in codes)[:10]
            assert [got[q, k + 1] for k in range(10)] == [(i, d) for d, i in near]
    few = table.where("id < 3")
    assert hamming.search(few, few.selectExpr("id as query_id", "code"), 10).count() == 9
    assert hamming.search(few.limit(0), few.selectExpr("id as query_id", "code"), 10).count() == 0


def test_sign_codes(spark):
    df = spark.createDataFrame([(1, [0.5, -1.0, 2.0], 0), (2, None, 0), (None, [1.0], 0), (3, [None, 1.0], 0), (4, [-1.0] * 63 + [1.0], 1)], "vec_id long, embedding array<float>, code int")
    assert {r.id: r.code for r in hamming.sign_codes(df).collect()} == {1: [5], 3: [2], 4: [-(1 << 63)]}
    wide = spark.createDataFrame([(1, [1.0] * 64 + [-1.0, 1.0]), (2, [])], "vec_id long, embedding array<float>")
    assert {r.id: r.code for r in hamming.sign_codes(wide).collect()} == {1: [-1, 2], 2: []}


@pytest.mark.parametrize("words", [1, 2])
def test_search_of_skewed_codes(spark, words):
    """Bits that are nearly constant, a large group of near codes, and queries far from all: against all distances."""
    rng = np.random.default_rng(words)
    n = 20_000
    bits = rng.random((n, 64 * words)) < np.where(np.arange(64 * words) % 3 == 0, 0.02, 0.5)
    near = rng.random((n // 3, 64 * words)) < 0.03
    bits[: n // 3] = bits[0] ^ near
    code = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    ask = np.concatenate([code[::997], ~code[:3]])
    table = spark.createDataFrame([(i, [int(x) for x in c.view(np.int64)]) for i, c in enumerate(code)], "id long, code array<long>")
    queries = spark.createDataFrame([(i, [int(x) for x in c.view(np.int64)]) for i, c in enumerate(ask)], "query_id long, code array<long>")
    got = {(r.query_id, r["rank"]): (r.id, r.distance) for r in hamming.search(table, queries, 10).collect()}
    for i, c in enumerate(ask):
        d = np.bitwise_count(code ^ c).sum(1, dtype=np.int64)
        order = np.lexsort((np.arange(n), d))[:10]
        assert [got[i, r + 1] for r in range(10)] == [(int(x), int(d[x])) for x in order]


# ---- language model


def brute_model(texts):
    triples = Counter()
    for t in texts:
        s = ["<s>", "<s>", *words(t, lower=True), "</s>"]
        triples.update(zip(s, s[1:], s[2:]))
    unigrams, contexts, adjusted = Counter(), Counter(), Counter()
    for (u, v, w), c in triples.items():
        unigrams[w] += c
        contexts[u, v] += c
        adjusted[v, w] += c if v == "<s>" else 1
    before = Counter(w for _, w in adjusted)
    total = Counter()
    for (v, _), c in adjusted.items():
        total[v] += c
    d3, d2, d1 = (kneser_ney._discounts(*(sum(c == k for c in x.values()) for k in (1, 2, 3, 4))) for x in (triples, adjusted, before))
    n, v = sum(unigrams.values()), len(unigrams)
    left = lambda counts, d: sum(d[min(c, 3) - 1] for c in counts)
    less = lambda c, d: max(c - d[min(c, 3) - 1], 0) if c else 0
    rest = left(before.values(), d1) / len(adjusted)

    def p(a, b, w):
        one = less(before[w], d1) / len(adjusted) + rest / (v + 1)
        two = one
        if total[b]:
            two = (less(adjusted[b, w], d2) + left((c for (x, _), c in adjusted.items() if x == b), d2) * one) / total[b]
        if not contexts[a, b]:
            return two
        return (less(triples[a, b, w], d3) + left((c for (x, y, _), c in triples.items() if (x, y) == (a, b)), d3) * two) / contexts[a, b]

    def score(t):
        s = ["<s>", "<s>", *words(t, lower=True), "</s>"]
        base = sum(log10((unigrams[w] + 0.5) / (n + 0.5 * (v + 1))) for w in s[2:])
        return len(s) - 2, sum(unigrams[w] > 0 for w in s[2:]), base, sum(log10(p(*x)) for x in zip(s, s[1:], s[2:]))

    return n, score, p, unigrams


@pytest.mark.parametrize("passes, copies", [(8, 1), (1, 1), (3, 300)])
def test_kneser_ney(spark, passes, copies):
    """Every score against the model computed pair by pair; with many copies, counts of more than a byte."""
    rng = random.Random(6)
    rows = [(i, text(rng, rng.randrange(0, 50), 40)) for i in range(60)] + [(100, None), (101, "Unseen W1 words"), (102, "w1 W2")]
    rows += [(1000 + 3 * k + 1, rows[7][1]) for k in range(copies - 1)]
    df = frame(spark, rows)
    train = [t for i, t in rows if i % 3]
    model = kneser_ney.train(df.where("doc_id % 3 <> 0"), passes)
    n, score, p, unigrams = brute_model(train)
    assert model.tokens == n and model.kinds == len(unigrams)
    for r in kneser_ney.perplexity(kneser_ney.score(df, model)).where("doc_id < 1002").collect():
        want = score(dict(rows)[r.doc_id])
        assert (r.n_tokens, r.n_known) == want[:2] and (r.base_score, r.score) == pytest.approx(want[2:]) and r.perplexity >= 1
    for a, b in (("w1", "w2"), ("<s>", "<s>"), ("w3", "never"), ("never", "w3")):
        assert sum(p(a, b, w) for w in [*unigrams, "never seen"]) == pytest.approx(1)
    assert kneser_ney.train(df.limit(0)) is None


def test_sorted_files():
    """Hashes of one range with small, large and very large counts, some of them with equal leading bits."""
    rng = np.random.default_rng(1)
    for part, parts in ((0, 1), (2, 3), (999, 2000)):
        low, high = kneser_ney._cut(part, parts), kneser_ney._cut(part + 1, parts)
        keys = np.unique(rng.integers(low, high - 1, 5000, np.uint64, endpoint=True))
        keys = np.unique(np.concatenate([keys, [np.uint64(min(int(k) + (1 << 18), high - 1)) for k in keys[:50]]]))
        keys = keys[np.append(True, np.diff(keys) > 1 << 17)]
        values = [rng.integers(1, 300, len(keys)), np.where(rng.random(len(keys)) < 0.01, 1 << 40, 7)]
        raw = np.frombuffer(kneser_ney._file(keys, values, part, parts), np.uint8)
        got = kneser_ney._Sorted(raw, 2, part, parts).find(keys[::-1])
        assert (got[::-1] == np.stack(values, 1)).all()
        absent = np.setdiff1d(rng.integers(low, high - 1, 1000, np.uint64, endpoint=True), keys)
        assert not kneser_ney._Sorted(raw, 2, part, parts).find(absent).any()
    assert not kneser_ney._Sorted(None, 2, 0, 1).find(keys).any()


def test_scoring_with_few_file_handles(tmp_path):
    """Two thousand shards are scored by a process that may open 256 files."""
    rng = np.random.default_rng(2)
    shards = 2000
    for k in range(shards):
        keys = np.unique(rng.integers(kneser_ney._cut(k, shards), kneser_ney._cut(k + 1, shards), 3, np.uint64))
        kneser_ney._write(str(tmp_path), f"triples-0-{k}", kneser_ney._file(keys, [np.ones(len(keys), np.int64)], k, shards))
    code = f"""
import resource; resource.setrlimit(resource.RLIMIT_NOFILE, (256, 256))
import numpy as np
from contextframe.llm import kneser_ney as kn
model = kn.Model({str(tmp_path)!r}, 1, {shards}, 1, 1, 1, 1, 1, (0.5, 1.0, 1.5), (0.5, 1.0, 1.5), (0.5, 1.0, 1.5), 1.0)
arrays = kn.Arrays(model)
arrays.find("triples", np.random.default_rng(3).integers(0, 1 << 63, 20000, np.uint64) * np.uint64(2), {shards}, 0)
assert len(arrays.files) > 1900
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))


def test_kneser_ney_without_training_rows(spark, tmp_path):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    frame(spark, [(i, "some words" if k else None) for k, i in enumerate(ids)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = op8_kneser_ney(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == ids and len(ids) > 1
    for r in got:
        assert r.held_out and r.n_tokens == (1 if r.doc_id == ids[0] else 3)
        assert (r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0)
    frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op8_kneser_ney(spark, f"{tmp_path}/none").count() == 0


# ---- substrings


def brute_repeats(rows, width):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), kept)
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_substring(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(substring, "HOT_RUNS", hot)
    table = [*rows, rows[9], (None, rows[0][1] or "x")]
    got = substring.remove_repeats(frame(spark, table), with_text=True).collect()
    want = brute_repeats(rows, 13)
    assert len(got) == len(table) and sum(v[1] for v in want.values()) > 0
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id]
        else:
            assert r.n_removed == 0
    assert substring.remove_repeats(frame(spark, [])).count() == 0


def test_strip_repeats(spark, rows):
    df = frame(spark, rows)
    want = brute_repeats(rows, 13)
    out = substring.strip_repeats(df)
    assert out.columns == df.columns
    for r in out.collect():
        assert r.text == (want[r.doc_id][2] if want[r.doc_id][1] else dict(rows)[r.doc_id]) and r.n_chars == len(r.text or "")


def test_repeats_of_one_id_with_other_texts(spark):
    rng = random.Random(21)
    a, b, c = text(rng, 40), text(rng, 40), text(rng, 80)
    table = [(1, a), (5, a), (5, b), (5, c), (7, f"{b} end"), (9, None), (9, b)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(frame(spark, table)).collect())
    assert got == [(1, 40, 0), (5, 40, 0), (5, 40, 40), (5, 80, 0), (7, 41, 40), (9, 0, 0), (9, 40, 40)]
    df = frame(spark, table).selectExpr("*", "1 as hits", "'x' as strip_id", "2 as row", "3 as strip_hits").withColumn("n_chars", F.col("n_chars").cast("int"))
    out = substring.strip_repeats(df)
    assert out.dtypes == df.dtypes
    want = [(1, a), (5, ""), (5, b), (5, c), (7, "end"), (9, None), (9, "")]
    assert sorted((r.doc_id, r.text or "", r.n_chars, r.hits, r.strip_id) for r in out.collect()) == sorted((i, t or "", len(t or ""), 1, "x") for i, t in want)


def test_fm_index_matches_brute_force():
    rng = np.random.default_rng(7)
    seq = rng.integers(1, 5, 400)
    index = substring.FMIndex(seq, 6)
    own = {tuple(seq[k : k + 6]) for k in range(395)}
    other = rng.integers(1, 7, 300)
    assert index.matching(other, 6).tolist() == [tuple(other[k : k + 6]) in own for k in range(295)]
    low, high = index.search(np.arange(395), 6)
    for k in range(395):
        assert sorted(index.order[low[k] : high[k]]) == [j for j in range(395) if (seq[j : j + 6] == seq[k : k + 6]).all()]
