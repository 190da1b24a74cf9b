"""The ten operators against brute force, round trips and held-out accuracy, and on the awkward cases."""

import collections
import itertools
import math
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from fleetweave.llm import bpe, compress_bands, decontam, html_blocks, license, link_trust, lm_automaton, quality, queries, substring, superminhash
from fleetweave.llm._spark import Workspace, components
from fleetweave.llm._text import shingles, words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS)


AWKWARD = [(1, None), (2, ""), (3, "   \n"), (None, "words without an id " * 5), (4, "one"), (5, "the same text twice " * 10), (5, "the same text twice " * 10), (6, "x" * 70000), (7, "long text of words " * 8000)]


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages", "benchmark", "labels")}


@pytest.mark.parametrize("kind", ["awkward", "empty"])
def test_awkward_rows(spark, tables, kind):
    docs = frame(spark, AWKWARD if kind == "awkward" else [])
    # names that operators use inside
    for c in ("group_id", "version", "block", "row", "ids", "keep", "first", "h1", "key", "id"):
        docs = docs.withColumn(c, docs["doc_id"])
    n = docs.count()
    bench, labels = tables["benchmark"], tables["labels"]
    assert compress_bands.compression_bands(docs).count() == n
    assert lm_automaton.score(docs).count() == n
    assert decontam.find(docs, bench).count() == 0
    assert decontam.find(docs, bench.limit(0)).count() == 0
    assert decontam.without(docs, bench).count() == n
    assert substring.passages(docs).where("doc_id = src_doc_id").count() == 0
    assert superminhash.near_duplicates(docs).count() == n
    kept = superminhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id = 5").count() == (kind == "awkward")
    assert quality.classify(spark, docs, labels).count() == n
    assert quality.classify(spark, docs, labels.limit(0)).count() == n
    coded = bpe.encode_documents(docs)
    assert coded.count() == n and coded.where("not round_trip").count() == 0
    assert license.recognise(docs).count() == 0
    assert substring.without_repeats(docs).columns == docs.columns
    pages = docs.selectExpr("doc_id page_id", "text url", "text html", "keep host", "keep trust")
    assert html_blocks.extract(pages).count() == n
    assert link_trust.url_filter(pages).where("keep").count() == n


LINKS = [(1, "http://good.edu/a", '<a href="http://mid.org/x">'), (2, "http://mid.org", '<a href="//good.edu">'), (3, "http://links.org", "<a href='http://casino.org/'>"), (4, "http://casino.org", ""), (5, "http://alone.org", None), (6, None, None), (7, "no url", "")]


@pytest.mark.parametrize("copies", [1, 40])
def test_link_trust_by_hand(spark, copies):
    """Scores and decisions don't change if the graph stands beside copies of itself."""
    rows = [(i + 10 * c, u and u.replace(".", f"{c}.", 1), h and re.sub(r"//(\w+)", rf"//\g<1>{c}", h)) for c in range(copies) for i, u, h in LINKS]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("keep", F.lit(1)).withColumn("host", F.lit("h")).withColumn("trust", F.lit(2))
    got = {r.page_id: r for r in link_trust.url_filter(pages).collect()}
    m = np.zeros((4, 4))
    m[1, 0] = m[0, 1] = m[3, 2] = 1  # to, from
    for name, matrix, seed in (("trust", m, 0), ("distrust", m.T, 3)):
        x = 0.15 * np.linalg.inv(np.eye(4) - 0.85 * matrix)[:, seed]  # the limit of the power iteration
        for c in range(copies):
            assert x.tolist() == pytest.approx([got[k + 10 * c][name] for k in range(1, 5)], abs=link_trust.TOLERANCE)
    for c in range(copies):
        assert [got[k + 10 * c].keep for k in range(1, 8)] == [True, True, False, False, True, True, True]


def test_link_trust_seeds(spark):
    many = [(k, f"http://site{k}.com", '<a href="http://star.io/">' * 2) for k in range(link_trust.ENDORSED)]
    pages = spark.createDataFrame([*many, (90, "http://star.io", '<a href="http://next.io">')], "page_id long, url string, html string")
    quick = {"tolerance": 0.5}
    got = {r.page_id: r for r in link_trust.url_filter(pages, **quick).collect()}
    assert got[90].trust > 0.1 and got[0].trust == 0
    assert {r.page_id: r.trust for r in link_trust.url_filter(pages.where("page_id > 0"), **quick).collect()}[90] == 0
    seeds = spark.createDataFrame([("SITE1.com",), (None,)], "host string")
    got = {r.page_id: r for r in link_trust.url_filter(pages, trusted=seeds, blocked=spark.createDataFrame([("next.io",)], "host string"), **quick).collect()}
    assert got[1].trust > 0.1 and got[90].distrust > 0.1 and not got[2].keep and got[1].keep


def test_compression_bands():
    press = zstandard.ZstdCompressor(level=3)
    rng = random.Random(1)
    assert compress_bands.judge("spam " * 400, press)[6] == "repetitive"
    assert compress_bands.judge("".join(chr(rng.randrange(33, 127)) for _ in range(20000)), press)[6] == "incompressible"
    assert compress_bands.judge(sentence(rng, 300), press)[7]
    assert compress_bands.judge(sentence(rng, 400) + "ab" * 9000 + sentence(rng, 400), press)[6] in ("repetitive", "chunks")


def test_compression_bands_against_brute_force(spark):
    rng = random.Random(23)
    texts = [None, "", "a", "a" * 199, "a" * 200, "é" * 5000]
    for _ in range(60):
        noise = lambda n: "".join(chr(rng.randrange(33, 127)) for _ in range(n))
        texts.append("".join(rng.choice((sentence(rng, rng.randrange(1, 900)), "ab " * rng.randrange(1, 3000), noise(rng.randrange(1, 6000)))) for _ in range(rng.randrange(1, 4))))
    press = zstandard.ZstdCompressor(level=3)
    for i, r in {r.doc_id: r for r in compress_bands.compression_bands(frame(spark, enumerate(texts))).collect()}.items():
        if not texts[i]:
            assert (r.n_bytes, r.ratio, r.keep, r.reason) == ((None, None, False, "no text") if texts[i] is None else (0, None, True, None))
            continue
        raw = texts[i].encode()
        ratio = lambda x: len(press.compress(x)) / len(x)
        band = lambda n: max(b for b in compress_bands.BANDS if b[0] <= n)[1:]
        chunks = [raw] if len(raw) <= 4096 else [raw[k * 4096 : k * 4096 + 4096] for k in range(math.ceil(len(raw) / 4096))]
        assert sum(map(len, chunks)) == len(raw)
        bad = 0
        for c in chunks:
            low, high = compress_bands.CHUNK_LIMITS if len(c) == 4096 else band(len(c))
            bad += not low <= ratio(c) <= high
        low, high = band(len(raw))
        why = "repetitive" if ratio(raw) < low else "incompressible" if ratio(raw) > high else "chunks" if bad and bad >= 0.34 * len(chunks) else None
        assert (r.n_bytes, r.ratio, r.n_chunks, r.bad_chunks, r.reason, r.keep) == (len(raw), ratio(raw), len(chunks), bad, why, why is None)
        assert (r.chunk_min, r.chunk_max) == (min(map(ratio, chunks)), max(map(ratio, chunks)))


def test_the_tail_of_a_text_counts():
    rng = random.Random(24)
    text = sentence(rng, 700)[:4096] + "spam " * 400
    assert compress_bands.judge(text, zstandard.ZstdCompressor(level=3))[5:] == (1, "chunks", False)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_automaton_against_recursion(spark, order):
    rng = random.Random(order)
    texts = [sentence(rng, n, 12) for n in (0, 1, 2, 5, 40, 300, 2500)]
    got = {r.doc_id: r.log_prob for r in lm_automaton.score(frame(spark, enumerate(texts)), order=order, block_chars=2000).collect()}
    split = [t.split() for t in texts]
    grams = [Counter(tuple(s[i : i + n]) for s in split for i in range(len(s) - n + 1)) for n in range(1, order + 1)]
    total, distinct = sum(grams[0].values()), len(grams[0])
    context = [Counter() for _ in grams]
    mass = [Counter() for _ in grams]
    for n in range(1, order):
        for g, c in grams[n].items():
            context[n][g[:-1]] += c
            mass[n][g[:-1]] += c - lm_automaton.DISCOUNT if c >= 2 else 0

    def prob(h, w):
        if not h:
            return (grams[0][w,] + 0.5) / (total + 0.5 * (distinct + 1))
        n, lower = len(h), prob(h[1:], w)
        if n > 1 and grams[n - 1][h] < 2 or not context[n][h]:
            return lower
        c = grams[n][*h, w]
        return (c - lm_automaton.DISCOUNT if c >= 2 else 0) / context[n][h] + (1 - mass[n][h] / context[n][h]) * lower

    for i, s in enumerate(split):
        want = sum(math.log(prob(tuple(s[max(0, k - order + 1) : k]), w)) for k, w in enumerate(s))
        assert got[i] == pytest.approx(want, abs=1e-5)


def test_grams_hold_narrow_numbers_within_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 2000) % 50_000) for _ in range(300)]
    lm_automaton.Grams(texts[:2], 3)  # tables of code points
    tracemalloc.start()
    g = lm_automaton.Grams(texts, 3)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    n = len(g.seq)
    assert n == 600_000 and g.seq.dtype == g.counts[2].dtype == g.suffix[2].dtype == np.int32
    assert sum(map(int, g.counts[2])) == n - 2 * 300
    assert held < 50 * n and peak < 95 * n


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_each_word_has_its_ngram(order):
    """Texts are read by numbers of n-grams: those that begin a text and all of the longest, each word in one."""
    rng = random.Random(order)
    texts = [sentence(rng, n, 6) for n in (0, 1, 2, 3, 4, 0, 60, 1, 0)]
    g = lm_automaton.Grams(texts, order)
    hashes, _, _, ptr = words(texts)
    names = [[(w,) for w in g.words.tolist()]]
    for keys in g.keys[1:]:
        names.append([names[-1][k // len(g.words)] + names[0][k % len(g.words)] for k in keys.tolist()])
    split = [tuple(hashes[a:b].tolist()) for a, b in zip(ptr[:-1], ptr[1:])]
    assert [names[-1][i] for i in g.last] == [t[i : i + order] for t in split for i in range(len(t) - order + 1)]
    for n in range(1, order):
        assert [names[n - 1][i] for i in g.first[n - 1]] == [t[:n] for t in split if len(t) >= n]
    assert lm_automaton.read(g, [np.ones(len(k)) for k in g.keys]).tolist() == [len(t) for t in split]


def test_production_order_is_three(spark):
    got = {r.doc_id: r.log_prob for r in queries.QUERIES["op3_lm_automaton"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got == {r.doc_id: r.log_prob for r in lm_automaton.score(docs, order=3).collect()}
    assert got != {r.doc_id: r.log_prob for r in lm_automaton.score(docs, order=2).collect()}


def test_decontamination_finds_substituted_passages(spark):
    rng = random.Random(4)
    items = [(i, sentence(rng, 30)) for i in range(20)]
    texts, want = [], set()
    for i in range(60):
        t = sentence(rng, 200).split()
        if i % 2:
            item = items[i % 20][1].split()
            for k in range(6, 30, 9):
                item[k] = "other"
            t[50:50] = item
            want.add((i, i % 20))
        texts.append((i, " ".join(t)))
    docs, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find(docs, bench).collect()} == want
    assert {(r.doc_id, r.item_id) for r in decontam.find(docs, bench, slice_chars=500).collect()} == want
    assert {r.doc_id for r in decontam.without(docs, bench).collect()} == set(range(60)) - {d for d, _ in want}


def brute_overlaps(docs, items):
    """(doc, item) with enough equal words on some diagonal: in its best run or, of all the item's words, the least share."""
    out = set()
    for (d, t), (i, u) in itertools.product(enumerate(docs), enumerate(items)):
        h, w = ([x.lower() for x in re.findall(r"\w+", y or "")] for y in (t, u))
        if 0 < len(w) < 4:
            if h == w:
                out.add((d, i))
            continue
        least = min(13, math.ceil(0.8 * len(w)))
        for shift in range(-len(w), len(h)) if w else ():
            eq = [h[k + shift] == x for k, x in enumerate(w) if 0 <= k + shift < len(h)]
            best, run, n, most = 0, 0, 0, 0
            for e in eq:
                run, n = (0, 0) if run < 0 else (run, n)
                run, n = run + (1 if e else -3), n + e
                if run > best:
                    best, most = run, n
            if most >= least or sum(eq) >= max(least, 0.8 * len(w)):
                out.add((d, i))
                break
    return out


@pytest.mark.parametrize("slice_chars", [decontam.SLICE_CHARS, 1])
def test_decontamination_against_brute_force(spark, slice_chars):
    rng = random.Random(28)
    items = [sentence(rng, n, 10**6) for n in (1, 2, 3, 4, 5, 7, 8, 12, 15, 20, 30, 45) for _ in range(3)] + ["", "?!", None]
    items += [items[20], "same words same words same words"]
    docs = ["", None, "?!", *items[:9], "same words same words same words and more"]
    for k in range(90):
        w = (items[k % 36] or "").split()
        for j in rng.sample(range(len(w)), int(len(w) * rng.choice((0, 0, 0.1, 0.2, 0.3)))):
            w[j] = "other"
        cut = w[: rng.randrange(len(w) // 2, len(w) + 1)] if k % 4 == 0 else w
        docs.append(" ".join((sentence(rng, rng.choice((0, 20)), 10**6), *cut, sentence(rng, rng.choice((0, 20)), 10**6))))
    docs += [docs[-1], docs[-1]]
    want = brute_overlaps(docs, items)
    frame_ = frame(spark, enumerate(docs)).withColumn("h", F.lit(1)).withColumn("row", F.lit("x")).withColumn("item", F.lit(1))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("item", F.lit(1)).withColumn("row", F.lit(2))
    rows = decontam.find(frame_, bench, slice_chars=slice_chars, filter_bits=20).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert len(rows) == len(got) and got <= want and len(got) >= 0.97 * len(want) and len(want) > 60
    kept = decontam.without(frame_, bench, slice_chars=slice_chars, filter_bits=20)
    assert kept.columns == frame_.columns and {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {d for d, _ in got}
    one = {(r.doc_id, r.item_id): r for r in rows}
    for d, i in got:
        found = docs[d][one[d, i].start_char : one[d, i].end_char]
        assert len(re.findall(r"\w+", found)) == one[d, i].n_words >= one[d, i].n_match


def test_benchmark_rows_that_are_null_empty_or_repeated(spark):
    rng = random.Random(29)
    item = sentence(rng, 20, 10**6)
    docs = frame(spark, [(1, f"before {item} after"), (1, f"before {item} after"), (None, item), (2, None), (3, "")])
    bench = spark.createDataFrame([(7, item), (7, item), (None, item), (8, None), (9, "")], "item_id long, text string")
    for chars in (decontam.SLICE_CHARS, 1):
        got = Counter((r.doc_id, r.item_id, r.n_match) for r in decontam.find(docs, bench, slice_chars=chars, filter_bits=16).collect())
        assert got == {(1, 7, 20): 4, (1, None, 20): 2, (None, 7, 20): 2, (None, None, 20): 1}
        assert sorted(r.doc_id for r in decontam.without(docs, bench, slice_chars=chars, filter_bits=16).collect()) == [2, 3]


@pytest.mark.parametrize("n", [5, 8, 10, 14, 16, 18, 20, 25])
def test_decontamination_at_the_stated_tolerance(n):
    """Whole items with as many words substituted as ``need`` and ``LEAST_SHARE`` allow."""
    rng = random.Random(n)
    items = [(i, sentence(rng, n, 10**6)) for i in range(60)]
    texts = []
    for _, t in items:
        w = t.split()
        for k in rng.sample(range(n), n - max(decontam.need(n), math.ceil(decontam.LEAST_SHARE * n))):
            w[k] = "other"
        texts.append(" ".join((sentence(rng, 30, 10**6), *w, sentence(rng, 30, 10**6))))
    got = {r[:2] for r in decontam.scan(texts, decontam.Index(items))}
    assert got <= {(i, i) for i in range(60)} and len(got) >= 59


def test_html_blocks():
    body = "".join(f"<p>{'Some words of the main text are here. ' * 5}</p>" for _ in range(5))
    page = f"<html><head><title>no</title></head><body><ul>{'<li><a href=/>x</a></li>' * 20}</ul>{'<br>' * 6}{body}{'<br>' * 6}<div>foot</div></body></html>"
    text = html_blocks.main_text(page)[3]
    assert text.count("main text") == 25 and "foot" not in text and "title" not in text
    assert html_blocks.main_text("")[3] == "" and html_blocks.main_text(None)[3] is None


def test_html_lines_as_stated():
    lines = lambda x: [y for y in html_blocks.lines(x) if y]
    assert lines("<!-- hidden note <p>b") == ["b"]
    assert lines("a<script>var x = '<p>code</p>'") == ["a"] and lines("a<style>p { }") == ["a"]
    assert lines("a<script>x</SCRIPT >b<!-- c -->d<!DOCTYPE html>e") == ["a b d e"]
    assert lines("<head><title>t</title><body>b") == ["b"] and lines("<svg>x <p>y") == ["x", "y"]
    assert lines("one\ntwo\n\nthree &amp; four") == ["one", "two", "three & four"]
    assert lines("<p>one\ntwo</p><pre>a\nb</pre>c\nd") == ["one two", "a", "b", "c d"]
    assert lines("<pre>a\nb") == ["a", "b"] and lines("a < b <p>c</p>") == ["a < b", "c"] and lines("<p>a<b") == ["a"]


@pytest.mark.parametrize("piece", ["<svg>x", "<!-- x ", "<script", "<head>x", "<pre>\n", "<", "&amp;", "<p ", "<iframe><!--", "<pre>x\n</pre>"])
def test_html_takes_linear_time(piece):
    began = time.time()
    html_blocks.main_text(piece * 60_000)
    assert time.time() - began < 5


def test_html_runs_against_brute_force():
    rng = random.Random(22)
    for _ in range(300):
        n = [rng.choice((0, 0, 5, 40, 90)) for _ in range(rng.randrange(25))]
        block = [sum(n[i : i + 3]) for i in range(len(n))]
        kept, on = [], False
        for i, x in enumerate(block):
            if not on and x > 86 and (i + 1 == len(n) or block[i + 1] > 0):
                on = True
            if x <= 0:
                on = False
            if on:
                kept.append(i)
        assert [i for a, b in html_blocks.runs(np.array(n, np.int64)) for i in range(a, b)] == kept


def test_passages_against_brute_force(spark):
    rng = random.Random(6)
    texts, want = [], set()
    shared = [sentence(rng, 60) for _ in range(4)]
    for i in range(60):
        t = sentence(rng, rng.randrange(50, 300)).split()
        if i % 3 == 0:
            p = shared[i // 3 % 4].split()
            if i > 20:
                p[30] = "changed"
            t[20:20] = p
            if i >= 12:
                want.add(i)
        texts.append((i, " ".join(t)))
    docs = frame(spark, texts)
    got = substring.passages(docs).collect()
    assert {r.doc_id for r in got} == want
    assert all(r.end_word - r.start_word >= 58 and r.src_doc_id < r.doc_id for r in got)
    cut = {r.doc_id: r for r in substring.without_repeats(docs).collect()}
    for i, t in texts:
        n = len(t.split()) - len(cut[i].text.split())
        assert (58 <= n <= 62) if i in want else n == 0
        assert cut[i].n_chars == len(cut[i].text) if i in want else True


@pytest.mark.parametrize("stock", [1, 25])
def test_mosaic_passages_against_all_pairs(spark, stock):
    """Passages whose parts stand in ``stock`` earlier documents each, which are the first holders of the parts' seeds."""
    rng = random.Random(16)
    parts = [sentence(rng, 30) for _ in range(8)]
    texts = [" ".join((sentence(rng, 50), parts[i % 8], sentence(rng, 50))) for i in range(8 * stock)]
    n = len(texts)
    for _ in range(2):
        texts += [" ".join((sentence(rng, 80), parts[i], parts[i + 1], sentence(rng, 80))) for i in range(0, 8, 2)]
    got = {(r.doc_id, r.src_doc_id) for r in substring.passages(frame(spark, enumerate(texts))).collect()}
    runs = [{" ".join(s[i : i + 40]) for i in range(len(s) - 39)} for s in map(str.split, texts)]
    want = {(j, i) for i, j in itertools.combinations(range(len(texts)), 2) if runs[i] & runs[j]}
    assert want == {(n + 4 + i, n + i) for i in range(4)} and got == want


def fuzzy(rng, n, every=None, share=None):
    """A passage and a copy with every so many words, or that share of them, substituted."""
    w = sentence(rng, n, 10**6).split()
    at = range(every - 1, n, every) if every else rng.sample(range(n), int(n * share))
    c = list(w)
    for i in at:
        c[i] = f"s{rng.randrange(10**6)}"
    return w, c


def brute_passages(texts, least=substring.LEAST_WORDS, share=substring.LEAST_SHARE):
    """(later, earlier) document of each pair with a stretch of ``least`` words or more, ``share`` of them equal on one diagonal."""
    out = set()
    split = [np.array(t.split()) for t in texts]
    for j, i in ((j, i) for j in range(len(split)) for i in range(j)):
        a, b = split[i], split[j]
        for d in range(-len(a) + least, len(b) - least + 1):
            x, y = a[max(0, -d) :], b[max(0, d) :]
            n = min(len(x), len(y))
            eq = np.concatenate(([0], np.cumsum(x[:n] == y[:n])))
            if n >= least and (eq[least:] - eq[:-least]).max() >= share * least:
                out.add((j, i))
                break
    return out


def test_fuzzy_passages_against_all_diagonals(spark):
    rng = random.Random(17)
    texts = []
    for k in range(40):
        w, c = fuzzy(rng, (40, 60, 80, 120)[k % 4], share=(0.05, 0.1, 0.15, 0.2)[k // 4 % 4])
        for x in (w, c):
            texts.append(" ".join((sentence(rng, 40, 10**6), *x, sentence(rng, 40, 10**6))))
    want = brute_passages(texts)
    got = {(r.doc_id, r.src_doc_id) for r in substring.passages(frame(spark, enumerate(texts))).collect()}
    assert got <= want and len(want) >= 40 and len(got) >= 0.9 * len(want)


@pytest.mark.parametrize("every", [6, 7, 9])
def test_long_fuzzy_copies_are_found_whole(spark, every):
    rng = random.Random(every)
    texts = []
    for _ in range(6):
        w, c = fuzzy(rng, 300, every=every)
        texts += [" ".join((sentence(rng, 50, 10**6), *x, sentence(rng, 50, 10**6))) for x in (w, c)]
    for flank in (substring.FLANK, 16):
        got = {r.doc_id: r for r in substring.passages(frame(spark, enumerate(texts)), flank=flank).collect()}
        assert sorted(got) == list(range(1, 12, 2))
        assert all(r.src_doc_id == r.doc_id - 1 and r.start_word <= 50 + every and r.end_word >= 350 - every for r in got.values())


def test_common_seeds_thinned_in_a_task(spark):
    """Many copies in small chunks: all pairs of them are found, whatever was thinned out where."""
    rng = random.Random(18)
    shared = sentence(rng, 60)
    texts = [f"{sentence(rng, 30)} {shared} {sentence(rng, 30)}" for _ in range(120)]
    docs = frame(spark, enumerate(texts)).repartition(3)
    for chunk in (100, 3000, 1 << 20):
        got = substring.passages(docs, holders=4, chunk=chunk).collect()
        assert {(r.doc_id, r.src_doc_id) for r in got} == {(j, i) for i, j in itertools.combinations(range(120), 2)}
        assert all(r.end_word - r.start_word >= 60 for r in got) and len(got) == 120 * 119 // 2


@pytest.mark.parametrize("split", [{}, {"members": 7, "common_seeds": 20}])
def test_passages_of_common_seeds_against_all_diagonals(spark, split):
    """Variants of few passages in many documents, with a common line in all and common words before: no seed of theirs is rare."""
    rng = random.Random(21)
    line = sentence(rng, 14)
    base = [sentence(rng, 60, 10**6).split() for _ in range(2)]
    texts = []
    for i in range(90):
        w = list(base[i % 2])
        for at in rng.sample(range(60), rng.choice((0, 3, 6))):
            w[at] = f"s{rng.randrange(10**6)}"
        texts.append(" ".join((sentence(rng, 40, 10**6), line, sentence(rng, 20, 10**6), *w[: rng.choice((60, 44))], sentence(rng, 40, 10**6))))
    # earlier documents are the first holders of the parts' seeds
    texts = [" ".join((sentence(rng, 20, 10**6), *b[i : i + 15], sentence(rng, 20, 10**6))) for b in base for i in range(0, 60, 15)] + texts
    want = brute_passages(texts)
    rows = substring.passages(frame(spark, enumerate(texts)), **split).collect()
    got = {(r.doc_id, r.src_doc_id) for r in rows}
    assert len(want) > 90 * 10 and want <= got
    for r in rows:  # a longer one need not hold 40 words that are equal often enough
        x, y = texts[r.doc_id].split()[r.start_word : r.end_word], texts[r.src_doc_id].split()[r.src_start_word : r.src_end_word]
        assert r.n_equal >= 0.8 * max(len(x), len(y)) >= 32 and (len(x) != len(y) or r.n_equal >= sum(map(str.__eq__, x, y)))


@pytest.mark.parametrize("of", ["passages", "pipeline"])
def test_passages_with_gaps_of_common_seeds(spark, of):
    """Passages with words put in and left out, all seeds of which are common and stand in an earlier document by themselves."""
    import corpus_pipeline

    rng = random.Random(25)
    parts = [sentence(rng, 12, 10**6).split() for _ in range(4)]
    new = lambda n: sentence(rng, n, 10**6).split()
    texts = [[*new(20), *p, *new(20)] for _ in range(20) for p in parts]  # pieces, too short for a passage
    n = len(texts)
    texts += [[*new(30), *parts[0], *parts[1], *parts[2], *parts[3], *new(30)], [*new(30), *parts[0], *new(1), *parts[1], *new(1), *parts[2], *new(1), *parts[3], *new(30)]]
    docs = frame(spark, enumerate(map(" ".join, texts)))
    if of == "passages":
        got = [(r.doc_id, r.src_doc_id, r.end_word - r.start_word, r.n_equal) for r in substring.passages(docs).collect()]
        assert [x[:2] for x in got] == [(n + 1, n)] and 49 <= got[0][2] <= 53 and got[0][3] >= 48
    else:
        left = {r.doc_id: r.text.split() for r in corpus_pipeline.cut_repeats(spark, docs, None).collect()}
        assert all(left[i] == texts[i] for i in range(n + 1)) and 58 <= len(left[n + 1]) <= 62


def test_pairs_of_a_common_seed_come_in_pieces():
    """However many pairs of a seed go on, and with or without a gap, they are never in memory together."""
    around, n = substring.Around(substring.K, substring.LEAST_WORDS, substring.LEAST_SHARE), 1500
    rng = np.random.default_rng(27)
    alike = np.tile(rng.integers(0, 8, around.total, np.uint8), (n, 1))
    shifted = alike.copy()  # every other row has two words less before the seed and two more behind it
    shifted[::2, 2 : around.before - 10] = alike[::2, : around.before - 12]
    shifted[::2, around.before + 15 : -2] = alike[::2, around.before + 17 :]
    for codes, least in ((alike, n * (n - 1) // 2), (shifted, 2 * (n // 2) * (n // 2 - 1) // 2)):
        rows = around.rows(codes, np.zeros(n, np.uint64), np.zeros(n, np.uint8))
        sizes = [len(part[0]) for part in around.pairs(rows, np.arange(n), np.zeros(n, np.int32))]
        assert least <= sum(sizes) <= n * (n - 1) // 2 and max(sizes) <= 1 << 16


def test_shuffle_files_go_once_a_table_is_written(spark):
    """Else each step's shuffle files are on disk together with those of the next one."""
    jvm = spark.sparkContext._jvm

    def files():
        return {f.getName() for f in jvm.scala.jdk.javaapi.CollectionConverters.asJava(jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}

    with Workspace(spark) as ws:
        ws.settle()
        before = files()
        assert ws.write(spark.range(1000).repartition(3, "id"), "some").count() == 1000
        ws.write(spark.range(1000).repartition(3, "id"), "more")
        ws.settle()
        assert files() <= before


def test_pairs_are_aligned_in_parts(spark, monkeypatch):
    """However many pairs of documents there are, only the words that one part needs are on disk together; the passages are the same."""
    rng = random.Random(31)
    shared = sentence(rng, 60, 10**6)
    docs = frame(spark, [(i, f"{sentence(rng, 30, 10**6)} {shared} {sentence(rng, 30, 10**6)}") for i in range(30)])
    whole = {tuple(r) for r in substring.passages(docs).collect()}
    written, write = [], Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, name, keep=False: written.append((name, got := write(self, df, name, keep))) or got)
    assert {tuple(r) for r in substring.passages(docs, pairs=100).collect()} == whole and len(whole) == 30 * 29 // 2
    sizes = [df.count() for name, df in written if name.startswith("aligned")]
    assert len(sizes) >= 5 and sum(sizes) == len(whole) and max(sizes) < 200


@pytest.mark.parametrize("near_from", [0, 10**9])
def test_seeds_near_a_common_one_tell_gaps(spark, near_from):
    """Passages with a gap are found between documents that all share a line; that some hold the line twice makes no pair."""
    rng = random.Random(28)
    new = lambda n: sentence(rng, n, 10**6).split()
    parts, line = [new(12) for _ in range(4)], new(14)
    texts = [[*new(20), *p, *new(20)] for _ in range(20) for p in parts]
    texts += [[*new(30), *line, *new(rng.randrange(20, 60)), *(line if i % 3 == 0 else new(5)), *new(30)] for i in range(60)]
    n = len(texts)
    texts += [[*line, *new(30), *itertools.chain(*parts), *new(30)], [*line, *new(30), *parts[0], *new(1), *parts[1], *new(1), *parts[2], *new(1), *parts[3], *new(30)]]
    got = [(r.doc_id, r.src_doc_id) for r in substring.passages(frame(spark, enumerate(map(" ".join, texts))), near_from=near_from).collect()]
    assert got == [(n + 1, n)]


def test_the_same_seed_twice_is_no_gap():
    """A pair that must have a gap and shares one common seed, twice in one document, has no chain with one."""
    chain = substring._chain(substring.K, substring.LEAST_SEEDS, substring.LEAST_SPAN)
    names = ["b", "a", "pos_b", "pos_a", "weak"]
    rows = lambda places: pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*((2, 1, b, a, True) for b, a in places))], names)
    count = lambda places: sum(b.num_rows for b in chain(iter([rows(places)])))
    assert count([(10, 50), (13, 53), (40, 50), (43, 53)]) == 0
    assert count([(10, 50), (13, 53), (40, 81), (43, 84)]) == 1
    assert count([(10, 50), (13, 53), (140, 181), (143, 184)]) == 0  # no gap so long is aligned


def test_runs_are_classes(spark):
    """Runs of one word or line: a passage a document, in the first holder of the class; what stands beside runs is still found."""
    rng = random.Random(23)
    line, beside = sentence(rng, 9, 10**6), sentence(rng, 30, 10**6)
    run = lambda i: " ".join(["tick"] * (60 + 7 * i % 50)) if i % 2 else " ".join([line] * (6 + i % 5))
    texts = [" ".join((sentence(rng, 40, 10**6), beside if i in (30, 31, 32, 41) else sentence(rng, 10, 10**6), run(i), sentence(rng, 40, 10**6))) for i in range(60)]
    texts.append(" ".join((sentence(rng, 40, 10**6), *["tick"] * 34, sentence(rng, 40, 10**6))))  # no run of its own right, but a passage of 40 words
    docs = frame(spark, enumerate(texts))
    rows = substring.passages(docs).collect()
    covered = collections.defaultdict(set)
    for r in rows:
        covered[r.doc_id] |= set(range(r.start_word, r.end_word))
    for i in range(2, 60):
        w, n = texts[i].split(), len(run(i).split())
        at = 70 if i in (30, 31, 32, 41) else 50
        assert w[at : at + n] == run(i).split() and covered[i] >= set(range(at, at + n))
        assert (covered[i] >= set(range(40, at))) == (i in (32, 41))
        assert any(r.doc_id == i and r.src_doc_id == i % 2 and r.end_word - r.start_word == n for r in rows)
    assert {(32, 30), (41, 31)} <= {(r.doc_id, r.src_doc_id) for r in rows} and len(rows) < 100  # all pairs are 870
    left = {r.doc_id: r.text.split() for r in substring.without_repeats(docs).collect()}
    assert all("tick" not in left[i] and line.split()[0] not in left[i] for i in range(2, 60))


def test_runs_against_brute_force():
    rng = random.Random(24)
    for _ in range(200):
        texts = []
        for _ in range(3):
            t = []
            while len(t) < rng.randrange(1, 200):
                unit = [rng.randrange(4) for _ in range(rng.randrange(1, 6))]
                t += (unit * rng.randrange(1, 30))[: rng.randrange(1, 70)]
            texts.append(t)
        h, ptr = np.array([x + 1 for t in texts for x in t], np.uint64), np.cumsum([0] + [len(t) for t in texts])
        want = set()
        for i, t in enumerate(texts):
            for p in range(1, 9):
                at = 0
                while at + p < len(t):
                    end = at
                    while end + p < len(t) and t[end] == t[end + p]:
                        end += 1
                    if end - at >= 19 and not any(w[0] == i and w[1] <= at and end + p <= w[2] for w in want):
                        want.add((i, at, end + p, p))
                    at = max(end, at) + 1
        got = substring.runs(h, ptr, 20, 8)
        assert {r[:4] for r in got} == want and len(got) == len(want)


def test_equal_texts_are_a_class(spark):
    """A copy has one passage, in the first of its class; that one is held against all other texts."""
    rng = random.Random(22)
    shared, short = sentence(rng, 60), sentence(rng, 20)
    a, b = (f"{sentence(rng, 30)} {shared} {sentence(rng, 30)}" for _ in range(2))
    rows = [(i, a) for i in range(1, 40)] + [(i, b) for i in range(40, 80)] + [(80, short), (81, short)]
    got = {(r.doc_id, r.src_doc_id, r.end_word - r.start_word) for r in substring.passages(frame(spark, rows)).collect()}
    assert {x for x in got if x[2] == 120} == {(i, 1, 120) for i in range(2, 40)} | {(i, 40, 120) for i in range(41, 80)}
    assert [x[:2] for x in got if x[2] < 120] == [(40, 1)] and len(got) == 38 + 39 + 1
    # doc 1 has both texts: it can't stand for the others
    got = {(r.doc_id, r.src_doc_id) for r in substring.passages(frame(spark, [(1, a), (1, b), (2, b), (3, a)])).collect()}
    assert got == {(2, 1), (3, 1), (3, 2)}


def test_pieces_held_by_earlier_documents_do_not_hide_a_passage(spark):
    rng = random.Random(19)
    passage = sentence(rng, 120, 10**6).split()
    texts = [" ".join((sentence(rng, 40, 10**6), *passage[i : i + 24], sentence(rng, 40, 10**6))) for i in range(0, 120, 24)]
    texts += [" ".join((sentence(rng, 40, 10**6), *passage, sentence(rng, 40, 10**6))) for _ in range(2)]
    got = {(r.doc_id, r.src_doc_id, r.end_word - r.start_word >= 120) for r in substring.passages(frame(spark, enumerate(texts))).collect()}
    assert got == {(6, 5, True)} == {(*p, True) for p in brute_passages(texts)}


def test_versions_of_a_document(spark):
    rng = random.Random(20)
    a, b, shared = sentence(rng, 80), sentence(rng, 80), sentence(rng, 70)
    rows = [(1, f"{a} {shared}"), (2, f"{b} {shared}"), (2, b), (2, f"{b} {shared}"), (None, shared), (3, None), (4, "")]
    docs = frame(spark, rows).withColumn("cuts", F.lit(7)).withColumn("of", F.lit("x")).withColumn("version", F.lit(1)).withColumn("row", F.lit(2))
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "-") for r in out.collect()) == sorted([(1, rows[0][1]), (2, b), (2, b), (2, b), (0, shared), (3, "-"), (4, "-")])


def test_chains_against_all_orders():
    rng = random.Random(7)
    for _ in range(50):
        segs = sorted({(rng.randrange(60), rng.randrange(60), rng.randrange(1, 9), 1) for _ in range(6)})
        best = 0.0
        for k in range(1, len(segs) + 1):
            for c in itertools.permutations(segs, k):
                if all(a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1] for a, b in zip(c, c[1:])):
                    best = max(best, sum(s[2] for s in c) - 0.1 * sum(b[0] - a[0] - a[2] + b[1] - a[1] - a[2] for a, b in zip(c, c[1:])))
        c = substring.chains(list(segs))[0]
        assert sum(s[2] for s in c) - 0.1 * sum(b[0] - a[0] - a[2] + b[1] - a[1] - a[2] for a, b in zip(c, c[1:])) == pytest.approx(best)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(8)
    texts = [sentence(rng, 200) for _ in range(30)]
    for t in list(texts[:15]):
        for rate in (0.0, 0.01, 0.05):
            texts.append(" ".join("new" if rng.random() < rate else w for w in t.split()))
    sets = [set(shingles(words([t])[0], superminhash.SHINGLE).tolist()) for t in texts]
    jac = lambda a, b: len(a & b) / len(a | b)
    pairs = {(i, j): jac(sets[i], sets[j]) for i, j in itertools.combinations(range(len(texts)), 2)}
    near = {p for p, x in pairs.items() if x >= superminhash.LEAST_JACCARD}
    group = {r.doc_id: r.group_id for r in superminhash.groups_of(frame(spark, enumerate(texts))).collect()}
    found = {p for p in near if p[0] in group and group.get(p[0]) == group.get(p[1])}
    assert len(found) >= 0.95 * len(near)
    # all that is grouped hangs together by pairs that are near, but for the error of the estimate
    top = list(range(len(texts)))
    for (i, j), x in pairs.items():
        if x >= superminhash.LEAST_JACCARD - 0.12:
            top = [min(top[i], top[j]) if t in (top[i], top[j]) else t for t in top]
    assert all(top[i] == top[j] for i, j in pairs if group.get(i) is not None and group.get(i) == group.get(j))


def test_no_text_is_lost_with_repeated_doc_ids(spark):
    rng = random.Random(26)
    a, b, c = (sentence(rng, 60, 10**6) for _ in range(3))
    rows = [(5, a), (5, b), (6, b), (6, c), (6, c), (7, f"{a} end"), (None, a), (None, a), (8, None), (9, ""), (10, ""), (4, c)]
    docs = frame(spark, rows).withColumn("row", F.lit(1)).withColumn("of", F.lit("x")).withColumn("again", F.lit(True)).withColumn("node", F.lit(0)).withColumn("a b`c", F.lit(3))
    out = superminhash.keep_one(docs)
    assert out.columns == docs.columns
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted([(5, a), (5, b), (None, a), (None, a), (8, None), (9, ""), (4, c)], key=key)
    got = Counter((r.doc_id, r.group_id, r.keep) for r in superminhash.near_duplicates(docs).collect())
    assert got == {(5, 5, True): 2, (6, 5, False): 1, (6, 4, False): 2, (7, 5, False): 1, (None, None, True): 2, (8, None, True): 1, (9, 9, True): 1, (10, 9, False): 1, (4, 4, True): 1}
    again = superminhash.keep_one(frame(spark, [(1, a), (1, a), (2, a), (3, b)]))
    assert sorted((r.doc_id, r.text) for r in again.collect()) == [(1, a), (3, b)]


def test_split_buckets_against_whole_ones(spark):
    """Near copies of a text, copies of copies, and unlike texts with a template in common: the same groups however buckets are split."""
    rng = random.Random(27)
    base = sentence(rng, 120, 10**6).split()
    texts, now = [], base
    for i in range(90):
        w = list(now if i % 3 else base)
        for k in rng.sample(range(120), 6):
            w[k] = f"n{i}-{k}"
        now = w if i % 3 else now
        texts.append(" ".join(w))
    texts += [" ".join((*base[:50], sentence(rng, 70, 10**6))) for _ in range(40)]
    docs = frame(spark, enumerate(texts))
    whole = {r.doc_id: r.group_id for r in superminhash.near_duplicates(docs).collect()}
    for members in (4, 16):
        assert {r.doc_id: r.group_id for r in superminhash.near_duplicates(docs, members=members).collect()} == whole
    assert len({g for g in whole.values() if g is not None}) < 40


def test_long_sets_are_signed_in_pieces():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 5, 700, 90, 2500, 1)]
    ptr = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    whole = superminhash.signatures(np.concatenate(sets), ptr)
    for piece in (300, 1000):
        assert (superminhash.signatures(np.concatenate(sets), ptr, piece=piece) == whole).all()


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [np.sort(e[:2000]), np.sort(e[1000:])]
    sig = superminhash.signatures(np.concatenate(sets), np.array([0, 2000, 4000]))
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.12


def test_link_against_all_pairs():
    rng = np.random.default_rng(2)
    for _ in range(20):
        base = rng.integers(0, 256, (4, 40)).astype(np.uint8)
        sig = base[rng.integers(0, 4, 50)].copy()
        noise = rng.random(sig.shape) < rng.random((50, 1)) * 0.6
        sig[noise] = rng.integers(0, 256, noise.sum())
        top = list(range(50))
        for i, j in itertools.combinations(range(50), 2):
            if (sig[i] != sig[j]).sum() <= 20:
                a, b = sorted((top[i], top[j]))
                top = [a if t == b else t for t in top]
        assert superminhash.link(sig, 20).tolist() == top


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103)]
    with Workspace(spark) as ws:
        got = {r.node: r.root for r in components(ws, spark.createDataFrame(edges, "a long, b long"), "c").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {103: 100, 105: 100}


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").where("doc_id is not null")
    w = quality.fit(docs, labels.where("doc_id % 4 <> 0"))
    scored = quality.score(docs, w).withColumnRenamed("quality", "p").join(labels.where("doc_id % 4 = 0"), "doc_id").selectExpr("avg(int((p >= 0.5) = (quality = 1))) acc").first()[0]
    assert scored > 0.85


def test_quality_against_brute_force(spark):
    """Features, training and scores in plain Python, with one feature number a distinct n-gram."""
    rng = random.Random(25)
    texts = [" ".join(rng.choice(("good", "bad", "!!", "?!?", "!!!!!!!!a", "!" * 500, "the", "x_1")) for _ in range(rng.randrange(1, 30))) for _ in range(60)] + ["", "the the the"]
    rows = [(i, t) for i, t in enumerate(texts)]
    labels = [(i, int("good" in texts[i].split()[:3]), None if i % 5 == 0 else int("bad" in texts[i].split()[:3])) for i in range(0, 60, 2)] + [(None, 1, 1), (3, None, None), (999, 1, 1), (4, 1, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)

    def plain(t):
        w = [x.lower() for x in re.findall(r"\w+", t)]
        f = {("w", x) for x in w} | {("p", *x) for x in zip(w, w[1:])} | {("s", x) for x in re.findall(r"[^\w\s]+", t)}
        return f | ({("t",)} if any(a == b == c for a, b, c in zip(w, w[1:], w[2:])) else set())

    train = [(r.doc_id, r.quality, r.toxic) for r in labels.where("doc_id < 900 and (quality is not null or toxic is not null)").selectExpr("*", "xxhash64(doc_id) h").orderBy("h", "doc_id", "quality", "toxic").collect()]
    z, n = [Counter(), Counter()], [Counter(), Counter()]
    w = lambda m, f: 0.0 if abs(z[m][f]) <= quality.L1 else (math.copysign(quality.L1, z[m][f]) - z[m][f]) / ((quality.BETA + math.sqrt(n[m][f])) / quality.ALPHA + quality.L2)
    p = lambda m, f: 1 / (1 + math.exp(-sum(w(m, x) for x in f)))
    for _ in range(quality.EPOCHS):
        for i, *ys in train:
            f = plain(texts[i]) | {"bias"}
            for m, y in enumerate(ys):
                if y is None:
                    continue
                g = p(m, f) - y
                old = {x: w(m, x) for x in f}
                for x in f:
                    sigma = (math.sqrt(n[m][x] + g * g) - math.sqrt(n[m][x])) / quality.ALPHA
                    z[m][x] += g - sigma * old[x]
                    n[m][x] += g * g
    got = {r.doc_id: r for r in quality.classify(spark, docs, labels).collect()}
    kept = {r.doc_id for r in quality.quality_filter(docs, quality.fit(docs, labels)).collect()}
    for i, t in rows:
        f = plain(t) | {"bias"}
        assert (got[i].quality, got[i].toxicity) == pytest.approx((p(0, f), p(1, f)), abs=1e-5)
        assert got[i].keep == (i in kept) == (got[i].quality >= quality.LEAST_QUALITY and got[i].toxicity < quality.MOST_TOXIC)


def test_whole_runs_of_symbols_count():
    a, b = quality.features(["!!!!!!!!", "!!!!!!!!!"])
    assert a.tolist() != b.tolist()


def test_bpe_chunks_equal_whole(spark):
    rng = random.Random(9)
    texts = [sentence(rng, n) + "  \n don't  12345 ünïcodeあ " * 3 for n in (1, 50, 400)] + ["x" * 900, " " * 700 + "a", "a" + "\n \t" * 300]
    got = {r.doc_id: r for r in bpe.encode_documents(frame(spark, enumerate(texts)), chunk=100, overlap=40).collect()}
    c = bpe.codec()
    for i, t in enumerate(texts):
        assert list(got[i].ids) == c.inner.encode_ordinary(t) and got[i].round_trip
    back = bpe.decode_documents(bpe.encode_documents(frame(spark, enumerate(texts))))
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(texts))


def test_license_rules(spark):
    rows = [(1, "Hello.\nLicensed under the Apache License, Version 2.0."), (2, "nothing here"), (3, "All rights reserved. All rights reserved!"), (4, "This is free and unencumbered software released into the public  domain."), (5, "All rights-reserved.")]
    got = {(r.doc_id, r.license, r.n_found) for r in license.recognise(frame(spark, rows)).collect()}
    assert got == {(1, "Apache-2.0", 1), (3, "Proprietary", 2), (4, "Unlicense", 1), (5, "Proprietary", 1)}


def test_repeated_rows_of_a_document_are_scanned_each(spark):
    mit = " ".join(("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."))
    rows = [(7, mit), (7, mit), (None, mit), (None, "All rights reserved.")]
    docs = frame(spark, rows).withColumn("said", F.lit(1)).withColumn("license", F.lit("x"))
    got = Counter((r.doc_id, r.license, r.rule, r.n_found, r.is_longest) for r in license.recognise(docs).collect())
    assert got == {(7, "MIT", 3, 1, True): 2, (7, "MIT", 4, 1, False): 2, (None, "MIT", 3, 1, True): 1, (None, "MIT", 4, 1, False): 1, (None, "Proprietary", 0, 1, True): 1}


def test_license_rules_against_brute_force():
    """Random sequences of known sentences and noise, wrapped anywhere; each rule's sequence is looked up in the list of ids."""
    rng = random.Random(21)
    ids = sorted(license.SENTENCES)
    for _ in range(200):
        said = [rng.choice(ids) for _ in range(rng.randrange(6))]
        text = ""
        for i in said:
            text += rng.choice(("", "Some other words here. ", "Note:\n")) + re.sub(" ", lambda _: rng.choice((" ", " ", " ", "\n", "\n * ")), license.SENTENCES[i].capitalize()) + rng.choice((". ", ".\n"))
        known = {license.normal(v): k for k, v in license.SENTENCES.items()}
        found = [sid for _, sid in license.said_in(text, known, license.beginnings(known))]
        assert found == said, text
        want = []
        for name, k, seq in license.rule_rows():
            seq = seq.strip(",").split(",")
            n, i = 0, 0
            while i + len(seq) <= len(said):  # side by side, not overlapping
                hit = said[i : i + len(seq)] == seq
                n, i = n + hit, i + (len(seq) if hit else 1)
            if n:
                want.append((name, k, n))
        assert [x[:3] for x in license.rules_in(said, license.rule_rows())] == want


NOTICES = {
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy was not distributed with this file, You can obtain one.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


@pytest.mark.parametrize("width", [30, 72, 10_000])
def test_canonical_notices_wrapped(spark, width):
    import textwrap

    rows = [(i, "\n".join(f" * {x}" for x in ["Copyright", "", *textwrap.wrap(t, width)])) for i, t in enumerate(NOTICES.values())]
    got = {(r.doc_id, r.license) for r in license.recognise(frame(spark, rows)).collect()}
    assert got == set(enumerate(NOTICES))
    assert "gpl03" in license.SENTENCES and license.recognise(frame(spark, rows)).where("license = 'GPL-2.0' and is_longest").first().rule == 1


def test_pipeline_on_planted_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count()
    assert corpus_pipeline.run(spark, SF).where("not round_trip").count() == 0


def test_pipeline_cuts_passages_of_common_seeds(spark):
    """A fuzzy passage whose parts stand in 20 earlier documents each is cut from the later one of the two that hold it."""
    import corpus_pipeline

    rng = random.Random(31)
    w, c = fuzzy(rng, 60, every=9)
    unique = lambda n: sentence(rng, n, 10**6)
    texts = [f"{unique(30)} {' '.join(x[i : i + 20])} {unique(30)}" for x in (w, c) for i in range(0, 50, 10) for _ in range(20)]
    texts += [f"{unique(40)} {' '.join(x)} {unique(40)}" for x in (w, c)]
    n = len(texts)
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, frame(spark, enumerate(texts)), SF).collect()}
    assert all(got[i] == texts[i] for i in range(n - 1))
    assert 55 <= len(texts[-1].split()) - len(got[n - 1].split()) <= 65


def test_pipeline_against_brute_force(spark, tmp_path):
    """The rows of run() on a made-up corpus, from plain definitions of its five stages."""
    import corpus_pipeline

    rng = random.Random(30)
    good = lambda n: "good report about " + sentence(rng, n, 10**6)
    rows, n = [], itertools.count()
    for _ in range(40):
        rows.append((next(n), good(120)))
    shared = sentence(rng, 60, 10**6)
    for k in range(4):  # copies of the first four, a few words changed
        w = rows[k][1].split()
        w[50], w[90] = "changed", "again"
        rows.append((next(n), " ".join(w)))
    rows.append((next(n), rows[5][1]))
    rows += [(next(n), f"{good(70)} {shared} {sentence(rng, 70, 10**6)}") for _ in range(5)]
    items = [(1, sentence(rng, 25, 10**6)), (2, sentence(rng, 6, 10**6)), (3, None)]
    for _, t in items[:2]:
        rows.append((next(n), f"{good(40)} {t} {sentence(rng, 40, 10**6)}"))
    bad = {next(n): "buy now cheap " + sentence(rng, 120, 10**6) for _ in range(40)}
    labels = [(d, 1, 0) for d, _ in rows] + [(d, 0, 1) for d in bad] + [(None, 1, 0), (10**6, 0, 1), (0, None, None)]
    extra = [(next(n), None), (next(n), ""), (None, good(100)), (0, rows[0][1])]
    docs = frame(spark, [*rows, *bad.items(), *extra]).withColumn("keep", F.lit("k")).withColumn("row", F.lit(1)).withColumn("node", F.lit(2)).withColumn("a`b", F.lit(3))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # a row without text is dropped by the classifier; empty texts and the one without an id are judged by it like others
    scored = {(r.doc_id, r.keep) for r in quality.classify(spark, docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert all((d, False) in scored for d in bad) and all((d, True) in scored for d, _ in rows)
    now = [x for x in [*rows, extra[2], extra[3]] if x[1]] + ([extra[1]] if (extra[1][0], True) in scored else [])
    sh = lambda t: {tuple(w[i : i + 3]) for w in [t.lower().split()] for i in range(max(1, len(w) - 2))}
    kept: list[tuple] = []
    for d, t in sorted(now, key=lambda x: (x[0] is None, x[0])):
        if d is None or not t or all(len(sh(t) & sh(u)) < 0.5 * len(sh(t) | sh(u)) for e, u in kept if e is not None and u):
            kept.append((d, t))
    first = min(d for d, t in kept if d is not None and shared in t)
    cut = [(d, t if d is None or d == first or shared not in t else re.sub(r"\s+", " ", t.replace(shared, " ")).strip()) for d, t in kept]
    leaks = {i for i, _ in brute_overlaps([t for _, t in cut], [t for _, t in items])}
    want = sorted(((d, t) for i, (d, t) in enumerate(cut) if i not in leaks), key=str)
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    c = bpe.codec()
    assert sorted(((r.doc_id, tuple(r.ids)) for r in got), key=str) == sorted(((d, tuple(c.inner.encode_ordinary(t))) for d, t in want), key=str)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got) and len(leaks) == 2 and len(got) == 40 + 5 + 1 + ((extra[1][0], True) in scored)


def test_awkward_values(spark, tables):
    """What nulls, empty, repeated and very long texts give, row by row."""
    docs = frame(spark, AWKWARD)
    key = lambda rows: sorted(rows, key=str)
    bands = [(r.doc_id, r.n_bytes, r.reason, r.keep) for r in compress_bands.compression_bands(docs).collect()]
    assert key(bands)[:2] == key(bands[:9])[:2] and (1, None, "no text", False) in bands and (2, 0, None, True) in bands and (6, 70000, "repetitive", False) in bands and bands.count((5, 200, "repetitive", False)) == 2
    lm = [(r.doc_id, r.n_words, r.log_prob, r.mean_log_prob) for r in lm_automaton.score(docs).collect()]
    assert (1, None, None, None) in lm and (2, 0, 0.0, None) in lm and (3, 0, 0.0, None) in lm and sum(x[0] is None and x[1] == 20 and x[2] < 0 for x in lm) == 1
    assert len({x for x in lm if x[0] == 5}) == 1 and sum(x[0] == 5 for x in lm) == 2
    q = [(r.doc_id, r.quality is None, r.keep) for r in quality.classify(spark, docs, tables["labels"]).collect()]
    assert (1, True, False) in q and len(q) == 9 and sum(x[1] for x in q) == 1
    none = [(r.quality, r.toxicity, r.keep) for r in quality.classify(spark, docs, tables["labels"].limit(0)).where("doc_id = 4").collect()]
    assert none == [(0.5, pytest.approx(0, abs=1e-9), True)]
    near = Counter((r.doc_id, r.group_id, r.keep) for r in superminhash.near_duplicates(docs).collect())
    assert near == {(1, None, True): 1, (2, None, True): 1, (3, None, True): 1, (None, None, True): 1, (4, None, True): 1, (5, 5, True): 1, (5, 5, False): 1, (6, None, True): 1, (7, None, True): 1}
    coded = {r.doc_id: r for r in bpe.encode_documents(docs).collect()}
    assert coded[1].ids is None and coded[1].n_tokens is None and list(coded[2].ids) == [] and coded[6].n_bytes == 70000
    pages = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "<p>x")], "page_id long, html string")
    assert key((r.page_id, r.n_lines, r.text) for r in html_blocks.extract(pages).collect()) == key([(1, 0, None), (2, 1, ""), (2, 1, ""), (None, 2, "")])


def test_nothing_is_left_in_the_shared_folder(spark, tables):
    from fleetweave.llm._spark import clean

    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    superminhash.near_duplicates(tables["documents"]).count()
    substring.without_repeats(tables["documents"]).count()
    assert [x for x in os.listdir(root) if x.startswith("fleetweave-")]
    clean(spark)
    assert not [x for x in os.listdir(root) if x.startswith("fleetweave-")]


def test_every_operator_has_a_query():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 11))
