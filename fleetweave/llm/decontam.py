"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over consecutive words name the positions that count; the words at the others may differ. Hashes of all
masked windows of the test items are joined with those of the documents. Around each hit the item is laid over the
document on the hit's diagonal, and the best run of words (1 for an equal word, ``-penalty`` for a substituted one)
is verified: it must have ``least_match`` equal words, or ``least_share`` of the words of a shorter item. Where the run
is cut short by substitutions, the item counts as well if ``least_share`` of all its words are equal on the diagonal.

A benchmark of at most ``slice_chars`` characters, as all usual ones are, is broadcast as an index: one narrow pass over
the documents and no exchange. A larger one has a table of ``2 ** filter_bits`` bits broadcast, a
fixed size: the documents' windows whose bit is set are joined with those of the items by hash, and only the documents
with hits meet the items they hit.

Defined cases: null and empty texts on either side match nothing; an item of fewer words than
the longest mask is also looked up by all masks of its own length that leave out as many words as may differ; one of
fewer than ``least_words`` words says little and matches only a document that consists of its words; one without words
matches nothing; a very long text is searched as a whole; repeated rows give rows each, of documents and of items;
several places of an item in a document give one row, that with most equal words and of these the first; empty tables
give no rows; other columns, whatever their names, are ignored by ``find`` and kept by ``without``, and ids may be null.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.llm._spark import Batches, Workspace, filtered, if_small, pack, sorted_groups, tidy, unpack
from fleetweave.llm._text import groups, mix, ngrams, words

MASKS = ("11101101", "1101001011", "10110010101", "1100110011")
LEAST_MATCH, LEAST_SHARE, LEAST_WORDS, PENALTY = 13, 0.8, 4, 3
#: characters of items that are broadcast as they are, and the bits of the table that stands for more
SLICE_CHARS, FILTER_BITS = 4_000_000, 27
_MULT = np.uint64(0xD6E8FEB86659FD93)
_BITS = 22

SCHEMA = "doc_id long, item_id long, start_char long, end_char long, n_match long, n_words long"


def masked(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window of the mask's span."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(n, int(mask, 2) * 8 + 1, np.uint64)
        for k, c in enumerate(mask):
            if c == "1":
                total = total * _MULT + h[k : k + n]
    return mix(total)


def need(n: int, least_match: int = LEAST_MATCH, least_share: float = LEAST_SHARE) -> int:
    return min(least_match, math.ceil(least_share * n))


def short_masks(n: int) -> list[str]:
    """All masks over n words that leave out as many as may differ, without what they leave out at the ends."""
    gaps = itertools.combinations(range(n), n - need(n))
    return sorted({"".join("0" if k in g else "1" for k in range(n)).strip("0") for g in gaps})


class Index:
    """The seeds of test items, sorted by hash; a bit table answers most lookups."""

    def __init__(self, items: list[tuple[int | None, str]], masks=MASKS, least_words: int = LEAST_WORDS):
        h, _, _, ptr = words([t for _, t in items])
        self.ids = [i for i, _ in items]
        self.words = [h[a:b] for a, b in zip(ptr[:-1], ptr[1:])]
        sizes = {n for n in map(len, self.words) if least_words <= n < max(map(len, masks))}
        own = {n: short_masks(n) for n in sorted(sizes)}
        self.masks = list(dict.fromkeys([*masks, *(m for some in own.values() for m in some)]))
        hashes, item, at = [], [], []
        for k, w in enumerate(self.words):
            for mask in [*masks, *own.get(len(w), ())] if len(w) >= least_words else ():
                s = masked(w, mask)
                hashes.append(s)
                item.append(np.full(len(s), k))
                at.append(np.arange(len(s)))
        cat = lambda x, d: np.concatenate(x).astype(d) if x else np.zeros(0, d)
        hs = cat(hashes, np.uint64)
        order = np.argsort(hs, kind="stable")
        self.hash, self.item, self.at = hs[order], cat(item, np.int64)[order], cat(at, np.int64)[order]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.hash >> np.uint64(64 - _BITS)] = True
        self.whole: dict[bytes, list[int]] = {}
        for k, w in enumerate(self.words):
            if 0 < len(w) < least_words:
                self.whole.setdefault(w.tobytes(), []).append(k)
        self.most_whole = max((len(x) // 8 for x in self.whole), default=0)

    def hits(self, h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Rows of (document, item, first word of the item on all documents' words), each once, for all seed hits.

        Document i has the words ptr[i] to ptr[i + 1]; windows that cross a border don't count.
        """
        found = [np.zeros((0, 3), np.int64)]
        for mask in self.masks:
            s = masked(h, mask)
            pos = np.flatnonzero(self.bits[s >> np.uint64(64 - _BITS)])
            lo, hi = np.searchsorted(self.hash, s[pos], "left"), np.searchsorted(self.hash, s[pos], "right")
            doc = np.searchsorted(ptr, pos, "right") - 1
            some = (hi > lo) & (pos + len(mask) <= ptr[doc + 1])
            pos, lo, n, doc = pos[some], lo[some], (hi - lo)[some], doc[some]
            k = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            found.append(np.stack((np.repeat(doc, n), self.item[k], np.repeat(pos, n) - self.at[k]), axis=1))
        return np.unique(np.concatenate(found), axis=0)


def best_run(a: np.ndarray, b: np.ndarray, penalty: int = PENALTY) -> tuple[int, int, int]:
    """(start, end, equal words) of the run of highest score where a and b are laid over each other."""
    eq = a == b
    total = np.concatenate(([0], np.cumsum(np.where(eq, 1, -penalty))))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmax(total[: end + 1] == low[end]))
    return start, end, int(eq[start:end].sum())


def verify(w: np.ndarray, h: np.ndarray, begin: int, end: int, shift: int, least_match: int = LEAST_MATCH, least_share: float = LEAST_SHARE, penalty: int = PENALTY) -> tuple[int, int, int] | None:
    """(start, end, equal words) of the overlap of the item w, laid over the words h[begin:end] from ``shift`` on."""
    least = need(len(w), least_match, least_share)
    a, b = max(0, begin - shift), min(len(w), end - shift)
    if b - a < least:
        return None
    s, e, n = best_run(w[a:b], h[a + shift : b + shift], penalty)
    if n < least:
        same = np.flatnonzero(w[a:b] == h[a + shift : b + shift])
        if len(same) >= max(least, least_share * len(w)):
            s, e, n = int(same[0]), int(same[-1]) + 1, len(same)
    return (s + a + shift, e + a + shift, n) if n >= least else None


def scan(texts: list[str | None], index: Index, least_match: int = LEAST_MATCH, least_share: float = LEAST_SHARE, penalty: int = PENALTY) -> list[tuple[int, int, int, int, int, int]]:
    """(text number, item number, first character, end character, equal words, words) for each item that a text overlaps."""
    out = []
    texts = [t or "" for t in texts]
    for first, last in groups(texts):
        h, starts, ends, ptr = words(texts[first:last])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for doc, k, shift in index.hits(h, ptr).tolist():
            if got := verify(index.words[k], h, ptr[doc], ptr[doc + 1], shift, least_match, least_share, penalty):
                found = (-got[2], *got[:2])
                best[doc, k] = min(best.get((doc, k), found), found)
        for doc in np.flatnonzero((np.diff(ptr) > 0) & (np.diff(ptr) <= index.most_whole)).tolist():
            for k in index.whole.get(h[ptr[doc] : ptr[doc + 1]].tobytes(), ()):
                best[doc, k] = (int(ptr[doc] - ptr[doc + 1]), int(ptr[doc]), int(ptr[doc + 1]))
        out += [(first + doc, k, int(starts[s]), int(ends[e - 1]), -n, int(e - s)) for (doc, k), (n, s, e) in sorted(best.items())]
    return out


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.selectExpr("cast(item_id as long) item_id", "text").where("text is not null")


def _one_slice(items: DataFrame, slice_chars: int) -> bool:
    return (items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0) <= slice_chars


def _index(items: DataFrame, masks) -> Index:
    """Of a benchmark that fits one slice."""
    return Index([(r[0], r[1]) for r in items.orderBy("item_id", "text").collect()], masks)


NAMES = ["doc_id", "item_id", "start_char", "end_char", "n_match", "n_words"]


def find(docs: DataFrame, benchmark: DataFrame, masks=MASKS, slice_chars: int = SLICE_CHARS, filter_bits: int = FILTER_BITS, **limits) -> DataFrame:
    """(doc_id, item_id, start_char, end_char, n_match, n_words) for each item that a document overlaps."""
    base, items = docs.selectExpr("cast(doc_id as long) doc_id", "text"), _items(benchmark)
    if not _one_slice(items, slice_chars):
        with Workspace(docs.sparkSession) as ws:
            return _joined(ws, base, items, masks, filter_bits, **limits).select(*NAMES)
    sent = docs.sparkSession.sparkContext.broadcast(_index(items, masks))

    def run(batches: Batches) -> Batches:
        index = sent.value
        for b in batches:
            rows = scan(b.column(1).to_pylist(), index, **limits)
            ids = b.column(0).to_pylist()
            cols = [[ids[r[0]] for r in rows], [index.ids[r[1]] for r in rows], *([r[k] for r in rows] for k in range(2, 6))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], NAMES)

    return base.mapInArrow(tidy(run), SCHEMA)


def without(docs: DataFrame, benchmark: DataFrame, masks=MASKS, slice_chars: int = SLICE_CHARS, filter_bits: int = FILTER_BITS, **limits) -> DataFrame:
    """The documents that overlap no item, with all their columns; a narrow pass if the benchmark fits one slice."""
    items, at = _items(benchmark), docs.columns.index("text")
    if not _one_slice(items, slice_chars):
        with Workspace(docs.sparkSession) as ws:
            # the same text overlaps the same items, so texts are joined by their hash and compared
            texts = docs.select(F.col("text")).where("text is not null").select(F.xxhash64("text").alias("doc_id"), "text")
            bad = ws.write(_joined(ws, texts, items, masks, filter_bits, **limits).select(F.col("doc_id").alias("h"), F.md5("text").alias("m")).distinct(), "bad", keep=True)
        whole = pack(docs)
        return unpack(whole.join(if_small(bad), F.expr(f"xxhash64(row.c{at}) = h and md5(row.c{at}) = m"), "left_anti"), docs.columns)
    sent = docs.sparkSession.sparkContext.broadcast(_index(items, masks))

    def run(batches: Batches) -> Batches:
        for b in batches:
            bad = {r[0] for r in scan(b.column(at).to_pylist(), sent.value, **limits)}
            yield b.filter(pa.array([k not in bad for k in range(b.num_rows)], pa.bool_()))

    return filtered(docs, run)


def _bit(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _joined(ws: Workspace, base: DataFrame, items: DataFrame, masks, filter_bits: int, least_words: int = LEAST_WORDS, **limits) -> DataFrame:
    """The rows of ``find`` and the text, for a benchmark of any size."""
    longest = max(map(len, masks))

    def item_seeds(batches: Batches) -> Batches:
        """(hash, item, place) of all seeds; a short item's whole words are a seed of place -1."""
        for b in batches:
            hs, row, at = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words([t])[0]
                if 0 < len(w) < least_words:
                    hs.append(ngrams(w, len(w), salt=71)[:1])
                    row.append(k)
                    at.append(np.full(1, -1))
                    continue
                for mask in [*masks, *(short_masks(len(w)) if least_words <= len(w) < longest else ())] if len(w) else ():
                    s = masked(w, mask)
                    hs.append(s)
                    row += [k]
                    at.append(np.arange(len(s)))
            n = [len(x) for x in hs]
            cat = lambda x, d: np.concatenate(x).astype(d) if x else np.zeros(0, d)
            yield pa.RecordBatch.from_arrays([pa.array(cat(hs, np.uint64).view(np.int64)), pa.array(np.repeat(np.array(row, np.int64), n)), pa.array(cat(at, np.int32))], ["h", "item", "place"])

    items = ws.write(items.withColumn("item", F.monotonically_increasing_id()).select("item", "item_id", "text"), "items", keep=True)
    seeds = ws.write(items.select("item", "text").mapInArrow(tidy(item_seeds), "h long, item long, place int").distinct(), "item-seeds", keep=True)
    # one bit a hash prefix, set in parallel and or-ed: the table has a fixed size
    size = (1 << filter_bits) // 8

    def bits(batches: Batches) -> Batches:
        mine = np.zeros(1 << filter_bits, bool)
        for b in batches:
            mine[_bit(b.column(0).to_numpy().view(np.uint64), filter_bits)] = True
        packed = np.packbits(mine)
        for k in range(0, size, 1 << 16):
            if packed[k : k + (1 << 16)].any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([packed[k : k + (1 << 16)].tobytes()], pa.binary())], ["k", "part"])

    def merged(batches: Batches) -> Batches:
        for t in sorted_groups(batches, ["k"]):
            parts = [np.frombuffer(x, np.uint8) for x in t.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column("k").combine_chunks()[:1], pa.array([np.bitwise_or.reduce(parts).tobytes()], pa.binary())], ["k", "part"])

    some = seeds.select("h").mapInArrow(tidy(bits), "k long, part binary").repartition("k").sortWithinPartitions("k").mapInArrow(tidy(merged), "k long, part binary")
    filled = np.zeros(size, np.uint8)
    for r in some.toLocalIterator():
        filled[r.k : r.k + len(r.part)] = np.frombuffer(bytes(r.part), np.uint8)
    sent = base.sparkSession.sparkContext.broadcast(filled)
    every = list(dict.fromkeys([*masks, *(m for n in range(least_words, longest) for m in short_masks(n))]))

    def doc_seeds(batches: Batches) -> Batches:
        """(hash, row, place) of the windows whose bit is set."""
        table = sent.value
        for b in batches:
            texts, rows = b.column(1).to_pylist(), b.column(0).to_numpy()
            for lo, hi in groups(texts):
                h, _, _, ptr = words(texts[lo:hi])
                hs, row, at = [], [], []
                for mask in every:
                    s = masked(h, mask)
                    at_bit = _bit(s, filter_bits)
                    pos = np.flatnonzero(table[at_bit >> 3] >> (7 - (at_bit & 7)).astype(np.uint8) & 1)
                    doc = np.searchsorted(ptr, pos, "right") - 1
                    ok = pos + len(mask) <= ptr[doc + 1]
                    hs.append(s[pos[ok]])
                    row.append(rows[lo + doc[ok]])
                    at.append((pos - ptr[doc])[ok])
                for doc in np.flatnonzero((np.diff(ptr) > 0) & (np.diff(ptr) < least_words)).tolist():
                    w = h[ptr[doc] : ptr[doc + 1]]
                    hs.append(ngrams(w, len(w), salt=71)[:1])
                    row.append(rows[lo + doc : lo + doc + 1])
                    at.append(np.full(1, -1))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(row).astype(np.int64)), pa.array(np.concatenate(at).astype(np.int32))], ["h", "row", "pos"])

    # rows are numbered in a written table, for numbers must not change if a task is run again
    rows = ws.write(base.where("text is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows", keep=True)
    hits = rows.select("row", "text").mapInArrow(tidy(doc_seeds), "h long, row long, pos int").join(seeds, "h").where("(pos < 0) = (place < 0)").select("row", "item", F.when(F.col("pos") >= 0, F.col("pos") - F.col("place")).alias("shift")).distinct()
    pairs = hits.groupBy("row", "item").agg(F.collect_set("shift").alias("shifts"))  # of one item in one document
    laid = pairs.join(items.withColumnRenamed("text", "words"), "item").join(rows, "row")

    def check(batches: Batches) -> Batches:
        for b in batches:
            out, last = [], None
            for d, i, t, w, shifts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "item_id", "text", "words", "shifts"))):
                if t != last:
                    last, (h, starts, ends, _) = t, words([t])
                w = words([w])[0]
                got = [(-g[2], *g[:2]) for x in shifts if (g := verify(w, h, 0, len(h), x, **limits))] if shifts else [(-len(h), 0, len(h))] if np.array_equal(h, w) else []
                if got:
                    n, s, e = min(got)
                    out.append((d, i, int(starts[s]), int(ends[e - 1]), -n, e - s, t))
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [*[pa.int64()] * 6, pa.string()])], [*NAMES, "text"])

    return laid.select("doc_id", "item_id", "text", "words", "shifts").mapInArrow(tidy(check), SCHEMA + ", text string")
