"""Language-model scores from a weighted backoff automaton over word n-grams of the whole corpus.

Counts cover all documents. An n-gram of two words or more that occurs ``least_count`` times makes an arc with an
absolute-discounted, interpolated probability; what the discounts and the rarer n-grams leave is the weight of the
failure arc to the context without its first word. Single words are smoothed additively and always have an arc, so a
traversal never ends. The state before a word is the longest kept n-gram that ends there, so the n-gram that ends at the
word tells which failure arcs and which arc are taken; their weights are added up once for each distinct n-gram.

The model grows with the corpus and is never in one place. Documents meet in blocks. A block counts its own distinct
words and pairs and sends them, packed by the hash of their context, one row a partition; there counts of all blocks
are added, contexts are complete, and each block gets back the figures of its own n-grams. Longer n-grams follow order
by order: one can only be kept if what it is without its first or its last word is, so a block sends no others, and how
often a context is followed by anything is its count less the times it ends a text. From the figures a block builds the
part of the automaton that its documents can reach, and reads all documents side by side. What is exchanged
is the documents once, compressed, and the blocks' distinct n-grams as far as they may be kept, there and back.

Defined cases: a null text has null figures; a text without words has no words, log_prob 0 and a null mean; words are
those of ``_text.words`` and n-grams don't cross documents; the first word is read from the state without context;
repeated rows count and are scored each; a very long text is read like others; an empty table gives no rows; other
columns, whatever their names, are ignored, and doc_id may be null.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.llm._spark import release, tidy
from fleetweave.llm._text import groups, mix, words

ORDER, LEAST_COUNT, DISCOUNT, ADDED = 3, 2, 0.75, 0.5
#: characters of a block at least and at most; between them a corpus has BLOCKS blocks, for rows grow with their square
BLOCK_CHARS, MOST_BLOCK_CHARS, BLOCKS = 16_000_000, 256_000_000, 2000
_MULT = np.uint64(0xC2B2AE3D27D4EB4F)

SCHEMA = "doc_id long, n_words long, log_prob double, mean_log_prob double"


class Grams:
    """The distinct n-grams of a block of texts, as sorted keys: number of the context times words, plus the word's number."""

    def __init__(self, texts: list[str], order: int):
        hashes, ptr = [], [np.zeros(1, np.int64)]
        for a, b in groups(texts):
            h, _, _, p = words(texts[a:b])
            hashes.append(h)
            ptr.append(p[1:] + ptr[-1][-1])
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        del hashes
        self.ptr = np.concatenate(ptr)
        size = len(h)
        codes, seen = pd.factorize(h)
        del h
        rank = np.argsort(seen)
        self.words = seen[rank]
        # numbers of words and n-grams of a block take 32 bits, only keys need more
        place = np.empty(len(rank), np.int32)
        place[rank] = np.arange(len(rank))
        self.seq = place[codes]
        del codes, seen, rank, place
        n_words = max(1, len(self.words))
        self.keys: list[np.ndarray] = [np.arange(len(self.words))]
        self.counts = [np.bincount(self.seq, minlength=len(self.words))]
        #: by order, as far as they are contexts of n-grams
        self.hash = [self.words]
        #: for each n-gram, the number of that without its first word
        self.suffix: list[np.ndarray] = [np.zeros(len(self.words), np.int64)]
        #: how often each n-gram ends a text
        self.ends: list[np.ndarray] = [np.zeros(len(self.words), np.int64)]
        number = self.seq  # n-gram numbers by first word
        #: numbers of the shorter n-grams that begin a text, where it has so many words, and of all longest ones in order
        self.first: list[np.ndarray] = []
        self.last = self.seq
        left = (np.repeat(self.ptr[1:], np.diff(self.ptr)) - np.arange(size)).astype(np.int32)  # words from here to the end of the text
        for n in range(2, order + 1):
            self.first.append(number[self.ptr[:-1][np.diff(self.ptr) >= n - 1]])
            alive = np.flatnonzero(left >= n).astype(np.int32)
            key = number[alive].astype(np.int64) * n_words + self.seq[alive + n - 1]
            by = np.argsort(key)
            ordered = key[by]
            first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(by) else np.zeros(0, np.int64)
            keys, count = ordered[first], np.diff(np.append(first, len(ordered)))
            del key, ordered
            mine = np.empty(len(by), np.int32)
            mine[by] = np.repeat(np.arange(len(first)), count)
            self.keys.append(keys)
            self.counts.append(count.astype(np.int32))
            if n < order:
                with np.errstate(over="ignore"):
                    self.hash.append(mix(self.hash[-1][keys // n_words] * _MULT + self.words[keys % n_words]))
            self.suffix.append((keys % n_words).astype(np.int32) if n == 2 else number[alive[by[first]] + 1])
            del by, first
            self.ends.append(np.bincount(mine[left[alive] == n], minlength=len(keys)).astype(np.int32))
            if n < order:
                number = np.full(size, -1, np.int32)
                number[alive] = mine
            else:
                self.last = mine

    def contexts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the contexts of the n-grams, and how many n-grams each has, in the order of the keys."""
        c = self.keys[n - 1] // max(1, len(self.words))
        first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))) if len(c) else np.zeros(0, np.int64)
        return c[first], np.diff(np.append(first, len(c)))

    def last_words(self, n: int) -> np.ndarray:
        """Five bytes of the hash of each n-gram's last word: enough to tell words behind one context apart."""
        return self.words.view(np.uint8).reshape(-1, 8)[:, 3:][self.keys[n - 1] % max(1, len(self.words))]

    def layout(self, n: int, parts: int, some: np.ndarray | None = None, heads: np.ndarray | None = None) -> tuple:
        """What of order n goes where: (rows by part, their bounds, contexts, runs, contexts by part, their bounds).

        ``some`` marks the n-grams that go, ``heads`` the contexts; without them all do.
        """
        c, runs = self.contexts(n)
        own = self.keys[n - 1] // max(1, len(self.words))
        rows = np.arange(len(own)) if some is None else np.flatnonzero(some)
        if heads is not None:
            runs = np.bincount(np.searchsorted(c, own[rows]), minlength=len(c))[heads[c]] if len(c) else runs
            c = c[heads[c]]
        at, bounds = _by_part(self.hash[n - 2][c], parts)
        by, row_bounds = _by_part(self.hash[n - 2][own[rows]], parts)
        return rows[by], row_bounds, c, runs, at, bounds


def _by_part(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    part = ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
    at = np.argsort(part, kind="stable")
    return at, np.searchsorted(part[at], np.arange(parts + 1))


def _small(x: np.ndarray) -> bytes:
    """Counts, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<i8").tobytes())


def _large(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64)


def _pack(n: int, ids: np.ndarray):
    """(block, documents): the documents of a batch by block, compressed."""

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=12))
        for b in batches:
            at = np.array([xxhash.xxh3_64_intdigest(f"{d}|{t}".encode("utf-8", "surrogatepass")) % n for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], np.int64)
            order = np.argsort(at, kind="stable")
            blocks, first = np.unique(at[order], return_index=True)
            out = []
            for rows in np.split(order, first[1:]) if len(order) else ():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=options) as w:
                    w.write_batch(b.take(pa.array(rows)))
                out.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids[blocks], pa.int32()), pa.array(out, pa.binary())], ["block", "docs"])

    return run


def _docs(rows: pa.Table) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(x.as_py()).read_all() for x in rows.column("docs"))


def _texts(rows: pa.Table) -> list[str]:
    return _docs(rows).column("text").to_pylist()


def _gram_data(g: Grams, n: int, lay: tuple) -> list[list[bytes]]:
    """What goes to each part; every array is put in the order of the parts once."""
    at, b, c, runs, cat, cb = lay
    heads, runs = g.hash[n - 2][c[cat]], runs[cat]
    last, counts, ends = g.last_words(n)[at], g.counts[n - 1][at], g.ends[n - 1][at]
    bounds = zip(b[:-1], b[1:], cb[:-1], cb[1:])
    return [[heads[x:y].tobytes(), _small(runs[x:y]), last[i:j].tobytes(), _small(counts[i:j]), _small(ends[i:j])] for i, j, x, y in bounds]


def _sent(docs: pa.Table, rows: list, ids: np.ndarray) -> pa.Table:
    """A row for each part, even if nothing goes there: the answer brings that part's totals."""
    block = docs.column("block")[0].as_py()
    return pa.table({"part": pa.array(ids, pa.int32()), "block": pa.array([block] * len(ids), pa.int32()), "data": pa.array(rows, pa.list_(pa.binary()))})


def _count(order: int, ids: np.ndarray):
    """Words and pairs."""

    def run(docs: pa.Table) -> pa.Table:
        g = Grams(_texts(docs), min(2, order))
        at, b = _by_part(g.words, len(ids))
        rows = [[g.words[at[b[p] : b[p + 1]]].tobytes(), _small(g.counts[0][at[b[p] : b[p + 1]]])] for p in range(len(ids))]
        if order > 1:
            for r, more in zip(rows, _gram_data(g, 2, g.layout(2, len(ids)))):
                r += more
        del g
        release()
        return _sent(docs, rows, ids)

    return run


def _candidates(g: Grams, n: int, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams that may be kept, (n - 1)-grams that are): both parts of an n-gram must be."""
    heads = kept > 0
    return heads[g.keys[n - 1] // max(1, len(g.words))] & heads[g.suffix[n - 1]], heads


def _count_next(n: int, ids: np.ndarray):
    """The n-grams that may be kept, once those of n - 1 words are known."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        g = Grams(_texts(docs), n)
        found, *_ = figures_of(g, n - 1, len(ids), _by_stage(answers, ids))
        lay = g.layout(n, len(ids), *_candidates(g, n, found[n - 2][0]))
        rows = _gram_data(g, n, lay)
        del g, found, lay
        release()
        return _sent(docs, rows, ids)

    return run


def _join(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The arrays one after the other, and the bounds."""
    return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))


def _added(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.bincount(codes, weights=counts, minlength=int(codes.max()) + 1 if len(codes) else 0).astype(np.int64)


def _grams_answer(data: list, k: int, least_count: int, out: list[list[bytes]]) -> None:
    """Adds to each block's row: kept counts (0 for others), their ends, and (count, kept count, kept n-grams) of its contexts."""
    ctx, ctx_at = _join([np.frombuffer(r[k], np.uint64) for r in data])
    runs = np.concatenate([_large(r[k + 1]) for r in data])
    words_, g_at = _join([np.frombuffer(r[k + 2], np.uint8).reshape(-1, 5) for r in data])
    counts, ends = (np.concatenate([_large(r[j]) for r in data]) for j in (k + 3, k + 4))
    last = np.zeros((len(words_), 8), np.uint8)
    last[:, :5] = words_
    with np.errstate(over="ignore"):
        codes, seen = pd.factorize(mix(np.repeat(ctx, runs) * _MULT + last.reshape(-1).view(np.uint64)))
    total = _added(codes, counts)
    ctx_codes, ctx_seen = pd.factorize(ctx)
    owner = np.zeros(len(seen), np.int64)
    owner[codes] = np.repeat(ctx_codes, runs)
    kept = np.where(total >= least_count, total, 0)
    sums = np.zeros((len(ctx_seen), 3), np.int64)
    for j, v in enumerate((total, kept, (kept > 0).astype(np.int64))):
        np.add.at(sums[:, j], owner, v)
    mine, last_, own = kept[codes], np.where(kept > 0, _added(codes, ends), 0)[codes], sums[ctx_codes]
    for o, a, b, c, d in zip(out, g_at[:-1], g_at[1:], ctx_at[:-1], ctx_at[1:]):
        o += [_small(mine[a:b]), _small(last_[a:b]), _small(own[c:d].reshape(-1))]


def _answer(order: int, least_count: int, stage: int):
    def run(rows: pa.Table) -> pa.Table:
        data = rows.column("data").to_pylist()
        out: list[list[bytes]] = [[] for _ in data]
        if stage == 2:
            h, at = _join([np.frombuffer(r[0], np.uint64) for r in data])
            codes, _ = pd.factorize(h)
            total = _added(codes, np.concatenate([_large(r[1]) for r in data]))
            whole = np.array([total.sum(), len(total)], np.int64).tobytes()
            mine = total[codes]
            out = [[whole, _small(mine[a:b])] for a, b in zip(at[:-1], at[1:])]
        if order > 1:
            _grams_answer(data, 2 if stage == 2 else 0, least_count, out)
        del data
        release()
        return pa.table({"block": rows.column("block"), "part": rows.column("part"), "stage": pa.array([stage] * len(out), pa.int32()), "data": pa.array(out, pa.list_(pa.binary()))})

    return run


def weights(g: Grams, figures: list[tuple[np.ndarray, ...]], n_tokens: int, n_distinct: int, discount: float = DISCOUNT, added: float = ADDED) -> list[np.ndarray]:
    """By order, the log-probability of each n-gram's last word behind the others: the arc's, or that of the failure arcs and the arc they lead to.

    figures: (counts,) for words, then (kept counts, contexts, their sums) by order.
    """
    n_words = max(1, len(g.words))
    prob = (figures[0][0] + added) / (n_tokens + added * (n_distinct + 1)) if len(g.words) else np.zeros(0)
    out = [np.log(prob)]
    for n in range(2, len(g.keys) + 1):
        kept, ctx, sums = figures[n - 1]
        c = g.keys[n - 1] // n_words
        # behind what isn't kept no arcs begin: its failure arc has weight 1
        total, mass = np.ones(len(g.keys[n - 2])), np.ones(len(g.keys[n - 2]))
        total[ctx] = sums[:, 0]
        mass[ctx] = 1 - (sums[:, 1] - discount * sums[:, 2]) / sums[:, 0]
        prob = np.where(kept > 0, (kept - discount) / total[c], 0.0) + mass[c] * prob[g.suffix[n - 1]]
        out.append(np.log(prob))
    return out


def read(g: Grams, logs: list[np.ndarray]) -> np.ndarray:
    """The log-probability of each text: the first words behind all before them, the others behind ``order - 1``.

    The n-gram that ends at a word names the state before it and its arc, so no arc is searched for.
    """
    size, order = np.diff(g.ptr), len(g.keys)
    owner = np.repeat(np.arange(len(size)), np.maximum(0, size - order + 1))
    total = np.bincount(owner, weights=logs[-1][g.last], minlength=len(size)) if len(owner) else np.zeros(len(size))
    for n in range(1, order):
        some = size >= n
        total[some] += logs[n - 1][g.first[n - 1]]
    return total


def _by_stage(answers: pa.Table, ids: np.ndarray) -> dict[int, list[list[bytes]]]:
    """The data of each stage, in the order of the parts."""
    place = {int(x): k for k, x in enumerate(ids)}
    out: dict[int, list] = {}
    for part, stage, data in zip(*(answers.column(c).to_pylist() for c in ("part", "stage", "data"))):
        out.setdefault(stage, [None] * len(ids))[place[part]] = data
    return out


def figures_of(g: Grams, order: int, parts: int, stages: dict[int, list[list[bytes]]]) -> tuple[list[tuple[np.ndarray, ...]], int, int]:
    """The answers of all parts, put in the block's own order, and the corpus totals.

    The first figures are (counts,) of words; then come (kept counts, contexts, their sums, ends) by order.
    """
    rows = stages[2]
    totals = np.sum([np.frombuffer(r[0], np.int64) for r in rows], axis=0)
    counts = np.empty(len(g.words), np.int64)
    counts[_by_part(g.words, parts)[0]] = np.concatenate([_large(r[1]) for r in rows])
    out: list[tuple[np.ndarray, ...]] = [(counts,)]
    for n in range(2, order + 1):
        rows, k = stages[n], 2 if n == 2 else 0
        lay = g.layout(n, parts) if n == 2 else g.layout(n, parts, *_candidates(g, n, out[n - 2][0]))
        at, _, c, _, cat, _ = lay
        kept, ends = np.zeros(len(g.keys[n - 1]), np.int64), np.zeros(len(g.keys[n - 1]), np.int64)
        kept[at] = np.concatenate([_large(r[k]) for r in rows])
        ends[at] = np.concatenate([_large(r[k + 1]) for r in rows])
        sums = np.empty((len(c), 3), np.int64)
        sums[cat] = np.concatenate([_large(r[k + 2]) for r in rows]).reshape(-1, 3)
        if n > 2:
            sums[:, 0] = out[n - 2][0][c] - out[n - 2][3][c]
        out.append((kept, c, sums, ends))
    return out, int(totals[0]), int(totals[1])


def _score(order: int, ids: np.ndarray, discount: float, added: float):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _docs(docs)
        g, doc_id = Grams(docs.column("text").to_pylist(), order), docs.column("doc_id").combine_chunks()
        del docs
        del g.seq
        release()
        found, n_tokens, n_distinct = figures_of(g, order, len(ids), _by_stage(answers, ids))
        found = [f[:3] for f in found]
        log, n = read(g, weights(g, found, n_tokens, n_distinct, discount, added)), np.diff(g.ptr)
        del g, found
        release()
        mean = np.divide(log, n, out=np.zeros(len(n)), where=n > 0)
        return pa.table({"doc_id": doc_id, "n_words": pa.array(n, pa.int64()), "log_prob": pa.array(log), "mean_log_prob": pa.array(mean, mask=n == 0)})

    return run


def n_blocks(chars: int, least: int = BLOCK_CHARS, most: int = MOST_BLOCK_CHARS, blocks: int = BLOCKS) -> int:
    return max(1, math.ceil(chars / min(most, max(least, chars / blocks))))


def spread_ids(docs: DataFrame, n: int) -> np.ndarray:
    """n numbers whose hashes fall into n partitions, one in each, so that every task of an exchange gets one block."""
    most = n * (math.ceil(math.log(n + 1)) + 12)
    while True:
        some = docs.sparkSession.range(most).selectExpr("cast(id as int) id").groupBy(F.expr(f"pmod(hash(id), {n})").alias("p")).agg(F.min("id").alias("id")).orderBy("p").collect()
        if len(some) == n:
            return np.array([r.id for r in some], np.int64)
        most *= 2


def score(docs: DataFrame, order: int = ORDER, least_count: int = LEAST_COUNT, discount: float = DISCOUNT, added: float = ADDED, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob) of each document under the model of all documents; natural logarithms."""
    if order < 1 or least_count < 2 or not 0 <= discount < 1:
        raise ValueError("the order is 1 at least, least_count 2 at least and the discount below 1")
    base = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    chars = base.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = n_blocks(chars, block_chars)
    ids = spread_ids(docs, n)
    some = base.where("text is not null").mapInArrow(tidy(_pack(n, ids)), "block int, docs binary").repartition(n, "block")
    kinds = "block int, part int, stage int, data array<binary>"

    def answered(sent: DataFrame, stage: int) -> DataFrame:
        return sent.repartition(n, "part").groupBy("part").applyInArrow(_answer(order, least_count, stage), kinds).repartition(n, "block")

    answers = answered(some.groupBy("block").applyInArrow(_count(order, ids), "part int, block int, data array<binary>"), 2)
    for k in range(3, order + 1):
        more = some.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_count_next(k, ids), "part int, block int, data array<binary>")
        answers = answers.unionByName(answered(more, k)).repartition(n, "block")
    scored = some.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(order, ids, discount, added), SCHEMA)
    empty = base.where("text is null").selectExpr("doc_id", "cast(null as long) n_words", "cast(null as double) log_prob", "cast(null as double) mean_log_prob")
    return scored.unionByName(empty).select("doc_id", "n_words", F.round("log_prob", 6).alias("log_prob"), F.round("mean_log_prob", 6).alias("mean_log_prob"))


def sql(table: str = "documents") -> str:
    """The trigram automaton in DuckDB: the probability that a walk adds up at each word."""
    if ORDER != 3:
        raise ValueError("the SQL is that of order 3")
    d, a = f"{DISCOUNT}::DOUBLE", f"{ADDED}::DOUBLE"
    mass = f"1 - (sum(CASE WHEN c >= {LEAST_COUNT} THEN c ELSE 0 END) - {d} * count(*) FILTER (c >= {LEAST_COUNT})) / sum(c) AS mass"
    return rf"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, text FROM {table}),
split AS MATERIALIZED (SELECT r, doc_id, text IS NULL AS gone, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS p FROM rows_),
tok AS MATERIALIZED (SELECT r, unnest(p) AS w0, generate_subscripts(p, 1) AS pos FROM split),
seq AS MATERIALIZED (SELECT r, pos, lower(w0) AS w, lag(lower(w0)) OVER (PARTITION BY r ORDER BY pos) AS h, lag(lower(w0), 2) OVER (PARTITION BY r ORDER BY pos) AS g FROM tok),
uni AS (SELECT w, count(*) AS c FROM seq GROUP BY 1),
size_ AS (SELECT sum(c) AS n, count(*) AS v FROM uni),
bi AS MATERIALIZED (SELECT h, w, count(*) AS c FROM seq WHERE h IS NOT NULL GROUP BY 1, 2),
tri AS MATERIALIZED (SELECT g, h, w, count(*) AS c FROM seq WHERE g IS NOT NULL GROUP BY 1, 2, 3),
ctx AS (SELECT h, sum(c) AS t, {mass} FROM bi GROUP BY 1),
ctx2 AS (SELECT g, h, sum(c) AS t, {mass} FROM tri JOIN (SELECT h AS g, w AS h FROM bi WHERE c >= {LEAST_COUNT}) USING (g, h) GROUP BY 1, 2),
low AS MATERIALIZED (SELECT r, s.g, s.h, s.w, CASE WHEN s.h IS NULL THEN (u.c + {a}) / (n + {a} * (v + 1)) ELSE (CASE WHEN b.c >= {LEAST_COUNT} THEN (b.c - {d}) / t ELSE 0 END) + mass * (u.c + {a}) / (n + {a} * (v + 1)) END AS p
  FROM seq s JOIN uni u USING (w) CROSS JOIN size_ LEFT JOIN bi b ON s.h = b.h AND s.w = b.w LEFT JOIN ctx x ON s.h = x.h),
each_ AS (SELECT r, ln(CASE WHEN y.t IS NULL THEN p ELSE (CASE WHEN k.c >= {LEAST_COUNT} THEN (k.c - {d}) / y.t ELSE 0 END) + y.mass * p END) AS lp
  FROM low s LEFT JOIN ctx2 y ON s.g = y.g AND s.h = y.h LEFT JOIN tri k ON s.g = k.g AND s.h = k.h AND s.w = k.w),
total AS (SELECT r, count(*) AS n_words, sum(lp) AS lp FROM each_ GROUP BY 1)
SELECT doc_id, CASE WHEN NOT gone THEN coalesce(n_words, 0) END AS n_words, CASE WHEN NOT gone THEN round(coalesce(lp, 0), 6) END AS log_prob, round(lp / n_words, 6) AS mean_log_prob
FROM split LEFT JOIN total USING (r)
"""
