"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are words and runs of other visible characters; features are the distinct hashed unigrams and bigrams of a
text, each 1, so a score is a sparse dot product. Two models share the features: quality (1 is good) and toxicity (1
is toxic). A document is kept if its quality is at least ``least_quality`` and its toxicity below ``most_toxic``.

Training uses the labelled rows; at most ``train_rows`` of them, those with the smallest hash of doc_id, which is a
uniform sample, the same in every run. FTRL takes one row after the other, so it runs in one task, over features that
were hashed in parallel; the L1 term keeps the models sparse. Scoring is one narrow pass over all documents with the
two weight vectors (of 2 ** bits floats each, a fixed size) broadcast.

Defined cases: a null text has null scores and isn't kept; an empty text is scored by the bias alone; labels of null
are not trained on, nor are labels whose doc_id is null or unknown; several labels of a doc_id all count; without any
labelled row quality is 0.5, toxicity 0 and all are kept, and with one class only the model leans to that class; ties
of the sample's hash go by doc_id and labels; repeated documents are scored one by one; a very long text is scored as a
whole; an empty table gives no rows; other columns, whatever their names, are ignored by ``classify`` and kept by
``quality_filter``, and doc_id may be null.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetweave.llm._spark import Batches, filtered, tidy
from fleetweave.llm._text import groups, ngrams, words

BITS = 20
TRAIN_ROWS = 20_000
LEAST_QUALITY, MOST_TOXIC = 0.5, 0.3
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 3.0, 1.0, 2

_SYMBOLS = re.compile(r"[^\w\s]+")
_marks: dict[str, int] = {}

SCHEMA = "doc_id long, quality double, toxicity double, keep boolean"


def _mark(x: str) -> int:
    """The hash of a run of symbols; those of short runs are kept."""
    if (got := _marks.get(x)) is None:
        got = xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"), 41)
        if len(x) <= 16:
            if len(_marks) > 100_000:
                _marks.clear()
            _marks[x] = got
    return got


def features(texts: list[str], bits: int = BITS) -> list[np.ndarray]:
    """Sorted distinct feature numbers of each text, in [1, 2 ** bits); 0 is the bias and left out.

    Besides words, word pairs and runs of symbols, a word three times in a row is one feature, whatever the word.
    """
    out = []
    for a, b in groups(texts):
        some = texts[a:b]
        h, _, _, ptr = words(some)
        pair = ngrams(h, 2, salt=17)
        triple = np.flatnonzero((h[2:] == h[1:-1]) & (h[1:-1] == h[:-2])) if len(h) > 2 else np.zeros(0, np.int64)
        shift = np.uint64(64 - bits)
        one, two = (h >> shift).astype(np.int32), (pair >> shift).astype(np.int32)
        for k, t in enumerate(some):
            i, j = ptr[k], ptr[k + 1]
            m = [_mark(x) >> (64 - bits) for x in set(_SYMBOLS.findall(t))]
            if j - i > 2 and np.searchsorted(triple, i) < np.searchsorted(triple, j - 2):
                m.append(1)
            f = np.concatenate((one[i:j], two[i : max(i, j - 1)], np.array(m, np.int32)))
            f.sort()
            out.append(np.maximum(f[np.concatenate(([True], f[1:] != f[:-1]))], 1) if len(f) else f)
    return out


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of shape (models, 2 ** bits). Rows are (feature numbers, a target of 0, 1 or nan for each model)."""
    models = len(rows[0][1]) if rows else 2
    z, n = np.zeros((models, 1 << bits)), np.zeros((models, 1 << bits))
    bias = np.zeros(1, np.int32)

    def weights(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) <= l1, 0.0, (np.sign(zz) * l1 - zz) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for f, y in rows:
            x = np.concatenate((bias, f))
            zz, nn = z[:, x], n[:, x]
            w = weights(zz, nn)
            # a nan target leaves its model as it is
            g = np.nan_to_num(1 / (1 + np.exp(-np.clip(w.sum(1), -35, 35))) - y)[:, None]
            sigma = (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha
            z[:, x] = zz + g - sigma * w
            n[:, x] = nn + g * g
    return weights(z, n).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, bits: int = BITS) -> np.ndarray:
    """The two weight vectors, from at most ``train_rows`` labelled rows (the bound of the sample)."""
    chosen = labels.where("doc_id is not null and (quality is not null or toxic is not null)").selectExpr("cast(doc_id as long) doc_id", "cast(quality as double) quality", "cast(toxic as double) toxic", "xxhash64(cast(doc_id as long)) h")
    chosen = chosen.orderBy("h", "doc_id", "quality", "toxic").limit(train_rows)  # ids only, so a bounded table: broadcast
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")

    def hashed(batches: Batches) -> Batches:
        for b in batches:
            f = features(b.column("text").to_pylist(), bits)
            ptr = np.concatenate(([0], np.cumsum([len(x) for x in f]))).astype(np.int32)
            flat = np.concatenate(f) if f else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("doc_id"), b.column("quality"), b.column("toxic"), pa.ListArray.from_arrays(pa.array(ptr), pa.array(flat.astype(np.int32)))], ["h", "doc_id", "quality", "toxic", "f"])

    def learn(batches: Batches) -> Batches:
        got = []
        for b in batches:
            col = b.column("f")
            flat, ptr = col.values.to_numpy(), col.offsets.to_numpy()
            q, t = b.column("quality").to_numpy(zero_copy_only=False), b.column("toxic").to_numpy(zero_copy_only=False)
            got += [(flat[ptr[i] : ptr[i + 1]].copy(), np.array([q[i], t[i]], float)) for i in range(b.num_rows)]
        w = train_ftrl(got, bits)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary())], ["w"])

    flat = rows.select("h", "doc_id", "quality", "toxic", "text").mapInArrow(tidy(hashed), "h long, doc_id long, quality double, toxic double, f array<int>")
    got = flat.repartition(1).sortWithinPartitions("h", "doc_id", "quality", "toxic")
    learned = got.mapInArrow(tidy(learn), "w binary").first()
    if learned is None:  # no labelled row: nothing speaks against any text
        w = np.zeros((2, 1 << bits), np.float32)
        w[1, 0] = -35
        return w
    return np.frombuffer(bytes(learned[0]), "<f4").reshape(-1, 1 << bits)


def score(docs: DataFrame, weights: np.ndarray, least_quality: float = LEAST_QUALITY, most_toxic: float = MOST_TOXIC, bits: int = BITS) -> DataFrame:
    """(doc_id, quality, toxicity, keep) of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Batches) -> Batches:
        w = sent.value.astype(np.float64)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *judge(b.column(1).to_pylist(), w, least_quality, most_toxic, bits)], ["doc_id", "quality", "toxicity", "keep"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tidy(run), SCHEMA)


def judge(texts: list[str | None], w: np.ndarray, least_quality: float, most_toxic: float, bits: int) -> list[pa.Array]:
    f = features([t or "" for t in texts], bits)
    s = np.array([w[:, x].sum(1) + w[:, 0] for x in f]).reshape(-1, 2)
    p = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
    null = np.array([t is None for t in texts], bool)
    keep = (p[:, 0] >= least_quality) & (p[:, 1] < most_toxic) & ~null
    return [pa.array(p[:, 0], pa.float64(), mask=null), pa.array(p[:, 1], pa.float64(), mask=null), pa.array(keep)]


def quality_filter(docs: DataFrame, weights: np.ndarray, least_quality: float = LEAST_QUALITY, most_toxic: float = MOST_TOXIC, bits: int = BITS) -> DataFrame:
    """The documents that are kept, with all their columns: one narrow pass, no join."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def run(batches: Batches) -> Batches:
        w = sent.value.astype(np.float64)
        for b in batches:
            yield b.filter(judge(b.column(at).to_pylist(), w, least_quality, most_toxic, bits)[2])

    return filtered(docs, run)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
