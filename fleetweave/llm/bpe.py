"""Byte-level BPE over overlapping chunks.

A text is cut into chunks that overlap. Each chunk is split into pre-tokens by itself, in parallel. Where the splits
of two neighbours have a boundary in common, both agree from there on, since a pre-token depends on nothing to its
left; there the chunks are stitched. The pieces between stitches are encoded in parallel, and their ids joined in
order. Only boundaries after a non-space serve as stitches, for a run of white space is split by what follows it.
A document of which two neighbours share no such boundary (a single word longer than the overlap, for one) is encoded
in one piece. Decoding concatenates the bytes of the ids.

Defined cases: a null text has null ids; an empty one has no ids and decodes to an empty text; strings of special
tokens in a text are ordinary text; repeated rows each give a row (ids are joined by row, not by doc_id); an empty
table gives no rows; other columns are ignored and doc_id may be null.
"""

from __future__ import annotations

import base64
import bisect

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.llm._spark import Batches, Workspace, tidy

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK, OVERLAP = 65536, 2048
#: a run of white space beyond this is encoded apart, for the pattern's look-ahead walks back over it
LONG_SPACE = 4096

_kept: dict = {}


class Codec:
    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.inner = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        lens = np.zeros(size + 1, np.int64)
        for k, v in ranks.items():
            lens[v + 1] = len(k)
        self.at = np.cumsum(lens)
        by = sorted(ranks, key=ranks.__getitem__)
        self.bytes = np.frombuffer(b"".join(by), np.uint8)
        self.lens = lens[1:]

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG_SPACE or not (gaps := list(regex.finditer(r"\s{%d,}" % LONG_SPACE, text))):
            return self.inner.encode_ordinary(text)
        out, begin = [], 0
        for m in gaps:
            if m.start() > begin:
                out += self.inner.encode_ordinary(text[begin : m.start()])
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += self.inner._encode_single_piece(m[0][: end - m.start()])
            begin = end
        return out + (self.inner.encode_ordinary(text[begin:]) if begin < len(text) else [])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, one after the other."""
        n = self.lens[ids]
        if not len(n):
            return b""
        start = np.repeat(self.at[ids] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        return self.bytes[start + np.arange(len(start))].tobytes()


def codec(vocabulary: str = VOCABULARY) -> Codec:
    if vocabulary not in _kept:
        _kept[vocabulary] = Codec(vocabulary)
    return _kept[vocabulary]


def cuts(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks [start, end) of n characters; each but the last reaches ``overlap`` into the next."""
    return [(s, min(n, s + chunk + overlap)) for s in range(0, max(1, n), chunk)]


def boundaries(text: str, low: int, high: int) -> list[int]:
    """Ends of pre-tokens within [low, high) that follow a non-space."""
    return [e for m in regex.finditer(PATTERN, text) if low <= (e := m.end()) < high and not text[e - 1].isspace()]


def stitch(heads: list[list[int]], tails: list[list[int]]) -> list[int] | None:
    """One boundary for each pair of neighbours, the first that both have; None if a pair has none. The first chunk has no head."""
    found = []
    for tail, head in zip(tails[:-1], heads[1:]):
        common = set(tail)
        first = next((p for p in head if p in common), None)
        if first is None:
            return None
        found.append(first)
    return found


def _make_chunks(chunk: int, overlap: int):
    def run(batches: Batches) -> Batches:
        """Rows of one chunk each; single documents have chunks = 1. row tells repeated rows apart."""
        for b in batches:
            out = []
            for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t is None:
                    continue
                parts = cuts(len(t), chunk, overlap)
                out += [(row, k, len(parts), s, t[s:e]) for k, (s, e) in enumerate(parts)]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()))], ["row", "part", "parts", "start", "body"])

    return run


def _marks(chunk: int, overlap: int):
    def run(batches: Batches) -> Batches:
        """The boundaries of a chunk in its overlaps; those near its end may be the cut's doing and don't count."""
        for b in batches:
            out = []
            for row, part, parts, start, body in zip(*(b.column(k).to_pylist() for k in range(5))):
                trusted = len(body) - (16 if part + 1 < parts else 0)
                ends = boundaries(body, 1, trusted)
                last = bisect.bisect_left(ends, chunk)
                head = [start + e for e in ends[: bisect.bisect_right(ends, overlap)]] if part else []
                out.append((row, part, parts, head, [start + e for e in ends[last:]]))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["row", "part", "parts", "head", "tail"])

    return run


def _stitched(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("part")
    found = stitch(rows.column("head").to_pylist(), rows.column("tail").to_pylist())
    n = rows.num_rows
    begin = [0, *found] if found is not None else [None] * n
    end = [*found, None] if found is not None else [None] * n
    return pa.table({"row": rows.column("row"), "part": rows.column("part"), "begin": pa.array(begin, pa.int64()), "until": pa.array(end, pa.int64())})


def _encode(vocabulary: str):
    def run(batches: Batches) -> Batches:
        """The ids of each piece and whether they decode to its bytes."""
        c = codec(vocabulary)
        for b in batches:
            rows, parts, ids, size, right = b.column(0), b.column(1), [], [], []
            for t in b.column(2).to_pylist():
                got = np.array(c.encode(t), np.int32)
                raw = t.encode("utf-8", "surrogatepass")
                ids.append(got)
                size.append(len(raw))
                right.append(c.decode(got) == raw)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            ptr = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows, parts, pa.ListArray.from_arrays(pa.array(ptr), pa.array(flat)), pa.array(size, pa.int64()), pa.array(right, pa.bool_())], ["row", "part", "ids", "n_bytes", "round_trip"])

    return run


_PIECES = "row long, part int, ids array<int>, n_bytes long, round_trip boolean"


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids, n_tokens, n_bytes, round_trip) a document.

    A document of one chunk is a piece as it is and needs no exchange. The chunks of longer ones are spread over the
    cluster; only boundary lists meet by document, then the ids of the pieces.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must be positive and at most a chunk")
    base = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    short = base.where(F.length("text") <= chunk).select("doc_id", F.lit(0).alias("part"), "text")
    whole = short.mapInArrow(tidy(_encode(vocabulary)), _PIECES).select(F.col("row").alias("doc_id"), "ids", "n_bytes", "round_trip")
    empty = base.where("text is null").selectExpr("doc_id", "cast(null as array<int>) ids", "cast(null as long) n_bytes", "cast(null as boolean) round_trip")

    ws = Workspace(docs.sparkSession)
    long = base.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    with ws:
        long = ws.write(long, "long", keep=True)  # row numbers must not change if a task is run again
    spread = long.select("row", "text").mapInArrow(tidy(_make_chunks(chunk, overlap)), "row long, part int, parts int, start long, body string").repartition(F.col("row"), F.col("part"))
    marks = spread.mapInArrow(tidy(_marks(chunk, overlap)), "row long, part int, parts int, head array<long>, tail array<long>")
    ranges = marks.groupBy("row").applyInArrow(_stitched, "row long, part int, begin long, until long")
    joined = spread.join(ranges, ["row", "part"])
    ok = joined.where("begin is not null")
    piece = ok.select("row", "part", F.expr("case when until is null then substring(body, cast(begin - start + 1 as int)) else substring(body, cast(begin - start + 1 as int), cast(until - begin as int)) end").alias("body"))
    unstitched = ranges.where("begin is null and part = 0").select("row").join(long, "row").select("row", F.lit(0).alias("part"), F.col("text").alias("body"))
    pieces = piece.unionByName(unstitched).mapInArrow(tidy(_encode(vocabulary)), _PIECES)
    by_row = pieces.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"])).alias("ids"), F.sum("n_bytes").alias("n_bytes"), F.min("round_trip").alias("round_trip"))
    longs = long.select("row", "doc_id").join(by_row, "row").select("doc_id", "ids", "n_bytes", "round_trip")
    return whole.unionByName(longs).unionByName(empty).select("doc_id", "ids", F.expr("cast(if(ids is null, null, size(ids)) as long)").alias("n_tokens"), "n_bytes", "round_trip")


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the bytes of all ids, read as UTF-8 (a cut character becomes U+FFFD). Null ids give a null text."""

    def run(batches: Batches) -> Batches:
        c = codec(vocabulary)
        for b in batches:
            texts = [None if not x.is_valid else c.decode(x.values.to_numpy(zero_copy_only=False).astype(np.int64)).decode("utf-8", "replace") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(tidy(run), "doc_id long, text string")
