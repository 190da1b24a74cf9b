"""Compression bands: zstandard ratios of whole documents and of fixed chunks, held against limits for their length.

A ratio is compressed bytes by raw bytes. Text below a band's lower limit is repetitive, text above the upper limit
is incompressible. Short texts compress badly whatever they hold, so each length has its own limits. All bytes belong
to a chunk; the last one may be shorter than ``chunk`` and is then held against the limits of its length.

Defined cases: a null text has null figures and reason ``no text`` and isn't kept; an empty text has no chunks and is
kept; a ratio that equals a limit is within it; of a whole text and its chunks the former gives the reason; repeated
rows are judged one by one; a very long text is compressed chunk by chunk and once as a whole; an empty table gives no
rows; columns other than doc_id and text, whatever their names, are ignored; doc_id may be null and is passed on.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from fleetweave.llm._spark import Batches, tidy

#: (least bytes, lowest ratio, highest ratio), by rising length
BANDS = ((0, 0.0, 9.0), (200, 0.22, 0.95), (1000, 0.16, 0.85), (4000, 0.12, 0.80), (16000, 0.08, 0.75))
CHUNK = 4096
CHUNK_LIMITS = (0.10, 0.85)
CHUNK_SHARE = 0.34
LEVEL = 3

SCHEMA = "doc_id long, n_bytes long, ratio double, n_chunks int, chunk_min double, chunk_max double, bad_chunks int, reason string, keep boolean"


def limits_for(n: int, bands=BANDS) -> tuple[float, float]:
    return bands[bisect_right([b[0] for b in bands], n) - 1][1:]


def judge(text: str | None, press: zstandard.ZstdCompressor, bands=BANDS, chunk=CHUNK, chunk_limits=CHUNK_LIMITS, chunk_share=CHUNK_SHARE) -> tuple:
    """The figures of one text, cut into chunks every ``chunk`` bytes."""
    if text is None:
        return None, None, None, None, None, None, "no text", False
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return 0, None, 0, None, None, 0, None, True
    ratio = len(press.compress(raw)) / len(raw)
    parts = [raw[i : i + chunk] for i in range(0, len(raw), chunk)] if len(raw) > chunk else []
    ratios = [len(press.compress(p)) / len(p) for p in parts] or [ratio]
    bad = 0
    for r, p in zip(ratios, parts or [raw]):
        low, high = chunk_limits if len(p) == chunk else limits_for(len(p), bands)
        bad += not low <= r <= high
    low, high = limits_for(len(raw), bands)
    reason = "repetitive" if ratio < low else "incompressible" if ratio > high else "chunks" if bad and bad >= chunk_share * len(ratios) else None
    return len(raw), ratio, len(ratios), min(ratios), max(ratios), bad, reason, reason is None


def compression_bands(docs: DataFrame, bands=BANDS, chunk: int = CHUNK, chunk_limits=CHUNK_LIMITS, chunk_share: float = CHUNK_SHARE, level: int = LEVEL) -> DataFrame:
    """One row a document with its ratios, the reason against it (null for none) and whether to keep it."""

    def run(batches: Batches) -> Batches:
        press = zstandard.ZstdCompressor(level=level)
        names = ["doc_id", "n_bytes", "ratio", "n_chunks", "chunk_min", "chunk_max", "bad_chunks", "reason", "keep"]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.bool_()]
        for b in batches:
            rows = [judge(t.as_py(), press, bands, chunk, chunk_limits, chunk_share) for t in b.column(1)]
            cols = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds[1:]))], names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tidy(run), SCHEMA)
