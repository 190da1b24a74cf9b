"""Near duplicates by SuperMinHash signatures, banding, verification and union-find grouping.

Each distinct word shingle of a text walks a random permutation of the registers; its step number plus a uniform
number is the rank it offers to the register it stands on, and each register keeps the least. The ranks of one
element are a permutation, not independent draws, which lowers the variance. A walk stops as soon as every register
of the text is taken, for later steps offer higher ranks only. Bands of equal registers give buckets. The members of a
bucket are verified on whole signatures, one byte a register: texts are near duplicates if the share of equal
registers says that the Jaccard similarity of their shingles is at least ``least``. A bucket is linked as if all its
pairs were held against each other, but the triangle inequality of the distance spares most: members gather around
leaders, and of two clusters only members far enough from their leaders are compared. Connected components of the
links are the groups; the smallest doc_id of a group stays.

Equal texts form a group before that, so copies in any number cost one row each. A bucket of more than ``members``
texts is split: parts are linked each by itself, and after that texts outside the bucket's largest component are held
against all of the bucket, in blocks. So no bucket is ever in one place, and the links are those of the whole.

Defined cases: null texts and null doc_ids are in no group and stay; texts without a word have no shingles, and only
equal ones are grouped; texts of fewer words than a shingle have one shingle; a very long text is signed in pieces;
rows are grouped by their text, so rows that repeat a doc_id with other texts are documents of their own, and with the
same text copies; of a group stays the row of the smallest doc_id, of rows with that doc_id any one, and which texts
differ or not decides nothing else; an empty table gives no rows; other columns, whatever their names, are ignored by
``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetweave.llm._spark import Batches, Workspace, components, if_small, pack, sorted_groups, tidy, unpack
from fleetweave.llm._text import groups, mix, shingles, words

SHINGLE, REGISTERS, BANDS, LEAST_JACCARD = 3, 160, 40, 0.5
#: texts of a bucket that are linked in one place
MEMBERS = 4096
#: elements that are signed at once; larger sets go in pieces, whose registers are then the least of all
PIECE = 1 << 16
_FULL = np.uint64(2**64 - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def signatures(elements: np.ndarray, ptr: np.ndarray, m: int = REGISTERS, piece: int = PIECE) -> np.ndarray:
    """The SuperMinHash registers of each set elements[ptr[i]:ptr[i + 1]]; an empty set has full registers."""
    out, at = np.full((len(ptr) - 1, m), _FULL, np.uint64), 0
    while at < len(ptr) - 1:
        end = max(at + 1, int(np.searchsorted(ptr, ptr[at] + piece, "right")) - 1)
        if end > at + 1 or ptr[end] - ptr[at] <= piece:
            out[at:end] = _signatures(elements[ptr[at] : ptr[end]], ptr[at : end + 1] - ptr[at], m)
        else:
            for k in range(ptr[at], ptr[end], piece):
                some = elements[k : min(k + piece, ptr[end])]
                np.minimum(out[at], _signatures(some, np.array([0, len(some)]), m)[0], out=out[at])
        at = end
    return out


def _signatures(elements: np.ndarray, ptr: np.ndarray, m: int) -> np.ndarray:
    """Registers of sets that are signed together.

    A register holds the step in its top 8 bits and 56 random bits below. All sets take a step together; sets with no
    free register then leave.
    """
    if not 0 < m <= 255:
        raise ValueError("1 to 255 registers")
    n = len(ptr) - 1
    sig = np.full(n * m, _FULL, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(ptr))
    e = elements.copy()
    perm = np.broadcast_to(np.arange(m, dtype=np.uint8), (len(e), m)).copy()
    row = np.arange(len(e))
    for j in range(m):
        if not len(row):
            break
        with np.errstate(over="ignore"):
            r = mix(e[row] + np.uint64(j + 1) * _STEP)
        k = j + ((r >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        slot = perm[row, k]
        perm[row, k] = perm[row, j]
        own = owner[row]
        rank = (np.uint64(j) << np.uint64(56)) | (mix(r) >> np.uint64(8))
        np.minimum.at(sig, own * m + slot, rank)
        here = np.unique(own)
        open_ = np.zeros(n, bool)
        open_[here] = (sig.reshape(n, m)[here] == _FULL).any(1)
        row = row[open_[own]]
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One key a band, different for each band."""
    n, m = sig.shape
    rows = m // bands
    out = np.empty((n, bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            total = np.full(n, b + 1, np.uint64)
            for k in range(b * rows, b * rows + rows):
                total = mix(total * _STEP + sig[:, k])
            out[:, b] = total
    return out


def text_sets(texts: list[str], shingle: int = SHINGLE) -> list[np.ndarray]:
    out = []
    for a, b in groups(texts):
        h, _, _, ptr = words(texts[a:b])
        out += [shingles(h[i:j], shingle) for i, j in zip(ptr[:-1], ptr[1:])]
    return out


def _long_list(ptr: np.ndarray, flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(flat.view(np.int64)))


_SIGNED = "row long, doc_id long, xh long, h1 long, h2 long, bands array<long>, sig binary"


def _sign(shingle: int, registers: int, bands: int):
    def run(batches: Batches) -> Batches:
        """Two halves of a hash of the text, band keys (none for a text without words), a byte of each register."""
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in groups(texts):
                some = texts[lo:hi]
                sets = text_sets(some, shingle)
                ptr = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                sig = signatures(np.concatenate(sets) if sets else np.zeros(0, np.uint64), ptr, registers)
                keys = band_keys(sig, bands)
                full = np.diff(ptr) > 0
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in some), np.int64).reshape(-1, 2)
                at = np.concatenate(([0], np.cumsum(full * bands)))
                low = (sig & np.uint64(255)).astype(np.uint8)
                own = [b.column(c).slice(lo, hi - lo) for c in ("row", "doc_id", "xh")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), _long_list(at, keys[full].reshape(-1)), pa.array([x.tobytes() for x in low], pa.binary())], ["row", "doc_id", "xh", "h1", "h2", "bands", "sig"])

    return run


def most_unlike(registers: int, least: float) -> int:
    """Registers that may differ; unequal ones have equal bytes one time in 256."""
    return registers - math.ceil(registers * (least + (1 - least) / 256) - 1e-9)


def link(sig: np.ndarray, most: int) -> np.ndarray:
    """The component of each row where rows with at most ``most`` different bytes are linked: the number of its first row."""
    n = len(sig)
    parent = np.arange(n)

    def unite(rows: np.ndarray) -> None:
        tops = np.unique(parent[rows])
        if len(tops) > 1:
            parent[np.isin(parent, tops[1:])] = tops[0]

    leader, leaders, far = np.full(n, -1), [], []
    for i in range(n):
        if leader[i] < 0:
            d = (sig != sig[i]).sum(1, dtype=np.int16)
            near = d <= most
            leader[near & (leader < 0)] = len(leaders)
            leaders.append(i)
            far.append(d)
            unite(np.flatnonzero(near))
    if len(leaders) > 1:
        at, distance = np.array(leaders), np.stack(far)
        own = distance[leader, np.arange(n)].astype(np.int64)
        radius = np.zeros(len(at), np.int64)
        np.maximum.at(radius, leader, own)
        close = distance[:, at] <= most + radius[:, None] + radius[None, :]
        for x, y in zip(*np.nonzero(np.triu(close, 1))):
            if parent[at[x]] == parent[at[y]]:
                continue
            one, two = np.flatnonzero(leader == x), np.flatnonzero(leader == y)
            one = one[distance[y, one] <= most + radius[y]]
            two = two[distance[x, two] <= most + radius[x]]
            for i in one:
                some = two[distance[x, two] - own[i] <= most]
                some = some[(sig[some] != sig[i]).sum(1) <= most]
                if len(some):
                    unite(np.array([i, some[0]]))
                    break
    return parent


def _link(most: int):
    def run(batches: Batches) -> Batches:
        for t in sorted_groups(batches, ["key", "part"]):
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            top, ids = link(sig, most), t.column("node").to_numpy()
            other = np.flatnonzero(top != np.arange(len(top)))
            if len(other):
                yield pa.RecordBatch.from_arrays([pa.array(ids[top[other]]), pa.array(ids[other])], ["a", "b"])

    return run


def _across(most: int):
    def run(batches: Batches) -> Batches:
        """Links between the two sides of a block, one for each text of the second side and component of the first."""
        for t in sorted_groups(batches, ["key", "block", "minor_block"]):
            node, root, minor = t.column("node").to_numpy(), t.column("root").to_numpy(), t.column("minor").to_numpy(zero_copy_only=False).astype(bool)
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            one, own, of = sig[~minor], node[~minor], root[~minor]
            a, b = [], []
            for i in np.flatnonzero(minor):
                near = np.flatnonzero(((one != sig[i]).sum(1, dtype=np.int16) <= most) & (of != root[i]))
                _, first = np.unique(of[near], return_index=True)
                a += own[near[first]].tolist()
                b += [node[i]] * len(first)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _links(ws: Workspace, texts: DataFrame, most: int, members: int) -> DataFrame:
    """(a, b) of texts (node, bands, sig) that are near: enough of them for the components of all near pairs in a bucket."""
    keyed = texts.select("node", F.explode("bands").alias("key"))
    shared = ws.write(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    within = keyed.join(shared, "key").join(texts.select("node", "sig"), "node").select("key", "node", "sig", "n", F.expr(f"pmod(xxhash64(node), cast(ceil(n / {members}) as int))").alias("part"))
    one = within.repartition("key", "part").sortWithinPartitions("key", "part", "node").select("key", "part", "node", "sig").mapInArrow(tidy(_link(most)), "a long, b long").where("a <> b")
    hot = shared.where(F.col("n") > members)
    if hot.isEmpty():
        return one
    one = ws.write(one, "links")
    known = components(ws, one, "parts", keep=True)
    inside = keyed.join(if_small(ws.write(hot, "hot", keep=True)), "key").join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    inside = ws.write(inside, "inside")
    most_common = inside.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("major"), (F.sum("count") - F.max("count")).alias("n_minor")).where("n_minor > 0")
    # a row for each block of all and each block of those outside the largest component
    split = inside.join(if_small(ws.write(most_common, "major", keep=True)), "key").join(texts.select("node", "sig"), "node")
    split = split.withColumn("blocks", F.expr(f"cast(ceil(n / {members}) as int)")).withColumn("minors", F.expr(f"cast(ceil(n_minor / {members}) as int)"))
    block, minor_block = F.expr("pmod(xxhash64(node), blocks)"), F.expr("pmod(xxhash64(node, 1), minors)")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ["key", "node", "root", "sig"]
    sides = split.select(*own, F.lit(False).alias("minor"), block.cast("int").alias("block"), every("minors").alias("minor_block"))
    sides = sides.unionByName(split.where("root <> major").select(*own, F.lit(True).alias("minor"), every("blocks").alias("block"), minor_block.cast("int").alias("minor_block")))
    more = sides.repartition("key", "block", "minor_block").sortWithinPartitions("key", "block", "minor_block", "node").mapInArrow(tidy(_across(most)), "a long, b long")
    return one.unionByName(more)


def _grouped(ws: Workspace, docs: DataFrame, shingle: int = SHINGLE, registers: int = REGISTERS, bands: int = BANDS, least: float = LEAST_JACCARD, members: int = MEMBERS) -> tuple[DataFrame, DataFrame]:
    """(rows (row, doc_id, xh, node), groups (node, group_id, best)): node is the text, best the row of its group that
    stays. All rows with a doc_id and a text are there, and all texts of groups of two rows or more. Both are written."""
    base = docs.selectExpr("cast(doc_id as long) doc_id", "text").where("doc_id is not null and text is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("xh"), "text")
    signed = base.mapInArrow(tidy(_sign(shingle, registers, bands)), _SIGNED)
    same = Window.partitionBy("h1", "h2")
    signed = signed.withColumn("first", F.min(F.struct("doc_id", "row")).over(same)).withColumn("copies", F.count("*").over(same))
    only = F.col("first.row") == F.col("row")  # one row a distinct text goes on
    signed = ws.write(signed.select("row", "doc_id", "xh", F.col("first.row").alias("node"), F.when(only, F.col("copies")).alias("copies"), F.when(only, F.col("bands")).alias("bands"), F.when(only, F.col("sig")).alias("sig")), "signed", keep=True)
    texts = signed.where("copies is not null")
    found = components(ws, _links(ws, texts.select("node", "bands", "sig"), most_unlike(registers, least), members), "groups", keep=True)
    top = texts.select("node", "doc_id", "copies").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")).where("copies > 1 or root <> node").unionByName(texts.select("node", "doc_id", "copies").join(found.select(F.col("root").alias("node")).distinct(), "node", "left_semi").where("copies = 1").withColumn("root", F.col("node")))
    top = ws.write(top, "top")
    best = top.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("best"))
    grouped = ws.write(top.join(best, "root").select("node", F.col("best.doc_id").alias("group_id"), F.col("best.node").alias("best")), "grouped", keep=True)
    return signed.select("row", "doc_id", "xh", "node"), grouped


def near_duplicates(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, group_id, keep) of each row: group_id, the smallest doc_id of the group, is null outside groups."""
    with Workspace(docs.sparkSession) as ws:
        rows, grouped = _grouped(ws, docs, **limits)
        found = rows.join(if_small(grouped), "node", "left").select("doc_id", "group_id", F.expr("best is null or best = row").alias("keep"))
    none = docs.selectExpr("cast(doc_id as long) doc_id", "cast(null as long) group_id", "true keep", "text").where("doc_id is null or text is null").drop("text")
    return found.unionByName(none)


def groups_of(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, group_id) of all documents in a group of two rows or more, the group's smallest doc_id included."""
    return near_duplicates(docs, **limits).where("group_id is not null").select("doc_id", "group_id").distinct()


def keep_one(docs: DataFrame, **limits) -> DataFrame:
    """The documents with one of each group left, with all their columns."""
    with Workspace(docs.sparkSession) as ws:
        rows, grouped = _grouped(ws, docs, **limits)
        gone = rows.join(if_small(grouped), "node").where("row <> best")
        # rows that repeat the one that stays have its doc_id and text; of those one stays
        stays = rows.join(if_small(grouped.select(F.col("best").alias("row")).distinct()), "row", "left_semi").select("doc_id", "xh")
        gone = gone.select(F.col("doc_id").alias("of"), F.col("xh").alias("of_xh")).distinct()
        stays = stays.select(F.col("doc_id").alias("of"), F.col("xh").alias("of_xh"), F.lit(True).alias("again")).distinct()
        gone = ws.write(gone.join(stays, ["of", "of_xh"], "left").select("of", "of_xh", F.coalesce("again", F.lit(False)).alias("again")), "gone", keep=True)
    names = docs.columns
    key = [f"cast(row.c{names.index('doc_id')} as long)", f"xxhash64(row.c{names.index('text')})"]
    matched = F.expr(f"{key[0]} = of and {key[1]} = of_xh")
    whole = pack(docs)
    if gone.where("again").isEmpty():
        return unpack(whole.join(if_small(gone), matched, "left_anti"), names)
    marked = whole.join(if_small(gone), matched, "left").select("row", "again")
    one = marked.where("again").select("row", F.row_number().over(Window.partitionBy(F.expr(key[0]), F.expr(key[1])).orderBy(F.lit(0))).alias("nth")).where("nth = 1").select("row")
    return unpack(marked.where("again is null").select("row").unionByName(one), names)
