"""What several operators share: a place for written tables, groups of sorted rows, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetweave.session import ship


Batches = Iterator[pa.RecordBatch]
Mapper = Callable[[Batches], Batches]

#: bytes of texts that go to Python at once, where the session names no other size
BATCH_BYTES = 8 << 20


def tune(spark: SparkSession) -> None:
    """Batches of bounded size, whatever the length of the texts: Spark's own limit of rows says nothing about that."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, str(BATCH_BYTES))


#: folders of this session's workspaces
_roots: list[str] = []


class Workspace:
    """Tables written to the shared folder of spark.checkpoint.dir; all but the kept ones go at the end.

    Without that setting (as in tests) a local folder is used, which is right on one machine only.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        tune(spark)
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("on a cluster spark.checkpoint.dir must name a shared folder")
            base = "file://" + tempfile.mkdtemp(prefix="fleetweave-")
        self.root = f"{base.rstrip('/')}/fleetweave-{uuid.uuid4().hex}"
        self.written: dict[str, bool] = {}
        # what a result still reads goes with ``clean``, or else when the session's JVM ends
        self._files(self.root, lambda fs, path: fs.deleteOnExit(path))
        _roots.append(self.root)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        for name, keep in list(self.written.items()):
            if not keep:
                self.drop(name)

    def write(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.written[name] = keep
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self.written.pop(name, None)
        self._files(f"{self.root}/{name}", lambda fs, path: fs.delete(path, True))

    def settle(self) -> None:
        """Has Spark delete the shuffle files of what is written: else they stay until the driver happens to collect its garbage."""
        # the threads that take Spark's events hold the last one, with the plan that it ended, until the next one comes
        self.spark.sql("SELECT 1").collect()
        gc.collect()
        self.spark._jvm.System.gc()
        time.sleep(1)  # the cleaner works beside

    def _files(self, path: str, act: Callable) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        act(where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where)


def clean(spark: SparkSession) -> None:
    """Deletes the tables that results of this session still read. To be called when those results are consumed."""
    while _roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(_roots.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def pack(df: DataFrame) -> DataFrame:
    """All columns by number in one struct named row, so that no name can clash with an operator's own."""
    return df.select(F.struct(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns))).alias("row"))


def filtered(df: DataFrame, run: Mapper) -> DataFrame:
    """The rows that an Arrow mapper keeps. It sees the columns as c0, c1 and so on, whatever their names."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(tidy(run), plain.schema).toDF(*df.columns)


def unpack(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, as tables; groups may cross batches. The rows must come sorted by the keys."""
    rest: list[pa.RecordBatch] = []

    def cuts(t: pa.Table) -> np.ndarray:
        change = np.zeros(max(0, t.num_rows - 1), dtype=bool)
        for k in keys:
            v = t.column(k).combine_chunks().to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        return np.flatnonzero(change) + 1

    for b in batches:
        if not b.num_rows:
            continue
        rest.append(b)
        if len(rest) > 1 and all(rest[0].column(k)[0] == b.column(k)[b.num_rows - 1] for k in keys):
            continue  # still the same group
        t = pa.Table.from_batches(rest).combine_chunks()
        c = cuts(t)
        begin = 0
        for end in c:
            yield t.slice(begin, int(end) - begin)
            begin = int(end)
        rest = t.slice(begin).to_batches()
    if rest:
        t = pa.Table.from_batches(rest).combine_chunks()
        begin = 0
        for end in [*cuts(t), t.num_rows]:
            yield t.slice(begin, int(end) - begin)
            begin = int(end)


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its set) for all nodes that aren't the smallest of their set."""
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    half = len(a)
    for x, y in zip(index[:half].tolist(), index[half:].tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    top = np.fromiter((root(x) for x in range(len(nodes))), np.int64, len(nodes))
    other = top != np.arange(len(nodes))
    return nodes[other], nodes[top[other]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = union_find(np.concatenate((a, batch.column(0).to_numpy())), np.concatenate((b, batch.column(1).to_numpy())))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["node", "root"])


def components(ws: Workspace, edges: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """(node, root) with the smallest node of each connected component as root, for nodes other than the root.

    Union-find contracts each partition to stars; large-star and small-star rounds then join the stars of all
    partitions. Each round is written to the workspace, so no round is computed again after a lost executor.
    """
    now = ws.write(edges.toDF("node", "root").mapInArrow(tidy(_contract), "node long, root long"), f"{name}-0")
    k = 0
    while True:
        both = now.select(F.col("node").alias("u"), F.col("root").alias("v"))
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        small = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: the larger neighbours go to the smallest one
        large = both.join(small, "u").where("v > u").select(F.col("v").alias("node"), F.col("m").alias("root")).where("node <> root").distinct()
        large = ws.write(large, f"{name}-large{k}")
        # small star: the smaller neighbours, and the node itself
        low = large.groupBy("node").agg(F.min("root").alias("m"))
        star = large.join(low, "node").select(F.col("root").alias("node"), F.col("m").alias("root")).unionByName(low.select("node", F.col("m").alias("root"))).where("node <> root").distinct()
        k += 1
        new = ws.write(star, f"{name}-{k}", keep)
        signs = [d.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first() for d in (now, new)]
        # equal sums end the rounds only if no row has changed; both tables are distinct
        same = signs[0] == signs[1] and new.join(now, ["node", "root"], "left_anti").isEmpty()
        ws.drop(f"{name}-large{k - 1}")
        ws.drop(f"{name}-{k - 1}")
        if same:
            return new
        now = new


_libc = None


def release() -> None:
    """Gives freed memory back to the system: Python workers live on between stages and would hold on to their peak."""
    global _libc
    pa.default_memory_pool().release_unused()
    try:
        if _libc is None:
            _libc = ctypes.CDLL("libc.so.6")
        _libc.malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidy(run: Mapper) -> Mapper:
    """The mapper, with its worker's freed memory released at the end of each task."""

    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        release()

    return wrapped


#: rows of ids that may be broadcast; about 64 MB as a hash relation
BROADCAST_ROWS = 2_000_000


def if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table with a broadcast hint if it has at most ``most`` narrow rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= most else df
