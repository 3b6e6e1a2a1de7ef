"""Shared pieces of the corpus operators: scratch tables, distributed ranks, fixed-size bitmaps."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

#: Characters that separate words in the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


#: Bytes of one Arrow batch: rows that carry whole texts or sets must not add up.
BATCH_BYTES = 2 << 20


def _settle() -> None:
    """In a Python worker: arrays go back to the system as soon as they are freed, and don't wait in an allocator's pools."""
    if TaskContext.get() is not None and sys.platform == "linux":
        m_mmap_threshold, m_arena_max = -3, -8
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(m_mmap_threshold, 1 << 20)
            libc.mallopt(m_arena_max, 2)
        pa.set_memory_pool(pa.system_memory_pool())


_settle()


def bounded(spark: SparkSession) -> None:
    """Bounds the bytes of the session's Arrow batches, unless the session has a bound of its own.

    It holds for the lazy plans too that the operators return.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table, by Arrow: from tuples Spark would start Python workers on the executors only to pass them on."""
    kind = T.StructType.fromDDL(schema)
    columns = [[r[i] for r in rows] for i in range(len(kind))]
    return spark.createDataFrame(pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, kind, strict=True)], names=kind.names), kind)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; in local mode only, a temp folder if unset."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("clonoframe.scratch.dir", None)
    if not path:
        if not conf.get("spark.master", "").startswith(("local[", "local")) or "cluster" in conf.get("spark.master", ""):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="clonoframe-")
        spark.conf.set("clonoframe.scratch.dir", path)
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_all() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended first
            return


atexit.register(_remove_all)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and broadcasts of finished jobs, which it does when the driver's JVM has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256):
    """Arrow batches of so many rows while the block runs jobs: rows that carry whole texts or sets stay small in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Intermediate tables, written as Parquet to the shared folder and read back.

    A written table cuts the lineage: a lost executor costs at most the running stage,
    and the plans after it see its true size. Tables that a returned DataFrame still
    reads stay until the interpreter ends; the others go with drop().
    """

    def __init__(self, spark: SparkSession, name: str):
        bounded(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/clonoframe/{name}-{uuid.uuid4().hex}"
        _made.append((spark, self.base))

    def write(self, df: DataFrame, name: str, codec: str = "zstd", rows: int = 256) -> DataFrame:
        path = f"{self.base}/{name}"
        with small_batches(self.spark, rows):
            df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.spark, f"{self.base}/{name}")


def ranked(df: DataFrame, scratch: Scratch, name: str, group: list[str], order: list[Column], out: str) -> DataFrame:
    """Adds the gapless 0-based rank of each row within its group, for groups of any size.

    The rows are dealt by range over (group, order), so a group that holds most rows is
    spread over many tasks; the written rows carry their partition and place; per
    (partition, group) counts, at most partitions plus groups, give each run's offset.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(g) for g in group]
    dealt = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    dealt = scratch.write(dealt, name).withColumn("_part", F.shiftright("_at", 33))
    runs = dealt.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_part", *group, (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_shift"))
    runs = runs.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_shift")
    on = [F.col("_part") == F.col("_p"), *[F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]]
    return dealt.join(runs, on).withColumn(out, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_p", "_shift", *[f"_g{i}" for i in range(len(group))])


BITS = 1 << 25


def held(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the bits are set in a packed bitmap."""
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


_BLOCKS = 1024


def bitmap(keys: DataFrame, cell: Column | None = None) -> np.ndarray:
    """A bitmap of 2**25 bits (4 MB, whatever the input) over the hashes of the only column of keys, or over `cell`.

    It lets a map-side pass skip rows whose key is certainly absent; an exact join follows.
    """
    per = BITS // _BLOCKS // 8
    cell = F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(BITS)) if cell is None else cell

    def local(batches):
        packed = np.zeros(BITS // 8, np.uint8)
        for b in batches:
            at = b.column(0).to_numpy()
            np.bitwise_or.at(packed, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        full = np.flatnonzero(packed.reshape(_BLOCKS, per).any(1))
        yield pa.RecordBatch.from_pydict({"block": pa.array(full, pa.int32()), "bits": pa.array([packed[i * per : (i + 1) * per].tobytes() for i in full], pa.binary())})

    def merge(key, t):
        x = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(-1, per)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.bitwise_or.reduce(x).tobytes()], pa.binary())})

    rows = keys.select(cell.cast("long").alias("cell")).mapInArrow(local, "block int, bits binary").groupBy("block").applyInArrow(merge, "block int, bits binary").collect()
    out = np.zeros((_BLOCKS, per), np.uint8)
    for r in rows:
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def trim() -> None:
    """Gives freed memory back to the system at the end of a task: Spark keeps the Python worker for the next one."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)


def chunks(batch: pa.RecordBatch, column: str, limit: int = 1 << 19):
    """Slices of the batch whose texts have about `limit` bytes at most (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
