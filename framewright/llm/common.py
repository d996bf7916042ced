"""Helpers shared by the operators: scratch tables, ranks in groups, text blocks, components.

Byte-level helpers work on blocks of at most BLOCK bytes of text (a single longer text is a
block of its own), so that a worker's memory follows the block and not the Arrow batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20
#: Bytes up to which a range is hashed by its prefix sums.
SHORT = 64
#: Word separators: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- scratch tables


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="framewright-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def _folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, which goes when the application ends."""
    path = f"{scratch_dir(spark)}/framewright/{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders.add(path)
        fs, p = _hadoop(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return path


_folders: set[str] = set()


def _hadoop(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage.

    Operators drop such a table once nothing lazy reads it; the rest is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._framewright_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables made by stored() that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_framewright_path", None)
        if path:
            fs, p = _hadoop(t.sparkSession, path)
            fs.delete(p, True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and broadcasts of tables that nothing refers to any more."""
    for _ in range(2):  # what the first round frees can hold other tables
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def numbered(rows: DataFrame) -> tuple[DataFrame, bool]:
    """Rows with a unique long `row`: doc_id itself, unless ids repeat or are null; and whether it is.

    Else the rows are numbered by task and place and written, so that every later reader sees the same
    numbers and no task gathers the rows of one id.
    """
    if not rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 or doc_id is null").limit(1).count():
        return rows.withColumn("row", F.col("doc_id").cast("long")), True
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "numbered"), False


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 128) -> Iterator[None]:
    """Arrow batches of few rows for what is planned and run inside: rows that carry whole texts or sets."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, old)


# ---------------------------------------------------------------- ranks in groups


def ranked(df: DataFrame, keys: list[str], order: list[Column], rank: str, lanes: int = 64) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in `lanes` tasks per group.

    A group is dealt into lanes by a hash of the order columns; a lane's rows are numbered in
    order, and a prefix sum over the lanes' counts (groups x lanes rows) shifts them. A group of
    any size is so numbered by many tasks. Rows that tie in all order columns get any order.
    """
    lane, base = f"{rank}__lane", f"{rank}__base"
    df = df.withColumn(lane, F.pmod(F.xxhash64(*order), F.lit(lanes)).cast("int"))
    sizes = df.groupBy(*keys, lane).agg(F.count(F.lit(1)).alias(base))
    before = Window.partitionBy(*keys).orderBy(lane).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    own = Window.partitionBy(*keys, lane).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(own) - 1).join(sizes, [*keys, lane]).withColumn(rank, (F.col(rank) + F.col(base)).cast("long")).drop(lane, base)


# ---------------------------------------------------------------- blocks of text


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving freed memory back to the system when a task ends: Spark keeps its Python workers for later tasks."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library has no such function
            ctypes.CDLL(None).malloc_trim(0)

    return go


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of about `limit` bytes of text: (slice, bytes, offsets)."""
    for batch in batches:
        buf, off = utf8(batch.column(text))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64, np.uint64]:
    rng = np.random.default_rng(20240229)
    value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    sep = np.zeros(256, bool)
    sep[[32, 9, 10, 11, 12, 13]] = True
    p = 0x9E3779B97F4A7C15
    return value, lower, sep, np.uint64(p), np.uint64(pow(p, -1, 1 << 64))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the multiplier and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        m = max(n + 1, BLOCK + 1)
        for k, base in ((0, _tables()[3]), (1, _tables()[4])):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Prefix:
    """Prefix sums of a block, from which the hash of any byte range follows at once."""

    def __init__(self, buf: np.ndarray, fold: bool = False):
        value, lower, _, _, _ = _tables()
        self.up, self.down = _pow(len(buf))
        self.bytes = lower[buf] if fold else buf
        v = value[self.bytes]
        v *= self.up[: len(buf)]
        self.sum = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(v, out=self.sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each range; beyond SHORT bytes by another hash, as sums modulo 2**64 of long regular texts can agree."""
        out = mix((self.sum[end] - self.sum[start]) * self.down[start] + (end - start).astype(np.uint64))
        long = np.flatnonzero(end - start > SHORT)
        if len(long):
            raw, digest = self.bytes.tobytes(), xxhash.xxh3_64_intdigest
            out[long] = np.fromiter((digest(raw[i:j]) for i, j in zip(start[long].tolist(), end[long].tolist(), strict=True)), np.uint64, len(long))
        return out

    def all(self, k: int) -> np.ndarray:
        """Of every range of k bytes, by start."""
        n = len(self.sum) - k
        return mix((self.sum[k:] - self.sum[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the block's words, and for each text the index of its first word (n + 1)."""
    inside = ~_tables()[2][buf]
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def shingles(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (of the whole, if fewer; none, if there are no words)."""
    n = len(word)
    if n == 0:
        return word
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = (out + word[j : n - k + 1 + j]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return mix(out)


# ---------------------------------------------------------------- connected components


class Forest:
    """Union-find over the nodes that a task has met; begins anew beyond LIMIT nodes, which costs links and no result."""

    LIMIT = 1 << 20

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def joined(self, a: int, b: int) -> bool:
        return self.root(a) == self.root(b)

    def join(self, a: int, b: int) -> None:
        if len(self.up) > self.LIMIT:
            self.up.clear()
        x, y = self.root(a), self.root(b)
        self.up[max(x, y)] = min(x, y)


def forest(links: DataFrame) -> DataFrame:
    """Of links (a, b) those that each task needs to join what it has: fewer than its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Forest()
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keep.append(new := not own.joined(a, b))
                if new:
                    own.join(a, b)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return links.select("a", "b").mapInArrow(trimmed(run), "a long, b long")


#: Edges of components() that one task joins.
FEW = 1 << 17


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of all nodes but the roots, for edges (u, v)."""
    own = Forest()
    own.LIMIT = 2 * FEW  # never begins anew
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if not own.joined(u, v):
                own.join(u, v)
    node = list(own.up)
    yield pa.record_batch([pa.array(node, pa.int64()), pa.array([own.root(x) for x in node], pa.int64())], names=["node", "root"]).filter(pa.array([own.root(x) != x for x in node], pa.bool_()))


def components(edges: DataFrame) -> DataFrame:
    """Node and smallest node of its component (stored; without the roots), for edges (a, b) of longs.

    At most FEW edges are joined in one task. Of more it alternates the large-star and small-star steps until the edges point at their roots. Hot
    nodes only meet in minima, which are combined before the shuffle, and in joins of three longs a
    row. Each round is written to the shared folder.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    e = stored(e, "edges")
    if e.count() <= FEW:
        out = stored(e.coalesce(1).mapInArrow(trimmed(_joined), "node long, root long"), "edges")
        dropped(e)
        return out
    last = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u != v").distinct()
        e, old = stored(small, "edges"), e
        dropped(old)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == last:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._framewright_path = e._framewright_path
            return out
        last = now
