"""Shared pieces: tables, the shared scratch folder, and vectorised byte scanning."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Share of the driver's heap limit up to which the heap may have grown before a written table makes it shrink.
HEAP_SHARE = 0.55


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of this machine where that is unset and Spark runs on this machine alone, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return root or f"file://{tempfile.gettempdir()}/probity-scratch"


class Scratch:
    """Written tables that cut lineage; they live in the shared folder until dropped or the session ends."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
        path, fs = self._fs("")
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        """Writes df once and returns the written table. What planning its queries has left on the driver's heap goes when that has grown
        over HEAP_SHARE: hundreds of short queries, as on small tables, else take the heap to its limit. Memory that the driver has freed
        beside its heap goes back to the system each time."""
        writer = df.write.mode("overwrite")
        (writer.option("compression", codec) if codec else writer).parquet(self.path(name))
        heap = self.spark._jvm.Runtime.getRuntime()
        if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
            self.tidy()
        else:
            trim_driver(self.spark)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        path, fs = self._fs(name)
        fs.delete(path, True)

    def tidy(self, last: bool = False) -> None:
        """Lets Spark's cleaner remove the shuffle files of stages whose results are already written. Spark holds on to the last
        query until another has run, so those of the last written table only go with `last`, which runs one on a single row."""
        import gc

        if last:
            self.spark.range(0, 1, 1, 1).count()
        gc.collect()
        self.spark._jvm.System.gc()
        trim_driver(self.spark)


def trim_driver(spark: SparkSession) -> None:
    """Has the driver's JVM return native memory that it has freed, where it can (HotSpot on Linux, newer 17 and later). Its hundreds of
    short-lived threads leave that in the C library's arenas, which else only grow from query to query."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    call = new(jvm.Object, 4)
    try:
        call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call[2], call[3] = new(jvm.Object, 0), new(jvm.String, 0)
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JError:
        pass


def give_back() -> None:
    """Returns memory that this process has freed to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, after whose last batch the worker gives its free memory back. Spark keeps workers for later tasks, and what an idle one holds on to
    counts beside whatever the executor does next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def free_names(taken, *names: str) -> list[str]:
    """Names for helper columns that no column of `taken` has, whatever its case."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def join_spread(rows: DataFrame, side: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """rows joined with side on keys, of which side has one row each and in `count` how many rows have them, of `total`.

    Keys with over a thousandth of the rows, of which there are less than a thousand, are joined by broadcast, so that a hot key's rows
    stay spread; the others are joined by shuffling. Null keys never meet.
    """
    many = F.lit(max(1, total // 1000))
    hot, rest = side.filter(F.col(count) > many).drop(count), side.filter(F.col(count) <= many).drop(count)
    cool = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(cool.join(rest, keys))


def input_splits(df: DataFrame) -> int:
    """Input splits of df: grows with the data, so that partition counts derived from it do too."""
    return max(1, df.rdd.getNumPartitions())


def scan_layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rebased to 0) of a string or binary column without copying; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.empty(0, np.uint8)
    return buf, offs - offs[0]


def chunks(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for consecutive rows of about `limit` bytes; a longer text is one chunk."""
    buf, offs = scan_layout(column)
    a, n = 0, len(offs) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1))
        yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that only ASCII white space parts.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
_P, _PINV = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_pow = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        size = 1 << max(19, (n - 1).bit_length())
        tables = []
        for base in (_P, _PINV):
            t, done, step = np.ones(size, U64), 1, base
            while done < size:
                t[done : 2 * done] = t[:done] * U64(step)
                step, done = step * step % (1 << 64), 2 * done
            tables.append(t)
        _pow.update(n=size, t=tables)
    return _pow["t"][0][:n], _pow["t"][1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the entropy of 64-bit values over all bits."""
    h = (h ^ (h >> U64(31))) * U64(0x7FB5D329728EA185)
    h = (h ^ (h >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts of a chunk in one pass: byte starts, byte ends, row, 64-bit hash.

    A word is a maximal run of bytes b with is_word[b], judged after lower-casing A-Z; it never crosses a text.
    """
    n = len(buf)
    if n == 0:
        e = np.empty(0, np.int64)
        return e, e, e, np.empty(0, U64)
    low = LOWER[buf]
    m = is_word[low]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, m[:-1]
    starts = np.flatnonzero(m & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, m[1:]
    ends = np.flatnonzero(m & (~after | edge[1:])) + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum((low.astype(U64) + U64(1)) * up[:n], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * down[starts])
    return starts, ends, np.searchsorted(offs, starts, "right") - 1, h
