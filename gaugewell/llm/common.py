"""What the operators of this subpackage share: scratch tables, UTF-8 buffers, words."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words of every operator: runs of anything but space, tab, LF, VT, FF and CR (fixed value of the contract).
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a Python worker turns into numpy arrays at once; one longer document goes alone.
SLICE_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one is set only where that is unset."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not folder:
        folder = "/tmp/gaugewell-scratch"  # one machine, such as in the tests
    return f"{folder.rstrip('/')}/gaugewell-{spark.sparkContext.applicationId}"


class Scope:
    """Paths of scratch tables in the order in which they were written."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_SCOPES: ContextVar[tuple[Scope, ...]] = ContextVar("scopes", default=())


def _path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}"
    for scope in _SCOPES.get():
        scope.paths.append(path)
    return path


@contextmanager
def last_only(spark: SparkSession) -> Iterator[None]:
    """Of the scratch tables written inside, only the last one is left at the end."""
    scope = Scope()
    token = _SCOPES.set((*_SCOPES.get(), scope))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in scope.paths[:-1]:
            _delete(spark, path)


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends, lost executors don't matter."""
    spark = df.sparkSession
    path = _path(spark, uuid.uuid4().hex)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_keyed(docs: DataFrame) -> DataFrame:
    """doc (all columns of ``docs``), file and index: what tells every row from all others, also where ids and texts
    repeat, and is the same whenever the rows are read again. Rows that don't come straight from files are written."""
    try:
        place = docs.metadataColumn("_metadata")
        return docs.select(F.struct("*").alias("doc"), F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("index"))
    except AnalysisException:
        return row_keyed(materialize(docs))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with the number (from 0) of each row in ``order``: a distributed sort, then an offset for each partition."""
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = materialize(df.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__own": own}))
    parts = rows.groupBy("__part").agg(F.count("*").alias("__n"))  # one row for each partition
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    return rows.join(parts, "__part").withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``key``, so that joins and cogroups by it move only the other
    side. The catalog's entry is needed only to read the table's layout; the files stay as those of ``materialize`` do."""
    spark, name = df.sparkSession, f"gaugewell_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.option("compression", "zstd").option("path", _path(spark, name))
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(name, format="parquet")
    out = spark.table(name)
    out.schema  # the plan is made while the entry is there
    spark.sql(f"DROP TABLE {name}")
    return out


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, which sizes of buckets and tasks follow."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def clear_scratch(spark: SparkSession) -> None:
    """Removes every scratch table of this application; results that still read them must be consumed before."""
    _delete(spark, scratch_root(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for ``mapInArrow``, which gives memory back to the system at the end of each task: a worker waits for its
    next task beside the JVM, and what it would hold by then is memory that other stages lack."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
            if trim:
                trim(0)

    return wrapped


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its offsets, from 0; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, width, len(column) + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each, whole rows always."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(lengths), 0
    while start < batch.num_rows:
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """Words of a column of texts: byte spans in ``data`` and, by ``first``, the words of each document."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = utf8(column)
        n = len(self.data)
        solid = ~_SEPARATOR[self.data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], before[1:] = False, solid[:-1]
            after[-1], after[:-1] = False, solid[1:]
            edges = self.offsets[1:-1]
            before[edges[edges < n]] = False  # a word never crosses documents
            after[edges[edges > 0] - 1] = False
        self.solid = solid
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.first[-1] = len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def array(self) -> pa.Array:
        """The words as one Arrow array of bytes."""
        ends = np.concatenate(([0], np.cumsum(self.ends - self.starts)))
        return pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(self.data[self.solid]))])

    def joined(self, table: np.ndarray | None = None) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words, each followed by one space, and where each begins and ends; ``table`` maps bytes."""
        lengths = self.ends - self.starts
        begin = np.concatenate(([0], np.cumsum(lengths + 1)))
        out = np.full(begin[-1], 0x20, np.uint8)
        inside = np.ones(begin[-1], bool)
        inside[begin[1:] - 1] = False
        kept = self.data[self.solid]
        out[inside] = kept if table is None else table[kept]
        return out.tobytes(), begin[:-1], begin[:-1] + lengths
