"""What the operators share: rules for odd rows, scratch tables, Arrow batches by size.

Rules that hold for every operator here, unless its docstring says otherwise:

* a row whose id is null can't be named by any result and takes no part;
* a null text counts as the empty text;
* only the columns that an operator names are read, so further columns, whatever
  they are called, don't matter; filters hand them on unchanged;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_root: dict[str, str] = {}
_to_delete: set[str] = set()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id (long) and text, by the rules above."""
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def scratch_root(spark: SparkSession) -> str:
    """A folder that all executors share: the one in spark.checkpoint.dir. Where that is unset, as in
    tests, a temporary one if Spark runs in this process alone; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = _own_root.setdefault("dir", "") or tempfile.mkdtemp(prefix="siltstone-")
        _own_root["dir"] = at
    return f"{at.rstrip('/')}/siltstone-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone when the process ends
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the scratch folder: it cuts lineage and outlives any executor.
    The folder goes when the driver's process ends."""
    spark = df.sparkSession
    root = scratch_root(spark)
    if root not in _to_delete:
        _to_delete.add(root)
        atexit.register(_delete, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """The rows with their place in the order, from 0, as a column place. A row knows its partition of a distributed sort and its place there; the sizes of the
    partitions before it give the rest. No task sees more than its partition."""
    ordered = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_at", 33))
    parts = ordered.groupBy("_part").agg(F.count("*").alias("n"))
    before = parts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a partition
    return ordered.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("place"))


#: Rows of identifiers and digests up to which a table is broadcast: some tens of megabytes.
BROADCAST_ROWS = 200_000


def bounded(table: DataFrame) -> tuple[DataFrame, bool]:
    """A written table of narrow rows, marked for broadcast if it is small, which is counted and not guessed; else Spark joins it by a shuffle."""
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return (F.broadcast(table) if small else table), small


_C = ctypes.CDLL(None)


def release() -> None:
    """Give freed memory back to the system: a worker process outlives its task, and would keep what the task needed at its peak while later stages run."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20, tidy: bool = True) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices with about `limit` bytes of `column` each, which bounds a worker's memory
    whatever the texts' length; a longer text is a slice of its own, and whole. tidy: memory is released at the end, as a task's is."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch
    if tidy:
        release()


def offsets_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words between white space, one after the other, and how many each text has."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts)))
    flat = lists.flatten()
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full).as_py() and len(flat):
        mask = full.to_numpy(zero_copy_only=False)
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[mask], minlength=len(counts)).astype(np.int64)
        flat = flat.filter(full)
    return flat, counts


def coded_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """split_words() with the words as positions in an array of the distinct ones."""
    flat, counts = split_words(texts)
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, counts


def byte_buffer(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary array."""
    wide = pa.types.is_large_string(words.type) or pa.types.is_large_binary(words.type)
    offsets = np.frombuffer(words.buffers()[1], np.int64 if wide else np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = words.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data, np.uint8))]).cast(pa.binary())


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets_of(counts).astype(np.int32)), pa.array(values))
