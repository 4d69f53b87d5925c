"""Column statistics of data files, and mergeable distinct counts."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: That of 2 ** 12 registers: 1.6 %.
SKETCH_ERROR = 1.04 / math.sqrt(1 << 12)
ORDERED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)
_FLOATS = (T.FloatType, T.DoubleType)


def distinct_estimate(c: Column | str) -> Column:
    return F.approx_count_distinct(c, SKETCH_ERROR)


def json_value(x: object) -> object:
    """A statistic as JSON can hold it: numbers, text and truth values as such, dates in ISO form."""
    if x is None or isinstance(x, (bool, int, str)):
        return x
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    return x.isoformat() if hasattr(x, "isoformat") else str(x)


def file_stats(df: DataFrame, columns: list[str] | None = None) -> dict[str, dict]:
    """For each data file that `df` reads, by path: its rows and its columns' statistics. One job over all files,
    aggregated before the shuffle; the driver gets a row a file. Least and greatest texts don't fit the rows of Spark's hash aggregate, and a task would
    sort all of its rows by path; an aggregate that holds an object, here a set that stays empty, has it hash the groups."""
    fields = [f for f in df.schema if isinstance(f.dataType, ORDERED) and (columns is None or f.name in columns)]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs += [F.min(c).alias(f"min{i}"), F.max(c).alias(f"max{i}"), F.count(c).alias(f"n{i}"), distinct_estimate(c).alias(f"d{i}")]
        aggs += [F.max(F.isnan(c)).alias(f"nan{i}")] * isinstance(f.dataType, _FLOATS)
    aggs.append(F.collect_set(F.lit(None).cast("int")).alias("held"))
    out = {}
    for row in df.groupBy(F.col("_metadata.file_path").alias("path")).agg(*aggs).toLocalIterator():
        stats = {}
        for i, f in enumerate(fields):
            s = {"min": json_value(row[f"min{i}"]), "max": json_value(row[f"max{i}"]), "null_count": row["rows"] - row[f"n{i}"], "distinct": row[f"d{i}"]}
            if isinstance(f.dataType, _FLOATS) and row[f"nan{i}"]:
                s["has_nan"] = True
            stats[f.name] = s
        out[row["path"]] = {"rows": row["rows"], "stats": stats}
    return out


def footer_stats(spark: SparkSession, paths: list[str]) -> dict[str, dict]:
    """The same from the files' own footers, without reading their rows: tasks open the Parquet files' ends. There is no distinct count in footers, but the names of the file's columns. A file whose
    file system they can't open has no entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_footer(p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], ["path", "found"])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths) // 16, 10_000)))
    return {r["path"]: json.loads(r["found"]) for r in files.mapInArrow(run, "path string, found string").toLocalIterator() if r["found"]}


def _footer(path: str) -> str | None:
    try:
        store, at = fs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:"))
        with store.open_input_file(at) as f:
            meta = pq.ParquetFile(f).metadata
    except (OSError, ValueError, NotImplementedError):
        return None
    stats: dict[str, dict] = {}
    for j in range(meta.num_columns):
        parts = [meta.row_group(i).column(j) for i in range(meta.num_row_groups)]
        name, own = meta.schema.column(j).path, [c.statistics for c in parts]
        if "." in name or not all(s is not None and s.has_null_count for s in own):
            continue
        found: dict = {"min": None, "max": None, "null_count": sum(s.null_count for s in own)}
        known = [s for s in own if s.has_min_max]
        if all(s.has_min_max or s.num_values == 0 for s in own) and known and not isinstance(known[0].min, bytes):
            found |= {"min": json_value(min(s.min for s in known)), "max": json_value(max(s.max for s in known))}
        if meta.schema.column(j).physical_type in ("FLOAT", "DOUBLE"):
            found["has_nan"] = True  # footers don't tell
        if found["min"] is not None or found["null_count"] == meta.num_rows:
            stats[name] = found
    return json.dumps({"rows": meta.num_rows, "columns": meta.schema.to_arrow_schema().names, "stats": stats})
