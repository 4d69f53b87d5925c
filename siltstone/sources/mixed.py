"""One DataFrame over a dataset's files, whatever formats they have."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.catalog import Manifest
from siltstone.errors import BadFile
from siltstone.sources import csv

#: Files whose partition values are broadcast; those of more files are joined as Spark sees fit.
BROADCAST_FILES = 100_000
FORMATS = ("parquet", "iceberg", "delta", "csv", "orc", "json")


def read(spark: SparkSession, schema: T.StructType, manifests: list[Manifest]) -> DataFrame:
    """The dataset's columns in its schema's order and types; a row for each row of the files. Files of one format, and with
    values for the same partition columns, are one scan. Partition values that a table's log has instead of its files are
    joined to it by file, however many there are."""
    groups: dict[tuple[str, tuple[str, ...]], list[Manifest]] = defaultdict(list)
    for m in manifests:
        kind = m.format or "parquet"
        if kind not in FORMATS:
            raise BadFile(f"{m.path} has the unknown format {kind!r}")
        # only these formats' files may lack their partition columns
        names = tuple(sorted(m.partition)) if kind in ("parquet", "iceberg", "delta") else ()
        groups["parquet" if kind in ("iceberg", "delta") else kind, names].append(m)
    parts = []
    for (kind, names), files in sorted(groups.items(), key=lambda g: g[0]):
        paths = [m.path for m in files]
        own = T.StructType([f for f in schema if f.name not in names])
        if kind == "csv":
            df = csv.read(spark, paths, own)
        else:
            # the files' own schema: what it calls int stays int until the cast
            df = spark.read.format(kind).load(paths) if kind != "json" else spark.read.schema(own).json(paths)
        missing = [f.name for f in own if f.name not in df.columns]
        if missing:
            raise BadFile(f"{paths[0]} lacks the column {missing[0]!r}")
        parts.append(_valued(df, schema, names, files) if names else df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema)))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _text(x: object) -> str | None:
    return None if x is None else str(x).lower() if isinstance(x, bool) else str(x)


def _valued(df: DataFrame, schema: T.StructType, names: tuple[str, ...], files: list[Manifest]) -> DataFrame:
    """The scan of files that all have values of `names` in their manifests, with those values."""
    spark = df.sparkSession
    values = [tuple(_text(m.partition[c]) for c in names) for m in files]
    if len(set(values)) == 1:
        fixed = dict(zip(names, values[0]))
        return df.select(*((F.lit(fixed[f.name]) if f.name in fixed else F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in schema))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    plain = lambda p: p if p.startswith(("/", "file:/")) and not p.endswith("/") and "//" not in p and "/." not in p and "\\" not in p else path(p).toString()  # noqa: E731  a call of the JVM for each of many files takes long
    rows = [(plain(m.path).removeprefix("file:").replace("//", "/"), *v) for m, v in zip(files, values)]
    of = spark.createDataFrame(rows, T.StructType([T.StructField("of_file", T.StringType())] + [T.StructField(f"value_{c}", T.StringType()) for c in names]))
    of = F.broadcast(of) if len(rows) <= BROADCAST_FILES else of
    here = F.regexp_replace(F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), "^file:", ""), "//+", "/")
    df = df.withColumn("in_file", here).join(of, F.col("in_file") == F.col("of_file"))
    return df.select(*((F.col(f"`value_{f.name}`") if f.name in names else F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in schema))


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (the file's name without .txt), text: every text file of a folder, whole."""
    df = spark.read.text(f"{folder.rstrip('/')}/*.txt", wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return df.select(F.url_decode(F.regexp_replace(name, r"\.txt$", "")).alias("doc_id"), F.col("value").alias("text"))
