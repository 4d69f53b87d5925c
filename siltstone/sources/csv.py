"""CSV files: every field is text until the column's type is inferred from a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_ROWS = 1000
_NULLS = "(?i)^(|n/a|na|null|nan)$"
_WHOLE, _NUMBER, _TRUTH = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity)$", "^(true|false)$"


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text, with their names from the first line."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=False, escape='"', mode="PERMISSIVE", nullValue="")


def _value(name: str) -> Column:
    """The field, null where it is one of the null tokens."""
    c = F.col(f"`{name}`")
    return F.when(c.isNull() | c.rlike(_NULLS), None).otherwise(c)


def infer(sample: DataFrame) -> T.StructType:
    """A column is of the first of long, double, boolean that all its values in the sample are, else text. It is nullable
    if the sample has a null token. A column of nulls alone is text."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(sample.columns):
        v = _value(name)
        aggs += [F.count(v).alias(f"n{i}"), F.count_if(v.rlike(_WHOLE) & v.try_cast("bigint").isNotNull()).alias(f"w{i}"), F.count_if(v.rlike(_NUMBER)).alias(f"f{i}"), F.count_if(v.rlike(_TRUTH)).alias(f"t{i}")]
    r = sample.agg(*aggs).first()
    fields = []
    for i, name in enumerate(sample.columns):
        n = r[f"n{i}"]
        kind = T.StringType() if not n else T.LongType() if r[f"w{i}"] == n else T.DoubleType() if r[f"f{i}"] == n else T.BooleanType() if r[f"t{i}"] == n else T.StringType()
        fields.append(T.StructField(name, kind, n < r["rows"]))
    return T.StructType(fields)


def infer_file(spark: SparkSession, path: str | list[str], rows: int = SAMPLE_ROWS) -> T.StructType:
    return infer(read_text(spark, path).limit(rows))


def read(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """Typed. A value after the sample that doesn't fit its column's type is an error when it is read, never a silent null."""
    schema = infer_file(spark, path) if schema is None else schema
    text = read_text(spark, path)
    return text.select(*(_value(f.name).cast(f.dataType).alias(f.name) for f in schema))
