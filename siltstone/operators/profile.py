"""Statistics that describe a dataset: summary, quality, outlier groups, trend, and the columns worth a look."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.stats import ORDERED, distinct_estimate, json_value

NULL_RATE, SHOWN, OUTLIER_Z, TREND_R2, TREND_POINTS = 0.2, 20, 2.0, 0.5, 3
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType, T.DecimalType)
_TIME = (T.DateType, T.TimestampType, T.TimestampNTZType)


def logical_type(kind: T.DataType) -> str:
    """What the heuristics go by: text, whole, real, time, truth or other."""
    for name, types in (("text", (T.StringType,)), ("whole", _WHOLE), ("real", _REAL), ("time", _TIME), ("truth", (T.BooleanType,))):
        if isinstance(kind, types):
            return name
    return "other"


@dataclass(frozen=True)
class ColumnSummary:
    name: str
    type: str
    null_rate: float
    distinct: int
    min: object
    max: object


@dataclass(frozen=True)
class Summary:
    rows: int
    columns: tuple[ColumnSummary, ...]

    def to_dict(self) -> dict:
        return asdict(self)


def summary(df: DataFrame) -> Summary:
    """Every column, by name, in one aggregation."""
    fields = sorted(df.schema, key=lambda f: f.name)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(c).alias(f"n{i}"))
        if isinstance(f.dataType, ORDERED):
            aggs += [distinct_estimate(c).alias(f"d{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    r = df.agg(*aggs).first().asDict()
    rows = r["rows"]
    columns = []
    for i, f in enumerate(fields):
        rate = (rows - r[f"n{i}"]) / rows if rows else 0.0
        columns.append(ColumnSummary(f.name, logical_type(f.dataType), rate, min(r.get(f"d{i}") or 0, rows), json_value(r.get(f"lo{i}")), json_value(r.get(f"hi{i}"))))
    return Summary(rows, tuple(columns))


def summary_rows(df: DataFrame) -> DataFrame:
    """column, total_rows, non_null, null_rate, min, max (as text): the exact part of summary(), as a DataFrame."""
    fields = sorted((f for f in df.schema if isinstance(f.dataType, ORDERED)), key=lambda f: f.name)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.struct(F.lit(f.name).alias("column"), F.count(c).alias("non_null"), F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max")).alias(f"c{i}"))
    row = df.agg(*aggs).select("rows", F.explode(F.array(*(f"c{i}" for i in range(len(fields))))).alias("c"))
    rate = F.when(F.col("rows") == 0, 0.0).otherwise((F.col("rows") - F.col("c.non_null")) / F.col("rows"))
    return row.select("c.column", F.col("rows").alias("total_rows"), "c.non_null", rate.alias("null_rate"), "c.min", "c.max")


def duplicate_rows(df: DataFrame, columns: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The rows whose values in `columns` (default: all) a row before them has, nulls being equal. Before is by `order`, the
    default being any order, in which case just the number of such rows is defined. Rows are grouped by a hash of their values and their values."""
    columns = columns or df.columns
    by = order or columns
    n = "copy_number"
    while n in df.columns:
        n += "_"
    w = Window.partitionBy(*(f"`{c}`" for c in columns)).orderBy(*(f"`{c}`" for c in by))
    return df.withColumn(n, F.row_number().over(w)).where(F.col(n) > 1).drop(n)


def duplicates(df: DataFrame, shown: int = SHOWN) -> tuple[int, list[int]]:
    """How many rows repeat an earlier one, and the first row numbers (from 0, in the frame's order) that do. For samples of bounded size."""
    n = "row_number_in_order"
    numbered = df.withColumn(n, F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1)
    again = duplicate_rows(numbered, df.columns, [n]).select(n).cache()
    try:
        return again.count(), [r[n] for r in again.orderBy(n).limit(shown).collect()]
    finally:
        again.unpersist()


def quality(s: Summary, repeated: tuple[int, list[int]] = (0, [])) -> list[dict]:
    """Findings: columns with many nulls, columns of one value, repeated rows."""
    out = []
    for c in s.columns:
        if c.null_rate > NULL_RATE:
            out.append({"kind": "high_null_rate", "column": c.name, "null_rate": c.null_rate})
        if c.null_rate < 1 and c.min is not None and str(c.min) == str(c.max):
            out.append({"kind": "zero_variance", "column": c.name, "value": c.min})
    if repeated[0]:
        out.append({"kind": "duplicate_rows", "count": repeated[0], "rows": list(repeated[1])})
    return out


def high_null_columns(df: DataFrame) -> DataFrame:
    return summary_rows(df).where(F.col("null_rate") > NULL_RATE).select("column", "null_rate")


def zero_variance_columns(df: DataFrame) -> DataFrame:
    return summary_rows(df).where((F.col("null_rate") < 1) & (F.col("min") == F.col("max"))).select("column", F.col("min").alias("value"))


def outlier_groups(grouped: DataFrame, group: str, value: str, z: float = OUTLIER_Z) -> DataFrame:
    """group, value, z of groups more than `z` population deviations from the mean over groups. Null groups and values don't count;
    with fewer than two groups or no deviation there are none. The mean and deviation are a one-row aggregate that is
    broadcast, so the groups stay where they are."""
    g = grouped.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).alias("group"), F.col(value).cast("double").alias("value"))
    over = g.agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n"))
    scored = g.crossJoin(F.broadcast(over)).where("n >= 2 AND sd > 0").withColumn("z", (F.col("value") - F.col("mu")) / F.col("sd"))
    return scored.where(F.abs("z") > z).select("group", "value", "z")


def trend(series: DataFrame, time: str, value: str) -> DataFrame:
    """n, slope, r2, direction: least squares of the value on its place in the order of time (from 0); rows with a null value
    keep their place. No row unless there are three points, r2 reaches 0.5 and the slope isn't 0. `series` has a row
    a point in time, so one partition orders it."""
    at = F.row_number().over(Window.orderBy(F.col(time).asc_nulls_last())) - 1
    points = series.select(at.alias("x"), F.col(value).cast("double").alias("y")).where("y IS NOT NULL")
    fit = points.agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.when(F.var_pop("y") > 0, F.regr_r2("y", "x")).otherwise(0.0).alias("r2"))
    found = fit.where((F.col("n") >= TREND_POINTS) & (F.col("r2") >= TREND_R2) & (F.col("slope") != 0))
    return found.withColumn("direction", F.when(F.col("slope") > 0, "up").otherwise("down"))


def pick_group(s: Summary) -> str | None:
    """A text column with few nulls and 2 to 50 values; the one with the fewest."""
    fits = [c for c in s.columns if c.type == "text" and c.null_rate < 0.5 and 2 <= c.distinct <= 50]
    return min(fits, key=lambda c: (c.distinct, c.name)).name if fits else None


def pick_value(s: Summary) -> str | None:
    """A number that varies; the first by name."""
    fits = [c.name for c in s.columns if c.type in ("whole", "real") and c.null_rate < 1 and c.min != c.max]
    return min(fits, default=None)


def pick_time(s: Summary) -> str | None:
    fits = [c.name for c in s.columns if c.type == "time" and c.null_rate < 0.5]
    return min(fits, default=None)


def by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(F.col(f"`{group}`").alias("group")).agg(F.avg(F.col(f"`{value}`")).alias("value"))


def by_time(df: DataFrame, time: str, value: str) -> DataFrame:
    """By day, where the column has times of day."""
    return df.groupBy(F.col(f"`{time}`").cast("date").alias("time")).agg(F.avg(F.col(f"`{value}`")).alias("value")).orderBy("time")
