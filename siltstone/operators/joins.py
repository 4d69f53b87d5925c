"""Joins on order: as of a time, and of points with ranges. Both cut the axis into pieces, so that a key with a third of all rows is many tasks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of both sides that a piece of the axis has on average.
PIECE_ROWS = 100_000


def _number(df: DataFrame, name: str) -> Column:
    """A time in microseconds, or the number itself."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(f"`{name}`").cast("timestamp"))
    return F.col(f"`{name}`")


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], tolerance: float | None = None, prefix: str = "right_") -> DataFrame:
    """Every row of the left with the columns (prefixed) of the last row of the right that has its keys and no later `on`; nulls where there is none,
    where one of the keys or `on` is null, or where it is more than `tolerance` (microseconds, or numbers) earlier. Of several with the same `on` the one with the greatest further
    columns counts. No self-join by ranges: both sides are merged in one order, within pieces of the axis; what was last before a piece comes from a window over the pieces."""
    rest = [c for c in right.columns if c not in by]
    keys = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(by)]
    a = left.select(F.struct("*").alias("_row"), *keys, _number(left, on).alias("_at"), F.lit(None).cast(right.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("x")).schema["x"].dataType).alias("_found"), F.lit(1).alias("_side"))
    b = right.where(F.col(f"`{on}`").isNotNull()).select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *keys, _number(right, on).alias("_at"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_found"), F.lit(0).alias("_side"))
    both, names = a.unionByName(b), [f"_k{i}" for i in range(len(by))]
    low, high, n = both.agg(F.min("_at"), F.max("_at"), F.count("*")).first()
    pieces = max(1, n // PIECE_ROWS)
    width = float(high - low) / pieces if low is not None and high > low else 1.0
    low = low if low is not None else 0
    both = both.withColumn("_piece", F.coalesce(F.floor((F.col("_at") - F.lit(low)) / F.lit(width)), F.lit(0)))
    last = F.struct("_at", "_found")
    ends = both.where("_side = 0").groupBy(*names, "_piece").agg(F.max(last).alias("_last"))
    # what was last before each piece that has rows of the left: a row for each key and piece
    asked = both.where("_side = 1").select(*names, "_piece").distinct().withColumn("_last", F.lit(None).cast(ends.schema["_last"].dataType)).withColumn("_asked", F.lit(True))
    order = Window.partitionBy(*names).orderBy("_piece", F.col("_asked").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = ends.withColumn("_asked", F.lit(False)).unionByName(asked).withColumn("_before", F.last("_last", ignorenulls=True).over(order)).where("_asked").select(*names, "_piece", "_before")
    inside = Window.partitionBy(*names, "_piece").orderBy("_at", "_side", "_found").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_own", F.last(F.when(F.col("_side") == 0, last), ignorenulls=True).over(inside)).where("_side = 1")
    own = own.alias("o").join(before.alias("b"), [F.col(f"o.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ["_piece", *names]], "left").withColumn("_hit", F.coalesce("_own", "_before"))
    valid = F.col("_at").isNotNull() & F.col("_hit").isNotNull()
    for c in names:
        valid &= F.col(f"o.{c}").isNotNull()
    if tolerance is not None:
        valid &= F.col("_at") - F.col("_hit._at") <= F.lit(tolerance)
    return own.select("_row.*", *(F.when(valid, F.col("_hit._found").getField(c)).alias(f"{prefix}{c}") for c in rest))


def in_range(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float | None = None) -> DataFrame:
    """Pairs of a point and a range that holds it, ends included; both have their columns. An equality join on pieces of the axis: a range lies in as many
    as it touches, a point in one. `width` of a piece: by default the mean length of the ranges."""
    if width is None:
        width = ranges.agg(F.avg(_number(ranges, high) - _number(ranges, low))).first()[0]
    width = float(width) if width and math.isfinite(width) and width > 0 else 1.0

    def piece(c: Column) -> Column:
        return F.floor(c / F.lit(width))

    valid = ranges.where(_number(ranges, low) <= _number(ranges, high))
    cut = valid.withColumn("_piece", F.explode(F.sequence(piece(_number(valid, low)), piece(_number(valid, high)))))
    found = points.withColumn("_piece", piece(_number(points, at))).join(cut, "_piece")
    return found.where((F.col(f"`{at}`") >= F.col(f"`{low}`")) & (F.col(f"`{at}`") <= F.col(f"`{high}`"))).drop("_piece")


def _sums(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of each of the slices [first, last) of x its sum, from sums of aligned blocks of doubling size; no difference of large sums."""
    out, a, b = np.zeros(len(first), x.dtype), first.copy(), np.maximum(first, last)
    while len(x) and (a < b).any():
        odd = (a < b) & (a & 1 == 1)
        out[odd] += x[a[odd]]
        a[odd] += 1
        odd = (a < b) & (b & 1 == 1)
        b[odd] -= 1
        out[odd] += x[b[odd]]
        x = np.append(x, x[:0].sum()) if len(x) & 1 else x
        a, b, x = a >> 1, b >> 1, x[::2] + x[1::2]
    return out


def totals_in_range(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str) -> DataFrame:
    """The ranges that hold a point, ends included, with n, the number of their points, and total, the sum of the points' `at` (numbers), without the pairs of in_range(). Points of
    one value are one. Pieces of the axis have equally many points; in each that a range touches its points lie between two places of the sorted values, and blocks of them are added."""
    values = points.select((F.col(f"`{at}`").cast("double") + F.lit(0.0)).alias("_at")).where("_at IS NOT NULL").groupBy("_at").agg(F.count("*").alias("_n"))
    pieces = points.count() // PIECE_ROWS + 1
    cuts = values.agg(F.percentile_approx("_at", [i / pieces for i in range(1, pieces)], F.lit(10_000))).first()[0] if pieces > 1 else None
    bounds = np.unique(np.array(cuts or [], np.float64))

    @F.pandas_udf("long")
    def piece(c: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, c.to_numpy(), "right"))

    def answered(own: pa.Table, asked: pa.Table) -> pa.Table:
        v, n = own["_at"].to_numpy(), own["_n"].to_numpy()
        order = np.argsort(v, kind="stable")
        v, n = v[order], n[order]
        first, last = np.searchsorted(v, asked["_low"].to_numpy(), "left"), np.searchsorted(v, asked["_high"].to_numpy(), "right")
        found = pa.table({"_low": asked["_low"], "_high": asked["_high"], "n": pa.array(_sums(n, first, last)), "total": pa.array(_sums(v * n, first, last))})
        return found.filter(pa.array(last > first))

    ends = [(F.col(f"`{c}`").cast("double") + F.lit(0.0)).alias(k) for c, k in ((low, "_low"), (high, "_high"))]
    kept = ranges.select("*", *ends).where("_low <= _high")
    asked = kept.select("_low", "_high").distinct().withColumn("_piece", F.explode(F.sequence(piece("_low"), piece("_high"))))
    found = values.withColumn("_piece", piece("_at")).groupBy("_piece").cogroup(asked.groupBy("_piece")).applyInArrow(answered, "_low double, _high double, n long, total double")
    whole = found.groupBy("_low", "_high").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return kept.join(whole, ["_low", "_high"]).select(*(F.col(f"`{c}`") for c in ranges.columns), "n", "total")
