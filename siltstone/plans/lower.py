"""Plans as DataFrames. Catalyst optimises and runs them; nothing here is executed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column as C
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.errors import InvalidPlan
from siltstone.plans import ir

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TYPES = {"Int": "bigint", "Float": "double", "Str": "string", "Bool": "boolean"}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def float_division(left: C, right: C) -> C:
    """Division by the floating-point standard, where ANSI mode would raise: x / 0 is infinite, 0 / 0 not a number."""
    by_zero = F.when(left > 0, F.lit(float("inf"))).when(left < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(left.isNull() | right.isNull(), F.lit(None).cast("double")).when(right == 0, by_zero).otherwise(left / right)


def expression(e: ir.Expr, df: DataFrame) -> C:
    if isinstance(e, ir.Column):
        return F.col(quoted(e.name))
    if isinstance(e, ir.Literal):
        return F.lit(e.value).cast(_TYPES[e.kind])
    left, right = expression(e.left, df), expression(e.right, df)
    if e.op == "Div":
        kinds = [f.dataType for f in df.select(left, right).schema]
        if all(isinstance(k, _WHOLE) for k in kinds):
            return _whole_division(left, right)
        return float_division(left.cast("double"), right.cast("double"))
    return {
        "Eq": lambda: left == right, "NotEq": lambda: left != right, "Lt": lambda: left < right, "LtEq": lambda: left <= right, "Gt": lambda: left > right, "GtEq": lambda: left >= right,
        "And": lambda: left & right, "Or": lambda: left | right, "Add": lambda: left + right, "Sub": lambda: left - right, "Mul": lambda: left * right,
    }[e.op]()


def _whole_division(left: C, right: C) -> C:
    """Truncates; division by zero raises in ANSI mode."""
    return F.call_function("div", left.cast("bigint"), right.cast("bigint"))


def aggregate(a: ir.Agg, df: DataFrame) -> C:
    if a.func == "Count":
        return (F.count(F.lit(1)) if a.arg is None else F.count(expression(a.arg, df))).alias(a.alias)
    return {"Sum": F.sum, "Avg": F.avg, "Min": F.min, "Max": F.max}[a.func](expression(a.arg, df)).alias(a.alias)


def lower(p: ir.Plan, scan: Callable[[ir.Scan], DataFrame]) -> DataFrame:
    """`scan` gives the DataFrame of a scan's dataset; the columns that the scan lists are selected here."""
    if isinstance(p, ir.Scan):
        df = scan(p)
        return df.select(*map(quoted, p.columns)) if p.columns else df
    if isinstance(p, ir.Join):
        left, right = lower(p.left, scan), lower(p.right, scan)
        both = set(left.columns) & set(right.columns)
        if both:
            raise InvalidPlan(f"both sides of a join have {', '.join(sorted(both))}")
        # types of the condition's columns come from both sides
        return left.join(right, expression(p.on, left.limit(0).crossJoin(right.limit(0))), {"Inner": "inner", "Left": "left", "Right": "right", "Full": "full"}[p.how])
    df = lower(p.input, scan)
    if isinstance(p, ir.Filter):
        return df.filter(expression(p.predicate, df))
    if isinstance(p, ir.Project):
        return df.select(*(expression(e, df).alias(a) for e, a in zip(p.exprs, p.aliases)))
    if isinstance(p, ir.Aggregate):
        keys = [expression(e, df).alias(ir.group_name(e, i)) for i, e in enumerate(p.group_by)]
        aggs = [aggregate(a, df) for a in p.aggregates]
        return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    if isinstance(p, ir.Sort):
        keys = [(c := expression(k.expr, df), c.desc_nulls_last() if k.descending else c.asc_nulls_last())[1] for k in p.keys]
        return df.orderBy(*keys)
    return df.limit(p.n)
