"""Mixing sources to target weights: capped water-filling.

Source s has size n_s and weight w_s; the mixture has budget B. A source may be repeated at most
`max_epochs` times, so its share is min(w_s * level, max_epochs * n_s), the level being the one
at which the shares add up to B. Clamping and handing the excess to the others in proportion,
again and again until nothing exceeds its cap, ends at exactly that level; sorted by cap / weight
it takes one pass, since the clamped sources are a prefix of that order.

A document of a source with share r_s * n_s is repeated floor(r_s) times, and once more if its
seeded hash in [0, 1) is below the fraction.

Defined results: null sources are a source of their own; sources without a weight get
`default_weight`; with weight 0 or size 0 they get nothing; a null or negative size counts as 0,
and such a document goes with its source's r_s like any other; if every source is at its cap the
mixture is smaller than the budget; equal rows draw alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seed and cap of the registered query.
SEED, MAX_EPOCHS = 17, 4.0
#: Sources up to which the plan goes to the executors as a literal.
MAP_SOURCES = 2000


def hashed(id_col: Column, seed: int) -> Column:
    """Seeded hash of an id in [0, 1): the first 13 hexadecimal digits of an MD5, which any SQL engine has."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def allocate(sizes: DataFrame, budget: float | None = None, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, size, weight -> source, size, weight, repeats. One row a source, so the window's single
    partition holds no more than the sources; B defaults to the sum of the sizes."""
    live = (F.col("weight") > 0) & (F.col("size") > 0)
    cap, weight = F.when(live, F.col("size") * max_epochs).otherwise(0.0), F.when(live, F.col("weight")).otherwise(0.0)
    everything = Window.partitionBy()
    b = F.lit(float(budget)) if budget is not None else F.sum("size").over(everything).cast("double")
    order = Window.orderBy(F.col("ratio").asc_nulls_last(), F.col("source").asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    d = sizes.withColumn("budget", b).withColumn("cap", cap).withColumn("w", weight).withColumn("ratio", F.when(live, F.col("cap") / F.col("w")))
    d = d.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("left", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    # a source is free if, with all before it clamped, the level stays below its own ratio; the first such level holds for all after it
    d = d.withColumn("level", F.when(F.col("left") > 0, (F.col("budget") - F.col("capped")) / F.col("left")))
    d = d.withColumn("final", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "level"))).over(everything))
    share = F.when(~live, 0.0).when(F.col("final").isNull() | (F.col("ratio") < F.col("final.ratio")), F.col("cap")).otherwise(F.greatest(F.lit(0.0), F.col("w") * F.col("final.level")))
    return d.select("source", "size", "weight", F.when(F.col("size") > 0, share / F.col("size")).otherwise(0.0).alias("repeats"))


def source_sizes(docs: DataFrame, weights: dict[str | None, float], source_col: str = "source", size_col: str = "n_chars", default_weight: float = 1.0) -> DataFrame:
    size = F.sum(F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("double")).alias("size")
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(size)
    weight = F.lit(float(default_weight))
    for source, w in weights.items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(w))).otherwise(weight)
    return sizes.withColumn("weight", weight)


def _drawn(docs: DataFrame, weights: dict, budget: float | None, max_epochs: float, seed: int, id_col: str, source_col: str, size_col: str, default_weight: float) -> tuple[DataFrame, str]:
    """The documents that are drawn, with a column that says how often, and its name. The plan has a row a source.
    Up to MAP_SOURCES of them reach the executors as a literal map, without a join or shuffle of the documents;
    more are joined."""
    plan = allocate(source_sizes(docs, weights, source_col, size_col, default_weight), budget, max_epochs).select("source", "repeats")
    rows = plan.limit(MAP_SOURCES + 1).collect()
    docs = docs.where(F.col(id_col).isNotNull())
    name = "times"
    while name in docs.columns:
        name += "_"
    if len(rows) <= MAP_SOURCES:
        named = [x for r in rows if r["source"] is not None for x in (F.lit(r["source"]), F.lit(float(r["repeats"])))]
        null = next((float(r["repeats"]) for r in rows if r["source"] is None), 0.0)
        found = F.create_map(*named)[F.col(source_col)] if named else F.lit(0.0)
        r = F.when(F.col(source_col).isNull(), F.lit(null)).otherwise(F.coalesce(found, F.lit(0.0)))
    else:
        of = plan.select(F.struct("source", "repeats").alias(name + "of"))
        docs = docs.join(of, F.col(source_col).eqNullSafe(F.col(f"{name}of.source")))
        r = F.col(f"{name}of.repeats")
    times = F.floor(r) + F.when(hashed(F.col(id_col).cast("long"), seed) < r - F.floor(r), 1).otherwise(0)
    return docs.withColumn(name, times.cast("int")).drop(name + "of").where(F.col(name) > 0), name


def copies(docs: DataFrame, weights: dict[str | None, float] | None = None, budget: float | None = None, max_epochs: float = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_chars", default_weight: float = 1.0) -> DataFrame:
    """doc_id, source, copy: a row for each time that a document is in the mixture, copy counting from 1.
    Reads three columns, never the text."""
    drawn, times = _drawn(docs, weights or {}, budget, max_epochs, seed, id_col, source_col, size_col, default_weight)
    return drawn.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.explode(F.sequence(F.lit(1), F.col(times))).alias("copy"))


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, budget: float | None = None, max_epochs: float = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_chars", default_weight: float = 1.0) -> DataFrame:
    """The mixture's documents, as often as they are in it, all columns unchanged."""
    drawn, times = _drawn(docs, weights or {}, budget, max_epochs, seed, id_col, source_col, size_col, default_weight)
    return drawn.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(times)
