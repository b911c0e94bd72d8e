"""Mixing sources to target weights: weighted sampling without replacement into budgets of words.

Each document draws an exponential key divided by its quality weight (Efraimidis and Spirakis); in the order of keys, a source's documents form
a random order in which good ones tend to come first.  Sources share a budget by weight; a source's share ends at `epochs` times its size and
what is above is shared again among the others.  A source's target is filled by complete epochs, then by the documents first in key order whose
running size stays inside what is left; the document at the border gives the words that are still missing.

Running sizes don't need a source in one task: the key is cut into fixed intervals, their sums are added up, and only inside an interval are
documents put in order.  Keys come from a hash of the id, so reruns agree.

Defined results: a null text has size 0; documents of size 0 take 0; a null source is a source; null ids and repeated rows draw by their
number among equals; ties in the key are broken by id and size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.tables import settled

WORD = r"[^\x20\x09-\x0D]+"
#: Intervals of the key; a source's documents spread evenly over them.
INTERVALS = 1024
#: Weights of sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    """A weight between 0.5 and 1.5: texts whose words have the length of natural words get more."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.when(mean.between(3.5, 12.0), 1.5).otherwise(0.5)


def budgets(sizes: DataFrame, share: float, epochs: int, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes: source, source_size.  Adds weight and target.  The table has a row for each source, no more."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    known = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    # Sources reach their limit in the order of limit / weight.  A level l gives each source min(limit, l * weight); the level that spends the
    # budget is found at the first source that doesn't reach its limit.
    known = known.withColumn("cap", F.col("source_size") * float(epochs)).withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * share)
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    known = known.withColumn("spent", F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    known = known.withColumn("left", F.col("budget") - F.coalesce("spent", F.lit(0.0))).withColumn("w", F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    known = known.withColumn("level", F.col("left") / F.col("w"))
    level = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(Window.partitionBy())
    known = known.withColumn("final", level["level"])
    return known.select("source", "source_size", "weight", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, *, share: float = 1.5, epochs: int = 2, seed: int = 17) -> DataFrame:
    """docs: doc_id, source, size (long), quality (double), digest (binary) if ids may repeat.  Returns these but quality, with source_size,
    target, taken, pick_key: one row per row of docs, which should be a stored table, as it is read twice."""
    given = [c for c in ("doc_id", "digest", "source", "size") if c in docs.columns]
    docs = docs.select(*given, "quality")
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double")
    key = -F.log((draw + 0.5) / float(1 << 48)) / F.col("quality")
    cell = F.floor(INTERVALS * (1 - F.exp(-F.col("pick_key")))).cast("int")
    docs = docs.withColumn("pick_key", key).withColumn("cell", cell)
    cells = settled(docs.groupBy("source", "cell").agg(F.sum("size").alias("n")))
    goals = settled(budgets(cells.groupBy("source").agg(F.sum("n").alias("source_size")), share, epochs))
    run = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    at = cells.withColumn("before_cell", F.coalesce(F.sum("n").over(run), F.lit(0))).drop("n").withColumnsRenamed({"source": "s", "cell": "c"})
    goals = goals.withColumnRenamed("source", "g")
    at = settled(at.join(goals, F.col("s").eqNullSafe(F.col("g"))).drop("g", "weight"))
    inner = Window.partitionBy("source", "cell").orderBy("pick_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = docs.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    out = ranked.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.floor(F.col("target") + 0.5).cast("long") - whole * F.col("source_size")
    taken = whole * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), left - F.col("before_cell") - F.col("inside")))
    return out.select(*given, "source_size", "target", taken.cast("long").alias("taken"), "pick_key")
