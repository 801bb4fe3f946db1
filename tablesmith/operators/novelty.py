"""Saturation by novel entities: how many of a batch's entities no earlier batch of the run had."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Size of a sketch: 2 ** LG_K registers, for a standard error of about 0.83 / sqrt(2 ** LG_K).
LG_K = 12


def sketches(rows: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """rows (run_id, batch, key) -> run_id, batch, total_rows, sketch of the keys; sketches of parts can be merged."""
    return rows.groupBy("run_id", "batch").agg(F.count(F.lit(1)).alias("total_rows"), F.hll_sketch_agg("key", lg_k).alias("sketch"))


def novel(rows: DataFrame, exact: bool = True, lg_k: int = LG_K) -> DataFrame:
    """rows (run_id, batch, key) -> run_id, batch, total_rows, new_rows: keys that no earlier batch of the run has.

    Exact: each key counts for the first batch that has it (a partial minimum, so hot keys are combined before the
    shuffle). Otherwise from mergeable sketches: the growth of the estimate of all keys so far; only a sketch of a few
    KB a batch is kept. Null keys are rows but no entities.
    """
    if exact:
        totals = rows.groupBy("run_id", "batch").agg(F.count(F.lit(1)).alias("total_rows"))
        first = rows.where("key is not null").groupBy("run_id", "key").agg(F.min("batch").alias("batch"))
        new = first.groupBy("run_id", "batch").agg(F.count(F.lit(1)).alias("new_rows"))
        return totals.join(new, ["run_id", "batch"], "left").withColumn("new_rows", F.coalesce("new_rows", F.lit(0)))
    each = sketches(rows, lg_k)
    ahead = Window.partitionBy("run_id").orderBy("batch")
    so_far = each.withColumn("_n", F.hll_sketch_estimate(F.hll_union_agg("sketch").over(ahead.rowsBetween(Window.unboundedPreceding, 0))))
    return so_far.select("run_id", "batch", "total_rows", F.greatest(F.lit(0), F.col("_n") - F.coalesce(F.lag("_n").over(ahead), F.lit(0))).alias("new_rows"))


def saturation_stop(rows: DataFrame, least: float, exact: bool = True) -> DataFrame:
    """The batches up to the one after which the run is saturated: fewer than `least` of its rows are novel entities."""
    marked = novel(rows, exact).withColumn("saturated", F.col("new_rows") / F.col("total_rows") < least)
    stop = marked.where("saturated").groupBy("run_id").agg(F.min("batch").alias("_stop"))
    return marked.join(stop, "run_id", "left").where("_stop is null or batch <= _stop").drop("_stop")
