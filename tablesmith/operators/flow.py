"""Ranks, batches, early stop, budgets and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: list, name: str, buckets: int = 64) -> DataFrame:
    """Adds a global row number from 0 in the given order without sending all rows to one task.

    Rows are range-partitioned by the order; each range is numbered by itself and moved by the sizes of those before it.
    """
    spark = rows.sparkSession
    n = min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id())
    from tablesmith.operators.shared import written

    ranged = written(ranged, "ranges")
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_own")).drop("_p", "_own", "_before")


def stop_reason(rows: Column, cost: Column, elapsed: Column, new: Column, total: Column, limits: dict) -> Column:
    """Why a run stops after these totals (new and total are the last batch's), or null."""
    spent = F.when(total > 0, new / total)
    return (
        F.when(rows >= limits["target_rows"], "target_reached").when(cost >= limits["max_cost_micros"], "budget_exhausted")
        .when(elapsed >= limits["max_seconds"], "time_limit").when((spent < limits["saturation"]) & (rows > 0), "saturated")
    )


def early_stop(batches: DataFrame, limits: dict, run: str = "run_id") -> DataFrame:
    """The batches (run, seq, new_rows, total_rows, cost_micros, elapsed_s) up to the one after which the run stops."""
    w = Window.partitionBy(run).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(run).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    totals = batches.withColumns({"rows_so_far": F.sum("new_rows").over(w), "cost_so_far": F.sum("cost_micros").over(w)})
    marked = totals.withColumn("reason", stop_reason(F.col("rows_so_far"), F.col("cost_so_far"), F.col("elapsed_s"), F.col("new_rows"), F.col("total_rows"), limits))
    return marked.withColumn("_stopped", F.coalesce(F.count("reason").over(before), F.lit(0))).where("_stopped = 0").drop("_stopped")


def llm_micros(prompt: Column, completion: Column, legacy: bool = False) -> Column:
    """Micro-dollars of a model call at 0.15 and 0.60 dollars a million tokens, 1 at least; legacy: truncated per term."""
    if legacy:
        return F.greatest(F.lit(1), F.floor(prompt * 150 / 1_000_000) + F.floor(completion * 600 / 1_000_000)).cast("long")
    return F.greatest(F.lit(1), F.ceil((prompt * 15 + completion * 60) / 100)).cast("long")


def budget(calls: DataFrame, max_micros: int) -> DataFrame:
    """calls (kind llm or search, prompt, completion) -> one row of usage and what is left."""
    cost = F.when(F.col("kind") == "llm", llm_micros(F.col("prompt"), F.col("completion"))).when(F.col("kind") == "search", 5000).otherwise(0)
    out = calls.agg(F.sum(cost).cast("long").alias("spent"), F.count(F.when(F.col("kind") == "llm", 1)).alias("llm_calls"), F.count(F.when(F.col("kind") == "search", 1)).alias("search_calls"))
    return out.withColumns({"remaining": F.greatest(F.lit(0), max_micros - F.col("spent")), "exceeded": F.col("spent") >= max_micros, "warn": F.col("spent") * 5 > max_micros * 4})
