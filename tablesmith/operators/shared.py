"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder (spark.checkpoint.dir) that no other call returns. Where that is unset, a folder of
    this machine serves a session whose executor is the driver itself (tests); any other session is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 2_000, size: int = 4_000_000) -> None:
    """Lower the session's Arrow batches, so that a worker's memory doesn't follow the size of pages. Smaller settings
    of the session's own stay."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, most)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df written as Parquet, with the writer's options, and read back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_and_counted(df: DataFrame, name: str, counts: dict[str, Column]) -> tuple[DataFrame, dict]:
    """As written, with aggregates of the rows that come from the pass that writes them."""
    seen = Observation()
    made = written(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), name)
    return made, seen.get
