"""What the operators of this subpackage share: the shared folder, materialised tables, skew-safe lookups."""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that a lookup broadcasts at most; see :func:`lookup`.
HEAVY_KEYS = 1_000
#: Rows and bytes of a batch that Python workers get at most; see :func:`small_batches`.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of this machine
    serves a session whose executor is the driver itself (tests); any other session is refused."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches, so that a worker's memory follows neither the rows of a partition nor, but for
    a single longer one, the size of texts. Smaller settings of the session's own stay."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")
    if not (size.isdigit() and 0 < int(size) <= BATCH_BYTES):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call returns."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions, by which hot groups are split."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, spread: Column) -> DataFrame:
    """left LEFT JOIN right on key, where a few keys may hold most rows of left.

    right has one row per key; weight (dropped) says how many rows of left have it. The HEAVY_KEYS heaviest keys are
    broadcast (at most that many rows of right); rows that they settle, and rows whose key is null, enter the second,
    shuffled join under a key of their own made from spread, so that no task receives a hot key. Any other key holds
    at most 1/HEAVY_KEYS of the rows.
    """
    values = [c for c in right.columns if c not in (key, weight)]
    heavy = right.where(F.col(weight) > 1).orderBy(F.desc(weight), F.asc(key)).limit(HEAVY_KEYS)
    heavy = heavy.select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in values])
    first = left.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left")
    settled = F.col("_hk").isNotNull() | F.col(key).isNull()
    first = first.withColumn("_jk", F.when(settled, F.concat(F.lit("\u0000"), F.xxhash64(spread).cast("string"))).otherwise(F.col(key).cast("string")))
    rest = right.select(F.col(key).cast("string").alias("_rk"), *[F.col(c).alias(f"_r_{c}") for c in values])
    joined = first.join(rest, F.col("_jk") == F.col("_rk"), "left")
    return joined.select(*left.columns, *[F.coalesce(F.col(f"_h_{c}"), F.col(f"_r_{c}")).alias(c) for c in values])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (node, component), component the smallest node reachable.

    Alternates large-star and small-star rounds (each a group-by) until no link changes; every round is written to the
    shared folder. Nodes without a link do not appear. Hot nodes are spread by the partial minimum of each group-by.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "links")
    seen = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours of u are hung on the smallest node that u sees
        large = lookup(both, low, "u", "n", F.struct("u", "v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are hung on the smallest of them
        low2 = large.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("m"))
        hung = lookup(large, low2, "u", "n", F.struct("u", "v"))
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small, "links")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).distinct()



def ordered_sha256(chunks: DataFrame, key: str, order: list[str], text: str, between: str) -> DataFrame:
    """chunks (key string, order..., text) -> key, sha256: of a key's texts in this order, with `between` between them.

    A digest needs its bytes in turn, so a key's chunks pass one task; they are sorted by Spark and streamed, and the
    task holds a batch of them at a time.
    """
    def run(batches):
        now, digest = None, None
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is not None and k == now:
                    digest.update(between.encode())
                else:
                    if digest is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = k, hashlib.sha256()
                digest.update(t.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(2)], names=["key", "sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (now, digest.hexdigest())], names=["key", "sha256"])

    rows = chunks.repartition(partitions(chunks.sparkSession), key).sortWithinPartitions(key, *order)
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, "key string, sha256 string")
