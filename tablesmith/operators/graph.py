"""Connected components, and entities that any of several keys joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.operators.shared import written

#: A node with more than 1/HOT of all edges is hot; there are fewer than HOT + 1 of them, so their rows can be broadcast.
HOT = 1_000


def to_least(edges: DataFrame) -> DataFrame:
    """Adds least, the smallest b of each a, to edges (a, b) in which a few nodes may have most of the edges."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n"))
    total = edges.count()
    hot = least.where(F.col("n") * HOT > total).select(F.col("a").alias("_h"), F.col("least").alias("_l"))
    first = edges.join(F.broadcast(hot), F.col("a") == F.col("_h"), "left")
    rest = least.where(F.col("n") * HOT <= total).select("a", "least")
    settled = first.where("_h is not null").select("a", "b", F.col("_l").alias("least"))
    return settled.unionByName(first.where("_h is null").select("a", "b").join(rest, "a"))


def components(edges: DataFrame) -> DataFrame:
    """Undirected edges (a, b) -> node, component: the smallest node that can be reached. Nodes without an edge to
    another don't appear.

    Stars are contracted in turn: each node's larger neighbours are hung on the smallest node it sees, then its smaller
    ones, until every node hangs on its component's smallest. Each round is written.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = written(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        seen = to_least(both).withColumn("least", F.least("a", "least"))
        large = written(seen.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct(), "large")
        small = to_least(large)
        hung = small.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(small.select("a", F.col("least").alias("b")))
        now = written(hung.where("a <> b").distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("node")))


def same_by_keys(rows: DataFrame, seq: str, keys: dict[str, Column]) -> DataFrame:
    """rows -> with leader: the smallest seq of all rows that are the same by any chain of equal keys.

    Null and empty keys join nothing; equal values of different keys don't either. A value links each of its rows with
    its first row, so links are as many as rows; a value that a third of all rows have is no heavier than others.
    """
    told = F.array(*[F.struct(F.lit(n).alias("k"), c.cast("string").alias("v")) for n, c in keys.items()])
    each = written(rows.select(F.col(seq).alias("b"), F.explode(told).alias("_k")).where("_k.v <> ''").select(F.concat_ws("=", "_k.k", "_k.v").alias("a"), "b"), "keys")
    links = to_least(each).where("b <> least").select("b", F.col("least").alias("a"))
    label = components(links).select(F.col("node").alias(seq), F.col("component").alias("leader"))
    return rows.join(label, seq, "left").withColumn("leader", F.coalesce("leader", seq))


def merged_by_url(rows: DataFrame, url: str, fields: list[str]) -> DataFrame:
    """rows (seq, confidence, source_url, fields...) that share a URL -> one row a URL; rows without one stay."""
    from tablesmith.operators.dedup import merge_groups

    key = F.when(F.coalesce(F.col(url), F.lit("")) != "", F.concat(F.lit("u"), F.col(url))).otherwise(F.concat(F.lit("s"), F.col("seq")))
    return merge_groups(rows.withColumn("_url", key), "_url", fields).drop("_url")
