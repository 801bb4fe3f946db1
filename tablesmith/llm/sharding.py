"""Operator 8: uniform sharding by a hypergeometric communication matrix.

How many rows of each partition go to each shard is drawn from the multivariate hypergeometric distribution with the
partitions' row counts and the exact shard sizes as margins. A task deals its rows out to the shards in random order
(the local permutation), the rows are exchanged, and every shard is permuted once more by random keys: its blocks are
equal ranges of keys, sorted each by one task. The result is a uniform shuffle with exact shard sizes. A task computes
its own row of the matrix by halving the partitions: at each node of the tree the counts of the left half are drawn from
a generator seeded by the node, so that no process holds the matrix, and a draw has as many columns as there are shards,
whatever the number of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import partitions

#: Rows that a block has at most, about.
BLOCK_ROWS = 50_000
#: numpy draws up to so large a population; larger ones are drawn by _large.
POPULATION = 10**9


#: How many outcomes _large looks at at once, on each side.
WINDOW = 1 << 13


def _stirling(n: int) -> float:
    """log(n!) less Stirling's formula without its series."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n**2) / n**2) / n**2) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, exact also where x is close to mean."""
    d = (x - mean) / (x + mean)
    if abs(d) > 0.1:
        return x * math.log(x / mean) + mean - x
    total, term, k = (x - mean) * d, 2 * x * d, 1
    while True:
        term *= d * d
        more = total + term / (2 * k + 1)
        if more == total:
            return total
        total, k = more, k + 1


def _log_binomial(k: int, n: int, p: float, q: float) -> float:
    """Log probability of k hits in n trials (p + q = 1), by its saddle point, to about 15 digits at any n."""
    if k in (0, n):
        return n * math.log(q if k == 0 else p) if n else 0.0
    centre = _stirling(n) - _stirling(k) - _stirling(n - k) - _deviance(k, n * p) - _deviance(n - k, n * q)
    return centre + 0.5 * (math.log(n / k) - math.log(2 * math.pi) - math.log(n - k))


def log_probability(k: int, good: int, bad: int, sample: int) -> float:
    """Log probability of k good ones in a sample without replacement: binomials whose parameter is the sampled share."""
    n = good + bad
    p, q = sample / n, (n - sample) / n
    return _log_binomial(k, good, p, q) + _log_binomial(sample - k, bad, p, q) - _log_binomial(sample, n, p, q)


def _large(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """A hypergeometric draw by inversion from the mode outwards, for populations beyond numpy's.

    0 < sample < good + bad. Outcomes are gone through in windows, upwards and downwards in turn, until their
    probabilities reach the drawn number, or vanish.
    """
    lo, hi = max(0, sample - bad), min(good, sample)
    mode = min(hi, max(lo, (sample + 1) * (good + 1) // (good + bad + 2)))
    up = down = math.exp(log_probability(mode, good, bad, sample))
    u, top, bottom = rng.random() - up, mode, mode
    while u > 0 and (up > 0 or down > 0):
        k = np.arange(top, min(hi, top + WINDOW), dtype=np.float64)
        p = up * np.cumprod((good - k) * (sample - k) / ((k + 1) * (bad - sample + k + 1)))
        far = np.cumsum(p)
        if len(p) and far[-1] >= u:
            return top + 1 + int(np.searchsorted(far, u))
        u, up, top = u - (far[-1] if len(p) else 0), p[-1] if len(p) else 0.0, top + len(p)
        k = np.arange(bottom, max(lo, bottom - WINDOW), -1, dtype=np.float64)
        p = down * np.cumprod(k * (bad - sample + k) / ((good - k + 1) * (sample - k + 1)))
        far = np.cumsum(p)
        if len(p) and far[-1] >= u:
            return bottom - 1 - int(np.searchsorted(far, u))
        u, down, bottom = u - (far[-1] if len(p) else 0), p[-1] if len(p) else 0.0, bottom - len(p)
    return mode


def draw(rng: np.random.Generator, sizes: np.ndarray, sample: int) -> np.ndarray:
    """How many of `sample` rows, drawn without replacement from columns of these sizes, come from each."""
    out, left, total = np.zeros(len(sizes), np.int64), sample, int(sizes.sum())
    if total < POPULATION:
        return rng.multivariate_hypergeometric(sizes, sample, method="marginals")
    for i, s in enumerate(sizes.tolist()):
        rest = total - s
        out[i] = left if not rest else (rng.hypergeometric(s, rest, left) if total < POPULATION else _large(rng, s, rest, left)) if left and s else 0
        left, total = left - int(out[i]), rest
    return out


def matrix_row(row: int, counts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Row `row` of the communication matrix with margins counts (partitions) and sizes (shards)."""
    before = np.append(0, np.cumsum(counts))
    lo, hi, cols = 0, len(counts), np.asarray(sizes, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = draw(np.random.default_rng([seed, lo, hi]), cols, int(before[mid] - before[lo]))
        lo, hi, cols = (lo, mid, left) if row < mid else (mid, hi, cols - left)
    return cols


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Rows of each shard; they differ by one at most."""
    return np.array([rows // shards + (i < rows % shards) for i in range(shards)], np.int64)


def shuffle_shards(docs: DataFrame, shards: int = 8, seed: int = 42, blocks: int | None = None) -> DataFrame:
    """All rows and columns of docs, plus shard (int, from 0) and slot (long, gapless from 0 in each shard).

    The law is `rows`: shard sizes differ by one at most. A shard is put in order in `blocks` ranges of keys (by default
    so many that all blocks together are the shuffle partitions and none has more than about BLOCK_ROWS rows), each by
    one task. Null and repeated rows are dealt like any other; no rows: no rows. Columns of docs that are called shard or
    slot, in any case, are replaced. docs must give the same partitions whenever it is computed, as a scan of
    files or a written table does: a task that meets another number of rows than was counted fails.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "slot", "_block", "_key", "_before")])

    def count(batches):
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sum(b.num_rows for b in batches)], pa.int64())], names=["p", "n"])

    found = {r["p"]: r["n"] for r in docs.select(docs.columns[:1]).mapInArrow(count, "p int, n long").collect()}  # a number a partition
    counts = np.array([found.get(i, 0) for i in range(max(found, default=-1) + 1)], np.int64)
    total = int(counts.sum())
    blocks = blocks or max(1, -(-partitions(spark) // shards), -(-total // (shards * BLOCK_ROWS)))
    sizes = shard_sizes(total, shards)
    held, names = spark.sparkContext.broadcast(counts), list(docs.columns)

    def dealing(own):
        """The blocks and keys of the rows of partition `own`, the same whenever they are asked for."""
        n = int(held.value[own]) if own < len(held.value) else 0
        rng = np.random.default_rng([seed, own, 1])
        to = np.repeat(np.arange(shards, dtype=np.int64), matrix_row(own, held.value, sizes, seed)) if n else np.zeros(0, np.int64)
        rng.shuffle(to)
        key = rng.integers(0, 2**62, n)
        return to * blocks + key // -(-(2**62) // blocks), key

    def deal(batches):
        own, done = TaskContext.get().partitionId(), 0
        to, key = dealing(own)
        for batch in batches:
            here = slice(done, done := done + batch.num_rows)
            if done > len(to):
                break
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to[here]), pa.array(key[here])], names=[*names, "_block", "_key"])
        if done != len(to):
            raise RuntimeError("docs gave other partitions than when its rows were counted; write it as a table first")

    def lengths(batches):
        """How many rows each block gets from each partition; no row of docs is read for it."""
        for batch in batches:
            for own in batch.column(0).to_pylist():
                block, n = np.unique(dealing(own)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(n)], names=["_block", "n"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    dealt = docs.mapInArrow(deal, f"{kinds}, _block long, _key long")
    shard = F.expr(f"_block div {blocks}").cast("int")
    # a block has so many rows before it in its shard: a window over the blocks' numbers only
    length = spark.range(0, len(counts), 1, max(1, min(len(counts), partitions(spark)))).mapInArrow(lengths, "_block long, n long").groupBy("_block").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = length.select("_block", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy("_key")) - 1
    placed = dealt.withColumn("slot", place).join(starts, "_block")
    return placed.select(*docs.columns, shard.alias("shard"), (F.col("slot") + F.col("_before")).alias("slot"))


def digests(sharded: DataFrame) -> DataFrame:
    """Of sharded documents (doc_id, text, shard, slot) the sizes and checksums of their texts; null text: size 1."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return sharded.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
