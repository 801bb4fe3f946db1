"""Operator 10 [native]: document fingerprints by consistent weighted sampling.

A document's terms are its words, weighted by how often they occur. For each of SAMPLES positions every term draws two
Gamma(2, 1) variates and a uniform one from hashes of the term and the position; the smallest sampled value stands in
the signature. Two documents agree in a position with a probability equal to the generalised Jaccard similarity of
their weighted terms. DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import materialize, partitions

#: Positions of a fingerprint: a likeness has a standard error of at most 0.5 / sqrt(SAMPLES) = 0.0625 (0.05 at 0.8).
SAMPLES = 64
#: Positions that are drawn for a row of a term at a time: few enough for the generated code of an aggregate to be compiled.
BLOCK = 4
#: Hexadecimal digits of a position of a fingerprint.
DIGITS = 4
#: Bytes of text to a task that samples, as long as that makes at most SPLIT times the shuffle partitions.
TASK_BYTES, SPLIT = 6 << 20, 8
_LEAST = -(2**63)


def terms(text: Column) -> Column:
    """The words of a text: lower case, cut at white space; a text without words has the empty word."""
    found = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def variates(seed: Column, position: int) -> tuple[Column, Column, Column]:
    """What a term (by its seed, a hash) draws: r of Gamma(2, 1), the logarithm of c of Gamma(2, 1), beta of (0, 1).

    Uniform numbers are bits of two hashes: 32 each for r, 24 each for c and 16 for beta.
    """
    one, two = (F.xxhash64(seed.bitwiseXOR(F.lit(2 * position + k).cast("long"))) for k in range(2))
    bits = lambda h, n: h.bitwiseAND(F.lit(2**n - 1).cast("long")) + 0.5
    r = -F.ln(bits(one, 32) * (F.shiftrightunsigned(one, 32) + 0.5) * 2.0**-64)
    c = -F.ln(bits(two, 24) * (F.shiftrightunsigned(two, 40) + 0.5) * 2.0**-48)
    return r, F.ln(c), bits(F.shiftrightunsigned(two, 24), 16) * 2.0**-16


def sample(log_weight: Column, r: Column, log_c: Column, beta: Column) -> Column:
    """The logarithm of the value that a term of this weight draws; equal only for equal terms and levels. The level of
    a weight of 1 is 0, whatever was drawn; null for a null weight."""
    level = F.when(log_weight == 0, 0.0).otherwise(r * F.floor(log_weight / r + beta))
    return log_c - r * (1 - beta) - F.when(log_weight.isNotNull(), level)


def signatures(weighted: DataFrame, keys: list[str], weights: list[str], samples: int = SAMPLES) -> DataFrame:
    """Rows (keys..., term a hash, weights...) -> keys... and a fingerprint named like each weight.

    A weight column has a term's weight in one of the texts of a key, 0 where the text lacks it; what a term draws is
    computed once for all of them. Rows are taken BLOCK positions at a time. Where rows are dealt by one of the keys
    nothing is shuffled.
    """
    blocks = -(-samples // BLOCK)
    rows = weighted.withColumns({f"_l_{w}": F.ln(F.when(F.col(w) > 0, F.col(w).cast("double"))) for w in weights})
    rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_s", F.xxhash64("term", "_b"))
    drawn = rows.drop("term")
    for k in range(BLOCK):
        r, c, beta = variates(F.col("_s"), k)
        drawn = drawn.withColumns({f"_r{k}": r, f"_c{k}": c, f"_e{k}": beta})
    # null, which the minimum passes over, where a text lacks the term
    lows = [F.min(sample(F.col(f"_l_{w}"), F.col(f"_r{k}"), F.col(f"_c{k}"), F.col(f"_e{k}"))).alias(f"_{w}_{k}") for w in weights for k in range(BLOCK)]
    least = drawn.groupBy(*keys, "_b").agg(*lows)
    part = lambda w, k: F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(f"_{w}_{k}"), F.lit(16**DIGITS)))), DIGITS, "0")
    parts = least.select(*keys, "_b", *[F.concat(*[part(w, k) for k in range(BLOCK)]).alias(w) for w in weights])
    whole = lambda w: F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_b", w))), lambda x: x[w]), ""), 1, samples * DIGITS)
    return parts.groupBy(*keys).agg(*[whole(w).alias(w) for w in weights])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of positions in which two fingerprints agree: an estimate of the generalised Jaccard similarity."""
    same = [F.when(F.substring(a, 1 + DIGITS * k, DIGITS) == F.substring(b, 1 + DIGITS * k, DIGITS), 1.0).otherwise(0.0) for k in range(samples)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / samples


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, fingerprint of the whole text; null text as the empty one.

    Equal texts have equal fingerprints, whatever their rows. A null doc_id stays null, rows that share a doc_id and a
    text are fingerprinted once. Further columns are ignored.
    """
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("doc_id", "_t").select("doc_id", "_t", F.explode(terms(F.col("text"))).alias("word"))
    weighted = rows.groupBy("doc_id", "_t", F.xxhash64("word").alias("term")).agg(F.count(F.lit(1)).alias("fingerprint"))
    return signatures(weighted, ["doc_id", "_t"], ["fingerprint"], samples).drop("_t")


def _table(spark: SparkSession, rows: list[dict], kinds: str) -> DataFrame:
    """A small table of these rows, as one literal of the plan."""
    made = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kinds}>>")
    return spark.range(1).select(F.inline(made))


def _ranges(rows: DataFrame, buckets: int) -> DataFrame:
    """Ranges of _key, descending and of about equal numbers of rows, as a table of at most 65 * buckets rows.

    (cell, lo, hi, bucket): a range is listed under each of the cells of equal width that it reaches into, so a row
    finds its range by its cell. Beyond the ids' quantiles (a number a bucket) nothing reaches the driver.
    """
    spark = rows.sparkSession
    ends = rows.agg(F.min("_key").alias("lo"), F.max("_key").alias("hi")).first()
    lo, hi = (ends["lo"], ends["hi"]) if ends["lo"] is not None else (0, 0)
    at = rows.select("_key").stat.approxQuantile("_key", [k / buckets for k in range(1, buckets)], 0.2 / buckets) if buckets > 1 else []
    starts = sorted({lo, *(min(hi, max(lo, int(x))) for x in at)}, reverse=True)
    width = max(1, -(-(hi - lo + 1) // (64 * buckets)))
    made, end = [], hi
    for bucket, start in enumerate(starts):
        made.append({"lo": start, "hi": end, "bucket": bucket})
        end = start - 1
    whole = lambda c: F.floor((F.col(c).cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("long")
    # a range is a literal of the plan; its cells are made by the executors
    table = _table(spark, made, "lo:bigint,hi:bigint,bucket:int").withColumn("cell", F.explode(F.sequence(whole("lo"), whole("hi"))))
    return rows.withColumn("cell", whole("_key")).join(F.broadcast(table), "cell").where(F.col("_key").between(F.col("lo"), F.col("hi"))).drop("cell", "lo", "hi")


def edit_with_next(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> doc_id, text, n_chars, edited, bucket, place; see compare_with_edits.

    Rows are ordered by descending doc_id (null last), then by a hash of the text. Each range of ids is sorted by a
    task of its own; the first row of the next range is added to the end of each. Rows of one doc_id are in one range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_key", F.coalesce("doc_id", F.lit(_LEAST)))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    tasks = max(partitions(spark), min(SPLIT * partitions(spark), -(-size // TASK_BYTES)))
    rows = _ranges(rows, 4 * tasks)
    heads = rows.groupBy("bucket").agg(F.max("_key").alias("_key")).collect()  # a number a range
    order = sorted(r["bucket"] for r in heads)
    before = {b: order[k - 1] for k, b in enumerate(order)}
    turn = _table(spark, [{"bucket": r["bucket"], "_key": r["_key"], "_before": before[r["bucket"]]} for r in heads], "bucket:int,_key:bigint,_before:int")
    sort = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    first = rows.join(F.broadcast(turn), ["bucket", "_key"]).withColumn("_r", F.row_number().over(Window.partitionBy("bucket").orderBy(*sort))).where("_r = 1")
    first = first.select("doc_id", "text", F.col("_before").alias("bucket"), F.lit(True).alias("_tail"))
    # all columns are needed by the sort, so every use of the result has the same exchange, and texts are shuffled once
    both = rows.select("doc_id", "text", "bucket", F.lit(False).alias("_tail")).unionByName(first).repartition(tasks, "bucket")
    w = Window.partitionBy("bucket").orderBy("_tail", *sort)
    placed = both.withColumns({"_next": F.lead("text").over(w), "place": F.row_number().over(w)}).where(~F.col("_tail"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("_next"), F.lit(1), cut))
    return placed.select("doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), "bucket", "place")


def compare_with_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many of the next document in
    descending doc_id (after the last: the first; a single document: itself). Null text is the empty text, whose only
    term is the empty word. Repeated rows are each others' next; no documents: no rows; further columns are ignored.
    """
    keys = ["bucket", "place"]
    placed = edit_with_next(docs)
    facts = placed.select(*keys, "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    words = placed.select(*keys, F.posexplode(F.array("text", "edited")).alias("side", "_t")).select(*keys, "side", F.explode(terms(F.col("_t"))).alias("word"))
    side = lambda s, name: F.count_if(F.col("side") == s).alias(name)
    weighted = words.groupBy(*keys, F.xxhash64("word").alias("term")).agg(side(0, "fingerprint"), side(1, "edited_fingerprint"))
    rows = materialize(facts.join(signatures(weighted, keys, ["fingerprint", "edited_fingerprint"], samples), keys), "fingerprints")
    order = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # a number a range
    turn = _table(docs.sparkSession, [{"bucket": b, "_before": order[k - 1]} for k, b in enumerate(order)], "bucket:int,_before:int")
    heads = rows.where("place = 1").join(F.broadcast(turn), "bucket").select(*[F.col("_before").alias(c) if c == "bucket" else F.lit(2**31 - 1).alias(c) if c == "place" else c for c in rows.columns])
    after = F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("place"))
    both = rows.unionByName(heads).withColumn("_next", after).where(F.col("place") < 2**31 - 1)
    return both.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next"), samples).alias("near_next"),
    )
