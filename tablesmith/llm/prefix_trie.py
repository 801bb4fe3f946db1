"""Operator 13: conversation prefix trie, its subtree totals by leaf peeling.

A node is a prefix of rebuilt conversations, told by its depth and two 64-bit hashes that are combined turn by turn, so
that a long conversation's prefixes are made in many tasks. A conversation is the smallest member of the nodes at the
end of its path: these nodes are its tail. Tails are the tree's nodes for message passing: each counts the tails that
hang on it and haven't finished; a tail without any sends its totals to the tail it hangs on, round by round, until the
root's has finished. Sums along each tail then give every node its subtree's totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import lookup, materialize, new_path, ordered_sha256, partitions

#: A conversation takes over up to SHARED - 1 turns of the first of every GROUP conversations.
GROUP, SHARED = 20, 4
#: Depths, and conv_ids, whose sums and lists are made at once.
DEPTHS, IDS = 4096, 4096
WORDS = r"[^\x20\x09-\x0D]+"


def light(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest (for the order), two hashes of role and text, and the text's words."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"), F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "text", "role").alias("t2"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"))


def running(rows: DataFrame, key: str, block: str, sums: dict[str, Column], order: Column) -> DataFrame:
    """Adds, for each name, the sum of a column over the key's rows from the first block and the first in order on to
    this one. A block's rows are few; no task holds a key's."""
    within = Window.partitionBy(key, block).orderBy(order)
    before = Window.partitionBy(key).orderBy(F.col(block)).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, block).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    totals = totals.select(key, block, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    made = rows.withColumns({f"_w_{n}": F.sum(c).over(within) for n, c in sums.items()}).join(totals, [key, block])
    return made.select(*rows.columns, *[(F.col(f"_b_{n}") + F.col(f"_w_{n}")).cast("long").alias(n) for n in sums])


def paths(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Light rows -> the rebuilt turns (conv_id, depth, x1, x2: the prefix, p1, p2: the one before it, words, last), and
    the conversations (conv_id, length)."""
    order = [F.asc_nulls_first("turn"), "role", "digest"]
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())  # identical rows are spread
    ranged = materialize(salted.repartitionByRange(partitions(rows.sparkSession), "conv_id", *order, "_salt").withColumn("part", F.spark_partition_id()).drop("_salt"), "turns")
    sizes = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.groupBy("conv_id").agg(F.sum("n").alias("n"))
    base = totals.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")).where(F.col("base") % GROUP == 0)
    told = totals.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % SHARED, "base": F.col("conv_id") - F.col("conv_id") % GROUP}).join(base, "base", "left")
    told = told.withColumn("took", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("length", F.col("took") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    facts = materialize(told.select("conv_id", "base", "h", "took", "length"), "conversations")

    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("conv_id", "part", before.alias("before")).join(facts, "conv_id")  # a row for each range of a conversation
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    placed = ranged.withColumn("_own", place).join(starts, ["conv_id", "part"]).withColumn("place", F.col("before") + F.col("_own"))
    own = placed.where("place > h").withColumn("depth", F.col("place") - F.col("h") + F.col("took"))
    heads = placed.where((F.col("place") < SHARED) & (F.col("conv_id") % GROUP == 0)).select(F.col("conv_id").alias("base"), "place", "t1", "t2", "words")
    heads = heads.join(facts.select("conv_id", "base", "took", "length"), "base").where("place <= took").withColumns({"depth": F.col("place"), "part": F.lit(-1)})  # GROUP conversations to a base at most
    columns = ["conv_id", "part", F.col("depth").cast("long").alias("depth"), F.xxhash64("depth", "t1").alias("e1"), F.xxhash64("depth", "t2").alias("e2"), "words", "length"]
    turns = materialize(own.select(*columns).unionByName(heads.select(*columns)), "rebuilt")

    xor = lambda c, w: F.bit_xor(c).over(w)
    within = Window.partitionBy("conv_id", "part").orderBy("depth")
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = turns.groupBy("conv_id", "part").agg(F.bit_xor("e1").alias("c1"), F.bit_xor("e2").alias("c2"))
    carry = carry.select("conv_id", "part", *[F.coalesce(xor(f"c{k}", ahead), F.lit(0)).alias(f"c{k}") for k in (1, 2)])
    found = turns.withColumns({"w1": xor("e1", within), "w2": xor("e2", within)}).join(carry, ["conv_id", "part"])
    x = {k: F.col(f"c{k}").bitwiseXOR(F.col(f"w{k}")) for k in (1, 2)}
    made = found.select("conv_id", "depth", *[x[k].alias(f"x{k}") for k in x], *[x[k].bitwiseXOR(F.col(f"e{k}")).alias(f"p{k}") for k in x], "words", (F.col("depth") == F.col("length")).alias("last"))
    return materialize(made, "paths"), facts.select("conv_id", "length")


def _key(depth: Column, one: str, two: str) -> Column:
    return F.concat_ws(":", depth, F.when(depth > 0, F.col(one)).otherwise(0), F.when(depth > 0, F.col(two)).otherwise(0))


ROOT = "0:0:0"


def nodes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """key, pkey, conv_id, depth, parent_conv_id, n_convs, n_children, words of every node; no conversation: no node."""
    depth = F.col("depth")
    made = turns.groupBy(_key(depth, "x1", "x2").alias("key")).agg(F.min("depth").alias("depth"), F.min(_key(depth - 1, "p1", "p2")).alias("pkey"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    root = conversations.agg(F.lit(ROOT).alias("key"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("pkey"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.lit(0).cast("long").alias("words")).where("n_convs > 0")
    each = materialize(made.unionByName(root), "nodes")
    kids = each.where("pkey is not null").groupBy("pkey").agg(F.count(F.lit(1)).alias("n"))
    parents = kids.join(each.select(F.col("key").alias("pkey"), F.col("conv_id").alias("parent_conv_id")), "pkey")
    with_parent = lookup(each, parents, "pkey", "n", F.col("key"))
    counted = with_parent.join(kids.select(F.col("pkey").alias("key"), F.col("n").alias("n_children")), "key", "left")
    return materialize(counted.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "tree")


def peel(tails: DataFrame) -> DataFrame:
    """tails (tail, parent, at, saved, leaves: its own) -> the same with its subtree's totals.

    Rounds are as many as tails hang on one another; each passes the totals of the tails that have finished.
    """
    spark = tails.sparkSession
    path = new_path(spark, "peeled")
    waiting = tails.where("parent is not null").groupBy(F.col("parent").alias("tail")).agg(F.count(F.lit(1)).alias("left"))
    active = materialize(tails.join(waiting, "tail", "left").withColumn("left", F.coalesce("left", F.lit(0))), "active")
    while not active.isEmpty():
        ready = active.where("left = 0").drop("left")
        ready.write.mode("append").parquet(path)
        told = ready.where("parent is not null").groupBy(F.col("parent").alias("tail")).agg(F.count(F.lit(1)).alias("_n"), F.sum("saved").alias("_s"), F.sum("leaves").alias("_l"))
        more = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
        rest = active.where("left > 0").join(told, "tail", "left")
        active = materialize(rest.select("tail", "parent", "at", more("saved", "_s"), more("leaves", "_l"), (F.col("left") - F.coalesce("_n", F.lit(0))).alias("left")), "active")
    return spark.read.schema(tails.schema).parquet(path)


def trie(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text, ...) -> a row per node of the trie of rebuilt conversations.

    Turns go by turn, nulls first; those that share a turn by role, then by the MD5 of their text. Null roles and texts
    are empty. Rows without a conv_id belong to no conversation and are left out. Repeated rows are turns each. No
    conversations: no nodes. Further columns are ignored.
    """
    turns, found = paths(light(conversations))
    each = nodes(turns, found)
    each = each.withColumns({"saved": (F.col("n_convs") - 1) * F.col("words"), "leaf": F.when(F.col("n_children") == 0, 1).otherwise(0)})
    tops = each.where("parent_conv_id is null or parent_conv_id <> conv_id").select(F.col("conv_id").alias("tail"), F.col("parent_conv_id").alias("parent"), (F.col("depth") - 1).alias("at"))
    own = each.groupBy(F.col("conv_id").alias("tail")).agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"))
    if each.isEmpty():
        peeled = tops.join(own, "tail")
    else:
        peeled = peel(tops.join(own, "tail"))
    hung = peeled.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("saved").alias("_s"), F.sum("leaves").alias("_l"))
    rows = each.join(hung, ["conv_id", "depth"], "left").withColumn("_up", -F.floor(F.col("depth") / DEPTHS))
    rows = running(rows, "conv_id", "_up", {"saved_tokens": F.col("saved") + F.coalesce("_s", F.lit(0)), "n_leaves": F.col("leaf") + F.coalesce("_l", F.lit(0))}, F.desc("depth"))

    ends = turns.where("last").select(_key(F.col("depth"), "x1", "x2").alias("key"), "conv_id").unionByName(found.where("length = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")  # at most IDS of them
    chunks = ends.groupBy("key", F.floor(F.col("conv_id") / IDS).alias("at")).agg(ids.alias("text"))
    digests = ordered_sha256(chunks, "key", ["at"], "text", ",")
    out = rows.join(digests, "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
