"""Operator 11: sum-of-squares online packing.

Documents arrive in the order of the table and are placed at once. Each task is a lane with a level array: how many of
its windows are filled to each level. A document goes to the level (or a new window) after which the sum of the squares
of these counts, full windows aside, is least. Windows that lanes leave open are themselves placed once more by the same
rule, whole, in groups of bounded size. What is open even then is laid end to end and cut at the capacity, the rest at
powers of two, so that nothing is padded and few documents are cut.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import materialize, small_batches
from tablesmith.llm.packing import _encoder, _slices

CAPACITY, END_ID = 4096, 2
#: Bytes of ids in open windows at which a lane ends and the next begins, so that a task's memory is bounded.
HELD_BYTES = 48 << 20
#: Open windows to a group that is placed anew by one task.
GROUP = 50_000
#: Rows and bytes of a batch that a task gives back.
OUT_ROWS, OUT_BYTES = 2_000, 4 << 20
#: Where the numbers of sequences made of several lanes' windows, and of those cut from the rest, begin.
MERGED, CUT = 1 << 61, 1 << 62
_FAR = 1 << 60
_PLACED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("level", pa.int64())])


class Levels:
    """Windows by the level to which they are filled, and the array of their counts."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.windows: dict[int, list[int]] = {}
        # what a window adds to the sum of squares by leaving a level, and by entering one; full ones don't count
        self.leave = np.full(capacity + 1, _FAR, np.int64)
        self.enter = np.ones(capacity + 1, np.int64)
        self.leave[0] = self.enter[capacity] = 0

    def _count(self, level: int, change: int) -> None:
        if 0 < level < self.capacity:
            self.enter[level] += 2 * change
            n = int(self.enter[level]) // 2
            self.leave[level] = 1 - 2 * n if n else _FAR

    def place(self, size: int, new: int) -> tuple[int, int]:
        """Put an item in the window that makes the sum of squares least, the fullest of equally good ones, or in the
        new one. Returns the window and the level at which the item begins."""
        cost = self.leave[: self.capacity - size + 1] + self.enter[size:]
        level = self.capacity - size - int(cost[::-1].argmin())
        window = self.windows[level].pop() if level else new
        self._count(level, -1)
        self._count(level + size, 1)
        if level + size < self.capacity:
            self.windows.setdefault(level + size, []).append(window)
        return window, level


def placements(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Every document's ids (and end_id) in windows: doc_id, start, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, and the level to which the lane has filled the window in the end."""
    small_batches(docs.sparkSession)
    end = array("I", [end_id]).tobytes()

    def run(batches) -> Iterator[pa.RecordBatch]:
        encode, number = _encoder(tokenizer_path), TaskContext.get().partitionId() << 32
        levels, opened, held, out, size = Levels(capacity), {}, 0, [], 0

        def batch() -> pa.RecordBatch:
            nonlocal out, size
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PLACED, strict=True)], schema=_PLACED)
            out, size = [], 0
            return made

        def close(window: int, level: int) -> None:
            nonlocal held, size
            for doc_id, start, ids, tokens, offset in opened.pop(window):
                out.append((doc_id, start, ids, tokens, window, offset, level))
                held, size = held - len(ids), size + len(ids)

        def close_all() -> None:
            for level, windows in levels.windows.items():
                for w in windows:
                    close(w, level)

        for rows in batches:
            for doc_ids, texts in _slices(rows):
                for doc_id, data in zip(doc_ids, encode(texts), strict=True):
                    data += end
                    n = len(data) // 4
                    for at in range(0, n, capacity):
                        ids = data[4 * at : 4 * (at + capacity)]
                        number += 1
                        window, level = levels.place(len(ids) // 4, number)
                        opened.setdefault(window, []).append((doc_id, at, ids, n, level))
                        held += len(ids)
                        if level + len(ids) // 4 == capacity:
                            close(window, capacity)
                    if held > held_bytes:
                        close_all()
                        levels = Levels(capacity)
                    if len(out) >= OUT_ROWS or size >= OUT_BYTES:
                        yield batch()
        close_all()
        if out:
            yield batch()

    kinds = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, level long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kinds)


def refit(opened: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Open windows (sequence_id, level) -> sequence_id, group, target (the sequence that takes the window, null if it
    is to be cut), shift (where the window begins in the target, or in what is cut of its group).

    Windows are placed largest first; those that end at a power of two need no padding and stay.
    """
    groups = max(1, math.ceil(opened.count() / group))
    rows = opened.withColumn("group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).cast("long"))

    def run(table: pa.Table) -> pa.Table:
        levels, number, items, filled = Levels(capacity), 0, [], {}
        own = table.column("group")[0].as_py()
        for size, window in sorted(zip(table.column("level").to_pylist(), table.column("sequence_id").to_pylist(), strict=True), key=lambda x: (-x[0], x[1])):
            number += 1
            target, shift = levels.place(size, number)
            items.append((window, target, shift))
            filled[target] = shift + size
        base, at = {}, 0
        for target, level in filled.items():
            if level & (level - 1) and level < capacity:
                base[target] = at
                at += level
        made = [(w, own, None if t in base else MERGED + (own << 32) + t, s + base.get(t, 0)) for w, t, s in items]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], names=["sequence_id", "group", "target", "shift"])

    return rows.select("group", "sequence_id", "level").groupBy("group").applyInArrow(run, "sequence_id long, group long, target long, shift long")


def _parts(at: Column, end: Column, capacity: int, full: int, tail: list[int]) -> Column:
    """Where [at, end) of what is cut falls in: structs (at, end, first), first where the sequence begins. The first
    `full` positions are cut at the capacity, the rest at the positions in tail."""
    tails = F.array(*[F.lit(x).cast("long") for x in tail])
    steps = F.transform(F.sequence(F.floor(at / capacity), F.floor((end - 1) / capacity)), lambda k: k * capacity)
    starts = F.concat(F.filter(steps, lambda x: x < full), F.filter(tails, lambda x: x < end))
    own = F.array_sort(F.array_union(F.array(at), F.filter(starts, lambda x: x > at)))
    first = lambda x: F.greatest(F.coalesce(F.array_max(F.filter(tails, lambda y: y <= x)), F.lit(0)), F.least(F.floor(x / capacity) * capacity, F.lit(full)))
    return F.transform(own, lambda x, i: F.struct(x.alias("at"), F.coalesce(F.get(own, i + 1), end).alias("end"), first(x).alias("first")))


def pack_online(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, start, length, ids, doc_tokens, sequence_id, offset: a row per piece.

    A sequence holds at most `capacity` ids; every sequence that isn't full has a power of two of them, so none is
    padded. Null or empty text: only end_id. Documents longer than the capacity are cut into full windows and a rest; a
    null doc_id stays null, repeated rows are packed each. No documents: no rows. Further columns are ignored.
    """
    placed = materialize(placements(docs, tokenizer_path, capacity, end_id), "windows")
    opened = placed.where(F.col("level") < capacity)
    heads = opened.where("offset = 0").select("sequence_id", "level")  # one row of each open window
    fitted = materialize(refit(heads, capacity), "refit").withColumnRenamed("sequence_id", "_w")
    sizes = opened.join(fitted, F.col("sequence_id") == F.col("_w")).select(*placed.columns, "group", "target", "shift")
    rest = heads.join(fitted.where("target is null"), F.col("sequence_id") == F.col("_w")).groupBy("group").agg(F.sum("level").alias("n"))
    rest = materialize(rest, "rest")  # a row for each GROUP open windows
    total = rest.agg(F.sum("n")).first()[0] or 0
    before = F.coalesce(F.sum("n").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = rest.select(F.col("group").alias("_g"), before.alias("_base"))

    full, tail, at = total // capacity * capacity, [], total // capacity * capacity
    for bit in reversed(range(capacity.bit_length())):
        if (total - full) >> bit & 1:
            tail.append(at)
            at += 1 << bit
    cut = sizes.where("target is null").join(bases, F.col("group") == F.col("_g")).withColumn("_at", F.col("_base") + F.col("shift") + F.col("offset"))
    cut = cut.withColumn("_p", F.explode(_parts(F.col("_at"), (F.col("_at") + F.octet_length("ids") / 4).cast("long"), capacity, full, tail)))
    moved = F.col("_p.at") - F.col("_at")
    of_ids = lambda x: F.substring(F.col("ids"), (4 * moved + 1).cast("int"), x.cast("int"))
    columns = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]
    cut = cut.select("doc_id", (F.col("start") + moved).alias("start"), of_ids(4 * (F.col("_p.end") - F.col("_p.at"))).alias("ids"), "doc_tokens", (F.lit(CUT) + F.col("_p.first")).alias("sequence_id"), (F.col("_p.at") - F.col("_p.first")).alias("offset"))
    merged = sizes.where("target is not null").select("doc_id", "start", "ids", "doc_tokens", F.col("target").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    whole = placed.where(F.col("level") == capacity).select(*columns)
    made = whole.unionByName(merged.select(*columns)).unionByName(cut.select(*columns))
    return made.withColumn("length", (F.octet_length("ids") / 4).cast("long"))


def digests(packed: DataFrame) -> DataFrame:
    """The packed pieces with a checksum in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
