"""Duplicate handling: first row per key, fuzzy entity groups, field-level merging."""

from __future__ import annotations

import array
import functools
import itertools
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.operators.shared import written, written_and_counted

THRESHOLD = 0.85
#: Characters of a segment from which names are told by segments; keys and pairs that a task sends on at a time.
SEGMENT, KEYS = 6, 50_000
#: Characters of a segment with gaps from which names are told by such segments; names and characters of a block of them,
#: blocks of fewer names, pairs that are looked at a time, and a step's cost in pairs.
GAPPED, NAMES, CHARS, FEW, PAIRS, STEP = 3, 32_768, 2_500_000, 8, 200_000, 2_000
#: Classes of characters, a multiple of 16, whose counts in half a name are sketched.
CLASSES = 32
#: Columns of a matrix of trigrams; names of a block, those compared with a block at a time, blocks of fewer names, and
#: tasks that compare blocks at most.
GRAMS, BLOCK, TILE, BLOCKS, TASKS = 1_024, 4_096, 256, 16, 1_000


def first_by_key(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key in the given order (by a partial minimum, so hot keys are combined before the shuffle)."""
    best = F.min(F.struct(*[F.col(c) if isinstance(c, str) else c for c in order], F.struct(*[F.col(c) for c in rows.columns]).alias("_row")))
    return rows.groupBy(key).agg(best.alias("_b")).select("_b._row.*")


def anti_seen(rows: DataFrame, seen: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key that no row of the history has; rows without a key go."""
    return first_by_key(rows.where(F.col(key).isNotNull()), key, order).join(seen.select(key).distinct(), key, "left_anti")


def damerau(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance in characters."""
    last: dict[str, int] = {}
    top = len(a) + len(b)
    d = [[top] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        at = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), at
            same = a[i - 1] == b[j - 1]
            if same:
                at = j
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[-1][-1]


def _damerau_all(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else damerau(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def damerau_distance(a: str, b: str) -> Column:
    return F.pandas_udf(_damerau_all, "int")(F.col(a), F.col(b))


def _edits(n: int, threshold: float) -> int:
    """Insertions, deletions and substitutions that a similar name can differ by (a transposition is two)."""
    return 2 * math.floor((1 - threshold) * n + 1e-9)


def _by_segments(short: int, long: int, threshold: float) -> bool:
    """Whether names of these lengths are similar only if they share a segment of at least SEGMENT characters."""
    return short // (_edits(long, threshold) + 1) >= SEGMENT


def _partners(n: int, threshold: float) -> range:
    """The lengths of names that can be similar to one of n characters."""
    return range(math.ceil(threshold * n - 1e-9), math.floor(n / threshold + 1e-9) + 1)


def _signatures(threshold: float, longer: bool):
    """Keys that similar names share: with e edits, one of e + 1 segments of the shorter name stands in the longer."""

    def keys(name: str):
        n = len(name)
        for m in _partners(n, threshold):
            if (m > n) if longer else (m < n):
                continue
            short, long = (m, n) if longer else (n, m)
            if not _by_segments(short, long, threshold):
                continue
            e = _edits(long, threshold)
            size, extra, at = short // (e + 1), short % (e + 1), 0
            for i in range(e + 1):
                w = size + (i >= e + 1 - extra)
                for s in range(max(0, at - e), min(long - w, at + e) + 1) if longer else (at,):
                    yield f"{short} {long} {i} {name[s : s + w]}"
                at += w

    def run(frames):
        for f in frames:
            each = ((n, k) for n in f["name"] for k in dict.fromkeys(keys(n)))
            while made := list(itertools.islice(each, KEYS)):
                yield pd.DataFrame(made, columns=["name", "key"])

    return run


def _by_gaps(short: int, long: int, threshold: float) -> bool:
    """Whether names of these lengths are told by segments with gaps: they share none of SEGMENT characters, but one of
    GAPPED. Without an operation only equal names are similar."""
    k = _edits(long, threshold) // 2
    return k > 0 and not _by_segments(short, long, threshold) and (long - k) // (k + 1) >= GAPPED


def _by_products(short: int, long: int, threshold: float) -> bool:
    return _edits(long, threshold) > 0 and not _by_segments(short, long, threshold) and not _by_gaps(short, long, threshold)


@functools.cache
def _any_partner(n: int, threshold: float, told: Callable[[int, int, float], bool]) -> bool:
    """Whether a name of n characters can be similar to one from which it is told in this way."""
    return any(told(min(m, n), max(m, n), threshold) for m in _partners(n, threshold))


def _grams(threshold: float):
    """Names that can be similar to some that share no segment of either kind, with their trigrams (the second of a kind
    is another than the first) as numbers below GRAMS."""

    def numbers(name: str) -> bytes:
        seen: Counter[str] = Counter()
        out = array.array("H")
        for k in range(len(name) - 2):
            g = name[k : k + 3]
            out.append(zlib.crc32(g.encode(), seen[g]) % GRAMS)
            seen[g] += 1
        return out.tobytes()

    def run(frames):
        for f in frames:
            made = [(n, len(n), numbers(n)) for n in f["name"] if _any_partner(len(n), threshold, _by_products)]
            yield pd.DataFrame(made, columns=["name", "n", "grams"])

    return run


def _in_blocks(threshold: float):
    """Pairs of two blocks (or of one) that can be similar: enough trigrams in common, told by products of counts.

    An insertion, deletion or replacement takes 3 trigrams of the longer name at most, a transposition 4. Numbers that
    trigrams share only make a product greater, so no pair is lost.
    """

    def counts(grams: list[bytes]) -> np.ndarray:
        at = np.repeat(np.arange(len(grams)), [len(g) // 2 for g in grams])
        flat = at * GRAMS + np.frombuffer(b"".join(grams), np.uint16)
        return np.bincount(flat, minlength=len(grams) * GRAMS).reshape(-1, GRAMS).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        i, j, own = t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("p").to_numpy()
        left, right = (t.filter(pa.array(own == x)) for x in (i, j))
        names, others = left.column("name").combine_chunks(), right.column("name").combine_chunks()
        wide, n, m = counts(right.column("grams").to_pylist()).T, left.column("n").to_numpy(), right.column("n").to_numpy()
        top = int(max(n.max(initial=0), m.max(initial=0)))
        most = np.array([_edits(x, threshold) // 2 for x in range(top + 1)])
        by_gaps = np.array([_by_gaps(0, x, threshold) for x in range(top + 1)])
        for k in range(0, len(n), TILE):
            longest, shortest = (f(n[k : k + TILE, None], m[None]) for f in (np.maximum, np.minimum))
            allowed = most[longest]
            near = (counts(left.column("grams")[k : k + TILE].to_pylist()) @ wide >= longest - 2 - 4 * allowed) & (shortest >= longest - allowed)
            a, b = np.nonzero(near)
            a += k
            apart = a < b if i == j else np.ones(len(a), bool)
            apart &= shortest[a - k, b] // (2 * allowed[a - k, b] + 1) < SEGMENT  # others are told by segments
            apart &= (allowed[a - k, b] > 0) & ~by_gaps[longest[a - k, b]]
            a, b = a[apart], b[apart]
            for s in range(0, len(a), KEYS):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a[s : s + KEYS])), others.take(pa.array(b[s : s + KEYS]))], names=["x", "y"])

    return run


def _block_pairs(names: DataFrame, threshold: float) -> DataFrame:
    """(x, y) of distinct names that can be similar though they needn't share a segment of either kind: each block of at
    most about BLOCK names meets each other, a task holds two of them, and what it finds goes out in batches."""
    made, counted = written_and_counted(names.mapInPandas(_grams(threshold), "name string, n long, grams binary"), "grams", {"n": F.count(F.lit(1))})
    n = counted["n"]
    blocks = max(-(-n // BLOCK), min(BLOCKS, -(-n // 256)), 1)
    p, q = F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = made.withColumn("p", p).withColumn("q", q).select(F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", "name", "n", "grams")
    return dealt.repartition(min(blocks * (blocks + 1) // 2, TASKS), "i", "j").groupBy("i", "j").applyInArrow(_in_blocks(threshold), "x string, y string")


class _Block:
    """Names in order of their lengths, with sums by which any segment is hashed, and sketches of their halves: a bit for
    each level that the count of a class of characters reaches, in fine and in coarse classes and levels."""

    BASE, MIX = 0x9E3779B1, 0x85EBCA6B

    def __init__(self, names: pa.Array, powers: np.ndarray, inverse: np.ndarray):
        n = pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(n, kind="stable")
        self.names, self.n = names.take(pa.array(order)), n[order]
        together = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), self.names), "")[0].as_py()
        self.codes = np.frombuffer(together.encode("utf-32-le"), np.uint32)
        self.starts = np.concatenate([[0], np.cumsum(self.n)])
        self.inverse, self.sums = inverse, np.zeros(len(self.codes) + 1, np.uint32)
        np.cumsum((self.codes + np.uint32(1)) * powers[: len(self.codes)], dtype=np.uint32, out=self.sums[1:])

    def sketch(self, classes: np.ndarray) -> None:
        self.fine, self.coarse = np.empty((len(self.n), CLASSES // 4), np.uint64), np.empty((len(self.n), CLASSES // 16), np.uint64)
        for s in range(0, len(self.n), BLOCK):
            n, starts = self.n[s : s + BLOCK], self.starts[s : s + BLOCK + 1]
            at = np.repeat(np.arange(len(n)), n)
            second = np.arange(len(at)) - (starts[:-1] - starts[0])[at] >= (n // 2)[at]
            counts = np.bincount((at * 2 + second) * CLASSES + classes[self.codes[starts[0] : starts[-1]]], minlength=len(n) * 2 * CLASSES).reshape(len(n), 2, CLASSES)
            fine = ((1 << np.minimum(counts, 8)) - 1).astype(np.uint8)
            coarse = ((1 << np.minimum(counts[..., : CLASSES // 2] + counts[..., : CLASSES // 2 - 1 : -1], 4)) - 1).astype(np.uint8)
            self.fine[s : s + BLOCK] = fine.reshape(len(n), -1).view(np.uint64)
            self.coarse[s : s + BLOCK] = (coarse[..., ::2] | coarse[..., 1::2] << 4).reshape(len(n), -1).view(np.uint64)

    def slice(self, shortest: int, longest: int) -> tuple[int, int]:
        """The names of these lengths."""
        lo, hi = np.searchsorted(self.n, (shortest, longest + 1))
        return int(lo), max(int(lo), int(hi))

    def hashes(self, lo: int, hi: int, at: int, w: int) -> np.ndarray:
        """16 bits of the w characters from `at` of names, which have so many; equal ones have equal hashes."""
        s = self.starts[lo:hi] + at
        return ((self.sums[s + w] - self.sums[s]) * self.inverse[s] >> np.uint32(16)).astype(np.uint16)


def _powers(first: int, base: int, n: int) -> np.ndarray:
    """first times base to 0, 1, ..., n modulo 2^32."""
    steps = np.full(n + 1, base, np.uint32)
    steps[0] = first
    return np.cumprod(steps, dtype=np.uint32, out=steps)


def _blocks(*names: pa.Array) -> list[_Block]:
    """Blocks whose sketches can be compared: frequent characters are classes of their own where there are enough."""
    most = max(pc.sum(pc.utf8_length(x)).as_py() or 0 for x in names)
    powers, inverse = _powers(1, _Block.BASE, most), _powers(_Block.MIX, pow(_Block.BASE, -1, 1 << 32), most)
    made = [_Block(x, powers, inverse) for x in names]
    counts = sum(np.bincount(x.codes, minlength=0x110000) for x in made)
    classes, weights = np.arange(len(counts)) % CLASSES, np.zeros(CLASSES)
    for c in np.argsort(-counts, kind="stable")[: 8 * CLASSES]:
        classes[c] = np.argmin(weights)
        weights[classes[c]] += counts[c]
    for x in made:
        x.sketch(classes)
        del x.codes
    return made


def _segments(n: int, k: int) -> list[tuple[int, int]]:
    """(place, size) of k + 1 segments of n characters with one between each two; those in the middle may be longer."""
    size, extra, at, made = (n - k) // (k + 1), (n - k) % (k + 1), 0, []
    first = (k + 1 - extra) // 2
    for i in range(k + 1):
        w = size + (first <= i < first + extra)
        made.append((at, w))
        at += w + 1
    return made


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows of two sketches, how many bits are different: no more than the counts of characters in both halves.

    k operations move 2 k + 3 of these counts at most: 2 each, where an insertion or deletion moves the middle by half a
    character; a transposition moves only the middle's, 4 of them; and lengths of different parity have their middles
    half a character apart (1).
    """
    bits = np.bitwise_count(x ^ y)
    return bits[:, 0] + bits[:, 1] if bits.shape[1] == 2 else bits.sum(1, dtype=np.uint16)


def _matches(start: np.ndarray, size: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, k) for all places, from start[h] size[h] of them, of each h = others[k], about PAIRS at a time."""
    n, first = size[others], start[others]
    ends = np.cumsum(n)
    cuts = [0, *np.searchsorted(ends, np.arange(PAIRS, ends[-1], PAIRS)), len(others)]
    for s, e in itertools.pairwise(cuts):
        if total := int(n[s:e].sum()):
            yield np.arange(total) + np.repeat(first[s:e] - np.cumsum(n[s:e]) + n[s:e], n[s:e]), np.repeat(np.arange(s, e), n[s:e])


def _gapped(x: _Block, y: _Block, equal: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in x and in y of names that can be similar, the longer in x; as long ones only if `equal`. x may be y.

    A name is cut into k + 1 segments with a character between each two. An operation touches one of them at most, also
    a transposition, and with what it deletes between no more than it costs. So there is a segment i that stands in the
    other name after exactly i operations, k - i at most behind it: at most so many characters from its place.
    """
    for n in map(int, np.unique(x.n)):
        k = _edits(n, threshold) // 2
        if not _by_gaps(0, n, threshold):
            continue
        least, most = n - k, min(n - (not equal), SEGMENT * (2 * k + 1) - 1)  # longer ones are told by segments
        (lo, hi), (from_, to) = x.slice(n, n), y.slice(least, most)
        found, held = [], 0

        def candidates(n=n, k=k, least=least, most=most, lo=lo, hi=hi, from_=from_, to=to):
            if (hi - lo) * (to - from_) <= (k + 1) ** 2 // 2 * (STEP + 4 * (hi - lo + to - from_)):
                step = max(1, PAIRS // max(1, to - from_))
                for s in range(lo, hi, step):
                    a, b = np.repeat(np.arange(s, min(s + step, hi)), to - from_), np.tile(np.arange(from_, to), min(step, hi - s))
                    near = _apart(x.coarse.take(a, 0), y.coarse.take(b, 0)) <= 2 * k + 3
                    yield a[near], b[near]
                return
            for i, (at, w) in enumerate(_segments(n, k)):
                keys = x.hashes(lo, hi, at, w)
                order = np.argsort(keys, kind="stable")
                size = np.bincount(keys, minlength=1 << 16)
                start, coarse, order = np.cumsum(size) - size, x.coarse[lo:hi].take(order, 0), order + lo
                for d in range(-min(i, at), i + 1):
                    s, e = y.slice(max(least, n + d - (k - i), at + d + w), min(most, n + d + (k - i)))
                    if s < e:
                        for a, b in _matches(start, size, y.hashes(s, e, at + d, w)):
                            near = _apart(coarse.take(a, 0), y.coarse[s:e].take(b, 0)) <= 2 * k + 3
                            yield order[a[near]], b[near] + s

        for a, b in candidates() if from_ < to else ():
            if x is y:
                fresh = (y.n[b] < n) | (a < b)
                a, b = a[fresh], b[fresh]
            near = _apart(x.fine.take(a, 0), y.fine.take(b, 0)) <= 2 * k + 2 + (n - y.n[b]) % 2
            found.append(a[near] * len(y.n) + b[near])
            held += len(found[-1])
            if held > PAIRS:
                yield np.divmod(np.unique(np.concatenate(found)), len(y.n))
                found, held = [], 0
        if held:
            yield np.divmod(np.unique(np.concatenate(found)), len(y.n))


def _in_gapped_blocks(threshold: float):
    """Pairs of two blocks (or of one) that share a segment with gaps and have like counts of characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        i, j, own = t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("p").to_numpy()
        names = [t.filter(pa.array(own == k)).column("name").combine_chunks() for k in ((i,) if i == j else (i, j))]
        del t, own
        made = _blocks(*names)
        x, y = made[0], made[-1]
        for one, other, equal in [(x, x, True)] if x is y else [(x, y, True), (y, x, False)]:
            for a, b in _gapped(one, other, equal, threshold):
                for s in range(0, len(a), KEYS):
                    yield pa.RecordBatch.from_arrays([one.names.take(pa.array(a[s : s + KEYS])), other.names.take(pa.array(b[s : s + KEYS]))], names=["x", "y"])

    return run


def _gapped_pairs(names: DataFrame, threshold: float) -> DataFrame:
    """(x, y) of distinct names that are told by segments with gaps, some of them more than once: each block of at most
    about NAMES names and CHARS characters meets each other, and a task holds two of them."""

    def told(frames):
        for f in frames:
            yield f[[_any_partner(len(n), threshold, _by_gaps) for n in f["name"]]]

    made, counted = written_and_counted(names.mapInPandas(told, "name string"), "gapped", {"n": F.count(F.lit(1)), "chars": F.sum(F.length("name"))})
    n, chars = counted["n"], counted["chars"] or 0
    blocks = max(-(-n // NAMES), -(-chars // CHARS), min(FEW, -(-n // 256)), 1)
    p, q = F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = made.withColumn("p", p).withColumn("q", q).select(F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", "name")
    return dealt.repartition(min(blocks * (blocks + 1) // 2, TASKS), "i", "j").groupBy("i", "j").applyInArrow(_in_gapped_blocks(threshold), "x string, y string")


def _near_pairs(names: DataFrame, threshold: float) -> DataFrame:
    """(a, b, lev, longest) of distinct non-empty names, a < b, whose Levenshtein distance lev doesn't tell them apart."""
    names = written(names.where("name <> ''").select("name").distinct(), "names")
    short, long = (names.mapInPandas(_signatures(threshold, x), "name string, key string") for x in (False, True))
    pairs = short.withColumnRenamed("name", "x").join(long.withColumnRenamed("name", "y"), "key").where("x <> y").select("x", "y")
    ordered = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    pairs = pairs.select(*ordered).distinct().unionByName(_block_pairs(names, threshold).select(*ordered))

    def near(pairs: DataFrame) -> DataFrame:
        told = pairs.withColumn("longest", F.greatest(F.length("a"), F.length("b"))).withColumn("lev", F.levenshtein("a", "b"))
        return told.where(F.col("lev") <= 2 * F.floor((1 - threshold) * F.col("longest") + 1e-9))

    return near(pairs).unionByName(near(_gapped_pairs(names, threshold).select(*ordered)).distinct())


def fuzzy_pairs(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, dl) of distinct non-empty names with 1 - dl / longest >= threshold, a < b; threshold above 0.

    Where similar names must share a long segment, candidates do so by place and length, and nothing is compared with
    all names of a length. Where the segments are short but GAPPED characters at least with gaps between them (names of
    60 characters at 0.85: 5), names meet in blocks, and candidates share such a segment and have like counts of
    characters in their halves. Other names are compared each with each, in blocks, by their trigrams: that time grows
    with the square of the distinct names, the memory of a task doesn't. A native Levenshtein bound comes before the
    exact distance.
    """
    near = _near_pairs(names, threshold).withColumn("dl", damerau_distance("a", "b").cast("long"))
    return near.where(1.0 - F.col("dl") / F.col("longest") >= threshold).select("a", "b", "dl")


def similar_pairs(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) of fuzzy_pairs, without distances: most pairs are told by Levenshtein's, which is no smaller."""
    pairs = _near_pairs(names, threshold).withColumn("settled", 1.0 - F.col("lev") / F.col("longest") >= threshold)
    open_ = pairs.withColumn("x", F.when(~F.col("settled"), F.col("a"))).withColumn("y", F.when(~F.col("settled"), F.col("b")))
    return open_.withColumn("dl", damerau_distance("x", "y")).where(F.col("settled") | (1.0 - F.col("dl") / F.col("longest") >= threshold)).select("a", "b")


def fuzzy_groups(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rows (seq, name normalised) -> seq, name, leader: the seq of the group's first row.

    Rows without a name (null or empty) lead themselves. In order of seq each row without a group leads one and takes
    every later row that is similar to it. Done in rounds
    over the graph of similar names: a name leads once all smaller neighbours are members of other groups.
    """
    nodes = rows.where("name <> ''").groupBy("name").agg(F.min("seq").alias("s"))
    pairs = similar_pairs(rows.select("name"), threshold)
    edges = pairs.join(nodes.select(F.col("name").alias("a"), F.col("s").alias("sa")), "a").join(nodes.select(F.col("name").alias("b"), F.col("s").alias("sb")), "b")
    edges = written(edges.select(F.least("sa", "sb").alias("lo"), F.greatest("sa", "sb").alias("hi")), "pairs")
    state = written(nodes.select("s", F.lit(None).cast("boolean").alias("leads")), "state")
    while not state.where("leads is null").isEmpty():
        seen = edges.join(state.select(F.col("s").alias("lo"), "leads"), "lo").groupBy(F.col("hi").alias("s"))
        seen = seen.agg(F.bool_or("leads").alias("led"), F.count(F.when(F.col("leads").isNull(), 1)).alias("open"))
        led = F.coalesce("led", F.lit(False))
        now = F.coalesce("leads", F.when(led, False).when(F.coalesce("open", F.lit(0)) == 0, True))
        state = written(state.join(seen, "s", "left").select("s", now.alias("leads")), "state")
    leaders = state.where("leads").select("s")
    taken = edges.join(leaders, edges.lo == leaders.s).groupBy("hi").agg(F.min("lo").alias("by"))
    label = nodes.join(taken, nodes.s == taken.hi, "left").select("name", F.coalesce("by", "s").alias("leader"))
    out = rows.join(label, "name", "left")
    return out.select("seq", "name", F.when(F.coalesce("name", F.lit("")) == "", F.col("seq")).otherwise(F.col("leader")).alias("leader"))


def best_row(value: Column, confidence: Column, seq: Column) -> Column:
    """The value of the row with the highest confidence; of equal ones the last."""
    return F.max_by(value, F.struct(confidence, seq))


def merge_field(value: Column, is_best: Column, seq: Column) -> Column:
    """A field of a merged group: the first solid value (not null, not empty) of the best row, then of the others by
    seq; else an empty one if there is any; else null."""
    solid = F.when(value.isNotNull() & (value != ""), value)
    order = F.when(solid.isNotNull(), F.struct(F.when(is_best, 0).otherwise(1), seq))
    return F.coalesce(F.min_by(solid, order), F.max(F.when(value == "", value)))


def merge_groups(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """rows (key, seq, confidence, source_url, fields...) -> a merged row per key, with sources in order of seq."""
    top = rows.groupBy(key).agg(F.max(F.struct("confidence", "seq")).alias("_top"))
    marked = rows.join(top, key).withColumn("_best", F.col("seq") == F.col("_top.seq"))
    merged = [merge_field(F.col(f), F.col("_best"), F.col("seq")).alias(f) for f in fields]
    sources = F.transform(F.array_sort(F.collect_list(F.struct("seq", "source_url"))), lambda x: x["source_url"])
    return marked.groupBy(key).agg(*merged, F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("member_count"), sources.alias("sources"))


def dedup_stats(groups: DataFrame) -> DataFrame:
    """rows (leader) -> total_input, unique_rows, merged_rows."""
    return groups.agg(F.count(F.lit(1)).alias("total_input"), F.countDistinct("leader").alias("unique_rows"), (F.count(F.lit(1)) - F.countDistinct("leader")).alias("merged_rows"))


