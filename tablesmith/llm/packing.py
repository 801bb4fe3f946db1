"""Operator 2: best-fit packing after Martello-Toth dominance reduction.

Sizes are integers from 1 to the capacity, so an instance of any number of documents is a histogram of at most
`capacity` counts. The reduction and the packing of the remainder work on the counts and give bin patterns with a
multiplicity; documents find their place by their rank within their size. Only the histogram (at most `capacity` rows)
and the patterns (bounded by the capacity, not by the number of documents) pass through the driver.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import materialize, partitions, small_batches

CAPACITY = 4096
END_ID = 1
#: Entries of each of the two generations of a worker's cache of encoded chunks, and the longest chunk it keeps (bytes).
CACHE_ENTRIES, CACHE_CHUNK = 150_000, 48
#: Characters encoded at a time.
SLICE = 2_000_000
#: Lower-case letters of Latin-1 in UTF-8: normalising leaves them as they are, and a word of them is one pre-token.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_MARKS = b".,;:!?)"
_SURROGATE = re.compile("[\ud800-\udfff]")
#: The character that stands for a byte in a byte-level vocabulary: itself if it can be printed, else the next from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_AS_TEXT = dict(zip((b for b in range(256) if b not in _PRINTED), range(256, 512)))
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal int"


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes; equal to encoding the whole text.

    Where the tokenizer lower-cases and never joins or changes text across ASCII white space, every chunk between white
    space is encoded once and reused; see _by_words. Texts are encoded whole for any other tokenizer. The cache has two
    generations: chunks met since the last change of generations are in the new one, and the old one goes when the new
    one is full, so a worker holds 2 * CACHE_ENTRIES short chunks at most beside the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.by_words, self.model = _by_words(path), self.tokenizer.model
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        special = [(i, t.content) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and not t.normalized]
        self.mark, self.between = special[0] if special else (-1, "")

    def _encode(self, chunks: list[bytes]) -> None:
        """Put chunks in the cache, many to a call: a special token, of which no ids are part, stands between them."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        if not self.between or any(self.between in t for t in texts):
            found = [array("I", e.ids).tobytes() for e in self.batch(texts, add_special_tokens=False)]
        else:
            ids = np.array(self.batch([self.between.join(texts)], add_special_tokens=False)[0].ids, "<u4")
            raw, cut = ids.tobytes(), np.flatnonzero(ids == self.mark).tolist()
            found = [raw[4 * a : 4 * b] for a, b in zip([0, *(c + 1 for c in cut)], [*cut, len(ids)], strict=True)]
        self.new.update(zip(chunks, found, strict=True))

    def _add(self, missing: set[bytes]) -> None:
        """Put chunks in the cache. A mark after a letter or digit is a pre-token of its own, so only what stands before
        it is encoded."""
        new, tokenize, simple = self.new, self.model.tokenize, _LETTERS.fullmatch
        new[b""] = b""  # stands before and after white space at the ends of a text
        missing.discard(b"")
        cut = [c for c in missing if c[-1] in _MARKS and (c[-2:-1].isalnum() or c[-2:-1] > b"\x7f" and simple(c[:-1]))]
        rest = missing.difference(cut)
        rest.update([c[:-1] for c in cut], [c[-1:] for c in cut])
        odd, plain = [], []
        for c in rest:
            if c in new:
                continue
            if c.isalpha() and c.islower():
                new[c] = array("I", [t.id for t in tokenize(c.decode())]).tobytes()
            elif simple(c):
                new[c] = array("I", [t.id for t in tokenize(c.decode("latin-1").translate(_AS_TEXT))]).tobytes()
            else:
                (odd if b"<|" in c else plain).append(c)
        for part in [odd, *(plain[i : i + 4096] for i in range(0, len(plain), 4096))]:
            if part:
                self._encode(part)
        new.update((c, new[c[:-1]] + new[c[-1:]]) for c in cut)

    def _found(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of distinct chunks."""
        new, old = self.new, self.old
        missing = [c for c in chunks if c not in new]
        again = [c for c in missing if c in old]
        new.update((c, old[c]) for c in again)
        self._add(set(missing).difference(again))
        found = [new[c] for c in chunks]
        for c in missing:
            if len(c) > CACHE_CHUNK:
                del new[c]
        if len(new) > CACHE_ENTRIES:
            self.old, self.new = new, {}
        return found

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        if not self.by_words:
            for e in self.batch(texts, add_special_tokens=False):
                yield array("I", e.ids).tobytes()
            return
        if any("<|" in t or not t.isascii() and _SURROGATE.search(t) for t in texts):
            # the ids don't depend on the case of A to Z, but the strings of special tokens do
            chunks = [(r if b"<|" in r else r.lower()).split() for r in (t.encode("utf-8", "surrogatepass") for t in texts)]
            distinct = list(set().union(*chunks))
            get = dict(zip(distinct, self._found(distinct), strict=True)).__getitem__
            for c in chunks:
                yield b"".join(map(get, c))
            return
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
        coded = lists.flatten().dictionary_encode()
        _, at, raw = coded.dictionary.buffers()
        at, raw = np.frombuffer(at, np.int64, len(coded.dictionary) + 1).tolist(), raw.to_pybytes() if raw else b""
        found = self._found([raw[a:b] for a, b in zip(at, at[1:], strict=False)])
        made = pa.array(found, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(made.buffers()[1], np.int64, len(made) + 1)[lists.offsets.to_numpy()] if len(made) else [0] * len(lists.offsets)
        data = made.buffers()[2] or b""
        for a, b in zip(ends, ends[1:], strict=False):
            yield bytes(data[a:b])


def _by_words(path: str) -> bool:
    """Whether a tokenizer file's normaliser lower-cases, and its pre-tokenizer removes white space and cuts letters,
    single digits and marks apart (then bytes): what the encoding by chunks relies on."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    norm, pre = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}
    norms = {n["type"] for n in norm.get("normalizers", [norm]) if n}
    split, *rest = pre.get("pretokenizers") or [{}]
    pattern = (split.get("pattern") or {}).get("Regex", "")
    removed = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
    # a pattern of letters, single digits and marks (with English endings after an apostrophe) that matches no white space
    plain = pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    bytes_ = all(p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex", True) for p in rest)
    return "Lowercase" in norms and norms <= {"NFC", "Replace", "Lowercase"} and removed and plain and bytes_ and told["model"]["type"] == "BPE" and not told["model"].get("continuing_subword_prefix")


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One encoder a worker process: its cache, of bounded size, serves all tasks that the process runs."""
    return Encoder(path)


def _slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch, about `most` characters at a time, so that memory doesn't follow the longest texts."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        text = t.as_py() or ""
        ids.append(i)
        texts.append(text)
        size += len(text)
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: its ids and end_id, cut after every `capacity` ids. `deal` numbers the pieces of a
    task in turn, so that equal rows can be told apart and spread once the pieces are written."""
    end = array("I", [end_id]).tobytes()

    small_batches(docs.sparkSession)

    def run(batches):
        encode, deal = _encoder(tokenizer_path), TaskContext.get().partitionId()
        for batch in batches:
            for ids, texts in _slices(batch):
                out = []
                for doc_id, data in zip(ids, encode(texts), strict=True):
                    data += end
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        deal = (deal + 7919) % (1 << 20)
                        out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), deal))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def reduce_and_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Bin patterns ((size, times), ...) with the number of bins of each.

    Dominance (Martello and Toth): a feasible set dominates all others that hold item j if what it adds to j can take
    the place of what any other adds. So {j, C - j} is fixed for every exact complement; {j} alone where nothing fits
    beside j; {j, k} with the largest fitting k where no two further items fit beside j together. What is left is
    packed best fit, largest first, all items of a size at once.
    """
    left = {w: n for w, n in counts.items() if n > 0}
    fixed: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def take(pattern: tuple[tuple[int, int], ...], bins: int) -> None:
        fixed.append((pattern, bins))
        for w, k in pattern:
            left[w] -= k * bins
            if not left[w]:
                del left[w]

    for j in sorted(left, reverse=True):
        if j == capacity:
            take(((j, 1),), left[j])
        elif 2 * j == capacity:
            if left[j] >= 2:
                take(((j, 2),), left[j] // 2)
        elif 2 * j > capacity and left.get(capacity - j):
            take(((j, 1), (capacity - j, 1)), min(left[j], left[capacity - j]))
    for j in sorted(left, reverse=True):
        while left.get(j):
            sizes = sorted(left)
            room = capacity - j
            others = [w for w in sizes if w <= room and (w != j or left[j] > 1)]
            if not others:
                take(((j, 1),), 1 if 2 * j <= capacity else left[j])
                continue
            two = 2 * others[0] if left[others[0]] - (others[0] == j) > 1 else others[0] + (others[1] if len(others) > 1 else capacity)
            if two <= room:
                break
            k = others[-1]
            take(((j, 2),) if k == j else ((j, 1), (k, 1)), left[j] // 2 if k == j else min(left[j], left[k]))
    return fixed + best_fit(left, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit, largest first: every item goes to the fullest bin that has room for it."""
    open_bins: dict[int, dict[tuple, int]] = {}
    rooms: list[int] = []  # sorted keys of open_bins

    def put(room: int, pattern: tuple, bins: int) -> None:
        if room not in open_bins:
            open_bins[room] = {}
            bisect.insort(rooms, room)
        open_bins[room][pattern] = open_bins[room].get(pattern, 0) + bins

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect.bisect_left(rooms, w)
            if at < len(rooms):
                room = rooms[at]
                pattern, bins = open_bins[room].popitem()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                room, pattern, bins = capacity, (), n  # new bins, as many as could be wanted
            each = room // w
            full = min(bins, n // each)
            if full:
                put(room - each * w, (*pattern, (w, each)), full)
                n -= full * each
                bins -= full
            if bins and n:  # fewer are left than one more bin takes
                put(room - n * w, (*pattern, (w, n)), 1)
                n, bins = 0, bins - 1
            if bins and pattern:
                put(room, pattern, bins)
    return [(p, n) for by in open_bins.values() for p, n in by.items()]


def places(patterns: list, capacity: int) -> dict[int, np.ndarray]:
    """Per size the rows (first rank, times in a bin, first bin, offset in a bin), by first rank."""
    used: dict[int, int] = {}
    rows: dict[int, list] = {}
    base = 0
    for pattern, bins in patterns:
        at = 0
        for w, k in pattern:
            rows.setdefault(w, []).append((used.get(w, 0), k, base, at))
            used[w] = used.get(w, 0) + k * bins
            at += k * w
        assert at <= capacity
        base += bins
    return {w: np.array(r, np.int64) for w, r in rows.items()}


def pack(items: DataFrame, capacity: int = CAPACITY, solve: Callable = reduce_and_fit) -> DataFrame:
    """Adds sequence_id and offset to rows (doc_id, piece, length, ...): no sequence exceeds the capacity.

    A size that many rows share is ranked by (size, salt), so no task holds all rows of a size. Lengths must lie in
    1..capacity. No rows: no rows. Rows may repeat; each gets its own place. Equal rows differ in `deal`, by which (with
    doc_id and piece) rows are dealt to the salts; without such a column equal rows share a salt.
    """
    spark = items.sparkSession
    dealt = ["doc_id", "piece", *(c for c in ("deal",) if c in items.columns)]
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*dealt), F.lit(partitions(spark))))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    if any(not 1 <= w <= capacity for w in histogram):
        raise ValueError(f"a length lies outside 1..{capacity}")
    table = spark.sparkContext.broadcast(places(solve(histogram, capacity), capacity))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*dealt)) - 1
    ranked = salted.withColumn("_within", within).join(counts.withColumn("_before", before).drop("_n"), ["length", "_salt"])
    ranked = ranked.select(*items.columns, (F.col("_before") + F.col("_within")).alias("_rank"))
    names = list(items.columns)
    length_at, rank_at = names.index("length"), len(names)

    def place(batches):
        for batch in batches:
            size, rank = batch.column(length_at).to_numpy(), batch.column(rank_at).to_numpy()
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
                t = table.value[int(size[rows[0]])]
                row = t[np.searchsorted(t[:, 0], rank[rows], "right") - 1]
                d = rank[rows] - row[:, 0]
                seq[rows] = row[:, 2] + d // row[:, 1]
                off[rows] = row[:, 3] + d % row[:, 1] * size[rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in items.dtypes)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all documents (doc_id, text, ...) into as few sequences of at most `capacity` tokens as best fit finds.

    Null or empty text: only end_id. Longer documents are cut into pieces of `capacity`, the last may be shorter. A
    null doc_id stays null, repeated rows are packed each. No documents: no rows. Further columns are ignored.
    """
    return pack(materialize(pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity).drop("deal")
