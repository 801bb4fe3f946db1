"""Operator 6: benchmark decontamination by a distributed positional inverted index.

The index is document-partitioned: every block of whole documents stores, per term, the positions of the term as one
posting list. Blocks are rows of a table in the shared folder and have a bounded number of words (but for a single
longer document). Phrases are found per block from the rarest term, by intersecting offset-adjusted posting lists;
proximity matches start from the rarest term as well and keep the places that have every other term near.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import materialize, small_batches

WINDOW = 10
BLOCK_WORDS = 1_000_000
#: Distinct words of which a task remembers the number beyond a block.
NUMBERED = 300_000
#: Bits of the map of hashed test terms that is sent to the tasks (1 MB, whatever the benchmark): a term whose bit is
#: not set occurs in no item and gets no posting list.
VOCABULARY_BITS = 1 << 23
#: Words of items matched in a pass, about, and of the overlapping parts that longer items are cut into: they bound the
#: phrases that the driver and a task hold.
WORDS_A_PASS, WORDS_A_PART = 500_000, 50_000
#: Further words among which the words of a phrase may stand, in any order, for a proximity match.
SLOP = 3

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_NONE = hashlib.sha256(b"").hexdigest()
INDEX = "block string, doc_ids array<long>, starts array<int>, lens array<int>, terms array<binary>, postings array<binary>"


def words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A to Z, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def windows(item: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The phrases of an item: `size` consecutive words each, or all words where it has fewer."""
    return [tuple(item[i : i + size]) for i in range(max(1, len(item) - size + 1))] if item else []


def vocabulary(items: DataFrame) -> np.ndarray:
    """The map of hashed terms of items (text): VOCABULARY_BITS bits, made by the tasks."""
    text = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.select(F.explode(F.split(text, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")).alias("w")).where("w <> ''")
    h = F.pmod(F.xxhash64("w"), F.lit(VOCABULARY_BITS)) + 1
    found = terms.groupBy(F.bitmap_bucket_number(h).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("bits")).collect()
    bits = np.zeros(VOCABULARY_BITS // 8, np.uint8)
    for r in found:
        bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def build_index(docs: DataFrame, bits: np.ndarray | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Positional inverted index of documents (doc_id, text): one row a block, written to the shared folder.

    Positions run on through a block, with one empty place after each document, so no phrase spans two documents.
    With a vocabulary's map, terms whose bit is not set get no posting list (they still count as words and hold their
    position).
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = None if bits is None else spark.sparkContext.broadcast(bits)

    def run(batches):
        known = None if held is None else held.value
        numbers: dict[bytes, int] = {}
        names: list[bytes] = []

        def number(w: bytes) -> int:
            if known is not None:
                h = xxhash.xxh64_intdigest(w, 42) & (VOCABULARY_BITS - 1)  # as Spark's xxhash64
                if not known[h >> 3] >> (h & 7) & 1:
                    return -1
            names.append(w)
            return len(names) - 1

        def block(rows: list[tuple], number: int) -> pa.RecordBatch:
            lens = np.array([len(r[1]) for r in rows], np.int64)
            starts = np.cumsum(np.append(0, lens + 1))[:-1]
            codes = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.int32)
            at = np.repeat(starts - np.append(0, np.cumsum(lens))[:-1], lens) + np.arange(len(codes))
            keep = codes >= 0
            codes, at = codes[keep], at[keep].astype("<i4")
            order = np.argsort(codes, kind="stable")
            codes, at = codes[order], at[order]
            first = np.flatnonzero(np.append(True, np.diff(codes) != 0)) if len(codes) else np.zeros(0, np.int64)
            terms = [names[c] for c in codes[first]]
            ends = [*first[1:].tolist(), len(codes)] if len(codes) else []
            lists = [at[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)]
            cols = [pa.array([x], t) for x, t in ((([r[0] for r in rows]), pa.list_(pa.int64())), (starts.tolist(), pa.list_(pa.int32())), (lens.tolist(), pa.list_(pa.int32())), (terms, pa.list_(pa.binary())), (lists, pa.list_(pa.binary())))]
            name = pa.array([f"{TaskContext.get().partitionId()}-{number}"])
            return pa.RecordBatch.from_arrays([name, *cols], names=["block", "doc_ids", "starts", "lens", "terms", "postings"])

        rows, size, made = [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words(text.as_py())
                for w in set(found).difference(numbers):
                    numbers[w] = number(w)
                rows.append((doc_id, np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))))
                size += len(found) + 1
                if size >= block_words:
                    yield block(rows, made)
                    rows, size, made = [], 0, made + 1
                    if len(numbers) > NUMBERED:
                        numbers.clear()
                        names.clear()
        if rows:
            yield block(rows, made)

    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX), "positional-index")


class Phrases:
    """Phrases as term numbers, with the items that have them."""

    def __init__(self, items: Iterable[tuple[str, str | None]], size: int = WINDOW):
        self.items: list[str] = []
        phrases: dict[tuple[bytes, ...], list[int]] = {}
        for item_id, text in items:
            for p in dict.fromkeys(windows(words(text), size)):
                phrases.setdefault(p, []).append(len(self.items))
            self.items.append(item_id)
        self.terms = {w: i for i, w in enumerate(sorted({w for p in phrases for w in p}))}
        self.lengths = np.array([len(p) for p in phrases], np.int64)
        self.codes = np.full((len(phrases), size), len(self.terms), np.int64)  # the number past the last: no term
        for i, p in enumerate(phrases):
            self.codes[i, : len(p)] = [self.terms[w] for w in p]
        self.owners = [np.array(x, np.int64) for x in phrases.values()]


def find_phrases(postings: dict[int, np.ndarray], phrases: Phrases) -> Iterator[tuple[int, np.ndarray]]:
    """(phrase, its first positions) for each phrase that occurs: lists are intersected from the rarest term on."""
    if not len(phrases.codes):
        return
    many = np.zeros(len(phrases.terms) + 1, np.int64)
    for t, p in postings.items():
        many[t] = len(p)
    many[-1] = np.iinfo(np.int64).max
    sizes = many[phrases.codes]
    for i in np.flatnonzero(sizes.min(axis=1) > 0):
        codes, at = phrases.codes[i], None
        for k in np.argsort(sizes[i], kind="stable")[: phrases.lengths[i]]:
            adjusted = postings[int(codes[k])]
            if at is None:
                at = adjusted.astype(np.int64) - k
            else:
                spot = np.searchsorted(adjusted, at + k)
                at = at[(spot < len(adjusted)) & (adjusted[np.minimum(spot, len(adjusted) - 1)] == at + k)]
            if not len(at):
                break
        else:
            yield int(i), at


def near_phrases(postings: dict[int, np.ndarray], phrases: Phrases, starts: np.ndarray, lens: np.ndarray, slop: int = SLOP) -> Iterator[tuple[int, np.ndarray]]:
    """(phrase, documents of the block) where all terms of the phrase lie within len(phrase) + slop words, in any order.

    From the rarest term on, the places stay that have each further term less than that many words away in their
    document; only what then remains is tried window by window.
    """
    if not len(phrases.codes):
        return
    many = np.zeros(len(phrases.terms) + 1, np.int64)
    for t, p in postings.items():
        many[t] = len(p)
    many[-1] = np.iinfo(np.int64).max
    sizes = many[phrases.codes]
    for i in np.flatnonzero(sizes.min(axis=1) > 0):
        n = int(phrases.lengths[i])
        order = np.argsort(sizes[i], kind="stable")[:n]
        own = list(dict.fromkeys(phrases.codes[i, order].tolist()))
        span, at = n + slop, postings[own[0]].astype(np.int64)
        for c in own[1:]:
            p = postings[c]
            spot = np.searchsorted(p, at - (span - 1))
            at = at[(spot < len(p)) & (p[np.minimum(spot, len(p) - 1)] < at + span)]
            if not len(at):
                break
        else:
            doc, found = np.searchsorted(starts, at, "right") - 1, []
            for a, d in zip(at.tolist(), doc.tolist(), strict=True):
                lo, hi = max(a - span + 1, int(starts[d])), min(a + span, int(starts[d] + lens[d]))
                near = [p[np.searchsorted(p, lo) : np.searchsorted(p, hi)] for p in (postings[c] for c in own)]
                # a window that holds every term starts at one of these places
                if all(map(len, near)) and any(all(k < len(p) and p[k] < s + span for p in near for k in (np.searchsorted(p, s),)) for s in np.unique(np.concatenate(near)).tolist() if s <= a):
                    found.append(d)
            if found:
                yield int(i), np.unique(found)


def _postings(row: dict, terms: dict[bytes, int]) -> dict[int, np.ndarray]:
    return {terms[t]: np.frombuffer(p, "<i4") for t, p in zip(row["terms"], row["postings"], strict=True) if t in terms}


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_py() for k, n in enumerate(("block", "doc_ids", "starts", "lens", "terms", "postings"))}


def match(index: DataFrame, phrases: Phrases, slop: int | None = SLOP) -> DataFrame:
    """Per document of the index: hit words as runs (run_starts, run_ends), the items of which a phrase occurs, and those
    of which all words of a phrase stand within its length and slop more words (near_items; none where slop is null)."""
    held = index.sparkSession.sparkContext.broadcast(phrases)

    def listed(pairs: list[np.ndarray], n: int, own: Phrases) -> list[list[str]]:
        m = max(1, len(own.items))
        code = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        edges = np.searchsorted(code // m, np.arange(n + 1))
        return [[own.items[c % m] for c in code[edges[d] : edges[d + 1]]] for d in range(n)]

    def run(batches):
        own = held.value
        for row in _rows(batches):
            starts, lens = np.array(row["starts"], np.int64), np.array(row["lens"], np.int64)
            n, m = len(starts), max(1, len(own.items))
            diff, pairs, near = np.zeros(int(starts[-1] + lens[-1] + 2) if n else 1, np.int32), [], []
            postings = _postings(row, own.terms)
            for i, at in find_phrases(postings, own):
                diff[at] += 1
                diff[at + own.lengths[i]] -= 1
                doc = np.unique(np.searchsorted(starts, at, "right") - 1)
                pairs.append((doc[:, None] * m + own.owners[i][None, :]).ravel())
            for i, doc in near_phrases(postings, own, starts, lens, slop) if slop is not None else ():
                near.append((doc[:, None] * m + own.owners[i][None, :]).ravel())
            hit = (np.cumsum(diff) > 0).astype(np.int8)
            turn = np.diff(np.concatenate([[0], hit, [0]]))
            begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
            edges = np.searchsorted(np.searchsorted(starts, begin, "right") - 1, np.arange(n + 1))
            runs = [[(x[edges[d] : edges[d + 1]] - starts[d]).tolist() for d in range(n)] for x in (begin, end)]
            cols = [pa.array([row["block"]] * n), pa.array(row["doc_ids"], pa.int64()), pa.array(range(n), pa.int32()), pa.array(lens, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in runs), *(pa.array(listed(x, n, own), pa.list_(pa.string())) for x in (pairs, near))]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "doc_id", "place", "n_words", "run_starts", "run_ends", "items", "near_items"])

    return index.mapInArrow(run, "block string, doc_id long, place int, n_words long, run_starts array<long>, run_ends array<long>, items array<string>, near_items array<string>")


def summarize(matches: DataFrame) -> DataFrame:
    """The report per document from match's rows."""
    total = F.aggregate(F.zip_with("run_starts", "run_ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    ids = F.array_sort("items")
    return matches.select(
        "doc_id", "n_words", total.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.when(F.size("items") == 0, F.lit(_NONE)).otherwise(F.sha2(F.array_join(ids, ","), 256)).alias("items_sha256"), (total > 0).alias("contaminated"),
        F.array_join(F.array_sort("near_items"), ",").alias("near_items"),
    )


def _items(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct items (item_id, text, words: about how many); longer ones in parts that overlap by a phrase less a word."""
    rows = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    rows = rows.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("n")).drop("n").withColumn("w", F.split("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    part = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)), F.lit(WORDS_A_PART)), lambda a: F.array_join(F.slice("w", a, WORDS_A_PART + size - 1), " "))
    parts = F.when(F.size("w") <= WORDS_A_PART + size - 1, F.array("text")).otherwise(part)
    return rows.select("item_id", F.explode(parts).alias("text")).withColumn("words", F.size(F.split("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, words_a_pass: int = WORDS_A_PASS, slop: int | None = None) -> DataFrame:
    """Which words of each document (doc_id, text) belong to an occurrence of a benchmark phrase (item_id, text).

    Null or wordless texts have no words and no hits; items without words have no phrases; an item_id that is null
    counts as the empty string, rows of one item_id as one item. Repeated documents are reported each. The items are
    matched in passes of about words_a_pass words, longer items in overlapping parts, so neither the driver nor a task
    holds an unbounded benchmark. With a slop, near_items are the items of proximity matches (sorted as strings,
    comma-joined), else it is empty.
    """
    items = materialize(_items(benchmark, window), "items")
    total = items.agg(F.sum("words").alias("n")).first()["n"] or 0
    passes = max(1, -(-total // words_a_pass))
    index = build_index(docs, vocabulary(items))

    def matched(k: int) -> DataFrame:
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        by_id: dict[str, list[str]] = {}
        for r in own.select("item_id", "text").collect():  # about words_a_pass words
            by_id.setdefault(r["item_id"], []).append(r["text"])
        return match(index, _Merged(by_id, window), slop)

    found = matched(0)
    for k in range(1, passes):
        found = found.unionByName(matched(k))
    return summarize(found if passes == 1 else _merge_passes(found))


class _Merged(Phrases):
    """Phrases of items that may have several texts."""

    def __init__(self, texts: dict[str, list[str]], size: int):
        super().__init__([(i, t) for i, ts in texts.items() for t in ts], size)
        names = list(dict.fromkeys(self.items))
        at = {x: k for k, x in enumerate(names)}
        move = np.array([at[x] for x in self.items], np.int64)
        self.owners = [np.unique(move[o]) for o in self.owners]
        self.items = names


def _merge_passes(found: DataFrame) -> DataFrame:
    """One row a document from the rows of several passes: hit words counted once, items of all passes."""
    places = F.flatten(F.zip_with("run_starts", "run_ends", lambda a, b: F.sequence(a, b - 1)))
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    merged = found.groupBy("block", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), every(places).alias("hit"), every("items").alias("items"), every("near_items").alias("near_items"))
    return merged.select("block", "doc_id", "place", "n_words", F.col("hit").alias("run_starts"), F.transform("hit", lambda x: x + 1).alias("run_ends"), "items", "near_items")
