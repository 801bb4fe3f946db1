"""Operator 7: n-gram Jaccard join by a grouped prefix join.

A document is the set of its distinct word shingles (64-bit hashes). All sets are put in one order, rare shingles
first, so two sets can only be similar if they share a shingle of their short prefixes. Documents with equal sets are
one class; classes with identical prefixes and size are one group. Candidates are found between groups, pruned by size
and position, expanded to their members and verified on whole texts.

No pairs within a group of similar documents are listed: members are first verified against one leader per shared
shingle, which settles most of a group in a linear number of pairs. Only what then still lies in different components
is compared, exactly, so no link between components is lost.
"""

from __future__ import annotations

import math
import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import components, lookup, materialize, small_batches

SHINGLE = 4
PERCENT = 85
#: Shingles that are put last in the order, by their counts over all documents; the others are ordered by hash. The
#: number bounds what is broadcast. It only steers how long lists get, not the result.
FREQUENT = 1 << 18
#: Postings of one frequent shingle, by its count, that one task takes; longer lists are split by their groups.
LIST = 4_000
#: Members compared with one copy of their leader in a task.
MEMBERS = 200
#: Bits of the map by which texts that no candidate needs are left out before the shuffle (8 MB, whatever the input).
MAP_BITS = 1 << 26
#: Shingles that a task counts before it passes the counts on, and entries of its cache of word hashes.
COUNTED, CACHED = 4_000_000, 100_000

_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M[4]
    x = (x ^ (x >> np.uint64(33))) * _M[5]
    return x ^ (x >> np.uint64(33))


class Shingles:
    """The distinct shingles of texts, as sorted 64-bit hashes."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.cache = size, {}
        self.weights = [np.uint64(pow(int(_M[k % 4]), 2 * (k // 4) + 1, 1 << 64)) for k in range(size)]

    def __call__(self, text: str | None) -> np.ndarray:
        """Words [^\\x20\\x09-\\x0D]+ after lower-casing A to Z; fewer than `size` words are one shingle, none no shingle."""
        found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not found:
            return np.zeros(0, np.uint64)
        cache = self.cache
        missing = set(found).difference(cache)
        if len(cache) + len(missing) > CACHED:
            cache.clear()
            missing = set(found)
        for w in missing:
            cache[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
        with np.errstate(over="ignore"):
            if len(h) < self.size:
                total = np.uint64(len(h))
                for k, w in enumerate(h):
                    total = total + _mix(np.array([w + self.weights[k]]))[0] * self.weights[k]
                return _mix(np.array([total]))
            m = len(h) - self.size + 1
            total = h[:m] * self.weights[0]
            for k in range(1, self.size):
                total = total + h[k : k + m] * self.weights[k]
            return np.unique(_mix(total))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share, as two signed numbers."""
    with np.errstate(over="ignore"):
        a, b = s.sum(dtype=np.uint64), _mix(s ^ _M[0]).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def least_size(n, percent: int = PERCENT):
    """The least size of a set that can be similar to one of n shingles."""
    return -(-n * percent // 100)


def least_overlap(n, m, percent: int = PERCENT):
    """The least number of shared shingles of similar sets of n and m shingles: 100 i >= p (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def probe_length(n, percent: int = PERCENT):
    return n - least_size(n, percent) + 1


def index_length(n, percent: int = PERCENT):
    return n - least_overlap(n, n, percent) + 1


def prefix(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first probe_length shingles of a sorted set: those not in `frequent` by hash, then the frequent by rank."""
    p = probe_length(len(s), percent)
    for part in (s[: 2 * p], s) if 2 * p < len(s) else (s,):
        at = np.minimum(np.searchsorted(frequent, part), max(0, len(frequent) - 1))
        often = frequent[at] == part if len(frequent) else np.zeros(len(part), bool)
        rare = part[~often]
        if len(rare) >= p:
            return rare[:p]
    late = s[often]
    return np.concatenate([rare, late[np.argsort(rank[at[often]], kind="stable")]])[:p]


def _batch(rows: list[tuple], names: str, kinds: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names.split())


_L = pa.int64()


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """kind 0: (doc_id, key, key, n) per document; kind 1: (shingle, documents) for shingles met again in a task's share."""

    def counted(held: np.ndarray) -> pa.RecordBatch:
        """The shingles that stand more than once in held (sorted in place: nothing of its size is allocated but a mask)."""
        held.sort()
        same = held[1:] == held[:-1]
        turn = np.diff(np.concatenate([[False], same, [False]]).view(np.int8))
        first, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        zero = np.zeros(len(first), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(first), np.int32)), pa.array(held[first].view(np.int64)), pa.array(end - first + 1), pa.array(zero), pa.array(zero)], names=["kind", "a", "b", "c", "n"])

    def run(batches):
        # mapped by itself, so that the system has it back when the task is over
        shingles, seen, held, used = Shingles(size), set(), np.frombuffer(mmap.mmap(-1, 8 * COUNTED), np.uint64), 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(text.as_py())
                key = set_key(s)
                rows.append((0, doc_id, *key, len(s)))
                if 0 < len(s) <= COUNTED and key not in seen:  # a set has no shingle twice, so a larger one adds nothing by itself
                    if used + len(s) > COUNTED:
                        yield counted(held[:used])
                        used = 0
                        seen.clear()
                    seen.add(key)
                    held[used : used + len(s)] = s
                    used += len(s)
            yield _batch(rows, "kind a b c n", [pa.int32(), _L, _L, _L, _L])
        yield counted(held[:used])

    return docs.mapInArrow(run, "kind int, a long, b long, c long, n long")


def _prefixes(docs: DataFrame, size: int, percent: int, frequent: np.ndarray, rank: np.ndarray, many: np.ndarray) -> DataFrame:
    """(gid, key, key, n, prefix, salts) once per set and task: gid stands for the prefix and the size.

    A shingle of the prefix whose list is split has the number of the part (by the gid) as its salt, others -1.
    """
    held = docs.sparkSession.sparkContext.broadcast((frequent, rank, -(-many // LIST)))

    def run(batches):
        (often, place, parts), shingles, seen = held.value, Shingles(size), set()
        for batch in batches:
            rows = []
            for text in batch.column(0):
                s = shingles(text.as_py())
                key = set_key(s)
                if len(s) and key not in seen:
                    if len(seen) > CACHED // 2:
                        seen.clear()
                    seen.add(key)
                    p = prefix(s, often, place, percent)
                    gid = xxhash.xxh3_64_intdigest(p.tobytes(), len(s))
                    salts = np.full(len(p), -1, np.int32)
                    if len(often):
                        at = np.minimum(np.searchsorted(often, p), len(often) - 1)
                        k = np.where(often[at] == p, parts[at], 1)
                        salts[k > 1] = gid % k[k > 1].astype(np.uint64)
                    rows.append((gid - (1 << 63), *key, len(s), p.view(np.int64), salts))
            yield _batch(rows, "gid c1 c2 n prefix salts", [_L, _L, _L, _L, pa.list_(_L), pa.list_(pa.int32())])

    return docs.select("text").mapInArrow(run, "gid long, c1 long, c2 long, n long, prefix array<long>, salts array<int>")


def _possible(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Whether sets of n and m shingles can be similar if the first one they share is at i and j of their orders."""
    large, at_small = F.greatest(n, m), F.when(n < m, i).when(n > m, j).otherwise(F.least(i, j))
    small = F.least(n, m)
    need = F.ceil(percent * (n + m) / (100 + percent))
    return (100 * small >= percent * large) & (F.least(n - i, m - j) >= need) & (at_small < small - F.ceil(2 * percent * small / (100 + percent)) + 1)


def _shared(postings: DataFrame, percent: int) -> DataFrame:
    """Postings (s, salt, pos, gid, n) of shingles that several groups have, with the list's leader where it is possible.

    Rows come sorted by (s, salt, pos, gid), some of them repeated; the first of a list leads: it has the fewest rarer
    shingles, as the text from which copies are made does. All of a split list is kept (salt from 0). Runs through the
    rows once and holds two of them.
    """

    def run(batches):
        last = None  # the row held back, and whether it was emitted as part of a list
        lead = None
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(5)]
            if last is not None:
                cols = [np.append(x, y) for x, y in zip(last[:5], cols, strict=True)]
            if not len(cols[0]):
                continue
            s, salt, pos, gid, n = cols
            new = np.append(True, (s[1:] != s[:-1]) | (gid[1:] != gid[:-1]))  # a group comes once for each task that met it
            s, salt, pos, gid, n = (x[new] for x in cols)
            more = np.append((s[1:] == s[:-1]) & (salt[1:] == salt[:-1]), False)  # the next row is of the same list
            again = np.append(False, more[:-1])
            if last is not None:
                again[0] = last[5]
            first = np.flatnonzero(~again)
            at = np.searchsorted(first, np.arange(len(s)), "right") - 1
            leads = np.stack([pos, gid, n])[:, first] if len(first) else np.zeros((3, 0), np.int64)
            if again[0]:  # still the list of the last batch
                leads, at = np.concatenate([np.array(lead)[:, None], leads], axis=1), at + 1
            lp, lg, ln = leads[:, at]
            lead = leads[:, at[-1]].tolist()
            end = len(s) - 1
            last = (*([x[end]] for x in (s, salt, pos, gid, n)), bool(again[end]))
            keep = (more | again | (salt >= 0))[:end]
            yield emit(*(x[:end][keep] for x in (s, salt, pos, gid, n, lp, lg, ln)))
        if last is not None and (last[5] or last[1][0] >= 0):
            yield emit(*(np.array(x, np.int64) for x in (*last[:5], *([x] for x in lead))))

    def emit(s, salt, pos, gid, n, lp, lg, ln):
        large, small = np.maximum(n, ln), np.minimum(n, ln)
        at_small = np.where(n < ln, pos, np.where(n > ln, lp, np.minimum(pos, lp)))
        ok = (gid != lg) & (100 * small >= percent * large) & (np.minimum(n - pos, ln - lp) >= least_overlap(n, ln, percent)) & (at_small < index_length(small, percent))
        return pa.RecordBatch.from_arrays([pa.array(s), pa.array(salt.astype(np.int32)), pa.array(pos), pa.array(gid), pa.array(n), pa.array(lg, mask=~ok)], names=["s", "salt", "pos", "gid", "n", "lead"])

    return postings.mapInArrow(run, "s long, salt int, pos long, gid long, n long, lead long")


def _bitmap(ids: DataFrame) -> dict[int, bytes]:
    """A map of hashed ids, MAP_BITS bits at most."""
    h = F.pmod(F.xxhash64("doc"), F.lit(MAP_BITS)) + 1
    found = ids.groupBy(F.bitmap_bucket_number(h).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("bits"))
    return {r["k"]: bytes(r["bits"]) for r in found.collect()}


def _needed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose hashed id is in the map of ids, and few others."""
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    for k, b in _bitmap(ids).items():
        bits[(k - 1) * 4096 : k * 4096] = np.frombuffer(b, np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            h = batch.column(2).to_numpy()
            keep = held.value[h >> 3] >> (h & 7).astype(np.uint8) & 1
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep.astype(bool))) for c in batch.columns[:2]], names=["doc", "text"])

    h = F.pmod(F.xxhash64(F.col("doc_id").alias("doc")), F.lit(MAP_BITS))
    return docs.select("doc_id", "text", h.alias("h")).where("doc_id is not null").mapInArrow(run, "doc long, text string")


def verify(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, ka, b, kb) of documents that are similar, on their whole texts: links (a, b).

    ka and kb are the first halves of the sets' keys, for ids that several texts have. A document b with many partners
    is sent along with each MEMBERS of them or so.
    """
    many = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("_n")).withColumn("parts", F.ceil(F.col("_n") / MEMBERS))
    dealt = lookup(pairs, many.where("_n > 1"), "b", "_n", F.col("a")).withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))))
    dealt = materialize(dealt.select("a", "ka", "b", "kb", "part"), "pairs")
    role = lambda doc, key, r: dealt.select(F.col(doc).alias("doc"), F.col(key).alias("key"), "b", "kb", "part", F.lit(r).alias("role"))
    wanted = role("b", "kb", 0).distinct().unionByName(role("a", "ka", 1))
    texts = _needed(docs, wanted.select("doc")).join(wanted, "doc")
    sorted_ = texts.repartition("b", "kb", "part").sortWithinPartitions("b", "kb", "part", "role", "doc")

    def run(batches):
        shingles, now, own = Shingles(size), None, None
        for batch in batches:
            rows = []
            doc, text, key, b, kb, part, r = batch.columns
            for i, where in enumerate(zip(b.to_pylist(), kb.to_pylist(), part.to_pylist(), strict=True)):
                if where != now:
                    now, own = where, None
                s = shingles(text[i].as_py())
                if not len(s) or set_key(s)[0] != key[i].as_py():
                    continue
                if r[i].as_py() == 0:
                    own = s
                elif own is not None:
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        rows.append((doc[i].as_py(), where[0]))
            yield _batch(rows, "a b", [_L, _L])

    return materialize(sorted_.select("doc", "text", "key", "b", "kb", "part", "role").mapInArrow(run, "a long, b long"), "verified")


def group_similar(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, n_shingles, component_id, a row per input row.

    Null, empty and blank texts have no shingles and are linked with nothing: component_id is their doc_id. A null
    doc_id has a null component_id and links nothing. Rows that share a doc_id are one document for the components.
    No documents: no rows. Further columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    facts = materialize(_sets(docs, size), "sets")
    rows = facts.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("c1"), F.col("c").alias("c2"), "n")
    named = rows.where("n > 0 and doc_id is not null")
    classes = materialize(named.groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("cid"), F.count(F.lit(1)).alias("docs")), "classes")
    counts = facts.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).where("n >= 8")
    often = counts.orderBy(F.desc("n"), "a").limit(FREQUENT).toArrow()  # FREQUENT rows at most
    code, many = often.column("a").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(code)
    code, many = code[order], many[order]
    rank = np.empty(len(code), np.int64)
    rank[np.lexsort((code, many))] = np.arange(len(code))

    sets = materialize(_prefixes(docs.where("doc_id is not null"), size, percent, code, rank, many), "prefixes")
    postings = sets.select("gid", "n", F.posexplode(F.arrays_zip("prefix", "salts")).alias("pos", "p"))
    postings = postings.select(F.col("p.prefix").alias("s"), F.col("p.salts").alias("salt"), F.col("pos").cast("long"), "gid", "n")
    postings = postings.repartition("s", "salt").sortWithinPartitions("s", "salt", "pos", "gid")
    shared = materialize(_shared(postings, percent), "shared")
    members = materialize(sets.select("gid", "c1", "c2", "n").distinct().join(classes, ["c1", "c2", "n"]).select("gid", "cid", "c1"), "members")

    # members against the first of their group, and that one against the leader that most shared shingles name
    first = members.groupBy("gid").agg(F.min(F.struct("cid", "c1")).alias("f")).select("gid", F.col("f.cid").alias("rep"), F.col("f.c1").alias("krep"))
    within = members.join(first, "gid").where("cid <> rep").select(F.col("cid").alias("a"), F.col("c1").alias("ka"), F.col("rep").alias("b"), F.col("krep").alias("kb"))
    # the first of each part of a split list follows the first of all its parts (of FREQUENT lists at most)
    part = shared.where("salt >= 0").groupBy("s", "salt").agg(F.min(F.struct("pos", "gid")).alias("f"))
    whole = part.groupBy("s").agg(F.min("f").alias("l"))
    parted = part.join(F.broadcast(whole), "s").where("f.gid <> l.gid").select(F.col("f.gid").alias("gid"), F.col("l.gid").alias("lead"))
    led = shared.where("lead is not null").select("gid", "lead").unionByName(parted).groupBy("gid", "lead").agg(F.count(F.lit(1)).alias("k"))
    led = led.groupBy("gid").agg(F.max(F.struct("k", -F.col("lead"), "lead")).alias("l")).select("gid", F.col("l.lead").alias("lead"))
    across = led.join(first, "gid").join(first.select(F.col("gid").alias("lead"), F.col("rep").alias("b"), F.col("krep").alias("kb")), "lead").select(F.col("rep").alias("a"), F.col("krep").alias("ka"), "b", "kb")
    links = verify(docs, within.unionByName(across), size, percent)
    differ = [f"min({c}) <> max({c})" for c in ("c1", "c2", "n")]
    repeated = named.groupBy("doc_id").agg(F.expr(" or ".join(differ)).alias("several")).where("several").select("doc_id")
    several = named.join(repeated, "doc_id", "left_semi").join(classes, ["c1", "c2", "n"]).select(F.col("doc_id").alias("a"), F.col("cid").alias("b")).distinct()
    links = links.unionByName(several)
    found = components(links)

    # what lies in different components still: pairs of (component, size, position) first, then their members
    member = members.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).select("gid", "cid", "c1", "comp")
    member = materialize(member, "members")
    group = member.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).select("gid", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("comp"))
    rest = shared.select("s", "pos", "gid", "n").join(group, "gid")
    mixed = rest.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("k"), F.count("comp").alias("kc")).where("k > kc or lo <> hi").select("s")
    rest = materialize(rest.join(mixed, "s", "left_semi"), "mixed")
    kinds = rest.select("s", "comp", "n", "pos").distinct()
    x, y = (kinds.select("s", *[F.col(c).alias(f"{p}{c}") for c in ("comp", "n", "pos")]) for p in "xy")
    ordered = (F.col("xn") > F.col("yn")) | (F.col("xn") == F.col("yn")) & (F.col("xpos") >= F.col("ypos"))
    apart = F.coalesce(F.col("xcomp") != F.col("ycomp"), F.lit(True))
    # similar sizes lie in one band or in neighbouring ones, so a hot shingle's kinds meet by size
    band = lambda n: F.floor(F.log(n) / F.lit(1.0001 * math.log(100 / percent)))
    x = x.withColumn("band", F.explode(F.array(band(F.col("xn")), band(F.col("xn")) - 1)))
    pairs = x.join(y.withColumn("band", band(F.col("yn"))), ["s", "band"]).drop("band").where(ordered & apart & _possible(F.col("xn"), F.col("xpos"), F.col("yn"), F.col("ypos"), percent))
    for p in "xy":
        own = rest.select(F.col("s").alias("s_"), F.col("gid").alias(f"{p}gid"), *[F.col(c).alias(f"{p}{c}_") for c in ("comp", "n", "pos")])
        pairs = pairs.join(own, (F.col("s") == F.col("s_")) & F.col(f"{p}comp").eqNullSafe(F.col(f"{p}comp_")) & (F.col(f"{p}n") == F.col(f"{p}n_")) & (F.col(f"{p}pos") == F.col(f"{p}pos_"))).drop("s_", f"{p}comp_", f"{p}n_", f"{p}pos_")
    pairs = pairs.select("xgid", "ygid").distinct()
    one, two = (member.select(F.col("gid").alias(f"{p}gid"), F.col("cid").alias(c), F.col("c1").alias(f"k{c}"), F.col("comp").alias(f"{p}comp")) for p, c in ("xa", "yb"))
    pairs = pairs.join(one, "xgid").join(two, "ygid").where("xcomp <> ycomp").select("a", "ka", "b", "kb").distinct()
    more = verify(docs, materialize(pairs, "candidates"), size, percent)
    if more.isEmpty():
        final = found
    else:
        final = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    label = classes.join(final.withColumnRenamed("node", "cid"), "cid", "left").select("c1", "c2", "n", "docs", F.coalesce("component", "cid").alias("component"))
    label = label.select(F.concat_ws("/", "c1", "c2", "n").alias("class"), "docs", "component").where("docs > 0")
    keyed = rows.withColumn("class", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.concat_ws("/", "c1", "c2", "n")))
    out = lookup(keyed, label, "class", "docs", F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
