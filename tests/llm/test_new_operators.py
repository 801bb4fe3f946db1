"""Operators 11 to 13: unit cases, brute force, odd rows."""

import hashlib
import heapq
import random
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablesmith.llm import prefix_trie, repair, squares

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"
CONVERSATIONS = "conv_id long, turn long, role string, text string"


# operator 11


def square_sum(levels, capacity):
    return sum(n * n for n in Counter(x for x in levels.values() if x < capacity).values())


@pytest.mark.parametrize("capacity", [7, 16, 40])
def test_levels_place_where_the_sum_of_squares_is_least(capacity):
    rng, levels, filled = random.Random(capacity), squares.Levels(capacity), {}
    for k in range(600):
        size = rng.randrange(1, capacity + 1)
        options = [(square_sum({**filled, w: at + size}, capacity), -at) for w, at in [*filled.items(), (k, 0)] if at + size <= capacity]
        window, level = levels.place(size, k)
        assert filled.get(window, 0) == level
        filled[window] = level + size
        assert (square_sum(filled, capacity), -level) == min(options)


def packed(spark, rows, **more):
    return [r.asDict() for r in squares.pack_online(spark.createDataFrame(rows, DOCS), TOKENIZER, **more).collect()]


def ids_of(text):
    return [*Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids, squares.END_ID]


def check_packing(rows, made, capacity):
    """Every id lies in one piece, sequences are gapless, none is longer than the capacity or padded."""
    want, found, sequences = Counter(), Counter(), defaultdict(list)
    for doc_id, text in rows:
        want.update((doc_id, k, t) for k, t in enumerate(ids_of(text)))
    for r in made:
        ids = array("I", bytes(r["ids"]))
        assert len(ids) == r["length"] > 0
        found.update((r["doc_id"], r["start"] + k, t) for k, t in enumerate(ids))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert found == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)


ODD_DOCS = [(1, None), (2, ""), (None, "no id here"), (3, "twice"), (3, "twice"), (3, "another text"), (4, "long text " * 700), (-5, "  \n\t"), (6, "é ß 漢字 🙂 <|endoftext|>")]


@pytest.mark.parametrize("capacity", [8, 64, 4096])
def test_online_packing_of_odd_rows(spark, capacity):
    check_packing(ODD_DOCS, packed(spark, ODD_DOCS, capacity=capacity), capacity)


def test_online_packing_of_many_lanes(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randrange(0, 60)))) for k in range(400)]
    docs = spark.createDataFrame(rows, DOCS).repartition(9)
    made = [r.asDict() for r in squares.pack_online(docs, TOKENIZER, capacity=50).collect()]
    sizes = Counter()
    for r in made:
        sizes[r["sequence_id"]] += r["length"]
    assert max(sizes.values()) == 50 and sum(sizes.values()) == sum(len(ids_of(t)) for _, t in rows)
    assert sum(n for n in sizes.values() if n < 50 and n & (n - 1)) == 0


def test_lanes_end_when_they_hold_too_much(spark):
    rows = [(k, "word " * 40) for k in range(50)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    made = squares.placements(docs, TOKENIZER, 64, held_bytes=500).collect()
    assert all(r.level == 41 and r.offset == 0 for r in made) and len({r.sequence_id for r in made}) == 50  # nothing fits beside another
    check_packing(rows, packed(spark, rows, capacity=64), 64)


def test_groups_of_open_windows(spark):
    rng = random.Random(2)
    opened = {k: rng.randrange(1, 64) for k in range(500)}
    made = squares.refit(spark.createDataFrame(list(opened.items()), "sequence_id long, level long"), 64, group=60).collect()
    assert {r.sequence_id for r in made} == set(opened) and len(made) == 500 and len({r.group for r in made}) > 4
    for key in ("target", "group"):
        ends = defaultdict(list)
        for r in made:
            if (r.target is None) == (key == "group"):
                ends[r[key]].append((r["shift"], r["shift"] + opened[r.sequence_id]))
        for pieces in ends.values():
            pieces.sort()
            assert pieces[0][0] == 0 and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
            assert key == "group" or pieces[-1][1] == 64 or pieces[-1][1] & (pieces[-1][1] - 1) == 0


def test_online_packing_of_nothing_and_clashing_names(spark):
    assert packed(spark, []) == []
    docs = spark.createDataFrame([(1, "a b", 1, 2, 3, 4)], DOCS + ", level long, ids long, `group` long, Sequence_ID long")
    out = squares.digests(squares.pack_online(docs, TOKENIZER))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sum(r["length"] for r in out.collect()) == len(ids_of("a b"))


def test_online_packing_checksums(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in squares.digests(squares.pack_online(docs, TOKENIZER)).collect():
        ids = ids_of(texts[r.doc_id])
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(array("I", ids[r.start : r.start + r.length]).tobytes())


# operator 12


def cheapest(roles, texts):
    """(cost, audit, lines) by Dijkstra's method over (rows read, role of the last row)."""
    seen, faults = set(), []
    for r, t in zip(roles, texts):
        bare = t.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (r, t) in seen else "o" if bare[-1] in ".!?" else "t")
        seen.add((r, t))
    after, name = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, s, out = heapq.heappop(heap)
        if i == len(roles) and s in ("", "a"):
            return cost, audit, "\n".join(out)
        if (i, s) in done:
            continue
        done.add((i, s))
        heapq.heappush(heap, (cost + 2, audit + "I", i, after[s], (*out, name[after[s]] + ":")))
        if i < len(roles):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, s, out))
            if faults[i] not in "bd":
                more = int(faults[i] == "t")
                if (s, roles[i][:1]) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles[i][:1], (*out, f"{roles[i]}:{texts[i]}")))
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, after[s], (*out, f"{name[after[s]]}:{texts[i]}")))


def audit_of(rows):
    """What the query is to return for a conversation's damaged rows, in order."""
    turns, roles, texts = zip(*rows) if rows else ((), (), ())
    cost, audit, lines = cheapest(roles, texts)
    told = [t for t in turns if t is not None]
    blank = [not t.strip(" \t\n\x0b\x0c\r") for t in texts]
    pairs = list(zip(roles, texts))
    dup = [not b and p in pairs[:k] for k, (b, p) in enumerate(zip(blank, pairs))]
    cut = [not b and not d and t.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?" for b, d, t in zip(blank, dup, texts)]
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    return (max(told) - min(told) + 1 - len(set(told)) if told else 0, sum(blank), sum(dup), sum(cut), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())


def some_rows(rng, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", " "]
    return [(rng.randrange(-1, 3), rng.choice(roles), rng.choice(["a.", "b!", "c", "d ", "e?\n", " ", "", "f.", "g.", "h"])) for _ in range(n)]


def damaged_by_hand(rows):
    out = []
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role = "user" if k == 4 else role
        text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
        out += [(c, turn, role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def in_order(rows):
    """(turn, role, text) of each conversation: by turn, nulls first, then by role and the MD5 of the text."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn, role, text))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest())) for c, r in own.items()}


def facts(out):
    found = {r["conv_id"]: tuple(r[c] for c in (*repair.COUNTS, "audit", "repaired_sha256")) for r in out.collect()}
    assert len(found) == out.count()
    return found


def test_damage_by_hand(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, k % 40]), rng.choice([None, k % 9]), rng.choice([None, "user", "system"]), rng.choice([None, "A. b? c!", "x"])) for k in range(400)]
    found = Counter((r.conv_id, r.turn, r.role, r.text) for r in repair.damage(spark.createDataFrame(rows, CONVERSATIONS)).where("not dropped").collect())
    assert found == Counter(damaged_by_hand(rows))


def test_one_conversation_against_dijkstra():
    rng = random.Random(3)
    for _ in range(3000):
        rows = some_rows(rng, rng.randrange(0, 9))
        roles, texts = [r[1] for r in rows], [r[2] for r in rows]
        _, cost, audit, new_roles, new_texts = repair.repair_one([0] * len(rows), roles, texts)
        assert (cost, audit, "\n".join(f"{a}:{b}" for a, b in zip(new_roles, new_texts))) == cheapest(roles, texts)


@pytest.mark.parametrize("block_rows", [3, 20_000])
def test_repair_in_blocks_against_dijkstra(spark, block_rows):
    rng = random.Random(block_rows)
    rows = [(c, t, r, x) for c in [None, *range(40)] for t, r, x in some_rows(rng, rng.randrange(1, 30))]
    rows += [(77, t, "user", "the same.") for t in range(60)] + [(78, None, "assistant", "again.")] * 80
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumn("dropped", F.lit(False)).repartition(5)
    fixed = repair.repair(df, block_rows=block_rows)
    found = {r.conv_id: r for r in fixed.conversations.collect()}
    text = defaultdict(list)
    for r in sorted(fixed.rows().collect(), key=lambda r: (r.part, r.block, r.place)):
        text[r.conv_id].append(f"{r.role}:{r.text}")
    want = in_order(rows)
    assert set(found) == set(want)
    for c, own in want.items():
        digest = hashlib.sha256("\n".join(text[c]).encode()).hexdigest()
        assert (*(found[c][x] for x in repair.COUNTS), found[c].audit, digest) == audit_of(own), c


def test_audits_of_odd_rows(spark):
    rng = random.Random(11)
    rows = [(rng.choice([None, *range(-6, 30)]), rng.choice([None, 0, 1, 2, 5]), rng.choice([None, "", "user", "assistant", "system", "User"]), rng.choice([None, "", " \n", "Yes.", "No", "wörd!", "x" * 20_000])) for _ in range(300)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumns({"Dropped": F.lit(1), "digest": F.lit(2), "KEY": F.lit(3), "part": F.lit(4)})
    want = {c: audit_of(own) for c, own in in_order(damaged_by_hand(rows)).items()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert facts(repair.audited(df)) == {c: want.get(c, nothing) for c in {r[0] for r in rows}}


def test_a_conversation_whose_rows_all_go(spark):
    gone = next((c, t) for c in range(100) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    assert facts(repair.audited(spark.createDataFrame([(*gone, "user", "x")], CONVERSATIONS))) == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert facts(repair.audited(spark.createDataFrame([], CONVERSATIONS))) == {}


# operator 13


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn, role or "", text or ""))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest())
    own = {c: [x[1:] for x in sorted(r, key=key)] for c, r in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = Counter(n[:-1] for n in members if n)
    words = lambda t: len(t.translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ")) - t.translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ").count("")
    leaves, saved = Counter(), Counter()
    for n, own_members in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(own_members) - 1) * words(n[-1][1]) if n else 0
    ends = lambda n: ",".join(str(c) for c in sorted(c for c in members[n] if whole[c] == n))
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(ends(n).encode()).hexdigest()) for n, m in members.items())


def trie_rows(df):
    return sorted(tuple(r) for r in prefix_trie.trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.mark.parametrize("seed", range(3))
def test_trie_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-45, 130), 90):
        rows += [(c, rng.choice([None, t, t]), rng.choice(["u", "a", None]), rng.choice(["one", "two words", None, "", "\t x \n"])) for t in range(rng.randrange(0, 7))]
    rows += [(None, 1, "u", "x")] + rows[:30]
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumns({"KEY": F.lit(1), "depth": F.lit(2), "Part": F.lit(3), "tail": F.lit(4)}).repartition(6)
    assert trie_rows(df) == brute_trie(rows)


def test_trie_of_one_long_and_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "DEPTHS", 8)
    monkeypatch.setattr(prefix_trie, "IDS", 5)
    rows = [(3, t, "u", f"w{t} x") for t in range(70)] + [(c, t, "u", f"w{t} x") for c in range(4, 44) for t in range(3)]
    rows += [(c, t, "u", f"w{t} x") for c in range(50, 60) for t in range(c)]
    assert trie_rows(spark.createDataFrame(rows, CONVERSATIONS)) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie_rows(spark.createDataFrame([], CONVERSATIONS)) == []
    assert trie_rows(spark.createDataFrame([(None, 1, "u", "x")], CONVERSATIONS)) == []
    turnless = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert trie_rows(spark.createDataFrame([(turnless, 1, "u", "x")], CONVERSATIONS)) == brute_trie([(turnless, 1, "u", "x")])
