"""Operator 12: conversation structure repair by tight arcs.

Edits of a conversation are arcs of a graph whose nodes are (rows read, role of the last row written). Forward and
backward minimum costs tell the arcs that lie on a cheapest path; a frontier that takes the least letter of its tight
arcs at each step spells the least of all cheapest audits.

Rows are dealt by ranges of (conversation, turn), so a conversation of any length is spread over tasks. One that lies
inside a task and a block is repaired at once. The others are cut into blocks: a block is a matrix of least costs from
state to state, matrices chained forward and backward give each block its costs at both ends, and the states in which
blocks are entered are chained last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tablesmith.llm.common import materialize, ordered_sha256, partitions, small_batches

#: Rows and bytes of text of a block at most (a longer text is a block of its own).
BLOCK_ROWS, BLOCK_BYTES = 20_000, 8 << 20
#: Costs of the edits, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing written yet; the last row written is a system, user, assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state after a row of the next role in turn, which is what an insertion or a new role gives.
NEXT = (USER, USER, ASSISTANT, USER)
#: The state after a row is kept, by its initial and the state before.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\x0c\r"
FAR = 1 << 40
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: rows damaged by the checksum of conv_id:turn; a dropped row stays as a mark."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    role = F.when(k == 4, "user").otherwise(text("role"))
    hurt = F.when(k == 1, "").when(k == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    copies = F.array_repeat(k == 0, F.when(k == 3, 2).otherwise(1))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), hurt.alias("text"), F.explode(copies).alias("dropped"))


def arcs(code: str) -> Iterator[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of the edits of a row, by its initial and its fault (b, d, t or o for none)."""
    initial, fault = code
    for s in range(4):
        yield "D", s, s, DELETE
        if fault not in "bd":
            more = TRUNCATED * (fault == "t")
            if s in KEPT.get(initial, ()):
                yield "K", s, KEPT[initial][s], more
            yield "R", s, NEXT[s], REROLE + more


_ARCS = {a + b: list(arcs(a + b)) for a in "sua-" for b in "bdto"}


def inserted(costs: list[int]) -> list[int]:
    """Forward costs with insertions: the two chains that can pay, up to a user row and on to an assistant row."""
    c = list(costs)
    c[USER] = min(c[USER], INSERT + min(c[START], c[SYSTEM], c[ASSISTANT]))
    c[ASSISTANT] = min(c[ASSISTANT], INSERT + c[USER])
    return c


def forward(codes: list[str], costs: list[int]) -> list[list[int]]:
    """Least costs of each state before each row, insertions included, and after the last, not included."""
    made = []
    for code in codes:
        costs = inserted(costs)
        made.append(costs)
        after = [FAR] * 4
        for _, s, t, w in _ARCS[code]:
            after[t] = min(after[t], costs[s] + w)
        costs = after
    return [*made, costs]


def to_end(costs: list[int]) -> list[int]:
    """Backward costs with insertions."""
    c = [min(costs[s], INSERT + costs[NEXT[s]]) for s in range(4)]
    return [min(c[s], INSERT + c[NEXT[s]]) for s in range(4)]


def backward(codes: list[str], costs: list[int]) -> list[list[int]]:
    """Least costs from each state before each row to the end, and the given ones after the last row."""
    made = [costs]
    for code in reversed(codes):
        before = [FAR] * 4
        for _, s, t, w in _ARCS[code]:
            before[s] = min(before[s], w + costs[t])
        costs = to_end(before)
        made.append(costs)
    return made[::-1]


#: Costs after the last row: no rows at all, or an assistant's as the last.
ACCEPT = to_end([0, FAR, FAR, 0])
BEGIN = [0, FAR, FAR, FAR]


def traverse(codes: list[str], ahead: list[list[int]], behind: list[list[int]], total: int, state: int, last: bool) -> tuple[str, int]:
    """The least letters along tight arcs from a state before the first row, and the state after the last row.

    Insertions after the last row belong to the last block of a conversation only.
    """
    letters, at, frontier = [], 0, {state}
    while True:
        found: dict[str, set[tuple[int, int]]] = {}
        for s in frontier:
            f = ahead[at][s]
            if at < len(codes):
                for letter, a, t, w in _ARCS[codes[at]]:
                    if a == s and f + w + behind[at + 1][t] == total:
                        found.setdefault(letter, set()).add((at + 1, t))
            elif not last or s in (START, ASSISTANT):
                return "".join(letters), s
            if (at < len(codes) or last) and f + INSERT + behind[at][NEXT[s]] == total:
                found.setdefault("I", set()).add((at, NEXT[s]))
        letter = min(found)
        letters.append(letter)
        frontier = {t for _, t in found[letter]}
        at += letter != "I"


def faults(roles: list[str], texts: list[str], first: Iterable[bool]) -> list[str]:
    """A row's initial (s, u, a, else -) and its first fault: b blank, d duplicate, t truncated, o none."""
    codes = []
    for role, text, new in zip(roles, texts, first, strict=True):
        bare = text.rstrip(WHITE)
        fault = "b" if not bare else "d" if not new else "o" if bare[-1] in ".!?" else "t"
        codes.append((role[:1] if role[:1] in ("s", "u", "a") else "-") + fault)
    return codes


def firsts(keys: list) -> list[bool]:
    seen: set = set()
    return [not (k in seen or seen.add(k)) for k in keys]


class Measure(NamedTuple):
    """What a block, or several in a row, has besides its costs; chained by adding."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    head: str | None = None
    tail: str | None = None

    def __add__(self, other: Measure) -> Measure:
        if other.head is None or self.head is None:
            return self if other.head is None else other
        joint = int(self.tail + other.head not in LEGAL)
        same = int(self.high is not None and self.high == other.low)
        return Measure(*(self[k] + other[k] for k in range(3)), self.illegal + other.illegal + joint, self.turns + other.turns - same, other.low if self.low is None else self.low, self.high if other.high is None else other.high, self.head, other.tail)

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def measure(codes: list[str], turns: list[int | None]) -> Measure:
    """Of rows in order of turn, nulls first."""
    if not codes:
        return Measure()
    told = [t for t in turns if t is not None]
    count = lambda x: sum(c[1] == x for c in codes)
    illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(codes, codes[1:], strict=False))
    return Measure(count("b"), count("d"), count("t"), illegal, len(set(told)), told[0] if told else None, told[-1] if told else None, codes[0][0], codes[-1][0])


def apply(letters: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """The roles and texts that edits from a state on leave."""
    out_roles, out_texts, at = [], [], 0
    for letter in letters:
        if letter in "IR":
            state = NEXT[state]
            out_roles.append(ROLES[state])
            out_texts.append("" if letter == "I" else texts[at])
        elif letter == "K":
            state = KEPT[roles[at][:1]][state]
            out_roles.append(roles[at])
            out_texts.append(texts[at])
        at += letter != "I"
    return out_roles, out_texts


def repair_one(turns: list[int | None], roles: list[str], texts: list[str]) -> tuple[Measure, int, str, list[str], list[str]]:
    """A whole conversation's rows, in order: its measures, cost, audit, and the repaired roles and texts."""
    codes = faults(roles, texts, firsts(list(zip(roles, texts, strict=True))))
    ahead, behind = forward(codes, BEGIN), backward(codes, ACCEPT)
    ahead[-1] = inserted(ahead[-1])
    letters, _ = traverse(codes, ahead, behind, behind[0][START], START, True)
    return measure(codes, turns), behind[0][START], letters, *apply(letters, START, roles, texts)


_OPEN = pa.schema([("key", pa.string()), ("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("done", pa.bool_()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("turns", pa.list_(pa.int64())), ("digests", pa.list_(pa.string()))])
_OPEN_DDL = f"key string, conv_id long, part int, block int, done boolean, {', '.join(f'{c} long' for c in COUNTS)}, audit string, roles array<string>, texts array<string>, turns array<long>, digests array<string>"


def blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Damaged rows -> repaired conversations (done), and blocks of those that may lie in several tasks or are long."""
    small_batches(rows.sparkSession)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest"]
    # identical rows are spread by their place in the scan, so that none of them is too many for a task
    salted = rows.withColumns({"digest": F.md5("text"), "_salt": F.monotonically_increasing_id()})
    ranged = salted.repartitionByRange(partitions(rows.sparkSession), *order, "_salt").sortWithinPartitions(*order)

    def run(batches) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []
        own, size, block, now, begun = [], 0, 0, None, False

        def close(edge: bool) -> None:
            nonlocal own, size, block
            kept = [r[:4] for r in own if not r[4]]
            turns, roles, texts, digests = map(list, zip(*kept, strict=True)) if kept else ([], [], [], [])
            key = "" if now is None else str(now)
            if edge or block:
                out.append((key, now, part, block, False, *[None] * 7, roles, texts, turns, digests))
            else:
                m, cost, audit, roles, texts = repair_one(turns, roles, texts)
                out.append((key, now, part, 0, True, m.gaps(), *m[:4], cost, audit, roles, texts, None, None))
            own, size, block = [], 0, block + 1

        first = True  # the task's first conversation may have begun before it, and the last may go on after it
        for batch in batches:
            for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and conv_id != now:
                    close(first)
                    first, block = False, 0
                elif begun and (len(own) >= block_rows or size >= block_bytes):
                    block = max(block, 1)
                    close(True)
                begun, now = True, conv_id
                own.append(row)
                size += len(row[2])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OPEN, strict=True)], schema=_OPEN)
                out = []
        if begun:
            close(True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OPEN, strict=True)], schema=_OPEN)

    return ranged.select("conv_id", "turn", "role", "text", "digest", "dropped").mapInArrow(run, _OPEN_DDL)


_AT = ["key", "part", "block"]


def _by_rows(df: DataFrame, f: Callable[[dict], dict], kinds: str) -> DataFrame:
    """f(row) -> row, batch by batch."""
    schema = to_arrow_schema(df.sparkSession.createDataFrame([], kinds).schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pylist([f(r) for r in batch.to_pylist()], schema=schema)

    return df.mapInArrow(run, kinds)


def _codes(joined: str) -> list[str]:
    return [joined[k : k + 2] for k in range(0, len(joined), 2)]


def _measured(r: dict) -> dict:
    found = set(r["firsts"] or ())
    codes = faults(r["roles"], r["texts"], [k in found for k in range(len(r["roles"]))])
    matrix = [forward(codes, [0 if s == t else FAR for t in range(4)])[-1] for s in range(4)]
    return {c: r[c] for c in ("key", "conv_id", "part", "block")} | {"codes": "".join(codes), "matrix": matrix} | measure(codes, r["turns"])._asdict()


_MEASURED = "key string, conv_id long, part int, block int, codes string, matrix array<array<long>>, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, head string, tail string"


def _chain_costs(table: pa.Table) -> pa.Table:
    """Costs at both ends of every block of a conversation, and the conversation's measures."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["block"]))
    ahead, total = [BEGIN], Measure()
    for r in rows:
        ahead.append([min(FAR, *(ahead[-1][s] + r["matrix"][s][t] for s in range(4))) for t in range(4)])
        total += Measure(*(r[c] for c in Measure._fields))
    behind = [ACCEPT]
    for r in reversed(rows):
        behind.append([min(FAR, *(r["matrix"][s][t] + behind[-1][t] for t in range(4))) for s in range(4)])
    behind.reverse()
    facts = {"gaps": total.gaps(), **{c: total._asdict()[c] for c in COUNTS[1:-1]}, "cost": behind[0][START]}
    made = [{"key": r["key"], "part": r["part"], "block": r["block"], "ahead": ahead[k], "behind": behind[k + 1], "last": k == len(rows) - 1, **facts} for k, r in enumerate(rows)]
    long = pa.int64()
    return pa.Table.from_pylist(made, schema=pa.schema([("key", pa.string()), ("part", pa.int32()), ("block", pa.int32()), ("ahead", pa.list_(long)), ("behind", pa.list_(long)), ("last", pa.bool_()), *((c, long) for c in COUNTS)]))


_CHAINED = f"key string, part int, block int, ahead array<long>, behind array<long>, last boolean, {', '.join(f'{c} long' for c in COUNTS)}"


def _paths(r: dict) -> dict:
    """Letters and exit of a block for every state in which a cheapest path can enter it."""
    codes = _codes(r["codes"])
    ahead, behind = forward(codes, r["ahead"]), backward(codes, r["behind"])
    if r["last"]:
        ahead[-1] = inserted(ahead[-1])
    found = [traverse(codes, ahead, behind, r["cost"], s, r["last"]) if r["ahead"][s] + behind[0][s] == r["cost"] else (None, None) for s in range(4)]
    return {c: r[c] for c in _AT} | {"letters": [a for a, _ in found], "exits": [b for _, b in found]}


def _chain_states(table: pa.Table) -> pa.Table:
    """The state in which each block of a conversation is entered."""
    rows, state, made = sorted(table.to_pylist(), key=lambda r: (r["part"], r["block"])), START, []
    for r in rows:
        made.append((r["key"], r["part"], r["block"], state))
        state = r["exits"][state]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=[*_AT, "entry"])


def _applied(r: dict) -> dict:
    roles, texts = apply(r["path"], r["entry"], r["roles"], r["texts"])
    return {c: r[c] for c in ("key", "conv_id", "part", "block")} | {"roles": roles, "texts": texts}


class Repaired(NamedTuple):
    """conversations: conv_id, counts, cost, audit, a row each. blocks: the repaired rows of each, as (key, conv_id,
    part, block, roles, texts) in order of part and block; key is the conv_id as a text, empty for null."""

    conversations: DataFrame
    blocks: DataFrame

    def rows(self) -> DataFrame:
        """conv_id, part, block, place, role, text: the repaired rows, ordered by part, block and place."""
        at = F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "r")
        return self.blocks.select("conv_id", "part", "block", at).select("conv_id", "part", "block", "place", F.col("r.roles").alias("role"), F.col("r.texts").alias("text"))


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> Repaired:
    """Repair conversations (conv_id, turn, role, text, dropped) as cheaply as can be.

    Rows go by turn, nulls first; rows that share a turn by role, then by the MD5 of their text. A null conv_id is a
    conversation of its own. role and text may not be null (see damage). No rows: no conversations.
    """
    all_blocks = materialize(blocks(rows, block_rows, block_bytes), "blocks")
    done, cut = all_blocks.where("done"), all_blocks.where("not done")
    each = cut.select(*_AT, F.posexplode(F.arrays_zip("roles", "digests")).alias("at", "r"))
    first = each.groupBy("key", "r").agg(F.min(F.struct("part", "block", "at")).alias("f"))
    first = first.groupBy("key", F.col("f.part").alias("part"), F.col("f.block").alias("block")).agg(F.collect_list("f.at").alias("firsts"))  # at most a block's rows
    measured = materialize(_by_rows(cut.join(first, _AT, "left").select("key", "conv_id", "part", "block", "roles", "texts", "turns", "firsts"), _measured, _MEASURED), "measured")
    # a row a block: a conversation's blocks are few, at most its rows / BLOCK_ROWS and two a task
    chained = materialize(measured.drop("codes", "conv_id").groupBy("key").applyInArrow(_chain_costs, _CHAINED), "chained")
    paths = materialize(_by_rows(measured.select(*_AT, "codes").join(chained.select(*_AT, "ahead", "behind", "last", "cost"), _AT), _paths, "key string, part int, block int, letters array<string>, exits array<int>"), "paths")
    entered = paths.select(*_AT, "exits").groupBy("key").applyInArrow(_chain_states, "key string, part int, block int, entry int")
    chosen = materialize(paths.join(entered, _AT).select(*_AT, "entry", F.get("letters", F.col("entry")).alias("path")), "chosen")
    audits = chosen.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "block", "path"))), lambda x: x["path"]), "").alias("audit"))
    facts = chained.where("last").select("key", *COUNTS).join(audits, "key").withColumn("conv_id", F.when(F.col("key") != "", F.col("key")).cast("long"))
    columns = ["key", "conv_id", *COUNTS, "audit"]
    fixed = _by_rows(cut.select("key", "conv_id", "part", "block", "roles", "texts").join(chosen, _AT), _applied, "key string, conv_id long, part int, block int, roles array<string>, texts array<string>")
    return Repaired(done.select(*columns).unionByName(facts.select(*columns)), done.select(*fixed.columns).unionByName(materialize(fixed, "repaired")))


def lines(roles: Column | str, texts: Column | str) -> Column:
    """role:text of each row, newline-joined."""
    return F.array_join(F.zip_with(roles, texts, lambda r, t: F.concat(r, F.lit(":"), t)), "\n")


def audited(conversations: DataFrame) -> DataFrame:
    """Damage and repair conversations; a row per conv_id with its counts, cost, audit and the repaired rows' digest."""
    fixed = repair(damage(conversations))
    chunks = fixed.blocks.select("key", "part", "block", F.size("roles").alias("n"), lines("roles", "texts").alias("text"))
    each = chunks.where("n > 0").select("key", F.sha2("text", 256).alias("sha256")).groupBy("key").agg(F.count(F.lit(1)).alias("chunks"), F.first("sha256").alias("sha256"))
    one, several = each.where("chunks = 1").select("key", "sha256"), each.where("chunks > 1").select("key")
    more = ordered_sha256(chunks.where("n > 0").join(several, "key", "left_semi"), "key", ["part", "block"], "text", "\n")
    digest = F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return fixed.conversations.join(one.unionByName(more), "key", "left").select("conv_id", *COUNTS, "audit", digest)
