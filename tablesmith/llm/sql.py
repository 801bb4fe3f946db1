"""DuckDB SQL for the registered queries that SQL can express."""

from tablesmith.llm.decontaminate import SLOP
from tablesmith.llm.licenses import COPYRIGHT_LINE, LICENSES, SPELLINGS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), {_quoted(COPYRIGHT_LINE)}, ' ', 'g')"
    out = f"' ' || regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim({out}, ' ')"


_KNOWN = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(LICENSES.items()))

_OP3 = r"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as payload_bytes, sha1(b) as hex from p),
f as (select *, min(page_id) over (partition by hex) as first_id from d),
bits as (select page_id, payload_bytes, first_id, lpad(bin(('0x' || substr(hex, 10 * g - 9, 10))::bigint), 40, '0') as b, g
         from f, range(1, 5) t(g)),
letters as (select page_id, payload_bytes, first_id,
            string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (substr(b, 5 * i - 4, 1)::int * 16 + substr(b, 5 * i - 3, 1)::int * 8
            + substr(b, 5 * i - 2, 1)::int * 4 + substr(b, 5 * i - 1, 1)::int * 2 + substr(b, 5 * i, 1)::int), 1), '' order by g, i) as payload_digest
            from bits, range(1, 9) u(i) group by all)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id <> first_id then first_id end as refers_to from letters
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP6 = rf"""
with dw as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') as w from documents),
bw as (select item_id::varchar as item, regexp_extract_all({_LOWER.format("text")}, '{_WORD}') as w from benchmark where text is not null),
b as (select item, w, least(10, len(w)) as k from bw where len(w) > 0),
ph as (select distinct item, k, array_to_string(w[i : i + k - 1], ' ') as phrase from b, range(1, len(b.w) - b.k + 2) t(i)),
ks as (select distinct k from ph),
dp as (select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') as phrase from dw, ks, range(1, greatest(1, len(dw.w) - ks.k + 2)) t(i)),
m as (select doc_id, i, dp.k, item from dp join ph on dp.phrase = ph.phrase and dp.k = ph.k),
hits as (select doc_id, count(distinct i + j) as n_hit from m, range(0, m.k) u(j) group by doc_id),
pt as (select row_number() over () as p, item, k, list_distinct(string_split(phrase, ' ')) as t from ph),
df as (select w, count(*) as n from (select unnest(w) as w from dw) group by 1),
rare as (select p, arg_min(w, n) as w, count(*) as c from (select p, unnest(t) as w from pt) join df using (w) group by p),
spots as (select doc_id, unnest(w) as w, unnest(range(1, len(w) + 1)) as i from dw),
tried as (select distinct doc_id, item, pt.k + {SLOP} as span, t, s from rare join pt using (p) join spots using (w), range(greatest(1, i - pt.k - {SLOP} + 1), i + 1) r(s) where c = len(t)),
near as (select doc_id, string_agg(item, ',' order by item) as near_items from (select distinct tried.doc_id, item from tried join dw using (doc_id) where list_has_all(dw.w[s : s + span - 1], t)) group by doc_id),
items as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as h from (select distinct doc_id, item from m) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       coalesce(h, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(near_items, '') as near_items
from dw d left join hits using (doc_id) left join items using (doc_id) left join near using (doc_id)
"""

#: The checksum table by its bits, and the checksum of an ASCII text.
_CRC_TABLE = "[list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, n) for n in range(256)]"


def _crc32(text: str) -> str:
    """Of an ASCII text, where a column `crc` has the table."""
    return f"xor(4294967295, list_reduce([ord(x)::bigint for x in string_split({text}, '')], lambda c, x: xor(crc[xor(c & 255, x) + 1], c >> 8), 4294967295))"


_ROLE, _BARE = "left({}, 1)", r"rtrim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _plus(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """A state's struct after an edit; null stays null."""
    more = f"list_append({state}.t, {line})" if line else f"{state}.t"
    return f"case when {state} is not null then {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {more}}} end"


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _with_insertions(source: str) -> str:
    u = _least("u", *[_plus(s, "2", "I", "'user:'") for s in ("z", "s", "a")])
    return f"select * exclude (a), {_least('a', _plus('u', '2', 'I', chr(39) + 'assistant:' + chr(39)))} as a from (select * exclude (u), {u} as u from ({source}))"


def _op12() -> str:
    keep = lambda s: _plus(s, "bad", "K", "role || ':' || text")  # noqa: E731
    role = lambda s, r: _plus(s, "2 + bad", "R", f"'{r}:' || text")  # noqa: E731
    only = lambda i, x: f"case when stays and initial = '{i}' then {x} end"  # noqa: E731
    may = lambda x: f"case when stays then {x} end"  # noqa: E731
    gone = lambda s: _plus(s, "3", "D")  # noqa: E731
    step = f"""select c.conv, c.i + 1 as i, {gone("z")} as z, {_least(gone("s"), only("s", keep("z")))} as s,
{_least(gone("u"), *[only("u", keep(x)) for x in "zsa"], *[may(role(x, "user")) for x in "zsa"])} as u,
{_least(gone("a"), only("a", keep("u")), may(role("u", "assistant")))} as a from c join f on f.conv = c.conv and f.i = c.i + 1"""
    return rf"""
with recursive t as (select {_CRC_TABLE} as crc),
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as k from conversations, t),
hurt as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case k when 0 then [] when 3 then [1, 2] else [1] end) as copy from k),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth from hurt),
f as (select conv_id, coalesce(conv_id::varchar, '') as conv, i, turn, role, text, {_ROLE.format("role")} as initial, {_BARE.format("text")} = '' as blank, {_BARE.format("text")} <> '' and nth > 1 as dup,
 {_BARE.format("text")} <> '' and nth = 1 and right({_BARE.format("text")}, 1) not in ('.', '!', '?') as cut, not ({_BARE.format("text")} = '' or nth > 1) as stays, case when {_BARE.format("text")} <> '' and nth = 1 and right({_BARE.format("text")}, 1) not in ('.', '!', '?') then 1 else 0 end as bad,
 lag({_ROLE.format("role")}) over (partition by conv_id order by i) as prior from o),
facts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (dup) as duplicate, count(*) filter (cut) as truncated, count(*) filter (i > 1 and prior || initial not in ('su', 'ua', 'au')) as illegal, count(*) as n from f group by 1),
ids as (select distinct conv_id, coalesce(conv_id::varchar, '') as conv from conversations),
c as (select conv, 0::bigint as i, {{'c': 0::bigint, 'a': '', 't': []::varchar[]}} as z, null::struct(c bigint, a varchar, t varchar[]) as s, {{'c': 2::bigint, 'a': 'I', 't': ['user:']}} as u, {{'c': 4::bigint, 'a': 'II', 't': ['user:', 'assistant:']}} as a from ids
 union all select conv, i, z, s, u, a from ({_with_insertions(step)})),
best as (select conv, list_min([z, a]) as b, i from c)
select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, b.c as cost, b.a as audit, sha256(array_to_string(b.t, chr(10))) as repaired_sha256
from ids left join facts on facts.conv_id is not distinct from ids.conv_id join best on best.conv = ids.conv and best.i = coalesce(n, 0)"""


_OP13 = rf"""
with t as (select {_CRC_TABLE} as crc),
o as (select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as t, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as p from conversations where conv_id is not null),
n as (select c, count(*) as n from o group by 1),
f as (select c, n, {_crc32("c::varchar")} % 4 as h, c - c % 20 as b from n, t),
g as (select f.*, least(h, coalesce(m.n, 0)) as took from f left join n m on m.c = f.b),
w as (select g.c, o.p as d, r, t from g join o on o.c = g.b and o.p <= took union all select g.c, o.p - h + took, r, t from g join o on o.c = g.c and o.p > h),
pre as (select c, d, string_agg(md5(r || chr(1) || t), '') over (partition by c order by d) as k, len(regexp_extract_all(t, '[^ 	-]+')) as words from w),
ends as (select c, coalesce(max_by(k, d), '') as k from n left join pre using (c) group by 1),
node as (select k, d, min(c) as c, count(*) as n_convs, max(words) as words from pre group by 1, 2 union all select '', 0, min(c), count(*), 0 from n having count(*) > 0),
kids as (select left(k, length(k) - 32) as k, count(*) as n from node where d > 0 group by 1),
each as (select node.*, coalesce(kids.n, 0) as n_children from node left join kids using (k)),
up as (select left(k, 32 * i) as k, sum((n_convs - 1) * words) as saved, count(*) filter (n_children = 0) as n_leaves from each, range(0, d + 1) u(i) group by 1),
told as (select k, sha256(string_agg(c::varchar, ',' order by c)) as h from ends group by 1)
select each.c as conv_id, each.d as depth, parent.c as parent_conv_id, each.n_convs, each.n_children, n_leaves, saved::bigint as saved_tokens, coalesce(h, sha256('')) as ends_sha256
from each join up using (k) left join told using (k) left join node parent on each.d > 0 and parent.k = left(each.k, length(each.k) - 32)
"""

ORACLES = {
    "op3_warc": _OP3,
    "op4_license_scan": f"""
with known as (select sha256({_canonical("text")}) as canonical_digest, min(license_id) as license_id from (values {_KNOWN}) t(license_id, text) group by 1),
d as (select doc_id, sha256({_canonical("text")}) as canonical_digest from documents)
select doc_id, canonical_digest, license_id from d left join known using (canonical_digest)""",
    "op6_decontamination": _OP6,
    "op12_structure_repair": _op12(),
    "op13_prefix_trie": _OP13,
}
