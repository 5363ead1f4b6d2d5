"""DuckDB SQL of ``op11``: the lattice walked row by row for all conversations at once."""

from __future__ import annotations

EDIT = "struct(c bigint, a varchar, t varchar)"


def _edit(state: str, cost: str, letter: str, turn: str | None = None, when: str = "true") -> str:
    said = f" || chr(10) || {turn}" if turn else ""
    return f"case when {state} is not null and {when} then {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t{said}}} end"


def _least(*edits: str) -> str:
    return f"list_min([{', '.join(edits)}])"


def _row(state: str, makes: str, keeps: str) -> list[str]:
    """Keep a row whose role begins with ``keeps``, or make it a turn of ``makes``."""
    cost = "(case fault when 't' then 3 else 0 end)"
    return [
        _edit(state, cost, "K", "role || ':' || text", f"fault in ('t', 'k') and initial = '{keeps}'"),
        _edit(state, f"3 + {cost}", "R", f"'{makes}:' || text", "fault in ('t', 'k')"),
    ]


def _drop(state: str) -> str:
    return _edit(state, "4", "D")


_opened = f"""
    select conv_id, i, s0, s1, u, {_least('s3', _edit('u', '3', 'I', "'assistant:'"))} as a
    from (select conv_id, i, s0, s1, s3, {_least('s2', *[_edit(s, '3', 'I', "'user:'") for s in ('s0', 's1', 's3')])} as u from walk)
"""

SQL = rf"""
with recursive crc as (
  select list(v order by n) as crc from (
    select n, list_reduce(list_prepend(n, list_transform(range(8), lambda k: -1::bigint)),
      lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end) as v
    from (select unnest(range(256)) as n))
),
hashed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(
      string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)),
      lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 20 as f
  from conversations, crc
),
damaged as (
  select conv_id, turn, case f when 4 then 'user' else role end as role,
    case f when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case f when 3 then [1, 2] else [1] end) as copy
  from hashed where f <> 0
),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged
),
marked as (
  select *, left(role, 1) as initial, regexp_replace(text, '[\x20\x09-\x0D]+$', '') as solid,
    row_number() over (partition by conv_id, role, text order by i) > 1 as again,
    lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair
  from placed
),
r as (
  select *, case when solid = '' then 'b' when again then 'd' when right(solid, 1) not in ('.', '!', '?') then 't' else 'k' end as fault from marked
),
counts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
    count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
  from r group by 1
),
walk as (
  select conv_id, 0::bigint as i, {{'c': 0::bigint, 'a': '', 't': ''}} as s0,
    null::{EDIT} as s1, null::{EDIT} as s2, null::{EDIT} as s3
  from counts
  union all
  select o.conv_id, o.i + 1, {_drop('s0')},
    {_least(_drop('s1'), _row('s0', 'user', 's')[0])},
    {_least(_drop('u'), *[e for s in ('s0', 's1', 'a') for e in _row(s, 'user', 'u')])},
    {_least(_drop('a'), *_row('u', 'assistant', 'a'))}
  from ({_opened}) o join r on r.conv_id is not distinct from o.conv_id and r.i = o.i + 1
),
best as (
  select o.conv_id, {_least('s0', 'a')} as e from ({_opened}) o join counts on counts.conv_id is not distinct from o.conv_id and counts.n = o.i
)
select v.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(e.c, 0)::bigint as cost,
  coalesce(e.a, '') as audit, sha256(coalesce(substr(e.t, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) v
left join counts on counts.conv_id is not distinct from v.conv_id
left join best on best.conv_id is not distinct from v.conv_id
"""
