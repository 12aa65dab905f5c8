"""SQL counterparts of the operators that SQL can express, for DuckDB."""

from __future__ import annotations

#: crc32 of the bytes ``b``: a table of 256 values by the polynomial's rule, then one step for each byte
_CRC_TABLE = """crc_table as materialized (
    select list(list_reduce(list_prepend(i, range(8)), lambda c, _ : case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as tab
    from range(256) t(i))"""


def _crc(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, with ``tab`` from ``crc_table`` in scope."""
    codes = f"list_transform(range(octet_length(encode({text}))), lambda i : ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b : xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295)"


# states of a conversation: 0 nothing yet, 1 after s, 2 after u, 3 after a; every way over one row is listed
OP11 = f"""
with recursive {_CRC_TABLE},
given as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {_crc("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind from conversations, crc_table),
damaged as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
    from given, range(2) r(copy) where kind <> 0 and (copy = 0 or kind = 3)),
placed as (select *, left(role, 1) as initial, right(rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 1) as final,
    row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as place,
    count(*) over (partition by conv_id) as rows from damaged),
marked as (select *, case when final = '' then 'blank'
    when row_number() over (partition by conv_id, role, text order by place) > 1 then 'duplicate'
    when final not in ('.', '!', '?') then 'truncated' end as fault,
    lag(initial) over (partition by conv_id order by place) as before from placed),
counted as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
    count(*) filter (where fault = 'truncated') as truncated,
    count(*) filter (where place > 1 and before || initial not in ('su', 'ua', 'au')) as illegal from marked group by conv_id),
added(state, n, letters, lines, after) as (values
    (0, 0, '', []::varchar[], 0), (0, 1, 'I', ['user:'], 2), (0, 2, 'II', ['user:', 'assistant:'], 3),
    (1, 0, '', []::varchar[], 1), (1, 1, 'I', ['user:'], 2), (1, 2, 'II', ['user:', 'assistant:'], 3),
    (2, 0, '', []::varchar[], 2), (2, 1, 'I', ['assistant:'], 3), (2, 2, 'II', ['assistant:', 'user:'], 2),
    (3, 0, '', []::varchar[], 3), (3, 1, 'I', ['user:'], 2), (3, 2, 'II', ['user:', 'assistant:'], 3)),
kept(initial, state, after) as (values ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
turned(state, after, role) as (values (0, 2, 'user'), (1, 2, 'user'), (3, 2, 'user'), (2, 3, 'assistant')),
ways as (
    select m.conv_id, m.place, a.state, a.after, 5 * a.n + 2 as cost, a.letters || 'D' as letters, a.lines from marked m, added a
    union all
    select m.conv_id, m.place, a.state, k.after, 5 * a.n + case when fault = 'truncated' then 5 else 0 end, a.letters || 'K',
        list_append(a.lines, m.role || ':' || m.text) from marked m, added a, kept k
    where k.state = a.after and k.initial = m.initial and coalesce(fault, '') not in ('blank', 'duplicate')
    union all
    select m.conv_id, m.place, a.state, t.after, 5 * a.n + 1 + case when fault = 'truncated' then 5 else 0 end, a.letters || 'R',
        list_append(a.lines, t.role || ':' || m.text) from marked m, added a, turned t
    where t.state = a.after and coalesce(fault, '') not in ('blank', 'duplicate')),
walk as (
    select conv_id, 0::bigint as place, 0 as state, 0 as cost, '' as letters, []::varchar[] as lines from counted
    union all
    select conv_id, place, state, best.cost, best.letters, best.lines from (
        select w.conv_id, w.place, w.after as state, min({{'cost': p.cost + w.cost, 'letters': p.letters || w.letters, 'lines': list_concat(p.lines, w.lines)}}) as best
        from walk p join ways w on w.conv_id is not distinct from p.conv_id and w.place = p.place + 1 and w.state = p.state
        group by all)),
ended as (select w.conv_id, min({{'cost': w.cost + 5 * a.n, 'letters': w.letters || a.letters, 'lines': list_concat(w.lines, a.lines)}}) as best
    from walk w join (select conv_id, max(place) as last from placed group by all) p on w.conv_id is not distinct from p.conv_id and w.place = p.last
    join added a on a.state = w.state where a.after = 3 or (a.after = 0 and a.n = 0) group by all)
select g.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
    coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(best.cost, 0)::bigint as cost,
    coalesce(best.letters, '') as audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) g
left join counted c on c.conv_id is not distinct from g.conv_id left join ended e on e.conv_id is not distinct from g.conv_id"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP12 = f"""
with recursive {_CRC_TABLE},
runs as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run
    from documents),
hashed as (select id, run, count(*) as times from runs where length(run) >= 7 group by all),
coded as (select run, times, {_crc("id || ':' || run")} as code from hashed, crc_table),
words as (select case when code % 31 = 0 then left(run, (code % length(run))::bigint) || substr(run, (code % length(run))::bigint + 2) else run end as word, sum(times)::bigint as n
    from coded group by 1 having length(word) >= 7 and sum(times) >= 2),
cuts as (select word, n, unnest(range(1, length(word) + 1)) as place, left(word, place - 1) || substr(word, place + 1) as rest from words),
near as (
    select a.word, b.word as other, b.n from cuts a join cuts b on a.place = b.place and a.rest = b.rest and a.word <> b.word
    union select c.word, w.word, w.n from cuts c join words w on w.word = c.rest
    union select w.word, c.word, c.n from cuts c join words w on w.word = c.rest),
best as (select word, count(*) as n_near, min({{'least': -n, 'other': other}}) as top from near group by word),
formed as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when -top.least >= 10 * w.n then top.other end as form,
    case when -top.least >= 10 * w.n then -top.least end as form_n from words w left join best b on b.word = w.word),
chain as (select word, word as here, 0 as depth from formed
    union all select c.word, f.form, depth + 1 from chain c join formed f on f.word = c.here where f.form is not null),
ends as (select word, arg_max(here, depth) as root from chain group by word)
select f.word, n, n_near::bigint as n_near, form, form_n::bigint as form_n, root from formed f join ends e on e.word = f.word"""
