"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

from corpusloom.llm import licenses, quality_rules, url_filter

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]+"


def mixing() -> str:
    return rf"""
with base as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as key
  from documents),
sized as (
  select source, sum(size)::bigint as source_size,
         [5, 2, 1][((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::int] as weight
  from base group by source),
filled as (
  select *, 3 * source_size as cap, (3 * source_size)::double / weight as full_at, (select sum(source_size) from sized) as total from sized),
levels as (
  select *, (total - coalesce(sum(cap) over (order by full_at, source is null, encode(source) rows between unbounded preceding and 1 preceding), 0))::double
            / sum(weight) over (order by full_at, source is null, encode(source) rows between current row and unbounded following) as level from filled),
level as (select max(level) filter (level <= full_at) as level from levels),
aims as (
  select source, source_size, case when full_at <= level.level then cap::double else weight * level.level end as target from filled, level),
plan as (
  select *, floor(target)::bigint as budget, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as epochs from aims),
run as (
  select base.*, plan.source_size, plan.target, plan.epochs, plan.budget - plan.epochs * plan.source_size as rest,
         sum(size) over (partition by base.source order by key, doc_id, size rows unbounded preceding) - size as before
  from base join plan on base.source is not distinct from plan.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken from run"""


def quality() -> str:
    q = quality_rules
    return rf"""
with base as (
  select row_number() over () as row_id, doc_id, source, coalesce(text, '') as t from documents),
worded as (
  select *, regexp_extract_all(t, '{_WORD}') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as lines from base),
windows as (
  select row_id, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') as g from worded, lateral (select unnest(range(1, len(w) - 3)) as i)),
again as (
  select row_id, i from (select row_id, i, count(*) over (partition by row_id, g) as c from windows) where c > 1),
covered as (
  select row_id, sum(least(5, coalesce(nxt - i, 5)))::bigint as n
  from (select row_id, i, lead(i) over (partition by row_id order by i) as nxt from again) group by row_id),
line_words as (
  select row_id, source, t, regexp_replace(trim(regexp_replace(lower(l), '{_SPACE}', ' ', 'g')), '^$', '') as l
  from worded, lateral (select unnest(lines) as l)),
limits as (
  select source, greatest({float(q.LINE_MIN_DOCS)}, {q.LINE_MAX_SHARE} * count(distinct t)) as lim from base group by source),
frequent as (
  select c.source, c.l from (select source, l, count(distinct t) as docs from line_words group by source, l) c
  join limits on c.source is not distinct from limits.source where docs > lim and docs > {q.LINE_MIN_DOCS}),
removed as (
  select row_id, sum(len(string_split(x.l, ' ')))::bigint as n from line_words x join frequent f on x.source is not distinct from f.source and x.l = f.l group by row_id),
measured as (
  select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    len(regexp_extract_all(t, '{q.SYMBOLS}'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(covered.n, 0) as n_repeat_words, len(w) - coalesce(removed.n, 0) as words_left, coalesce(removed.n, 0) as gone
  from worded left join covered using (row_id) left join removed using (row_id)),
judged as (
  select *, n_words < {q.MIN_WORDS} or 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words as base_failed from measured)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words_left::bigint as words_left, base_failed,
  not base_failed and not (gone > 0 and (words_left < {q.LEFT_WORDS} or words_left < {q.LEFT_SHARE} * n_words)) as kept
from judged"""


def _plain(x: str) -> str:
    out = f"regexp_replace(lower({x}), '{licenses.COPYRIGHT_LINE}', '\\1', 'g')"
    out = f"regexp_replace({out}, '[^a-z0-9\n]+', ' ', 'g')"
    out = f"' ' || replace(replace({out}, ' ', '  '), chr(10), ' ' || chr(10) || ' ') || ' '"  # each word between spaces of its own
    for variant, spelling in licenses.SPELLINGS.items():
        out = f"replace({out}, ' {variant.replace(' ', '  ')} ', ' {spelling} ')"
    return out


def _canonical(plain: str) -> str:
    lines = f"list_filter(list_transform(string_split({plain}, chr(10)), lambda l: trim(regexp_replace(l, ' +', ' ', 'g'))), lambda l: l <> '' and not regexp_matches(l, '{licenses.TITLE}'))"
    blocks = f"list_transform(list_filter(string_split_regex({plain}, '\n[ \n]*\n'), lambda l: regexp_matches(l, '[a-z0-9] *\n *[a-z0-9]')), lambda l: trim(regexp_replace(l, '[ \n]+', ' ', 'g')))"
    return f"{lines} as ls, {blocks} as bs"


def license_scan() -> str:
    known = ", ".join(f"({i}, '{n}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (n, t) in enumerate(licenses.KNOWN))
    long = ", ".join(f"('{d}', '{n}')" for n, _, d in licenses.LONG)
    return rf"""
with texts as (select i, n, {_plain('t')} as p from (values {known}) v(i, n, t)),
known as (
  select md5(array_to_string(ls, ' ')) as d, arg_min(n, i) as license from (select i, n, {_canonical('p')} from texts) group by 1
  union all select * from (values {long}) v(d, license)),
plain as (select row_number() over () as row_id, doc_id, {_plain("coalesce(text, '')")} as p from documents),
docs as (select row_id, doc_id, md5(array_to_string(ls, ' ')) as digest, ls, bs from (select row_id, doc_id, {_canonical('p')} from plain)),
units as (select row_id, license from (select row_id, md5(l) as d from docs, lateral (select unnest(list_concat(ls, bs)) as l)) u join known using (d)),
notices as (select row_id, count(*)::bigint as n, list(license) as found from units group by row_id)
select doc_id, digest, known.license as text_license, coalesce(notices.n, 0) as notice_lines,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(found, []), case when known.license is null then [] else [known.license] end))), ','), '') as licenses
from docs left join known on docs.digest = known.d left join notices using (row_id)"""


def url_judge() -> str:
    u = url_filter
    order = sorted(u.RULES, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r), reverse=True)
    fit = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    rule = "case " + " ".join(f"when {fit(h, p)} then '{h}{p}'" for h, p, _ in order) + " end"
    verdict = "case " + " ".join(f"when {fit(h, p)} then '{v}'" for h, p, v in order) + " end"
    strength = lambda t: f"""
  (select case when n is null then {u.LEAST_STRENGTH} when v > 0 then least(most, greatest({u.LEAST_STRENGTH}, m * (1 - m) / v - 1)) else most end from (
    select n, m, least({u.MOST_STRENGTH}, greatest({u.LEAST_STRENGTH}, n)) as most, q / n - m * m - m * (1 - m) * (k - 1) / n as v from (
      select sum(pages) as n, sum(bad)::double / sum(pages) as m, count(*) as k, sum((bad * bad)::double / pages) as q from {t} where pages > 0)))"""  # noqa: E731
    suffixes = ", ".join(f"'{x}'" for x in u.SUFFIXES)
    return rf"""
with parsed as (
  select page_id, url, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
marks as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels group by doc_id),
hosts0 as (
  select host, count(marks.doc_id) as pages, coalesce(sum(bad), 0) as bad, regexp_replace(host, '^.*@|:[0-9]*$|\.$', '', 'g') as site
  from parsed left join marks on marks.doc_id = try_cast(regexp_extract(path, '/([0-9]+)\z', 1) as bigint) group by host),
named as (
  select *, regexp_matches(site, '^[0-9]+(\.[0-9]+){{3}}$') as number, array_to_string(string_split(site, '.')[-2:], '.') in ({suffixes}) as two,
    string_split(site, '.') as parts from hosts0),
hosts as (
  select host, pages, bad, case when number then site when two then array_to_string(parts[-2:], '.') else parts[-1] end as suffix,
    case when number then site when two then array_to_string(parts[-3:], '.') else array_to_string(parts[-2:], '.') end as domain from named),
domains as (select domain, suffix, sum(pages) as pages, sum(bad) as bad from hosts group by domain, suffix),
suffixes as (select suffix, sum(pages) as pages, sum(bad) as bad from domains group by suffix),
s as (select {strength('suffixes')} as s1, {strength('domains')} as s2, {strength('hosts')} as s3, (select (coalesce(sum(bad), 0) + {u.TOP[0]}) / (coalesce(sum(pages), 0) + {sum(u.TOP)}) from hosts) as m0),
m as (
  select h.host, (h.bad + s3 * ((d.bad + s2 * ((x.bad + s1 * m0) / (x.pages + s1))) / (d.pages + s2))) / (h.pages + s3) as mean, h.pages + s3 as n
  from hosts h join domains d on h.domain = d.domain join suffixes x on d.suffix = x.suffix, s),
b as (select host, mean, mean - {u.QUANTILE} * sqrt(mean * (1 - mean) / (n + 1)) as low from m)
select page_id, host, path, {rule} as rule, coalesce({verdict}, case when low > {u.MAX_BAD} then 'block' else 'allow' end) as verdict,
  round(mean, 6) as bad_rate, round(low, 6) as lower_bound from parsed join b using (host)"""


def fill_in_middle() -> str:
    digit = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::bigint"
    return rf"""
with base as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
cuts as (
  select *, {digit(0)} % (n + 1) as a, {digit(1)} % (n + 1) as b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or {digit(2)} % 100 >= 90 then 'plain' when {digit(3)} % 100 < 20 then 'spm' else 'psm' end as form from base),
parts as (
  select *, least(a, b) as lo, greatest(a, b) as hi, substring(t, 1, least(a, b)) as p, substring(t, least(a, b) + 1, greatest(a, b) - least(a, b)) as m, substring(t, greatest(a, b) + 1) as s from cuts)
select doc_id, n, form, case when form <> 'plain' then lo end as prefix_chars, case when form <> 'plain' then hi - lo end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256 from parts"""


def decontamination() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}')"
    gram = "array_to_string(w[i:i + size - 1], ' ')"
    return rf"""
with items as (select coalesce(item_id::varchar, '') as item, {words} as w, least(10, len({words})) as size from benchmark),
windows as (select distinct item, size, {gram} as g from (select *, unnest(range(1, len(w) - size + 2)) as i from items where size > 0)),
docs as (select row_number() over () as row_id, doc_id, {words} as w from documents),
places as (select row_id, size, i, {gram} as g from (select row_id, w, size, unnest(range(1, len(w) - size + 2)) as i from docs, (select distinct size from windows))),
found as (select row_id, item, places.size, i from places join windows on places.size = windows.size and places.g = windows.g),
hit as (select row_id, count(*)::bigint as n from (select distinct row_id, unnest(range(i, i + size)) as at from (select distinct row_id, size, i from found)) group by row_id),
lists as (select row_id, count(*)::bigint as n, string_agg(item, ',' order by item) as items from (select distinct row_id, item from found) group by row_id)
select doc_id, len(w)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(lists.n, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, hit.n is not null as contaminated
from docs left join hit using (row_id) left join lists using (row_id)"""
