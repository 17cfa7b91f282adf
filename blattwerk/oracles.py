"""SQL twins of the page and style queries for DuckDB, written from their rules.

RE2 has no look-ahead and its ``\\w`` is ASCII, so classes are spelled out and what
would be looked at is taken and put back.
"""

from __future__ import annotations

from blattwerk.functions.text import USELESS_AUTHORS, USELESS_TITLE

LINES = """lines as (select buch_id as doc, seite as page, pos, arg_max(struct_pack(t := text), (gelesen_am, zeile_id)).t as line
from zeilen group by all)"""
STYLED = """styled as (select buch_id as doc, seite as page, pos, text, groesse as size, fett as bold, laeufe as runs from zeilen
qualify row_number() over (partition by buch_id, seite, pos order by gelesen_am desc, zeile_id desc) = 1 and text is not null)"""
TOC = r"""toc as (select buch_id as doc, seite as page, ebene as level, title, min(pos) as pos from (select *, left(trim(regexp_replace(titel, '\s+', ' ', 'g')), 200) as title from lesezeichen)
where length(title) >= 2 group by all)"""
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PART = r"(?i)^(?:aufgabe|beispiel|übung|abb|abbildung|tab|tabelle|lösung|figure|example|exercise|problem|gleichung)(?:[^\p{L}\p{N}_]|$)"
SHORT_END = rf"(?:^|\(|{SPACE})(?:[\p{{L}}\p{{M}}]{{1,3}}|vgl|Abb|Tab|bzw|usw|etc|Nr|Bd|Kap|Gl|Fig|Eq|Prof|Dr)\.$"
LIST = rf"^(?:[•●▪◦\-–—*]|\(?\p{{Nd}}{{1,3}}[.)]|\(?[a-zA-Z][.)]){SPACE}"
DIVIDED = r"([\p{L}\p{M}])(?:-|[\x02\x{fffe}\x{ad}])\n[ \t]*"
NUMBER = rf"^(\p{{Nd}}{{1,2}}|[A-Z])((?:\.\p{{Nd}}{{1,2}})*)\.?{SPACE}+[^\s\x{{a0}}\x{{3000}}]"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def key(c: str) -> str:
    return rf"lower(regexp_replace({c}, '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}]+', '', 'g'))"


def numbered(c: str) -> str:
    """A number before a title; a lone letter counts only with further numbers."""
    return rf"(regexp_matches({c}, '{NUMBER}') and not regexp_matches({c}, '^[A-Z]\.?{SPACE}'))"


SECTIONS = rf"""with {LINES}, l as (select doc, page, pos, {strip("line")} as z from lines where line is not null),
r as (select *, row_number() over (partition by doc, page order by pos) as a, row_number() over (partition by doc, page order by pos desc) as b from l where z <> ''),
c as (select distinct doc, page, try_cast(unnest([regexp_extract(z, '^[-–—]?\s*(\d{{1,4}})\s*[-–—]?$', 1), regexp_extract(z, '(?i)^(?:Seite|S\.|Page)\s*(\d{{1,4}})(?:\s*(?:von|of|/)\s*\d{{1,4}})?$', 1),
regexp_extract(z, '^(\d{{1,4}})\s{{1,6}}(?:\d{{1,3}}\s+)?[^\d\s.,:;/)\-–].{{0,90}}$', 1), regexp_extract(z, '^.{{0,90}}[^\d\s.,:;/(\-–]\s{{1,6}}(\d{{1,4}})$', 1)]) as int) as number from r where (a <= 4 or b <= 4) and length(z) <= 100),
o as (select doc, page, page + 1 - number as "offset" from c where number > 0 and number < 5000),
i as (select *, case when page - lag(page) over w <= 8 then 0 else 1 end as brk from o window w as (partition by doc, "offset" order by page)),
g as (select *, sum(brk) over (partition by doc, "offset" order by page) as run from i), s as (select doc, "offset", min(page) as start, max(page) as "end", count(*) as hits from g group by doc, "offset", run),
sec as (select * from s where (hits >= 3 and hits / ("end" - start + 1) >= 0.4) or ("offset" = 0 and "end" < 6 and hits / ("end" - start + 1) >= 0.5))
"""
NUMBERS = (
    SECTIONS
    + """, core as (select doc, page, arg_max(page + 1 - "offset", (hits, start, "end", "offset")) as number from (select *, unnest(range(start, "end" + 1))::int as page from sec) where page + 1 - "offset" > 0 group by all),
steps as (select doc, "offset", hits, start, "end", unnest(["end" + 1, "end" + 2, start - 1, start - 2]) as page from sec),
best as (select doc, page, arg_max(page + 1 - "offset", ((page + 1 - "offset" = 1)::int, hits, start, "end", "offset")) as extra from steps where page >= 0 and page + 1 - "offset" > 0 and (doc, page) not in (select (doc, page) from core) group by all),
printed as (select p.doc, p.page, coalesce(number, extra)::int as number from (select distinct doc, page from lines where line is not null) p left join core using (doc, page) left join best using (doc, page))
"""
)


def edge_lines() -> str:
    """Running headers and footers, round by round."""

    def ok(c: str) -> str:
        return rf"length({c}) between 5 and 300 and not regexp_matches({c}, '{PART}') and not regexp_matches({c}, '(?:[ \t]*\.){{4,}}|…')"

    q = rf"""with {LINES}, f as (select doc, page, pos, {strip("line")} as z from lines where line is not null and {strip("line")} <> ''),
r as (select *, row_number() over (partition by doc, page order by pos) as t, count(*) over (partition by doc, page) as n, regexp_replace(z, '[0-9]+', '#', 'g') as k from f),
need as (select doc, least(8, greatest(3, ceil(count(*) * 0.6))) as need from (select distinct doc, page from f) group by doc),
known as (select doc, k from (select distinct doc, page, k from r where t = 1 or t = n) join need using (doc) group by doc, k, need having count(*) >= need and {ok("k")}),
m0 as (select r.*, n + 1 - t as b, known.k is not null or regexp_full_match(z, '\d{{1,4}}|[ivxlcdmIVXLCDM]{{1,7}}') as top, known.k is not null or regexp_full_match(z, '\d{{1,4}}|[ivxlcdmIVXLCDM]{{1,7}}') as bottom from r left join known on known.doc = r.doc and known.k = r.k)"""
    for i in (0, 1):
        q += f""", a{i} as (select doc, page, n, least(3, coalesce(min(t) filter (not top), n + 1) - 1) as a, coalesce(min(b) filter (not bottom), n + 1) - 1 as c from m{i} group by doc, page, n),
s{i} as (select m.doc, m.z, m.t = a + 1 as x, b = least(3, c, m.n - a) + 1 as y from m{i} m join a{i} using (doc, page) where a + least(3, c, m.n - a) < m.n),
w{i} as (select doc, z, count(*) filter (x) >= need as x, count(*) filter (y) >= need as y from s{i} join need using (doc) group by doc, z, need having {ok("z")}),
m{i + 1} as (select m.* exclude (top, bottom), top or coalesce(x, false) as top, bottom or coalesce(y, false) as bottom from m{i} m left join w{i} w on w.doc = m.doc and w.z = m.z)"""
    return (
        q
        + """, u as (select doc, page, n, coalesce(max(t) filter (top and t <= least(3, n - 1)), 0) as u from m2 group by all),
v as (select u.doc, u.page, u.n, u.u, coalesce(max(b) filter (bottom and b <= least(3, u.n - u.u - 1)), 0) as v from m2 join u on u.doc = m2.doc and u.page = m2.page group by u.doc, u.page, u.n, u.u),
k as (select doc, sum(n - u - v) as kept from v group by doc)
select l.doc, count(distinct page) as pages, count(*) as lines, (count(*) - coalesce(any_value(kept), 0))::bigint as removed from lines l left join k using (doc) where line is not null group by l.doc"""
    )


def size_headings() -> str:
    letters = r"length(regexp_replace(title, '\P{L}', '', 'g'))"
    return rf"""with {STYLED}, b as (select doc, arg_max(b, (n, b)) as body from (select doc, round(size * 2) / 2 as b, sum(length(text)) as n from styled where size is not null group by all) group by doc),
j as (select s.* exclude (runs), body, {numbered("text")} as num, regexp_replace(lower(text), '[0-9]+', '#', 'g') as k from styled s left join b using (doc)),
c as (select *, coalesce(size >= body * 1.15 or (num and size >= body * 1.05) or (num and bold >= 0.9 and size >= body * 0.95), false) as c from j),
f as (select doc, k, size from c where c group by all having count(distinct page) >= 3),
d as (select c.* exclude (c), c.c and f.k is null as c from c left join f on f.doc = c.doc and f.k = c.k and f.size = c.size),
e as (select *, coalesce(lag(c) over w and abs(lag(size) over w - size) <= 0.3 and (lag(bold) over w >= 0.5) = (bold >= 0.5) and not num, false) as same from d window w as (partition by doc, page order by pos)),
g as (select *, sum((not (c and same))::int) over (partition by doc, page order by pos) as g from e), h as (select *, (row_number() over (partition by doc, page, g order by pos) - 1) // 3 as part from g where c),
t as (select doc, page, min(pos) as pos, max(size) as size, string_agg({strip("text")}, ' ' order by pos) as title from h group by doc, page, g, part),
w as (select *, list_filter(regexp_split_to_array(title, '{SPACE}+'), lambda x: x <> '') as ws from t),
p as (select *, list_reduce(list_prepend(0, list_transform(regexp_extract_all(title, '[()]'), lambda x: case when x = '(' then 1 else -1 end)), lambda a, x: case when a < 0 then a else a + x end) as depth from w),
o as (select * from p where length(title) between 2 and 200 and len(ws) <= 20 and {letters} >= 3 and {letters} >= 0.5 * length(regexp_replace(title, '{SPACE}', '', 'g'))
and not (regexp_matches(title, '(?i)^(?:Abb\.|Abbildung|Bild|Fig\.|Figure|Tab\.|Tabelle|Table|Gl\.|Gleichung|Quelle|Seite)\s') or contains(title, '=') or regexp_matches(title, '[,;]$') or regexp_matches(title, '^\d{{1,4}}\s+\d')
or starts_with(title, '(') or depth <> 0 or list_max(list_transform(ws, lambda x: length(regexp_replace(x, '\P{{L}}', '', 'g')))) < 3 or (len(ws) >= 4 and upper(title) = title) or (regexp_matches(title, '\.$') and len(ws) > 6)
or (regexp_matches(title, '\s\d{{1,4}}$') and not regexp_matches(title, '(?i)(?:Teil|Kapitel|Band|Anhang|Abschnitt|Lektion|Part|Chapter)\s+\d{{1,4}}$')))),
r as (select *, dense_rank() over (partition by doc order by size desc) as rank, count(*) over (partition by doc) as heads from o),
q as (select doc, count(distinct page) as p from styled group by doc)
select doc, page, pos, least(6, case when {numbered("title")} then len(regexp_extract_all(regexp_extract(title, '{NUMBER}', 2), '\.')) + 1 else rank end)::int as level, title from r join q using (doc) where heads <= 4 * p"""


def oracles() -> dict[str, str]:
    useless = USELESS_TITLE.replace("(?iU)", "(?i)").replace(r"\b", r"(?:[^\p{L}\p{N}_]|$)")
    nobody = ", ".join(f"'{x}'" for x in USELESS_AUTHORS)
    return {
        "number_sections": SECTIONS + "select * from sec",
        "printed_numbers": NUMBERS + "select * from printed",
        "running_titles_removed": NUMBERS + rf""", j as (select l.doc, l.page, l.pos, p.number::varchar as p, {strip("line")} as z, row_number() over (partition by l.doc, l.page order by pos) as a,
row_number() over (partition by l.doc, l.page order by pos desc) as b from lines l join printed p on p.doc = l.doc and p.page = l.page where line is not null),
h as (select *, coalesce((starts_with(z, p || ' ') or ends_with(z, ' ' || p)) and (a <= 2 or b <= 2), false) as hit from j),
k as (select doc from (select doc, page, bool_or(hit) as hit from h where p is not null group by all) group by doc having count(*) filter (hit) >= greatest(3, ceil(count(*) * 0.3)))
select doc, count(*) as n_lines from h where not (hit and doc in (select doc from k)) group by doc""",
        "edge_lines_removed": edge_lines(),
        "page_paragraphs": rf"""with {LINES}, l as (select * from lines where line is not null),
q as (select doc, page, list_sort(list(length(line)) filter (length(line) >= 25)) as x from l group by all), w as (select doc, page, case when len(x) >= 8 then 0.88::double * x[floor(len(x) * 0.9)::int + 1] end as w from q),
p as (select l.*, w, lag(line) over (partition by l.doc, l.page order by pos) as prev from l join w on w.doc = l.doc and w.page = l.page),
g as (select *, coalesce(w is not null and line <> '' and prev <> '' and length(prev) >= w and not (right(prev, 1) in ('.', '!', '?', ':', ';') and not regexp_matches(prev, '{SHORT_END}'))
and not (contains(line, ' … ') or contains(prev, ' … ')) and not (starts_with(line, '|') or starts_with(prev, '|')) and not regexp_matches(line, '{LIST}'), false) as goes from p),
n as (select *, sum((not goes)::int) over (partition by doc, page order by pos) as absatz from g)
select doc, page, absatz::bigint as absatz, string_agg(line, ' ' order by pos) as text from n where line <> '' group by all""",
        "outline_shifted": rf"""with {LINES}, {TOC}, have as (select distinct doc, page, {key("line")} as k from lines where line is not null and {key("line")} <> '')
select t.doc, (t.page + (a.k is null and b.k is not null)::int)::int as page, level, title, pos from toc t left join have a on a.doc = t.doc and a.page = t.page and a.k = {key("t.title")}
left join have b on b.doc = t.doc and b.page = t.page + 1 and b.k = {key("t.title")}""",
        "outline_lines": rf"""with {LINES}, {TOC}, k as (select doc, page, pos, {key("line")} as k from lines where line is not null and {key("line")} <> ''),
w as (select doc, page, pos, list(k) over (partition by doc, page order by pos rows between current row and 4 following) as ks from k),
s as (select doc, page, pos, unnest(range(1, 6)) as n, ks from w), f as (select doc, page, array_to_string(ks[1:n], '') as k, min(struct_pack(r := n, p := pos)) as m from s group by all)
select t.doc, t.page, title, level, m.p as pos, m.r::int as rows from toc t left join f on f.doc = t.doc and f.page = t.page and f.k = {key("t.title")}""",
        "weak_spots": rf"""with d as (select coalesce(source, '') as doc, coalesce(text, '') as t, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {strip("x")}), lambda x: x <> '') as l from documents)
select doc, sum(length(t) - length(replace(t, '�', '')))::bigint as lost, sum((length({strip("t")}) < 40)::int)::bigint as empty, sum(len(list_filter(l, lambda x: regexp_full_match(x, '[\d\s.,;:%()+-]+') and regexp_matches(x, '\d'))))::bigint as numeric,
sum(len(list_filter(l, lambda x: regexp_matches(x, '(?:^|[^\p{{L}}\p{{M}}\p{{Nd}}_])(?:[\p{{L}}\p{{M}}\p{{Nd}}_] ){{6,}}'))))::bigint as spaced, sum(len(list_filter(l, lambda x: length(x) < 4)))::bigint as short, sum(len(l))::bigint as lines, count(*) as pages from d group by doc""",
        "accepted_heads": rf"""with k as (select kopf_id, {strip("titel")} as t, {strip("autor")} as a from kopfbloecke)
select kopf_id, case when not regexp_matches(t, '(?i)^(?:isbn[\s:]*)?[\d\-\sxX]{{10,}}$|^10\.\d{{4,9}}/\S+$') and length(t) >= 3 and not regexp_matches(t, '{useless}') and regexp_matches(t, '[\p{{L}}\p{{N}}]') then t end as titel,
case when lower(a) not in ({nobody}) then a end as autor from k""",
        "emphasised": rf"""with {STYLED}, i as (select doc, page, pos, runs, unnest(range(len(runs)))::int as n from styled), r as (select doc, page, pos, n, runs[n + 1].text as t, coalesce(runs[n + 1].stil, '') as style from i),
c as (select doc, style, sum(length(t)) as c from r group by all), x as (select doc, style from (select *, sum(c) over (partition by doc) as a from c) where style <> '' and a >= 2000 and c > 0.3 * a),
k as (select r.* replace (regexp_replace(regexp_replace(t, '{SPACE}+', ' ', 'g'), '^ | $', '', 'g') as t) from r left join x on x.doc = r.doc and x.style = r.style where r.style <> '' and x.doc is null)
select doc, page, pos, n, t as text, style from k where 2 * length(regexp_replace(t, '\P{{L}}', '', 'g')) > length(replace(t, ' ', ''))
and (len(list_filter(string_split(t, ' '), lambda w: regexp_matches(w, '\p{{L}}'))) >= 2 or length(regexp_replace(t, '\P{{L}}', '', 'g')) >= 4)""",
        # what is taken is put back, so each replacement runs twice
        "joined_words": rf"""with {LINES}, p as (select doc || '/' || page as doc, replace(string_agg(line, chr(10) || chr(10) order by pos), chr(10) || chr(10), chr(10)) as t from lines where line is not null group by lines.doc, lines.page),
a as (select doc, regexp_replace(t, '\x{{ad}}[ \t]+', chr(173) || chr(10), 'g') as t from p), b as (select doc, regexp_replace(t, '{DIVIDED}((?i:und|oder|bzw|sowie|u|bis|and|or)[.,;:]*(?:\s|$))', '\1- \2', 'g') as t from a),
c as (select doc, regexp_replace(regexp_replace(t, '{DIVIDED}(\p{{Ll}})', '\1\2', 'g'), '{DIVIDED}(\p{{Ll}})', '\1\2', 'g') as t from b)
select doc, regexp_replace(regexp_replace(t, '{DIVIDED}(\S)', '\1-\2', 'g'), '{DIVIDED}(\S)', '\1-\2', 'g') as text from c""",
        "size_headings": size_headings(),
        "newest_documents": "select doc_id from documents order by eingang desc, lower(coalesce(source, '') || '/' || doc_id)",
        "titles_found": "select kopf_id, titel from kopfbloecke where contains(strip_accents(lower(coalesce(titel, ''))), 'prufung')",
        "outcome_shares": "select lauf, status, count(*) as n, floor(100.0 * count(*) / sum(count(*)) over (partition by lauf) + 0.5)::int as prozent from protokoll group by lauf, status",
        "log_folders": r"""select coalesce(nullif(regexp_extract(nach_pfad, '^(.*)/[^/]*$', 1), ''), '.') as ordner, sum(length(hinweis) + 1)::bigint as groesse, count(*) as dateien from protokoll where nach_pfad <> '' group by 1""",
        "repeated_titles": """select titel, textquelle, array_to_string(list_sort(list(distinct ort)), '|') as orte, count(distinct ort) as anzahl from (
select lower(titel) as titel, trim(coalesce(textquelle, '')) as textquelle, coalesce(originaldatei, '') as ort from kopfbloecke) group by titel, textquelle""",
        "trimmed_documents": rf"""select doc_id, md5(regexp_replace(array_to_string(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '{SPACE}+$', '')), chr(10)), '^{SPACE}+|{SPACE}+$', '', 'g')) as md5 from documents""",
        "part_versions": """select p_partkey, case when p_partkey % 7 <> 0 then p_size end as major, case when p_partkey % 7 <> 0 then p_partkey % 10 end::int as minor, case when p_partkey % 7 <> 0 then case when p_partkey % 3 = 0 then 4 else 0 end end as patch from part""",
        "axis_steps": """with m as (select c_nationkey, max(c_acctbal) as m from customer group by 1), b as (select *, m / 4 as raw, pow(10.0, floor(log10(m / 4))) as base from m),
s as (select *, list_filter([1.0 * base, 2.0 * base, 2.5 * base, 5.0 * base, 10.0 * base], lambda x: x >= raw)[1] as schritt from b) select c_nationkey, schritt, (ceil(m / schritt - 0.001) + 1)::int as marken from s""",
        "links_resolved": """with recursive l as (select p_partkey as path, p_partkey // 2 as t from part where p_partkey % 1000 <> 0 and p_partkey > 1), w as (select path, path as here, 0 as n from l
union all select w.path, l.t, n + 1 from w join l on l.path = w.here where n < 20) select path, arg_max(here, n) as target from w group by path""",
        "printed_labels": NUMBERS + """, lab as (select doc, page, number, case when doc % 3 = 0 then coalesce(number, page)::varchar when doc % 3 = 1 then (page + 2)::varchar else 'A-' || page end as label from printed),
use_ as (select doc, count(*) filter (label <> (page + 1)::varchar) >= greatest(1, count(*) // 10) and (count(*) filter (try_cast(label as int) is not null and number is not null) = 0
or count(*) filter (try_cast(label as int) = number) >= 0.8 * count(*) filter (try_cast(label as int) is not null and number is not null)) as use, count(number) as m from lab group by doc)
select doc, page, case when use then label else number::varchar end as printed, case when use then 'Seitenlabel der PDF' when m > 0 then 'Seitenzahlen am Seitenrand' else '' end as quelle from lab join use_ using (doc)""",
        "standards_recognised": rf"""with {LINES}, f as (select distinct doc, page from lines where line is not null), m as (select doc, count(*) as k, min(page) as first from f where doc % 3 = 0 and page % (1 + doc % 7) = 1 group by doc),
n as (select l.doc, count(distinct page) as n from lines l where line is not null and ({strip("line")} <> '' or (doc % 3 = 0 and page % (1 + doc % 7) = 1)) group by l.doc),
h as (select m.doc from m join n using (doc) where k >= greatest(2, 0.25 * n) or (k >= 2 and first < 4))
select doc, case when h.doc is not null then 'DIN EN ISO ' || (d.doc + 100) else 'DIN EN ' || d.doc end as nummer, case when h.doc is not null then '20' || lpad((d.doc % 30)::varchar, 2, '0') else '2019' end as jahr,
case when h.doc is not null then '0' || (d.doc % 9 + 1) else '10' end as monat, case when h.doc is not null then 'Kopfzeile der Norm' else 'Dateiname (Normen-Download)' end as quelle
from (select distinct doc from f) d left join h using (doc) where h.doc is not null or d.doc % 5 = 0""",
        "heads_read": """select kopf_id, case when kopf_id % 5 <> 0 then trim(titel || ' 2') end as titel, case when kopf_id % 5 <> 0 then seiten::varchar end as seiten,
case when kopf_id % 5 <> 0 then 4 else length('---' || chr(10) || 'titel: ' || titel || chr(10) || 'seiten: ' || coalesce(seiten::varchar, 'null') || chr(10) || 'titel: ' || titel || ' 2' || chr(10) || 'Text') end as rest from kopfbloecke where titel is not null""",
    }
