"""SQL of the queries of this subpackage that SQL can express."""

UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
FOLDED = f"translate(text, {UPPER}, {LOWER})"

OP11 = """
with v as (
    select row_number() over () as row_no, vec_id,
        [floor(256 * x::double) for x in embedding] as c
    from embeddings
    where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
),
scored as (
    select q.row_no, q.vec_id as query_id, d.vec_id,
        case when len(q.c) = 0 then 0 else list_dot_product(q.c, d.c)::bigint end as score
    from v q join v d on len(q.c) = len(d.c) and q.row_no <> d.row_no
    where q.vec_id % 50 = 0
)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by row_no order by score desc, vec_id nulls last) as rank from scored)
where rank <= 5
"""

OP12 = rf"""
with found as (
    select row_number() over () as doc_no, doc_id,
        regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words
    from documents where text is not null
),
docs as (select doc_no, doc_id, len(words) as n, words from found where len(words) > 0),
total as (select count(*) as docs, sum(n)::bigint as terms from docs),
tf as (select doc_no, doc_id, n, term, count(*) as tf from (select doc_no, doc_id, n, unnest(words) as term from docs) group by all),
w as (
    select term, floor(1000 * ln((2.0::double * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w
    from tf, total group by term
),
item as (
    select row_number() over () as item_no, item_id,
        list_distinct(regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as words
    from benchmark where text is not null
),
asked as (select item_no, item_id, unnest(words) as term from item),
scored as (
    select item_no, item_id, doc_no, doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::bigint as score
    from asked join w using (term) join tf using (term), total
    group by all
)
select item_id, rank::int as rank, doc_id, score
from (select *, row_number() over (partition by item_no order by score desc, doc_id nulls last) as rank from scored where score > 0)
where rank <= 10
"""

OP13 = rf"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({FOLDED}, '[.,;:!?\x0A-\x0D]')) as piece from documents
),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from words group by lang),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from words where len(w) > 0),
grams as (select lang, w[i : i + k - 1] as p from starts, (select unnest([1, 2, 3, 4]) as k) where i + k - 1 <= len(w)),
counted as (select lang, p, count(*) as f from grams group by all having count(*) >= 30),
candidates as (select lang, p, f as a from counted where len(p) > 1),
inside as (
    select lang, p[i : j] as p, max(a) as around
    from candidates, (select unnest([1, 2, 3]) as i), (select unnest([2, 3, 4]) as j)
    where i < j and j <= len(p) and j - i + 1 < len(p) group by all
),
alone as (
    select lang, p, a from candidates left join inside using (lang, p) where around is null or 100 * around < 80 * a
),
cuts as (
    select c.lang, c.p, c.a, k, l.f as l, r.f as r, ((2000000::hugeint * c.a) // (l.f + r.f))::bigint as score
    from alone c, (select unnest([1, 2, 3]) as k), counted l, counted r
    where k < len(c.p) and l.lang = c.lang and l.p = c.p[1 : k] and r.lang = c.lang and r.p = c.p[k + 1 : len(c.p)]
),
scored as (
    select lang, array_to_string(p, ' ') as phrase, a, unnest(min({{'score': score, 'k': k, 'l': l, 'r': r}})) from cuts group by lang, p, a
)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from scored) join totals using (lang)
where rank <= 2000
"""

WORD = r"[^\x20\x09-\x0D]+"
QUALITY = rf"""
with d as (select row_number() over () as doc_no, doc_id, coalesce(text, '') as text from documents),
w as (select doc_no, doc_id, text, regexp_extract_all(text, '{WORD}') as words,
    [x for x in string_split(text, chr(10)) if regexp_matches(x, '{WORD}')] as lines from d),
spots as (select doc_no, unnest(range(1, len(words) - 6)) as i, words from w where len(words) >= 8),
often as (select doc_no, i, count(*) over (partition by doc_no, words[i : i + 7]) as n from spots),
covered as (select doc_no, count(distinct place) as n from (select doc_no, unnest(range(i, i + 8)) as place from often where n > 1) group by doc_no)
select doc_id, len(words) as n_words, coalesce(list_sum([length(x) for x in words]), 0)::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(n, 0) as n_repeat_words, len(words) < 20 or 100 * coalesce(n, 0) > 30 * len(words) as base_failed
from w left join covered using (doc_no)
"""

SECRETS = r"""
select doc_id,
    len([x for x in regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) if length(x) >= 6]) as n_assign,
    len([x for x in regexp_extract_all(t, 'AKIA[A-Z0-9]+') if length(x) >= 20]) as n_access,
    len([x for x in regexp_extract_all(t, '[0-9a-f]+') if length(x) >= 24]) as n_hex
from (select doc_id, coalesce(text, '') as t from documents)
"""

URLS = rf"""
with parts as (
    select page_id, case when position('://' in url) > 0 then substring(url, position('://' in url) + 3) else '' end as rest from pages
),
split as (
    select page_id, translate(regexp_extract(rest, '^[^/?#]*'), {UPPER}, {LOWER}) as host,
        regexp_extract(substring(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
    from parts
),
rules as (select * from (values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
    ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) r(rule, rule_host, rule_path, verdict))
select page_id, any_value(host) as host, any_value(path) as path, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as fixed
from split left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
group by page_id
"""

ORACLES: dict[str, str] = {"quality_base": QUALITY, "secret_counts": SECRETS, "url_fixed_rules": URLS, "op11_exact_topk": OP11, "op12_lexical_search": OP12, "op13_collocations": OP13}
