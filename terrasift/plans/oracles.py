"""The same queries in SQL, for a second engine to run on the same tables."""

from __future__ import annotations

from html.entities import name2codepoint

from terrasift.functions.text import QUERY_STOP_WORDS, STOP_WORDS

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
WORDS = r"list_filter(string_split_regex(lower(regexp_replace({0}, '[^A-Za-z0-9\s]', ' ', 'g')), '\s+'), lambda z: z <> '')"
KEPT = f"list_filter({WORDS}, lambda z: z not in ({STOP}))"

INDEX = f"""w as (select * from (select doc_id, text, {WORDS.format('text')} as ws from documents) where len(ws) > 1),
docs as (select doc_id, substr(text, 1, 60) as title, len(ws) as num_words from w),
ks as (select doc_id, list_filter(ws, lambda z: z not in ({STOP})) as ks from w),
tok as (select doc_id, unnest(ks) as term, unnest(range(len(ks))) as pos from ks),
tf as (select term, doc_id, count(*) as tf from tok group by all),
terms as (select term, count(*) as df, sum(tf)::bigint as ctf from tf group by 1),
nd as (select count(*)::double as n from docs)"""

GEO = """vocab as (select term, row_number() over (order by df desc, term) - 1 as r from terms where length(term) >= 4),
ns as (select count(*) as n from supplier),
st as (select 1000 + n_nationkey as id, term as name, n_nationkey as k from nation join vocab on r = n_nationkey),
co as (select 10000 + s_suppkey as id, term as name, s_suppkey as k, s_nationkey as nk from supplier join vocab on r = 25 + s_suppkey % 100),
ci as (select 100000 + c_custkey as id, term as name, c_custkey as k, c_custkey % ns.n as sk, cast(floor(abs(c_acctbal) * 100) as int) as population from customer, ns, vocab where r = 125 + c_custkey % 400),
geo as (select 6252001::bigint as id, 'united states of america' as name, 'NATION' as type, null::int as population, null::bigint as county_id, null::bigint as state_id, '' as state_name, '' as county_name, null::bigint as x, null::bigint as y
 union all select id, name, 'STATE', null, null, id, name, '', null, null from st
 union all select co.id, co.name, 'COUNTY', null, co.id, st.id, st.name, co.name, null, null from co join st on st.k = co.nk
 union all select ci.id, ci.name, 'CITY', ci.population, co.id, st.id, st.name, co.name, (ci.k * 7919 * 13) % 1000000, (ci.k * 104729 * 7) % 1000000 from ci join co on co.k = ci.sk join st on st.k = co.nk),
names as (select case when population is null or population >= 200000 then name else name || ' ' || state_name end as key, id from geo),
par as (select id, case type when 'CITY' then coalesce(county_id, state_id, 6252001) when 'COUNTY' then coalesce(state_id, 6252001) else 6252001 end as parent_id from geo where type <> 'NATION')"""

TAGS = """g3 as (select doc_id, pos, term as t1, term || ' ' || lead(term) over w as t2, term || ' ' || lead(term) over w || ' ' || lead(term, 2) over w as t3 from tok window w as (partition by doc_id order by pos)),
u3 as (select doc_id, t1 as k from g3 union all select doc_id, t2 from g3 union all select doc_id, t3 from g3),
raw as (select doc_id, n.id as geo_id, count(*) as cnt from u3 join names n on n.key = u3.k group by 1, 2),
many as (select raw.*, type, state_id from raw join geo on geo.id = geo_id where cnt >= 3),
tags as (select doc_id, geo_id, cnt from many m where type in ('STATE', 'NATION') or exists (select 1 from many s where s.type = 'STATE' and s.doc_id = m.doc_id and s.geo_id = m.state_id)),
totals as (select geo_id, sum(cnt)::bigint as total from tags group by 1)"""

BQ = f"""bk as (select item_id, {KEPT.format('text')} as b from benchmark),
bq as (select item_id as sub_id, unnest(b[1:2]) as token, unnest(range(2)) as ord from bk where len(b) >= 2)"""

SCORERS = {
    "bm25": "(2.2 * tf / (1.2 * (0.5 + 0.5 * num_words / 200.0) + tf)) * pow(ln(n / df + 1.0) + 1.0, 2) * boost",
    "tfidf": "tf / (df + 1.0)",
    "cosine": "df * df / (num_words + nt)",
    "lucene_tfidf": "sqrt(tf) * pow(ln(n / df + 1.0) + 1.0, 2) * boost * case when contains(lower(title), token) then 10.0 else 1.0 end",
}


def scored(subs: str, scorer: str = "bm25", boosts: str | None = None, name: str = "scored") -> str:
    """CTEs that score all conjunctive matches of a table (sub_id, ord, token) of single words."""
    factor = "/ sqrt(max(num_words))" if scorer == "lucene_tfidf" else ""
    boost = f"coalesce((select max(boost) from {boosts} bb where bb.token = h.token), 1.0)" if boosts else "1.0"
    return f"""{name}_h as (select s.sub_id, s.ord, s.token, tf.doc_id, tf.tf::double as tf from {subs} s join tf on tf.term = s.token),
{name}_q as (select sub_id, count(*) as nt from {subs} group by 1),
{name}_c as (select a.sub_id, doc_id, nt from (select sub_id, doc_id, count(*) as k from {name}_h group by 1, 2) a join {name}_q b on a.sub_id = b.sub_id and k = nt),
{name} as (select h.sub_id, h.doc_id, {{0}} {factor} as score from (select h.*, {boost} as boost, (t.df + 1)::double as df, d.num_words::double as num_words, d.title, nd.n, {name}_c.nt from {name}_h h join {name}_c using (sub_id, doc_id) join terms t on t.term = h.token join docs d on d.doc_id = h.doc_id, nd) h group by 1, 2)""".replace("{0}", f"sum({SCORERS[scorer]})")


def top(name: str, k: int, out: str = "ranked") -> str:
    return f"""{out} as (select sub_id, row_number() over (partition by sub_id order by round(score, 6) desc, doc_id) as rank, doc_id,
 round(score / sqrt(sum(score * score) over (partition by sub_id)), 6) as score from {name} qualify rank <= {k})"""


def q(*ctes: str, select: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + select


TWO = "two as (select 0 as sub_id, unnest(['tion', 'er']) as token, unnest([0, 1]) as ord)"
STATES = """sq as (select state_id as sub_id, 0 as ord, any_value(state_name) as token from geo where type = 'COUNTY' group by 1
 union all select state_id, 1, arg_min(name, id) from geo where type = 'COUNTY' group by 1),
bst as (select name as token, max(case type when 'CITY' then 1.7 when 'COUNTY' then 1.5 when 'STATE' then 1.2 else 1.0 end) as boost from geo group by 1)"""
RES = "res as (select 'q' || (doc_id % 7) as query, doc_id, row_number() over (partition by doc_id % 7 order by (n_chars * 31 + doc_id) % 1009, doc_id) as rank from documents)"
JUD = """jud as (select 'q' || (doc_id % 7) as query, doc_id, (quality = 1 and toxic = 0)::int as rel,
 case when quality = 1 and toxic = 0 and doc_id % 5 = 0 then 10 when quality = 1 and toxic = 0 then 7 when quality = 1 then 1 else 0 end as gain from labels),
jd as (select r.query, r.doc_id, r.rank, coalesce(rel, 0) as rel, coalesce(gain, 0) as gain, coalesce(n_relevant, 0) as n_relevant,
 sum(coalesce(rel, 0)) over (partition by r.query order by r.rank) as hits from res r left join jud j on j.query = r.query and j.doc_id = r.doc_id
 left join (select query, sum(rel) as n_relevant from jud group by 1) t on t.query = r.query),
pr as (select *, hits / rank as precision, case when n_relevant > 0 then hits / n_relevant else 0.0 end as recall from jd)"""
AT = lambda c, k: f"max(case when rank = {k} then {c} end)"
_F = lambda k: f"round(case when {AT('precision', k)} is null then null when {AT('precision', k)} = 0 or {AT('recall', k)} = 0 then 0.0 else 1 / (0.5 / {AT('precision', k)} + 0.5 / {AT('recall', k)}) end, 6) as f_{k}"
_N = lambda k: f"round(case when max(rank) >= {k} then sum(case when rank <= {k} then gain / log2(rank + 1) end) / sum(case when rank <= {k} then 10 / log2(rank + 1) end) end, 6) as ndcg_{k}"
PAGES = r"""pe as (select distinct page_id::varchar as src, lower(d) as dst from (select page_id, unnest(regexp_extract_all(html, 'href="/?([^ /#"]*)"', 1)) as d from pages) where d <> '' and d not like '.%' and page_id::varchar <> d)"""
BODY = r"regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g')"


def unescaped(x: str) -> str:
    """Named references of HTML 4 and the apostrophe's number; & itself last."""
    names = {n: chr(c) for n, c in name2codepoint.items() if n != "amp"} | {"nbsp": " ", "#39": "''", "amp": "&"}
    for a, b in names.items():
        x = f"replace({x}, '&{a};', '{b}')"
    return x


TITLE = r"trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"
DENSE = "de as (select distinct src, dst from (select lag(user_id) over (order by ts, event_id) as src, user_id as dst from events) where src is not null and src <> dst)"


def parity(edges: str) -> str:
    return f"""deg as (select src, count(*) as k from {edges} group by 1), sw as (select dst as v, sum(1.0::double / k) as s from {edges} join deg using (src) group by 1),
vs as (select src as v from {edges} union select dst from {edges}),
prk as (select v, ((1 - 0.9::double) + 0.9::double * coalesce(s, 0)) * (1 + 0.9::double * coalesce(s, 0)) / (select count(*) from vs) as rank from vs left join sw using (v))"""


def spearman(z: str) -> str:
    return q(DENSE, parity("de"), "vw as (select user_id as v, count(*) as n from events where event_type = 'view' group by 1)",
             "xy as (select v as doc, round(rank, 9) as x, coalesce(n, 0) as y from prk left join vw using (v))",
             "rk as (select row_number() over (order by x desc, doc) as rx, row_number() over (order by y desc, doc) as ry, count(*) over () as n from xy)",
             select=f"select max(n)::bigint as n, round(sum((rx - {z}) * (ry - {z})) / sqrt(sum(pow(rx - {z}, 2)) * sum(pow(ry - {z}, 2))), 6) as rho from rk")


def standard(passes: int) -> str:
    ctes = [PAGES, "deg as (select src, count(*) as k from pe group by 1)", "vs as (select src as v from pe union select dst from pe)", "cnt as (select count(*)::double as n from vs)",
            "r0 as (select v, 1 / n as rank from vs, cnt)"]
    for i in range(1, passes + 1):
        ctes.append(f"r{i} as (select vs.v, 0.15::double / n + 0.85::double * coalesce((select sum(rank) from r{i - 1} where v not in (select src from pe)), 0) / n + 0.85::double * coalesce(g.got, 0) as rank "
                    f"from vs cross join cnt left join (select dst as v, sum(rank / k) as got from pe join deg using (src) join r{i - 1} on r{i - 1}.v = src group by 1) g on g.v = vs.v)")
    return q(*ctes, select=f"select v, round(rank, 9) as rank from r{passes}")


EXPAND = lambda kind, cand, child, over: f"""select cand.id as query, '{kind}' as kind, row_number() over (partition by cand.id order by {over} desc, {child}.id) as rank, {child}.id as id"""
NEAR = """near as (select a.id, b.id as near_id, row_number() over (partition by a.id order by b.population desc nulls last, b.id) as rank from geo a join geo b on a.type = 'CITY' and b.type = 'CITY' and a.id <> b.id
 and pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 50000.0 * 50000.0)"""
CAND = """cand as (select 'c' || (id % 40) as query, row_number() over (partition by id % 40 order by id) - 1 as ord, id from geo where type <> 'NATION')"""
UNIQ = """u0 as (select query, ord, cand.id, name, type, state_name, county_name from cand join geo using (id)),
u1 as (select *, count(*) over (partition by query, name) as k1 from u0),
u2 as (select *, case when k1 > 1 and type <> 'STATE' and state_name <> '' then name || ',' || state_name else name end as ua from u1),
u3b as (select *, count(*) over (partition by query, ua) as k2 from u2),
u4 as (select *, case when k2 > 1 and type <> 'STATE' and county_name <> '' then name || ',' || county_name || ',' || state_name else ua end as ub from u3b),
u5 as (select *, row_number() over (partition by query, ub order by ord, id) as k3 from u4)"""
SEG = f"""sk as (select item_id as sub_id, b[1] as a, b[2] as b, b[3] as cw from (select item_id, {KEPT.format('text')} as b from benchmark) where len(b) >= 3),
tt as (select sum(num_words)::double as t from docs),
n2 as (select term || ' ' || t2 as g, count(*) as c from (select term, lead(term) over (partition by doc_id order by pos) as t2 from tok) where t2 is not null group by 1),
n3 as (select term || ' ' || t2 || ' ' || t3 as g, count(*) as c from (select term, lead(term) over w as t2, lead(term, 2) over w as t3 from tok window w as (partition by doc_id order by pos)) where t3 is not null group by 1),
cts as (select sk.*, t, coalesce(ta.ctf, 0) as ca, coalesce(tb.ctf, 0) as cb, coalesce(tc.ctf, 0) as cc, coalesce(ab.c, 0) as cab, coalesce(bc.c, 0) as cbc, coalesce(abc.c, 0) as cabc from sk cross join tt
 left join terms ta on ta.term = a left join terms tb on tb.term = b left join terms tc on tc.term = cw left join n2 ab on ab.g = a || ' ' || b left join n2 bc on bc.g = b || ' ' || cw left join n3 abc on abc.g = a || ' ' || b || ' ' || cw),
sg as (select sub_id, unnest([a || '|' || b || '|' || cw, a || ' ' || b || '|' || cw, a || '|' || b || ' ' || cw, a || ' ' || b || ' ' || cw]) as segments,
 unnest([ln(ca / t + 1 + 1 / t) + ln(cb / t + 1 + 1 / t) + ln(cc / t + 1 + 1 / t),
  ln(cab / case when ca <= 50 then t else ca end + 1 + 1 / t) + ln(cc / t + 1 + 1 / t),
  ln(ca / t + 1 + 1 / t) + ln(cbc / case when cb <= 50 then t else cb end + 1 + 1 / t),
  ln(cabc / case when cab <= 50 then t else cab end + 1 + 1 / t)]) as score from cts)"""
EXPQ = """eb as (select id, name from geo where type = 'STATE'),
em as (select eb.id as query, g.id, g.name, g.type, g.population, g.state_name, row_number() over (partition by eb.id, g.type order by case when g.type = 'CITY' then g.population else cp.pop end desc nulls last, g.id) as rank
 from eb join geo g on g.state_id = eb.id and g.type in ('CITY', 'COUNTY') left join (select county_id, sum(population) as pop from geo where type = 'CITY' group by 1) cp on cp.county_id = g.id and g.type = 'COUNTY' qualify rank <= 10),
esub as (select query::varchar || '/' || id as sub_id, 0 as ord, 'er' as token from em union all select query::varchar || '/' || id, 1, name from em
 union all select query::varchar || '/' || id, 2, state_name from em where type = 'CITY' and population <= 200000
 union all select id::varchar, 0, 'er' from eb union all select id::varchar, 1, name from eb)"""
STRENGTH = lambda s, o="sm": f"{o} as (select sub_id, count(*) as n_hits, sum(score) as total, sum(score) / sqrt(sum(score * score) + 1) as strength from {s} group by 1)"
DIS = """amb as (select key, count(*) as c from names group by 1 having count(*) > 1),
dq as (select amb.key as query, geo.id, geo.name, state_name, county_name, type from amb join names on names.key = amb.key join geo on geo.id = names.id),
dsub as (select query || '/' || id as sub_id, 0 as ord, 'er' as token from dq union all select query || '/' || id, 1, split_part(query, ' ', 1) from dq union all select query || '/' || id, 2, state_name from dq
 union all select distinct query, 0, 'er' from dq union all select distinct query, 1, split_part(query, ' ', 1) from dq)"""
POSTING_BYTES = "pb as (select term, sum(vb(doc_id) + vb(tf) + ps)::bigint as bytes from (select term, doc_id, count(*) as tf, sum(vb(pos)) as ps from tok group by all) group by 1)".replace(
    "vb(doc_id)", "{d}").replace("vb(tf)", "{t}").replace("vb(pos)", "{p}")
VB = lambda x: f"(case when {x} < 128 then 1 when {x} < 16384 then 2 when {x} < 2097152 then 3 when {x} < 268435456 then 4 when {x} < 34359738368 then 5 when {x} < 4398046511104 then 6 when {x} < 562949953421312 then 7 when {x} < 72057594037927936 then 8 else 9 end)"
POSTING_BYTES = POSTING_BYTES.format(d=VB("doc_id"), t=VB("tf"), p=VB("pos"))
URL = r"regexp_replace(url, '#.*$', '')"
PHR = "ph as (select item_id as sub_id, b[1] as a, b[2] as b from bk where len(b) >= 2)"
PHIT = "phit as (select ph.sub_id, a || ' ' || b as token, t1.doc_id, count(*) as tf from ph join tok t1 on t1.term = a join tok t2 on t2.doc_id = t1.doc_id and t2.pos = t1.pos + 1 and t2.term = b group by all)"

SQL = {
    "corpus_stats": q(INDEX, select="select count(*) as n_docs, sum(num_words)::bigint as total_words, round(avg(num_words), 6) as avg_words, (select count(*) from terms) as vocabulary from docs"),
    "doc_lengths": q(INDEX, select="select doc_id, num_words::bigint as num_words from docs"),
    "term_df_ctf": q(INDEX, select="select term, df, ctf, df + 1 as df_offset from terms"),
    "vocab_top": q(INDEX, select="select term, df from terms order by df desc, term limit 50"),
    "positional_postings": q(INDEX, select="select term, doc_id, count(*) as tf, min(pos)::int as first_pos, max(pos)::int as last_pos, sum(pos)::bigint as pos_sum from tok group by 1, 2"),
    "vbyte_sizes": q(INDEX, POSTING_BYTES, select="select term, bytes from pb"),
    "dictionary_by_size": q(INDEX, POSTING_BYTES, select="select term, bytes from pb order by bytes desc, term limit 100"),
    "shard_assignment": q(INDEX, POSTING_BYTES, select="select (('0x' || substr(md5(term), 1, 8))::bigint % 1000)::int as shard, count(*) as n_terms, sum(bytes)::bigint as bytes from pb group by 1"),
    "vbyte_roundtrip": f"""with a as (select o_orderkey, o_orderkey * 7919 as n from orders), b as (select *, {VB('n')} as k from a)
select o_orderkey, n, array_to_string(list_transform(range(k - 1, -1, -1), lambda i: (n // (128 ** i)::bigint) % 128 + case when i = 0 then 128 else 0 end), ' ') as codes, n as decoded from b""",
    "stopword_share": f"with a as (select doc_id, {WORDS.format('text')} as ws from documents) select doc_id, len(ws)::int as n_words, len(list_filter(ws, lambda z: z in ({STOP})))::int as n_stop from a",
    "mining_words": r"with a as (select doc_id, list_filter(string_split_regex(lower(regexp_replace(text, '[^A-Za-z0-9\s]', '', 'g')), '\s+'), lambda z: z <> '') as ws from documents) select doc_id, len(ws)::int as n_words, len(list_distinct(ws))::int as n_distinct from a where len(ws) > 1",
    "anchored_ngrams": q(INDEX, "g as (select doc_id, pos, count(*) over (partition by doc_id) as n, term as t1, term || ' ' || lead(term) over w as t2, term || ' ' || lead(term) over w || ' ' || lead(term, 2) over w as t3 from tok window w as (partition by doc_id order by pos))",
                         *[f"m{k} as (select doc_id, t{k} as key, case when pos = 0 then greatest(0, least(3, n) - {k} + 1) when pos <= n - 3 then 1 else 0 end as x from g where t{k} is not null)" for k in (1, 2, 3)],
                         select="select doc_id, key, sum(x)::bigint as cnt from (select * from m1 union all select * from m2 union all select * from m3) group by 1, 2 having sum(x) > 0"),
    **{f"{s}_top10": q(INDEX, TWO, scored("two", s), top("scored", 10), select="select rank::int as rank, doc_id, score from ranked") for s in SCORERS},
    "bm25_boosted": q(INDEX, GEO, STATES, scored("sq", "bm25", "bst"), top("scored", 5), select="select sub_id, rank::int as rank, doc_id, score from ranked"),
    "query_strength": q(INDEX, BQ, scored("bq"), STRENGTH("scored"), select="select sub_id, n_hits, round(total, 6) as total, round(strength, 6) as strength from sm"),
    "batch_bm25_top3": q(INDEX, BQ, scored("bq"), top("scored", 3), select="select sub_id, rank::int as rank, doc_id, score from ranked"),
    "conjunctive_match": q(INDEX, BQ, "h as (select sub_id, ord, doc_id from bq join tf on term = token)", select="select sub_id, doc_id from h group by all having count(*) = 2"),
    "phrase_match": q(INDEX, BQ, PHR, PHIT, select="select sub_id, token, doc_id, tf from phit"),
    "phrase_df_ctf": q(INDEX, BQ, PHR, PHIT, select="select sub_id, token, count(*) as df, sum(tf)::bigint as ctf from phit group by all"),
    "page_rank_top10": q(INDEX, TWO, DENSE, parity("de"), "m as (select doc_id from two join tf on term = token group by 1 having count(*) = 2)",
                         select="select row_number() over (order by round(coalesce(rank, 0), 6) desc, m.doc_id)::int as rank, m.doc_id, round(coalesce(rank, 0), 6) as score from m left join prk on prk.v = m.doc_id qualify row_number() over (order by round(coalesce(rank, 0), 6) desc, m.doc_id) <= 10"),
    "prf_terms": q(INDEX, BQ, scored("bq"), top("scored", 10), "s as (select b.sub_id, b.token, sum(tf) as n from bq b join ranked r on r.sub_id = b.sub_id join tf on tf.term = b.token and tf.doc_id = r.doc_id group by all)",
                   select="select sub_id, token, round(n / sum(n) over (partition by sub_id), 6) as prob from s"),
    "prf_document_terms": q(INDEX, BQ, scored("bq"), top("scored", 10), "s as (select r.sub_id, term as token, sum(tf) as n from ranked r join tf on tf.doc_id = r.doc_id group by all)",
                            "p as (select sub_id, token, round(n / sum(n) over (partition by sub_id), 6) as prob from s)", select="select sub_id, token, prob from p qualify row_number() over (partition by sub_id order by prob desc, token) <= 10"),
    "page_titles": f"select page_id, {TITLE} as title from pages",
    "page_text": rf"select page_id, trim(regexp_replace({unescaped(f'''regexp_replace({BODY}, '<[^>]*>', ' ', 'g')''')}, '\s+', ' ', 'g')) as text from pages",
    "page_fields": rf"""with a as (select page_id, html, string_split_regex({BODY}, '(?i)<p(?:\s[^>]*)?>') as ps from pages),
b as (select page_id, {TITLE} || ' ' || array_to_string(regexp_extract_all({BODY}, '(?is)<table[^>]*class="[^"]*\binfobox\b[^>]*>(.*?)</table>', 1), ' ') || ' ' || array_to_string(list_transform(ps[2:], lambda p: regexp_replace(p, '(?is)(</p>|</article>).*$', '')), ' ') as t from a)
select page_id, trim(regexp_replace({unescaped("regexp_replace(t, '<[^>]*>', ' ', 'g')")}, '\s+', ' ', 'g')) as text from b""",
    "page_links": q(PAGES, select="select src, dst from pe"),
    "link_outdegree": q(PAGES, select="select src, count(*) as out_degree from pe group by 1"),
    "redirect_fold": q(PAGES, "al as (select dst as alias, regexp_replace(dst, '[^a-z0-9]', '', 'g') as canonical from (select distinct dst from pe) where regexp_replace(dst, '[^a-z0-9]', '', 'g') <> dst and regexp_replace(dst, '[^a-z0-9]', '', 'g') <> '')",
                       select="select distinct src, coalesce(canonical, dst) as dst from pe left join al on al.alias = dst where src <> coalesce(canonical, dst)"),
    "pagerank_parity": q(PAGES, parity("pe"), select="select v, round(rank, 9) as rank from prk"),
    "pagerank_dense": q(DENSE, parity("de"), select="select v, round(rank, 9) as rank from prk"),
    "pagerank_standard_2": standard(2),
    "spearman_ranks": spearman("(n // 2)"),
    "spearman_standard": spearman("((n + 1) / 2)"),
    "precision_recall_at_k": q(RES, JUD, select="select query, " + ", ".join(f"round({AT(c, k)}, 6) as {c}_{k}" for c in ("precision", "recall") for k in (1, 5, 10)) + " from pr group by 1"),
    "f_measure": q(RES, JUD, select="select query, " + ", ".join(_F(k) for k in (1, 5, 10)) + " from pr group by 1"),
    "interp_pr_11pt": q(RES, JUD, select="select query, i / 10.0::double as level, round(coalesce(max(case when recall >= i / 10.0::double then precision end), 0.0), 6) as precision from pr, range(11) t(i) group by 1, 2"),
    "avg_precision_all_ranks": q(RES, JUD, select="select query, round(avg(precision), 6) as average_precision from pr group by 1"),
    "ndcg": q(RES, JUD, select="select query, " + ", ".join(_N(k) for k in (1, 5, 10)) + " from pr group by 1"),
    "reciprocal_rank": q(RES, JUD, select="select query, round(coalesce(1.0 / min(case when rel = 1 then rank end), 0.0), 6) as reciprocal_rank from pr group by 1"),
    "instructor_mean": q(RES, JUD, select="select query, round(avg(rel), 6) as mean_relevance from pr group by 1"),
    "geo_hierarchy": q(INDEX, GEO, select="select id, parent_id::bigint as parent_id from par"),
    "geo_name_keys": q(INDEX, GEO, select="select key, id from names"),
    "county_population": q(INDEX, GEO, select="select county_id, sum(population)::bigint as population from geo where type = 'CITY' group by 1"),
    "geo_neighbors_50km": q(INDEX, GEO, NEAR, select="select id, near_id, rank::int as rank from near where rank <= 20"),
    "geo_neighbors_cap5": q(INDEX, GEO, NEAR, select="select id, near_id, rank::int as rank from near where rank <= 5"),
    "geo_neighbor_lines": q(INDEX, GEO, NEAR, select="select id || ',' || string_agg(near_id::varchar, ':' order by rank) as line from near where rank <= 20 group by id"),
    "geo_expand_state": q(INDEX, GEO, "cp as (select g.id, g.state_id, coalesce(sum(c.population), 0) as pop from geo g left join geo c on c.type = 'CITY' and c.county_id = g.id where g.type = 'COUNTY' group by all)",
                          select="""select * from (select state_id as query, 'counties' as kind, (row_number() over (partition by state_id order by pop desc, id))::int as rank, id from cp
 union all select state_id, 'cities', (row_number() over (partition by state_id order by population desc, id))::int, id from geo where type = 'CITY') where rank <= 10"""),
    "geo_expand_county": q(INDEX, GEO, select="select county_id as query, 'cities' as kind, (row_number() over (partition by county_id order by population desc, id))::int as rank, id from geo where type = 'CITY' qualify rank <= 10"),
    "geo_expand_city": q(INDEX, GEO, NEAR, select="select id as query, 'near' as kind, rank::int as rank, near_id as id from near where rank <= 10 union all select id, 'county', 1, county_id from geo where type = 'CITY'"),
    "geo_resolve": q(INDEX, GEO, CAND, "cj as (select cand.*, county_id, state_id from cand join geo using (id))",
                     "ins as (select a.query, min(a.ord) as first from cj a join cj b on a.query = b.query and a.id <> b.id and (a.county_id = b.id or a.state_id = b.id) group by 1)",
                     select="select query, ord::int as ord, id from cand left join ins using (query) where first is null or ord = first"),
    "geo_uniqify": q(INDEX, GEO, CAND, UNIQ, select="select query, id, case when k3 = 1 then ub else ub || '#' || id end as unique_name from u5"),
    "doc_place_tags": q(INDEX, GEO, TAGS, select="select doc_id, geo_id, cnt from tags"),
    "place_totals": q(INDEX, GEO, TAGS, select="select geo_id, total from totals"),
    "place_suggestions": q(INDEX, GEO, TAGS, BQ, "m as (select sub_id, doc_id from bq join tf on term = token group by all having count(*) = 2)",
                           "sgs as (select sub_id, geo_id, round(sum(cnt) * (0.05 + 1.0 / any_value(total)), 6) as weight from m join tags using (doc_id) join totals using (geo_id) group by 1, 2)",
                           select="select sub_id, (row_number() over (partition by sub_id order by weight desc, geo_id))::int as rank, geo_id, weight from sgs where weight > 0.2 qualify rank <= 10"),
    "segment_scores": q(INDEX, SEG, select="select sub_id, segments, round(score, 6) as score from sg qualify row_number() over (partition by sub_id order by score desc, segments) = 1"),
    "best_of_merge": q(INDEX, GEO, "bs as (select id as sub_id, 0 as ord, 'tion' as token from geo where type = 'STATE' union all select id, 1, name from geo where type = 'STATE')", scored("bs"), top("scored", 10),
                       select="select doc_id, max(score) as score from ranked group by 1 order by 2 desc, 1 limit 10"),
    "expansion_qualify": q(INDEX, GEO, EXPQ, scored("esub"), STRENGTH("scored"), select="select em.query, em.id, round(s.strength, 6) as strength from em join sm s on s.sub_id = em.query::varchar || '/' || em.id join sm b on b.sub_id = em.query::varchar where s.strength > 0.5 and s.strength > 0.75 * b.strength"),
    "disambiguate": q(INDEX, GEO, DIS, scored("dsub"), STRENGTH("scored"), select="select dq.query, dq.id, round(s.strength, 6) as strength from dq join sm s on s.sub_id = dq.query || '/' || dq.id join sm b on b.sub_id = dq.query where s.strength > 0.7 * b.strength"),
    "numviews": "select user_id as doc_id, count(*) as num_views from events where event_type = 'view' group by 1",
    "url_normalize": rf"select page_id, {URL} as url, regexp_extract({URL}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) as host, replace(regexp_replace(regexp_replace({URL}, '\?.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/?', ''), '/', '_') as file from pages",
    "url_frontier_counts": rf"select u as url, count(*) as visits from (select {URL} as u from pages) where regexp_matches(u, '^https?://[^\s/?#]+[^\s]*$') and contains(u, 'example.') group by 1",
    "crawl_filter": "select page_id, url from pages where not contains(url, 'Category') and not contains(url, 'Talk') and not contains(url, 'User') and not contains(url, 'File') and contains(url, 'example.')",
    "crawl_content": rf"""with t as (select page_id, url, trim(regexp_replace({unescaped(f"regexp_replace({BODY}, '<[^>]*>', ' ', 'g')")}, '\s+', ' ', 'g')) as t from pages)
select page_id, replace(regexp_replace(regexp_replace({URL}, '\?.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/?', ''), '/', '_') as file from t
where (contains(t, 'tion') or contains(t, 'and')) and not contains(url, 'Category') and not contains(url, 'Talk') and not contains(url, 'User') and not contains(url, 'File')""",
    "vbyte_large": f"with a as (select o_orderkey, (o_orderkey::hugeint * (7919::hugeint * 4294967296))::bigint % 4611686018427387905 + 3 as n from orders) select o_orderkey, {VB('n')}::int as size, true as back from a",
    "wiki_urls": f"select page_id, 'https://en.wikipedia.org/wiki/page_' || page_id as url, lower(translate({TITLE} || ': Part 1', ' :', '__')) as redirect from pages",
    "admin_codes": "with a as (select s_suppkey, lpad((s_nationkey % 100)::varchar, 2, '0') as a, case when s_suppkey % 7 = 0 then '' else (s_suppkey % 1000)::varchar end as b from supplier), c as (select s_suppkey, 'US.' || a || '.' || case when length(b) in (1, 2) then lpad(b, 3, '0') else b end as county from a) select s_suppkey, county, left(county, 5) as state from c",
    "corpus_links": r"""with l as (select page_id::varchar as src, unnest(regexp_extract_all(html, 'href="/?([^ /#"]*)"', 1)) as dst from pages), n as (select distinct lower(regexp_extract(html, 'href="/?([^ /#"]*)"', 1)) as page from pages),
k as (select page from n where page <> '' union select left(page, length(page) - 5) from n where page like '%.html')
select distinct src, dst from l where dst <> '' and dst not like '.%' and src <> dst and dst in (select page from k)""",
    "grades": "select doc_id, case when quality = 1 and toxic = 0 then 1 else 0 end as relevant, case when quality = 1 and toxic = 0 and doc_id % 5 = 0 then 10 when quality = 1 and toxic = 0 then 7 when quality = 1 then 1 else 0 end as gain from labels",
    "membership_md5": "select d.doc_id, md5(d.text) as digest from documents d where md5(d.text) in (select md5(text) from documents join labels using (doc_id))",
    "text_result_lines": q(INDEX, TWO, scored("two"), top("scored", 10), select="select doc_id || chr(9) || title || chr(9) || printf('%.6f', score) || chr(9) || '0.0' || chr(9) || '0' as line from ranked join docs using (doc_id)"),
    "geojson_features": q(INDEX, GEO, select="""select id, '{"type":"Feature","id":"' || id || '","geometry":{"type":"Point","coordinates":[' || x || ',' || y || ']},"properties":{"name":"' || name || '","type":"primary","population":' || population || '}}' as feature from geo where type = 'CITY'"""),
    "query_words": "with a as (select item_id, list_filter(string_split_regex(lower(regexp_replace(text, '[^A-Za-z0-9\\s]', '', 'g')), '\\s+'), lambda z: z <> '' and z not in ({})) as ws from benchmark) select item_id, array_to_string(ws, ' ') as words, len(ws)::int as n from a".format(", ".join(f"'{w}'" for w in QUERY_STOP_WORDS)),
}
