"""DuckDB SQL of the queries that SQL can express. The others are tested against brute force in ``tests/llm``."""

from __future__ import annotations

_SQL = {
    "op1_exact_top_k": """
        with v as (
          select vec_id as id, min(list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint))) as v
          from embeddings
          where vec_id is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
          group by vec_id),
        scored as (
          select q.id as query_id, c.id as vec_id,
            list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as score
          from v q join v c on c.id <> q.id where q.id % 20 = 0),
        ranked as (
          select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
        select query_id, cast(rank as integer) as rank, vec_id, cast(score as bigint) as score from ranked where rank <= 20
    """,
    "op4_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        k as (select html, max(page_id) as kept from p where octet_length(encode(html)) >= 1000 group by html)
        select p.page_id, cast(octet_length(encode(p.html)) as bigint) as payload_bytes, sha1(p.html) as payload_digest,
          case when p.page_id < k.kept then 'revisit' else 'response' end as record_type,
          case when p.page_id < k.kept then k.kept end as refers_to
        from p left join k on p.html = k.html
    """,
    "op6_minhash_dedup": r"""
        with recursive w as (
          select doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
          from documents),
        sets as (
          select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
            else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as own from w),
        sizes as (select doc_id, len(own) as n from sets),
        shingles as (select doc_id, unnest(own) as shingle from sets),
        common as (
          select a.doc_id as a, b.doc_id as b, count(*) as c
          from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
        linked as (
          select a, b from common join sizes s on s.doc_id = a join sizes t on t.doc_id = b
          where 100 * c >= 85 * (s.n + t.n - c)),
        links as (select a, b from linked union all select b, a from linked),
        reached as (
          select doc_id, doc_id as other from sizes
          union
          select r.doc_id, l.b from reached r join links l on l.a = r.other)
        select doc_id, cast(n as bigint) as n_shingles, min(other) as component_id, doc_id = min(other) as kept
        from sizes join reached using (doc_id) group by doc_id, n
    """,
    "op11_exact_dedup": r"""
        with d as (
          select doc_id, coalesce(text, '') as raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as own from documents),
        g as (
          select own, count(*) as n, first(doc_id order by length(raw) desc, doc_id nulls last) as keep_id from d group by own)
        select d.doc_id, g.keep_id, cast(g.n as bigint) as group_size, d.doc_id = g.keep_id as kept, sha256(d.own) as text_sha256
        from d join g on d.own = g.own
    """,
    "op12_collocations": r"""
        with p as (
          select coalesce(lang, 'und') as lang, unnest(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
          from documents),
        w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
        totals as (select lang, cast(sum(len(ws)) as bigint) as n from w group by lang),
        spans as (select lang, ws, unnest(generate_series(1, 5)) as m from w),
        grams as (
          select lang, m, unnest(list_transform(generate_series(1, len(ws) - m + 1), lambda i: array_to_string(ws[i:i + m - 1], ' '))) as phrase
          from spans where len(ws) >= m),
        f as (select lang, m, phrase, count(*) as f from grams group by all having count(*) >= 100),
        cands as (select lang, m, phrase, f as a, string_split(phrase, ' ') as ws from f where m > 1),
        cuts as (select *, unnest(generate_series(1, m - 1)) as k from cands),
        scored as (
          select c.lang, c.phrase, c.a, c.k, h.f as l, t.f as r, n.n,
            (1000::hugeint * c.a * n.n) // (h.f::hugeint * t.f) as score
          from cuts c join f h on h.lang = c.lang and h.phrase = array_to_string(c.ws[1:c.k], ' ')
          join f t on t.lang = c.lang and t.phrase = array_to_string(c.ws[c.k + 1:c.m], ' ') join totals n on n.lang = c.lang),
        worst as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
        longer as (select *, unnest(generate_series(2, m - 1)) as len from cands where m > 2),
        inside as (
          select lang, a, unnest(list_transform(generate_series(1, m - len + 1), lambda i: array_to_string(ws[i:i + len - 1], ' '))) as phrase from longer),
        around as (select lang, phrase, max(a) as f from inside group by all),
        kept as (
          select w.* from worst w left join around x on x.lang = w.lang and x.phrase = w.phrase
          where x.f is null or 100 * x.f < 100 * w.a),
        ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
        select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score from ranked where rank <= 2000
    """,
    "op13_divergence": r"""
        with d as (
          select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
        t as (select id, lang, source, unnest(ws) as term from d),
        kept as (select lang, term, count(*) as ln from t group by all having count(distinct id) >= 30),
        vs as (select lang, count(*) as v, sum(ln) as l from kept group by lang),
        own as (select lang, source, term, count(*) as n, any_value(ln) as ln from t join kept using (lang, term) group by all),
        groups as (
          select g.lang, g.source, coalesce(s.total, 0) as total, coalesce(v.v, 0) as v, coalesce(v.l, 0) as l
          from (select distinct lang, source from d) g
          left join (select lang, source, sum(n) as total from own group by all) s on s.lang = g.lang and s.source = g.source
          left join vs v on v.lang = g.lang),
        shares as (
          select g.lang, g.source, k.term, coalesce(o.n, 0) as n,
            1 + (1000000000::hugeint * (coalesce(o.n, 0) + 5)) // (g.total + 5 * g.v)::hugeint as p,
            1 + (1000000000::hugeint * (k.ln + 5)) // (g.l + 5 * g.v)::hugeint as q
          from groups g join kept k on k.lang = g.lang
          left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term),
        sums as (
          select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
          from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
        pairs as (
          select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(s.value, 0) as bigint) as value
          from groups a join groups b on a.lang = b.lang and a.source <> b.source
          left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
        found as (
          select * from pairs
          union all
          select lang, source, 'term', term, cast(p - q as bigint) from shares where n > 0 and p > q),
        ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from found)
        select lang, source, part, item, value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 50
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
