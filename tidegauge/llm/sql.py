"""SQL of the queries that SQL can express, for whole tables."""

_CLOSED = "r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)"

SQL = {
    "op3_warc": """
        with p as (select page_id, coalesce(html, '') as h from pages),
        f as (select *, case when strlen(h) >= 100 then min(page_id) over (partition by h) end as first from p)
        select page_id, strlen(h)::bigint as payload_bytes, sha256(h) as payload_digest,
          case when first <> page_id then 'revisit' else 'response' end as record_type,
          case when first <> page_id then first end as refers_to
        from f""",
    "op4_embedding_near_dedup": f"""
        with recursive v as (select vec_id, embedding::double[] as e from embeddings),
        l as (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id <> y.vec_id
          where list_cosine_similarity(x.e, y.e) >= 0.95::double),
        {_CLOSED},
        c as (select v.vec_id, least(v.vec_id, min(r.b)) as component_id from v left join r on r.a = v.vec_id group by v.vec_id)
        select c.vec_id, (select count(*) from l where l.a = c.vec_id) as n_links, component_id, c.vec_id = component_id as kept from c""",
    "op7_ngram_jaccard_join": f"""
        with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
        s as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
          when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
        n as (select doc_id, count(*) as n from s group by doc_id),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
        l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * c >= 90 * (x.n + y.n - c)),
        {_CLOSED},
        c as (select a, min(b) as b from r group by a)
        select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) as component_id
        from d left join n on n.doc_id = d.doc_id left join c on c.a = d.doc_id""",
}
