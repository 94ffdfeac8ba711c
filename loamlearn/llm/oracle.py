"""SQL for the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

_TOPK = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64*x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
 p AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v)::BIGINT AS score FROM e AS q JOIN e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
 SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20"""


def _escapes(c: str) -> str:
    """Number of backslashes that escaping puts into a text."""
    has = lambda s: f"((length({c})-length(replace({c},'{s}','')))//{len(s)})"
    tail = lambda s: f"(ends_with({c},'{s}'))::INT"
    runs = f"(length({c})-length(regexp_replace({c},'#+','#','g')))"
    back = "\\"
    return "+".join([has(back), has("</"), has("<|"), has("<" + back), tail("<"), runs, has("#" + back), tail("#")])


_ROWS = r"""SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text, role AS r, text AS t FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok'"""
_CHAT = f"""SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
 sum(CASE WHEN role='assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role='assistant' THEN text ELSE '' END, '' ORDER BY turn, r NULLS FIRST, t NULLS FIRST),'')) AS loss_sha256,
 sum(4+length(role)+2+length(text)+8+{_escapes('text')}+{_escapes('role')}+length(role)-length(replace(role,':',''))+length(role)-length(replace(role,chr(10),'')))::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens FROM ({_ROWS}) GROUP BY conv_id"""

_WORD = r"[^\x20\x09-\x0D]+"
_MIX = f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')),0)::BIGINT AS size FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS i FROM d GROUP BY source),
 w AS (SELECT *, CASE (i-1)%3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3.0::DOUBLE*source_size AS cap FROM s),
 l AS (SELECT *, (sum(source_size) OVER ()-coalesce(sum(cap) OVER (ORDER BY cap/w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0))::DOUBLE/sum(w) OVER (ORDER BY cap/w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
 t AS (SELECT source, source_size, i, least(cap, w*max(level) OVER ()) AS target FROM l),
 g AS (SELECT *, floor(target+0.5)::BIGINT AS goal FROM t),
 a AS (SELECT row_number() OVER () AS rid, doc_id, size, source_size, target, goal, i, coalesce(sum(size) OVER (PARTITION BY g.source ORDER BY md5('mix:' || doc_id || ':' || size), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS pos FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
 b AS (SELECT i, sum(need) OVER (ORDER BY i) - need AS lo, sum(need) OVER (ORDER BY i) AS hi FROM (SELECT i, ceil(goal/1024.0::DOUBLE)::BIGINT AS need FROM g)),
 q AS (SELECT slot, row_number() OVER (ORDER BY slot%2147483648*1327217885%2147483648, slot) - 1 AS place FROM (SELECT unnest(range((SELECT max(hi) FROM b)::BIGINT)) AS slot)),
 z AS (SELECT i, slot, row_number() OVER (PARTITION BY i ORDER BY slot) - 1 AS r FROM q JOIN b ON place >= lo AND place < hi),
 e AS (SELECT rid, i, pos + turn*source_size AS lo, least(pos + turn*source_size + size, goal) AS hi FROM (SELECT *, unnest(range(0, (goal - pos - 1)//source_size + 1)) AS turn FROM a WHERE size > 0 AND pos < goal)),
 n AS (SELECT rid, sum((hi-1)//1024 - lo//1024 + 1)::BIGINT AS n_slots, min(z.slot) AS first_slot FROM e JOIN z ON z.i=e.i AND z.r=lo//1024 GROUP BY rid)
 SELECT doc_id, size, source_size, target, (CASE WHEN size=0 THEN 0 ELSE goal//source_size*size + greatest(0, least(size, goal%source_size-pos)) END)::BIGINT AS taken, first_slot, coalesce(n_slots,0)::BIGINT AS n_slots FROM a LEFT JOIN n ON n.rid=a.rid"""

_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
 s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws)>=4 THEN list_transform(range(1, len(ws)-2), lambda i: array_to_string(ws[i:i+3],' ')) ELSE [array_to_string(ws,' ')] END)) AS sh FROM w WHERE len(ws)>0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.sh=b.sh AND a.doc_id<b.doc_id GROUP BY 1,2),
 k AS (SELECT p.a, p.b FROM p JOIN n AS x ON x.doc_id=p.a JOIN n AS y ON y.doc_id=p.b WHERE 100*c>=85*(x.n+y.n-c)),
 e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
 r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON e.a=r.y)
 SELECT d.doc_id, coalesce(n.n,0)::BIGINT AS n_shingles, m.c AS component_id FROM documents AS d LEFT JOIN n ON n.doc_id=d.doc_id JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) AS m ON m.x=d.doc_id"""




def _kind(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    q = pattern.replace("'", "''")
    start = "list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda p: length(p))), 0)"
    return f"""SELECT rid, src, {order} AS o, '{kind}' AS kind, u.s::BIGINT AS s, (u.s + u.n)::BIGINT AS e, u.v FROM (SELECT rid, src, unnest(list_transform(range(1, len(hits)+1), lambda i: {{'s': {start}, 'n': length(hits[i]), 'v': vals[i]}})) AS u
 FROM (SELECT rid, src, regexp_extract_all(t, '{q}', 0) AS hits, regexp_extract_all(t, '{q}', {group}) AS vals, string_split_regex(t, '{q}') AS pieces FROM h)) WHERE length(u.v) >= {least}"""


def _secrets_sql() -> str:
    from .secrets import BASE, KINDS, PLACEHOLDER

    n = len(BASE)
    live = f"len(list_distinct(string_split(v,''))) >= least(12, 6 + length(v)//16) AND NOT regexp_matches(v, '{PLACEHOLDER}')"
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o)"
    return f"""WITH h AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(1)) AS src, coalesce(text, '') AS t FROM documents),
 f AS ({' UNION ALL '.join(_kind(i, *k) for i, k in enumerate(KINDS))}), w AS (SELECT v, count(DISTINCT src) AS owners FROM f GROUP BY v),
 a AS (SELECT rid, count(*) FILTER (o=0) AS n_assign, count(*) FILTER (o=1) AS n_access, count(*) FILTER (o=2) AS n_hex, {joined} FILTER (o<{n}) AS base, {joined} AS spans, count(*) FILTER (owners=1 AND {live}) AS n_live, count(*) FILTER (NOT (owners=1 AND {live})) AS n_copied FROM f JOIN w USING (v) GROUP BY rid)
 SELECT doc_id, coalesce(n_assign,0) AS n_assign, coalesce(n_access,0) AS n_access, coalesce(n_hex,0) AS n_hex, sha256(coalesce(base,'')) AS base_sha256, coalesce(spans,'') AS spans, coalesce(n_live,0) AS n_live, coalesce(n_copied,0) AS n_copied FROM h LEFT JOIN a ON a.rid=h.rid"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": _TOPK, "op2_chat_format": _CHAT, "op4_mix_sources": _MIX, "op8_secret_scan": _secrets_sql(), "op10_ngram_join": _JOIN}
