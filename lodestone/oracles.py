"""DuckDB SQL that says the same as the registered queries, written apart from them."""

from __future__ import annotations

from lodestone.functions.text import TOKEN_BREAKS
from lodestone.plans.rag import NO_EVIDENCE

_BREAKS = TOKEN_BREAKS.replace("'", "''")
_COLLECTION = "coll AS (SELECT d.doc_id AS id, d.text, d.lang, d.source, d.n_chars, e.embedding AS vector FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"
_DOT = "list_reduce(list_prepend(0::double, list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double)), lambda s, x: s + x)"
_L2 = "list_reduce(list_prepend(0::double, list_transform(list_zip({a}, {b}), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))), lambda s, x: s + x)"
_SCORES = {
    "IP": _DOT.format(a="q.embedding", b="c.vector"),
    "L2": _L2.format(a="q.embedding", b="c.vector"),
    "COSINE": f"{_DOT.format(a='q.embedding', b='c.vector')} / (sqrt({_DOT.format(a='q.embedding', b='q.embedding')}) * sqrt({_DOT.format(a='c.vector', b='c.vector')}))",
}


QUESTIONS = "q.vec_id IN (SELECT item_id FROM benchmark)"


def _dense(metric: str, where: str = "TRUE", having: str = "TRUE", places: str = "round({}, 6)", order: str = "DESC", asked: str = "q.vec_id % 100 = 0") -> str:
    return f"""{_COLLECTION}, scored AS (SELECT q.vec_id AS qid, c.id, {_SCORES[metric]} AS s FROM embeddings q, coll c WHERE {asked} AND ({where})),
    dense AS (SELECT * FROM (SELECT qid, id, {places.format("s")} AS score, (row_number() OVER (PARTITION BY qid ORDER BY s {order}, id))::int AS rank FROM scored) WHERE rank <= 5 AND ({having}))"""


_TERMS = f"""toks AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_BREAKS}'), lambda t: t <> '') AS t FROM documents),
    size AS (SELECT count(*) AS n, coalesce(nullif(avg(len(t)), 0), 1) AS avgdl FROM toks),
    post AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY id, term),
    idf AS (SELECT term, df, ln((n - df + 0.5::double) / (df + 0.5::double) + 1::double) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), size),
    docw AS (SELECT id, term, tf, round(idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * greatest(dl, 1) / avgdl)), 6) AS w FROM post JOIN idf USING (term), size),
    qtoks AS (SELECT item_id AS qid, unnest(list_filter(regexp_split_to_array(lower(text), '{_BREAKS}'), lambda t: t <> '')) AS term FROM benchmark),
    qw AS (SELECT qid, term, round(idf * tf * 2.5::double / (tf + 1.5::double), 6) AS w FROM (SELECT qid, term, count(*) AS tf FROM qtoks GROUP BY qid, term) JOIN idf USING (term))"""


def _sparse(where: str = "TRUE", having: str = "TRUE") -> str:
    return f"""sscored AS (SELECT qid, d.id, round(sum(d.w * q.w), 6) AS score FROM docw d JOIN qw q USING (term) WHERE d.id IN (SELECT doc_id FROM documents WHERE {where}) GROUP BY qid, d.id),
    sparse AS (SELECT * FROM (SELECT qid, id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::int AS rank FROM sscored) WHERE rank <= 5 AND ({having}))"""


_RRF = """fused AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, coalesce(a.score, b.score) AS score,
      coalesce(1::double / (60 + a.rank), 0) + coalesce(1::double / (60 + b.rank), 0) AS rrf_score, a.rank AS ra, b.rank AS rb
      FROM dense a FULL JOIN sparse b ON a.qid = b.qid AND a.id = b.id),
    hybrid AS (SELECT * EXCLUDE (ra, rb) FROM (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, ra NULLS LAST, rb NULLS LAST))::int AS rank FROM fused) WHERE rank <= 5)"""
_HITS = f"""{_dense("IP", having="score >= 0.2", asked=QUESTIONS)}, hits AS (SELECT h.*, d.text, d.source FROM dense h JOIN documents d ON h.id = d.doc_id),
    ctx AS (SELECT qid, string_agg('[文档' || rank || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS k FROM hits GROUP BY qid)"""
_WINDOWS = """w AS (SELECT doc_id, i::int AS chunk_index, substring(text, i * 450 + 1, 500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 450 + 1)) AS i FROM documents WHERE length(text) > 0))"""
_FRESH = "SELECT DISTINCT sha256(text) AS text_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)"

EN = "lang = 'en' AND n_chars > 500"

_EVENTS = r"""WITH t AS (SELECT len(regexp_extract_all(text, '^\s+|\S+\s*')) AS n FROM conversations WHERE role = 'user')
    SELECT 'sources' AS event, count(*) AS n, 0::bigint AS last FROM t
    UNION ALL SELECT 'token', sum(n)::bigint, max(n)::bigint FROM t HAVING sum(n) > 0
    UNION ALL SELECT 'done', count(*), (max(n) + 1)::bigint FROM t"""
_EMBEDDED = r"""WITH w AS (SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [''] ELSE l END) AS word FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\x1c-\x1f\x0b\x{85}\x{a0}]+'), lambda x: x <> '') AS l FROM documents)),
    h AS (SELECT doc_id, ('0x' || substring(md5(word), 1, 2))::int & 63 AS slot, CASE WHEN ('0x' || substring(md5(word), 15, 2))::int & 64 <> 0 THEN 1 ELSE -1 END AS sign FROM w),
    v AS (SELECT doc_id, slot, sum(sign)::double AS x FROM h GROUP BY doc_id, slot)
    SELECT doc_id, 64::int AS dimension, CASE WHEN sum(x * x) > 0 THEN 1 ELSE 0 END::double AS norm, round(coalesce(sum(x) FILTER (slot = 0), 0) / CASE WHEN sum(x * x) > 0 THEN sqrt(sum(x * x)) ELSE 1 END, 4) AS first FROM v GROUP BY doc_id"""

ORACLE_SQL: dict[str, str] = {
    "sse_events": _EVENTS,
    "embed_documents": _EMBEDDED,
    "dense_topk_ip": f"WITH {_dense('IP', places='{}')} SELECT * FROM dense",
    "ivf_topk": f"WITH {_dense('IP')} SELECT * FROM dense",
    "dense_topk_l2": f"WITH {_dense('L2', order='ASC')} SELECT * FROM dense",
    "dense_topk_cosine": f"WITH {_dense('COSINE')} SELECT * FROM dense",
    "dense_topk_threshold": f"WITH {_dense('IP', having='score >= 0.25')} SELECT * FROM dense",
    "dense_topk_expr": "WITH " + _dense("IP", where="lang IN ('en', 'de') AND n_chars >= 300 OR source = 'src3'") + " SELECT * FROM dense",
    "vector_normalize": f"SELECT vec_id, round(n, 6) AS norm, round(embedding[1]::double / n, 6) AS first, round(n / n, 6) AS unit_norm FROM (SELECT *, sqrt({_DOT.format(a='embedding', b='embedding')}) AS n FROM embeddings)",
    "vector_dim_check": "SELECT len(embedding) = 64 AS fits, count(*) AS n FROM embeddings GROUP BY 1",
    "tokenize_counts": f"WITH {_TERMS} SELECT id AS doc_id, len(t)::bigint AS n_tokens, len(list_distinct(t))::bigint AS n_terms FROM toks",
    "bm25_tf": f"WITH {_TERMS} SELECT id, term, tf FROM post",
    "bm25_df": f"WITH {_TERMS} SELECT term, df FROM idf",
    "bm25_idf": f"WITH {_TERMS} SELECT term, round(idf, 6) AS idf FROM idf",
    "bm25_avgdl": f"WITH {_TERMS} SELECT n, round(avgdl, 6) AS avgdl FROM size",
    "bm25_doc_weights": f"WITH {_TERMS} SELECT * FROM docw",
    "bm25_query_weights": f"WITH {_TERMS} SELECT * FROM qw",
    "bm25_search": f"WITH {_TERMS}, {_sparse()} SELECT * FROM sparse",
    "bm25_blockmax": f"WITH {_TERMS}, {_sparse()} SELECT * FROM sparse",
    "bm25_search_expr": f"WITH {_TERMS}, {_sparse(EN, 'score >= 20')} SELECT * FROM sparse",
    "hybrid_rrf": f"WITH {_dense('IP', asked=QUESTIONS)}, {_TERMS}, {_sparse()}, {_RRF} SELECT * FROM hybrid",
    "hybrid_rrf_threshold": f"WITH {_dense('IP', asked=QUESTIONS)}, {_TERMS}, {_sparse()}, {_RRF} SELECT * FROM hybrid WHERE rrf_score >= 0.016",
    "hybrid_rrf_dense_only": f"WITH {_dense('IP', asked=QUESTIONS)} SELECT qid, id, score, 1::double / (60 + rank) AS rrf_score, rank FROM dense",
    "fixed_chunks": f"WITH {_WINDOWS} SELECT * FROM w",
    "fixed_chunks_ids": f"WITH {_WINDOWS} SELECT doc_id, chunk_index, row_number() OVER (ORDER BY doc_id, chunk_index) - 1 AS chunk_id FROM w WHERE length(chunk) >= 20",
    "chunk_min_length": f"WITH {_WINDOWS} SELECT doc_id, chunk_index, length(chunk) AS n_chars FROM w WHERE length(chunk) >= 20",
    "chunk_stats": f"WITH {_WINDOWS} SELECT count(DISTINCT doc_id) AS files_processed, count(*) AS chunks_generated, round(count(*)::double / count(DISTINCT doc_id), 2) AS avg_chunks_per_file, 500::int AS chunk_size, 50::int AS chunk_overlap, 20::int AS min_chunk_length FROM w WHERE length(chunk) >= 20",
    "rag_context": f"WITH {_HITS} SELECT qid, context FROM ctx",
    "rag_prompt": f"WITH {_HITS} SELECT qid, context || chr(10) || '---' || chr(10) || b.text AS prompt FROM ctx JOIN benchmark b ON b.item_id = qid",
    "rag_sources": f"WITH {_HITS} SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY rank) - 1)::int AS place, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS text, source, score FROM hits",
    "rag_fallback": f"SELECT item_id AS qid, '{NO_EVIDENCE}' AS answer, 0::bigint AS n_sources, '' AS context FROM benchmark",
    "rag_answer_template": f"WITH {_HITS} SELECT item_id AS qid, coalesce(trim(h.text, ' ' || chr(9) || chr(10) || chr(13)), '{NO_EVIDENCE}') AS answer, coalesce(k, 0) AS n_sources FROM benchmark LEFT JOIN ctx ON ctx.qid = item_id LEFT JOIN hits h ON h.qid = item_id AND h.rank = 1",
    "hit_display": f"WITH {_HITS} SELECT qid, rank, CASE WHEN length(text) > 120 THEN replace(substring(text, 1, 120), chr(10), ' ') || '...' ELSE replace(text, chr(10), ' ') END AS preview, CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '...' ELSE text END AS short, printf('%.4f', score) AS shown, source AS label FROM hits",
    "collection_stats": "SELECT count(*) AS num_entities FROM documents JOIN embeddings ON doc_id = vec_id",
    "collection_roundtrip": f"WITH {_TERMS} SELECT doc_id, length(text) AS n_chars, CASE WHEN strlen(text) <= 65535 THEN len(list_distinct(t))::bigint END AS n_terms FROM documents JOIN toks ON toks.id = doc_id JOIN embeddings ON vec_id = doc_id",
    "embed_cache_misses": _FRESH,
    "question_validation": "SELECT conv_id, turn, length(trim(text)) AS n_chars FROM conversations WHERE role = 'user' AND length(trim(text)) BETWEEN 1 AND 2000 AND turn * 7 BETWEEN 1 AND 50",
}
