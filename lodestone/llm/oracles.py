"""DuckDB SQL for the corpus queries that SQL can express at test size, written apart from them.

Not here, as SQL lacks the means: unigram counts (op1), BPE ids (op3, op4), XXH64 and
components (op5), trained models (op7, op9), label propagation (op10), runs of words (op11) and
two tokenizers (op13); tests hold those against plain versions.
"""

from __future__ import annotations

_KINDS = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("github", "gh[opusr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("stripe", "[rs]k_live_[A-Za-z0-9]{16,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}", 0, 1),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
)


def _matches(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""SELECT rid, {rank} AS rank, '{kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS g, {least} AS least
      FROM (SELECT rid, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {group}) AS v, regexp_split_to_array(text, '{pattern}') AS g FROM d) WHERE len(m) > 0"""


_SECRETS = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
  found AS ({" UNION ALL ".join(_matches(i, *k) for i, k in enumerate(_KINDS))}),
  placed AS (SELECT *, sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM found WINDOW w AS (PARTITION BY rid, rank ORDER BY i)),
  spans AS (SELECT rid, rank, kind, a::bigint AS a, (a + length(m))::bigint AS b FROM placed WHERE length(v) >= least),
  lists AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < 3), '') AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans FROM spans GROUP BY rid)
  SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN lists USING (rid)"""

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
_CONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("text")} AS w FROM documents),
  items AS (SELECT DISTINCT item_id, {_WORDS.format("text")} AS w FROM benchmark),
  wins AS (SELECT item_id, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s, w FROM items WHERE len(w) > 0),
  wanted AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM wins),
  sizes AS (SELECT DISTINCT n FROM wanted),
  there AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS t FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
  hits AS (SELECT rid, item_id, p, there.n FROM there JOIN wanted ON there.t = wanted.t AND there.n = wanted.n),
  places AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hits) GROUP BY rid),
  ids AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT rid, item_id::varchar AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM d LEFT JOIN places USING (rid) LEFT JOIN ids USING (rid)"""

_SEARCH = """WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint AS score FROM c q JOIN c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
  SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::int AS rank FROM s) WHERE rank <= 10"""

# Marks take 16 characters a turn besides the role; backslash and angle brackets take one more each.
_ESCAPED = "length({0}) + length({0}) - length(translate({0}, '\\<>', ''))"
_CHATS = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum({_ESCAPED.format("role")} + {_ESCAPED.format("text")} + 16)::bigint AS formatted_chars FROM t GROUP BY conv_id"""

ORACLE_SQL: dict[str, str] = {"op12_chat_format": _CHATS, "op2_secret_scan": _SECRETS, "op6_decontaminate": _CONTAMINATION, "op8_topk": _SEARCH}
