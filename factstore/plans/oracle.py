"""DuckDB SQL giving the same rows as the registered queries, over the whole tables."""

from __future__ import annotations

from factstore.functions.text import WHITESPACE

_WS = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def _strip(x: str) -> str:
    return f"trim({x}, {_WS})"


_MEM = """
clock AS (
  SELECT *, doc_id * 37 % 2500 AS days, doc_id * 7919 % 86400 AS secs,
         CAST(CAST(date '2019-01-01' + CAST(doc_id * 37 % 2500 AS INTEGER) AS DATE) AS VARCHAR) AS d,
         lpad(CAST(doc_id * 7919 % 86400 // 3600 AS VARCHAR), 2, '0') || ':' ||
         lpad(CAST(doc_id * 7919 % 86400 % 3600 // 60 AS VARCHAR), 2, '0') || ':' ||
         lpad(CAST(doc_id * 7919 % 86400 % 60 AS VARCHAR), 2, '0') AS t
  FROM documents),
mem AS (
  SELECT 'doc-' || doc_id AS id, text AS memory, source AS user_id,
         '{"lang":"' || lang || '","n_chars":' || n_chars || '}' AS metadata, doc_id,
         CASE doc_id % 12
           WHEN 0 THEN d || 'T' || t
           WHEN 1 THEN d || 'T' || t || 'Z'
           WHEN 2 THEN d || 'T' || t || '.250000+05:30'
           WHEN 3 THEN d
           WHEN 4 THEN CAST(1546300800 + days * 86400 + secs AS VARCHAR)
           WHEN 5 THEN CAST(1546300800 + days * 86400 + secs AS VARCHAR) || '.5'
           WHEN 6 THEN 'not a date'
           WHEN 7 THEN NULL
           WHEN 8 THEN d || ' ' || t
           WHEN 9 THEN '  ' || d || 'T' || substr(t, 1, 5) || ' '
           WHEN 10 THEN replace(d, '-', '')
           ELSE d || 'T' || replace(t, ':', '') || '-0800'
         END AS created_at
  FROM clock)"""

# The date rule written out with regular expressions and arithmetic.
_DATED = _MEM + r""",
trimmed AS (SELECT *, trim(created_at) AS s FROM mem),
parts AS (
  SELECT *,
    regexp_full_match(s, '\d+(\.\d*)?|\.\d+') AS is_epoch,
    regexp_full_match(s, '\d{4}-\d{2}-\d{2}(T.*)?') AND NOT contains(s, ' ') AS is_iso,
    regexp_extract(s, '^(\d{4}-\d{2}-\d{2})', 1) AS day,
    regexp_extract(s, 'T(\d{2})', 1) AS hh, regexp_extract(s, 'T\d{2}:?(\d{2})', 1) AS mi,
    regexp_extract(s, 'T\d{2}:?\d{2}:?(\d{2})', 1) AS ss, regexp_extract(s, '(\.\d+)', 1) AS frac,
    regexp_extract(s, 'T.*([+-]\d{2}):?\d{2}$', 1) AS zh, regexp_extract(s, 'T.*[+-]\d{2}:?(\d{2})$', 1) AS zm
  FROM trimmed),
dated AS (
  SELECT *, CASE
    WHEN is_epoch THEN CAST(s AS DOUBLE)
    WHEN is_iso THEN epoch(CAST(day AS TIMESTAMP))
      + coalesce(TRY_CAST(hh AS INTEGER), 0) * 3600 + coalesce(TRY_CAST(mi AS INTEGER), 0) * 60
      + coalesce(TRY_CAST(ss AS INTEGER), 0) + coalesce(TRY_CAST('0' || frac AS DOUBLE), 0)
      - CASE WHEN zh = '' THEN 0 ELSE CAST(zh AS INTEGER) * 3600
             + CASE WHEN zh LIKE '-%' THEN -1 ELSE 1 END * CAST(zm AS INTEGER) * 60 END
    END AS epoch
  FROM parts)"""

_CUTOFF = "1735689600.0 - 365 * 86400.0"

_VEC = """
vec AS (SELECT vec_id AS id, 'u' || label AS user_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""

_CENTER = _VEC + """,
spread AS (SELECT user_id, unnest(v) AS x, unnest(range(len(v))) AS place FROM vec),
means AS (SELECT user_id, place, avg(x) AS x FROM spread GROUP BY ALL),
center AS (SELECT user_id, list(x ORDER BY place) AS q FROM means GROUP BY user_id)"""


def _one_search(user: str, limit: int) -> str:
    return f"""WITH {_VEC},
q AS (SELECT arg_min(v, id) AS q FROM vec WHERE user_id = '{user}'),
hits AS (
  SELECT id, user_id, round(list_cosine_similarity(v, q), 12) AS s FROM vec, q WHERE user_id = '{user}'
  ORDER BY s DESC, id LIMIT {limit}),
ranked AS (SELECT row_number() OVER (ORDER BY s DESC, id) AS rank, id, user_id, s FROM hits)"""


_PAIRS = f"""WITH {_VEC}
SELECT a.user_id AS user_id, a.id AS id, b.id AS match_id, round(list_cosine_similarity(a.v, b.v), 4) AS score
FROM vec a JOIN vec b ON a.user_id = b.user_id AND b.id < a.id
WHERE round(list_cosine_similarity(a.v, b.v), 12) >= 0.3
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.id) = 1"""

_WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"

_BM25 = f"""WITH docs AS (
  SELECT 'doc-' || doc_id AS id, {_WORDS.format('text')} AS words FROM documents),
sizes AS (SELECT count(*) AS n_docs, avg(len(words)) AS avg_length FROM docs),
flat AS (SELECT id, len(words) AS length, unnest(words) AS term FROM docs),
tf AS (SELECT id, length, term, count(*) AS tf FROM flat GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT item_id AS query_id, unnest(list_distinct({_WORDS.format('text')})) AS term FROM benchmark),
scored AS (
  SELECT query_id, id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2
         / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))) AS s
  FROM asked JOIN tf USING (term) JOIN dfs USING (term) CROSS JOIN sizes GROUP BY query_id, id)
SELECT query_id, id, rank, round(s, 4) AS bm25 FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM scored)
WHERE rank <= 10"""

_NONE = "CAST([] AS VARCHAR[])"


def _cut_line(limit: int) -> str:
    """Words of one line packed under the limit, as a list."""
    return f"""list_transform([list_reduce(
      list_transform(string_split(l, ' '), lambda w:
        {{'c': CASE WHEN length(w) > {limit} THEN list_transform(range(0, length(w), {limit}), lambda i: substr(w, i + 1, {limit})) ELSE {_NONE} END, 'p': w}}),
      lambda a, x: CASE
        WHEN length(x.p) > {limit} THEN
          {{'c': list_concat(CASE WHEN a.p <> '' THEN list_append(a.c, a.p) ELSE a.c END, x.c), 'p': ''}}
        WHEN length(a.p) + length(x.p) + 1 > {limit} AND a.p <> '' THEN {{'c': list_append(a.c, a.p), 'p': x.p}}
        ELSE {{'c': a.c, 'p': CASE WHEN a.p = '' THEN x.p ELSE a.p || ' ' || x.p END}} END,
      {{'c': {_NONE}, 'p': ''}})], lambda r: CASE WHEN r.p <> '' THEN list_append(r.c, r.p) ELSE r.c END)[1]"""


def _lines(limit: int) -> str:
    return f"""list_transform(string_split(text, chr(10)), lambda l:
    {{'c': CASE WHEN length(l) > {limit} THEN {_cut_line(limit)} ELSE {_NONE} END, 'p': l}})"""


def _packed(limit: int, compat: bool) -> str:
    """Chunks of documents: lines packed together, or each line a paragraph."""
    glue = "chr(10)" if compat else "chr(10) || chr(10)"
    reserve = 1 if compat else 2
    flush = "CASE WHEN a.p <> '' THEN list_append(a.c, a.p) ELSE a.c END"
    huge = "{'c': list_concat(a.c, x.c), 'p': a.p}" if compat else f"{{'c': list_concat({flush}, x.c), 'p': ''}}"
    # The length of a document is that of the text the query packs.
    whole = "length(text)" if compat else "length(replace(text, chr(10), chr(10) || chr(10)))"
    same = "text" if compat else "replace(text, chr(10), chr(10) || chr(10))"
    return f"""packed AS (
  SELECT doc_id, CASE WHEN {whole} <= {limit} THEN [{same}] ELSE list_transform([list_reduce({_lines(limit)},
    lambda a, x: CASE
      WHEN length(x.p) > {limit} THEN {huge}
      WHEN length(a.p) + length(x.p) + {reserve} > {limit} THEN {{'c': {flush}, 'p': x.p}}
      ELSE {{'c': a.c, 'p': CASE WHEN a.p = '' THEN x.p ELSE a.p || {glue} || x.p END}} END,
    {{'c': {_NONE}, 'p': ''}})], lambda r: CASE WHEN r.p <> '' THEN list_append(r.c, r.p) ELSE r.c END)[1] END AS pieces
  FROM documents)"""


_REQUESTS = f"""
asked AS (
  SELECT CAST(doc_id AS VARCHAR) AS request_id, text AS content, * FROM documents
  UNION ALL SELECT 'none-' || doc_id, NULL, * FROM documents WHERE doc_id % 50 = 0
  UNION ALL SELECT 'blank-' || doc_id, ' ' || chr(10) || chr(9) || ' ', * FROM documents WHERE doc_id % 50 = 1),
requests AS (
  SELECT request_id, nullif(source, 'src3') AS owner, source, text, doc_id, lang, content FROM asked),
checked AS (
  SELECT *, coalesce(owner, 'dev') AS user_id, {_strip('content')} AS stripped FROM requests)"""

def _under(source: str, limit: int) -> str:
    """Chunks of ``text`` in rows of ``source`` under the header ``head``, whose length varies."""
    packed = _packed("room", True).replace("FROM documents)", "FROM roomy)").replace("SELECT doc_id,", "SELECT *,")
    return f"""roomy AS (SELECT *, {limit} - CASE WHEN head = '' THEN 0 ELSE length(head) + 2 END AS room FROM {source}),
{packed},
headed AS (SELECT * EXCLUDE (pieces), CASE WHEN head = '' THEN pieces
  ELSE list_transform(pieces, lambda p: head || chr(10) || chr(10) || p) END AS pieces FROM packed)"""


_FILE = "source || '/' || doc_id || '.md'"

_ITEMS = f"""
items AS (
  SELECT doc_id AS pos, text, lang, n_chars,
         CASE WHEN {_strip('text')} = '' THEN 'Empty memory text, skipped' END AS message FROM documents
  UNION ALL SELECT -doc_id - 1, NULL, NULL, NULL,
    CASE doc_id % 20 WHEN 3 THEN 'Non-dict item skipped: int' WHEN 7 THEN 'Non-dict item skipped: str'
         WHEN 13 THEN 'Non-dict item skipped: list' ELSE 'Empty memory text, skipped' END
  FROM documents WHERE doc_id % 20 IN (3, 7, 11, 13)),
valid AS (SELECT pos, text, lang, n_chars, lower({_strip('text')}) AS k FROM items WHERE message IS NULL),
stored AS (
  SELECT DISTINCT lower({_strip('text')}) AS k FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
fresh AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS nth FROM valid)
  WHERE nth = 1 AND k NOT IN (SELECT k FROM stored))"""

_NEW_ROWS = f"""WITH {_ITEMS}
SELECT pos, 'team' AS user_id, md5(text) AS memory_md5,
       '{{"lang":"' || lang || '","n_chars":' || n_chars || '}}' AS metadata FROM fresh"""

_VERBATIM = f"""WITH {_REQUESTS}, {_packed(3000, True)}
SELECT request_id, user_id, len(pieces) AS n_chunks, md5(array_to_string(pieces, chr(1))) AS chunks_md5
FROM checked JOIN packed USING (doc_id) WHERE stripped <> ''"""

_FACT_CHECK = f"""WITH {_REQUESTS}
SELECT request_id, user_id,
  CASE WHEN content IS NULL THEN 'content_required' WHEN stripped = '' THEN 'empty_content'
       WHEN length(stripped) > 3000 THEN 'too_long' END AS error_code,
  CASE WHEN content IS NULL THEN 'content is required.' WHEN stripped = '' THEN 'Cannot save empty content.'
       WHEN length(stripped) > 3000 THEN 'Content exceeds the verbatim chunk size: ' || length(content)
            || ' chars (limit 3000).' END AS message,
  CASE WHEN content IS NULL THEN 'Send a content value with the text to keep.'
       WHEN stripped = '' THEN 'Send at least one visible character.'
       WHEN length(stripped) > 3000 THEN 'Send it in verbatim mode, which cuts long texts, or shorten it.'
  END AS fix
FROM checked"""

_UPDATES = _MEM + """,
updates AS (
  SELECT 'doc-' || doc_id AS memory_id,
         CASE WHEN toxic = 1 THEN ' ' ELSE 'quality ' || quality END AS content FROM labels
  UNION ALL SELECT 'page-' || page_id, url FROM pages)"""

_CSV = """lines AS (
  SELECT id || ',' ||
    CASE WHEN regexp_matches(memory, '[,"\\r\\n]') THEN '"' || replace(memory, '"', '""') || '"' ELSE memory END
    || ',"' || replace(metadata, '"', '""') || '",' || coalesce(created_at, '') || ',' || user_id AS line FROM mem)"""

ORACLES = {
    "search_topk": _one_search("u0", 10) + " SELECT rank, id, user_id, round(s, 4) AS score FROM ranked",
    "search_floor": _one_search("u1", 50) + " SELECT rank, id, round(s, 4) AS score FROM ranked WHERE s >= 0.1",
    "search_no_scores": _one_search("u2", 5) + " SELECT rank, id, user_id FROM ranked",
    "search_batch": f"""WITH {_CENTER}
SELECT user_id AS query_id, rank, id, round(s, 4) AS score FROM (
  SELECT user_id, id, s, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, id) AS rank
  FROM (SELECT user_id, id, round(list_cosine_similarity(v, q), 12) AS s FROM vec JOIN center USING (user_id)))
WHERE rank <= 10""",
    "search_records": f"""WITH {_CENTER}
SELECT user_id AS query_id, rank, user_id, hits.id AS id, round(s, 4) AS score, md5(text) AS memory_md5 FROM (
  SELECT user_id, id, s, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, id) AS rank
  FROM (SELECT user_id, id, round(list_cosine_similarity(v, q), 12) AS s FROM vec JOIN center USING (user_id))) AS hits
LEFT JOIN documents ON doc_id = hits.id
WHERE rank <= 10""",
    "search_batch_blocks": f"""WITH {_VEC}
SELECT query_id, rank, id, round(s, 4) AS score FROM (
  SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank
  FROM (SELECT a.id AS query_id, b.id AS id, round(list_cosine_similarity(a.v, b.v), 12) AS s
        FROM vec a JOIN vec b USING (user_id)))
WHERE rank <= 5""",
    "cosine_to_centroid": f"""WITH {_CENTER}
SELECT id, round(list_cosine_similarity(v, q), 4) AS score FROM vec JOIN center USING (user_id)""",
    "near_duplicates": _PAIRS,
    "near_duplicates_blocks": _PAIRS,
    "near_duplicates_bucketed": _PAIRS,
    "search_approx": f"""WITH {_VEC}
SELECT query_id, rank, id, round(s, 4) AS score FROM (
  SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank
  FROM (SELECT a.id AS query_id, b.id AS id, round(list_cosine_similarity(a.v, b.v), 12) AS s
        FROM vec a JOIN vec b USING (user_id) WHERE a.id % 50 = 0))
WHERE rank <= 10""",
    "bm25_scores": _BM25,
    "embed_encoder": """SELECT 'doc-' || doc_id AS id, length(text) AS chars,
  length(text) - length(replace(text, ' ', '')) AS blanks, length(text) - length(replace(text, 'e', '')) AS letters_e,
  CAST(1 AS BIGINT) AS one FROM documents""",
    "list_namespace": f"""WITH {_MEM}
SELECT id, md5(memory) AS memory_md5, metadata, created_at FROM mem WHERE user_id = 'src1'""",
    "page_2": f"""WITH {_DATED}
SELECT user_id, position, id FROM (
  SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY epoch NULLS FIRST, id) AS position FROM dated)
WHERE position BETWEEN 11 AND 20""",
    "page_far": f"""WITH {_DATED},
placed AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY epoch NULLS FIRST, id) AS position FROM dated)
SELECT 'each' AS of, user_id, position, id FROM placed WHERE position BETWEEN 31 AND 40
UNION ALL SELECT 'src5', user_id, position, id FROM placed WHERE user_id = 'src5' AND position BETWEEN 36 AND 42""",
    "page_of_namespace": f"""WITH {_DATED}
SELECT id, created_at FROM dated WHERE user_id = 'src5' ORDER BY epoch NULLS FIRST, id LIMIT 7 OFFSET 7""",
    "get_by_ids": f"""WITH {_MEM}, ids AS (
  SELECT 'doc-' || doc_id AS id FROM labels UNION SELECT 'page-' || page_id FROM pages)
SELECT ids.id AS id, mem.id IS NOT NULL AS found, user_id,
       CASE WHEN mem.id IS NULL THEN 'Failed to retrieve memory ''' || ids.id || '''.' END AS message
FROM ids LEFT JOIN mem ON ids.id = mem.id""",
    "get_stored_ids": f"""WITH {_MEM}, first AS (
  SELECT 'doc-' || min(doc_id) AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source)
SELECT mem.id AS id, true AS found, user_id, md5(memory) AS memory_md5 FROM mem JOIN first USING (id)
UNION ALL SELECT id || '-none', false, NULL, NULL FROM first""",
    "entities": """SELECT DISTINCT entity FROM (
  SELECT CAST(user_id AS VARCHAR) AS entity FROM events UNION ALL SELECT event_type FROM events
  UNION ALL SELECT json_extract_string(props, '$.k') FROM events) WHERE entity <> ''""",
    "listing_stats": "SELECT count(*) AS memories, count(DISTINCT user_id) AS entities FROM events",
    "grep_records": f"""WITH {_MEM},
rec AS (SELECT id, lower(CAST(json_object('id', id, 'memory', memory, 'user_id', user_id,
          'created_at', coalesce(created_at, ''), 'metadata', CAST(metadata AS JSON)) AS VARCHAR)) AS j FROM mem)
SELECT id, 'metadata' AS hit FROM rec WHERE contains(j, lower('LANG":"de'))
UNION ALL SELECT id, 'text' FROM rec WHERE contains(j, 'license')""",
    "entity_filter": "SELECT 'doc-' || doc_id AS id, source AS user_id FROM documents WHERE source = 'src2'",
    "listing_cards": f"""WITH {_MEM}
SELECT md5(replace(memory, '<', '&lt;')) AS card_text, user_id AS owner, substr(id, 1, 12) AS short_id,
       coalesce(created_at, '-') AS created,
       CASE WHEN quality IS NULL THEN '' ELSE printf('%.3f', CAST(quality AS DOUBLE)) END AS score_text
FROM mem LEFT JOIN labels USING (doc_id)""",
    "flatten_payload": """SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS memory_md5,
  CASE WHEN doc_id % 3 < 2 THEN source ELSE '' END AS user_id, CAST(NULL AS VARCHAR) AS agent_id,
  CASE WHEN doc_id % 3 = 1 THEN '2020-01-01' ELSE '' END AS created_at,
  CASE doc_id % 3 WHEN 0 THEN '{"lang":"' || lang || '","n_chars":' || n_chars || '}'
       WHEN 2 THEN '{"lang":"' || lang || '"}' ELSE '{}' END AS metadata
FROM documents
UNION ALL SELECT 'empty-' || doc_id, md5(''), source, 'a1', '', '{"agent_id":"a1"}' FROM documents WHERE doc_id % 5 = 3
UNION ALL SELECT 'none-' || doc_id, md5(''), '', NULL, '', '{}' FROM documents WHERE doc_id % 5 = 4""",
    "conversation_memories": """SELECT conv_id, CAST(coalesce(turn // 10000, 0) AS BIGINT) AS part,
  CAST(to_json(list({'role': role, 'content': text} ORDER BY turn)) AS VARCHAR) AS memory, count(*) AS messages
FROM conversations GROUP BY conv_id, part""",
    "validate_facts": _FACT_CHECK,
    "validate_updates": f"""WITH {_REQUESTS}
SELECT request_id,
  CASE WHEN owner IS NULL THEN 'id_required' WHEN stripped IS NULL OR stripped = '' THEN 'empty_content' END AS error_code,
  CASE WHEN owner IS NULL THEN 'memory_id is required.'
       WHEN stripped IS NULL OR stripped = '' THEN 'New content cannot be empty.' END AS message
FROM checked""",
    "validate_queries": f"""WITH {_REQUESTS}
SELECT request_id, 'empty_query' AS error_code, 'Search query cannot be empty.' AS message
FROM checked WHERE stripped IS NULL OR stripped = ''""",
    "validate_ids": """SELECT nullif(event_type, 'error') AS user_id,
  CASE WHEN event_type = 'error' THEN 'id_required' END AS error_code,
  CASE WHEN event_type = 'error' THEN 'user_id is required.' END AS message, count(*) AS n FROM events GROUP BY ALL""",
    "validate_batches": """WITH codes AS (
  SELECT DISTINCT conv_id, CASE conv_id % 9 WHEN 1 THEN 'data_required' WHEN 2 THEN 'invalid_json'
    WHEN 3 THEN 'invalid_json' WHEN 4 THEN 'not_an_array' WHEN 5 THEN 'empty_batch' WHEN 6 THEN 'data_required'
    WHEN 7 THEN 'user_required' WHEN 8 THEN 'user_required' END AS error_code FROM conversations)
SELECT conv_id, error_code, CASE error_code
  WHEN 'data_required' THEN 'data is required (JSON string of memory array).'
  WHEN 'invalid_json' THEN 'data is not valid JSON.'
  WHEN 'not_an_array' THEN 'data must be a JSON array of memory objects.'
  WHEN 'empty_batch' THEN 'memories must be a non-empty array'
  WHEN 'user_required' THEN 'user_id is required' END AS message FROM codes""",
    "short_docs": f"SELECT {_FILE} AS file FROM documents WHERE length({_strip('text')}) >= 50",
    "parse_dates": f"WITH {_DATED} SELECT id, epoch FROM dated",
    "dedup_keys": f"""SELECT doc_id, md5(lower(s)) AS dedup_md5, length(s) AS chars FROM (
  SELECT doc_id, {_strip("chr(12288) || ' ' || chr(28) || text || chr(133) || chr(10)")} AS s FROM documents)""",
    "canonical_models": """SELECT CASE WHEN event_type IN ('click', 'view') THEN 'nomic-ai/nomic-embed-text-v1.5'
  ELSE event_type END AS model, count(*) AS n FROM events GROUP BY 1""",
    "tolerant_numbers": """SELECT event_id,
  CASE WHEN event_type = 'error' THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS as_int,
  CASE WHEN event_type = 'error' THEN -1.0::DOUBLE ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) + 0.5 END AS as_float
FROM events""",
    "chunk_texts": f"""WITH {_packed(500, True)}
SELECT doc_id, len(pieces) AS n_chunks, md5(array_to_string(pieces, chr(1))) AS chunks_md5 FROM packed""",
    "chunk_paragraphs": f"""WITH {_packed(500, False)}
SELECT doc_id, len(pieces) AS n_chunks, md5(array_to_string(pieces, chr(1))) AS chunks_md5 FROM packed""",
    "chunk_profile": _VERBATIM,
    "verbatim_headers": f"""WITH {_REQUESTS},
kept AS (SELECT request_id, trim(content, ' ') AS text, lang, doc_id,
                CASE WHEN lang <> 'en' AND length(trim(content, ' ')) > 500 THEN '[Document: d' || doc_id || ']' ELSE '' END AS head
         FROM checked WHERE stripped <> ''),
{_under('kept', 500)},
tagged AS (SELECT *, length(text) > 500 AS cut, CASE WHEN lang <> 'en' THEN '"file":"d' || doc_id || '","lang":"' || lang || '"' END AS own
           FROM headed)
SELECT request_id, len(pieces) AS n_chunks, md5(array_to_string(pieces, chr(1))) AS chunks_md5,
  md5(array_to_string(list_transform(range(len(pieces)), lambda i: CASE
    WHEN cut THEN '{{' || coalesce(own || ',', '') || '"chunk":"' || (i + 1) || '/' || len(pieces) || '"}}'
    WHEN own IS NULL THEN '' ELSE '{{"lang":"' || lang || '","file":"d' || doc_id || '"}}' END), chr(1))) AS metadata_md5
FROM tagged""",
    "verbatim_rejects": f"""WITH {_REQUESTS}
SELECT request_id, user_id,
  CASE WHEN content IS NULL THEN 'content_required' ELSE 'empty_content' END AS error_code,
  CASE WHEN content IS NULL THEN 'content is required.' ELSE 'Cannot save empty content.' END AS message,
  CASE WHEN content IS NULL THEN 'Send a content value with the text to keep.' ELSE 'Send at least one visible character.' END AS fix
FROM checked WHERE stripped IS NULL OR stripped = ''""",
    "chunk_reports": f"""WITH {_REQUESTS}, {_packed(3000, True)}
SELECT request_id, len(pieces) AS chunks,
       array_to_string(list_transform(range(len(pieces)), lambda i: request_id || '-' || i), ',') AS ids
FROM checked JOIN packed USING (doc_id) WHERE stripped <> ''""",
    "plan_import": f"""WITH {_packed(500, True)}
SELECT {_FILE} AS file, strlen(text) AS n_bytes, len(pieces) AS n_chunks FROM documents JOIN packed USING (doc_id)""",
    "import_documents": f"""WITH
files AS (SELECT doc_id, text, {_FILE} AS file, '[Document: ' || {_FILE} || '][Source: docs_import]' AS head
          FROM documents WHERE length({_strip('text')}) >= 50),
{_under('files', 3000)}
SELECT file, len(pieces) AS n_chunks, md5(array_to_string(pieces, chr(1))) AS chunks_md5,
  md5(array_to_string(list_transform(range(len(pieces)), lambda i:
    '{{"file":"' || file || '","repo":"team","source":"docs_import"'
    || CASE WHEN len(pieces) > 1 THEN ',"chunk":"' || (i + 1) || '/' || len(pieces) || '"' ELSE '' END || '}}'), chr(1))) AS metadata_md5
FROM headed""",
    "rechunk_documents": f"""SELECT {_FILE} AS file, true AS within_limit
FROM documents WHERE length({_strip('text')}) >= 50""",
    "document_report": f"""SELECT count(*) FILTER (n >= 50) AS imported, CAST(0 AS BIGINT) AS failed,
  count(*) FILTER (n < 50) AS skipped, count(*) AS total FROM (SELECT length({_strip('text')}) AS n FROM documents)""",
    "import_new_rows": _NEW_ROWS,
    "import_rejects": f"""WITH {_ITEMS}
SELECT pos, CASE WHEN message LIKE 'Non%' THEN 'not_an_object' ELSE 'empty_text' END AS error_code, message
FROM items WHERE message IS NOT NULL""",
    "import_report": f"""WITH {_ITEMS},
kinds AS (SELECT message, count(*) AS n FROM items WHERE message IS NOT NULL GROUP BY message)
SELECT 'team' AS user_id, (SELECT count(*) FROM fresh) AS imported,
  (SELECT count(*) FROM valid) - (SELECT count(*) FROM fresh) AS skipped,
  (SELECT CAST(sum(n) AS BIGINT) FROM kinds) AS failed,
  (SELECT string_agg(message || ' x' || n, '; ' ORDER BY message) FROM kinds) AS errors""",
    "import_status": f"""WITH {_ITEMS}
SELECT pos, CASE WHEN message IS NOT NULL THEN 'failed' WHEN pos IN (SELECT pos FROM fresh) THEN 'imported'
  ELSE 'skipped' END AS status FROM items""",
    "import_array": """SELECT CAST(conv_id AS VARCHAR) AS user_id,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, 'dict' AS item_type, md5(text) AS memory_md5
FROM conversations""",
    "union_store": f"""WITH {_ITEMS},
good AS (SELECT count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
SELECT 'team' AS user_id, (SELECT n FROM good) + (SELECT count(*) FROM fresh) AS n, (SELECT n FROM good) AS kept""",
    "update_text": f"""WITH {_UPDATES}
SELECT id, user_id, md5(CASE WHEN trim(content) <> '' THEN content ELSE memory END) AS memory_md5
FROM mem LEFT JOIN updates ON memory_id = id""",
    "update_rejects": f"""WITH {_UPDATES}
SELECT memory_id, CASE WHEN trim(content) = '' THEN 'empty_content' ELSE 'unknown_id' END AS error_code,
  CASE WHEN trim(content) = '' THEN 'New content cannot be empty.'
       ELSE 'Failed to update memory ''' || memory_id || '''.' END AS message
FROM updates WHERE trim(content) = '' OR memory_id NOT IN (SELECT id FROM mem)""",
    "delete_ids": f"""WITH {_UPDATES}
SELECT id, user_id FROM mem WHERE id NOT IN (SELECT memory_id FROM updates)""",
    "delete_rejects": f"""WITH {_UPDATES}
SELECT memory_id, 'unknown_id' AS error_code, 'Failed to delete memory ''' || memory_id || '''.' AS message
FROM updates WHERE memory_id NOT IN (SELECT id FROM mem)""",
    "delete_namespace": "SELECT 'doc-' || doc_id AS id, source AS user_id FROM documents WHERE source IS DISTINCT FROM 'src4'",
    "delete_entity": "SELECT 'doc-' || doc_id AS id, source AS user_id FROM documents WHERE source <> 'src2'",
    "add_facts": f"""WITH {_REQUESTS}
SELECT request_id, user_id, md5(content) AS memory_md5,
       CASE WHEN lang <> 'en' THEN '{{"lang":"' || lang || '","file":"d' || doc_id || '"}}' END AS metadata
FROM checked WHERE stripped <> '' AND length(stripped) <= 3000""",
    "update_then_search": f"""WITH {_MEM},
changed AS (SELECT 'doc-' || doc_id AS id, 'quality ' || quality AS content FROM labels WHERE toxic <> 1),
stored AS (SELECT mem.id, coalesce(content, memory) AS memory FROM mem LEFT JOIN changed USING (id)),
vec AS (SELECT id, [CAST(length(memory) AS DOUBLE), length(memory) - length(replace(memory, ' ', '')),
                    length(memory) - length(replace(memory, 'e', '')), 1.0] AS v FROM stored),
asked AS (SELECT item_id AS query_id, [CAST(length(text) AS DOUBLE), length(text) - length(replace(text, ' ', '')),
                    length(text) - length(replace(text, 'e', '')), 1.0] AS q FROM benchmark),
scored AS (SELECT query_id, id, round(list_cosine_similarity(v, q), 12) AS s FROM vec CROSS JOIN asked)
SELECT query_id, rank, id, round(s, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM scored) WHERE rank <= 5""",
    "delete_namespaces": """SELECT 'doc-' || doc_id AS id, source AS user_id FROM documents WHERE source NOT IN (
  SELECT source FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source HAVING avg(quality) < 0.85)""",
    "prune_dry_run": f"""WITH {_DATED}
SELECT count(*) AS would_delete, CAST(0 AS BIGINT) AS deleted, true AS dry_run FROM dated WHERE epoch < {_CUTOFF}""",
    "prune_candidates": f"""WITH {_DATED}
SELECT id, md5(substr(memory, 1, 200)) AS preview_md5, created_at FROM dated WHERE epoch < {_CUTOFF}""",
    "prune_apply": f"""WITH {_DATED}
SELECT id, user_id FROM dated WHERE epoch IS NULL OR epoch >= {_CUTOFF}""",
    "prune_min_score": f"""WITH {_DATED}
SELECT id FROM dated LEFT JOIN labels USING (doc_id)
WHERE NOT coalesce(epoch < {_CUTOFF} AND quality < 0.5, false)""",
    "export_records": f"""WITH {_MEM}
SELECT id, md5(memory) AS memory, metadata, coalesce(created_at, '') AS created_at, user_id FROM mem""",
    "export_csv_lines": f"WITH {_MEM}, {_CSV} SELECT md5(line) AS line_md5, length(line) AS chars FROM lines",
    "export_csv_file": f"""WITH {_MEM}
SELECT id, md5(memory) AS memory_md5, metadata, coalesce(created_at, '') AS created_at, user_id FROM mem
UNION ALL SELECT 'id', md5('memory'), 'metadata', 'created_at', 'user_id'""",
    "export_csv_quoted": f"""WITH {_MEM}
SELECT md5('"' || id || '","' || replace(memory, '"', '""') || '","' || replace(metadata, '"', '""') || '","'
  || coalesce(created_at, '') || '","' || user_id || '"') AS line_md5 FROM mem""",
    "export_manifest": "SELECT source AS user_id, count(*) AS count FROM documents GROUP BY source",
    "stored_namespace": f"""WITH {_MEM}
SELECT id, md5(memory) AS memory_md5, created_at FROM mem WHERE user_id = 'src6'""",
    "snapshot_after_prune": f"""WITH {_DATED}
SELECT id, user_id FROM dated WHERE epoch IS NULL OR epoch >= {_CUTOFF}""",
    "export_round_trip": f"""WITH k AS (SELECT lower({_strip('text')}) AS k FROM documents),
n AS (SELECT count(*) FILTER (k <> '') AS valid, count(*) FILTER (k = '') AS failed,
             count(DISTINCT k) FILTER (k <> '') AS keys FROM k)
SELECT 'first' AS run, keys AS imported, valid - keys AS skipped, failed FROM n
UNION ALL SELECT 'second', 0, valid, failed FROM n""",
    "import_csv": f"""WITH {_MEM}
SELECT md5(memory) AS memory_md5, 'dict' AS item_type, metadata FROM mem""",
    "csv_round_trip": f"""WITH {_MEM}
SELECT md5(memory) AS memory_md5, 'dict' AS item_type, metadata FROM mem""",
    "import_json_files": "SELECT 'dict' AS item_type, md5(nullif(text, '')) AS memory_md5 FROM conversations",
    "import_ids_unique": f"SELECT pos, 1::BIGINT AS ids, 2::BIGINT AS runs FROM ({_NEW_ROWS})",
    "prune_legacy_ids": f"""WITH {_DATED}
SELECT id, user_id FROM dated WHERE epoch IS NULL OR epoch >= {_CUTOFF}""",
    "audit_dims": """WITH a AS (
  SELECT 'records' AS collection, len(embedding) AS dim FROM embeddings
  UNION ALL SELECT 'migrations', CASE WHEN label % 2 = 1 THEN 32 ELSE len(embedding) END FROM embeddings)
SELECT collection, dim, count(*) AS n_rows, CASE WHEN dim = 64 THEN 'ok' ELSE 'mismatch' END AS status,
  collection || CASE WHEN dim = 64 THEN ' OK (' ELSE ' mismatch (was ' END || dim || ')' AS action
FROM a GROUP BY collection, dim""",
    "audit_strict": """SELECT 'cut' AS collection, 'embedder needs 64: ' || count(*) ||
  ' rows of 1 other sizes in 1 collections, first ''cut''; audit_dims lists them all' AS refusal FROM embeddings WHERE label % 2 = 1
UNION ALL SELECT 'whole', NULL""",
    "audit_settings": """SELECT label, CASE WHEN label % 5 < 2 THEN max(len(embedding)) ELSE 0 END AS dims
FROM embeddings GROUP BY label""",
    "markdown_files": """WITH g AS (
  SELECT doc_id // 50 AS k, string_agg('# ' || doc_id || chr(10) || md5(text), chr(10) ORDER BY doc_id) AS body,
         count(*) AS n FROM documents GROUP BY k),
f AS (SELECT CASE k % 6 WHEN 0 THEN 'a/' WHEN 1 THEN 'node_modules/' WHEN 2 THEN 'b/.hidden/' WHEN 3 THEN 'b/_own/' ELSE '' END
             || CASE k % 5 WHEN 0 THEN '.' WHEN 1 THEN '_' ELSE 'f' END || k || CASE k % 7 WHEN 0 THEN '.txt' ELSE '.md' END AS file,
             body, n FROM g)
SELECT file, length(body) + 2 * n - 1 AS n_bytes, md5(body) AS text_md5 FROM f
WHERE file LIKE '%.md' AND file NOT LIKE 'node_modules/%'""",
    "audit_drop": "SELECT vec_id, label FROM embeddings WHERE label % 2 = 0",
    "stream_ingest": _VERBATIM,
    "stream_rejects": f"SELECT * FROM ({_FACT_CHECK}) WHERE error_code IS NOT NULL",
    "stream_import": _NEW_ROWS,
}
