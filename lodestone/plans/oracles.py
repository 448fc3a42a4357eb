"""The same queries in SQL, for DuckDB on the same tables."""

from __future__ import annotations

from lodestone.plans.queries import API, DIRECTIVES, EDGES, FRONT, INDEX, MEMBERS
from lodestone.plans.queries import _LITERAL as LITERAL


def values(rows) -> str:
    def lit(x):
        return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


WORD = r"[\p{L}\p{N}_]+"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
#: Lines by splitting at each end, each trimmed by its characters.
ENDS = "chr(11) chr(12) chr(13) chr(28) chr(29) chr(30) chr(133) chr(8232) chr(8233)".split()
ALL_SPACE = " || ".join(f"chr({c})" for c in [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])
LINES = "{0}"
for _end in ("chr(13) || chr(10)", *ENDS):
    LINES = f"replace({LINES}, {_end}, chr(10))"
TIDY = f"trim(regexp_replace(array_to_string(list_transform(string_split({LINES}, chr(10)), lambda line: rtrim(line, {ALL_SPACE})), chr(10)), '\\n{{{{3,}}}}', chr(10) || chr(10), 'g'), {ALL_SPACE})"
NORMAL = TIDY
ANSWER = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower({0}), '’', ''''), '\[\d+\]', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s'']', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
UNESCAPE = "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace({0}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', chr(160)), '&#39;', ''''), '&#124;', '|'), '&#8230;', '…'), '&amp;', '&')"
TAGS = r"regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script\b[^>]*>.*?</script>', '', 'g'), '(?is)<style\b[^>]*>.*?</style>', '', 'g'), '<[^>]+>', '', 'g')"

BM25 = f"""words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT doc_id, len(regexp_extract_all(lower(text), '{WORD}')) AS doc_len FROM documents),
st AS (SELECT count(*) AS n, avg(doc_len) AS avg_len FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, df, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1::DOUBLE) AS idf FROM df, st),
w AS (SELECT tf.doc_id, tf.term, idf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len)) AS w FROM tf JOIN idf USING (term) JOIN len USING (doc_id), st)"""
SCORED = f"""asked AS (SELECT query_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM q),
qtf AS (SELECT query_id, term, count(*) AS qtf FROM asked GROUP BY ALL),
scored AS (SELECT query_id, doc_id, sum(qtf * w) AS score FROM qtf JOIN w USING (term) GROUP BY ALL)"""
BENCH = "q AS (SELECT item_id AS query_id, text FROM benchmark)"
LIT = f"q AS (SELECT * FROM {values(LITERAL)} t(query_id, text))"
FULL = "SELECT q.query_id, doc_id, coalesce(score, 0) AS score FROM q CROSS JOIN documents LEFT JOIN scored USING (query_id, doc_id)"
RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ({FULL}))"
TOP5 = "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 5"

#: Token windows of whole documents: 500 tokens, 400 apart.
PARTS = r"""pieces AS (SELECT doc_id, unnest(regexp_extract_all(text, '\s*\S+')) AS p, generate_subscripts(regexp_extract_all(text, '\s*\S+'), 1) AS i FROM t),
ends AS (SELECT doc_id, i, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS e, length(regexp_replace(p, '^\s+', '')) AS tl FROM pieces),
toks AS (SELECT doc_id, i - 1 AS tok, (e - tl)::BIGINT AS s, e::BIGINT AS e FROM ends),
n AS (SELECT t.doc_id, length(text) AS chars, len(regexp_extract_all(text, '\S+')) AS n FROM t),
parts AS (SELECT doc_id, n, chars, unnest(generate_series(0, CASE WHEN n <= 500 THEN 0 ELSE ceil((n - 500) / 400.0)::INT END)) AS part FROM n),
spans AS (SELECT doc_id, part, any_value(n) AS n_doc, CASE WHEN any_value(n) <= 500 THEN 0 ELSE min(s) END AS char_start, CASE WHEN any_value(n) <= 500 THEN any_value(chars) ELSE max(toks.e) END AS char_end, count(toks.tok) AS n_tokens
          FROM parts LEFT JOIN toks USING (doc_id) WHERE tok IS NULL OR (tok >= part * 400 AND tok < part * 400 + 500) GROUP BY doc_id, part)"""
DOCS = "t AS (SELECT doc_id, text FROM documents)"
#: Windows of at most 1,000 covered tokens, packed from the last chunk backwards, with 1,300 tokens of context.
PACKED = """r AS (SELECT doc_id, part, doc_id || '#' || printf('%03d', part) AS cid, part * 400 AS ts, least(part * 400 + 500, n_doc) AS te FROM spans WHERE n_tokens > 0),
 last_ AS (SELECT doc_id, max(part) AS part FROM r GROUP BY doc_id),
 walk AS (SELECT doc_id, part, 0 AS win, te AS we, ts, cid FROM r JOIN last_ USING (doc_id, part)
  UNION ALL SELECT r.doc_id, r.part, CASE WHEN walk.we - r.ts <= 1000 THEN win ELSE win + 1 END, CASE WHEN walk.we - r.ts <= 1000 THEN walk.we ELSE r.te END, r.ts, r.cid FROM walk JOIN r ON r.doc_id = walk.doc_id AND r.part = walk.part - 1),
 g AS (SELECT doc_id, win, any_value(we) AS we, min(ts) AS ts, string_agg(cid, ',' ORDER BY part) AS owned, count(*) AS n FROM walk GROUP BY doc_id, win),
packed AS (SELECT doc_id, max(win) OVER (PARTITION BY doc_id) - win AS window, owned, n, least(ts, greatest(0, we - 1300)) AS context_start, we AS window_end FROM g)"""

MD = "md AS (SELECT page_id AS doc_id, " + TAGS.format(r"regexp_replace(regexp_replace(html, '<h1[^>]*>', chr(10) || '# ', 'g'), '<p[^>]*>', chr(10) || '## ', 'g')") + " AS text FROM pages)"
HEAD = r"(?m)^(#{1,6})\s+(.+?)\s*$"
SECTIONS = rf"""{MD},
found AS (SELECT doc_id, length(text) AS size, regexp_extract_all(text, '{HEAD}') AS m, regexp_extract_all(text, '{HEAD}', 1) AS marks, regexp_extract_all(text, '{HEAD}', 2) AS titles, regexp_split_to_array(text, '{HEAD}') AS gaps FROM md),
each_ AS (SELECT doc_id, size, unnest(m) AS m, unnest(marks) AS mark, unnest(titles) AS title, unnest(gaps[1:len(m)]) AS gap, unnest(generate_series(1, len(m))) AS i FROM found WHERE len(m) > 0),
starts AS (SELECT doc_id, size, i, length(mark) AS level, title AS heading, (sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m))::BIGINT AS s FROM each_),
secs AS (SELECT doc_id, level, heading, s AS char_start, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY i), size) AS char_end FROM starts
  UNION ALL SELECT doc_id, 0, 'Introduction', 0, length(gaps[1]) FROM found WHERE len(m) > 0 AND regexp_matches(gaps[1], '\S')
  UNION ALL SELECT doc_id, 0, 'Document', 0, size FROM found WHERE len(m) = 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY char_start) - 1 AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM secs)"""

VQ = "vq AS (SELECT vec_id AS query_id, embedding AS qvec, label AS qlabel FROM embeddings WHERE vec_id % 50 = 0)"
IP = f"{VQ}, ip AS (SELECT query_id, qlabel, vec_id AS item, label, list_dot_product(embedding::DOUBLE[], qvec::DOUBLE[]) AS score FROM embeddings, vq)"
DENSE_RANKED = f"{IP}, dranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) AS rank FROM ip WHERE item <> query_id)"


def metrics(ranks: str) -> str:
    """ranks: (query_id, rank) of the gold items."""
    return f"""per AS (SELECT query_id, count(*) AS n_gold, min(rank) AS first_relevant_rank, count(*) FILTER (rank <= 5) AS hits, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 5), 0) AS gain FROM ({ranks}) GROUP BY query_id),
m AS (SELECT query_id, n_gold, first_relevant_rank, hits / 5.0::DOUBLE AS precision, hits / n_gold::DOUBLE AS recall, coalesce(1 / first_relevant_rank::DOUBLE, 0) AS reciprocal_rank,
      gain / list_sum(list_transform(generate_series(1, least(n_gold, 5)), lambda i: 1 / log2(i + 1))) AS ndcg FROM per)"""


MROUND = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg"

QA = """qa AS (SELECT a.conv_id * 1000 + a.turn AS id, a.conv_id, a.turn, u.text AS asked, a.text AS reference,
 CASE a.conv_id % 5 WHEN 0 THEN 'I don''t know' WHEN 1 THEN a.text || ' [1] [7]' WHEN 2 THEN a.text || ' [2] [1, 2]' WHEN 3 THEN 'See [1] [2]. ' || u.text ELSE a.text END AS said
 FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant' AND u.role = 'user')"""
F1 = f"""nrm AS (SELECT id, {ANSWER.format('said')} AS p, {ANSWER.format('reference')} AS r FROM qa),
tok AS (SELECT id, p, r, CASE WHEN p = '' THEN [] ELSE string_split(p, ' ') END AS pt, CASE WHEN r = '' THEN [] ELSE string_split(r, ' ') END AS rt FROM nrm),
pc AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(pt) AS t FROM tok) GROUP BY ALL),
rc AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(rt) AS t FROM tok) GROUP BY ALL),
ov AS (SELECT id, sum(least(pc.n, rc.n)) AS o FROM pc JOIN rc USING (id, t) GROUP BY id),
f1 AS (SELECT id, p = r AS em, CASE WHEN len(pt) + len(rt) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(o, 0) / (len(pt) + len(rt)) END AS f1 FROM tok LEFT JOIN ov USING (id))"""
CITED = r"list_distinct(list_transform(list_filter(regexp_extract_all(said, '\[(\d+)\]', 1), lambda s: length(ltrim(s, '0')) <= 9), lambda s: s::INT))"
EVAL = rf"""{QA}, {F1},
base AS (SELECT id, conv_id, turn, said, {CITED} AS nums, conv_id % 4 = 0 AS unans,
  CASE turn % 3 WHEN 0 THEN 'naive' WHEN 1 THEN 'rag_bm25' ELSE 'rag_dense' END AS arm, CASE turn % 3 WHEN 0 THEN 0 ELSE 3 END AS k,
  CASE conv_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['c' || ((conv_id + 1) % 7)] ELSE ['c' || ((conv_id + 2) % 7), 'c0'] END AS gold FROM qa),
lists AS (SELECT *, list_transform(generate_series(1, k), lambda n: 'c' || ((conv_id + n) % 7)) AS retrieved, list_transform(list_filter(generate_series(1, k), lambda n: list_contains(nums, n)), lambda n: 'c' || ((conv_id + n) % 7)) AS cited,
  list_sort(list_filter(nums, lambda n: n < 1 OR n > k)) AS invalid, regexp_replace(said, '^\s+|\s+$', '', 'g') = 'I don''t know' AS refused FROM base),
flags AS (SELECT *, arm <> 'naive' AS rag, NOT unans AND len(list_filter(gold, lambda g: NOT list_contains(retrieved, g))) = 0 AS supported, len(list_filter(list_distinct(cited), lambda c: list_contains(gold, c))) AS both_ FROM lists),
ev AS (SELECT id::VARCHAR AS answer_id, arm, CASE WHEN unans THEN 'unanswerable' WHEN conv_id % 4 = 1 THEN 'factoid' ELSE 'multi-hop' END AS question_type, em AS exact_match, f1 AS token_f1, refused AS is_exact_refusal, unans AS is_unanswerable,
  CASE WHEN rag THEN supported END AS context_has_all_gold, CASE WHEN rag THEN NOT supported END AS expected_refusal, CASE WHEN rag THEN refused = (NOT supported) END AS support_gate_correct,
  CASE WHEN rag THEN NOT supported AND NOT refused END AS unsupported_answer, CASE WHEN rag THEN supported AND refused END AS supported_refusal,
  len(cited) > 0 AND len(invalid) = 0 AS has_valid_inline_citation, array_to_string(invalid, ',') AS invalid_citation_numbers,
  CASE WHEN len(cited) > 0 THEN both_ / len(list_distinct(cited))::DOUBLE ELSE 0 END AS citation_precision, CASE WHEN len(gold) > 0 THEN both_ / len(list_distinct(gold))::DOUBLE ELSE 0 END AS citation_recall
  FROM flags JOIN f1 USING (id))"""

REVIEW = """rv AS (SELECT doc_id::VARCHAR AS answer_id, doc_id // 3 AS question_id, ['naive', 'rag_bm25', 'rag_dense'][(doc_id % 3 + 1)::INT] AS arm, CASE WHEN doc_id % 6 < 3 THEN 'factoid' ELSE 'multi-hop' END AS question_type,
 (quality + (doc_id % 5 = 0)::INT)::VARCHAR AS correctness, CASE WHEN doc_id % 41 = 0 THEN '3' WHEN doc_id % 43 = 0 THEN '1.5' ELSE toxic::VARCHAR END AS groundedness, (quality * 2)::VARCHAR AS completeness FROM labels)"""
SOUND = REVIEW + ", ok AS (SELECT arm, question_id, question_type, correctness::INT AS c, groundedness::INT AS g, completeness::INT AS f FROM rv WHERE groundedness IN ('0', '1', '2'))"
_WIDE = ", ".join(f"max({x}) FILTER (arm = '{a}') AS {n}_{full}_0_to_2" for a, n in (("naive", "naive"), ("rag_bm25", "bm25"), ("rag_dense", "dense")) for x, full in (("c", "correctness"), ("g", "groundedness"), ("f", "completeness")))
DIAG = f"""{SOUND}, wide AS (SELECT question_id, question_type, {_WIDE} FROM ok GROUP BY ALL),
diag AS (SELECT *, CASE WHEN naive_correctness_0_to_2 = 2 AND naive_completeness_0_to_2 = 2 THEN 'fully correct' WHEN naive_correctness_0_to_2 = 1 THEN 'partially correct' ELSE 'incorrect' END AS naive_status,
 greatest(bm25_correctness_0_to_2, dense_correctness_0_to_2) AS best_rag_score, CASE WHEN dense_correctness_0_to_2 > bm25_correctness_0_to_2 THEN 'dense' WHEN bm25_correctness_0_to_2 > dense_correctness_0_to_2 THEN 'bm25' ELSE 'tie' END AS best_rag_system,
 greatest(bm25_correctness_0_to_2, dense_correctness_0_to_2) > naive_correctness_0_to_2 AS retrieval_improved_answer FROM wide)"""


def mean(x: str, where: str = "") -> str:
    return f"round(coalesce(avg({x}){f' FILTER ({where})' if where else ''}, 0), 6)"


def _rag(x: str) -> str:
    return f"CASE WHEN starts_with(arm, 'rag_') THEN {x} END"


AGGREGATE = f"""WITH {EVAL} SELECT arm, count(*) AS count, {mean('exact_match::INT')} AS exact_match, {mean('token_f1')} AS mean_token_f1, {mean('token_f1', 'NOT is_unanswerable')} AS answerable_mean_token_f1,
 {mean('is_exact_refusal::INT', 'is_unanswerable')} AS unanswerable_exact_refusal_accuracy, count(*) FILTER (is_exact_refusal) AS exact_refusal_count,
 {_rag("count(*) FILTER (context_has_all_gold)")} AS context_supported_count, {_rag("count(*) FILTER (NOT context_has_all_gold)")} AS context_unsupported_count, {_rag(mean('support_gate_correct::INT'))} AS support_gate_accuracy,
 {_rag(mean('(NOT is_exact_refusal)::INT', 'context_has_all_gold'))} AS supported_answer_rate, {_rag(mean('is_exact_refusal::INT', 'NOT context_has_all_gold'))} AS unsupported_refusal_rate, {_rag(mean('unsupported_answer::INT'))} AS unsupported_answer_rate,
 {_rag(mean('supported_refusal::INT'))} AS supported_refusal_rate, {_rag(mean('has_valid_inline_citation::INT', 'NOT is_exact_refusal'))} AS non_refusal_inline_citation_rate, {_rag(mean('citation_precision', 'NOT is_exact_refusal'))} AS mean_citation_precision,
 {_rag(mean('citation_recall', 'NOT is_unanswerable'))} AS mean_citation_recall, {_rag("count(*) FILTER (invalid_citation_numbers <> '')")} AS invalid_citation_answer_count FROM ev GROUP BY arm"""

DIR = r"\{\{(?s:.*?)\}\}"
DIRECTIVE = rf"""d AS (SELECT * FROM {values(DIRECTIVES)} t(doc_id, url, text)), ix AS (SELECT * FROM {values(INDEX)} t(url, flat_name)),
dm AS (SELECT doc_id, url, unnest(regexp_extract_all(text, '{DIR}')) AS m, unnest(generate_series(0, len(regexp_extract_all(text, '{DIR}')) - 1)) AS n FROM d WHERE len(regexp_extract_all(text, '{DIR}')) > 0),
dj AS (SELECT *, CASE WHEN json_valid(m[2:-2]) THEN nullif(json_extract_string(m[2:-2], '$.demo'), '') END AS ref FROM dm),
dp AS (SELECT *, CASE WHEN starts_with(ref, '../') THEN regexp_replace(url, '[^/]*/[^/]*$', '') || ref[4:] ELSE regexp_replace(url, '[^/]*$', '') || ref END AS path FROM dj WHERE ref IS NOT NULL),
dt AS (SELECT doc_id, n, ref, unnest([path, regexp_replace(path, '\.[^./]*$', '') || '.js', regexp_replace(path, '\.[^./]*$', '') || '.tsx', regexp_replace(path, '\.[^./]*$', '') || '.jsx', regexp_replace(path, '\.[^./]*$', '') || '.ts']) AS try, unnest([0, 1, 2, 3, 4]) AS pr FROM dp),
dr AS (SELECT doc_id, n, any_value(ref) AS ref, arg_min(flat_name, pr) AS demo_id FROM dt LEFT JOIN ix ON try = ix.url GROUP BY doc_id, n)"""

ORACLE_SQL = {
    "bm25_postings": f"WITH {BM25} SELECT doc_id, term, tf FROM tf",
    "bm25_doc_freq": f"WITH {BM25} SELECT term, df FROM df",
    "bm25_doc_len": f"WITH {BM25} SELECT doc_id, doc_len FROM len",
    "bm25_stats": f"WITH {BM25} SELECT n AS n_docs, round(avg_len, 6) AS avg_len, (SELECT count(*) FROM df) AS n_terms FROM st",
    "bm25_idf": f"WITH {BM25} SELECT term, round(idf, 9) AS idf FROM idf",
    "bm25_scores": f"WITH {BM25}, {BENCH}, {SCORED} SELECT query_id, doc_id, round(score, 6) AS score FROM scored",
    "bm25_index_search": f"WITH {BM25}, {BENCH}, {SCORED}, {RANKED} {TOP5}",
    "bm25_top5": f"WITH {BM25}, {BENCH}, {SCORED}, {RANKED} {TOP5}",
    "bm25_top5_zero_pad": f"WITH {BM25}, {LIT}, {SCORED}, {RANKED} {TOP5}",
    "bm25_dup_query_terms": f"WITH {BM25}, {LIT}, {SCORED} SELECT query_id, doc_id, round(score, 6) AS score FROM scored WHERE query_id IN (3, 4, 6)",
    "chunk_split": f"WITH {DOCS}, {PARTS} SELECT doc_id, part, char_start, char_end, n_tokens FROM spans",
    "chunk_ids": rf"""WITH t AS (SELECT doc_id, {NORMAL.format('text')} AS text FROM documents WHERE regexp_matches(text, '\S')), {PARTS}
 SELECT 'prose__' || doc_id || '__chunk_0001' || CASE WHEN n_doc > 500 THEN printf('__part_%03d', part + 1) ELSE '' END AS chunk_id, 'prose__' || doc_id AS doc_id, n_tokens AS token_count, char_start, char_end,
 md5({NORMAL.format("substr(text, (char_start + 1)::BIGINT, (char_end - char_start)::BIGINT)")}) AS text_md5, 'Document' AS headings, CASE WHEN n_doc > 500 THEN part + 1 END AS split_index FROM spans JOIN t USING (doc_id)""",
    "chunk_stats": rf"""WITH t AS (SELECT doc_id, {NORMAL.format('text')} AS text FROM documents WHERE regexp_matches(text, '\S')), {PARTS}
 SELECT count(*) AS chunks, count(*) AS prose, 0 AS api, count(*) FILTER (n_doc > 500) AS split_parts, 0 AS oversized_api, min(n_tokens) AS min_tokens, max(n_tokens) AS max_tokens, round(avg(n_tokens), 6) AS avg_tokens FROM spans""",
    "chunk_validate": r"""WITH c AS (SELECT source || '-' || n_chars AS chunk_id, text, len(regexp_extract_all(text, '\S+')) AS n FROM documents)
 SELECT 'duplicate' AS problem, chunk_id FROM c GROUP BY chunk_id HAVING count(*) > 1 UNION ALL SELECT 'blank', chunk_id FROM c WHERE NOT regexp_matches(text, '\S') UNION ALL SELECT 'oversized', chunk_id FROM c WHERE n > 500 UNION ALL SELECT 'bad span', chunk_id FROM c WHERE length(text) = 0""",
    "heading_sections": f"WITH {SECTIONS} SELECT doc_id, n, level, heading, char_start, char_end FROM numbered",
    "heading_pair_chunks": rf"""WITH {SECTIONS}, pr AS (SELECT doc_id, n, total, CASE WHEN total = 1 THEN heading ELSE heading || '|' || lead(heading) OVER w END AS headings, char_start, CASE WHEN total = 1 THEN char_end ELSE lead(char_end) OVER w END AS char_end FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
 full_ AS (SELECT pr.* FROM pr JOIN md USING (doc_id) WHERE char_end IS NOT NULL AND regexp_matches(regexp_replace(substr(text, char_start + 1, char_end - char_start), '(?m)^#{{1,6}}\s+.*$', '', 'g'), '\S'))
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS chunk_index, headings, char_start, char_end FROM full_""",
    "demo_claim": f"""WITH {DOCS}, {PARTS}, mk AS (SELECT doc_id, length(text) * i // 7 AS pos, 'd' || (i % 3) AS demo_id FROM documents, generate_series(1, 7) g(i)),
 hit AS (SELECT doc_id, part, demo_id, min(pos) AS pos FROM spans JOIN mk USING (doc_id) WHERE pos >= char_start AND pos < char_end GROUP BY ALL)
 SELECT doc_id || '#' || part AS chunk_id, coalesce(string_agg(demo_id, ',' ORDER BY pos, demo_id), '') AS demo_refs FROM spans LEFT JOIN hit USING (doc_id, part) GROUP BY doc_id, part""",
    "strip_html": f"SELECT page_id, {TIDY.format(UNESCAPE.format(TAGS.format('html')))} AS plain FROM (SELECT page_id, html FROM pages UNION ALL SELECT * FROM {values(EDGES)} t(page_id, html))",
    "html_unescape": f"SELECT page_id, {UNESCAPE.format('html')} AS plain FROM pages",
    "normalize_text": f"SELECT doc_id, md5({NORMAL.format('text')}) AS normal_md5, md5({ANSWER.format('text')}) AS answer_md5 FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {values(EDGES)} t(doc_id, text))",
    "ws_token_count": r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n_tokens FROM documents",
    "preview_text": "SELECT doc_id, replace(substr(text, 1, 300), chr(10), ' ') AS preview FROM documents",
    "event_props": "SELECT event_id, unnest(json_keys(props)) AS prop, json_extract_string(props, '$.' || unnest(json_keys(props))) AS prop_value FROM events",
    "frontmatter": rf"""WITH d AS (SELECT * FROM {values(FRONT)} t(id, raw)), b AS (SELECT id, raw, regexp_extract(raw, '^---\s*\n((?s:.*?)\n)---\s*\n?', 1) AS block FROM d),
 v AS (SELECT id, raw, nullif(trim(regexp_extract(block, '(?m)^title\s*:\s*(.*)$', 1)), '') AS title, nullif(trim(regexp_extract(block, '(?m)^components\s*:\s*(.*)$', 1)), '') AS component FROM b)
 SELECT id, regexp_replace(title, '^''(.*)''$', '\1') AS title, component, regexp_replace(raw, '^---\s*\n((?s:.*?)\n)---\s*\n?', '') AS body FROM v""",
    "api_flatten": rf"""WITH d AS (SELECT * FROM {values(API)} t(id, raw)), p AS (SELECT id, unnest(json_keys(raw, '$.props')) AS k, unnest(generate_series(1, len(json_keys(raw, '$.props')))) AS i, raw FROM d WHERE len(json_keys(raw, '$.props')) > 0),
 s AS (SELECT id, i, k, coalesce(nullif(json_extract_string(raw, '$.props.' || k || '.type.description'), ''), nullif(json_extract_string(raw, '$.props.' || k || '.type.name'), ''), 'unspecified') AS ty, json_extract_string(raw, '$.props.' || k || '.default') AS df, coalesce(json_extract_string(raw, '$.props.' || k || '.description'), '') AS ds FROM p),
 c AS (SELECT id, i, k, df, trim(regexp_replace(regexp_replace({UNESCAPE.format('ty')}, '<br>', ' ', 'g'), '[\s\x{{a0}}]+', ' ', 'g')) AS ty, trim(regexp_replace(regexp_replace({UNESCAPE.format('ds')}, '<br>', ' ', 'g'), '[\s\x{{a0}}]+', ' ', 'g')) AS ds FROM s),
 l AS (SELECT id, i, 'Prop `' || k || '`: type ' || ty || '.' || coalesce(' Default: ' || df || '.', '') || CASE WHEN ds <> '' THEN ' ' || ds ELSE '' END AS line FROM c)
 SELECT d.id, coalesce(json_extract_string(raw, '$.name'), 'Unknown component') || ' component API reference.' || coalesce((SELECT string_agg(chr(10) || line, '' ORDER BY i) FROM l WHERE l.id = d.id), '') AS flat FROM d""",
    "directives": rf"""WITH {DIRECTIVE}, g AS (SELECT doc_id, unnest(regexp_split_to_array(text, '{DIR}')) AS gap, unnest(generate_series(0, len(regexp_split_to_array(text, '{DIR}')) - 1)) AS n FROM d),
 r AS (SELECT doc_id, string_agg(gap || coalesce(chr(10) || chr(10) || '[[DEMO:' || demo_id || ']]' || chr(10) || chr(10), ''), '' ORDER BY n) AS text FROM g LEFT JOIN dr USING (doc_id, n) GROUP BY doc_id)
 SELECT doc_id, regexp_replace(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM r""",
    "directive_refs": f"WITH {DIRECTIVE} SELECT doc_id, n, ref, demo_id FROM dr",
    "classify_members": rf"""WITH d AS (SELECT * FROM {values([(m,) for m in MEMBERS])} t(member)), e AS (SELECT member, lower(regexp_extract(member, '\.[^./]*$')) AS ext FROM d)
 SELECT member, CASE WHEN kind IS NOT NULL THEN split_part(member, sub, 2) END AS rel, kind AS doc_type FROM (SELECT member, CASE WHEN contains(member, '/docs/data/material/') THEN '/docs/data/material/' ELSE '/docs/pages/material-ui/api/' END AS sub,
 CASE WHEN contains(member, '/docs/data/material/') AND ext = '.md' THEN 'prose' WHEN contains(member, '/docs/pages/material-ui/api/') AND ext = '.json' THEN 'api' WHEN (contains(member, '/docs/data/material/') OR contains(member, '/docs/pages/material-ui/api/')) AND ext IN ('.js', '.tsx') THEN 'demo' END AS kind FROM e)""",
    "dense_top5": f"WITH {IP}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) AS rank FROM ip) SELECT query_id, rank, item, round(score, 6) AS score FROM r WHERE rank <= 5",
    "dense_exact_ip": f"WITH {IP} SELECT query_id, item, round(score, 6) AS score FROM ip",
    "late_pool": """WITH v AS (SELECT vec_id // 10 AS doc_id, vec_id % 10 * 5 AS s, vec_id % 10 * 5 + vec_id % 5 AS e, embedding AS vec FROM embeddings), sp AS (SELECT DISTINCT doc_id, c, x, y FROM v, (VALUES ('a', 0, 27), ('b', 20, 60)) t(c, x, y)),
 p AS (SELECT v.doc_id, v.doc_id || c AS chunk_id, unnest(vec) AS x, unnest(generate_series(0, 63)) AS dim FROM sp JOIN v ON sp.doc_id = v.doc_id AND e > s AND s >= sp.x AND e <= y),
 a AS (SELECT doc_id, chunk_id, dim, avg(x::DOUBLE) AS x FROM p GROUP BY ALL) SELECT doc_id, chunk_id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, chunk_id)), 6) AS x FROM a""",
    "token_ranges": f"""WITH {DOCS}, {PARTS} SELECT doc_id, doc_id || '#' || printf('%03d', part) AS chunk_id, min(tok) AS token_start, max(tok) + 1 AS token_end FROM spans JOIN toks USING (doc_id) WHERE toks.s >= char_start AND toks.e <= char_end GROUP BY doc_id, part""",
    "pack_windows": f'WITH RECURSIVE {DOCS}, {PARTS}, {PACKED} SELECT doc_id, "window", owned, context_start, window_end FROM packed',
    "dense_windows": f"""WITH RECURSIVE {DOCS}, {PARTS}, {PACKED},
 each_ AS (SELECT packed.doc_id, packed.n, context_start, window_end FROM packed JOIN n USING (doc_id) WHERE n.n > 1300 UNION ALL SELECT doc_id, count(*), 0, any_value(n_doc) FROM spans WHERE n_tokens > 0 AND n_doc <= 1300 GROUP BY doc_id)
 SELECT doc_id, count(*) AS windows, min(context_start) AS first_start, max(window_end) AS last_end, sum(n)::BIGINT AS owned FROM each_ GROUP BY doc_id""",
    "flat_names": r"""WITH p AS (SELECT page_id AS place, regexp_replace(regexp_replace(url, '^[^:]*://[^/]*/|[?#].*$', '', 'g'), '/$', '') AS rel FROM pages),
 b AS (SELECT place, rel, string_split(rel, '/')[-1] AS base, CASE WHEN contains(rel, '/') THEN string_split(rel, '/')[-2] ELSE 'root' END AS parent FROM p),
 f AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY place) = 1 AS leads FROM b),
 k AS (SELECT *, row_number() OVER (PARTITION BY base, parent, leads ORDER BY place) AS k FROM f)
 SELECT place, rel, CASE WHEN leads THEN base WHEN k = 1 THEN parent || '__' || base ELSE parent || '_' || k || '__' || base END AS flat_name FROM k""",
    "rag_run": rf"""WITH {BM25}, {BENCH}, {SCORED}, {RANKED}, top AS (SELECT * FROM ranked JOIN documents USING (doc_id) WHERE rank <= 5)
 SELECT query_id || '-naive' AS answer_id, query_id AS question_id, 'naive' AS mode, NULL AS retriever, 0 AS n_citations, NULL AS first_cited FROM q
 UNION ALL SELECT query_id || '-rag-bm25', query_id, 'rag', 'bm25', count(*), max(CASE WHEN rank = 1 AND regexp_matches(text, '^[^
]') THEN 'https://github.com/owner/corpus/blob/v1/' || source || '/' || doc_id || '.md' END) FROM top GROUP BY query_id""",
    "retrieval_metrics_bm25": f"WITH {BM25}, {BENCH}, {SCORED}, {RANKED}, {metrics('SELECT query_id, rank FROM ranked JOIN q USING (query_id) JOIN documents USING (doc_id) WHERE contains(documents.text, q.text)')} SELECT query_id, n_gold, first_relevant_rank, {MROUND} FROM m",
    "gold_ranks_full_depth": f"WITH {BM25}, {BENCH}, {SCORED}, {RANKED} SELECT query_id, doc_id, rank FROM ranked JOIN q USING (query_id) JOIN documents USING (doc_id) WHERE contains(documents.text, q.text)",
    "retrieval_metrics_dense": f"WITH {DENSE_RANKED}, {metrics('SELECT query_id, rank FROM dranked WHERE label = qlabel')} SELECT query_id, n_gold, first_relevant_rank, {MROUND} FROM m",
    "retrieval_metrics_mean": f"WITH {DENSE_RANKED}, {metrics('SELECT query_id, rank FROM dranked WHERE label = qlabel')} SELECT query_id::VARCHAR AS query_id, {MROUND} FROM m UNION ALL SELECT 'MEAN', round(avg(precision), 6), round(avg(recall), 6), round(avg(reciprocal_rank), 6), round(avg(ndcg), 6) FROM m",
    "token_f1": f"WITH {QA}, {F1} SELECT id, round(f1, 9) AS f1 FROM f1",
    "exact_match": rf"WITH {QA}, {F1} SELECT id, em AS exact_match, regexp_replace(said, '^\s+|\s+$', '', 'g') = 'I don''t know' AS is_exact_refusal FROM f1 JOIN qa USING (id)",
    "citation_parse": f"WITH {QA} SELECT id, array_to_string(list_sort({CITED}), ',') AS cited, array_to_string(list_sort(list_filter({CITED}, lambda n: n BETWEEN 1 AND 3)), ',') AS valid FROM qa",
    "generation_eval": f"WITH {EVAL} SELECT * REPLACE (round(token_f1, 9) AS token_f1, round(citation_precision, 9) AS citation_precision, round(citation_recall, 9) AS citation_recall) FROM ev",
    "generation_aggregate": AGGREGATE,
    "citation_validity": f"WITH {EVAL} SELECT arm, count(*) FILTER (has_valid_inline_citation) AS valid, count(*) FILTER (invalid_citation_numbers <> '') AS invalid FROM ev GROUP BY arm",
    "prompt_context": f"""WITH {BM25}, {BENCH}, {SCORED}, {RANKED}, h AS (SELECT query_id, rank, '[' || rank || '] (' || doc_id || ')' || chr(10) || text || CASE WHEN source = 'src0' THEN chr(10) || chr(10) || '```jsx' || chr(10) || 'let a = 1;' || chr(10) || '```' ELSE '' END || CASE WHEN source = 'src1' THEN chr(10) || chr(10) || '```tsx' || chr(10) || 'let b = 2;' || chr(10) || '```' ELSE '' END || chr(10) || chr(10) || '```tsx' || chr(10) || 'let b = 2;' || chr(10) || '```' AS p FROM ranked JOIN documents USING (doc_id) WHERE rank <= 5)
 SELECT query_id, 'Numbered passages:' || chr(10) || string_agg(p, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question:' || chr(10) || any_value(q.text) || chr(10) || chr(10) || 'Answer:' AS prompt FROM h JOIN q USING (query_id) GROUP BY query_id""",
    "review_validate": " UNION ALL ".join(f"SELECT answer_id, 'manual_{f}_0_to_2' AS field, {f} AS value FROM rv WHERE coalesce(try_cast({f} AS DOUBLE) NOT IN (0, 1, 2), true) OR contains({f}, '.')" for f in ("correctness", "groundedness", "completeness")).replace("SELECT", f"WITH {REVIEW} SELECT", 1),
    "manual_summary": f"WITH {SOUND} SELECT arm, count(*) AS count, round(avg(c), 6) AS mean_correctness_0_to_2, round(avg(g), 6) AS mean_groundedness_0_to_2, round(avg(f), 6) AS mean_completeness_0_to_2, count(*) FILTER (c = 2) AS fully_correct_count, count(*) FILTER (g = 2) AS fully_grounded_count, count(*) FILTER (f = 2) AS fully_complete_count FROM ok GROUP BY arm",
    "diagnostic": f"WITH {DIAG} SELECT * FROM diag",
    "diagnostic_summary": f"""WITH {DIAG} SELECT count(*) AS questions, count(*) FILTER (question_type = 'factoid') AS factoid, count(*) FILTER (question_type = 'multi-hop') AS multi_hop, count(*) FILTER (naive_status = 'fully correct') AS naive_fully_correct, count(*) FILTER (naive_status = 'partially correct') AS naive_partially_correct, count(*) FILTER (naive_status = 'incorrect') AS naive_incorrect,
 round(count(*) FILTER (naive_status = 'fully correct') / count(*)::DOUBLE, 6) AS naive_fully_correct_rate, count(*) FILTER (bm25_correctness_0_to_2 = 2) AS bm25_fully_correct, round(count(*) FILTER (bm25_correctness_0_to_2 = 2) / count(*)::DOUBLE, 6) AS bm25_fully_correct_rate, count(*) FILTER (dense_correctness_0_to_2 = 2) AS dense_fully_correct, round(count(*) FILTER (dense_correctness_0_to_2 = 2) / count(*)::DOUBLE, 6) AS dense_fully_correct_rate,
 count(*) FILTER (retrieval_improved_answer) AS improved, round(count(*) FILTER (retrieval_improved_answer) / count(*)::DOUBLE, 6) AS improved_rate FROM diag""",
    "review_upsert": f"""WITH {EVAL}, {REVIEW} SELECT ev.answer_id, ev.arm, coalesce(rv.correctness, '') AS manual_correctness_0_to_2, coalesce(rv.groundedness, '') AS manual_groundedness_0_to_2, coalesce(rv.completeness, '') AS manual_completeness_0_to_2, '' AS manual_notes FROM ev LEFT JOIN rv ON ev.answer_id = (rv.answer_id::BIGINT * 1000 + 1)::VARCHAR""",
}
