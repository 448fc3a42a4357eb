"""The operators' queries over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat, crf, hamming, licenses, mixing, pii, quality, simhash, urls
from lodestone.llm.common import table

#: (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Pages with this many words ending in sign clutter are listed for op1.
_CLUTTER = r"(?:\*\*\*|%%%|###|\$\$\$)"
#: What both turns of conversation -1 say.
_CONTROL = "</s>[INST] ok [/INST]"


def tokenizer() -> tuple[str, str]:
    """Rank file and split pattern of the 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages judged by URL: four rules, and as listed URLs those of pages cluttered with sign runs."""
    pages = table(spark, sf_dir, "pages")
    listed = urls.blocked(pages.where(F.col("html").rlike(f"(?s){_CLUTTER}.*{_CLUTTER}.*{_CLUTTER}")).select("url"), "url")
    return urls.judge(pages.select("page_id", "url"), listed.unionByName(urls.rules(spark, URL_RULES))).drop("url")


def op2_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every row whose id is divisible by 50, among all rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.nearest(rows, rows.where("vec_id % 50 = 0"), k=10)


def op3_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return crf.score(docs, crf.fit(docs, table(spark, sf_dir, "labels")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op7_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), *tokenizer(), with_ids=False)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_documents(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("finds", lambda f: F.concat_ws(":", f["license"], f["start"].cast("string"), f["end"].cast("string"), f["differences"].cast("string"))), ",")
    return found.select("doc_id", "n_blocks", "licenses", spans.alias("spans"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    # as many files as cut writes, not one for each shuffle partition
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id").coalesce(2 * spark.sparkContext.defaultParallelism)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", _CONTROL), (-1, 1, "assistant", _CONTROL)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(chat.as_events(turns.unionByName(extra))))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_hamming_topk, op3_weighted_mix, op4_crf_quality, op5_pii, op6_line_rules, op7_tree_bpe, op8_license_scan, op9_simhash, op10_chat_format)}
ORACLE_SQL: dict[str, str] = {}


# -- the same in SQL ------------------------------------------------------------------------------

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_W = r"[^\x20\x09-\x0D]+"

ORACLE_SQL["op1_url_filter"] = rf"""WITH u AS (SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, url, translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
listed AS (SELECT DISTINCT regexp_replace(host || path, '/+$', '') AS c FROM p WHERE regexp_matches(html, '(?s){_CLUTTER}.*{_CLUTTER}.*{_CLUTTER}') AND regexp_replace(host || path, '/+$', '') <> ''),
r(h, pre, v) AS (VALUES {_RULES}),
best AS (SELECT page_id, url, arg_max(h || pre, length(h || pre)) AS rule, arg_max(v, length(h || pre)) AS v FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id, url)
SELECT page_id, host, path, best.rule, coalesce(best.v, CASE WHEN regexp_replace(host || path, '/+$', '') IN (SELECT c FROM listed) AND url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN best USING (page_id, url)"""

ORACLE_SQL["op2_hamming_topk"] = """WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings WHERE len(embedding) = 64),
d AS (SELECT q.vec_id AS query, b.vec_id AS neighbor, len(list_filter(list_zip(q.s, b.s), lambda z: z[1] <> z[2])) AS distance FROM b q, b WHERE q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbor) AS rank FROM d) SELECT query, rank, neighbor, distance FROM r WHERE rank <= 10"""

ORACLE_SQL["op3_weighted_mix"] = rf"""WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_W}')) AS size, md5('0:' || doc_id || ':' || md5(coalesce(text, ''))) AS shuffled FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM src),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, w * (SELECT arg_min(level, cap / w) FROM l WHERE level * w <= cap)) AS target FROM l),
o AS (SELECT s.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY shuffled, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, source, size, start, (start + size) / target::DOUBLE AS finish FROM (SELECT *, before + k * source_size AS start FROM o, (VALUES (0), (1)) passes(k) WHERE size > 0)),
q AS (SELECT doc_id, size, coalesce(sum(size) OVER (ORDER BY finish, source NULLS LAST, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM c),
k AS (SELECT doc_id, sum(greatest(0, least(size, (SELECT floor(1.5::DOUBLE * sum(size)) FROM s) - position)))::BIGINT AS taken FROM q GROUP BY doc_id)
SELECT doc_id, o.size, source_size, target, coalesce(taken, 0) AS taken FROM o LEFT JOIN k USING (doc_id)"""


def _squeezed(x: str) -> str:
    """Lower-cased, digits as 0, white space to single spaces, none at the ends."""
    return rf"trim(regexp_replace(translate({x}, '{_UP}123456789', '{_LOW}000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"


ORACLE_SQL["op6_line_rules"] = rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
ln AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line, unnest(generate_series(1, len(string_split(t, chr(10))))) AS at FROM d),
lw AS (SELECT *, len(regexp_extract_all(line, '{_W}')) AS n, {_squeezed('line')} AS norm FROM ln WHERE regexp_matches(line, '{_W}')),
whole AS (SELECT doc_id, source, {_squeezed('t')} AS doc FROM d WHERE regexp_matches(t, '{_W}')),
lim AS (SELECT source, greatest(10, count(DISTINCT doc) * 0.02::DOUBLE) AS most FROM whole GROUP BY source),
freq AS (SELECT lw.source, norm FROM lw JOIN whole USING (doc_id) JOIN lim ON lim.source IS NOT DISTINCT FROM lw.source GROUP BY lw.source, norm, most HAVING count(DISTINCT whole.doc) > most),
gone AS (SELECT lw.doc_id, sum(n)::BIGINT AS frequent_words FROM lw JOIN freq ON freq.source IS NOT DISTINCT FROM lw.source AND freq.norm = lw.norm GROUP BY lw.doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY doc_id),
tri AS (SELECT doc_id, unnest(generate_series(1, len(w) - 2)) AS i, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM d WHERE len(w) >= 3),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri), (VALUES (0), (1), (2)) z(k) WHERE c > 1 GROUP BY doc_id),
a AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(frequent_words, 0) AS frequent_words
 FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND NOT (n_words - frequent_words < 0.2::DOUBLE * n_words) AS kept FROM f"""

_T = r"[\p{L}\p{M}\p{N}_]+"
_EMAIL, _IP, _CARD, _PHONE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[0-9](?:[ -]?[0-9])+", r"\+[0-9][ ().0-9-]+[0-9]"


def _found(kind: int, pattern: str, ok: str) -> str:
    """Matches of a pattern with their offsets: running sums over the pieces between them."""
    return f"""SELECT doc_id, {kind} AS kind, s, s + length(v) AS e, v FROM (SELECT doc_id, v, (sum(length(gap) + length(v)) OVER (PARTITION BY doc_id ORDER BY i) - length(v))::BIGINT AS s FROM
 (SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}')) AS v, unnest(regexp_split_to_array(t, '{pattern}')[:len(regexp_extract_all(t, '{pattern}'))]) AS gap, unnest(generate_series(1, len(regexp_extract_all(t, '{pattern}')))) AS i FROM d)) WHERE {ok}"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(generate_series(1, length({_DIGITS})), lambda k: CASE WHEN k % 2 = 1 THEN reverse({_DIGITS})[k]::INT ELSE 2 * reverse({_DIGITS})[k]::INT - CASE WHEN reverse({_DIGITS})[k]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_OCTETS = "list_bool_and(list_transform(string_split(v, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND ('0' || left(ltrim(p, '0'), 3))::INT <= 255))"


def _tokens(part: str, at: str, cut: str) -> str:
    return f"""SELECT doc_id, ent, kind, v, {at} + s AS s, {at} + s + length(tok) AS e, tok FROM (SELECT *, (sum(length(gap) + length(tok)) OVER (PARTITION BY doc_id, ent ORDER BY i) - length(tok))::BIGINT AS s FROM
 (SELECT *, unnest(regexp_extract_all({part}, '{_T}')) AS tok, unnest(regexp_split_to_array({part}, '{_T}')[:len(regexp_extract_all({part}, '{_T}'))]) AS gap, unnest(generate_series(1, len(regexp_extract_all({part}, '{_T}')))) AS i FROM ents)) WHERE NOT ({cut})"""


def _tokens_of_texts() -> str:
    """All tokens of all texts with their offsets."""
    return f"""SELECT doc_id, s, s + length(tok) AS e, tok FROM (SELECT doc_id, tok, (sum(length(gap) + length(tok)) OVER (PARTITION BY doc_id ORDER BY i) - length(tok))::BIGINT AS s FROM
 (SELECT doc_id, unnest(regexp_extract_all(t, '{_T}')) AS tok, unnest(regexp_split_to_array(t, '{_T}')[:len(regexp_extract_all(t, '{_T}'))]) AS gap, unnest(generate_series(1, len(regexp_extract_all(t, '{_T}')))) AS i FROM d))"""


ORACLE_SQL["op5_pii"] = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS ({_found(0, _EMAIL, 'true')} UNION ALL {_found(1, _IP, _OCTETS)} UNION ALL {_found(2, _CARD, f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}")} UNION ALL {_found(3, _PHONE, f"length({_DIGITS}) BETWEEN 10 AND 15")}),
ents AS (SELECT doc_id, kind, lower(v) AS v, s AS s0, e AS e0, greatest(0, s - 100) AS low, substr(t, greatest(0, s - 100) + 1, s - greatest(0, s - 100)) AS lp, substr(t, e + 1, 100) AS rp, length(t) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY s, kind) AS ent FROM b JOIN d USING (doc_id)),
ctx AS ({_tokens('lp', 'low', 's = 0 AND low > 0')} UNION ALL {_tokens('rp', 'e0', 's + length(tok) = 100 AND size > e0 + 100')}),
c AS (SELECT DISTINCT doc_id, kind, v, s, e, lower(tok) AS term FROM ctx WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = ctx.doc_id AND b.s < ctx.e AND ctx.s < b.e)),
n AS (SELECT count(DISTINCT t)::DOUBLE AS n FROM d),
both_ AS (SELECT kind, v, term, count(DISTINCT t) AS n_both FROM c JOIN d USING (doc_id) GROUP BY ALL),
tk AS ({_tokens_of_texts()}),
nt AS (SELECT lower(tok) AS term, count(DISTINCT t) AS n_term FROM tk JOIN d USING (doc_id) GROUP BY ALL),
ne AS (SELECT kind, v, count(DISTINCT t) / (SELECT n FROM n) AS p_entity FROM ents JOIN d USING (doc_id) GROUP BY ALL),
tell AS (SELECT DISTINCT term FROM both_ JOIN nt USING (term) JOIN ne USING (kind, v) WHERE (n_both + p_entity) / (n_term + 1) >= 0.5 AND (n_both + p_entity) / (n_term + 1) >= sqrt(p_entity)),
x AS (SELECT doc_id, s, e FROM tk JOIN tell ON lower(tok) = term WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = tk.doc_id AND b.s < tk.e AND tk.s < b.e)),
ba AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone, string_agg((['email', 'ip', 'card', 'phone'])[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS line FROM b GROUP BY doc_id),
al AS (SELECT doc_id, count(*) FILTER (kind = 4) AS n_terms, string_agg((['email', 'ip', 'card', 'phone', 'term'])[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS line FROM (SELECT doc_id, kind, s, e FROM b UNION ALL SELECT doc_id, 4, s, e FROM x) GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(ba.line, '')) AS base_sha256, coalesce(al.line, '') AS spans, coalesce(n_terms, 0) AS n_terms FROM d LEFT JOIN ba USING (doc_id) LEFT JOIN al USING (doc_id)"""

# A segment is its marks, a line end, and the role and text with two characters for each escaped string.
_ESCAPED = "|".join(map(re.escape, [chat.SIGN, *chat.CONTROLS]))
_MARKS = len(chat.OPEN + chat.SPLIT + chat.END) + 1
ORACLE_SQL["op10_chat_format"] = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{_CONTROL}'), (-1, 1, 'assistant', '{_CONTROL}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum({_MARKS} + length(regexp_replace(role, '{_ESCAPED}', 'xx', 'g')) + length(regexp_replace(text, '{_ESCAPED}', 'xx', 'g')))::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""
