"""DuckDB SQL that gives the same rows as the registered queries."""

from __future__ import annotations

from lorespark.functions.templates import CARD_QA_EN, QUERY_REWRITE, REVIEW_EN
from lorespark.plans.queries import NOISE_HEAD, NOISE_TAIL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


L2 = "list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
HITS = f"""hits AS (SELECT *, row_number() OVER (ORDER BY d, vec_id) AS rank FROM (
  SELECT e.vec_id, e.label, {L2.format(a='e.embedding', b='v.embedding')} AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) v
  ORDER BY d, vec_id LIMIT 10))"""
SOURCE = "CASE WHEN d.lang <> 'de' THEN d.source || '.txt' ELSE 'unknown' END"
LABELLED = "labelled AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"
CONTEXT = f"""{HITS}, {LABELLED}, context AS (SELECT CAST(h.rank AS INT) AS rank, CAST(h.vec_id AS VARCHAR) AS chunk_id, coalesce(d.text, '[Not found]') AS chunk_text,
  CASE WHEN d.doc_id IS NULL THEN 'unknown' ELSE {SOURCE} END AS source, '' AS doi, CASE WHEN d.doc_id IS NULL THEN '' ELSE 'Document ' || d.doc_id END AS title,
  coalesce(d.source, '') AS author, '' AS journal, CASE WHEN d.lang = 'en' THEN '2024' ELSE '' END AS year, '' AS keywords, d.doc_id IS NOT NULL AS found
  FROM hits h LEFT JOIN labelled d ON d.doc_id = h.vec_id)"""
SENTENCES = "list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, chr(32) || chr(10) || chr(9)) <> '')"
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def unnested(parts: str, file: str = "'f' || doc_id || '.txt'") -> str:
    """(doc_id, file, lang, source, pos, part) of a list per document."""
    return f"SELECT doc_id, {file} AS file, source, unnest(range(len(parts))) AS pos, unnest(parts) AS part FROM (SELECT *, {parts} AS parts FROM documents)"


def chunked(parts: str, kind: str, ext: str = "txt") -> str:
    return f"""SELECT file, 0 AS doc_ix, CAST(pos AS INT) AS pos, 'f' || doc_id || '{kind}' || pos AS chunk_id, part AS chunk_text, source, 'f' || doc_id || '{kind}' || pos AS meta_id
FROM ({unnested(parts, f"'f' || doc_id || '.{ext}'")})"""


def paragraphs(parts: str, ext: str) -> str:
    return f"""SELECT file, 0 AS doc_ix, CAST(pos AS INT) AS pos, 'f' || doc_id || '_para' || pos AS chunk_id, {STRIP.format('part')} AS chunk_text, source, 'f' || doc_id || '_para' || pos AS meta_id
FROM ({unnested(parts, f"'f' || doc_id || '.{ext}'")}) WHERE {STRIP.format('part')} <> ''"""


FILES = """files AS (SELECT doc_id, text, 'f' || doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.MD' WHEN 'de' THEN '.bin' ELSE '.html' END AS file,
  CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.md' WHEN 'de' THEN '.bin' ELSE '.html' END AS ext, md5(text) AS hash FROM documents)"""
OLD = f"""{FILES}, old AS (SELECT f.file, CASE WHEN l.quality = 1 THEN f.hash ELSE md5('old') END AS hash, CAST(CASE WHEN l.toxic = 0 THEN len({SENTENCES}) ELSE 0 END AS INT) AS n_chunks,
  TIMESTAMP '2024-05-17 20:25:33' AS last_processed, CASE WHEN l.quality = 1 THEN 'sentence' END AS chunk_method FROM files f JOIN labels l USING (doc_id)
  UNION ALL SELECT 'gone.txt', repeat('0', 32), NULL, NULL, NULL)"""
DIFF = f"""{OLD}, state AS (SELECT f.*, o.hash AS prev_hash, CASE WHEN f.ext = '.bin' THEN 'unsupported' WHEN f.hash = o.hash THEN 'unchanged' ELSE 'changed' END AS state
  FROM files f LEFT JOIN old o USING (file))"""
PAPER = f"""paper AS (SELECT doc_id, CASE lang WHEN 'en' THEN {q(NOISE_HEAD)} || body || {q(NOISE_TAIL)} WHEN 'fr' THEN body || chr(10) || '[7] One entry only' ELSE body END AS text
  FROM (SELECT *, regexp_replace(text, '[,()\\[\\]\\d:]', '', 'g') AS body FROM documents))"""
# The alternatives of a reference line, in this engine's dialect; the tables hold ASCII digits and white space only.
REFERENCE = (
    r"(?i)^\s*(?:\[\d+\]|\[J\]\.?|\[M\]\.?|\d{1,4}[\.）]\s+|\d{4}(?:年|;)\s*\d+|\d{4}[:,]\d{1,4}|doi[:：]\S+|https?://\S+|[A-Za-z]{2,}(?:[A-Za-z0-9\-,']+),"
    r"|[A-Z][A-Za-z0-9\-\x{2019}&, ]{10,}\.\s+[A-Z]|[\x{4e00}-\x{9fa5}]{2,}(?:,|，|、).{5,}?[\.。]\s*[\x{4e00}-\x{9fa5}A-Za-z]|.+?,\s*\d{4},\s*\d{1,4}:\d{1,5}(?:-\d{1,5})?)"
)


def cut_references(source: str) -> str:
    """(doc_id, kept) of ``source`` (doc_id, text): the window form of the cut, for at least 2 references and 7 other lines."""
    return f"""l AS (SELECT doc_id, unnest(range(len(ls))) AS ix, unnest(ls) AS line, len(ls) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {source})),
  r AS (SELECT *, regexp_matches(line, {q(REFERENCE)}) AS ref, n - ix AS rn FROM l),
  c AS (SELECT *, sum(CAST(ref AS INT)) OVER (PARTITION BY doc_id ORDER BY rn) AS cum FROM r),
  m AS (SELECT *, max(CASE WHEN ref AND cum >= 2 THEN rn END) OVER (PARTITION BY doc_id ORDER BY rn) AS lastrn FROM c),
  s AS (SELECT *, min(CASE WHEN NOT ref AND cum >= 2 AND rn - lastrn >= 7 THEN rn END) OVER (PARTITION BY doc_id) AS stop_rn FROM m),
  b AS (SELECT *, coalesce(min(CASE WHEN ref AND cum >= 2 AND (stop_rn IS NULL OR rn < stop_rn) THEN ix END) OVER (PARTITION BY doc_id), n) AS cut FROM s),
  kept AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY ix) FILTER (ix < cut), '') AS text, max(n) AS n, max(cut) AS cut FROM b GROUP BY doc_id)"""


INTRO = r"coalesce(list_position(list_transform(ls, lambda x: regexp_matches(x, '(?i)\babstract\b|\bintroduction\b')), true), 1)"
STARTED = f"started AS (SELECT doc_id, array_to_string(ls[{INTRO}:], chr(10)) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {{0}}))"
WS = "array_to_string(list_transform(string_split({0}, chr(10)), lambda x: regexp_replace(" + STRIP.format("x") + ", ' {{2,}}', ' ', 'g')), chr(10))"


def single_breaks(text: str) -> str:
    """A single line break that follows no full stop becomes a space; runs of breaks stay (no look-around here)."""
    hidden = f"regexp_replace(regexp_replace({text}, '\\n\\n', chr(2), 'g'), '([。！？.!?])\\n', '\\1' || chr(3), 'g')"
    return f"replace(replace(regexp_replace({hidden}, '\\n', ' ', 'g'), chr(3), chr(10)), chr(2), chr(10) || chr(10))"


NORMAL = WS.format(single_breaks("regexp_replace({0}, '\\n{{3,}}', chr(10) || chr(10), 'g')"))
NORMAL_OF = lambda c: NORMAL.replace("{0}", c).replace("{{", "{").replace("}}", "}")
NO_BLANKS = "regexp_replace(array_to_string(list_filter(string_split({0}, chr(10)), lambda x: regexp_matches(x, '\\S')), chr(10)), '^\\s+|\\s+$', '', 'g')"
WORD = "replace(string_split(replace(text, chr(10), ' '), ' ')[{0}], '\"', '')"
CARDS = f"SELECT doc_id AS id, 'What, ' || {WORD.format(1)} || '?' AS c0, replace(coalesce({WORD.format(2)}, '-'), ',', '') AS c1 FROM documents"


def filled(template: str, **values: str) -> str:
    parts, rest = [], template
    while rest:
        at = [(rest.index("{" + n + "}"), n) for n in values if "{" + n + "}" in rest]
        i, name = min(at) if at else (len(rest), None)
        parts.append(q(rest[:i].replace("{{", "{").replace("}}", "}")))
        if name is None:
            break
        parts.append(values[name])
        rest = rest[i + len(name) + 2 :]
    return " || ".join(parts)


#: A document's page in its source's file, numbered over the whole file.
PAGES = "pages AS (SELECT *, source || '.txt' AS file, source || '_chunk' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS chunk_id FROM {0})"
INGESTED = "SELECT *, replace(CASE WHEN doc_id % 3 = 1 THEN text || chr(10) || chr(10) || 'New end.' ELSE text END, chr(10), chr(10) || chr(10)) AS content FROM documents"


def spoken(text: str, most: int) -> tuple[str, str]:
    """What the offline model says to a message, and the words of both: its first words, delimiters left out."""
    words = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"
    content = f"'#####' || {text} || '#####'"
    said = f"list_slice({words.format(f"replace({content}, '#####', '')")}, 1, {most})"
    return f"coalesce(array_to_string({said}, ' '), '')", f"len({words.format(content)}) + len({said})"


SAID, TOKENS = spoken("text", 64)
REWRITTEN = spoken(filled(QUERY_REWRITE, user_query="text"), 300)[0]
TRIMMED = r"regexp_replace(regexp_replace(w, '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}.]+$', '')"
BARE = r"lower(regexp_replace(t, '\.$', ''))"
TYPES = f"""types AS (SELECT type, count(*) FILTER (stopped) AS with_stop, count(*) FILTER (NOT stopped) AS without_stop FROM (
  SELECT CASE WHEN regexp_full_match({BARE}, '[0-9][0-9.,-]*') THEN '##number##' ELSE {BARE} END AS type, ends_with(t, '.') AND NOT ends_with(t, '..') AS stopped
  FROM (SELECT {TRIMMED} AS t FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents))) WHERE type <> '' GROUP BY type)"""
INNER = "(length(type) - length(replace(type, '.', '')))"

ORACLE_SQL = {
    "topk_l2_lookup": f"WITH {HITS} SELECT CAST(h.rank AS INT) AS rank, CAST(h.vec_id AS VARCHAR) AS chunk_id, 'label' || h.label AS source, round(h.d, 6) AS distance, d.text AS chunk_text FROM hits h JOIN documents d ON d.doc_id = h.vec_id WHERE d.text <> ''",
    "topk_left_lookup_fill": f"WITH {CONTEXT} SELECT * FROM context",
    "topk_distance_stats": f"WITH {HITS} SELECT round(min(d), 6) AS min_distance, round(max(d), 6) AS max_distance, round(avg(d), 6) AS avg_distance FROM hits",
    "topk_cosine": "SELECT CAST(row_number() OVER (ORDER BY d, vec_id) AS INT) AS rank, vec_id, round(d, 6) AS distance FROM (SELECT e.vec_id, 1 - list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) v ORDER BY d, vec_id LIMIT 10)",
    "topk_max_distance": f"WITH {HITS} SELECT CAST(rank AS INT) AS rank, CAST(vec_id AS VARCHAR) AS chunk_id, round(d, 6) AS distance FROM hits WHERE d <= 1.0",
    "knn_join_multi_query": f"SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INT) AS rank, round(d, 6) AS distance FROM (SELECT v.vec_id AS query_id, e.vec_id, {L2.format(a='e.embedding', b='v.embedding')} AS d FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) v) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) <= 5",
    "hits_without_id": f"WITH {HITS} SELECT CAST(rank AS INT) AS rank, CAST(vec_id AS VARCHAR) AS chunk_id, 'label' || label AS source, round(d, 6) AS distance FROM hits WHERE rank % 2 = 1",
    "context_block": f"""WITH {CONTEXT}, v AS (SELECT *, row_number() OVER (ORDER BY rank) AS i FROM context WHERE found AND chunk_text NOT IN ('', '[Not found]'))
SELECT string_agg('Chunk ' || i || ': ' || chunk_text || chr(10) || '[' || concat_ws('; ', 'Title: ' || nullif(title, ''), 'Author: ' || nullif(author, ''), 'Journal: ' || nullif(journal, ''), 'Year: ' || nullif(year, ''), 'DOI: ' || nullif(doi, ''), 'Source: ' || nullif(source, '')) || ']', chr(10) || chr(10) ORDER BY i) AS context FROM v""",
    "context_plain": f"WITH {CONTEXT} SELECT string_agg(chunk_text, chr(10) ORDER BY rank) AS context FROM context WHERE found AND chunk_text <> ''",
    "chunk_flatten": f"SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CASE WHEN length(text) > 200 THEN text ELSE 'from metadata' END AS chunk_text, {SOURCE} AS source, '' AS doi, 'Document ' || doc_id AS title, d.source AS author, '' AS journal, CASE WHEN lang = 'en' THEN '2024' ELSE '' END AS year, '' AS keywords FROM documents d",
    "hit_preview": f"WITH {HITS} SELECT CAST(h.rank AS INT) AS rank, CAST(h.vec_id AS VARCHAR) AS chunk_id, substr(d.text, 1, 500) AS chunk_text FROM hits h JOIN documents d ON d.doc_id = h.vec_id WHERE d.text <> '' ORDER BY h.rank LIMIT 5",
    "chunk_page": "SELECT 'f' || doc_id || '.txt' AS file, 0 AS doc_ix, 0 AS pos, 'f' || doc_id || '_chunk0' AS chunk_id, text AS chunk_text, source, 'f' || doc_id || '_chunk0' AS meta_id FROM documents",
    "chunk_sentence": chunked(SENTENCES, "_sent"),
    "chunk_paragraph": paragraphs("string_split(' ' || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))", "txt"),
    "chunk_line": paragraphs("string_split(text, chr(10))", "xlsx"),
    "preclean_pdf": "SELECT doc_id, regexp_replace(regexp_replace(replace('• ' || regexp_replace(text, '([a-z]) ([a-z])', '\\1-' || chr(10) || ' \\2', 'g'), '•', ''), '-\\s*\\n', '', 'g'), '\\s+', ' ', 'g') AS text FROM documents",
    "preclean_markdown": "SELECT doc_id, regexp_replace(replace(text, chr(10), repeat(chr(10), 4)), '\\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents",
    "file_names": "SELECT doc_id, source || CASE lang WHEN 'en' THEN '.tar.GZ' WHEN 'fr' THEN '' ELSE '.Md' END AS file, source || CASE lang WHEN 'en' THEN '.tar' ELSE '' END AS stem, CASE lang WHEN 'en' THEN '.gz' WHEN 'fr' THEN '' ELSE '.md' END AS ext FROM documents",
    "manifest_diff": f"WITH {DIFF} SELECT file, ext, hash, prev_hash, state FROM state",
    "manifest_counters": f"WITH {DIFF} SELECT count(*) AS total, count(*) FILTER (state = 'changed' AND contains(text, '.')) AS processed, count(*) FILTER (state <> 'changed') AS skipped, count(*) FILTER (state = 'changed' AND NOT contains(text, '.')) AS failed FROM state",
    "manifest_upsert": f"WITH {DIFF} SELECT * FROM old WHERE file NOT IN (SELECT file FROM state WHERE state = 'changed') UNION ALL SELECT file, hash, CAST(len({SENTENCES}) AS INT), TIMESTAMP '2025-01-01 00:00:00', 'sentence' FROM state WHERE state = 'changed'",
    "manifest_view": f"WITH {OLD} SELECT file, coalesce(CAST(n_chunks AS VARCHAR), '-') AS n_chunks, coalesce(chunk_method, '-') AS chunk_method, coalesce(hash, '-') AS hash FROM old",
    "manifest_health": f"WITH {OLD} SELECT file FROM old WHERE coalesce(n_chunks, 0) = 0",
    "manifest_health_names": f"WITH {OLD} SELECT string_agg(file, ', ' ORDER BY file) AS names FROM old WHERE coalesce(n_chunks, 0) = 0",
    "chunks_per_file": f"SELECT 'f' || doc_id || '.txt' AS file, CAST(len({SENTENCES}) AS BIGINT) AS n_chunks FROM documents WHERE len({SENTENCES}) > 0",
    "dedup_keep_first": "SELECT md5(text) AS chunk_id, source AS file, doc_id AS pos FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) = 1",
    "duplicate_report": "SELECT md5(text) AS chunk_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "upload_anti_join": "SELECT doc_id AS file, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "upload_semi_join": "SELECT doc_id AS file, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "vector_upsert": "SELECT vec_id AS chunk_id, label AS version FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, -1 FROM documents",
    "vector_prune": "SELECT vec_id AS chunk_id, label AS version FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)",
    "empty_ids": "SELECT doc_id, CAST(doc_id AS VARCHAR) AS chunk_id FROM documents WHERE lang NOT IN ('de', 'es', 'fr')",
    "clean_unify_spaces": "SELECT doc_id, regexp_replace(translate(chr(12288) || 'a' || chr(9) || chr(160) || ' b ' || chr(8195) || replace(text, ' ', ' ' || chr(8232) || ' '), chr(12288) || chr(9) || chr(160) || chr(8195) || chr(8232), '     '), ' {2,}', ' ', 'g') AS text FROM documents",
    "clean_normalize_ws": f"SELECT doc_id, {NORMAL_OF('t')} AS text FROM (SELECT doc_id, replace(replace(text, '. ', ' .' || repeat(chr(10), 4)), ', ', ' ,' || chr(10)) AS t FROM documents)",
    "clean_strip_intro": f"WITH {PAPER}, {STARTED.format('paper')} SELECT doc_id, text FROM started",
    "clean_strip_refs": f"WITH {PAPER}, {cut_references('paper')} SELECT doc_id, text FROM kept",
    "clean_footnotes": "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, '. ', ' [12]( 3 ). ') || ' end 12.', '\\[\\d+\\]', '', 'g'), '\\(\\s*\\d+\\s*\\)', '', 'g'), '\\s+\\d{1,2}([.,]?)$', '\\1') AS text FROM documents",
    "clean_page_numbers": f"SELECT doc_id, {NO_BLANKS.format('t')} AS text FROM (SELECT doc_id, array_to_string(list_filter(string_split(replace(text, chr(10), chr(10) || '  Page 12 ' || chr(10) || '7' || chr(10) || '第 3 页' || chr(10)), chr(10)), lambda x: NOT regexp_full_match(x, '\\s*(Page\\s*\\d+|第\\s*\\d+\\s*页|\\d+)\\s*')), chr(10)) AS t FROM documents)",
    "clean_pipeline": f"""WITH {PAPER}, spaced AS (SELECT doc_id, regexp_replace(text, ' {{2,}}', ' ', 'g') AS text FROM paper), normal AS (SELECT doc_id, {NORMAL_OF('text')} AS text FROM spaced),
{STARTED.format('normal')}, {cut_references('started')}
SELECT doc_id, CAST(n AS INT) AS lines_before, CAST(CASE WHEN cut < n THEN greatest(cut, 1) ELSE n END AS INT) AS lines_after, {NO_BLANKS.format("regexp_replace(regexp_replace(text, '\\[\\d+\\]', '', 'g'), '([^ ]) \\d{1,2}([.,]?)$', '\\1\\2')")} AS cleaned FROM kept""",
    "html_plain": "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages",
    "csv_cards_parse": f"SELECT id, CAST(0 AS INT) AS row, c0 AS front, c1 AS back, ' note' AS extra FROM ({CARDS}) UNION ALL SELECT doc_id, 1, 'second', 'row', 'here' FROM documents",
    "csv_cards_lines": f"SELECT id, CAST(0 AS INT) AS line, c0, c1, ' note' AS c2 FROM ({CARDS}) UNION ALL SELECT doc_id, 3, 'second', 'row', 'here' FROM documents",
    "csv_cards_export": f"SELECT id, CAST(0 AS INT) AS line, '\"' || c0 || '\",' || c1 || ', note' AS csv FROM ({CARDS}) UNION ALL SELECT doc_id, 3, 'second,row,here' FROM documents",
    "dashboard_counts": "SELECT n_chunks, n_vectors, round(n_vectors / n_chunks, 6) AS progress FROM (SELECT count(*) AS n_chunks FROM documents), (SELECT count(*) AS n_vectors FROM embeddings WHERE label > 0)",
    "provider_route": "SELECT doc_id, model, CASE WHEN model = 'qwen-max' THEN 'qwen' ELSE 'openai' END AS provider, CASE WHEN model = 'qwen-max' THEN 'qwen-plus' ELSE 'gpt-4o-mini' END AS default_model FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'gpt-4o' WHEN 'fr' THEN 'qwen-max' WHEN 'de' THEN 'claude-x' ELSE 'other' END AS model FROM documents)",
    "i18n_lookup": "SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'fr' THEN '中文' ELSE 'fr' END AS lang, 'review' AS tab, CASE lang WHEN 'es' THEN 'no such key' ELSE 'not_found' END AS key, CASE lang WHEN 'es' THEN NULL WHEN 'fr' THEN '未找到' ELSE '[Not found]' END AS value FROM documents",
    "prompt_card": "SELECT doc_id, " + filled(CARD_QA_EN, num_cards="'5'", card_type="'qa'", difficulty="'intermediate'", detail_level="'moderate'", query="'{context} of ' || source", context="text") + " AS prompt FROM documents",
    "prompt_review": "SELECT doc_id, " + filled(REVIEW_EN, query="'{context} of ' || source", context="text") + " AS prompt FROM documents",
    "prompt_messages": "SELECT doc_id, 2 AS n, 'system' AS first_role, '#####' || text || '#####' AS user_content FROM documents",
    "template_column": "SELECT doc_id, '{' || lang || '} {context} / ' || source AS prompt FROM documents",
    "project_catalog": "SELECT DISTINCT source AS project FROM documents",
    "line_counts": f"SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INT) AS n_lines, CAST(length({STRIP.format('text')}) AS INT) AS n_stripped FROM documents",
    "embed_stub": "SELECT doc_id, 64 AS size, CASE WHEN regexp_matches(text, '\\w') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS norm FROM documents",
    "query_rewrite": "SELECT item_id, CASE WHEN item_id > 0 THEN text ELSE '' END AS std_query FROM benchmark",
    "card_table": f"SELECT id, CAST(0 AS INT) AS row, c0 AS front, c1 AS back, ' note' AS extra FROM ({CARDS}) UNION ALL SELECT doc_id, 1, 'second', 'row', 'here' FROM documents",
    "ingest_manifest": f"""SELECT 'f' || doc_id || '.txt' AS file, md5(content) AS hash, CAST(n AS INT) AS n_chunks, 'paragraph' AS chunk_method, CAST(n AS BIGINT) AS n_stored
FROM (SELECT *, len(list_filter(string_split(content, chr(10) || chr(10)), lambda x: {STRIP.format('x')} <> '')) AS n FROM ({INGESTED}))""",
    "ingest_report": "SELECT count(*) AS total, count(*) FILTER (doc_id % 5 = 0) AS processed, count(*) FILTER (doc_id % 5 <> 0) AS skipped, CAST(0 AS BIGINT) AS failed FROM documents",
    "chunk_page_files": f"WITH {PAGES.format('documents')} SELECT file, source AS stem, CAST(doc_id AS INT) AS doc_ix, chunk_id, md5(text) AS md5 FROM pages",
    "chunk_store_replace": f"""WITH fresh AS (SELECT * REPLACE ('new ' || text AS text) FROM documents WHERE lang = 'en'), {PAGES.format('fresh')},
{PAGES.format('documents').replace('pages AS', 'before AS')}
SELECT file, CAST(doc_id AS INT) AS doc_ix, chunk_id, md5(text) AS md5 FROM (SELECT file, doc_id, chunk_id, text FROM pages UNION ALL SELECT file, doc_id, chunk_id, text FROM before WHERE source NOT IN (SELECT source FROM fresh))""",
    "chunk_store_empty_ids": """SELECT file, CAST(doc_id AS INT) AS pos, chunk_id FROM (SELECT source || '.txt' AS file, doc_id,
  CASE lang WHEN 'de' THEN ' ' WHEN 'fr' THEN '' WHEN 'es' THEN NULL ELSE CAST(doc_id AS VARCHAR) END AS chunk_id, lang IN ('de', 'fr', 'es') AS blank FROM documents)
QUALIFY NOT blank OR bool_and(blank) OVER (PARTITION BY file)""",
    "vector_store_upsert": "SELECT CAST(vec_id AS VARCHAR) AS chunk_id, CASE WHEN label = 1 OR vec_id % 4 = 0 THEN 'new' ELSE 'old' END AS chunk_text, CAST(label AS VARCHAR) AS label, CAST(len(embedding) AS INT) AS size FROM embeddings WHERE label <> 2",
    "only_files_semi_join": f"WITH {PAGES.format('documents')} SELECT file, CAST(doc_id AS INT) AS doc_ix, chunk_id FROM pages WHERE source IN (SELECT source FROM documents WHERE lang = 'en')",
    "joined_pages": "SELECT source, md5(text) AS md5, CAST(length(text) AS INT) AS n_chars FROM (SELECT source, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY source)",
    "query_rewrite_asked": f"SELECT item_id, CASE WHEN item_id % 7 > 0 THEN {REWRITTEN} ELSE '' END AS std_query FROM benchmark",
    "memo_calls": f"SELECT md5(text) AS md5, {SAID} AS said, CAST(2 + {TOKENS} AS BIGINT) AS tokens, count(*) AS n_rows, (SELECT count(DISTINCT text) FROM documents) AS n_memo FROM documents GROUP BY text",
    "boundary_type_counts": f"WITH {TYPES} SELECT * FROM types",
    "abbreviations_learned": f"""WITH {TYPES}, total AS (SELECT sum(with_stop + without_stop) AS n, sum(with_stop) AS stops FROM types),
scored AS (SELECT type, -2 * (with_stop * ln(stops / n) + without_stop * ln(1 - stops / n) - with_stop * ln(0.99::DOUBLE) - without_stop * ln((1 - 0.99::DOUBLE)))
  * exp(-(length(type) - {INNER})) * ({INNER} + 1) * pow(length(type) - {INNER}, -without_stop) AS score
  FROM types, total WHERE with_stop > 0 AND regexp_matches(type, '\\p{{L}}') AND type <> '##number##')
SELECT type, round(score, 6) AS score FROM scored WHERE score >= 0.3""",
}
ORACLE_SQL["ivf_knn_all_lists"] = ORACLE_SQL["knn_join_multi_query"]
