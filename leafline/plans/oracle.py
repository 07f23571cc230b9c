"""DuckDB SQL that gives the same results as the queries, over the whole tables."""

from __future__ import annotations

import re

from leafline.functions import text as T
from leafline.functions.tokens import HAN_RUN, LATIN, STOPWORDS
from leafline.operators.answers import BRACKET, ITEM, LIMITS, MAX_CHUNK, MAX_CONTEXT, MAX_QUERY, MIN_SCORE, RULES, digit_table
from leafline.operators.chunking import MAXIMUM, OVERLAP, TARGET
from leafline.operators.experiments import DISTRACTOR as REPEATS
from leafline.operators.experiments import WORDINGS
from leafline.operators.retrieval import B, K1, PHRASE_BONUS, PHRASE_CHARS


# A passage about something else, that a good ranking puts last.
DISTRACTOR = "The recipe calls for two ripe pears, a spoon of honey and a warm oven."


#: What turns a BM25 score into a logit of about the size that a reranker gives.
LOGIT = 14.0
#: What citation_checks adds to each answer.
CITED_BESIDES = [
    ("plain", ""), ("unknown", " See [S9, page 1]."), ("far", " [S1, page 99999999999]"), ("digits", " [S1, page ٣]"), ("back", " [S1, pages 7-1]"), ("small", " [s1]"), ("several", " [S1; S2, pp. 1-2, 7; S3]"),
    ("chinese", " [S1, 第8页]"), ("note", " [note 1] S1"), ("beyond", " [S1, pages 1-99999]"),
]
#: Planning responses that are refused: (kind, response, why).
REFUSED_CALLS = [
    ("tool", '{"choices": [{"message": {"tool_calls": [{"id": "1", "type": "function", "function": {"name": "remove_pdf", "arguments": "{}"}}]}}]}', "the tool or its arguments are not allowed"),
    ("extra", '{"choices": [{"message": {"tool_calls": [{"id": "1", "type": "function", "function": {"name": "retrieve_pdf", "arguments": "{\\"query\\": \\"a\\", \\"k\\": 1}"}}]}}]}', "the tool or its arguments are not allowed"),
    ("empty", '{"choices": [{"message": {"tool_calls": [{"id": "1", "type": "function", "function": {"name": "retrieve_pdf", "arguments": "{\\"query\\": \\" \\"}"}}]}}]}', "the tool or its arguments are not allowed"),
    ("long", '{"choices": [{"message": {"tool_calls": [{"id": "1", "type": "function", "function": {"name": "retrieve_pdf", "arguments": "{\\"query\\": \\"' + "x" * 2001 + '\\"}"}}]}}]}', "the tool or its arguments are not allowed"),
    ("twice", '{"choices": [{"message": {"tool_calls": [{"id": "1", "type": "function", "function": {"name": "retrieve_pdf", "arguments": "{\\"query\\": \\"a\\", \\"query\\": \\"b\\"}"}}]}}]}', "a key occurs twice"),
    ("constant", '{"choices": [{"message": {"tool_calls": [{"id": "1", "type": "function", "function": {"name": "retrieve_pdf", "arguments": "{\\"query\\": NaN}"}}]}}]}', "NaN is no JSON"),
    ("trailing", '{"choices": [{"message": {"tool_calls": [{"id": "1", "type": "function", "function": {"name": "retrieve_pdf", "arguments": "{\\"query\\": \\"a\\"} b"}}]}}]}', "the arguments are no JSON"),
    ("object", '{"choices": [{"message": {"tool_calls": [{"id": "1", "type": "function", "function": {"name": "retrieve_pdf", "arguments": {"query": "a"}}}]}}]}', "the arguments is missing or of a wrong kind"),
    ("nameless", '{"choices": [{"message": {"tool_calls": [{"id": " ", "type": "function", "function": {"name": "document_status", "arguments": "{}"}}]}}]}', "the call must be a function call with an id"),
    ("two", '{"choices": [{"message": {"tool_calls": [{}, {}]}}]}', "exactly one tool call is expected"),
    ("none", '{"choices": []}', "exactly one choice is expected"),
    ("broken", "{", "the response is no JSON"),
]


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replace(c: str, pattern: str, new: str) -> str:
    return f"regexp_replace({c}, {_quote(pattern)}, {_quote(new)}, 'g')"


def _strip(c: str) -> str:
    return _replace(c, f"^{T.BLANK}+|{T.BLANK}+$", "")


def _compact(c: str) -> str:
    return _strip(_replace(c, f"{T.BLANK}+", " "))


def _count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {_quote(pattern)}))"


def _glyphs(c: str) -> str:
    return f"translate({c}, {', '.join(map(_quote, T.glyph_table()))})"


def _normalize(c: str) -> str:
    c = _glyphs(c)
    for pattern, new in ((r"\r\n?", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
        c = _replace(c, pattern, new)
    return _strip(c)


def _unmapped(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, {_quote(T.UNMAPPED_GLYPH)}) THEN {_compact(_replace(c, T.UNMAPPED_GLYPH, ''))} ELSE {c} END"


def _key(c: str) -> str:
    return f"replace(replace(lower({_replace(_compact(c), chr(92) + 'p{Nd}+', '#')}), 'ß', 'ss'), 'ς', 'σ')"


def _words(c: str) -> str:
    return f"({_count(c, T.HAN)} + {_count(c, T.LATIN_WORD)})"


_BAND = f"coalesce(top <= page_height * {T.BAND} OR bottom >= page_height - page_height * {T.BAND}, false)"

_LINES = f"""
lines0 AS (
  SELECT *, len(regexp_extract_all(text, {_quote(T.UNMAPPED_GLYPH)})) AS glyphs, row_number() OVER (PARTITION BY page_id, line_no, CASE WHEN line_no IS NULL THEN line_id END ORDER BY extracted_at DESC NULLS LAST, line_id DESC) AS rn
  FROM extract_page_lines),
lines1 AS (
  SELECT line_id, page_id, file_id, line_no, top, bottom, page_height, glyphs, {_glyphs('t')} AS text FROM (SELECT * EXCLUDE (text), {_unmapped('text')} AS t FROM lines0 WHERE rn = 1)),
lines AS (SELECT * FROM lines1 WHERE {_strip('text')} <> ''),
pages AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY parsed_at DESC NULLS LAST) AS rn FROM parsed_pages) WHERE rn = 1),
bodies AS (SELECT file_id, coalesce(median(bottom - top), 0.0) AS body_height FROM lines GROUP BY file_id),
repeats AS (
  SELECT file_id, key, n_pages FROM
    (SELECT file_id, key, count(*) AS n_pages FROM (SELECT DISTINCT file_id, page_id, {_key('text')} AS key FROM lines WHERE {_BAND}) GROUP BY file_id, key)
    JOIN (SELECT file_id, count(*) AS file_pages FROM pages GROUP BY file_id) USING (file_id)
  WHERE n_pages >= greatest({T.MIN_PAGES}, ceil(file_pages * {T.MIN_SHARE}))),
keyed AS (SELECT *, {_key('text')} AS key FROM lines),
marked0 AS (
  SELECT keyed.*, {_BAND} AND repeats.key IS NOT NULL AS is_repeated, body_height
  FROM keyed LEFT JOIN repeats ON keyed.file_id = repeats.file_id AND keyed.key = repeats.key LEFT JOIN bodies ON keyed.file_id = bodies.file_id),
marked AS (
  SELECT *, NOT is_repeated AND NOT (regexp_matches(text, {_quote(T.CONTENT)}) OR (regexp_matches(text, {_quote(T.NUMERIC_ROW)}) AND coalesce(bottom - top >= body_height * {T.BODY_RATIO}, false))) AS is_low_information
  FROM marked0)"""


def _texts(name: str, rows: str) -> str:
    """Page texts of rows, as CTEs ending in the name."""
    return f"""
{name}_steps AS (SELECT *, top - lag(top) OVER (PARTITION BY page_id ORDER BY line_no) AS step, row_number() OVER (PARTITION BY page_id ORDER BY line_no) AS n FROM {rows}),
{name}_usual AS (SELECT page_id, median(step) AS typical, count(*) AS n_steps FROM {name}_steps WHERE step > 0 GROUP BY page_id),
{name} AS (
  SELECT page_id, string_agg(CASE WHEN n = 1 THEN '' WHEN n_steps >= 2 AND step > typical * {T.GAP_RATIO} THEN chr(10) || chr(10) ELSE chr(10) END || text, '' ORDER BY line_no) AS text
  FROM {name}_steps LEFT JOIN {name}_usual USING (page_id) GROUP BY page_id)"""


_CLEAN = f"""{_LINES}, {_texts('raw', 'lines')}, {_texts('kept', '(SELECT * FROM marked WHERE NOT is_repeated AND NOT is_low_information)')},
counters AS (SELECT page_id, count(*) FILTER (is_repeated) AS repeated, count(*) FILTER (is_low_information) AS low, sum(glyphs) AS glyphs FROM marked GROUP BY page_id),
clean AS (
  SELECT p.page_id, p.file_id, page_index, page_number, round(width, 2) AS width, round(height, 2) AS height, CAST(length(t) AS INT) AS char_count, CAST({_words('t')} AS INT) AS word_count, t <> '' AS has_text,
    coalesce(length({_normalize('raw.text')}) < {T.MIN_TEXT_CHARS}, true) AS needs_ocr, t AS text, coalesce(repeated, 0) AS repeated_lines_removed, coalesce(low, 0) AS low_information_lines_removed,
    CAST(coalesce(glyphs, 0) AS BIGINT) AS unmapped_glyphs_removed, extraction_error
  FROM pages p LEFT JOIN raw USING (page_id) LEFT JOIN (SELECT page_id, {_normalize('text')} AS t0 FROM kept) k USING (page_id) LEFT JOIN counters USING (page_id), LATERAL (SELECT coalesce(t0, '') AS t))"""

_LATIN_FORMS = """list_concat(list_concat([t], list_filter(regexp_split_to_array(t, '[-'']'), lambda p: p <> '')),
    CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN [t[:length(t) - 3] || 'y'] WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND length(t) > 3 THEN [t[:length(t) - 1]] ELSE [] END)"""
_HAN_FORMS = "list_concat(list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 1)), list_transform(range(1, length(t)), lambda i: substr(t, i, 2)))"


def _tokens(name: str, rows: str, key: str, column: str) -> str:
    """(key, token) rows of all tokens with repeats, as a CTE."""
    return f"""
{name} AS (
  SELECT {key}, token FROM (
    SELECT {key}, unnest({_LATIN_FORMS}) AS token FROM (SELECT {key}, unnest(regexp_extract_all(lower(coalesce({column}, '')), {_quote(LATIN)})) AS t FROM {rows})
    UNION ALL
    SELECT {key}, unnest({_HAN_FORMS}) FROM (SELECT {key}, unnest(regexp_extract_all(lower(coalesce({column}, '')), {_quote(HAN_RUN)})) AS t FROM {rows}))
  WHERE token NOT IN ({', '.join(map(_quote, STOPWORDS))}) AND token <> '')"""


_CORPUS = """
corpus AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC NULLS LAST, chunk_no DESC) AS rn FROM chunks) WHERE rn = 1)"""
_CORPUS_AND_DISTRACTOR = f"""{_CORPUS.replace('corpus AS', 'own AS')}, corpus AS (SELECT chunk_id, file_id, chunk_index, text FROM own UNION ALL SELECT 'distractor', -1, 0, {_quote(DISTRACTOR)})"""
_POSTED = f"""{_CORPUS}, {_tokens('toks', 'corpus', 'chunk_id', 'text')},
lens AS (SELECT chunk_id, count(*) AS n_tokens FROM toks GROUP BY chunk_id),
post AS (SELECT chunk_id, token, count(*) AS tf FROM toks GROUP BY chunk_id, token),
dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token),
stats AS (SELECT count(*) AS n_texts, greatest(coalesce(sum(n_tokens), 0) / count(*), 1.0) AS avg_tokens FROM corpus LEFT JOIN lens USING (chunk_id)),
qs AS (SELECT id AS query_id, query FROM eval_cases), {_tokens('qtoks', 'qs', 'query_id', 'query')},
qpost AS (SELECT query_id, token, count(*) AS tf FROM qtoks GROUP BY query_id, token),
qlens AS (SELECT query_id, count(*) AS n_tokens FROM qtoks GROUP BY query_id)"""


def _phrases(source: str, column: str) -> str:
    return f"""
phrases AS (
  SELECT query_id, chunk_id FROM (SELECT id AS query_id, {_compact(f'lower({column})')} AS phrase FROM {source} WHERE {column} IS NOT NULL) JOIN (SELECT chunk_id, {_compact('lower(text)')} AS low FROM corpus WHERE text IS NOT NULL) ON contains(low, phrase)
  WHERE length(phrase) >= {PHRASE_CHARS})"""


def _bm25(k: int) -> str:
    return f"""{_POSTED}, {_phrases('eval_cases', 'query')},
parts AS (
  SELECT query_id, chunk_id, sum(ln(1 + (n_texts - df + 0.5) / (df + 0.5)) * post.tf * ({K1} + 1) / (post.tf + {K1} * (1 - {B} + {B} * n_tokens / avg_tokens))) AS part, array_to_string(list_sort(list(token)), '|') AS matched_terms
  FROM qpost JOIN post USING (token) JOIN dfs USING (token) JOIN lens USING (chunk_id), stats GROUP BY query_id, chunk_id),
scored AS (
  SELECT query_id, chunk_id, round(coalesce(part, 0) + CASE WHEN bonus THEN {PHRASE_BONUS} ELSE 0 END, 4) AS score, coalesce(matched_terms, '') AS matched_terms
  FROM parts FULL JOIN (SELECT *, true AS bonus FROM phrases) USING (query_id, chunk_id)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id, chunk_index, chunk_id) AS INT) AS rank FROM scored JOIN (SELECT chunk_id, file_id, chunk_index, page_range FROM corpus) USING (chunk_id) WHERE score > 0),
hits AS (SELECT * FROM ranked WHERE rank <= {k})"""


_TFIDF = f"""{_POSTED},
cw AS (SELECT chunk_id, token, tf / n_tokens * (ln((n_texts + 1) / (df + 1)) + 1) AS w FROM post JOIN dfs USING (token) JOIN lens USING (chunk_id), stats),
qw AS (SELECT query_id, token, tf / n_tokens * (ln((n_texts + 1) / (df + 1)) + 1) AS w FROM qpost JOIN dfs USING (token) JOIN qlens USING (query_id), stats),
sims AS (
  SELECT q.query_id, c.chunk_id, sum(c.w * q.w) / (any_value(cn.n) * any_value(qn.n)) AS sim FROM cw c JOIN qw q USING (token)
    JOIN (SELECT chunk_id, sqrt(sum(w * w)) AS n FROM cw GROUP BY chunk_id) cn ON cn.chunk_id = c.chunk_id JOIN (SELECT query_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY query_id) qn ON qn.query_id = q.query_id
  GROUP BY q.query_id, c.chunk_id),
ranked AS (
  SELECT query_id, chunk_id, round(coalesce(sim, 0.0), 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(sim, 0.0), 6) DESC, file_id, chunk_index, chunk_id) AS INT) AS rank
  FROM qs CROSS JOIN corpus LEFT JOIN sims USING (query_id, chunk_id))"""

_CORPUS_AND_REPEATS = f"""{_CORPUS.replace('corpus AS', 'own AS')}, corpus AS (SELECT chunk_id, file_id, chunk_index, text FROM own UNION ALL SELECT 'distractor', 9223372036854775807, 0, {_quote(REPEATS)})"""


def _wordings(number: int, corpus: str) -> str:
    """The three best chunks of each wording in one corpus, as CTEs of their own names ending in found and the number."""
    values = ", ".join(f"('Q{i}', {_quote(t)})" for i, t in enumerate(WORDINGS, 1))
    ctes = f"""wordings AS (SELECT * FROM (VALUES {values}) w(id, query)), {_TFIDF.replace(_CORPUS, corpus).replace('eval_cases', 'wordings').strip()},
active AS (SELECT query_id, array_to_string(list_sort(list(token)), '|') AS active_dimensions FROM qw WHERE w > 0 GROUP BY query_id),
found AS (SELECT {number} AS experiment, query_id, coalesce(active_dimensions, '') AS active_dimensions, rank, chunk_id, similarity AS score FROM ranked LEFT JOIN active USING (query_id) WHERE rank <= 3)"""
    for name in ("wordings", "own", "corpus", "toks", "lens", "post", "dfs", "stats", "qs", "qtoks", "qpost", "qlens", "cw", "qw", "sims", "ranked", "active", "found"):
        ctes = re.sub(rf"\b{name}\b(?!')", f"{name}{number}", ctes)
    return ctes


_DENSE = """
near AS (
  SELECT q.vec_id AS query_id, p.vec_id, p.label = q.label AS relevant, list_dot_product(CAST(p.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings q JOIN embeddings p ON p.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS INT) AS rank FROM near)"""

_CITED = f"""{_bm25(5)},
full_texts AS (
  SELECT h.query_id, h.rank, h.chunk_id, h.page_range, h.score - {LOGIT} AS rerank_score,
    {_compact("CASE WHEN len(coalesce(page_segments, [])) > 0 THEN array_to_string(list_transform(page_segments, lambda s: '[p' || s.page || '] ' || coalesce(s.text, '')), ' ') ELSE coalesce(text, '') END")} AS t
  FROM hits h JOIN (SELECT chunk_id, text, page_segments FROM corpus) USING (chunk_id) WHERE h.score - {LOGIT} >= {MIN_SCORE}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS i FROM full_texts),
fold AS (
  SELECT query_id, 0 AS i, 0 AS n, CAST(0 AS BIGINT) AS used, false AS stopped, '' AS chunk_id, '' AS header, '' AS body, false AS truncated, false AS added FROM (SELECT DISTINCT query_id FROM numbered)
  UNION ALL
  SELECT query_id, i, CAST(n + CASE WHEN ok THEN 1 ELSE 0 END AS INT), used + CASE WHEN ok THEN fixed + length(body) ELSE 0 END, stopped OR room <= 0, chunk_id, header, body, length(t) > allowed, ok FROM (
    SELECT *, NOT stopped AND room > 0 AND body <> '' AS ok FROM (
      SELECT *, CASE WHEN length(t) <= allowed THEN t WHEN allowed <= 0 THEN '' WHEN allowed <= 3 THEN substr('...', 1, allowed) ELSE regexp_replace(substr(t, 1, allowed - 3), {_quote(T.BLANK + '+$')}, '') || '...' END AS body FROM (
        SELECT *, least({MAX_CHUNK}, room) AS allowed FROM (
          SELECT *, {MAX_CONTEXT} - used - fixed AS room FROM (
            SELECT f.query_id, CAST(x.i AS INT) AS i, f.n, f.used, f.stopped, x.chunk_id, x.t, h.header, CASE WHEN f.n > 0 THEN 2 ELSE 0 END + length(h.header) + 1 AS fixed
            FROM fold f JOIN numbered x ON x.query_id = f.query_id AND x.i = f.i + 1,
              LATERAL (SELECT format('[S{{}}] chunk={{}} pages={{}} rerank={{:.6f}} base_rank={{}}', f.n + 1, x.chunk_id, coalesce(x.page_range, ''), x.rerank_score, x.rank) AS header) h)))))),
sources AS (SELECT query_id, i, 'S' || n AS source_id, chunk_id, header, body, truncated FROM fold WHERE added),
contexts AS (SELECT query_id, string_agg(header || chr(10) || body, chr(10) || chr(10) ORDER BY i) AS context, count(*) AS n_sources FROM sources GROUP BY query_id)"""


_BRACKET, _ITEM = (x.replace("(?U)", "").replace("(?iU)", "(?i)").replace(r"\d", r"\p{Nd}") for x in (BRACKET, ITEM))


def _checked(answers: str) -> str:
    """Citations of answers (query_id, answer, of), as CTEs ending in checked; of names the question whose sources are meant."""
    numbers = "list_transform(regexp_extract_all(x, '[0-9]+'), lambda n: coalesce(TRY_CAST(n AS BIGINT), -1))"
    return rf"""
brackets AS (SELECT query_id, of, unnest(l) AS bracket, generate_subscripts(l, 1) AS b FROM (SELECT query_id, of, regexp_extract_all(answer, {_quote(_BRACKET)}, 1) AS l FROM {answers})),
items0 AS (SELECT query_id, of, b, unnest(l) AS item, generate_subscripts(l, 1) AS j FROM (SELECT query_id, of, b, regexp_extract_all(bracket, {_quote(_ITEM)}, 0) AS l FROM brackets)),
items AS (SELECT query_id, of, b, j, item, regexp_extract(item, {_quote(_ITEM)}, 1) AS name, translate(regexp_extract(item, {_quote(_ITEM)}, 2), {', '.join(map(_quote, digit_table()))}) AS listed FROM items0),
paged AS (SELECT i.*, p.source_pages AS pages FROM items i LEFT JOIN (SELECT query_id, source_id, source_pages FROM sources JOIN corpus USING (chunk_id)) p ON p.query_id = i.of AND p.source_id = i.name),
checked AS (
  SELECT *, pages IS NOT NULL AND (listed = '' OR len(list_filter(string_split(listed, ','), lambda x: NOT (len(list_filter({numbers}, lambda n: NOT list_contains(pages, n))) = 0 AND {numbers} = list_sort({numbers})))) = 0) AS valid
  FROM paged)"""


_ANSWERS = rf"""{_CITED},
answered0 AS (SELECT q.query_id, q.query, c.context FROM qs q LEFT JOIN contexts c USING (query_id)),
answered1 AS (SELECT *, '\[(S[0-9]+)\][^\n]*\n\[p([0-9]+)\] ([^\n]{{0,80}})' AS pattern FROM answered0),
answered AS (
  SELECT query_id, query, context IS NOT NULL AS asked_model, CASE
    WHEN context IS NULL AND regexp_matches(query, {_quote(T.HAN)}) THEN '文档里没有足以回答该问题的依据。' WHEN context IS NULL THEN 'The document holds no evidence for an answer to this question.'
    WHEN regexp_matches(context, pattern) THEN {_strip('regexp_extract(context, pattern, 3)')} || ' [' || regexp_extract(context, pattern, 1) || ', page ' || regexp_extract(context, pattern, 2) || ']'
    ELSE 'The context does not answer this.' END AS answer
  FROM answered1)"""


_INVALID = "coalesce(string_agg(trim(c.item, ' ,;'), '|' ORDER BY b, j) FILTER (NOT c.valid), '')"


def _split_words(c: str) -> str:
    return _count(c, rf"[^{T.BLANK[1:-1]}]+")


def _status(corpus: str, corpus_is_there: bool = False) -> str:
    """What is known of each file, as CTEs ending in status."""
    return f"""{'' if corpus_is_there else _CORPUS.strip() + ','}
status_pages AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY parsed_at DESC NULLS LAST) AS rn FROM parsed_pages) WHERE rn = 1),
status AS (
  SELECT file_id, file_name, coalesce(page_count, 0) AS page_count, coalesce(chunk_count, 0) AS chunk_count, CASE WHEN page_count IS NULL THEN NULL ELSE coalesce(ocr, '') END AS ocr_pages, {_quote(LIMITS)} AS limitations
  FROM (SELECT file_id, arg_max(file_name, registered_at) AS file_name FROM source_files GROUP BY file_id)
  LEFT JOIN (SELECT file_id, count(*) AS page_count, string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) FILTER (needs_ocr) AS ocr FROM status_pages GROUP BY file_id) USING (file_id)
  LEFT JOIN (SELECT file_id, count(*) AS chunk_count FROM {corpus} GROUP BY file_id) USING (file_id))"""


def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()} {select}"


def _unit(c: str) -> str:
    """A text as one unit on one line. Marks between ideographs overlap, so that step runs twice."""
    word = r"[\p{L}\p{N}_]"
    for pattern, new in ((r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n+", "\n"), (rf"({word})-{T.BLANK}+({word})", r"\1\2"), (rf"{T.BLANK}*\n{T.BLANK}*", " "), (rf"{T.BLANK}{{2,}}", " "), (f"({T.IDEOGRAPH}) ({T.IDEOGRAPH})", r"\1\2"), (f"({T.IDEOGRAPH}) ({T.IDEOGRAPH})", r"\1\2")):
        c = _replace(c, pattern, new)
    return _strip(c)


def _size(c: str) -> str:
    return f"(length({c}) + {_count(c, T.IDEOGRAPH)})"


_CJK = T.IDEOGRAPH[:-1] + r"\x{3000}-\x{303f}\x{ff00}-\x{ffef}]"


def _after(c: str, *marks: tuple[str, str]) -> str:
    """c with a line end after each mark and its blanks."""
    for mark, blanks in marks:
        c = _replace(c, f"({mark}){blanks}", r"\1" + chr(10))
    return f"string_split({c}, chr(10))"


def _parts(rows: str, key: str, column: str, limit: int) -> str:
    """Texts in parts within the limit, as CTEs ending in parts (key, place, part): sentences, else clauses, else words, else slices, packed greedily."""
    glued = f"CASE WHEN cur = '' THEN piece ELSE cur || CASE WHEN regexp_matches(right(cur, 1), {_quote(_CJK)}) OR regexp_matches(left(piece, 1), {_quote(_CJK)}) THEN '' ELSE ' ' END || piece END"
    return f"""
within AS MATERIALIZED (SELECT {key}, {column} AS t, {_size(column)} <= {limit} AS fits FROM {rows} WHERE {column} <> ''),
sents AS (SELECT {key}, i, s, {_size('s')} AS n FROM (SELECT {key}, i, {_strip('x')} AS s FROM (SELECT {key}, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT {key}, {_after('t', (T.CJK_STOP, T.BLANK + '*'), (T.STOP, T.BLANK + '+'))} AS l FROM within WHERE NOT fits))) WHERE s <> ''),
clauses AS (SELECT {key}, i, j, c, {_size('c')} AS n FROM (SELECT {key}, i, j, {_strip('x')} AS c FROM (SELECT {key}, i, unnest(l) AS x, generate_subscripts(l, 1) AS j FROM (SELECT {key}, i, {_after('s', (T.CJK_CLAUSE, T.BLANK + '*'), (T.CLAUSE, T.BLANK + '+'))} AS l FROM sents WHERE n > {limit}))) WHERE c <> ''),
words AS (SELECT {key}, i, j, k, w, {_size('w')} AS n FROM (SELECT {key}, i, j, unnest(l) AS w, generate_subscripts(l, 1) AS k FROM (SELECT {key}, i, j, regexp_split_to_array(c, {_quote(T.BLANK + '+')}) AS l FROM clauses WHERE n > {limit})) WHERE w <> ''),
slices AS (
  SELECT {key}, i, j, k, 0 AS m, '' AS piece, w AS rest, CASE WHEN n > length(w) THEN greatest({limit} // 2, 1) ELSE {limit} END AS step FROM words WHERE n > {limit}
  UNION ALL
  SELECT {key}, i, j, k, m + 1, left(rest, step), substr(rest, step + 1), step FROM slices WHERE {_size('rest')} > {limit}),
tokens AS (
  SELECT {key}, i, j, row_number() OVER (PARTITION BY {key}, i, j ORDER BY k, m) AS o, w, closed FROM (
    SELECT {key}, i, j, k, 0 AS m, w, false AS closed FROM words WHERE n <= {limit}
    UNION ALL SELECT {key}, i, j, k, m, piece, true FROM slices WHERE m > 0
    UNION ALL SELECT {key}, i, j, k, m + 1, rest, false FROM slices WHERE {_size('rest')} <= {limit})),
held AS (
  SELECT DISTINCT {key}, i, j, CAST(0 AS BIGINT) AS o, '' AS cur, '' AS e1, '' AS e2 FROM tokens
  UNION ALL
  SELECT h.{key}, h.i, h.j, t.o, CASE WHEN closed THEN '' WHEN cur = '' OR {_size('cur')} + 1 + {_size('w')} > {limit} THEN w ELSE cur || ' ' || w END, CASE WHEN closed OR {_size('cur')} + 1 + {_size('w')} > {limit} THEN cur ELSE '' END, CASE WHEN closed THEN w ELSE '' END
  FROM held h JOIN tokens t ON t.{key} = h.{key} AND t.i = h.i AND t.j = h.j AND t.o = h.o + 1),
packed_words AS (
  SELECT {key}, i, j, o, 1 AS p, e1 AS piece FROM held WHERE e1 <> '' UNION ALL SELECT {key}, i, j, o, 2, e2 FROM held WHERE e2 <> ''
  UNION ALL SELECT {key}, i, j, o, 3, cur FROM held JOIN (SELECT {key}, i, j, max(o) AS o FROM tokens GROUP BY {key}, i, j) USING ({key}, i, j, o) WHERE cur <> ''),
pieces AS (
  SELECT {key}, piece, row_number() OVER (PARTITION BY {key} ORDER BY i, j, o, p) AS q FROM (
    SELECT {key}, i, 0 AS j, 0 AS o, 0 AS p, s AS piece FROM sents WHERE n <= {limit} UNION ALL SELECT {key}, i, j, 0, 0, c FROM clauses WHERE n <= {limit} UNION ALL SELECT {key}, i, j, o, p, piece FROM packed_words)),
greedy AS (
  SELECT DISTINCT {key}, CAST(0 AS BIGINT) AS q, '' AS cur, '' AS done FROM pieces
  UNION ALL
  SELECT {key}, q, CASE WHEN {_size('joined')} <= {limit} OR cur = '' THEN joined ELSE piece END, CASE WHEN {_size('joined')} <= {limit} THEN '' ELSE cur END FROM (
    SELECT g.{key}, p.q, g.cur, p.piece, {glued} AS joined FROM greedy g JOIN pieces p ON p.{key} = g.{key} AND p.q = g.q + 1)),
parts AS (
  SELECT {key}, 0 AS place, t AS part FROM within WHERE fits
  UNION ALL
  SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY q, z) - 1 AS INT), part FROM (
    SELECT {key}, q, 0 AS z, done AS part FROM greedy WHERE done <> '' UNION ALL SELECT {key}, q, 1, cur FROM greedy JOIN (SELECT {key}, max(q) AS q FROM pieces GROUP BY {key}) USING ({key}, q)))"""


def _tail(c: str, rows: str, name: str) -> str:
    """rows with the end of c that the next chunk repeats, as a column of the given name."""
    first = f"SELECT *, {_strip(f'right({c}, {OVERLAP})')} AS {name}_e FROM ({rows})"
    places = f"SELECT *, greatest(instr({name}_e, '. '), instr({name}_e, '。'), instr({name}_e, chr(10))) - 1 AS {name}_b, instr({name}_e, ' ') - 1 AS {name}_s FROM ({first})"
    within = lambda p: f"{name}_{p} > 0 AND {name}_{p} < length({name}_e) - 1"
    inside = f"NOT regexp_matches(substr({c}, length({c}) - {OVERLAP}, 1), {_quote(f'^{T.BLANK}$')})"
    return f"SELECT *, CASE WHEN length({c}) <= {OVERLAP} THEN '' WHEN {within('b')} THEN {_strip(f'substr({name}_e, {name}_b + 2)')} WHEN {inside} AND {within('s')} THEN {_strip(f'substr({name}_e, {name}_s + 2)')} ELSE {name}_e END AS {name} FROM ({places})"


def _opens(s: str) -> str:
    """Whether a line opens a new unit."""
    word = r"[\p{L}\p{N}_]"
    numeral = "一二三四五六七八九十百千零〇"
    rules = [
        f"regexp_matches({s}, {_quote(rf'^({chr(92)}p{{Nd}}+({chr(92)}.{chr(92)}p{{Nd}}+)*|[A-Z])[).]{T.BLANK}+[^{chr(92)}s]')})",
        f"regexp_matches({s}, {_quote(rf'^(第[{numeral}{chr(92)}p{{Nd}}]+[章节部分篇条讲]|[{numeral}]+[、．]|[（(][{numeral}{chr(92)}p{{Nd}}]+[）)]|{chr(92)}p{{Nd}}+({chr(92)}.{chr(92)}p{{Nd}}+)*[、．])')})",
        f"regexp_matches({s}, {_quote(rf'^[•·▪◦●○■□‣*–—-]{T.BLANK}[^{chr(92)}s]')})",
        f"({s} LIKE '%:' AND length({s}) <= 90)", f"({s} LIKE '%：' AND length({s}) <= 40)",
        f"regexp_matches({s}, {_quote(rf'^(?i:Dear{T.BLANK}+{word}+|Best regards,?)$')})",
    ]
    return " OR ".join(rules)


def _line_units() -> str:
    """Each line as a unit."""
    return f"""{_LINES},
units0 AS (SELECT row_number() OVER () AS u, l.file_id, p.page_number, l.line_no AS o, {_unit('l.text')} AS text FROM lines l LEFT JOIN pages p USING (page_id))"""


def _page_units() -> str:
    """Units of the cleaned pages: paragraphs, divided where a line opens a unit; lines are joined by what stands on either side of their end."""
    cjk = lambda c: f"regexp_matches({c}, {_quote(_CJK)})"
    hyphen = lambda left, right: f"coalesce({left} LIKE '%-' AND regexp_matches({right}, '^\\p{{Ll}}'), false)"
    return f"""{_CLEAN},
paragraphs AS (SELECT page_id, file_id, page_number, unnest(l) AS t, generate_subscripts(l, 1) AS a FROM (SELECT *, string_split({_replace('text', chr(92) + 'n' + T.BLANK + '*' + chr(92) + 'n', chr(1))}, chr(1)) AS l FROM clean)),
page_lines AS (SELECT * FROM (SELECT page_id, file_id, page_number, a, b, {_strip('x')} AS s FROM (SELECT *, unnest(l) AS x, generate_subscripts(l, 1) AS b FROM (SELECT *, string_split({_replace('t', '[ ' + chr(9) + ']+', ' ')}, chr(10)) AS l FROM paragraphs))) WHERE s <> ''),
opened AS (SELECT *, sum(CASE WHEN {_opens('s')} THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, a ORDER BY b) AS g FROM page_lines),
beside AS (SELECT *, lag(s) OVER w AS before, lead(s) OVER w AS after FROM opened WINDOW w AS (PARTITION BY page_id, a, g ORDER BY b)),
glued AS (
  SELECT page_id, file_id, page_number, a, g, string_agg(CASE WHEN before IS NULL OR {hyphen('before', 's')} OR {cjk('right(before, 1)')} OR {cjk('left(s, 1)')} THEN '' ELSE ' ' END || CASE WHEN {hyphen('s', 'after')} THEN left(s, length(s) - 1) ELSE s END, '' ORDER BY b) AS t
  FROM beside GROUP BY page_id, file_id, page_number, a, g),
units0 AS (SELECT row_number() OVER (ORDER BY page_number, page_id, a, g) AS u, file_id, page_number, row_number() OVER (ORDER BY page_number, page_id, a, g) AS o, {_unit('t')} AS text FROM glued)"""


def _packed(units: str | None = None) -> str:
    """Chunks of the units of each document, of its lines if none are given: one step of the recursion per unit, which emits one chunk before and one after it at most."""
    step = f"""SELECT s.file_id, s.i, s.cur, s.own, s.clen, s.rep, u.text AS u, u.n AS n, s.own AND s.clen + 2 + u.n > {MAXIMUM} AS flush
      FROM pack s JOIN units u ON u.file_id = s.file_id AND u.i = s.i + 1"""
    flushed = f"SELECT *, CASE WHEN flush THEN t1 ELSE cur END AS cur1, CASE WHEN flush THEN t1 ELSE rep END AS rep1, CASE WHEN flush THEN {_size('t1')} ELSE clen END AS clen1, own AND NOT flush AS own1 FROM ({_tail('cur', step, 't1')})"
    dropped = f"SELECT *, NOT own1 AND cur1 <> '' AND clen1 + 2 + n > {MAXIMUM} AS dropping FROM ({flushed})"
    rest = f"SELECT *, CASE WHEN dropping THEN '' ELSE cur1 END AS cur2, CASE WHEN dropping THEN '' ELSE rep1 END AS rep2, CASE WHEN dropping THEN 0 ELSE clen1 END AS clen2 FROM ({dropped})"
    added = f"SELECT *, CASE WHEN cur2 = '' THEN u ELSE cur2 || chr(10) || chr(10) || u END AS cur3, clen2 + n + CASE WHEN clen2 > 0 THEN 2 ELSE 0 END AS clen3 FROM ({rest})"
    full = f"SELECT *, clen3 >= {TARGET} AS emit FROM ({_tail('cur3', added, 't3')})"
    return f"""{units or _line_units()},
{_parts('units0', 'u', 'text', MAXIMUM)},
units AS (SELECT file_id, page_number, part AS text, CAST({_size('part')} AS BIGINT) AS n, row_number() OVER (PARTITION BY file_id ORDER BY page_number NULLS FIRST, o, place) AS i FROM units0 JOIN parts USING (u)),
pack AS (
  SELECT file_id, CAST(0 AS BIGINT) AS i, '' AS cur, false AS own, CAST(0 AS BIGINT) AS clen, '' AS rep, CAST(NULL AS VARCHAR) AS e1, '' AS o1, CAST(NULL AS VARCHAR) AS e2, '' AS o2 FROM (SELECT DISTINCT file_id FROM units)
  UNION ALL
  SELECT file_id, i + 1, CASE WHEN emit THEN t3 ELSE cur3 END, NOT emit, CAST(CASE WHEN emit THEN {_size('t3')} ELSE clen3 END AS BIGINT), CASE WHEN emit THEN t3 ELSE rep2 END, CASE WHEN flush THEN cur END, rep, CASE WHEN emit THEN cur3 END, rep2
  FROM ({full})),
emitted AS (
  SELECT file_id, i, 1 AS part, e1 AS text, o1 AS overlap FROM pack WHERE e1 IS NOT NULL UNION ALL SELECT file_id, i, 2, e2, o2 FROM pack WHERE e2 IS NOT NULL
  UNION ALL SELECT file_id, i, 3, cur, rep FROM pack JOIN (SELECT file_id, max(i) AS i FROM units GROUP BY file_id) USING (file_id, i) WHERE own)"""


def _segments(packed: str) -> str:
    """Chunks with their numbers, the pages of their stretches and their page ranges, as CTEs ending in ranges."""
    return f"""{packed},
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY file_id ORDER BY i, part) - 1 AS INT) AS chunk_index, CASE WHEN part = 1 THEN i - 1 ELSE i END AS last FROM emitted),
spans AS (SELECT *, lag(last, 1, 0) OVER (PARTITION BY file_id ORDER BY chunk_index) AS before FROM numbered),
stretches AS (
  SELECT s.file_id, chunk_index, u.page_number AS page, length(u.text) AS n FROM spans s JOIN units u ON u.file_id = s.file_id AND u.i > before AND u.i <= last
  UNION ALL SELECT s.file_id, chunk_index, u.page_number, length(overlap) FROM spans s JOIN units u ON u.file_id = s.file_id AND u.i = before WHERE overlap <> ''),
segments AS (SELECT file_id, chunk_index, page, CAST(sum(n) + 2 * (count(*) - 1) AS INT) AS chars FROM stretches GROUP BY file_id, chunk_index, page),
islands AS (SELECT *, page - row_number() OVER (PARTITION BY file_id, chunk_index ORDER BY page) AS island FROM segments WHERE page IS NOT NULL),
ranges AS (
  SELECT file_id, chunk_index, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS page_range, min(a) AS start_page, max(b) AS end_page
  FROM (SELECT file_id, chunk_index, min(page) AS a, max(page) AS b FROM islands GROUP BY file_id, chunk_index, island) GROUP BY file_id, chunk_index)"""


def statements() -> dict[str, str]:
    """SQL by query name; queries of folds without a short SQL form, of models and of strict JSON have none."""
    return {
        "text_counts": f"SELECT line_id, CAST({_words('text')} AS INT) AS words, CAST(length(text) + {_count('text', T.IDEOGRAPH)} AS INT) AS size FROM extract_page_lines WHERE text IS NOT NULL",
        "normalized_lines": f"SELECT line_id, {_normalize('t')} AS text FROM (SELECT line_id, {_unmapped('text')} AS t FROM extract_page_lines WHERE text IS NOT NULL)",
        "low_information_lines": _with(_LINES, "SELECT line_id, text FROM marked WHERE is_low_information"),
        "body_heights": _with(_LINES, "SELECT file_id, round(body_height, 6) AS body_height FROM bodies"),
        "repeated_header_lines": _with(_LINES, "SELECT file_id, key, n_pages FROM repeats"),
        "repeated_lines_report": _with(_LINES, f"SELECT file_id, string_agg(text, chr(10) ORDER BY text) AS repeated_lines FROM (SELECT m.file_id, m.key, arg_min({_normalize('m.text')}, (p.page_number, m.page_id, m.line_no)) AS text FROM marked m JOIN pages p USING (page_id) WHERE is_repeated GROUP BY m.file_id, m.key) GROUP BY file_id"),
        "paragraph_texts": _with(f"{_LINES}, {_texts('raw', 'lines')}", "SELECT page_id, text FROM raw"),
        "pages_cleaned": _with(_CLEAN, "SELECT * FROM clean"),
        "documents_rollup": _with(_CLEAN, "SELECT file_id, count(*) AS page_count, count(*) FILTER (has_text) AS text_pages, count(*) FILTER (needs_ocr) AS ocr_pages, count(extraction_error) AS warnings, CAST(sum(repeated_lines_removed) AS BIGINT) AS repeated_lines_removed, CAST(sum(low_information_lines_removed) AS BIGINT) AS low_information_lines_removed, CAST(sum(unmapped_glyphs_removed) AS BIGINT) AS unmapped_glyphs_removed FROM clean GROUP BY file_id"),
        "ocr_pages": _with(_CLEAN, "SELECT file_id, string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) AS pages FROM clean WHERE needs_ocr GROUP BY file_id"),
        "source_hashes": "SELECT file_id, arg_max(sha256, registered_at) AS sha256, arg_max(size_bytes, registered_at) AS size_bytes, count(*) AS registrations FROM source_files GROUP BY file_id",
        "content_digests": "SELECT chunk_no, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM chunks WHERE text IS NOT NULL",
        "unit_starts": _with(_LINES, f"SELECT line_id FROM (SELECT line_id, {_strip('text')} AS s FROM lines) WHERE {_opens('s')}"),
        "unit_texts": f"SELECT chunk_no, {_unit('text')} AS unit FROM chunks WHERE text IS NOT NULL",
        "chunk_pack": _with(_packed(), "SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY i, part) - 1 AS INT) AS chunk_index, text, CAST(length(text) AS INT) AS char_count, overlap AS overlap_from_previous FROM emitted", True),
        "chunk_segments": _with(_segments(_packed()), "SELECT file_id, chunk_index, CAST(row_number() OVER (PARTITION BY file_id, chunk_index ORDER BY page NULLS FIRST) - 1 AS INT) AS place, page, chars, coalesce(page_range, '') AS page_range, start_page, end_page FROM segments LEFT JOIN ranges USING (file_id, chunk_index)", True),
        "chunk_runs": _with(_packed(_page_units()), "SELECT file_id, count(*) AS chunk_count, CAST(sum(length(text)) AS BIGINT) AS chars FROM emitted GROUP BY file_id", True),
        "chunks_built": _with(f"""{_segments(_packed(_page_units()))},
stems AS (SELECT file_id, regexp_replace(coalesce(arg_max(file_name, registered_at), CAST(file_id AS VARCHAR)), '\\.[^.]*$', '') AS stem FROM source_files GROUP BY file_id),
counted AS (SELECT file_id, chunk_index, CAST(count(*) AS INT) AS n_segments FROM segments GROUP BY file_id, chunk_index)""", f"""SELECT coalesce(stem, CAST(n.file_id AS VARCHAR)) || '_chunk_' || lpad(CAST(chunk_index AS VARCHAR), CAST(greatest(4, length(CAST(chunk_index AS VARCHAR))) AS INT), '0') AS chunk_id, n.file_id, chunk_index, text, CAST(length(text) AS INT) AS char_count, CAST({_words('text')} AS INT) AS word_count, coalesce(page_range, '') AS page_range, start_page, end_page, overlap AS overlap_from_previous, n_segments
          FROM numbered n JOIN counted USING (file_id, chunk_index) LEFT JOIN ranges USING (file_id, chunk_index) LEFT JOIN stems ON stems.file_id = n.file_id""", True),
        "unit_parts": _with(_parts("(SELECT chunk_no, text FROM chunks)", "chunk_no", "text", MAXIMUM), "SELECT chunk_no, place, part FROM parts", True),
        "unit_parts_narrow": _with(_parts("(SELECT chunk_no, text FROM chunks)", "chunk_no", "text", 60), "SELECT chunk_no, place, part FROM parts", True),
        "sentence_splits": f"SELECT chunk_no, CAST(row_number() OVER (PARTITION BY chunk_no ORDER BY i) - 1 AS INT) AS place, s AS sentence FROM (SELECT chunk_no, i, {_strip('part')} AS s FROM (SELECT chunk_no, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (SELECT chunk_no, {_after('text', (T.CJK_STOP, T.BLANK + '*'), (T.STOP, T.BLANK + '+'))} AS parts FROM chunks WHERE text IS NOT NULL))) WHERE s <> ''",
        "page_ranges": "SELECT chunk_no, coalesce(string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a), '') AS page_range FROM (SELECT chunk_no FROM chunks) LEFT JOIN (SELECT chunk_no, min(p) AS a, max(p) AS b FROM (SELECT chunk_no, p, p - row_number() OVER (PARTITION BY chunk_no ORDER BY p) AS island FROM (SELECT DISTINCT chunk_no, unnest(source_pages) AS p FROM chunks)) GROUP BY chunk_no, island) USING (chunk_no) GROUP BY chunk_no",
        "token_postings": _with(_POSTED, "SELECT chunk_id, token, tf, n_tokens FROM post JOIN lens USING (chunk_id)"),
        "document_frequencies": _with(_POSTED, "SELECT token, df FROM dfs"),
        "corpus_statistics": _with(_POSTED, "SELECT n_texts, round(avg_tokens, 6) AS avg_tokens FROM stats"),
        "bm25_topk": _with(_bm25(3), "SELECT query_id, rank, chunk_id, score, matched_terms, page_range FROM hits"),
        "phrase_matches": _with(f"{_CORPUS}, {_phrases('eval_cases', 'evidence')}", "SELECT query_id, chunk_id FROM phrases"),
        "tfidf_topk": _with(_TFIDF, "SELECT query_id, rank, chunk_id, similarity FROM ranked WHERE rank <= 3"),
        "tfidf_first_chunks": _with(_TFIDF.replace(_CORPUS, _CORPUS.replace("corpus AS", "whole AS") + ", corpus AS (SELECT * FROM whole ORDER BY file_id, chunk_index, chunk_id LIMIT 10)"), "SELECT query_id, rank, chunk_id, similarity FROM ranked WHERE rank <= 3"),
        "tfidf_dimensions": _with(_TFIDF, "SELECT query_id, place, token, round(w, 8) AS weight FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(w, 12) DESC, token) AS INT) AS place FROM qw) WHERE place <= 12"),
        "tfidf_dimension_counts": _with(_TFIDF, "SELECT query_id, count(*) AS dimensions FROM qw WHERE w > 0 GROUP BY query_id"),
        "tfidf_shared_dimensions": _with(_TFIDF, "SELECT query_id, chunk_id, place, token, round(p, 8) AS contribution FROM (SELECT r.query_id, r.chunk_id, token, c.w * q.w AS p, CAST(row_number() OVER (PARTITION BY r.query_id, r.chunk_id ORDER BY round(c.w * q.w, 12) DESC, token) AS INT) AS place FROM ranked r JOIN cw c ON c.chunk_id = r.chunk_id JOIN qw q USING (query_id, token) WHERE r.rank = 1) WHERE place <= 8"),
        "distractor_ranks": _with(_TFIDF.replace(_CORPUS, _CORPUS_AND_DISTRACTOR), "SELECT count(*) FILTER (chunk_id = 'distractor') AS distractor_hits, count(*) AS hits FROM ranked WHERE rank <= 3"),
        "dense_topk": _with(_DENSE, "SELECT query_id, rank, vec_id, round(s, 6) AS similarity FROM ranked WHERE rank <= 10"),
        "dense_label_metrics": _with(_DENSE, "SELECT count(*) AS queries, round(avg(CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END), 4) AS hit, round(avg(coalesce(1.0 / first, 0.0)), 4) AS mrr FROM (SELECT query_id, min(rank) FILTER (relevant AND rank <= 3) AS first FROM ranked GROUP BY query_id)"),
        "evaluation_metrics": _with(f"{_bm25(3)}, labels AS (SELECT DISTINCT query_id, chunk_id FROM (SELECT id AS query_id, unnest(relevant_chunk_ids) AS chunk_id FROM eval_cases) WHERE chunk_id IS NOT NULL), firsts AS (SELECT l.query_id, min(rank) AS first FROM labels l LEFT JOIN hits h ON h.query_id = l.query_id AND h.chunk_id = l.chunk_id GROUP BY l.query_id)", "SELECT 'bm25' AS stage, 3 AS k, count(*) AS cases, round(avg(CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END), 4) AS hit, round(avg(coalesce(1.0 / first, 0.0)), 4) AS mrr FROM firsts"),
        "tfidf_wordings": _with(
            f"{_wordings(1, _CORPUS)}, {_wordings(2, _CORPUS_AND_REPEATS)}",
            "SELECT * FROM found1 UNION ALL SELECT * FROM found2"),
        "unsound_cases": f"SELECT id, CASE WHEN coalesce({_strip('id')}, '') = '' THEN 'no id' WHEN coalesce({_strip('query')}, '') = '' THEN 'no query' ELSE 'no relevant chunk' END AS reason FROM eval_cases WHERE coalesce({_strip('id')}, '') = '' OR coalesce({_strip('query')}, '') = '' OR len(list_filter(coalesce(relevant_chunk_ids, []), lambda c: {_strip('c')} <> '')) = 0",
        "unknown_labels": _with(_CORPUS, "SELECT DISTINCT query_id, chunk_id FROM (SELECT id AS query_id, unnest(relevant_chunk_ids) AS chunk_id FROM eval_cases) WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM corpus)"),
        "evidence_labels": _with(f"{_CORPUS}, {_phrases('eval_cases', 'evidence')}", "SELECT query_id, count(*) AS n_chunks FROM phrases GROUP BY query_id"),
        "context_sources": _with(_CITED, "SELECT query_id, source_id, chunk_id, CAST(length(body) AS INT) AS included_chars, truncated, CAST(length(header) AS INT) AS header_chars FROM sources", True),
        "context_budgets": _with(_CITED, "SELECT query_id, CAST(coalesce(n_sources, 0) AS INT) AS n_sources, CAST(coalesce(length(context), 0) AS INT) AS used_chars FROM (SELECT DISTINCT query_id FROM numbered) LEFT JOIN contexts USING (query_id)", True),
        "prompts": _with(_CITED, f"SELECT query_id, {_quote(RULES)} || chr(10) || chr(10) || 'Question: ' || query || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(context, '') AS prompt FROM (SELECT DISTINCT query_id FROM numbered) LEFT JOIN contexts USING (query_id) JOIN qs USING (query_id)", True),
        "answer_outcomes": _with(_ANSWERS, "SELECT query_id, len(coalesce(relevant_chunk_ids, [])) > 0 AS answerable, asked_model, CASE WHEN expected_in_answer IS NOT NULL THEN CAST(contains(answer, expected_in_answer) AS VARCHAR) END AS has_expected FROM answered JOIN eval_cases ON id = query_id", True),
        "evidence_gate": _with(_ANSWERS, f"SELECT query_id, answer, asked_model, CASE WHEN asked_model THEN CAST({_split_words('answer')} AS BIGINT) ELSE 0 END AS total_tokens, CAST(NULL AS VARCHAR) AS error FROM answered", True),
        "agent_answers": _with(f"asked_cases AS (SELECT id, left({_strip('query')}, {MAX_QUERY}) AS query FROM eval_cases), {_ANSWERS.replace('eval_cases', 'asked_cases')}, {_status('corpus', True)}, {_checked('(SELECT query_id, query_id AS of, answer FROM answered)')}", f"""SELECT a.query_id, 'retrieve_pdf' AS tool, {_strip('any_value(a.query)')} AS argument, any_value(a.answer) AS answer, CAST(NULL AS VARCHAR) AS error, CAST(coalesce(any_value(n.n_sources), 0) AS INT) AS source_count, count(c.item) AS citation_count, {_INVALID} AS invalid
          FROM answered a LEFT JOIN contexts n USING (query_id) LEFT JOIN checked c ON c.query_id = a.query_id GROUP BY a.query_id
          UNION ALL SELECT 'file/' || file_id, 'document_status', NULL, coalesce(file_name, 'None') || ': ' || page_count || ' pages, ' || chunk_count || ' chunks.', NULL, 0, 0, '' FROM status""", True),
        "citation_checks": _with(f"{_ANSWERS}, varied AS (SELECT query_id || '/' || kind AS query_id, query_id AS of, answer || ending AS answer FROM answered, (VALUES {', '.join(f'({_quote(k)}, {_quote(e)})' for k, e in CITED_BESIDES)}) v(kind, ending)), {_checked('varied')}", f"SELECT a.query_id, count(c.item) AS citation_count, {_INVALID} AS invalid FROM varied a LEFT JOIN checked c ON c.query_id = a.query_id GROUP BY a.query_id", True),
        "answers_checked": _with(f"{_ANSWERS}, {_checked('(SELECT query_id, query_id AS of, answer FROM answered)')}", f"SELECT a.query_id, any_value(a.answer) AS answer, any_value(a.asked_model) AS asked_model, CAST(coalesce(any_value(n.n_sources), 0) AS INT) AS n_sources, count(c.item) AS citation_count, {_INVALID} AS invalid FROM answered a LEFT JOIN contexts n USING (query_id) LEFT JOIN checked c ON c.query_id = a.query_id GROUP BY a.query_id", True),
        "tool_calls": f"SELECT id || '/sound' AS id, CASE WHEN fits THEN 'retrieve_pdf' END AS tool, CASE WHEN fits THEN q END AS query, CASE WHEN NOT fits THEN 'the tool or its arguments are not allowed' END AS error FROM (SELECT id, {_strip('query')} AS q, coalesce(length({_strip('query')}) BETWEEN 1 AND {MAX_QUERY}, false) AS fits FROM eval_cases) UNION ALL SELECT id || '/' || kind, NULL, NULL, why FROM eval_cases, (VALUES {', '.join(f'({_quote(k)}, {_quote(w)})' for k, _, w in REFUSED_CALLS)}) v(kind, why)",
        "document_status": _with(_status("corpus"), "SELECT * FROM status"),
    }
