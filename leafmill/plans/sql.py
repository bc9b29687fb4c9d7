"""The same results in SQL (DuckDB's dialect), written from the operators' definitions."""

from __future__ import annotations

S = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
LF, NUL, CR, VT = "chr(10)", "chr(0)", "chr(13)", "chr(11)"
B = "(SELECT DISTINCT ON (block_id) * FROM blocks)"
TYPE = f"lower(regexp_replace(block_type, '^{S}+|{S}+$', '', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def clean(x: str) -> str:
    return strip(f"regexp_replace(regexp_replace(replace(coalesce({x}, ''), {CR}, {LF}), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', {LF} || {LF}, 'g')")


def narr(x: str) -> str:
    return strip(f"regexp_replace(coalesce({x}, ''), '{S}+', ' ', 'g')")


def ended(x: str, force: str = "false") -> str:
    return f"""CASE WHEN {x} = '' OR {x} = '[image]' OR contains('.!?:;)]}}', right({x}, 1)) OR (NOT {force} AND contains('.!?)"'']}}', right({x}, 1))) THEN {x} ELSE {x} || '.' END"""


def parts(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda p: {narr('p')}), lambda p: p <> '')"


def joined(p: str) -> str:
    """Of parts on one line each."""
    return f"array_to_string(list_transform({p}, lambda p, i: {ended('p', f'(i = len({p}))')}), ' ')"


def n_words(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN 0 ELSE len(regexp_split_to_array({x}, '{S}+')) END)"


def heading_like(x: str) -> str:
    return f"({x} <> '' AND NOT contains({x}, {LF}) AND length({x}) <= 120 AND NOT contains('.!?', right({x}, 1)) AND {n_words(strip(x))} <= 12)"


def no_colon(x: str) -> str:
    return f"regexp_replace({x}, ':+$', '')"


def headed(h: str, body: str) -> str:
    """h and body are on one line."""
    short = no_colon(h)
    return f"""CASE WHEN {h} = '' THEN {body} WHEN {body} = '' THEN {h}
WHEN {short} <> '' AND (lower({narr(body)}) = {no_colon(f'lower({narr(short)})')} OR starts_with(lower({narr(body)}), {no_colon(f'lower({narr(short)})')} || ':')) THEN {body}
WHEN {heading_like(short)} THEN {short} || ': ' || {body} ELSE {h} || {LF} || {LF} || {body} END"""


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"


def lettered(cells: str) -> str:
    """Blank cells as their column's letter (up to two letters)."""
    return f"list_transform({cells}, lambda x, i: CASE WHEN x <> '' THEN x WHEN i <= 26 THEN chr(CAST(64 + i AS INT)) ELSE chr(CAST(64 + (i - 1) // 26 AS INT)) || chr(CAST(65 + (i - 1) % 26 AS INT)) END)"


def numbered(cells: str) -> str:
    """The n-th cell of a name as "name (n)"."""
    return f"list_transform({cells}, lambda x, i: CASE WHEN len(list_filter({cells}[1:i], lambda y: y = x)) = 1 THEN x ELSE x || ' (' || len(list_filter({cells}[1:i], lambda y: y = x)) || ')' END)"


def json_list(x: str) -> str:
    return f"'[' || array_to_string(list_transform({x}, lambda y: CAST(to_json(y) AS VARCHAR)), ', ') || ']'"


PIECES = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x{85}\p{Z}]"
TITLE = no_colon(narr("coalesce(nullif(section_title, ''), nullif(heading, ''), nullif(section_key, ''), '')"))
LATEST = f"""chunks AS (SELECT *, {TITLE} AS title FROM (SELECT DISTINCT ON (chunk_id) * FROM chunk_records WHERE chunk_id IS NOT NULL ORDER BY chunk_id, embedded_at DESC NULLS LAST))"""
USABLE = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0"

#: The parts of a chunk's text, and the text repaired from them (column repaired).
REPAIRED = f"""
r1 AS (SELECT *, {narr('title')} AS h, {clean('text')} AS ct FROM chunks),
r2 AS (SELECT *, list_filter(list_transform(regexp_split_to_array(ct, '\\n{{2,}}'), lambda p: {strip('p')}), lambda p: p <> '') AS ps FROM r1),
r3 AS (SELECT *, coalesce(ps[1], '') AS first, {narr("coalesce(ps[1], '')")} AS f1, {parts('ps')} AS np, {parts('ps[2:]')} AS nrest,
  h <> '' AND {no_colon(f"lower({narr(chr(99)+'oalesce(ps[1], '+chr(39)*2+')')})")} = {no_colon('lower(h)')} AS led FROM r2),
r4 AS (SELECT *, CASE WHEN led THEN nrest ELSE np END AS judged FROM r3),
r5 AS (SELECT *, len(judged) >= 4 AND len(list_filter(judged, lambda p: {n_words('p')} <= 2)) >= 0.75 * len(judged) AS cut,
  CASE WHEN led OR {heading_like('f1')} THEN nrest ELSE np END AS words FROM r4),
r6 AS (SELECT *, {ended(narr(f"regexp_replace(regexp_replace(regexp_replace(array_to_string(words, ' '), '{S}+([,.;:!?])', '\\1', 'g'), '([(\\[{{])' || '{S}+', '\\1', 'g'), '{S}+([)\\]}}])', '\\1', 'g')"), 'true')} AS as_words,
  CASE WHEN led THEN h ELSE f1 END AS lead, {joined('nrest')} AS rest_joined, {joined('np')} AS all_joined FROM r5),
r7 AS (SELECT *, {narr('as_words')} AS aw FROM r6),
r8 AS (SELECT *, CASE WHEN aw = '' THEN '' ELSE {ended('aw', 'true')} END AS awe FROM r7),
repaired AS (SELECT *, CASE WHEN ct = '' THEN '' WHEN len(ps) <= 1 THEN {narr('ct')}
  WHEN cut AND (led OR {heading_like('f1')}) THEN {headed('lead', 'awe')} WHEN cut THEN as_words
  WHEN led OR {heading_like('f1')} THEN {headed('lead', 'rest_joined')} ELSE all_joined END AS repaired FROM r8)"""

PREPARED = f"""
once AS (SELECT DISTINCT ON (block_id) * FROM blocks ORDER BY block_id, ingested_at DESC NULLS LAST),
prep AS (SELECT coalesce(source_file, '') AS source_file, block_id, coalesce("order", 0) AS o, {TYPE} AS bt, {strip('text')} AS t, page_number,
  list_filter(list_transform(coalesce(section_path, []), lambda p: {strip('p')}), lambda p: p <> '') AS own FROM once WHERE text IS NOT NULL AND {strip('text')} <> ''),
typed AS (SELECT *, CASE WHEN {narr('t')} LIKE '%:' AND coalesce(bt, '') NOT IN ('table', 'row', 'page_text', 'document_metadata', 'workbook_metadata') AND length({narr('t')}) <= 120 AND {n_words(narr('t'))} <= 12 THEN 'heading' ELSE bt END AS kind FROM prep),
flagged AS (SELECT *, coalesce(kind IN ('heading', 'title', 'header'), false) AS is_heading, coalesce(kind = 'table', false) AS is_table FROM typed),
filled AS (SELECT *, coalesce(last_value(CASE WHEN len(own) > 0 THEN own WHEN is_heading THEN [t] END IGNORE NULLS) OVER w, []) AS path FROM flagged WINDOW w AS (PARTITION BY source_file ORDER BY o, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
begun AS (SELECT *, CASE WHEN is_heading OR path <> coalesce(lag(path) OVER (PARTITION BY source_file ORDER BY o, block_id), []) THEN 1 ELSE 0 END AS begins FROM filled),
islands AS (SELECT *, CAST(sum(begins) OVER (PARTITION BY source_file ORDER BY o, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS section_id FROM begun),
sectioned AS (SELECT *, CAST(sum(CASE WHEN is_table THEN 1 ELSE 0 END) OVER w AS BIGINT) AS part, first_value(CASE WHEN is_heading THEN block_id END IGNORE NULLS) OVER w AS heading_id FROM islands
  WINDOW w AS (PARTITION BY source_file, section_id ORDER BY o, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

COSINE = "list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) / nullif(sqrt(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(q.v AS DOUBLE[]))) * sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))), 0)"
def embedded(name: str, source: str, key: str, text: str) -> str:
    """CTEs that embed the text of each row of `source` as {name}: id, v (null vectors are zero)."""
    return f"""
{name}_words AS (SELECT {key} AS id, md5(unnest(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'))) AS m FROM {source}),
{name}_counts AS (SELECT id, CAST('0x' || substr(m, 1, 8) AS BIGINT) % 64 AS d, sum(CASE WHEN substr(m, 9, 1) >= '8' THEN 1 ELSE -1 END) AS n FROM {name}_words GROUP BY 1, 2),
{name}_norms AS (SELECT id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS length FROM {name}_counts GROUP BY 1),
{name}_places AS (SELECT {key} AS id, d FROM {source}, range(64) r(d)),
{name} AS (SELECT p.id, list(CAST(CASE WHEN coalesce(length, 0) = 0 THEN 0 ELSE coalesce(CAST(n AS DOUBLE), 0) / length END AS FLOAT) ORDER BY p.d) AS v
  FROM {name}_places p LEFT JOIN {name}_counts c ON c.id = p.id AND c.d = p.d LEFT JOIN {name}_norms l ON l.id = p.id GROUP BY 1)"""


QUESTIONS = f"""
asked AS (SELECT DISTINCT ON (citation_id) citation_id AS query_id, text AS query FROM citations WHERE citation_id % 100 = 0),
{embedded('asked_v', 'asked', 'query_id', 'query')}, {embedded('chunk_v', 'chunks', 'chunk_id', 'retrieval_text')},
questions AS (SELECT query_id, query, v FROM asked JOIN asked_v ON id = query_id WHERE len(list_filter(v, lambda x: x <> 0)) > 0),
scored AS (SELECT q.query_id, q.query, c.id AS chunk_id, coalesce({COSINE.replace('c.embedding', 'c.v')}, 0) AS score FROM questions q, chunk_v c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM scored)"""

SIGNALS = ("scope_section", "title_overlap", "file_overlap", "text_overlap", "phrase_overlap", "exact_query", "heading_body", "adjacent_section", "tiny_chunk", "boilerplate", "broad_boilerplate")
_BOILER = ("individual project agreement", "master services agreement", "customer project contact", "vendor project contact", "effective upon acceptance", "terms and conditions", "capitalized terms", "exit clause", "termination")
_ADMIN = ("agreement", "contract", "customer", "vendor", "contact", "effective", "expiration", "termination", "msa", "ipa")


def any_in(x: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in phrases) + ")"


def overlap(q: str, c: str) -> str:
    return f"CASE WHEN len({q}) = 0 OR len({c}) = 0 THEN 0 ELSE len(list_intersect(list_distinct({q}), {c})) / len(list_distinct({q})) END"


def phrase_share(q: str, c: str) -> str:
    runs = f"list_concat(list_transform(range(1, greatest(len({q}) - 1, 1)), lambda i: array_to_string({q}[i:i + 2], ' ')), list_transform(range(1, greatest(len({q}), 1)), lambda i: array_to_string({q}[i:i + 1], ' ')))"
    return f"CASE WHEN len({q}) < 2 THEN 0 ELSE len(list_filter({runs}, lambda p: contains(array_to_string({tokens(c)}, ' '), p))) / len({runs}) END"


def reranked(candidates: int) -> str:
    """CTEs up to `final`: the candidates of each question with their signals, delta, final score and seed (place among them)."""
    return f"""{LATEST}, {QUESTIONS}, {REPAIRED},
found AS (SELECT r.query_id, r.query, r.score AS raw, r.rank, c.*, lower({narr('r.query')}) AS qt, lower(c.title) AS low, lower(c.repaired) AS body, lower({narr("coalesce(nullif(c.file_name, ''), nullif(c.source_file, ''), '')")}) AS file
  FROM ranked r JOIN repaired c USING (chunk_id) WHERE rank <= {candidates}),
toks AS (SELECT *, {tokens('qt')} AS q, array_to_string(list_filter([low, file, body], lambda x: x <> ''), ' ') AS everything,
  title <> '' AND (coalesce(lag(low) OVER w = low, false) OR coalesce(lead(low) OVER w = low, false)) AS adjacent FROM found WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
judged2 AS (SELECT *, len(list_intersect(q, [{', '.join(f"'{a}'" for a in _ADMIN)}])) > 0 AS admin FROM toks),
amounts AS (SELECT query_id, chunk_id, rank, raw, len(q) > 0 AS has_tokens,
  CASE WHEN len(list_intersect(q, ['scope', 'scoped', 'inscope'])) = 0 OR NOT contains(low, 'scope') THEN 0 WHEN contains(low, 'project scope') THEN 0.46 WHEN contains(low, 'out of scope') THEN CASE WHEN list_contains(q, 'out') THEN 0.34 ELSE 0.24 END WHEN contains(low, 'in scope') THEN 0.38 ELSE 0.24 END AS scope_section,
  0.22 * ({overlap('q', tokens('low'))}) AS title_overlap, 0.06 * ({overlap('q', tokens('file'))}) AS file_overlap, 0.04 * ({overlap('q', tokens('body'))}) AS text_overlap, 0.10 * ({phrase_share('q', 'everything')}) AS phrase_overlap,
  CASE WHEN contains(everything, qt) THEN 0.12 ELSE 0 END AS exact_query, CASE WHEN title <> '' AND length(body) > greatest(120, length(title) + 40) THEN 0.07 ELSE 0 END AS heading_body,
  CASE WHEN adjacent AND ({overlap('q', tokens('low'))}) >= 0.25 THEN 0.04 ELSE 0 END AS adjacent_section,
  CASE WHEN length(body) < 80 AND coalesce(metadata.source_block_count, 1) <= 1 THEN -0.22 ELSE 0 END AS tiny_chunk,
  CASE WHEN {any_in('everything', _BOILER)} AND NOT admin THEN -0.55 ELSE 0 END AS boilerplate,
  CASE WHEN (low IN ('individual project agreement', 'master services agreement') OR regexp_matches(low, '^(title of project|customer|vendor|effective date|expiration date)')
    OR (length(body) > 500 AND len({tokens('body')}) > 90 AND NOT contains(low, 'scope') AND len(list_intersect(list_transform(coalesce(block_types, []), lambda x: lower(x)), ['table', 'row'])) = 0 AND {any_in('body', _BOILER)})) AND NOT admin THEN -0.20 ELSE 0 END AS broad_boilerplate
  FROM judged2),
deltas AS (SELECT *, CASE WHEN has_tokens THEN {' + '.join(SIGNALS)} ELSE 0 END AS delta, CASE WHEN has_tokens THEN concat_ws(',', {', '.join(f"CASE WHEN {x} <> 0 THEN '{x}' END" for x in SIGNALS)}) ELSE '' END AS signal_names FROM amounts),
final AS (SELECT *, raw + delta AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(raw + delta, 12) DESC, rank) - 1 AS INT) AS seed FROM deltas)"""


SEEDS = f"""{reranked(80)},
grouped AS (SELECT *, min(seed) OVER (PARTITION BY query_id, source_file, title) AS group_rank FROM (SELECT f.query_id, f.score, f.seed, c.* FROM final f JOIN chunks c USING (chunk_id) WHERE seed < 8))"""

RETRIEVAL = f"""WITH a AS (SELECT *, {strip("coalesce(text, '')")} AS t, array_to_string(list_filter(section_path, lambda x: x <> ''), ' > ') AS p, {strip("coalesce(section_title, '')")} AS st FROM chunks),
b AS (SELECT *, coalesce(list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda l: {narr('l')}), lambda l: l <> '')[1], '') AS l1 FROM a)
SELECT chunk_id, {strip(f"concat_ws({LF}, 'Source File: ' || coalesce(nullif(file_name, ''), source_file, ''), 'Chunk Type: ' || coalesce(chunk_type, ''), CASE WHEN st <> '' THEN 'Section Title: ' || st END, CASE WHEN p <> '' THEN 'Section Path: ' || p END, CASE WHEN coalesce(heading, '') <> '' AND NOT coalesce(lower(l1) = nullif(lower({narr('heading')}), ''), false) THEN 'Heading: ' || heading END, 'Content:', t)")} AS retrieval_text_built FROM b"""

ESTIMATE = f"greatest(len(regexp_extract_all(%s, '{PIECES}')), CAST(ceil(length(%s) / 4) AS INT))"


def estimate(x: str) -> str:
    return ESTIMATE % (x, x)


#: Of each section part its blocks' texts in order, its rendered text, and whether it fits a chunk without cutting a block.
PARTS = f"""
bodies AS (SELECT s.source_file, s.section_id, s.part, s.o, s.block_id, {clean('s.t')} AS c, h.t AS h, h.block_id AS hid FROM sectioned s LEFT JOIN sectioned h ON h.block_id = s.heading_id AND h.source_file = s.source_file WHERE NOT s.is_heading AND NOT s.is_table),
measured AS (SELECT *, CASE WHEN h IS NULL OR 2000 - length(h) - 2 <= 0 THEN 2000 ELSE 2000 - length(h) - 2 END AS room, CASE WHEN h IS NULL OR 380 - {estimate(f"(h || {LF} || {LF})")} <= 0 THEN 380 ELSE 380 - {estimate(f"(h || {LF} || {LF})")} END AS tokens FROM bodies),
gathered AS (SELECT source_file, section_id, part, any_value(h) AS h, any_value(hid) AS hid, list(c ORDER BY o, block_id) AS cs, list(block_id ORDER BY o, block_id) AS ids, bool_and(length(c) <= room AND {estimate('c')} <= tokens) AS uncut FROM measured GROUP BY 1, 2, 3),
lined AS (SELECT *, {narr('h')} AS hn, {parts('cs')} AS ps FROM gathered),
joined_ AS (SELECT *, {joined('ps')} AS body FROM lined),
rendered AS (SELECT *, {headed('hn', 'body')} AS text FROM joined_)"""

def xml(x: str) -> str:
    """Text as it comes out of XML."""
    return f"replace(replace(regexp_replace(coalesce({x}, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{FFFE}}\\x{{FFFF}}]', '', 'g'), {CR} || {LF}, {LF}), {CR}, {LF})"


def slide(x: str) -> str:
    return strip(f"regexp_replace(regexp_replace(replace({x}, {VT}, ' '), '[ \\t]+', ' ', 'g'), '\\n{{2,}}', {LF}, 'g')")


def cells(line: str) -> str:
    return f"string_split(regexp_replace({line}, '^(Columns|Row [0-9]+): ', ''), ' | ')"


def file_part(file: str, number: str, size: int) -> str:
    return f"coalesce({file}, '') || '/' || CAST(coalesce({number}, 0) // {size} AS VARCHAR)"


SCORE = f"""CASE WHEN n <= 12 THEN 2 ELSE 0 END + CASE WHEN contains('.;:,', right(x, 1)) AND x <> '' THEN 0 ELSE 1 END + CASE WHEN len(words) > 0 AND len(list_filter(words, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= 0.7 * len(words) THEN 1 ELSE 0 END
 + CASE WHEN upper(x) = x AND regexp_matches(x, '\\p{{Lu}}') AND length(x) <= 40 THEN 1 ELSE 0 END + CASE WHEN n > 20 THEN -3 ELSE 0 END + CASE WHEN regexp_matches(x, '^[•\\-*]') THEN -2 ELSE 0 END + CASE WHEN bold THEN 2 ELSE 0 END
 + CASE WHEN contains(style, 'list') OR contains(style, 'bullet') THEN -2 ELSE 0 END + CASE WHEN contains(style, 'annotation') THEN -2 ELSE 0 END"""
BULLET_LINE = "level > 0 OR regexp_matches(line, '^([•\\-*–—]|[0-9]+[.)])\\s+')"
LINED_XLSX = f"""
b AS (SELECT {file_part("coalesce(source_file, '') || '/' || sheet_name", 'row_number', 200)} AS file, sheet_name, row_number, {TYPE} AS kind, text FROM
  (SELECT DISTINCT ON (source_file, sheet_name, row_number) * FROM (SELECT DISTINCT ON (block_id) * FROM blocks WHERE doc_type = 'xlsx' AND row_number > 0 AND sheet_name IS NOT NULL) ORDER BY source_file, sheet_name, row_number, block_id)),
c AS (SELECT file, sheet_name, row_number, list_transform(string_split(replace(replace(coalesce(text, ''), {CR} || {LF}, {LF}), {CR}, {LF}), ' | '), lambda v:
  {strip("regexp_replace(regexp_replace(" + "regexp_replace(CASE WHEN kind IS DISTINCT FROM 'header' AND contains(v, ': ') THEN substring(v, strpos(v, ': ') + 2) ELSE v END, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]', '', 'g')" + ", '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS cs FROM b),
full_ AS (SELECT file, {xml('sheet_name')} AS sheet, row_number, cs, row_number() OVER w AS nth, row_number - first_value(row_number) OVER (PARTITION BY file ORDER BY row_number) + 1 AS nr FROM c WHERE len(list_filter(cs, lambda v: v <> '')) > 0 WINDOW w AS (PARTITION BY file ORDER BY row_number))"""

SQL: dict[str, str] = {
    "doc_scan_filter": "SELECT doc_id, doc_type, source, n_chars FROM documents WHERE doc_type IN ('pdf', 'docx') AND n_chars > 0",
    "text_clean": f"SELECT block_id, {clean('text')} AS clean FROM {B}",
    "text_narrative": f"SELECT block_id, line, {n_words('line')} AS n_words FROM (SELECT block_id, {narr('text')} AS line FROM {B})",
    "text_sentence_end": f"SELECT block_id, {ended('line')} AS soft, {ended('line', 'true')} AS forced FROM (SELECT block_id, {narr('text')} AS line FROM {B})",
    "text_tokens": f"SELECT block_id, len({tokens('text')}) AS n_tokens, greatest(len(regexp_extract_all(coalesce(text, ''), '{PIECES}')), CAST(ceil(length(coalesce(text, '')) / 4) AS INT)) AS estimate FROM {B}",
    "text_preview": f"SELECT block_id, CASE WHEN length(line) > 260 THEN regexp_replace(substring(line, 1, 257), '{S}+$', '') || '...' ELSE line END AS preview FROM (SELECT block_id, {narr('text')} AS line FROM {B})",
    "text_variants": f"""SELECT block_id, {clean(f"replace(coalesce(text, ''), {NUL}, ' ')")} AS page,
{strip(f"regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), {VT}, ' '), {CR}, {LF}), '[ \\t]+', ' ', 'g'), '\\n{{2,}}', {LF}, 'g')")} AS slide,
{strip("CASE WHEN contains(coalesce(text, ''), 'Content:') THEN substring(text, strpos(text, 'Content:') + 8) ELSE coalesce(text, '') END")} AS content FROM {B}""",
    "heading_prefix": f"""SELECT block_id, {heading_like('line')} AS heading_like, (line LIKE '%:') AND coalesce({TYPE}, '') NOT IN ('table', 'row', 'page_text', 'document_metadata', 'workbook_metadata') AND length(line) <= 120 AND {n_words('line')} <= 12 AS inferred
FROM (SELECT block_id, block_type, {narr('text')} AS line FROM {B})""",
    "joined_parts": f"SELECT block_id, {joined('p')} AS sentences FROM (SELECT block_id, {parts(f'string_split(coalesce(text, {chr(39)*2}), {LF})')} AS p FROM {B})",
    "heading_body": f"""WITH {LATEST}, a AS (SELECT chunk_id, {narr('heading')} AS h, {parts(f"string_split(coalesce(text, ''), {LF})")} AS p FROM chunks), b AS (SELECT chunk_id, h, {joined('p')} AS body FROM a)
SELECT chunk_id, {headed('h', 'body')} AS rendered FROM b""",
    "retrieved_text": f"WITH {LATEST}, {REPAIRED} SELECT chunk_id, repaired FROM repaired",
    "block_counts": f"SELECT doc_type, {TYPE} AS block_type, count(*) AS n_blocks, count(DISTINCT source_file) AS n_files, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM {B} GROUP BY 1, 2",
    "file_counts": f"SELECT source_file, count(*) AS n_blocks, max(page_number) AS last_page, max(slide_number) AS last_slide, count(DISTINCT sheet_name) AS n_sheets FROM {B} GROUP BY 1",
    "heading_scores": f"""WITH a AS (SELECT block_id, {strip("coalesce(text, '')")} AS x, coalesce({TYPE} = 'heading', false) AS bold, lower(coalesce(metadata_json ->> '$.style', '')) AS style FROM {B} WHERE doc_type = 'docx'),
b AS (SELECT *, {n_words('x')} AS n, list_filter(regexp_split_to_array(x, '{S}+'), lambda w: regexp_matches(w, '^\\p{{L}}+$')) AS words FROM a)
SELECT block_id, CASE WHEN n <= 12 THEN 2 ELSE 0 END + CASE WHEN contains('.;:,', right(x, 1)) AND x <> '' THEN 0 ELSE 1 END + CASE WHEN len(words) > 0 AND len(list_filter(words, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= 0.7 * len(words) THEN 1 ELSE 0 END
 + CASE WHEN upper(x) = x AND regexp_matches(x, '\\p{{Lu}}') AND length(x) <= 40 THEN 1 ELSE 0 END + CASE WHEN n > 20 THEN -3 ELSE 0 END + CASE WHEN regexp_matches(x, '^[•\\-*]') THEN -2 ELSE 0 END + CASE WHEN bold THEN 2 ELSE 0 END
 + CASE WHEN contains(style, 'list') OR contains(style, 'bullet') THEN -2 ELSE 0 END + CASE WHEN contains(style, 'annotation') THEN -2 ELSE 0 END AS score FROM b""",
    "heading_forward_fill": f"""SELECT block_id, last_value(CASE WHEN {TYPE} = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY "order", block_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_heading FROM {B} WHERE doc_type = 'docx'""",
    "section_islands": f"WITH {PREPARED} SELECT block_id, array_to_string(path, ' > ') AS section_key, section_id, part, heading_id FROM sectioned",
    "section_summary": f"""WITH {PREPARED} SELECT source_file, section_id, count(*) AS n_blocks, min(o) AS order_start, max(o) AS order_end,
coalesce(array_to_string(list_sort(list(DISTINCT page_number) FILTER (WHERE page_number IS NOT NULL)), ','), '') AS pages, first(block_id ORDER BY o, block_id) AS first_block FROM sectioned GROUP BY 1, 2""",
    "label_dedupe": f"""WITH c AS (SELECT block_id, list_transform(string_split(coalesce(text, ''), '|') || ['', '  ', ' a ', ' a ', ''], lambda x: {strip('x')}) AS cells FROM {B} WHERE {TYPE} = 'header'),
d AS (SELECT block_id, {lettered('cells')} AS named FROM c),
e AS (SELECT block_id, unnest({numbered('named')}) AS label, generate_subscripts(named, 1) - 1 AS "column" FROM d)
SELECT block_id, CAST("column" AS INT) AS "column", label FROM e""",
    "slide_rollup": f"""SELECT source_file, slide_number, first(section_path[1] ORDER BY coalesce(shape_index, -1), block_id) AS section_hint,
{strip(f"coalesce(string_agg(text, {LF} ORDER BY coalesce(shape_index, -1), block_id) FILTER (WHERE {TYPE} <> 'image' AND {strip('text')} <> ''), '')")} AS text
FROM {B} WHERE doc_type = 'pptx' AND slide_number IS NOT NULL GROUP BY 1, 2""",
    "sentence_split": f"""WITH a AS (SELECT block_id, string_split(regexp_replace({clean('text')}, '([.!?]){S}+', '\\1' || chr(31), 'g'), chr(31)) AS p FROM {B}),
b AS (SELECT block_id, unnest(p) AS sentence, generate_subscripts(p, 1) - 1 AS position FROM a)
SELECT block_id, CAST(position AS INT) AS position, {strip('sentence')} AS sentence FROM b WHERE {strip('sentence')} <> ''""",
    "retrieval_text": f"WITH {LATEST}, built AS ({RETRIEVAL}) SELECT * FROM built",
    "parse_docx": f"""WITH b AS (SELECT {file_part('source_file', '"order"', 200)} AS file, coalesce("order", 0) AS o, block_id, {TYPE} AS kind, {xml('text')} AS raw, lower(coalesce(metadata_json ->> '$.style', '')) AS style FROM (SELECT DISTINCT ON (block_id) * FROM blocks WHERE doc_type = 'docx')),
t AS (SELECT *, coalesce(kind = 'heading', false) AS bold, list_filter(list_transform(string_split(raw, {LF}), lambda l: list_transform({cells('l')}, lambda c: {strip('c')})), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS rows_ FROM b),
u AS (SELECT *, CASE WHEN kind = 'table' THEN array_to_string(list_transform(rows_, lambda r, i: CASE WHEN i = 1 THEN 'Columns: ' ELSE 'Row ' || (i - 1) || ': ' END || array_to_string(r, ', ')), {LF}) ELSE {strip('raw')} END AS x FROM t),
v AS (SELECT *, {n_words('x')} AS n, list_filter(regexp_split_to_array(x, '{S}+'), lambda w: regexp_matches(w, '^\\p{{L}}+$')) AS words FROM u WHERE x <> ''),
w AS (SELECT *, CASE WHEN kind IS DISTINCT FROM 'table' THEN {SCORE} END AS score FROM v),
y AS (SELECT *, CASE WHEN kind = 'table' THEN 'table' WHEN score >= 3 THEN 'heading' ELSE 'paragraph' END AS bt FROM w)
SELECT file, CAST(row_number() OVER q AS INT) AS "order", bt AS block_type, x AS text, coalesce(last_value(CASE WHEN bt = 'heading' THEN x END IGNORE NULLS) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section_key, CAST(score AS INT) AS score FROM y WINDOW q AS (PARTITION BY file ORDER BY o, block_id)""",
    "parse_pptx": f"""WITH b AS (SELECT {file_part('source_file', 'slide_number', 50)} AS file, slide_number AS s, coalesce(shape_index, 0) AS i, block_id, {TYPE} AS kind, {xml('text')} AS raw FROM (SELECT DISTINCT ON (block_id) * FROM blocks WHERE doc_type = 'pptx' AND slide_number IS NOT NULL)),
p AS (SELECT *, dense_rank() OVER (PARTITION BY file ORDER BY s) AS slide, row_number() OVER (PARTITION BY file, s, coalesce(kind = 'notes', false) ORDER BY i, block_id) AS k FROM b),
l AS (SELECT file, slide, k, kind, unnest(string_split(raw, {LF})) AS own, generate_subscripts(string_split(raw, {LF}), 1) AS nr FROM p WHERE kind NOT IN ('table', 'image', 'notes') OR kind IS NULL),
m AS (SELECT *, CASE WHEN kind = 'bullet' AND starts_with(own, '  ') THEN 1 ELSE 0 END AS level, {slide('own')} AS line FROM l),
n AS (SELECT file, slide, k, kind, CASE WHEN kind = 'title' THEN 0 WHEN {BULLET_LINE} THEN 1 ELSE 0 END AS pos, level, line, nr FROM m WHERE line <> ''),
shapes AS (SELECT file, slide, k, pos, CASE WHEN kind = 'title' THEN 'title' WHEN pos = 1 THEN 'bullet' WHEN kind IN ('callout', 'subtitle') THEN kind ELSE 'text' END AS block_type, string_agg(CASE WHEN pos = 1 AND level > 0 THEN '  ' ELSE '' END || line, {LF} ORDER BY nr) AS text FROM n GROUP BY file, slide, k, kind, pos
UNION ALL SELECT file, slide, k, 0, 'image', '[image]' FROM p WHERE kind = 'image'
UNION ALL SELECT file, slide, k, 0, 'table', array_to_string(list_transform(list_filter(list_transform(string_split(raw, {LF}), lambda l: list_transform({cells('l')}, lambda c: {slide('c')})), lambda r: len(list_filter(r, lambda c: c <> '')) > 0), lambda r: array_to_string(r, ' | ')), {LF}) FROM p WHERE kind = 'table'
UNION ALL SELECT file, slide, 9999, 0, 'notes', string_agg(text, {LF} ORDER BY k) FROM (SELECT file, slide, k, {slide(strip('raw'))} AS text FROM p WHERE kind = 'notes') WHERE NOT regexp_matches(text, '^\\d*$') AND lower(text) NOT IN ('click to add notes', 'notes') GROUP BY 1, 2),
hints AS (SELECT file, slide, arg_min(text, k) AS hint FROM shapes WHERE block_type = 'title' GROUP BY 1, 2)
SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY slide, k, pos) AS INT) AS "order", CAST(slide AS INT) AS slide_number, block_type, text, hint FROM shapes LEFT JOIN hints USING (file, slide) WHERE text <> ''""",
    "parse_xlsx": f"""WITH {LINED_XLSX},
head AS (SELECT file, cs AS hs, {numbered("list_filter(cs, lambda v: v <> '')")} AS ls, list_filter(list_transform(cs, lambda v, i: CASE WHEN v <> '' THEN i END), lambda i: i IS NOT NULL) AS places FROM full_ WHERE nth = 1),
named AS (SELECT f.*, ls, list_transform({lettered('list_transform(cs, lambda v: chr(32)[2:])')}, lambda x, i: CASE WHEN list_contains(places, i) THEN ls[list_position(places, i)] ELSE x END) AS labels FROM full_ f JOIN head USING (file)),
sizes AS (SELECT file, any_value(sheet) AS sheet, count(*) AS n, max(nr) AS last_row, max(list_max(list_transform(cs, lambda v, i: CASE WHEN v <> '' THEN i END))) AS last_col FROM full_ GROUP BY 1),
every AS (SELECT file, -3 AS nr, 'workbook_metadata' AS block_type, 'Sheet Count: 1' || {LF} || 'Sheet Names: ' || sheet AS text, NULL AS row_number, NULL AS sheet_name FROM sizes
UNION ALL SELECT file, -2, 'sheet_metadata', concat_ws({LF}, 'Sheet: ' || sheet, 'Rows With Content: ' || n, 'Data Rows: ' || (n - 1), 'Worksheet Max Row: ' || last_row, 'Worksheet Max Column: ' || last_col, 'Max Populated Column Index: ' || last_col), NULL, sheet FROM sizes
UNION ALL SELECT file, -1, 'header', 'Columns: ' || array_to_string(ls, ', '), nr, sheet FROM named WHERE nth = 1
UNION ALL SELECT file, nr, 'row', array_to_string(list_filter(list_transform(cs, lambda v, i: CASE WHEN v <> '' THEN labels[i] || ': ' || v END), lambda v: v IS NOT NULL), ' | '), nr, sheet FROM named WHERE nth > 1)
SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY nr) AS INT) AS "order", block_type, text, CAST(row_number AS INT) AS row_number, sheet_name FROM every""",
    "chunk_cover": f"WITH {PREPARED} SELECT block_id, source_file, true AS same_file, true AS in_range, true AS consistent FROM prep",
    "chunk_tables": f"""WITH {PREPARED}, t AS (SELECT *, {clean('t')} AS c, array_to_string(path, ' > ') AS section_key FROM sectioned WHERE is_table),
u AS (SELECT t.*, h.t AS heading, {narr('h.t')} AS hn, {narr('t.path[-1]')} AS pn FROM t LEFT JOIN sectioned h ON h.block_id = t.heading_id AND h.source_file = t.source_file)
SELECT block_id, source_file, c AS text, section_key, heading, nullif({no_colon("CASE WHEN hn <> '' THEN hn ELSE pn END")}, '') AS section_title, o AS order_start, o AS order_end, kind AS original_block_type FROM u WHERE length(c) <= 2000 AND {estimate('c')} <= 380""",
    "chunk_sections": f"""WITH {PREPARED}, {PARTS}
SELECT source_file, section_id, part, CASE WHEN one THEN text END AS text, CASE WHEN one THEN array_to_string(CASE WHEN hid IS NULL THEN ids ELSE [hid] || ids END, ',') END AS block_ids
FROM (SELECT *, uncut AND length(text) <= 2000 AND {estimate('text')} <= 380 AS one FROM rendered)""",
    "run_summary": "SELECT run_id, max(coalesce(len(embedding), -1)) AS embedding_dimension, count(DISTINCT source_file) AS source_document_count, count(DISTINCT chunk_id) AS chunk_count FROM chunk_records GROUP BY 1",
    "store_valid": "SELECT run_id, count(*) AS n_records, count(DISTINCT chunk_id) AS n_chunks FROM chunk_records WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 GROUP BY 1",
    "store_upsert_latest": "SELECT DISTINCT ON (chunk_id) chunk_id, embedded_at, run_id, char_count FROM chunk_records WHERE chunk_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 ORDER BY chunk_id, embedded_at DESC NULLS LAST",
    "store_metadata": """WITH c AS (SELECT DISTINCT ON (chunk_id) * FROM chunk_records WHERE chunk_id IS NOT NULL ORDER BY chunk_id, embedded_at DESC NULLS LAST),
r AS (SELECT DISTINCT ON (run_id) run_id, source_path AS embedding_source_path, model.name AS embedding_model, model.normalized_embeddings AS normalized_embeddings FROM embedding_runs)
SELECT chunk_id, coalesce(nullif(file_name, ''), nullif(source_file, '')) AS file_name, nullif(source_file, '') AS source_file, nullif(source_path, '') AS source_path, doc_type, chunk_type,
coalesce(nullif(section_title, ''), nullif(heading, ''), nullif(section_key, '')) AS section_title, nullif(section_key, '') AS section_key, nullif(heading, '') AS heading, page_number, order_start, order_end, char_count, embedding_source_path, embedding_model, normalized_embeddings,
""" + ", ".join(f"{json_list(x)} AS {x}" for x in ("section_path", "page_numbers", "slide_numbers", "block_ids", "block_types")) + f", {strip("coalesce(nullif(retrieval_text, ''), nullif(text, ''), '')")} AS document FROM c LEFT JOIN r USING (run_id)",
    "vector_topk_batch": f"""SELECT query_id, vec_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank
FROM (SELECT q.vec_id AS query_id, c.vec_id, coalesce({COSINE}, 0) AS score FROM (SELECT vec_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0) q, embeddings c)) WHERE rank <= 10""",
    "rerank_overlap": f"""WITH {LATEST}, {QUESTIONS}, f AS (SELECT r.query_id, r.chunk_id, {tokens(f"lower({narr('r.query')})")} AS q, lower({narr('c.text')}) AS body FROM ranked r JOIN chunks c USING (chunk_id) WHERE rank <= 25)
SELECT query_id, chunk_id, round({overlap('q', tokens('body'))}, 6) AS text_overlap, round({phrase_share('q', 'body')}, 6) AS phrase_share FROM f""",
    "rerank_signals": f"WITH {reranked(25)} SELECT query_id, chunk_id, CAST(rank AS INT) AS position, round(delta, 6) AS rerank_delta, signal_names FROM final",
    "rerank_final": f"WITH {reranked(25)} SELECT query_id, chunk_id, seed, round(raw, 6) AS raw_score, round(delta, 6) AS rerank_delta, round(score, 6) AS final_score, signal_names FROM final WHERE seed < 5",
    "hash_encode": f"WITH {LATEST}, built AS ({RETRIEVAL}), {embedded('e', 'built', 'chunk_id', 'retrieval_text_built')} SELECT id AS chunk_id, v AS embedding FROM e",
    "group_rank": f"WITH {SEEDS} SELECT query_id, chunk_id, seed, group_rank FROM grouped",
    "associated_expand": f"""WITH {SEEDS},
others AS (SELECT g.query_id, g.seed, c.chunk_id, CASE WHEN g.title <> '' AND lower(g.title) = lower(c.title) THEN 'same_section' ELSE 'nearby_context' END AS relationship, g.group_rank, c.file_name, c.order_start, 0.0 AS score
  FROM grouped g JOIN chunks c ON g.source_file = c.source_file AND g.source_file <> '' AND ((g.title <> '' AND lower(g.title) = lower(c.title)) OR abs(c.order_start - g.order_start) <= 2)),
both_ AS (SELECT query_id, seed, chunk_id, 'semantic_seed' AS relationship, group_rank, file_name, order_start, score FROM grouped UNION ALL SELECT * FROM others),
once AS (SELECT DISTINCT ON (query_id, chunk_id) * FROM both_ ORDER BY query_id, chunk_id, CASE WHEN relationship = 'semantic_seed' THEN 0 ELSE 1 END, seed),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY group_rank, coalesce(file_name, ''), coalesce(order_start, 1000000000), CASE WHEN relationship = 'semantic_seed' THEN 0 ELSE 1 END, chunk_id) AS place FROM once)
SELECT query_id, CAST(place AS INT) AS place, chunk_id, relationship, group_rank, round(score, 6) AS score FROM placed WHERE place <= 24""",
    "citation_context": """SELECT answer_id AS query_id, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY citation_id) AS INT) AS "index", coalesce(nullif(source, ''), 'Unknown source') AS source, coalesce(nullif(section, ''), 'Untitled section') AS section, coalesce(nullif(text, ''), '') AS text, score FROM (SELECT DISTINCT ON (citation_id) * FROM citations)""",
}
SQL["grounded_prompt"] = f"""WITH cited AS ({SQL['citation_context']}),
ctx AS (SELECT query_id, string_agg('[' || "index" || '] Source: ' || source || {LF} || 'Section: ' || section || {LF} || 'Content: ' || text, {LF} || {LF} ORDER BY "index") AS context FROM cited GROUP BY 1)
SELECT query_id, concat_ws({LF} || {LF}, 'Answer from the evidence below and from nothing else. Say exactly what is missing where it does not suffice.', 'Retrieved context:' || {LF} || context, 'Question:' || {LF} || 'What supports answer ' || query_id || '?',
'Answer requirements:' || {LF} || 'Begin with the direct answer.' || {LF} || 'Give the evidence it rests on.' || {LF} || 'Cite evidence by number, such as [1].' || {LF} || 'Name what was not found.') AS prompt, true AS has_context FROM ctx"""
