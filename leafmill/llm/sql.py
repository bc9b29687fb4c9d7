"""The same results in SQL, for the queries of this subpackage that SQL can express on whole tables."""

_PAGES = r"""
pages AS (SELECT DISTINCT ON (block_id) block_id, source_file, page_number, text FROM blocks
  WHERE doc_type = 'pdf' AND lower(trim(block_type, ' ' || chr(9) || chr(10) || chr(13))) = 'page_text'),
every_line AS (SELECT block_id, source_file, page_number, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM pages WHERE text IS NOT NULL),
keyed AS (SELECT *, regexp_replace(lower(line), '[^\p{L}]', '', 'g') AS letters FROM every_line),
sizes AS (SELECT source_file, count(DISTINCT page_number) AS file_pages FROM pages GROUP BY source_file),
often AS (SELECT k.source_file, letters, count(DISTINCT page_number) AS n_pages, any_value(file_pages) AS file_pages
  FROM keyed k JOIN sizes s ON k.source_file IS NOT DISTINCT FROM s.source_file WHERE letters <> '' GROUP BY k.source_file, letters
  HAVING count(DISTINCT page_number) >= 5 AND count(DISTINCT page_number) * 100 >= 30 * any_value(file_pages)),
gone AS (SELECT k.*, n_pages, file_pages FROM keyed k JOIN often o ON k.source_file IS NOT DISTINCT FROM o.source_file AND k.letters = o.letters)
"""

SQL = {
    "p1_found": f"WITH {_PAGES} SELECT block_id, CAST(line_no AS INT) AS line_no FROM gone",
    "p1_lines": f"WITH {_PAGES} SELECT source_file, min(line) AS line, max(n_pages) AS n_pages, max(file_pages) AS file_pages FROM gone GROUP BY source_file, letters",
    "p1_clean": f"""WITH {_PAGES},
kept AS (SELECT k.block_id, coalesce(string_agg(k.line, chr(10) ORDER BY k.line_no) FILTER (WHERE g.line_no IS NULL), '') AS text, CAST(count(g.line_no) AS INT) AS n_removed
  FROM keyed k LEFT JOIN gone g ON k.block_id = g.block_id AND k.line_no = g.line_no GROUP BY k.block_id)
SELECT p.block_id, kept.text, coalesce(n_removed, 0) AS n_removed FROM pages p LEFT JOIN kept ON p.block_id = kept.block_id""",
    "p3_found": r"""SELECT DISTINCT block_id FROM blocks b JOIN chunk_limits l ON b.doc_type = l.doc_type
WHERE length(regexp_replace(text, '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '', 'g')) > max_chars""",
    "p3_joined": r"""WITH b AS (SELECT DISTINCT block_id, doc_type, regexp_replace(text, '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '', 'g') AS t FROM blocks)
SELECT block_id, md5(t) AS digest, true AS within, true AS whole FROM b JOIN chunk_limits l ON b.doc_type = l.doc_type WHERE length(t) > max_chars""",
    "p6_found": r"""WITH records AS (SELECT DISTINCT 'block' AS rec_kind, block_id AS id, text FROM blocks WHERE coalesce(doc_type, '') <> 'xlsx' AND text IS NOT NULL
UNION SELECT DISTINCT 'chunk', chunk_id, retrieval_text FROM chunk_records WHERE coalesce(doc_type, '') <> 'xlsx' AND chunk_id IS NOT NULL AND retrieval_text IS NOT NULL),
worded AS (SELECT rec_kind, id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM records),
each AS (SELECT DISTINCT rec_kind, id, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS shingle FROM (SELECT rec_kind, id, w, unnest(range(1, len(w) - 1)) AS p FROM worded WHERE len(w) >= 20)),
sized AS (SELECT rec_kind, id, count(*) AS n FROM each GROUP BY ALL),
shared AS (SELECT a.rec_kind, a.id AS id_a, b.id AS id_b, count(*) AS s FROM each a JOIN each b ON a.rec_kind = b.rec_kind AND a.shingle = b.shingle AND a.id < b.id GROUP BY ALL)
SELECT s.rec_kind, id_a, id_b FROM shared s JOIN sized x ON x.rec_kind = s.rec_kind AND x.id = id_a JOIN sized y ON y.rec_kind = s.rec_kind AND y.id = id_b
WHERE s * 10 >= 6 * (x.n + y.n - s)""",
    "p8_found": r"""WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
ig AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM iw WHERE len(w) >= 12)),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM dw WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (run)""",
    "p8_passages": r"""WITH iw AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dw AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
ig AS (SELECT item_id, p, array_to_string(w[p:p + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM iw WHERE len(w) >= 12)),
dg AS (SELECT doc_id, p, array_to_string(w[p:p + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM dw WHERE len(w) >= 12)),
hits AS (SELECT doc_id, item_id, dg.p AS at_, dg.p - ig.p AS shift FROM dg JOIN ig USING (run)),
islands AS (SELECT *, at_ - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY at_) AS island FROM hits),
lengths AS (SELECT doc_id, item_id, count(*) + 11 AS n FROM islands GROUP BY doc_id, item_id, shift, island)
SELECT item_id, count(DISTINCT doc_id) AS n_documents, CAST(max(n) AS INT) AS longest_run FROM lengths GROUP BY 1""",
    "p6_groups": r"""WITH RECURSIVE records AS (SELECT DISTINCT 'block' AS kind, block_id AS id, text FROM blocks WHERE block_id IS NOT NULL UNION SELECT DISTINCT 'chunk', chunk_id, retrieval_text FROM chunk_records WHERE chunk_id IS NOT NULL),
worded AS (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM records),
each AS (SELECT DISTINCT kind, id, array_to_string(w[p:p + 4], ' ') AS shingle FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS p FROM worded WHERE len(w) >= 5)),
sized AS (SELECT kind, id, count(*) AS n FROM each GROUP BY ALL),
shared AS (SELECT a.kind, a.id AS a, b.id AS b, count(*) AS s FROM each a JOIN each b ON a.kind = b.kind AND a.shingle = b.shingle AND a.id <> b.id GROUP BY ALL),
short AS (SELECT kind, id, CASE WHEN len(w) = 0 THEN 'text ' || text ELSE 'words ' || array_to_string(w, ' ') END AS key FROM worded WHERE text IS NOT NULL AND len(w) < 5),
links AS MATERIALIZED (SELECT s.kind, a, b FROM shared s JOIN sized x ON x.kind = s.kind AND x.id = a JOIN sized y ON y.kind = s.kind AND y.id = b WHERE s * 10 >= 8 * (x.n + y.n - s)
  UNION ALL SELECT x.kind, x.id, y.id FROM short x JOIN short y ON x.kind = y.kind AND x.key = y.key AND x.id <> y.id),
reach(kind, id, other) AS (SELECT kind, id, id FROM records UNION SELECT r.kind, r.id, l.b FROM reach r JOIN links l ON l.kind = r.kind AND l.a = r.other)
SELECT g.kind, g.id, g.group_id, coalesce(n, 0) AS n_links FROM (SELECT kind, id, min(other) AS group_id FROM reach GROUP BY 1, 2) g LEFT JOIN (SELECT kind, a, count(*) AS n FROM links GROUP BY 1, 2) c ON c.kind = g.kind AND c.a = g.id""",
}
