"""DuckDB SQL for the round trips in catalog_io.py: what went in, as it is to come out."""

from __future__ import annotations

from .oracles import ANNOTATIONS, CARDS, LABELS, ORACLES as BASE, SENTENCES, _html

_TWO = """
    c AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 9 != 0),
    two AS (SELECT n_name AS company, n_name AS company_display, lower(n_name) AS company_slug, (2000 + c_custkey % 5)::BIGINT AS year, 'ai' AS ai_term, 'A' AS coder, 'Ann' AS coder_name,
                   'said We, ' || c_name || chr(10) || '2' AS sentence, 'Risk Mitigation' AS kind, 'IP' AS subcategory, (c_custkey % 3)::BIGINT AS strength FROM c WHERE c_custkey % 4 != 0
            UNION ALL SELECT n_name, n_name, lower(n_name), (2000 + c_custkey % 5)::BIGINT, 'ai', 'B', '', 'b ' || c_name, 'Risk', '', NULL FROM c WHERE c_custkey % 6 != 0)"""

_RUNS = "runs AS (SELECT lower(n_name) || '_2024' AS doc_id, unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['v1', 'v2'] ELSE ['v1'] END) AS version_id FROM nation)"
_HITS = BASE["keyword_hits"]
_ROWS = BASE["annotation_rows"]

ORACLES = {
    "taxonomy_file": """SELECT 'Risk' AS kind, n_name AS category, 's' || n_regionkey AS subcategory, 'a "b",' || chr(10) || n_name AS description FROM nation WHERE n_nationkey % 5 != 0""",
    "rubric_file": "SELECT r_regionkey::BIGINT AS strength, r_name AS reason FROM region",
    "assumptions_file": "SELECT r_name AS assumption FROM region",
    "keywords_file": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS place, lower(n_name) AS term FROM nation WHERE n_nationkey % 4 != 0",
    "two_coder_rows": f"WITH {_TWO} SELECT * FROM two",
    "human_for_doc": f"WITH {_TWO} SELECT company, year, coder, sentence FROM two QUALIFY dense_rank() OVER (ORDER BY company_slug, year) = 1",
    "group_sizes": f"WITH {_TWO} SELECT company_slug, year, coder, count(*) AS n FROM two GROUP BY ALL",
    "feedback_files": """SELECT *, row_number() OVER (ORDER BY (regexp_extract(anchor_id, '[0-9]+'))::INT) - 1 AS place FROM (
        SELECT n_name AS reviewer, 's-' || n_nationkey AS anchor_id, 'Human Miss' AS decision, '' AS explanation FROM nation WHERE n_nationkey < 12 AND n_nationkey % 3 != 0
        UNION ALL SELECT '', 's-' || n_nationkey, 'ok', n_name FROM nation WHERE n_nationkey >= 12)""",
    "export_file": """SELECT lpad(o_custkey::VARCHAR, 10, '0') AS cik, year(o_orderdate)::BIGINT AS year, '"q", ' || o_orderpriority AS sentence_text, CASE WHEN o_orderkey % 4 != 0 THEN o_orderkey % 4 END::BIGINT AS strength,
        o_orderkey % 2 = 0 AS disputed, o_orderkey AS annotation_id, NULL::BIGINT AS doc_id, NULL::VARCHAR AS note, NULL::VARCHAR AS resolved_at FROM orders""",
    "json_records": "SELECT r_regionkey::BIGINT AS k, r_name AS n FROM region",
    "html_files": f"SELECT 'meta_' || (2020 + page_id) AS doc_id, text FROM ({_html()}) WHERE page_id % 4 != 3",
    "registry": f"""WITH {_RUNS}, v AS (SELECT doc_id, string_agg(version_id, ',' ORDER BY version_id) AS versions FROM runs WHERE doc_id LIKE '%a%' GROUP BY doc_id)
        SELECT lower(n_name) || '_2024' AS doc_id, lower(n_name) AS company, 2024::BIGINT AS year, n_nationkey % 3 = 0 AS has_human, versions IS NOT NULL AS has_ai, coalesce(versions, '') AS versions
        FROM nation LEFT JOIN v ON v.doc_id = lower(n_name) || '_2024' WHERE n_nationkey != 7""",
    "versioned_table": "SELECT CASE WHEN n_regionkey = 1 THEN -n_nationkey ELSE n_nationkey END::BIGINT AS k, 'v' || n_regionkey AS version_id FROM nation",
    "run_meta": """SELECT lower(n_name) || '_2024' AS doc_id, t.*, nullif((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey), 0) AS n_chunks, true AS stamped FROM nation, (VALUES ('baseline', 'single', 'full_doc', ''), ('keyword_window_20', 'single', 'keyword_window', 'window_sentences=20'), ('keyword_per_sentence', 'single', 'keyword_per_sentence', ''),
        ('sequential_batched', 'sequential', 'full_doc', ''), ('hai_tuned', 'single', 'full_doc', ''), ('hai_tuned_v2', 'single', 'full_doc', ''), ('sequential_passage_aware', 'passage_aware', 'full_doc', ''),
        ('xml_cot', 'single', 'full_doc', ''), ('n_sentence_chunk_20', 'single', 'n_sentence', 'n_sentences=20'), ('n_sentence_chunk_40', 'single', 'n_sentence', 'n_sentences=40')) t(version_id, workflow, chunker, params)""",
    "latest": "SELECT o_custkey AS c, max(o_orderkey) AS k FROM orders GROUP BY ALL",
    "missing_runs": "SELECT lower(n_name) || '_2024' AS doc_id FROM nation WHERE n_nationkey % 2 != 0",
    "new_runs": f"WITH {_RUNS} SELECT * FROM runs WHERE version_id = 'v2' AND doc_id NOT LIKE 'a%'",
    "new_content": "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR (doc_id % 5 = 0 AND coalesce(text, '') != 'old')",
    "cached_hits": _HITS,
    "stream_hits": _HITS,
    "cached_replies": """SELECT item_id AS doc_id, 'ok' AS status, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)(tion|ment|schaft|ciones)')))::BIGINT AS n, 1::BIGINT AS asked FROM benchmark""",
    "numbered_lines": f"WITH {SENTENCES} SELECT doc_id, string_agg('[' || anchor_id || '] ' || text, chr(10) ORDER BY sentence_idx) AS text FROM s GROUP BY doc_id",
    "examples_block": """SELECT string_agg('**Human Miss** (why)' || chr(10) || '> ' || r_name || chr(10) || 'long', chr(10) || chr(10) ORDER BY r_regionkey) AS text FROM region""",
    "schemas": """WITH tax AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS half, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
        halves(phase, half) AS (VALUES ('p3a_risk_cats', 'a'), ('p5a_risk_cats', 'a'), ('p3b_mit_cats', 'b'), ('p5b_mit_cats', 'b'))
        SELECT phase, 'kind' AS field, value FROM (VALUES ('p2_kind'), ('p4_kind')) p(phase), (VALUES ('Risk'), ('Risk Mitigation'), ('None')) k(value)
        UNION ALL SELECT DISTINCT phase, 'category', r_name FROM tax JOIN halves USING (half) UNION ALL SELECT DISTINCT phase, 'subcategory', n_name FROM tax JOIN halves USING (half)
        UNION ALL SELECT phase, 'strength', value FROM (VALUES ('p4_strength'), ('p6_strength')) p(phase), (VALUES ('1'), ('2'), ('3')) k(value)""",
    "table_lines": "SELECT o_orderkey, '| ' || o_orderstatus || ' ' || o_orderpriority || ' | ' || o_custkey || ' | ' || CASE WHEN o_orderkey % 3 != 0 THEN (o_orderkey % 3) || '/3' ELSE '' END || ' |' AS line FROM orders",
    "experiment_lines": f"""SELECT doc_id, version_id, '| baseline | single | n_sentence | n_sentences=20 | 3 | ' || ai_total || ' | ' || anchors_caught || ' | ' || anchors_missed || ' |' AS line FROM ({BASE['experiment_log']})""",
    "index_lines": """WITH f AS (SELECT n_name AS company, replace(n_name, ' ', '_') AS d, 2000 + n_nationkey % 2 AS y FROM nation)
        SELECT company, lower(company) AS sort, '- **' || company || '** — [' || y || '](' || d || '/' || d || '_' || y || '.csv) · [' || (y + 5) || '](' || d || '/' || d || '_' || (y + 5) || '.csv)' AS line FROM f""",
    "selected_rows": f"SELECT * FROM ({_ROWS}) WHERE source = 'AI' AND type = 'Risk'",
    "page_of_rows": f"SELECT place, source, coder, count(*) AS n FROM ({_ROWS}) GROUP BY ALL ORDER BY place, source, coder LIMIT 10 OFFSET 20",
    "ordered_cards": f"""WITH {CARDS} SELECT doc_id, anchor_id, sentence_excerpt, CASE WHEN anchor_id > 'h05' THEN substring(anchor_id, 2, 2)::BIGINT ELSE 1000000000 END AS place
        FROM cards WHERE side = 'human' AND anchor_id IS NOT NULL""",
    "tag_rows": f"""WITH {LABELS}, e AS (SELECT doc_id, ordinal, unnest(string_split(final_tags, '; ')) AS final_tag FROM labels WHERE final_tags != '')
        SELECT *, row_number() OVER (PARTITION BY doc_id, ordinal ORDER BY final_tag) AS tag_row FROM e""",
    "finalised_only": f"WITH {LABELS} SELECT doc_id, ordinal, adjudicated_status FROM labels WHERE adjudicated_status != 'disputed'",
    "exact_duplicates": "SELECT event_id AS annotation_id, event_type, user_id % 7 AS u, row_number() OVER (PARTITION BY event_type, user_id % 7 ORDER BY event_id) AS copy FROM events",
    "comments": """SELECT o_orderkey, 'Ann' AS name, '10:00' AS time, 'see (x): ' || o_orderpriority AS text FROM orders
        UNION ALL SELECT o_orderkey, 'Ben', '2024-01-02', o_orderstatus FROM orders""",
    "filing_people": """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS doc_id, 'n' || (user_id % 3) AS annotator, event_id FROM events),
        p AS (SELECT doc_id, annotator, count(*) % 2 = 0 AS done FROM e GROUP BY ALL),
        c AS (SELECT doc_id, count(*) AS n FROM e WHERE event_id % 40 = 0 GROUP BY ALL)
        SELECT p.doc_id, string_agg(annotator, '; ' ORDER BY annotator) AS annotators, string_agg(annotator || '=' || CASE WHEN done THEN 'done' ELSE 'in_progress' END, '; ' ORDER BY annotator) AS annotator_statuses,
               coalesce(string_agg(annotator || '=' || p.doc_id, '; ' ORDER BY annotator) FILTER (done), '') AS annotator_done_at, count(*) AS n_annotators, coalesce(any_value(c.n), 0)::BIGINT AS n_comments
        FROM p LEFT JOIN c ON p.doc_id = c.doc_id GROUP BY p.doc_id""",
    "splitter_cases": """SELECT n_name AS nation, name, n + 1 AS n FROM nation, (VALUES ('colon header', 1::BIGINT), ('lower-case continuation', 1), ('prose', 4), ('colon inside', 2), ('initials', 2), ('quotes', 4), ('empty', 0), ('blank', 0),
        ('no end', 1), ('many breaks', 3)) t(name, n)""",
    "unresolved_cards": f"""WITH {ANNOTATIONS}, r AS (SELECT kind, CASE seq WHEN 2 THEN 'Other' ELSE subcategory END AS subcategory, doc_id || '/' || seq AS x FROM ann WHERE kind != 'Other'),
        names AS (SELECT kind, lower(subcategory) AS sub, count(DISTINCT category) AS n FROM tax GROUP BY ALL)
        SELECT r.kind, subcategory, count(*) AS n, min(x) AS first FROM r LEFT JOIN names ON r.kind = names.kind AND lower(subcategory) = sub WHERE coalesce(names.n, 0) != 1 GROUP BY 1, 2""",
}
