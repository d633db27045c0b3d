"""DuckDB SQL for the registered queries.

Written for RE2 and SQL windows rather than for arrays, so that both sides reach a result by different ways.
"""

from __future__ import annotations

# --- text ------------------------------------------------------------------------------------------------------

_ABBREVIATIONS = "Mr|Mrs|Ms|Dr|Prof|Inc|Corp|Ltd|Co|No|vs|cf|Sr|Jr|St|Fig|Sec|Art"
_SHORT = rf"'(^|[^\p{{L}}\p{{N}}])({_ABBREVIATIONS}|\p{{Lu}})\.(\s+)' || chr(1), '\1\2.\3', 'g'"

#: s(doc_id, sentence_idx, anchor_id, text, char_start, char_end)
SENTENCES = rf"""
    m0 AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), ' ') AS t FROM documents),
    m1 AS (SELECT doc_id, t, regexp_replace(t, '([.!?…]["”’)\]]*)(\s+)', '\1\2' || chr(1), 'g') AS m FROM m0),
    m2 AS (SELECT doc_id, t, regexp_replace(m, chr(1) || '(\p{{Ll}})', '\1', 'g') AS m FROM m1),
    m3 AS (SELECT doc_id, t, regexp_replace(m, {_SHORT}) AS m FROM m2),
    m4 AS (SELECT doc_id, t, regexp_replace(m, {_SHORT}) AS m FROM m3),
    m5 AS (SELECT doc_id, t, string_split(regexp_replace(m, '(\n\s*)', '\1' || chr(1), 'g'), chr(1)) AS p FROM m4),
    pieces AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM m5),
    placed AS (SELECT doc_id, i, regexp_replace(p, '^\s+|\s+$', '', 'g') AS body, length(regexp_extract(p, '^\s*')) AS lead,
                      coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM pieces),
    raw AS (SELECT doc_id, i, body, off + lead AS a, off + lead + length(body) AS b, lag(body) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM placed WHERE body != ''),
    islands AS (SELECT *, sum(CASE WHEN prev IS NOT NULL AND (prev LIKE '%:' OR (regexp_matches(body, '^\p{{Ll}}') AND NOT regexp_matches(prev, '[.?!…]$')))
                                   THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM raw),
    merged AS (SELECT doc_id, g - 1 AS sentence_idx, min(a) AS a, max(b) AS b FROM islands GROUP BY doc_id, g),
    s AS (SELECT doc_id, sentence_idx::BIGINT AS sentence_idx, printf('s-%05d', sentence_idx::BIGINT) AS anchor_id,
                 substring(t, (a + 1)::BIGINT, (b - a)::BIGINT) AS text, a::BIGINT AS char_start, b::BIGINT AS char_end FROM merged JOIN m0 USING (doc_id))"""


def _key(text: str) -> str:
    """normalize_text in SQL."""
    signs = f"translate(coalesce({text}, ''), '‘’“”–— ', '''''\"\"-- ')"
    gone = rf"regexp_replace({signs}, '(?i)\s*AI_TERM\s*[×x*]\s*', ' ', 'g')"
    single = rf"trim(regexp_replace({gone}, '\s+', ' ', 'g'), ' ')"
    return rf"regexp_replace({single}, '\s+([;\-.,:])', '\1', 'g')"


def _hits(words: str) -> str:
    return f"""hits AS (SELECT doc_id, sentence_idx, anchor_id, list_distinct(regexp_extract_all(text, '(?i)({words})', 1)) AS terms
                        FROM s WHERE regexp_matches(text, '(?i)({words})'))"""


def _sentences(rest: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((SENTENCES, *ctes)) + "\n" + rest


_TOTALS = "totals AS (SELECT doc_id, count(*) AS total FROM s GROUP BY doc_id)"


def _windows(w: int) -> str:
    """ranges(doc_id, chunk, lo, hi) of merged windows about hits."""
    return f"""
    spans AS (SELECT doc_id, greatest(0, sentence_idx - {w}) AS lo, least(total - 1, sentence_idx + {w}) AS hi FROM hits JOIN totals USING (doc_id)),
    fresh AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS f FROM spans),
    numbered AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM fresh),
    ranges AS (SELECT doc_id, (g - 1)::BIGINT AS chunk, min(lo)::BIGINT AS lo, max(hi)::BIGINT AS hi FROM numbered GROUP BY doc_id, g)"""


def _blocks(n: int, s: int) -> str:
    return f"""ranges AS (SELECT doc_id, (x // {s})::BIGINT AS chunk, x::BIGINT AS lo, (least(total, x + {n}) - 1)::BIGINT AS hi
                          FROM (SELECT doc_id, total, unnest(range(0, total, {s})) AS x FROM totals) WHERE x = 0 OR x - {s} + {n} < total)"""


_RANGES = "SELECT doc_id, chunk, lo, hi FROM ranges"
_VOCABULARY = "schaft|ciones|tion|ment|the"

_STRIPPED = ["script", "style", "noscript", "head", "title", "table", "svg", "figure", "form", "button", "select"]
_BLOCKS = "p|div|section|article|header|footer|main|li|h1|h2|h3|h4|h5|h6|blockquote|br|tr"


def _html(source: str = "html") -> str:
    out = f"regexp_replace(coalesce({source}, ''), '(?s)<!--.*?-->', '', 'g')"
    for tag in _STRIPPED:
        out = rf"regexp_replace({out}, '(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>', '', 'g')"
    out = rf"regexp_replace({out}, '(?i)<br(\s[^>]*)?/?>', chr(10) || chr(10), 'g')"
    out = rf"regexp_replace({out}, '(?i)</?({_BLOCKS})(\s[^>]*)?/?>', chr(10), 'g')"
    out = f"regexp_replace({out}, '(?s)<[^>]*>|<[a-zA-Z/][^>]*$', '', 'g')"
    for name, sign in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·")]:
        out = f"replace({out}, '{name}', '{sign}')"
    out = f"regexp_replace({out}, '&amp;?', '&', 'g')"
    out = f"regexp_replace({out}, 'https?://[^\\s ]+', ' ', 'g')"
    out = f"replace(replace({out}, ' ', ' '), '​', '')"
    out = rf"regexp_replace({out}, '[ \t]{{2,}}', ' ', 'g')"
    out = rf"regexp_replace({out}, '(?m)^\s*\d+\s*$', '', 'g')"
    for _ in range(2):  # RE2 has no lookaround, so neighbours that share a letter need another pass
        out = rf"regexp_replace({out}, '([A-Za-z,;:\-])\n([a-z(])', '\1 \2', 'g')"
    out = rf"regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    out = rf"regexp_replace({out}, '[ \t]+\n', chr(10), 'g')"
    out = rf"regexp_replace({out}, '\n[ \t]+', chr(10), 'g')"
    return rf"SELECT page_id, regexp_replace({out}, '^\s+|\s+$', '', 'g') AS text FROM pages"


#: What a reader sees of the hand-written pages, set down by hand.
HTML_TEXTS = {
    "attributes": "kept\n\nend", "aria": "kept", "breaks": "Three\n\nFour\n\nfive", "broken line": "word, lower and\nUpper", "cell": "one\n\ntwo", "comment": "abc",
    "entities": "’tis “so” été &lt; <b> AT&T R&D … &nosuch;", "hidden deep": "out", "hidden table cell": "kept", "ix": "7 kept", "less than": "a < b and c > d",
    "links": "See now", "nested table": "a\n\nb", "no html": "plain text", "page numbers": "one\n\ntwo", "paragraphs without end": "one\n\ntwo\n\nthree", "scripts": "y",
    "spaces": "a bc d\ne", "truncated": "one & two", "buttons": "kept",
}


def _html_cases() -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in HTML_TEXTS.items())
    return f"SELECT n_name AS nation, name, n_name || '.' || chr(10) || chr(10) || text AS text FROM nation, (VALUES {rows}) t(name, text)"


def _label(x: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({x}, ''), '[;\s]+$', ''), '^\s+|\s+$', '', 'g')"


_RAW_LABEL = "' ' || c_mktsegment || CASE c_custkey % 3 WHEN 0 THEN '; Other; ' WHEN 1 THEN ': Legal' ELSE ' ;' END"

# --- stand-ins -------------------------------------------------------------------------------------------------

CARDS = """
    cards AS (SELECT strftime(ts, '%Y-%m-%d') AS doc_id, CASE WHEN event_id % 17 != 0 THEN 'h' || strftime(ts, '%H') END AS anchor_id,
                     CASE user_id % 3 WHEN 0 THEN 'ai' ELSE 'human' END AS side, CASE user_id % 3 WHEN 1 THEN 'A' WHEN 2 THEN 'B' END AS coder,
                     CASE WHEN event_type IN ('purchase', 'signup') THEN 'Risk Mitigation' ELSE 'Risk' END AS kind, event_type AS category,
                     'sub' || (event_id % 4) AS subcategory, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 + event_id % 3 END AS strength,
                     'event ' || event_id AS sentence_excerpt FROM events)"""

_BOTH = """
    agreed AS (SELECT doc_id, anchor_id, category FROM cards WHERE side = 'human' AND anchor_id IS NOT NULL
               GROUP BY ALL HAVING bool_or(coder = 'A') AND bool_or(coder = 'B'))"""


def _frame(mode: str = "union") -> str:
    """frame(doc_id, key, matched, hc, ac, hk, ak, hs, as_, hm, am) with sorted lists."""
    keep = {
        "union": "true", "coder_a": "(side = 'ai' OR coder = 'A')", "coder_b": "(side = 'ai' OR coder = 'B')",
        "intersection": "(side = 'ai' OR (anchor_id IS NOT NULL AND (doc_id, anchor_id, category) IN (SELECT (doc_id, anchor_id, category) FROM agreed)))",
    }[mode]
    some = lambda side, c: f"coalesce(list_sort(list(DISTINCT {c}) FILTER (side = '{side}' AND ok)), [])"
    sets = ", ".join(f"{some(s, c)} AS {s[0]}{n}" for s in ("human", "ai") for c, n in (("category", "c"), ("kind", "k"), ("subcategory", "s")))
    return f"""{_BOTH},
    flagged AS (SELECT *, {keep} AS ok, CASE WHEN anchor_id IS NULL THEN sentence_excerpt ELSE anchor_id END AS key FROM cards),
    frame AS (SELECT doc_id, key, anchor_id IS NOT NULL AS matched, {sets}, max(strength) FILTER (side = 'human' AND ok) AS hm, max(strength) FILTER (side = 'ai' AND ok) AS am
              FROM flagged WHERE anchor_id IS NOT NULL OR ok GROUP BY doc_id, key, anchor_id IS NOT NULL)"""


def _on_frame(rest: str, mode: str = "union", *ctes: str) -> str:
    return "WITH " + ",\n".join((CARDS, _frame(mode), *ctes)) + "\n" + rest


_J = lambda c: f"array_to_string({c}, '; ')"


def _label_frame(mode: str) -> str:
    return _on_frame(f"""SELECT doc_id, key AS anchor_id, {_J('hc')} AS human_categories, {_J('hk')} AS human_kinds, {_J('hs')} AS human_subcats,
        {_J('ac')} AS ai_categories, {_J('ak')} AS ai_kinds, {_J('"as"')} AS ai_subcats, am::BIGINT AS ai_strength_max, hm::BIGINT AS human_strength_max FROM frame WHERE matched""", mode)


def _report(mode: str = "union") -> str:
    return f"""
    cats AS (SELECT DISTINCT event_type AS category FROM events),
    report AS (SELECT category, count(*) FILTER (list_contains(hc, category)) AS support, count(*) FILTER (list_contains(ac, category)) AS predicted,
                      count(*) FILTER (list_contains(hc, category) AND list_contains(ac, category)) AS tp FROM cats CROSS JOIN frame GROUP BY category),
    scored AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r,
                      CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END AS f FROM report)"""


_MATRIX = """
    labels(i, label) AS (VALUES (0, 'none'), (1, 'click'), (2, 'error'), (3, 'purchase'), (4, 'signup'), (5, 'view')),
    pairs AS (SELECT human, unnest(CASE WHEN len(ac) = 0 THEN ['none'] ELSE ac END) AS ai
              FROM (SELECT ac, unnest(CASE WHEN len(hc) = 0 THEN ['none'] ELSE hc END) AS human FROM frame WHERE len(hc) + len(ac) > 0)),
    matrix AS (SELECT h.i::BIGINT AS "row", a.i::BIGINT AS col, h.label AS human, a.label AS ai,
                      (SELECT count(*) FROM pairs p WHERE p.human = h.label AND p.ai = a.label) AS n FROM labels h, labels a)"""

_STRENGTHS = """
    levels(i, label) AS (VALUES (0, 'none'), (1, '1'), (2, '2'), (3, '3')),
    graded AS (SELECT coalesce(hm::VARCHAR, 'none') AS human, coalesce(am::VARCHAR, 'none') AS ai FROM frame WHERE list_contains(hk, 'Risk Mitigation') OR list_contains(ak, 'Risk Mitigation')),
    matrix AS (SELECT h.i::BIGINT AS "row", a.i::BIGINT AS col, h.label AS human, a.label AS ai,
                      (SELECT count(*) FROM graded g WHERE g.human = h.label AND g.ai = a.label) AS n FROM levels h, levels a)"""

_COUNTS = """
    sources AS (SELECT doc_id, anchor_id, bool_or(side = 'ai') AS ai, coalesce(bool_or(coder = 'A'), false) AS a, coalesce(bool_or(coder = 'B'), false) AS b
                FROM cards WHERE anchor_id IS NOT NULL GROUP BY ALL),
    by_card AS (SELECT doc_id, count(*) FILTER (side = 'ai') AS ai_total, count(*) FILTER (side = 'ai' AND anchor_id IS NOT NULL) AS ai_matched,
                       count(*) FILTER (side = 'ai' AND anchor_id IS NULL) AS ai_unmatched, count(*) FILTER (side = 'human' AND anchor_id IS NOT NULL) AS human_matched,
                       count(*) FILTER (side = 'human' AND anchor_id IS NULL) AS human_unmatched, count(*) FILTER (side = 'human' AND category = '(unresolved)') AS human_unresolved
                FROM cards GROUP BY doc_id),
    by_anchor AS (SELECT doc_id, count(*) FILTER (ai) AS anchors_with_ai, count(*) FILTER (a OR b) AS anchors_with_human, count(*) FILTER (a) AS anchors_with_a,
                         count(*) FILTER (b) AS anchors_with_b, count(*) FILTER (a AND b) AS anchors_with_both_coders, count(*) FILTER (ai AND (a OR b)) AS anchors_with_ai_and_human
                  FROM sources GROUP BY doc_id)"""
_PEOPLE = """
    people AS (SELECT doc_id, count(*) AS human_total, count(*) FILTER (coder = 'A') AS human_a_total, count(*) FILTER (coder = 'B') AS human_b_total
               FROM cards WHERE side = 'human' GROUP BY doc_id)"""
_COUNT_COLUMNS = ("ai_total ai_matched ai_unmatched human_matched human_unmatched human_unresolved human_total human_a_total human_b_total "
                  "anchors_with_ai anchors_with_human anchors_with_a anchors_with_b anchors_with_both_coders anchors_with_ai_and_human").split()  # fmt: skip
_ALL_COUNTS = "SELECT doc_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _COUNT_COLUMNS) + " FROM by_card LEFT JOIN people USING (doc_id) LEFT JOIN by_anchor USING (doc_id)"

TAGS = """
    tags AS (SELECT strftime(ts, '%Y-%m-%d') AS doc_id, event_id AS annotation_id, 'ann' || (user_id % 2) AS annotator,
                    CASE WHEN event_id % 5 = 0 THEN [hour(ts), hour(ts) + 1] ELSE [hour(ts)] END AS ordinals,
                    CASE WHEN event_type IN ('purchase', 'signup') THEN 'Mitigation' ELSE 'Risk' END AS kind, event_type AS category, '-' AS subcategory,
                    CASE WHEN event_type IN ('purchase', 'signup') THEN 1 + event_id % 3 END AS strength FROM events),
    each AS (SELECT *, unnest(ordinals) AS ordinal, kind || ' · ' || category || ' · ' || subcategory AS tag FROM tags),
    present AS (SELECT doc_id, count(DISTINCT annotator) AS present FROM tags GROUP BY doc_id),
    sets AS (SELECT doc_id, ordinal, annotator, list_sort(list(DISTINCT tag)) AS t FROM each GROUP BY ALL),
    strong AS (SELECT doc_id, ordinal, bool_or(d) AS sd FROM (SELECT doc_id, ordinal, tag, count(DISTINCT strength) > 1 AS d FROM each GROUP BY ALL) GROUP BY ALL),
    disputes AS (SELECT doc_id, ordinal, count(*) AS n_tagging, count(DISTINCT t) > 1 OR count(*) < any_value(present) AS disputed, any_value(sd) AS strength_disputed
                 FROM sets JOIN present USING (doc_id) JOIN strong USING (doc_id, ordinal) GROUP BY doc_id, ordinal)"""

LABELS = TAGS + """,
    people AS (SELECT doc_id, annotator, dense_rank() OVER (PARTITION BY doc_id ORDER BY annotator) AS r FROM (SELECT DISTINCT doc_id, annotator FROM tags)),
    n AS (SELECT doc_id, max(r) AS n FROM people GROUP BY doc_id),
    wide AS (SELECT doc_id, ordinal, array_to_string(coalesce(list_sort(list(DISTINCT tag || coalesce(' · S' || strength, '')) FILTER (r = 1)), []), '; ') AS annotator_a_tags,
                    array_to_string(coalesce(list_sort(list(DISTINCT tag || coalesce(' · S' || strength, '')) FILTER (r = 2)), []), '; ') AS annotator_b_tags,
                    max(annotator) FILTER (r = 1) AS annotator_a, max(annotator) FILTER (r = 2) AS annotator_b, array_to_string(list_sort(list(DISTINCT tag)), '; ') AS own
             FROM each JOIN people USING (doc_id, annotator) GROUP BY doc_id, ordinal),
    resolved AS (SELECT *, ordinal % 4 = 0 AS solved, CASE WHEN ordinal % 4 != 0 THEN NULL WHEN ordinal % 8 = 0 THEN '' ELSE 'Risk · view · -; Mitigation · signup · - · S2' END AS res
                 FROM wide JOIN disputes USING (doc_id, ordinal) JOIN n USING (doc_id)),
    final AS (SELECT doc_id, ordinal::BIGINT AS ordinal, CASE WHEN solved THEN res WHEN NOT disputed THEN own ELSE '' END AS final_tags,
                     CASE WHEN res = '' THEN 'resolved_to_none' WHEN solved AND ordinal % 12 = 0 THEN 'resolved_span' WHEN solved THEN 'resolved'
                          WHEN disputed THEN 'pending' WHEN n = 1 THEN 'solo' ELSE 'agreed' END AS final_source,
                     annotator_a, annotator_a_tags, annotator_b, annotator_b_tags, strength_disputed, disputed,
                     CASE WHEN solved THEN 'resolved' WHEN disputed THEN 'disputed' ELSE 'agreed' END AS adjudicated_status FROM resolved),
    labels AS (SELECT *, CASE WHEN final_tags = '' THEN 0 ELSE len(string_split(final_tags, '; ')) END::BIGINT AS n_final_tags FROM final)"""

ANNOTATIONS = """
    ann AS (SELECT l_orderkey AS doc_id, l_linenumber AS seq, CASE l_returnflag WHEN 'R' THEN 'Risk' WHEN 'A' THEN 'Risk Mitigation' ELSE 'Other' END AS kind,
                   CASE WHEN l_partkey % 5 = 0 THEN 'odd' ELSE 'c' || (l_partkey % 2) END AS category, 's' || (l_suppkey % 4) AS subcategory,
                   CASE WHEN l_suppkey % 6 != 0 THEN l_suppkey % 5 END AS strength FROM lineitem),
    tax(kind, category, subcategory) AS (VALUES ('Risk', 'c0', 's0'), ('Risk', 'c1', 's1'), ('Risk Mitigation', 'c1', 's1'), ('Risk Mitigation', 'c1', 's2'), ('Risk', 'c1', 'other'), ('Risk', 'c0', 'other')),
    judged AS (SELECT *, CASE WHEN kind NOT IN ('Risk', 'Risk Mitigation') THEN 'dropped_bad_kind'
                              WHEN kind = 'Risk Mitigation' AND (strength IS NULL OR strength NOT BETWEEN 1 AND 3) THEN 'dropped_bad_strength'
                              WHEN NOT EXISTS (SELECT 1 FROM tax WHERE tax.kind = ann.kind AND tax.category = ann.category) THEN 'dropped_unknown_category'
                              WHEN subcategory NOT IN (SELECT subcategory FROM tax) THEN 'dropped_unknown_subcategory' ELSE 'kept' END AS reason FROM ann)"""

ASKED = f"""
    asked AS (SELECT doc_id, sentence_idx, CASE sentence_idx % 3 WHEN 0 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '  ' WHEN 1 THEN substring(text, 1, 100) || ' qq' ELSE substring(text, 5) END AS sentence FROM s),
    keyed AS (SELECT doc_id, sentence_idx, k FROM (SELECT doc_id, sentence_idx, lower({_key('text')}) AS k FROM s) WHERE k != ''),
    q AS (SELECT DISTINCT doc_id, key FROM (SELECT doc_id, lower({_key('sentence')}) AS key FROM asked) WHERE key != ''),
    e AS (SELECT q.doc_id, key, min(sentence_idx) AS sentence_idx, 'exact' AS stage FROM q JOIN keyed ON q.doc_id = keyed.doc_id AND key = k GROUP BY ALL),
    q2 AS (SELECT * FROM q ANTI JOIN e USING (doc_id, key)),
    p AS (SELECT q2.doc_id, key, min(sentence_idx) AS sentence_idx, 'prefix' AS stage FROM q2 JOIN keyed ON q2.doc_id = keyed.doc_id AND left(key, 80) = left(k, 80)
          WHERE length(key) >= 80 AND length(k) >= 80 GROUP BY ALL),
    q3 AS (SELECT * FROM q2 ANTI JOIN p USING (doc_id, key)),
    c AS (SELECT q3.doc_id, key, min(sentence_idx) AS sentence_idx, 'containment' AS stage FROM q3 JOIN keyed ON q3.doc_id = keyed.doc_id
          WHERE length(key) > 40 AND length(k) > 40 AND greatest(length(k), length(key)) <= 1.5 * least(length(k), length(key)) AND (contains(k, key) OR contains(key, k)) GROUP BY ALL),
    found AS (SELECT * FROM e UNION ALL SELECT * FROM p UNION ALL SELECT * FROM c)"""

VERDICTS = """
    v AS (SELECT *, length(text) AS n FROM s),
    cand AS (SELECT doc_id, anchor_id FROM v WHERE contains(text, 'th') OR contains(text, 'en')),
    ment AS (SELECT doc_id, anchor_id FROM v WHERE contains(text, 'on')),
    pass AS (SELECT x.doc_id, x.sentence_idx AS passage, x.sentence_idx AS lo, x.sentence_idx + 2 AS hi, 'topic ' || x.sentence_idx AS topic_summary
             FROM v x JOIN v y ON x.doc_id = y.doc_id AND y.sentence_idx = x.sentence_idx + 2 WHERE x.sentence_idx % 7 = 0),
    inside AS (SELECT v.doc_id, v.sentence_idx, v.anchor_id, arg_max(topic_summary, passage) AS topic_summary FROM v JOIN pass ON v.doc_id = pass.doc_id AND v.sentence_idx BETWEEN lo AND hi GROUP BY ALL),
    ctx AS (SELECT doc_id, anchor_id, n % 3 != 0 AS keep, ' length ' || n AS reason FROM v WHERE n % 5 != 0),
    kinds AS (SELECT doc_id, anchor_id, CASE n % 4 WHEN 0 THEN 'Risk Mitigation' WHEN 3 THEN 'Neither' ELSE 'Risk' END AS kind FROM v WHERE n % 11 != 0),
    rc AS (SELECT doc_id, anchor_id, sentence_idx AS seq, 'Legal' AS category, 'r' || (n % 3) AS subcategory FROM v WHERE n % 13 != 0),
    mc AS (SELECT doc_id, anchor_id, sentence_idx AS seq, 'Governance' AS category, 'm' || (n % 2) AS subcategory FROM v WHERE n % 13 != 1),
    st AS (SELECT doc_id, anchor_id, 1 + n % 3 AS strength FROM v WHERE n % 6 != 0)"""


def _labelled(kept: str) -> str:
    return _sentences(
        """SELECT doc_id, anchor_id, 'Risk' AS kind, category, subcategory, NULL::BIGINT AS strength, seq FROM rc JOIN k USING (doc_id, anchor_id) WHERE kind = 'Risk'
           UNION ALL SELECT doc_id, anchor_id, 'Risk Mitigation', category, subcategory, strength::BIGINT, seq FROM mc JOIN k USING (doc_id, anchor_id) LEFT JOIN st USING (doc_id, anchor_id)
           WHERE kind = 'Risk Mitigation'""", VERDICTS, f"k AS (SELECT * FROM kinds SEMI JOIN ({kept}) z USING (doc_id, anchor_id))")


_PASSAGES_LOST = """
    lost AS (SELECT m.doc_id, m.anchor_id, CASE
        WHEN inside.anchor_id IS NULL AND ment.anchor_id IS NULL THEN 'P1+P2: Not surfaced as a candidate — the sentence was not inside any AI-topic passage Phase 1 identified, and Phase 2 didn''t flag it as a direct AI mention.'
        WHEN ctx.anchor_id IS NULL THEN 'Pre-P3: Candidate was in the set but Phase 3 didn''t issue a verdict on it.'
        WHEN NOT keep THEN 'P3 (context filter): DROPPED — reason given: "' || trim(reason) || '"'
        WHEN kinds.anchor_id IS NULL THEN 'Pre-P4: Phase 3 kept it but Phase 4 didn''t issue a kind verdict.'
        WHEN kind NOT IN ('Risk', 'Risk Mitigation') THEN 'P4 (kind decision): kind set to null — Phase 4 decided it wasn''t a Risk or Mitigation.'
        WHEN rc.anchor_id IS NULL AND mc.anchor_id IS NULL THEN 'P5 (category assignment): Made it through filtering but Phase 5 didn''t return a (category, subcategory) tuple.'
        ELSE 'Tagged by AI but at a different (kind, category, subcategory) than the human — see Document View for the actual AI tags.' END AS diagnosis
        FROM v m LEFT JOIN inside USING (doc_id, anchor_id) LEFT JOIN ment USING (doc_id, anchor_id) LEFT JOIN ctx USING (doc_id, anchor_id) LEFT JOIN kinds USING (doc_id, anchor_id)
        LEFT JOIN rc USING (doc_id, anchor_id) LEFT JOIN mc USING (doc_id, anchor_id) WHERE m.sentence_idx % 2 = 0)"""

_ROW_CARDS = """
    rows AS (SELECT *, CASE WHEN anchor_id IS NULL THEN NULL ELSE substring(anchor_id, 2, 2)::BIGINT END AS place0 FROM cards)"""


def _few_shot() -> str:
    parts = []
    for i, (decision, n) in enumerate((("AI-flagged incorrectly", 5), ("Human Miss", 2))):
        parts.append(f"""
    u{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, lang, n_chars % 50 ORDER BY doc_id) AS f FROM documents
             WHERE (CASE WHEN doc_id % 3 = 0 THEN 'Human Miss' ELSE 'AI-flagged incorrectly' END) = '{decision}') WHERE f = 1 AND length(text) >= 60),
    l{i} AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) > 1 AS again FROM u{i}),
    r{i} AS (SELECT doc_id, {i}::BIGINT AS part, row_number() OVER (ORDER BY again, length(text) DESC, doc_id) AS rank, '{decision}' AS decision, source AS explanation FROM l{i} QUALIFY rank <= {n})""")
    return "WITH " + ",".join(parts) + " SELECT * FROM r0 UNION ALL SELECT * FROM r1"


_TOKENS = """SELECT doc_id, para_idx, row_number() OVER (PARTITION BY doc_id, para_idx ORDER BY a) - 1 AS token_idx, anchor_id IS NOT NULL AS is_sentence, anchor_id,
        substring(t, (a + 1)::BIGINT, (b - a)::BIGINT) AS text FROM tokens JOIN m0 USING (doc_id)"""
_PARAGRAPHS = (
    """lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM m0)""",
        """starts AS (SELECT doc_id, i, length(l) AS n, sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(l) - 1 AS a FROM lines)""",
        """paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS para_idx, a AS p0, a + n AS p1 FROM starts WHERE n > 0)""",
        """firsts AS (SELECT s.doc_id, anchor_id, char_start, char_end, min(para_idx) AS para_idx FROM s JOIN paras ON s.doc_id = paras.doc_id AND char_start < p1 AND char_end > p0 GROUP BY ALL)""",
        """spans AS (SELECT doc_id, para_idx, anchor_id, greatest(char_start, p0) AS a, least(char_end, p1) AS b FROM firsts JOIN paras USING (doc_id, para_idx)
                     UNION ALL SELECT doc_id, para_idx, NULL, p1, p1 FROM paras)""",
        """edges AS (SELECT *, lag(b) OVER (PARTITION BY doc_id, para_idx ORDER BY a, anchor_id IS NULL) AS before FROM spans)""",
        """tokens AS (SELECT doc_id, para_idx, anchor_id, a, b FROM edges WHERE b > a
                      UNION ALL SELECT doc_id, para_idx, NULL, coalesce(before, p0), a FROM edges JOIN paras USING (doc_id, para_idx) WHERE a > coalesce(before, p0))""",
)

ORACLES = {
    "html_extract": _html(),
    "html_cases": _html_cases(),
    "keyword_hits_large": _sentences("""SELECT doc_id, sentence_idx, arg_min(w, (p, -length(w))) AS first FROM starts JOIN words ON left(w, 7) = head AND substring(t, p, length(w)) = w GROUP BY doc_id, sentence_idx""",
        """words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS w FROM conversations)""",
        """places AS (SELECT doc_id, sentence_idx, lower(text) AS t, unnest(range(1, length(text) - 5)) AS p FROM s)""",
        """starts AS (SELECT doc_id, sentence_idx, p, t, substring(t, p, 7) AS head FROM places)"""),
    "reply_items": """WITH i AS (SELECT o_orderkey, '"{' || o_orderpriority || '}' AS sentence, o_orderkey % 4 AS strength, length(o_orderpriority) + 61 AS n FROM orders),
        c AS (SELECT *, 16 + 3 * n + 2 + 2 AS whole, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 150 ELSE 0 END AS gone FROM i),
        k AS (SELECT *, least(3, greatest(0, (whole - gone - 16 + 1) // (n + 1))) AS items FROM c)
        SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'truncated' ELSE 'ok' END AS status, items AS n, CASE WHEN items > 0 THEN sentence END AS sentence,
               CASE WHEN items > 0 THEN strength END AS strength, CASE WHEN items > 0 THEN 'note' END AS extra FROM k""",
    "html_nested": _html("replace(html, '</p>', '’</p>')"),
    "normalize_text": f"SELECT doc_id, {_key('text')} AS text, lower({_key('text')}) AS key, substring({_key('text')}, 1, 140) AS excerpt FROM documents",
    "labels_clean": rf"""WITH r AS (SELECT c_custkey, c_name, {_label(_RAW_LABEL)} AS label FROM customer)
        SELECT c_custkey, label, regexp_matches(label, '[;:]') AS has_parts,
               {_label(r"regexp_extract(label, '(?s)^([^;:]*)[;:](.*)$', 1)")} AS head, {_label(r"regexp_extract(label, '(?s)^([^;:]*)[;:](.*)$', 2)")} AS tail,
               CASE WHEN c_custkey % 4 != 0 THEN c_custkey % 5 END::BIGINT AS strength, replace(c_name, ' ', '_') || '-_a-b' AS token,
               CASE WHEN c_custkey % 2 = 0 THEN 'Risk Mitigation' ELSE 'Risk' END AS kind FROM r""",
    "sentence_index": _sentences("SELECT * FROM s"),
    "keyword_hits": _sentences("SELECT doc_id, sentence_idx, anchor_id, array_to_string(list_sort(terms), ',') AS terms FROM hits", _hits(_VOCABULARY)),
    "coverage": _sentences("""SELECT doc_id, total::BIGINT AS n_sentences, coalesce(n_hits, 0)::BIGINT AS n_hits, coalesce(n_chunks, 0)::BIGINT AS n_chunks, coalesce(covered, 0)::BIGINT AS covered
        FROM totals LEFT JOIN (SELECT doc_id, count(*) AS n_hits FROM hits GROUP BY doc_id) USING (doc_id)
        LEFT JOIN (SELECT doc_id, count(*) AS n_chunks, sum(hi - lo + 1) AS covered FROM ranges GROUP BY doc_id) USING (doc_id)""", _hits(_VOCABULARY), _TOTALS, _windows(2)),
    "chunks_full": _sentences("SELECT doc_id, 0::BIGINT AS chunk, 0::BIGINT AS lo, (total - 1)::BIGINT AS hi FROM totals", _TOTALS),
    "chunks_window": _sentences(_RANGES, _hits("ment|ciones"), _TOTALS, _windows(3)),
    "chunks_sentence": _sentences("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_idx) - 1 AS chunk, sentence_idx AS lo, sentence_idx AS hi FROM hits", _hits("ment|ciones")),
    "chunks_n20": _sentences(_RANGES, _TOTALS, _blocks(20, 20)),
    "chunks_n40": _sentences(_RANGES, _TOTALS, _blocks(40, 40)),
    "chunks_overlap": _sentences(_RANGES, _TOTALS, _blocks(7, 4)),
    "chunks_gaps": _sentences(_RANGES, _TOTALS, _blocks(3, 5)),
    "chunk_texts": _sentences("""SELECT doc_id, printf('chunk_%04d', chunk) AS chunk_id, lo, hi, string_agg(sentence_idx::VARCHAR, ',' ORDER BY sentence_idx) AS indices, min(anchor_id) AS first_anchor,
        max(anchor_id) AS last_anchor, string_agg(text, chr(10) ORDER BY sentence_idx) AS text FROM ranges JOIN s USING (doc_id) WHERE sentence_idx BETWEEN lo AND hi GROUP BY doc_id, chunk, lo, hi""",
        _TOTALS, _blocks(5, 3)),
    "context_window": """SELECT a.conv_id, a.turn, string_agg(CASE WHEN b.turn = a.turn THEN '>> ' ELSE '   ' END || b.role || ': ' || b.text, chr(10) ORDER BY b.turn) AS context
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) a JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) b
        ON a.conv_id = b.conv_id AND b.i BETWEEN a.i - 2 AND a.i + 2 GROUP BY a.conv_id, a.turn""",
    "passage_members": _sentences("SELECT doc_id, sentence_idx, topic_summary, anchor_id FROM inside", VERDICTS),
    "dedupe_first": _sentences(f"""SELECT min(doc_id * 1000000 + sentence_idx) AS seq, category FROM (SELECT doc_id, sentence_idx, lower({_key('text')}) AS k, 'c' || (length(text) % 3) AS category FROM s) GROUP BY k, category"""),
    "validate_reasons": f"WITH {ANNOTATIONS} SELECT reason, count(*) AS n FROM judged GROUP BY reason",
    "validate_kept": f"WITH {ANNOTATIONS} SELECT kind, category, subcategory, CASE WHEN kind != 'Risk' THEN strength END::BIGINT AS strength, count(*) AS n FROM judged WHERE reason = 'kept' GROUP BY ALL",
    "resolve_category": f"""WITH {ANNOTATIONS},
        r AS (SELECT kind, CASE seq WHEN 1 THEN 'Legal; x' WHEN 2 THEN 'Other' WHEN 3 THEN 'a: b' ELSE upper(subcategory) END AS raw FROM ann),
        names AS (SELECT kind, lower(subcategory) AS sub, list(DISTINCT category) AS c FROM tax GROUP BY ALL)
        SELECT r.kind, CASE WHEN raw = 'Legal; x' THEN 'Legal' WHEN raw = 'a: b' THEN 'a' WHEN len(c) = 1 THEN c[1] ELSE '(unresolved)' END AS category,
               CASE raw WHEN 'Legal; x' THEN 'x' WHEN 'a: b' THEN 'b' ELSE raw END AS subcategory, count(*) AS n
        FROM r LEFT JOIN names ON r.kind = names.kind AND lower(raw) = sub GROUP BY 1, 2, 3""",
    "align_cascade": _sentences("SELECT doc_id, key, sentence_idx, stage, printf('s-%05d', sentence_idx) AS anchor_id FROM found", ASKED),
    "align_cards": _sentences(_ALL_COUNTS, ASKED, f"""
        sides AS (SELECT doc_id, 'ai' AS side, NULL AS coder, 'c1' AS category, sentence, true AS card FROM asked WHERE sentence_idx % 2 = 0
                 UNION ALL SELECT doc_id, 'human', CASE WHEN sentence_idx % 4 = 0 THEN 'A' ELSE 'B' END,
                 CASE WHEN sentence_idx % 3 = 0 THEN '(unresolved)' ELSE 'c1' END, sentence, sentence_idx % 5 != 0 AND trim(sentence, ' ') != '' FROM asked WHERE sentence_idx % 4 != 3),
        cards AS (SELECT sides.doc_id, side, coder, category, found.sentence_idx AS anchor_id FROM (SELECT *, lower({_key('sentence')}) AS key FROM sides) sides
                  LEFT JOIN found ON sides.doc_id = found.doc_id AND sides.key = found.key WHERE card)""",
        "people AS (SELECT doc_id, count(*) AS human_total, count(*) FILTER (coder = 'A') AS human_a_total, count(*) FILTER (coder = 'B') AS human_b_total FROM sides WHERE side = 'human' GROUP BY doc_id)", _COUNTS),
    "anchor_sources": f"""WITH {CARDS}, {_COUNTS} SELECT doc_id, anchor_id, CASE WHEN ai AND a AND b THEN 'ai_and_both' WHEN ai AND a THEN 'ai_and_a' WHEN ai AND b THEN 'ai_and_b' WHEN ai THEN 'ai'
        WHEN a AND b THEN 'coders_both' WHEN a THEN 'coder_a' ELSE 'coder_b' END AS source FROM sources""",
    "align_counts": f"WITH {CARDS}, {_PEOPLE}, {_COUNTS} {_ALL_COUNTS}",
    "label_frame": _label_frame("union"),
    "label_frame_both": _label_frame("intersection"),
    "frame_rows": "\nUNION ALL\n".join(
        f"SELECT * FROM ({_on_frame(f'''SELECT '{m}' AS mode, NOT matched AS unmatched, count(*) AS n, count(*) FILTER (len(hc) = 0) AS without_human, sum(len(ac))::BIGINT AS ai_labels FROM frame GROUP BY ALL''', m)})"
        for m in ("union", "intersection", "coder_a", "coder_b")),
    "prf_per_category": _on_frame("SELECT category, support, predicted, tp, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM scored", "union", _report()),
    "prf_averages": _on_frame("""SELECT 'micro' AS average, round(sum(tp) / sum(predicted), 6) AS precision, round(sum(tp) / sum(support), 6) AS recall, round(2 * sum(tp) / (sum(support) + sum(predicted)), 6) AS f1 FROM scored
        UNION ALL SELECT 'macro', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6) FROM scored
        UNION ALL SELECT 'weighted', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6) FROM scored""", "union", _report()),
    "prf_displayed": _on_frame("""SELECT category, support, CASE WHEN predicted > 0 THEN printf('%.2f', p) ELSE '—' END AS precision, CASE WHEN support > 0 THEN printf('%.2f', r) ELSE '—' END AS recall,
        CASE WHEN support > 0 AND predicted > 0 THEN printf('%.2f', f) ELSE '—' END AS f1 FROM scored""", "coder_a", _report()),
    "kappa": f"""WITH {CARDS},
        anchors AS (SELECT doc_id, anchor_id, list(DISTINCT category) FILTER (coder = 'A') AS a, list(DISTINCT category) FILTER (coder = 'B') AS b FROM cards
                    WHERE side = 'human' AND anchor_id IS NOT NULL GROUP BY ALL),
        bits AS (SELECT doc_id, anchor_id, coalesce(list_contains(a, category), false)::INT AS x, coalesce(list_contains(b, category), false)::INT AS y FROM anchors CROSS JOIN (SELECT DISTINCT category FROM cards)),
        t AS (SELECT count(*)::DOUBLE AS n, avg((x = y)::INT) AS po, avg(x) * avg(y) + (1 - avg(x)) * (1 - avg(y)) AS pe FROM bits)
        SELECT round((po - pe) / (1 - pe), 6) AS kappa, (SELECT count(*) FROM anchors) AS n_anchors, n::BIGINT AS n_pairs,
               (SELECT count(*) FROM anchors WHERE list_sort(a) = list_sort(b)) AS agreement_anchors FROM t""",
    "confusion_category": _on_frame("SELECT * FROM matrix", "union", _MATRIX),
    "confusion_strength": _on_frame("SELECT * FROM matrix", "union", _STRENGTHS),
    "confusion_headlines": _on_frame("""SELECT headline, human, ai, n FROM (SELECT *, CASE WHEN human = 'none' AND ai != 'none' THEN 'over_tagging' WHEN ai = 'none' AND human != 'none' THEN 'missed'
        WHEN human = ai AND ai != 'none' THEN 'best_agreement' WHEN ai != 'none' THEN 'confusion' END AS headline FROM matrix WHERE n > 0) WHERE headline IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY headline ORDER BY n DESC, "row", col) = 1""", "union", _MATRIX),
    "strength_headline": _on_frame("""SELECT human, ai, n FROM matrix WHERE "row" != col AND n > 0 ORDER BY n DESC, "row", col LIMIT 1""", "union", _STRENGTHS),
    "strength_levels": _on_frame("""SELECT array_to_string(list_sort(list(DISTINCT am) FILTER (am IS NOT NULL)), ',') AS ai, array_to_string(list_sort(list(DISTINCT hm) FILTER (hm IS NOT NULL)), ',') AS human FROM frame
        WHERE list_contains(hk, 'Risk Mitigation') OR list_contains(ak, 'Risk Mitigation')"""),
    "fp_counts": _on_frame("SELECT category, count(*) AS fp_count FROM (SELECT unnest(ac) AS category FROM frame WHERE len(hc) = 0) GROUP BY category"),
    "comparison": _on_frame(f"""SELECT doc_id, key AS anchor_id, {_J('ac')} AS ai_categories, {_J('hc')} AS human_categories, {_J('"as"')} AS ai_subcategories, {_J('hs')} AS human_subcategories,
        am::BIGINT AS ai_strength, hm::BIGINT AS human_strength, CASE WHEN len(ac) + len(hc) = 0 THEN 'none' WHEN len(hc) = 0 THEN 'ai_only' WHEN len(ac) = 0 THEN 'human_only' WHEN ac = hc THEN 'exact'
        WHEN list_has_any(ac, hc) THEN 'partial' ELSE 'disjoint' END AS agreement FROM frame WHERE matched"""),
    "labels_prf": """WITH t AS (SELECT sum((quality = 1)::INT) AS s, sum((n_chars > 500)::INT) AS p, sum((quality = 1 AND n_chars > 500)::INT) AS tp FROM labels JOIN documents USING (doc_id))
        SELECT 'good' AS category, s::BIGINT AS support, p::BIGINT AS predicted, tp::BIGINT AS tp, round(tp / p, 6) AS precision, round(tp / s, 6) AS recall, round(2 * tp / (s + p), 6) AS f1 FROM t""",
    "sentence_disputes": f"WITH {TAGS} SELECT doc_id, ordinal::BIGINT AS ordinal, n_tagging, disputed, strength_disputed FROM disputes",
    "tag_disputes": f"""WITH {TAGS}, givers AS (SELECT doc_id, ordinal, tag, count(DISTINCT annotator) AS g FROM each GROUP BY ALL)
        SELECT doc_id, annotation_id, bool_or(disputed) AS disputed, bool_or(strength_disputed) AS strength_disputed, max(g) < 2 AS pair_disputed
        FROM each JOIN disputes USING (doc_id, ordinal) JOIN givers USING (doc_id, ordinal, tag) GROUP BY ALL""",
    "final_labels": f"WITH {LABELS} SELECT * FROM labels",
    "final_parts": f"""WITH {LABELS}, f AS (SELECT *, string_split(string_split(final_tags, '; ')[1], ' · ') AS x FROM labels WHERE adjudicated_status = 'resolved')
        SELECT doc_id, ordinal, CASE WHEN final_tags != '' THEN x[1] END AS final_kind, CASE WHEN final_tags != '' THEN x[2] END AS final_category, CASE WHEN final_tags != '' THEN x[3] END AS final_subcategory,
               CASE WHEN final_tags != '' THEN try_cast(substring(x[4], 2) AS BIGINT) END AS final_strength, n_final_tags FROM f""",
    "filing_summary": f"""WITH {LABELS} SELECT doc_id, count(*) AS n_tagged_sentences, count(*) FILTER (adjudicated_status = 'agreed') AS n_agreed, count(*) FILTER (adjudicated_status = 'disputed') AS n_disputed_open,
        count(*) FILTER (adjudicated_status = 'resolved') AS n_resolved, count(*) FILTER (final_source = 'resolved_to_none') AS n_resolved_to_none FROM labels GROUP BY doc_id""",
    "adjudication_report": f"""WITH {LABELS} SELECT doc_id, ordinal, annotator_a, annotator_a_tags, annotator_b, annotator_b_tags, adjudicated_status, final_tags FROM labels WHERE disputed OR adjudicated_status = 'resolved'""",
    "span_collapse": f"""WITH {TAGS}, m AS (SELECT *, category || ' on ' || doc_id || ' h' || annotator AS span FROM each)
        SELECT doc_id, annotator, kind, category, subcategory, span, count(*) AS spans_n_sentences, string_agg(ordinal::VARCHAR, ',' ORDER BY ordinal) AS context_sentence_ordinals,
               string_agg('text ' || ordinal, ' ' ORDER BY ordinal) AS context_sentence_text, array_to_string(list_sort(list(DISTINCT 'k' || (annotation_id % 3))), '; ') AS matched_keywords FROM m GROUP BY ALL""",
    "coder_names": """WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS doc_id, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS coder, 'n' || (user_id % 7) AS coder_name, event_id FROM events),
        c AS (SELECT doc_id, coder, coder_name, count(*) AS n, min(event_id) AS f FROM r GROUP BY ALL)
        SELECT doc_id, coder, coder_name FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, coder ORDER BY n DESC, f) = 1""",
    "sequential": _labelled("SELECT doc_id, anchor_id FROM cand"),
    "passage_aware": _labelled("SELECT doc_id, anchor_id FROM ctx WHERE keep AND ((doc_id, anchor_id) IN (SELECT (doc_id, anchor_id) FROM inside) OR (doc_id, anchor_id) IN (SELECT (doc_id, anchor_id) FROM ment))"),
    "diagnosis_passages": _sentences("SELECT * FROM lost", VERDICTS, _PASSAGES_LOST),
    "diagnosis_phases": _sentences("""SELECT m.doc_id, m.anchor_id, CASE
        WHEN cand.anchor_id IS NULL THEN 'P1 (candidates): The candidate-identification pass didn''t list this sentence as AI-related.'
        WHEN kind IS NULL THEN 'P2 (kind decision): Filtered as null/non-RAI (returned kind=None).' WHEN kind = 'Neither' THEN 'P2 (kind decision): Filtered as null/non-RAI (returned kind=''Neither'').'
        WHEN rc.anchor_id IS NULL AND mc.anchor_id IS NULL THEN 'P3 (category assignment): No category was returned for this sentence.'
        ELSE 'Tagged by AI but at a different (kind, category, subcategory) than the human.' END AS diagnosis
        FROM v m LEFT JOIN cand USING (doc_id, anchor_id) LEFT JOIN kinds USING (doc_id, anchor_id) LEFT JOIN rc USING (doc_id, anchor_id) LEFT JOIN mc USING (doc_id, anchor_id) WHERE m.sentence_idx % 2 = 0""", VERDICTS),
    "loss_buckets": _sentences("""SELECT string_split(diagnosis, ':')[1] AS bucket, count(*) AS n FROM lost GROUP BY ALL
        UNION ALL SELECT 'Unmatched human (extraction-side, can''t be caught)', count(*) FROM cards WHERE side = 'human' AND anchor_id IS NULL""", VERDICTS, _PASSAGES_LOST, CARDS),
    "missed_anchors": f"WITH {CARDS} SELECT doc_id, anchor_id FROM cards WHERE anchor_id IS NOT NULL GROUP BY ALL HAVING bool_or(side = 'human') AND NOT bool_or(side = 'ai')",
    "few_shot": _few_shot(),
    "annotation_rows": f"""WITH {CARDS}, {_ROW_CARDS} SELECT doc_id, CASE side WHEN 'ai' THEN 'AI' ELSE 'Human' END AS source, CASE WHEN side = 'ai' THEN 'AI' WHEN coder = 'A' THEN 'A — Ann' ELSE 'B — Ben' END AS coder,
        coalesce(anchor_id, '(unmatched)') AS anchor_id, coalesce('text ' || anchor_id, sentence_excerpt) AS sentence, kind AS type, category, subcategory, strength::BIGINT AS strength, coalesce(place0, 1000000000)::BIGINT AS place FROM rows""",
    "split_index": """WITH g AS (SELECT n_name AS company, (2000 + c_custkey % 4)::VARCHAR AS year, 'acc/' || (c_custkey % 8 = 1)::VARCHAR AS accession, count(*) AS n_rows
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), k AS (SELECT *, replace(company, ' ', '_') AS folder, count(*) OVER (PARTITION BY company, year) > 1 AS many FROM g)
        SELECT company, year, accession, n_rows, folder || '/' || folder || '_' || year || CASE WHEN many THEN '_' || replace(accession, '/', '-') ELSE '' END || '.csv' AS path FROM k""",
    "experiment_log": f"""WITH {CARDS}, {_PEOPLE}, {_COUNTS}, c AS ({_ALL_COUNTS}) SELECT doc_id, 'baseline' AS version_id, ai_total, anchors_with_human + human_unmatched AS human_total_anchors,
        anchors_with_ai_and_human AS anchors_caught, greatest(0, anchors_with_human + human_unmatched - anchors_with_ai_and_human) AS anchors_missed,
        greatest(0, anchors_with_human - anchors_with_ai_and_human) AS missed_anchors FROM c""",
    "top_index": f"""WITH {CARDS}, {_PEOPLE}, {_COUNTS}, c AS ({_ALL_COUNTS}) SELECT doc_id, 'baseline, xml_cot' AS versions, ai_total, human_a_total, human_b_total FROM c""",
    "ai_only": f"""WITH {CARDS}, {_COUNTS}, {_ROW_CARDS} SELECT rows.doc_id, coalesce(rows.anchor_id, '(unmatched)') AS anchor_id, coalesce('text ' || rows.anchor_id, sentence_excerpt) AS sentence, kind, category, subcategory,
        coalesce(strength::VARCHAR, '') AS strength, coalesce(place0, 1000000000)::BIGINT AS place FROM rows LEFT JOIN sources ON rows.doc_id = sources.doc_id AND rows.anchor_id = sources.anchor_id
        WHERE side = 'ai' AND (rows.anchor_id IS NULL OR NOT (a OR b))""",
    "paragraph_tokens": _sentences(_TOKENS, *_PARAGRAPHS),
    "paragraph_tokens_joined": _sentences(f"""SELECT *, CASE WHEN is_sentence AND substring(anchor_id, 3)::INT % 3 != 0
        THEN ['source-ai', 'source-coder-a', 'source-coder-b', 'source-coders-both', 'source-ai-and-a', 'source-ai-and-b', 'source-ai-and-both'][substring(anchor_id, 3)::INT % 7 + 1] ELSE '' END AS source_class FROM ({_TOKENS})""", *_PARAGRAPHS),
    "run_strategy": _sentences(f"""SELECT doc_id, kind, 'c1' AS category, subcategory, strength::BIGINT AS strength, count(*) AS n FROM (
        SELECT DISTINCT doc_id, lower({_key('line')}) AS k, CASE WHEN r = 0 THEN 'Risk' ELSE 'Risk Mitigation' END AS kind, CASE WHEN r = 0 THEN 's1' ELSE 's2' END AS subcategory, CASE WHEN r = 1 THEN 2 END AS strength
        FROM (SELECT *, CASE WHEN regexp_matches(line, '(?i)tion') THEN 0 WHEN regexp_matches(line, '(?i)ment') THEN 1 END AS r
              FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM s)) WHERE r IS NOT NULL) GROUP BY ALL"""),
    "parse_replies": """SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'refused' WHEN 1 THEN 'truncated' WHEN 2 THEN 'empty' ELSE 'ok' END AS status,
        CASE WHEN o_orderkey % 4 = 3 THEN 200000 END::BIGINT AS seq, CASE WHEN o_orderkey % 4 = 3 THEN o_orderpriority END AS sentence, CASE WHEN o_orderkey % 4 = 3 THEN 'Risk' END AS kind FROM orders""",
}

# the forms within a document's row have the results of the forms by rows
ORACLES |= {"chunk_texts_joined": ORACLES["chunk_texts"], "row_chunks_full": ORACLES["chunks_full"], "row_chunks_window": ORACLES["chunks_window"],
            "row_chunks_sentence": ORACLES["chunks_sentence"], "row_chunks_overlap": ORACLES["chunks_overlap"]}


def _phased(kept: str, *ctes: str) -> str:
    """Annotations of a phased run: what the phases keep, labelled by the first rule, once for each normalised sentence, valid labels only."""
    has = lambda p: f"regexp_matches(text, '(?i)({p})')"
    return _sentences(f"""SELECT doc_id, CASE r WHEN 1 THEN 'Risk' ELSE 'Risk Mitigation' END AS kind, 'c1' AS category, CASE r WHEN 1 THEN 's1' ELSE 's2' END AS subcategory,
        CASE r WHEN 2 THEN 2 END::BIGINT AS strength, count(DISTINCT lower({_key('text')})) AS n FROM lab WHERE r <= 2 AND {kept} GROUP BY doc_id, r""",
        f"""lab AS (SELECT *, CASE WHEN {has('tion')} THEN 1 WHEN {has('ment')} THEN 2 WHEN {has('schaft')} THEN 3 WHEN {has('ciones')} THEN 4 END AS r, {has('on|en')} AS about,
                    {has('schaft|ment')} AS begins, {has('the')} AS idle, coalesce(lag({has('schaft|ment')}) OVER (PARTITION BY doc_id ORDER BY sentence_idx), false) AS follows FROM s)""", *ctes)


ORACLES |= {"run_sequential": _phased("about"), "run_passage_aware": _phased("(begins OR follows OR about) AND NOT idle")}

_LOOSE = """
    loose AS (SELECT *, 'unmatched_' || side || '_' || (row_number() OVER (PARTITION BY doc_id, side ORDER BY key) - 1) AS anchor_id
              FROM (SELECT *, CASE WHEN len(hc) > 0 THEN 'human' ELSE 'ai' END AS side FROM frame WHERE NOT matched))"""


def _unmatched(mode: str) -> str:
    return _on_frame(f"""SELECT doc_id, anchor_id, key AS sentence_text, {_J('hc')} AS human_categories, {_J('hk')} AS human_kinds, {_J('hs')} AS human_subcats,
        {_J('ac')} AS ai_categories, {_J('ak')} AS ai_kinds, {_J('"as"')} AS ai_subcats, am::BIGINT AS ai_strength_max, hm::BIGINT AS human_strength_max FROM loose""", mode, _LOOSE)


ORACLES |= {
    "label_frame_unmatched": _unmatched("union"), "label_frame_both_unmatched": _unmatched("intersection"),
    "comparison_unmatched": _on_frame(f"""SELECT doc_id, anchor_id, {_J('ac')} AS ai_categories, {_J('hc')} AS human_categories, {_J('"as"')} AS ai_subcategories, {_J('hs')} AS human_subcategories,
        am::BIGINT AS ai_strength, hm::BIGINT AS human_strength, CASE WHEN len(hc) = 0 THEN 'ai_only' ELSE 'human_only' END AS agreement FROM loose""", "union", _LOOSE),
}
