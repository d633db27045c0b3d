"""The registered queries ``opN_<name>`` and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, filter_audit, line_dedup, lm, media, merkle, mixing, quality, secret_scan, simhash, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def referred_urls(pages: DataFrame) -> DataFrame:
    """The list that op3 applies: canonical URLs seen anywhere with a referral parameter (``ref=``)."""
    referral = F.regexp_extract(F.coalesce("url", F.lit("")), r"\?([^#]*)", 1).rlike("(^|&)ref=")
    return pages.where(referral).select(url_filter.canonical(F.col("url")).alias("canonical")).where("canonical != ''")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(pages, rules, referred_urls(pages))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(_table(spark, sf_dir, "documents"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return found.select("doc_id", "held_out", "score", predicted, "lang_cut", "flagged")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, with_ids=False)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(_table(spark, sf_dir, "documents")).shares()


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "width", "height",
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as bigint)")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.joined("base").cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined("spans").alias("spans"),
    )


def without_breaks(docs: DataFrame) -> F.Column:
    """What op11's holders show: where 2 divides the id's CRC-32, the text without its line breaks."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(tampered, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return merkle.prove(docs, without_breaks(docs)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, names = line_dedup.cut_lines(_table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", F.col(names["n_lines"]).alias("n_lines"), F.col(names["n_dropped"]).alias("n_dropped"), F.sha2(F.col(names["text"]).cast("binary"), 256).alias("kept_sha256")
    )


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_toxicity": op2_toxicity,
    "op3_url_filter": op3_url_filter,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality": op5_quality,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_media_columns": op9_media_columns,
    "op10_secret_scan": op10_secret_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_filter_audit": op12_filter_audit,
    "op13_line_dedup": op13_line_dedup,
}

ORACLES = {
    "op3_url_filter": """
        WITH p AS (
            SELECT page_id, url,
                   translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        c AS (
            SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(/|\\.html)$', '') AS canonical,
                   regexp_matches(regexp_extract(coalesce(url, ''), '\\?([^#]*)', 1), '(^|&)ref=') AS referred
            FROM p),
        rules(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
                                     ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        best AS (
            SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
            FROM (SELECT DISTINCT host, path FROM c), rules
            WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
            GROUP BY host, path),
        listed AS (SELECT DISTINCT canonical FROM c WHERE referred AND canonical != '')
        SELECT c.page_id, c.host, c.path, best.rule,
               coalesce(best.rv, CASE WHEN c.host != '' AND listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
               (c.host != '' AND listed.canonical IS NOT NULL) AS listed
        FROM c LEFT JOIN best ON best.host = c.host AND best.path = c.path
               LEFT JOIN listed ON listed.canonical = c.canonical""",
    "op4_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op11_merkle_manifest": """
        WITH RECURSIVE said AS (
            SELECT doc_id, source, text,
                   coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
                   || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
                   -- the lowest bit of the id's CRC-32, before the last inversion
                   list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: i::UBIGINT)), lambda r, i: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))) & 1 AS odd
            FROM documents),
        shown AS (SELECT *, CASE WHEN odd = 1 THEN replace(text, chr(10), '') ELSE text END AS claim FROM said),
        leaves AS (
            SELECT doc_id, coalesce('s' || source, 'n') AS g, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
                   sha256(head || coalesce(octet_length(encode(claim)) || ':' || claim, '-')) AS shown
            FROM shown),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
        lv AS (
            SELECT g, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM ranked
            UNION ALL
            SELECT g, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM lv WHERE n > 1 GROUP BY g, lvl, pos // 3),
        subroots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos FROM lv WHERE n = 1),
        tp AS (
            SELECT 0 AS lvl, pos, h, count(*) OVER () AS n FROM subroots
            UNION ALL
            SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM tp WHERE n > 1 GROUP BY lvl, pos // 3),
        nodes AS (SELECT 0 AS tree, g, lvl, pos, h FROM lv WHERE n > 1 UNION ALL SELECT 1, '', lvl, pos, h FROM tp WHERE n > 1),
        runs AS (
            SELECT tree, g, lvl, pos, coalesce((SELECT string_agg(b.h, '' ORDER BY b.pos) FROM nodes b WHERE b.tree = a.tree AND b.g = a.g AND b.lvl = a.lvl AND b.pos // 3 = a.pos // 3 AND b.pos < a.pos), '') AS before,
                   coalesce((SELECT string_agg(b.h, '' ORDER BY b.pos) FROM nodes b WHERE b.tree = a.tree AND b.g = a.g AND b.lvl = a.lvl AND b.pos // 3 = a.pos // 3 AND b.pos > a.pos), '') AS after
            FROM nodes a),
        up AS (
            SELECT r.g AS own, r.pos AS spot, s.h AS subroot, s.pos AS place, x.tree, x.lvl, row_number() OVER (PARTITION BY r.g, r.pos ORDER BY x.tree, x.lvl) AS k, x.before, x.after
            FROM ranked r JOIN subroots s ON s.g = r.g
            JOIN runs x ON (x.tree = 0 AND x.g = r.g AND x.pos = r.pos // CAST(pow(3, x.lvl) AS BIGINT)) OR (x.tree = 1 AND x.pos = s.pos // CAST(pow(3, x.lvl) AS BIGINT))),
        folded AS (
            SELECT g AS own, pos AS spot, 0 AS k, shown AS h FROM ranked
            UNION ALL
            SELECT f.own, f.spot, f.k + 1, sha256(u.before || f.h || u.after) FROM folded f JOIN up u ON u.own = f.own AND u.spot = f.spot AND u.k = f.k + 1),
        ends AS (SELECT own, spot, arg_max(h, k) AS folded_root FROM folded GROUP BY own, spot),
        proofs AS (SELECT own, spot, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256 FROM up GROUP BY own, spot),
        top AS (SELECT h AS root FROM tp WHERE n = 1)
        SELECT r.doc_id, r.leaf, s.h AS subroot, top.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = top.root AS verified
        FROM ranked r JOIN subroots s ON s.g = r.g JOIN ends e ON e.own = r.g AND e.spot = r.pos LEFT JOIN proofs p ON p.own = r.g AND p.spot = r.pos CROSS JOIN top""",
    "op12_filter_audit": """
        WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        f AS (
            SELECT part, len(w) < 200 AS A, 100 * len(list_distinct(w)) < 50 * len(w) AS B, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS C,
                   regexp_matches(text, '[#$%&*|]') AS D, coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS E,
                   coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
            FROM t LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = t.doc_id),
        m AS (SELECT *, A::INT + 2 * B::INT + 4 * C::INT + 8 * D::INT + 16 * E::INT AS bits FROM f),
        l(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        o AS (
            SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS seq
            FROM l a JOIN l b ON b.bit != a.bit JOIN l c ON c.bit NOT IN (a.bit, b.bit) JOIN l d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN l e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
        s AS (SELECT filter_order, k.step AS step, seq[k.step] AS own, list_sum(seq[1:k.step - 1]) AS before FROM o, (SELECT unnest(range(1, 6)) AS step) k),
        q AS (SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, bits),
        r AS (
            SELECT part, filter_order, step, own, coalesce(before, 0) AS before, CAST(sum(CASE WHEN bits & (coalesce(before, 0)::INT + own) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
                   CAST(sum(CASE WHEN bits & coalesce(before, 0)::INT = 0 AND bits & own != 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
                   CAST(sum(CASE WHEN bits & coalesce(before, 0)::INT != 0 AND bits & own != 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
                   CAST(sum(CASE WHEN bits = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
                   CAST(sum(CASE WHEN bits & coalesce(before, 0)::INT = 0 AND bits & own != 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
                   CAST(sum(CASE WHEN bits & coalesce(before, 0)::INT = 0 AND bits & own != 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
            FROM q, s GROUP BY part, filter_order, step, own, before)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM r""",
    "op13_line_dedup": """
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key, count(DISTINCT doc_id) AS docs, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key),
        g AS (SELECT k.*, coalesce(c.docs >= 5 AND k.doc_id != c.keeper, false) AS gone FROM k LEFT JOIN c ON c.key = k.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM g GROUP BY doc_id""",
}
