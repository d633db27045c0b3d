"""URL rules and lists: a blocked Bloom filter before an exact hash join.

Listed entries are (a) rules, a host suffix with a path prefix and a verdict, and (b) canonical URLs
that are blocked.  A page's candidates are its canonical URL and its host suffixes joined to path
prefixes, of only those label counts and prefix lengths that the rules have.  All listed entries go into a
blocked Bloom filter (512 bits a block, one bit in each of its eight words, so that one lookup reads one
row); candidates that pass it are joined exactly with the entries, which removes false positives.

Bounds: the filter has at most ``MAX_BLOCKS`` rows of 72 bytes, whatever the lists' size (fuller blocks
only let more candidates through to the exact join), and that bounds its broadcast.  Rules and list entries are each
broadcast up to ``SMALL_LIST`` rows, else joined by hash partitions.  Each distinct URL is judged once, and pages with a very
common URL get its verdict on the map side.

Defined results: a null url, or one without ``://``, has an empty host and path and is allowed; of several fitting rules the
longest (host with path, then host) wins, block before allow at a full tie; every row comes back, repeated rows too; urls of any
length are judged whole; empty lists allow everything; an empty table gives an empty result; other columns of any name are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import joined_by_key, pruned, stored

MAX_BLOCKS = 1 << 17
SMALL_LIST = 20_000
BITS_PER_ENTRY = 16

# Fixed values of the contract: host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def _lower(c: F.Column) -> F.Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: F.Column) -> F.Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return _lower(rest)


def path_of(url: F.Column) -> F.Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def canonical(url: F.Column) -> F.Column:
    """Host without a leading www. or m., path without a final slash or .html; no scheme, query, fragment."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    return F.concat(host, F.regexp_replace(path_of(url), r"(/|\.html)$", ""))


def _block(key: str, blocks: int) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: str, word: int) -> F.Column:
    """The bit of word ``word``: six bits of a second hash."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit("bit")), 6 * word).bitwiseAND(F.lit(63)).cast("int")


def bloom_filter(entries: DataFrame, n_entries: int, key: str = "_key") -> tuple[DataFrame, int]:
    """The filter's rows (block and eight words) and its number of blocks."""
    blocks = 16
    while blocks < MAX_BLOCKS and blocks * 512 < n_entries * BITS_PER_ENTRY:
        blocks *= 2
    one = F.lit(1).cast("long")
    words = [F.bit_or(F.call_function("shiftleft", one, _bit(key, w))).alias(f"_w{w}") for w in range(8)]
    return entries.groupBy(_block(key, blocks).alias("_block")).agg(*words), blocks


def passes_filter(rows: DataFrame, bloom: DataFrame, blocks: int, key: str = "_key", passes: bool = True) -> DataFrame:
    """The rows whose key may be in the filter, or, if not ``passes``, those whose key is not in it."""
    hit = F.lit(True)
    for w in range(8):
        hit &= F.call_function("shiftright", F.col(f"_w{w}"), _bit(key, w)).bitwiseAND(F.lit(1)) == 1
    own = rows.withColumn("_block", _block(key, blocks)).join(F.broadcast(bloom), "_block", "left")
    hit = F.coalesce(hit, F.lit(False))
    return own.where(hit if passes else ~hit).select(*rows.columns)


def judge_urls(
    pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, listed.

    ``rules``: host, path, verdict.  ``listed``: canonical (the canonical URLs that are blocked).
    """
    rule_entries = rules.select(
        F.concat(F.lit("r "), "host", "path").alias("_key"), "host", "path", "verdict"
    ).groupBy("_key", "host", "path").agg(F.max("verdict").alias("verdict"))
    nothing = F.lit(None).cast("string")
    list_entries = listed.select(F.concat(F.lit("u "), "canonical").alias("_key")).distinct().select(
        "_key", nothing.alias("host"), nothing.alias("path"), F.lit("block").alias("verdict")
    )
    entries = stored(rule_entries.unionAll(list_entries), "listed")
    shape = entries.where("host is not null").agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"),
        F.collect_set(F.char_length("path")).alias("lengths"),
        F.count(F.lit(1)).alias("n"),
    ).first()  # distinct label counts and prefix lengths: a few integers
    n_entries = entries.count()

    rows = pruned(pages, _id=id_col, _url=url_col)
    rows = rows.withColumn("_host", host_of(F.col("_url"))).withColumn("_path", path_of(F.col("_url")))
    labels = F.split("_host", r"\.")
    prefixes = [
        F.when(
            (F.size(labels) >= k) & (F.char_length("_path") >= m),
            F.concat(
                F.lit("r "), F.substring_index(F.col("_host"), ".", -k), F.expr(f"substring(_path, 1, {m})")
            ),
        )
        for k in sorted(shape.labels)
        for m in sorted(shape.lengths)
    ]
    whole = F.concat(F.lit("u "), canonical(F.col("_url")))
    # each url is judged once; those without a host are nobody's candidates and pass no join
    distinct = stored(rows.where("_host != ''").groupBy("_url", "_host", "_path").agg(F.count(F.lit(1)).alias("_rows")), "urls")
    candidates = distinct.select("_url", F.explode(F.array_distinct(F.array_compact(F.array(whole, *prefixes)))).alias("_key"))
    bloom, blocks = bloom_filter(entries, n_entries)
    possible = passes_filter(candidates, stored(bloom, "bloom"), blocks)
    # the rules are few and broadcast; a long list is joined by hash partitions, without the rules' keys in its shuffle
    small = lambda df, n: F.broadcast(df) if n <= SMALL_LIST else df.hint("shuffle_hash")
    by_rule = possible.where(F.col("_key").startswith("r ")).join(small(entries.where("host is not null"), shape.n), "_key")
    by_list = possible.where(F.col("_key").startswith("u ")).join(small(entries.where("host is null"), n_entries - shape.n), "_key")
    exact = by_rule.unionByName(by_list)
    length = F.struct(F.char_length(F.concat("host", "path")), F.char_length("host"), F.col("verdict"))
    best = exact.groupBy("_url").agg(
        F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), F.when(F.col("host").isNotNull(), length)).alias("_best"),
        F.max(F.col("host").isNull()).alias("_listed"),
    )
    table = stored(distinct.select("_url", "_rows").join(best, "_url", "left"), "judged")
    judged = joined_by_key(rows.where("_host != ''"), table, "_url", "_rows")
    judged = judged.unionByName(rows.where("_host = ''"), allowMissingColumns=True)
    in_list = F.coalesce("_listed", F.lit(False))
    by_method = F.when(in_list, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", by_method).alias("verdict"),
        in_list.alias("listed"),
    )
