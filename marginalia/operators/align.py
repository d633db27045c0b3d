"""Alignment of annotations to sentences: exact key, then 80-character prefix, then containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import computed
from ..functions.text import clean_label, excerpt, match_key, normalize_text, split_label
from ..scratch import dropped, settled

PREFIX, LEAST, RATIO = 80, 40, 1.5
GRAM = 20
SPLIT = 4096
DIMENSION = 10_000
UNRESOLVED = "(unresolved)"


def small_side(df: DataFrame, bound: int = DIMENSION) -> DataFrame:
    """A dimension for a join: broadcast if it has at most ``bound`` rows, else as it is."""
    return F.broadcast(df) if len(df.limit(bound + 1).take(bound + 1)) <= bound else df


def resolve_category(rows: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Adds category and subcategory to rows with ``kind`` and a raw ``subcategory``.

    ``head; tail`` is taken as it stands; else the (kind, subcategory) must name one category, or it is unresolved.
    """
    has, head, tail = split_label(F.col("subcategory"))
    names = taxonomy.groupBy(F.col("kind").alias("_k"), F.lower("subcategory").alias("_s")).agg(F.collect_set("category").alias("_c"))
    found = rows.join(small_side(names), (F.col("kind") == F.col("_k")) & (F.lower(clean_label(F.col("subcategory"))) == F.col("_s")), "left")
    category = F.when(has, head).when(F.size("_c") == 1, F.element_at("_c", 1)).otherwise(F.lit(UNRESOLVED))
    sub = F.when(has, tail).otherwise(clean_label(F.col("subcategory")))
    return found.withColumn("category", category).withColumn("subcategory", sub).drop("_k", "_s", "_c")


def _digest(c: Column | str) -> Column:
    return F.unhex(F.md5(F.col(c) if isinstance(c, str) else c))


def _grams(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep``, ``g`` (hashes of stretches of ``GRAM`` characters of ``text``, longer than ``LEAST``), ``own`` and ``n_own``.

    A string that lies in another has all its ``own`` grams among the other's grams.  These are the stretches that begin a word, but the
    first word, which may be cut.  Few strings have none: their first word is longer than ``GRAM``.  They take, of each run of grams, the one
    of least hash, and so does, besides, every string with so long a word.  Texts are cut in pieces, so that long ones stay linear.
    """
    run, piece = LEAST - GRAM + 1, 64
    hashes = f"flatten(transform(_p, p -> transform(sequence(1, greatest(1, char_length(p) - {GRAM - 1})), i -> xxhash64(substring(p, i, {GRAM})))))"
    rows = computed(
        rows, _w=f"array_distinct(transform(regexp_extract_all({text}, r'(?s)(?<= )(?=(.{{{GRAM}}}))', 1), x -> xxhash64(x)))",
        _p=f"case when {text} rlike '[^ ]{{{GRAM + 1}}}' then regexp_extract_all({text}, r'(?s)(?=(.{{{GRAM},{piece + GRAM - 1}}})).{{1,{piece}}}', 1) else array() end",
        _c=f"case when size(_p) > 0 then {hashes} else cast(array() as array<bigint>) end",
        _m=f"case when size(_c) > 0 then array_except(transform(sequence(1, greatest(1, size(_c) - {run - 1})), i -> array_min(slice(_c, i, {run}))), _w) else _c end",
    )
    rows = rows.withColumn("n_own", F.when(F.size("_w") > 0, F.size("_w")).otherwise(F.size("_m")))
    each = "concat(transform(_w, x -> named_struct('g', x, 'own', true)), transform(_m, x -> named_struct('g', x, 'own', size(_w) = 0)))"
    return rows.select(*keep, "n_own", F.explode(F.expr(each)).alias("x")).select(*keep, "n_own", "x.g", "x.own")


def _candidates(left: DataFrame, near: DataFrame) -> DataFrame:
    """(q, doc_id, i) of a left key (q, doc_id, key) and a distinct sentence (doc_id, i, k), in either of which the other may lie; none that does is missing.

    Strings of either side are looked up by that of their own grams which the fewest strings of the other side have in this document, if
    the other side has all of them.  Only numbers are shuffled: once to count grams by side, once to choose, once to meet.  A gram
    that more than ``SPLIT`` strings of a side have is dealt out over parts, which is planned for only if there is one.
    """
    side = lambda rows, of, text, is_key: _grams(rows.select("doc_id", F.col(of).cast("long").alias("id"), F.length(text).alias("n"), F.lit(is_key).alias("is_key"), text), text, "doc_id", "id", "n", "is_key")
    both = side(left, "q", "key", True).unionByName(side(near, "i", "k", False))
    have = Window.partitionBy("doc_id", "g")
    both = both.withColumn("keys", F.count_if("is_key").over(have)).withColumn("lines", F.count_if(~F.col("is_key")).over(have)).where("keys > 0 and lines > 0")
    both = both.withColumn("peers", F.when(F.col("is_key"), F.col("keys")).otherwise(F.col("lines"))).withColumn("others", F.col("keys") + F.col("lines") - F.col("peers"))
    met = settled(both.select("doc_id", "g", "id", "n", "is_key", "own", "n_own", "peers", "others"))

    one = met.where("own").groupBy("doc_id", "id", "is_key").agg(F.min(F.struct("others", "g")).alias("r"), F.count(F.lit(1)).alias("m"), F.first("n").alias("n"), F.first("n_own").alias("n_own"))
    one = one.where("m = n_own").select("doc_id", "r.g", F.col("id").alias("id1"), F.col("n").alias("n1"), F.col("is_key").alias("key1"), F.col("r.others").alias("many"))
    other = met.select("doc_id", "g", "id", "n", "is_key", F.col("peers").alias("many"))
    fits = (F.col("key1") != F.col("is_key")) & F.col("n").between(F.col("n1"), RATIO * F.col("n1"))
    key, line = F.when(F.col("key1"), F.col("id1")).otherwise(F.col("id")).alias("q"), F.when(F.col("key1"), F.col("id")).otherwise(F.col("id1")).alias("i")
    pairs = lambda a, b, *on: a.drop("many").join(b.drop("many"), ["doc_id", "g", *on]).where(fits).select(key, "doc_id", line)
    most = met.agg(F.max("peers")).first()[0] or 0

    def ended(found: DataFrame) -> DataFrame:
        out = settled(found.distinct())
        dropped(met)
        return out

    if most <= SPLIT:
        return ended(pairs(one, other))
    parts, rare, common = F.expr(f"cast(many div {SPLIT} as int)"), F.col("many") <= SPLIT, F.col("many") > SPLIT
    dealt = other.where(common).withColumn("salt", F.pmod(F.xxhash64("id"), parts + 1).cast("int"))
    asked = one.where(common).withColumn("salt", F.explode(F.sequence(F.lit(0), parts)))
    return ended(pairs(one.where(rare), other.where(rare)).unionByName(pairs(asked, dealt, "salt")))


def find_anchors(queries: DataFrame, sentences: DataFrame, key_col: str = "sentence") -> DataFrame:
    """(doc_id, key) -> sentence_idx, anchor_id, stage for the distinct keys of ``queries`` that match."""
    asked = queries.select("doc_id", match_key(F.col(key_col)).alias("key")).where("key != ''")
    return _anchors(asked.select("doc_id", _digest("key").alias("d"), "key"), sentences, True).select("doc_id", "key", "sentence_idx", "stage", "anchor_id")


def _anchors(asked: DataFrame, sentences: DataFrame, texts: bool) -> DataFrame:
    """(doc_id, d) -> sentence_idx, anchor_id, stage for the distinct keys of ``asked`` (doc_id, d, key; d: the key's digest) that match; with key, if ``texts``.

    The first two stages are equi-joins on 16-byte digests of keys and of prefixes.  What neither finds meets the distinct sentences of
    its document that share its rarest gram (:func:`_candidates`), and only such pairs are compared.  Of several sentences the
    first in the document holds, so equal sentences count as their first one from the start.  Only what is found stays on disk.
    """
    keyed = settled(sentences.select("doc_id", "sentence_idx", match_key(F.col("text")).alias("k")).where("k != ''"))  # keys are made once, for three uses
    distinct = keyed.groupBy("doc_id", _digest("k").alias("d")).agg(F.min("sentence_idx").alias("i1"))
    asked = asked.groupBy("doc_id", "d").agg(F.first("key").alias("key"))
    tried = asked.join(distinct, ["doc_id", "d"], "left")

    head = lambda c: _digest(F.substring(c, 1, PREFIX)).alias("h")
    by_head = keyed.where(F.length("k") >= PREFIX).groupBy("doc_id", head("k")).agg(F.min("sentence_idx").alias("i2"))
    unmet = F.when(F.col("i1").isNull() & (F.length("key") >= PREFIX), head("key"))
    kept = F.col("key") if texts else F.when((F.length("key") > LEAST) & F.col("i1").isNull() & F.col("i2").isNull(), F.col("key"))
    tried = settled(tried.withColumn("h", unmet).join(by_head, ["doc_id", "h"], "left").select("doc_id", "d", kept.alias("key"), "i1", "i2", F.monotonically_increasing_id().alias("q")))
    columns = ["doc_id", "d", "key"] if texts else ["doc_id", "d"]
    hit = lambda rows, index, stage: rows.select(*columns, F.col(index).alias("sentence_idx"), F.lit(stage).alias("stage"))
    found = hit(tried.where("i1 is not null"), "i1", "exact").unionByName(hit(tried.where("i2 is not null"), "i2", "prefix"))

    left = tried.where((F.length("key") > LEAST) & F.col("i1").isNull() & F.col("i2").isNull()).select("q", "doc_id", "d", "key")
    firsts = distinct.join(left.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("i1").alias("sentence_idx"))
    near = settled(keyed.where(F.length("k") > LEAST).join(firsts, ["doc_id", "sentence_idx"]).select("doc_id", F.col("sentence_idx").cast("long").alias("i"), "k"))
    dropped(keyed)
    pairs = _candidates(left.select("q", "doc_id", "key"), near)
    met = pairs.join(left, ["q", "doc_id"]).join(near, ["doc_id", "i"]).where(F.contains(F.col("k"), F.col("key")) | F.contains(F.col("key"), F.col("k")))
    part = met.groupBy("q", "doc_id").agg(F.first("d").alias("d"), F.first("key").alias("key"), F.min("i").cast("int").alias("i3"))
    out = settled(found.unionByName(hit(part, "i3", "containment")).withColumn("anchor_id", F.format_string("s-%05d", "sentence_idx")))
    dropped(tried, near, pairs)
    return out


def classify_anchor(ai: Column, a: Column, b: Column) -> Column:
    """The source of an anchor by who tagged it."""
    return (
        F.when(ai & a & b, "ai_and_both").when(ai & a, "ai_and_a").when(ai & b, "ai_and_b").when(ai, "ai")
        .when(a & b, "coders_both").when(a, "coder_a").when(b, "coder_b").otherwise("")
    )


def align(sentences: DataFrame, ai: DataFrame, human: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Cards of both sides in long form; ``anchor_id`` is null where no sentence matches.

    ai: doc_id, sentence, kind, category, subcategory, strength[, reasoning].  human: doc_id, coder, coder_name,
    sentence, kind, subcategory, strength.  Human rows without a sentence or a kind make no card.
    """
    none = F.lit(None).cast("string")
    reasoning = F.col("reasoning") if "reasoning" in ai.columns else none
    ai_cards = ai.select(
        "doc_id", F.lit("ai").alias("side"), none.alias("coder"), none.alias("coder_name"), "kind", "category", "subcategory", "strength",
        excerpt(F.coalesce("sentence", F.lit(""))).alias("sentence_excerpt"), reasoning.alias("reasoning"), match_key(F.col("sentence")).alias("key"),
    )
    people = human.where((F.btrim(F.coalesce("sentence", F.lit(""))) != "") & (F.btrim(F.coalesce("kind", F.lit(""))) != ""))
    people = resolve_category(people.withColumn("kind", F.btrim("kind")), taxonomy)
    human_cards = people.select(
        "doc_id", F.lit("human").alias("side"), "coder", "coder_name", "kind", "category", clean_label(F.col("subcategory")).alias("subcategory"), "strength",
        excerpt(normalize_text(F.col("sentence"))).alias("sentence_excerpt"), none.alias("reasoning"), match_key(F.col("sentence")).alias("key"),
    )
    cards = ai_cards.unionByName(human_cards).withColumn("d", _digest("key"))
    # cards meet their anchors by digest, without their text
    anchors = _anchors(cards.where("key != ''").select("doc_id", "d", "key"), sentences, False).select("doc_id", "d", "sentence_idx", "anchor_id")
    return cards.join(anchors, ["doc_id", "d"], "left").drop("key", "d")


def anchor_sources(cards: DataFrame) -> DataFrame:
    """doc_id, anchor_id, source."""
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    seen = cards.where("anchor_id is not null").groupBy("doc_id", "anchor_id").agg(
        flag(F.col("side") == "ai").alias("ai"), flag(F.col("coder") == "A").alias("a"), flag(F.col("coder") == "B").alias("b")
    )
    return seen.select("doc_id", "anchor_id", "ai", "a", "b", classify_anchor(F.col("ai"), F.col("a"), F.col("b")).alias("source"))


def align_counts(cards: DataFrame, human: DataFrame | None = None) -> DataFrame:
    """One row per document with the counters of an alignment.

    ``human`` adds the totals over all human rows with a sentence, those without a card too; by default cards stand for them.
    """
    one = lambda c, name: F.count_if(c).alias(name)
    sum_of = lambda c, name, which=None: F.coalesce(F.sum(c if which is None else F.when(which, F.col(c))), F.lit(0)).alias(name)
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    is_ai, is_human = F.col("side") == "ai", F.col("side") == "human"
    # first by anchor, null for what matches none, then by document: cards are made and read once
    by_anchor = cards.groupBy("doc_id", "anchor_id").agg(
        one(is_ai, "n_ai"), one(~is_ai, "n_other"), one(~is_ai & (F.col("category") == UNRESOLVED), "n_unresolved"),
        one(is_human, "n_human"), one(is_human & (F.col("coder") == "A"), "n_a"), one(is_human & (F.col("coder") == "B"), "n_b"),
        flag(is_ai).alias("ai"), flag(F.col("coder") == "A").alias("a"), flag(F.col("coder") == "B").alias("b"),
    )
    matched, people = F.col("anchor_id").isNotNull(), F.col("a") | F.col("b")
    totals = [sum_of("n_human", "human_total"), sum_of("n_a", "human_a_total"), sum_of("n_b", "human_b_total")]
    counts = by_anchor.groupBy("doc_id").agg(
        sum_of("n_ai", "ai_total"), sum_of("n_ai", "ai_matched", matched), sum_of("n_ai", "ai_unmatched", ~matched),
        sum_of("n_other", "human_matched", matched), sum_of("n_other", "human_unmatched", ~matched), sum_of("n_unresolved", "human_unresolved"), *totals,
        one(matched & F.col("ai"), "anchors_with_ai"), one(matched & people, "anchors_with_human"), one(matched & F.col("a"), "anchors_with_a"),
        one(matched & F.col("b"), "anchors_with_b"), one(matched & F.col("a") & F.col("b"), "anchors_with_both_coders"), one(matched & F.col("ai") & people, "anchors_with_ai_and_human"),
    )
    if human is None:
        return counts
    names = ["human_total", "human_a_total", "human_b_total"]
    totals = human.where("sentence is not null").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias(names[0]), one(F.col("coder") == "A", names[1]), one(F.col("coder") == "B", names[2])
    )
    return counts.drop(*names).join(totals, "doc_id", "left").na.fill(0).select(counts.columns)


def unresolved_cards(cards: DataFrame) -> DataFrame:
    """Human cards whose category could not be told from kind and subcategory: what the counter ``human_unresolved`` counts, one by one."""
    return cards.where((F.col("side") == "human") & (F.col("category") == UNRESOLVED)).select("doc_id", "coder", "coder_name", "kind", "subcategory", "sentence_excerpt")
