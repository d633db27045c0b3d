"""A Merkle manifest of a dataset: every row's proof of membership, with DataFrame and SQL functions only.

1. Each row is hashed into a leaf in one pass over the texts; leaves are kept (some 80 bytes a row).
2. Leaves get their places: a range partitioning by (part, id) with counts of the pieces, so that no part, however large, is one
   task's work (:func:`placed`).
3. Bottom-up: every ``RUN`` consecutive nodes of a part become their hash, one persisted level after the other, until each part has
   one node, its subroot.  The subroots, ordered by part, are leaves of a tree of the same kind, whose last node is the root.
4. Top-down: children join their parents on (part, place div ``RUN``), keys of at most ``RUN`` rows.  A child puts its siblings before
   the proof that it inherits.  The lowest join is with the leaves themselves, so that no whole proof of a leaf is stored.

A proof is the concatenated digests of all siblings from the leaf up, and for each level one small number that says how many of them
stand before and after.  Its size grows with the logarithm of the rows; a level has a third of the rows of the level below.

Defined results: null columns are hashed as ``-``; an empty text is ``0:``; a null part is a part of its own and comes first; null ids
come first in their part; rows of equal id are ordered by their leaf, so that rows which repeat wholly have the same leaf and
neighbouring places; a part of one row has its leaf as subroot, and one part's subroot is the root; texts of any length are hashed
whole; an empty table gives an empty result; other columns of any name are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .shared import release, scratch_scope, stored

RUN = 3
DIGEST = 32
PROOF = ("_sub", "_proof", "_steps")


def digest(hexes: Column) -> Column:
    """SHA-256, as 32 bytes, of a text."""
    return F.unhex(F.sha2(hexes.cast("binary"), 256))


def as_hex(digests: Column) -> Column:
    """Digests, one or several in a row, as lower-case hex text."""
    return F.lower(F.hex(digests))


def leaf(*columns: Column) -> Column:
    """The digest of a row: each value as its UTF-8 byte count, a colon and itself, null as ``-``."""
    said = [c.cast("string") for c in columns]
    return digest(F.concat(*(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in said)))


def placed(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` (stored), stored again with ``_pos``, their place from 0 within ``group`` by ``order``, and ``_n``, the group's size.

    Rows are dealt by ranges and sorted; what precedes a piece of a group is summed over the pieces, of which there are no more than
    ranges and groups.
    """
    tie = rows.withColumn("_tie", F.monotonically_increasing_id())  # deals out rows that repeat wholly
    dealt = tie.repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie").drop("_tie")
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "placed")
    piece = F.shiftrightunsigned("_at", 33).alias("_piece")
    pieces = dealt.groupBy(group, piece).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = stored(pieces.select(group, "_piece", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("_n")), "pieces")
    small = pieces.count() <= shared.SMALL_SIDE
    found = dealt.withColumn("_piece", piece).join(F.broadcast(pieces) if small else pieces, [group, "_piece"])
    found = stored(found.withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_at", "_piece", "_shift"), "nodes")
    release(dealt, pieces)
    return found


def build(nodes: DataFrame) -> list[DataFrame]:
    """The persisted levels of every group's tree, from ``nodes`` (stored: _g, _pos, _hash, _n) up.

    A level above has the nodes of those groups that had several, with ``_kids``, the digests of its run.
    """
    levels = [nodes]
    most = nodes.agg(F.max("_n").alias("n")).first().n or 0
    while most > 1:
        below = levels[-1].where("_n > 1")
        kids = F.array_sort(F.collect_list(F.struct("_pos", "_hash")))["_hash"]
        runs = below.groupBy("_g", F.expr(f"_pos div {RUN}").alias("_pos")).agg(kids.alias("_kids"), F.expr(f"(first(_n) + {RUN - 1}) div {RUN}").alias("_n"))
        hexes = F.array_join(F.transform("_kids", as_hex), "")
        levels.append(stored(runs.withColumn("_hash", digest(hexes)), "level"))
        most = -(-most // RUN)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """_g and _hash of each group's last node."""
    out = None
    for level in levels:
        ends = level.where("_n = 1").select("_g", "_hash")
        out = ends if out is None else out.unionByName(ends)
    return out


def push(levels: list[DataFrame], starts: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The lowest level's rows with ``_sub``, ``_proof`` and ``_steps``, and the stored level above that they read.

    ``starts`` has the three columns for each group's last node, by ``_g``; without it nothing stands above.
    """
    above, nothing = None, {"_sub": F.lit(None).cast("binary"), "_proof": F.lit(b""), "_steps": F.array().cast("array<tinyint>")}
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        ends = level.where("_n = 1")
        found = ends.withColumns(nothing) if starts is None else ends.join(starts, "_g")
        if above is not None:
            up, place = F.expr(f"_pos div {RUN}"), F.expr(f"cast(_pos % {RUN} as int)")
            parents = above.select("_g", F.col("_pos").alias("_up"), F.col("_kids").alias("_run"), *PROOF)
            joined = level.where("_n > 1").withColumn("_up", up).withColumn("_place", place).join(parents, ["_g", "_up"])
            others = F.concat(*(F.when(F.col("_place") == i, F.lit(b"")).otherwise(F.coalesce(F.get("_run", F.lit(i)), F.lit(b""))) for i in range(RUN)))
            step = (F.col("_place") * RUN + F.size("_run") - 1 - F.col("_place")).cast("tinyint")
            joined = joined.withColumn("_proof", F.concat(others, "_proof")).withColumn("_steps", F.concat(F.array(step), "_steps"))
            found = found.unionByName(joined.drop("_up", "_place", "_run"))
        if depth:
            found, old = stored(found.drop("_hash"), "pushed"), above
            if old is not None:
                release(old)
            above = found
    return found, above


def fold(start: Column, proof: str = "_proof", steps: str = "_steps") -> Column:
    """The root that follows from a leaf and its proof, as 32 bytes."""
    zero = F.struct(start.alias("h"), F.lit(1).alias("at"))

    def climb(so_far: Column, step: Column) -> Column:
        before, after = F.floor(step / RUN).cast("int") * DIGEST, (step % RUN).cast("int") * DIGEST
        cut = lambda at, n: F.substring(F.col(proof), at, n)
        run = F.concat(cut(so_far["at"], before), so_far["h"], cut(so_far["at"] + before, after))
        return F.struct(digest(as_hex(run)).alias("h"), (so_far["at"] + before + after).alias("at"))

    return F.aggregate(F.col(steps), zero, climb, lambda last: last["h"])


def prove(docs: DataFrame, claimed: Column | None = None, id_col: str = "doc_id", part_col: str = "source",
          other_cols: tuple[str, ...] = ("lang", "n_chars"), text_col: str = "text") -> DataFrame:
    """One row per input row: id, leaf, subroot, root, proof and steps, proof_sha256, folded_root, verified.

    ``claimed`` is the text that a holder of the row shows (a Column over ``docs``; the text itself by default): the folded root follows
    from the leaf that this text gives and the proof of the true leaf, and is verified if it is the root.
    """
    spark, col = docs.sparkSession, lambda c: F.col(f"`{c}`")
    hashed = lambda text: leaf(col(id_col), col(part_col), *(col(c) for c in other_cols), text)
    part = F.coalesce(F.concat(F.lit("s"), col(part_col)), F.lit("n"))  # a null part comes before all others, an empty one too
    shown = F.lit(None).cast("binary") if claimed is None else F.when(~claimed.eqNullSafe(col(text_col)), hashed(claimed))
    with scratch_scope(spark) as keep:
        rows = stored(docs.select(col(id_col).alias("_id"), part.alias("_g"), hashed(col(text_col)).alias("_hash"), shown.alias("_shown")), "leaves")
        leaves = placed(rows, "_g", "_id", "_hash")
        release(rows)
        levels = build(leaves)
        ends = stored(tops(levels), "subroots")
        heads = placed(ends.select(F.lit("").alias("_g"), F.col("_g").alias("_part"), "_hash"), "_g", "_part")
        above = build(heads)
        top = tops(above).first()
        root = F.unhex(F.lit(top._hash.hex() if top else ""))
        starts, _ = push(above)
        starts = stored(starts.select(F.col("_part").alias("_g"), F.col("_hash").alias("_sub"), "_proof", "_steps"), "starts")
        found, parents = push(levels, starts)
        keep += [leaves, starts, *([] if parents is None else [parents])]
        folded = fold(F.coalesce("_shown", "_hash"))
        return found.select(
            F.col("_id").alias(id_col), as_hex(F.col("_hash")).alias("leaf"), as_hex(F.col("_sub")).alias("subroot"), as_hex(root).alias("root"),
            F.col("_proof").alias("proof"), F.col("_steps").alias("steps"), F.sha2(as_hex(F.col("_proof")).cast("binary"), 256).alias("proof_sha256"),
            as_hex(folded).alias("folded_root"), (folded == root).alias("verified"),
        )
