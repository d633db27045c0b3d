"""Sentence index: cut, merge, number.

One map stage: a document's sentences are built as an array in its own row, so no text is shuffled however
long the table is.  Boundaries are line breaks, and . ! ? … (with closing marks) before white space, unless a
lower-case letter follows or an abbreviation or initial precedes.  This rule set is our own and smaller than
that of a full segmenter; it meets decimals, section numbers, initials and the listed abbreviations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import computed, running_starts
from ..functions.text import anchor_id

# Abbreviations that end no sentence.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Inc", "Corp", "Ltd", "Co", "No", "vs", "cf", "Sr", "Jr", "St", "Fig", "Sec", "Art")
CUT = "\x01"


def mark_boundaries(text: str) -> str:
    """SQL: the text with a sign after each boundary's white space; without it the text is unchanged.

    Two passes: what is looked at about a mark (abbreviations before it, a small letter behind) is looked at there alone, and takes no sign.
    """
    # the high sign is no letter either; that it stands in the pattern makes the look back go by whole code points
    short = rf"(?:^|[^\p{{L}}\p{{N}}]|{chr(0x10FFFF)})(?:{'|'.join(ABBREVIATIONS)}|\p{{Lu}})\."
    closing = r"[\"”’)\]]"
    steps = [
        rf"(?:[!?…]|\.(?:(?={closing})|(?<!{short}))){closing}*+\s++(?!\p{{Ll}})",
        r"\n\s*+",
    ]
    out = f"replace(coalesce({text}, ''), '{CUT}', ' ')"
    for pattern in steps:
        out = f"regexp_replace({out}, r'{pattern}', r'$0{CUT}')"
    return out


def sentence_arrays(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and ``sentences``: array of (text, char_start, char_end) in order; and the columns ``keep``."""
    lead = r"char_length(regexp_extract(x, r'^\s*', 0))"
    body = r"regexp_replace(x, r'^\s+|\s+$', '')"
    # a piece joins the one before it if that ends with a colon, or has no hard end and this starts in lower case
    joins = r"i > 0 and (_r[i - 1].b like '%:' or (x.b rlike r'^\p{Ll}' and not _r[i - 1].b rlike r'[.?!…]$'))"
    df = computed(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"), *keep),
        _p=f"split({mark_boundaries('_t')}, '{CUT}')",
        _n="transform(_p, x -> char_length(x))",
        _s=running_starts("_n"),
        _r=f"filter(transform(_p, (x, i) -> named_struct('at', i, 'b', {body}, 's', _s[i] + {lead})), x -> x.b != '')",
        _k=f"filter(transform(_r, (x, i) -> case when {joins} then -1 else i end), i -> i >= 0)",
    )
    last = "case when j + 1 < size(_k) then _k[j + 1] - 1 else size(_r) - 1 end"
    text = r"regexp_replace(array_join(slice(_p, _r[i].at + 1, _r[z].at - _r[i].at + 1), ''), r'^\s+|\s+$', '')"
    text = text.replace("_r[z]", f"_r[{last}]")
    df = df.withColumn(
        "sentences",
        F.expr(
            f"transform(_k, (i, j) -> named_struct('text', {text}, 'char_start', _r[i].s, "
            f"'char_end', _r[{last}].s + char_length(_r[{last}].b)))"
        ),
    )
    return df.select("doc_id", *keep, "sentences")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sentence: doc_id, sentence_idx, anchor_id, text, char_start, char_end."""
    rows = sentence_arrays(docs, id_col, text_col).select("doc_id", F.posexplode("sentences").alias("sentence_idx", "s"))
    return rows.select("doc_id", "sentence_idx", anchor_id(F.col("sentence_idx")).alias("anchor_id"), "s.text", "s.char_start", "s.char_end")
