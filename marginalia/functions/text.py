"""Text extraction, normalisation and formatting as Column functions.

White space is ASCII white space plus the no-break space, which is mapped to a space first.  Offsets are code points,
zero-based and half-open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags whose subtree is dropped, tags that start a new line, named entities, quote and dash signs.
DROPPED_TAGS = ("script", "style", "noscript", "head", "meta", "link", "title", "table", "img", "svg", "figure", "form", "button", "input", "select")
BLOCK_TAGS = ("p", "div", "section", "article", "header", "footer", "main", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "br", "tr")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
            ("&reg;", "®"), ("&trade;", "™"), ("&ndash;", "–"), ("&mdash;", "—"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&rdquo;", "”"),
            ("&ldquo;", "“"), ("&bull;", "•"), ("&middot;", "·"), ("&amp;", "&"))
SIGNS = ("‘’“”–— ", "''\"\"-- ")
VOID_TAGS = ("meta", "link", "img", "input")


def strip_markup(html: Column) -> Column:
    """Drop comments, the subtrees of tags without text, and elements hidden by attribute or style.

    Regular expressions match an element up to its first end tag, which is exact on the pages that ``html.is_plain`` lets through.
    """
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    for tag in DROPPED_TAGS:
        if tag not in VOID_TAGS:
            out = F.regexp_replace(out, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>", "")
    out = F.regexp_replace(out, r"(?is)<ix:hidden[^>]*>.*?</ix:hidden\s*>", "")
    hidden = r"(style\s*=\s*[\"'][^\"']*(display\s*:\s*none|visibility\s*:\s*hidden)|aria-hidden\s*=\s*[\"']true[\"']|hidden(\s|>|=))"
    for tag in ("div", "span", "p"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\s+([^>]*\s)?{hidden}[^>]*>?.*?</{tag}\s*>", "")
    return out


def block_breaks(html: Column) -> Column:
    """A line break for each block tag's start and end, so two for a ``br``; other tags go."""
    html = F.regexp_replace(html, r"(?i)<br(\s[^>]*)?/?>", "\n\n")
    out = F.regexp_replace(html, rf"(?i)</?({'|'.join(BLOCK_TAGS)})(\s[^>]*)?/?>", "\n")
    return F.regexp_replace(out, r"(?s)<[^>]*>", "")


def decode_entities(text: Column) -> Column:
    """Named entities; the ampersand last, so that nothing is decoded twice."""
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def tidy(text: Column) -> Column:
    """The ordered clean-up of extracted text: URLs, odd spaces, page numbers, broken lines, blank lines."""
    # The clean-up patterns and their order.
    out = F.regexp_replace(text, "https?://[^\\s ]+", " ")
    out = F.replace(F.replace(out, F.lit(" "), F.lit(" ")), F.lit("​"), F.lit(""))
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    out = F.regexp_replace(out, r"(?m)^\s*\d+\s*$", "")
    out = F.regexp_replace(out, r"(?<=[A-Za-z,;:\-])\n(?=[a-z(])", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"[ \t]+\n", "\n")
    out = F.regexp_replace(out, r"\n[ \t]+", "\n")
    return strip(out)


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_text(text: Column) -> Column:
    """Straight quotes and dashes, marker words gone, single spaces, no space before ; - . , :"""
    out = F.translate(F.coalesce(text, F.lit("")), *SIGNS)  # fixed values: the signs and the patterns below
    out = F.regexp_replace(out, r"(?i)\s*AI_TERM\s*[×x*]\s*", " ")
    out = F.btrim(F.regexp_replace(out, r"\s+", " "))
    return F.regexp_replace(out, r"\s+([;\-.,:])", "$1")


def match_key(text: Column) -> Column:
    """What sentences are compared by."""
    return F.lower(normalize_text(text))


def clean_label(text: Column) -> Column:
    """A label without blanks or semicolons at its end; null is empty."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"[;\s]+$", ""))


def normalize_kind(kind: Column) -> Column:
    """The pipeline's kinds: any case of risk, mitigation, risk mitigation; others as they are."""
    bare = strip(F.coalesce(kind, F.lit("")))
    low = F.lower(bare)
    return F.when(low == "risk", "Risk").when(low.isin("mitigation", "risk mitigation"), "Risk Mitigation").otherwise(bare)


def to_strength(text: Column) -> Column:
    """A whole number, decimals cut off; anything else is null."""
    number = F.expr("try_cast(0 as double)") if text is None else strip(text.cast("string")).try_cast("double")
    return F.when(number.between(-2147483648, 2147483647), number).cast("int")


def split_label(raw: Column) -> tuple[Column, Column, Column]:
    """``head; tail`` or ``head: tail``: whether there is a separator, the head, the tail."""
    clean = clean_label(raw)
    pattern = r"(?s)^([^;:]*)[;:](.*)$"
    part = lambda i: clean_label(strip(F.regexp_extract(clean, pattern, i)))
    return clean.rlike("[;:]"), part(1), part(2)


def path_token(text: Column) -> Column:
    """A token that is safe in paths: unsafe runs to '-', blanks to '_', no ._- at the ends, never empty."""
    out = strip(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(F.regexp_replace(out, r'[\\/:*?"<>|]+', "-"), r"\s+", "_")
    out = F.regexp_replace(out, r"^[._-]+|[._-]+$", "")
    return F.when(out == "", "unknown").otherwise(out)


def doc_slug(name: Column, aliases: dict[str, str] | None = None) -> tuple[Column, Column]:
    """``company_2024`` -> company (through aliases) and year; nulls where it is none such."""
    company, year = F.regexp_extract(name, r"^(.+)_([0-9]+)$", 1), F.regexp_extract(name, r"^(.+)_([0-9]+)$", 2)
    known = company != ""
    for old, new in (aliases or {}).items():
        company = F.when(company == old, new).otherwise(company)
    return F.when(known, company), F.when(known, year).cast("int")


def excerpt(text: Column, n: int = 140) -> Column:
    return F.substring(text, 1, n)


def anchor_id(index: Column) -> Column:
    return F.format_string("s-%05d", index.cast("int"))


def anchor_place(anchor: Column) -> Column:
    """The place that an anchor names; null for what is no anchor."""
    return F.when(anchor.rlike("^s-([0-9]{5}|[1-9][0-9]{5,8})$"), F.substr(anchor, F.lit(3)).cast("int"))


def chunk_id(index: Column) -> Column:
    return F.format_string("chunk_%04d", index.cast("int"))


def params_text(params: Column) -> Column:
    """A map as ``k=v, k=v``."""
    return F.array_join(F.transform(F.map_entries(params), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")


def coder_name(coder: Column, name: Column) -> Column:
    """``A — Name``, ``A``, or ``Human``."""
    coder, name = F.coalesce(coder, F.lit("")), F.coalesce(name, F.lit(""))
    return F.when((coder != "") & (name != ""), F.concat(coder, F.lit(" — "), name)).when(coder != "", coder).otherwise("Human")


def strength_text(strength: Column) -> Column:
    return F.concat(strength.cast("string"), F.lit("/3"))


def table_row(*cells: Column) -> Column:
    """A markdown table row; line breaks within cells become spaces."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\n", " ") for c in cells)), F.lit(" |"))
