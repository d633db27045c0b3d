"""Secrets by patterns and by a battery of randomness tests, with SQL functions only.

Base spans come from three fixed patterns.  The battery looks at every run of 20 or more characters of
the base64 alphabets that has a digit or changes case, and at runs of letters alone from ``LETTERS`` characters on (no test of this
kind tells a shorter one from a long word): the encoding (decimal, hex, base32, letters or letters with digits of one case, base62,
base64) is inferred from its characters, and three tests of the null hypothesis "uniform and
independent over that alphabet" are made -- chi-squared uniformity, runs about the middle of the
alphabet, lag-1 serial correlation -- and joined by Fisher's method into one p-value.

A short run of prose or of an identifier can pass such tests by lack of power, so false discoveries
are controlled by length: for each encoding and length class the p-values above 1/2 estimate how many
runs are truly random (those are uniform on 0..1), and the class reports from the smallest cut at
which the estimated share of others above the cut is at most ``FDR``.  The histogram behind it covers
all rows and has at most 9 x 8 x 20 cells, which bounds what reaches the driver.

Defined results: null text counts as empty; an empty text has no spans and the digest of the empty
string; every row comes back, repeated rows too; an empty table gives an empty result; other columns of any name are ignored.  Offsets are code points,
half-open; positions are prefix sums in blocks, so that a text with very many matches stays linear.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import computed
from .shared import pruned, stored

# Fixed values of the contract: patterns of the three base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")

FDR = 0.1
LETTERS = 40
LEAST_P = 1e-4  # no run below it is reported, whatever its class's cut
BINS = 20
BLOCK = 64
# The alphabets in the order of their digits.
DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Characters of a run and the alphabet they mean, the narrowest first.
ENCODINGS = (
    ("[0-9]+", DIGITS), ("[0-9a-f]+|[0-9A-F]+", DIGITS + "abcdef"), ("[A-Z]+", UPPER), ("[a-z]+", LOWER), ("[A-Z2-7]+", UPPER + "234567"),
    ("[A-Z0-9]+", DIGITS + UPPER), ("[a-z0-9]+", DIGITS + LOWER), ("[A-Za-z0-9]+", DIGITS + UPPER + LOWER), ("[A-Za-z0-9+/_-]+", UPPER + LOWER + DIGITS + "+/"),
)


def _q(pattern: str) -> str:
    """A Spark SQL raw string literal; patterns here hold both quote signs, so they are escaped."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _find(df: DataFrame, kind: str, pattern: str) -> DataFrame:
    """Add ``_f_<kind>``: array of (s, e, v), the leftmost non-overlapping matches in code points."""
    rx = _q(pattern)
    m, g, step, base = f"_m_{kind}", f"_g_{kind}", f"_l_{kind}", f"_b_{kind}"
    df = df.withColumn(m, F.expr(f"regexp_extract_all(_text, {rx}, 0)"))
    # step[i]: the gap before match i with match i - 1, so that its running sum is where i starts
    steps = f"transform({m}, (x, i) -> char_length({g}[i]) + case when i > 0 then char_length({m}[i - 1]) else 0 end)"
    df = computed(
        df,
        **{
            g: f"case when size({m}) > 0 then split(_text, {rx}) end",
            step: f"case when size({m}) > 0 then {steps} end",
        },
    )
    blocks = f"sequence(0, cast((size({m}) - 1) div {BLOCK} as int))"
    df = df.withColumn(
        base,
        F.expr(
            f"case when size({m}) > 0 then aggregate({blocks}, array(0), (a, b) -> array_append(a, "
            f"element_at(a, -1) + aggregate(slice({step}, b * {BLOCK} + 1, {BLOCK}), 0, (t, x) -> t + x))) end"
        ),
    )
    start = f"{base}[cast(i div {BLOCK} as int)] + aggregate(slice({step}, cast(i div {BLOCK} as int) * {BLOCK} + 1, i % {BLOCK} + 1), 0, (t, y) -> t + y)"
    df = df.withColumn(
        f"_f_{kind}",
        F.expr(
            f"case when size({m}) > 0 then transform({m}, (x, i) -> named_struct('s', {start}, "
            f"'e', {start} + char_length(x), 'v', x)) else array() end"
        ).cast("array<struct<s:int,e:int,v:string>>"),
    )
    return df.drop(m, g, step, base)


def _upper_tail(z: str) -> str:
    """P(Z >= z) of a standard normal, by a logistic form good to 2e-4."""
    return f"(1 / (1 + exp(least(greatest(1.5976 * ({z}) + 0.070566 * ({z}) * ({z}) * ({z}), -700), 700))))"


def _battery(df: DataFrame, runs: str) -> DataFrame:
    """Replace the array of (s, e, v) in ``runs`` by (s, e, cell, p): the length class and p-value."""
    kept = f"filter({runs}, x -> x.v rlike '[0-9]' or x.v rlike '[a-z][A-Z]' or char_length(x.v) >= {LETTERS})"
    enc = "case " + " ".join(f"when x.v rlike '^({chars})$' then {i}" for i, (chars, _) in enumerate(ENCODINGS)) + " end"
    alphabet = "case x.enc " + " ".join(f"when {i} then '{digits}'" for i, (_, digits) in enumerate(ENCODINGS)) + " end"
    text = "case x.enc when 1 then lower(x.v) when 8 then translate(x.v, '-_', '+/') else x.v end"
    n = "cast(size(x.d) as double)"
    df = df.withColumn("_c", F.expr(f"transform({kept}, x -> named_struct('s', x.s, 'e', x.e, 'v', x.v, 'enc', {enc}))"))
    df = df.withColumn(
        "_c",
        F.expr(
            f"transform(_c, x -> named_struct('s', x.s, 'e', x.e, 'enc', x.enc, 'k', cast(char_length({alphabet}) as double), "
            f"'d', transform(split({text}, ''), c -> cast(instr({alphabet}, c) - 1 as double))))"
        ),
    )
    # sum of squared counts: each distinct digit's count is the length of the array less what is left without it
    squares = "aggregate(array_distinct(x.d), cast(0 as double), (a, u) -> a + pow(size(x.d) - size(array_remove(x.d, u)), 2))"
    mean = "aggregate(x.d, cast(0 as double), (a, u) -> a + u) / size(x.d)"
    df = df.withColumn(
        "_c",
        F.expr(
            f"transform(_c, x -> named_struct('s', x.s, 'e', x.e, 'enc', x.enc, 'k', x.k, 'd', x.d, 'n', {n}, "
            f"'chi', x.k / {n} * {squares} - {n}, 'mean', {mean}, "
            f"'hi', cast(size(filter(x.d, u -> u >= x.k / 2)) as double), "
            f"'runs', 1 + cast(size(filter(zip_with(slice(x.d, 2, size(x.d)), slice(x.d, 1, size(x.d) - 1), "
            f"(a, b) -> (a >= x.k / 2) != (b >= x.k / 2)), u -> u)) as double)))"
        ),
    )
    df = df.withColumn(
        "_c",
        F.expr(
            "transform(_c, x -> named_struct('s', x.s, 'e', x.e, 'enc', x.enc, 'k', x.k, 'n', x.n, 'chi', x.chi, 'runs', x.runs, "
            "'mu', 2 * x.hi * (x.n - x.hi) / x.n + 1, "
            "'ss', aggregate(x.d, cast(0 as double), (a, u) -> a + (u - x.mean) * (u - x.mean)), "
            "'sc', aggregate(zip_with(slice(x.d, 2, size(x.d)), slice(x.d, 1, size(x.d) - 1), "
            "(a, b) -> (a - x.mean) * (b - x.mean)), cast(0 as double), (a, u) -> a + u)))"
        ),
    )
    # Wilson and Hilferty's cube root makes the chi-squared statistic normal
    z_chi = "(cbrt(greatest(x.chi, 0) / (x.k - 1)) - (1 - 2 / (9 * (x.k - 1)))) / sqrt(2 / (9 * (x.k - 1)))"
    var_runs = "(x.mu - 1) * (x.mu - 2) / (x.n - 1)"
    z_runs = f"case when {var_runs} > 0 then abs(x.runs - x.mu) / sqrt({var_runs}) else 8 end"
    z_ser = "case when x.ss > 0 then abs(x.sc / x.ss + 1 / x.n) * sqrt(x.n) else 8 end"
    logs = f"ln(greatest({_upper_tail(z_chi)}, 1e-300)) + ln(least(1, 2 * {_upper_tail(z_runs)})) + ln(least(1, 2 * {_upper_tail(z_ser)}))"
    df = df.withColumn(
        "_c",
        F.expr(
            f"transform(_c, x -> named_struct('s', x.s, 'e', x.e, 'cell', cast(x.enc * 8 + least(7, floor(log2(x.n / 20) * 2)) as int), 'h', -({logs})))"
        ),
    )
    return df.withColumn(
        "_c", F.expr("transform(_c, x -> named_struct('s', x.s, 'e', x.e, 'cell', x.cell, 'p', exp(-x.h) * (1 + x.h + x.h * x.h / 2)))")
    )


def length_cuts(found: DataFrame, fdr: float = FDR) -> dict[int, float]:
    """Cell (encoding and length class) -> least p-value reported; cells without one report nothing."""
    bins = (
        found.select(F.explode("_c").alias("c"))
        .groupBy(F.col("c.cell").alias("cell"), F.least(F.lit(BINS - 1), F.floor(F.col("c.p") * BINS)).cast("int").alias("bin"))
        .count()
        .collect()  # at most 72 cells x BINS rows
    )
    cuts: dict[int, float] = {}
    for cell in {r.cell for r in bins}:
        counts = {r.bin: r["count"] for r in bins if r.cell == cell}
        random = 2 * sum(n for b, n in counts.items() if b >= BINS // 2)
        for b in range(BINS // 2 + 1):
            above = sum(n for k, n in counts.items() if k >= b)
            if above and 1 - random * (1 - b / BINS) / above <= fdr:
                cuts[cell] = b / BINS
                break
    return cuts


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per input row: id, ``base`` and ``spans`` as arrays of (s, e, kind number)."""
    df = pruned(docs, _id=id_col, _text=text_col).withColumn("_text", F.coalesce("_text", F.lit("")))
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("run", RUN)):
        df = _find(df, kind, pattern)
    df = _battery(df, "_f_run")
    value = f"regexp_extract(x.v, {_q(ASSIGN_VALUE)}, 1)"
    df = df.withColumn("_f_assign", F.expr(f"filter(_f_assign, x -> char_length({value}) >= 12)"))
    base = ", ".join(
        f"transform(_f_{kind}, x -> named_struct('s', x.s, 'kind', {i}, 'e', x.e))" for i, kind in enumerate(KINDS[:3])
    )
    found = stored(df.select("_id", F.expr(f"array_sort(concat({base}))").alias("_base"), "_c"), "spans")
    cuts = length_cuts(found, fdr)
    keep = " or ".join(f"(x.cell = {cell} and x.p >= {max(cut, LEAST_P)!r})" for cell, cut in sorted(cuts.items())) or "false"
    extra = f"transform(filter(_c, x -> {keep}), x -> named_struct('s', x.s, 'kind', 3, 'e', x.e))"
    return found.select(
        F.col("_id").alias(id_col),
        F.col("_base").alias("base"),
        F.expr(f"array_sort(concat(_base, {extra}))").alias("spans"),
    )


def joined(spans: str) -> F.Column:
    """``kind:start:end`` by start and kind, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.s, ':', x.e)), ',')")
