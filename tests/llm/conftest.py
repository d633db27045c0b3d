import pytest

#: id, text, lang, source and columns whose names clash with what operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _digest string, size int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing columns."""
    long = " ".join(f"wort{i % 977} lang{i}" for i in range(30_000))
    base = "the quick brown fox jumps over the lazy dog and then it sleeps under the old oak tree until dawn breaks"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, base + " again", None, "a"), (4, "", "en", None), (5, None, None, None),
        (6, "One", "de", "b"), (7, "ONE", "de", "b"), (8, long, "en", "a"), (9, long, "fr", "c"), (9, long, "fr", "c"),
        (None, base, "en", "a"), (10, "täst \U0001f600 ﬁ \u00a0x\u2028y", "de", "é"), (11, " \t\n", "en", "b"), (12, "a b", "es", ""),
        (13, "worthless idiot " * 40, "en", "a"), (14, "x" * 50_000, "en", "a"), (15, "nul\x00byte", "en", "a"),
    ]
    full = [(i, t, lang, s, len(t or ""), "clash", None, -1) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i != 13), int(i == 13)) for i in range(1, 16)], "doc_id long, quality int, toxic int")


@pytest.fixture
def apart(spark):
    """Small partitions stay apart, so that it shows what a range or hash deals out."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)
