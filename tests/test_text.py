import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.arrays import computed, running_starts
from marginalia.functions.html import decode_entities, extract_html, visible
from marginalia.operators.sentences import build_index

from pages import visible_text


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first().y


def index(spark, *texts):
    rows = build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "sentence_idx").collect()
    return [[r for r in rows if r.doc_id == i] for i in range(len(texts))]


def test_splitter_cases(spark):
    prose = (
        "In fiscal year 2024, we invested about $7.4 billion, a 12.3% increase. Bodies in the U.S. and the E.U. have new frameworks "
        "(e.g., the EU act) that cost. Section 7.4.4 of our manual shows it. Failure to attract Ph.D. researchers could harm us."
    )
    texts = ["This could:\n• Cost time.", "governance strategies\nsupport decisions", prose, "Note: this is inside. The next one is separate.",
             "", None, "One.", "a:\nB:\nC", "End.\n2 starts with a digit", "Wait… Élan vital", "open end\nélan", "Mr. Smith met J. K. Doe. Fine."]
    assert [len(x) for x in index(spark, *texts)] == [1, 1, 4, 2, 0, 0, 1, 1, 2, 2, 1, 2]


def test_offsets_are_slices_of_the_text(spark):
    rng = random.Random(1)
    bits = ["Word", "more", ". ", "! ", "\n", "\n\n", ": ", "… ", "é", "Ünd", " ", "😀", "No. ", "7.5", "•"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    for text, rows in zip(texts, index(spark, *texts)):
        assert all(r.text == text[r.char_start : r.char_end] and r.text == r.text.strip() for r in rows)
        assert all(a.char_end <= b.char_start for a, b in zip(rows, rows[1:]))
        assert "".join(text.split()) == "".join("".join(r.text for r in rows).split())
        assert [r.anchor_id for r in rows] == [f"s-{i:05d}" for i in range(len(rows))]


def test_merges_equal_a_left_fold(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["low end", "Up.", "Up:", "low.", "7 x", "Nö…", "ö"]) for _ in range(rng.randrange(1, 15))) for _ in range(200)]
    for text, rows in zip(texts, index(spark, *texts)):
        merged = []
        for piece in text.split("\n"):
            joins = merged and (merged[-1].endswith(":") or (piece[0].islower() and not merged[-1].endswith((".", "?", "!", "…"))))
            merged[-1:] = [merged[-1] + "\n" + piece] if joins else [*merged[-1:], piece]
        assert [r.text for r in rows] == merged


def test_running_starts(spark):
    for n in (0, 1, 63, 64, 65, 500):
        df = computed(spark.createDataFrame([([i % 7 for i in range(n)],)], "l array<int>"), s=running_starts("l"))
        got, acc = df.first().s, 0
        assert len(got) == n
        for i in range(n):
            assert got[i] == acc
            acc += i % 7


@pytest.mark.parametrize(("raw", "want"), [
    ("“AI” — it’s AI_TERM× -related  text ;", "\"AI\"- it's-related text;"), (None, ""), ("  a  b ", "a b"), ("x AI_TERM × ; y", "x; y"),
])
def test_normalize(spark, raw, want):
    assert one(spark, T.normalize_text, raw) == want
    assert one(spark, T.match_key, raw) == want.lower()


def test_tidy(spark):
    text = "See https://a.b/c d\n\n\n 12 \nword,\nlower\u00a0x\u200by\nUpper  end \n tail "
    assert one(spark, T.tidy, text) == "See d\n\nword, lower xy\nUpper end\ntail"


def test_html(spark):
    page = ('<html><head><title>t</title></head><body><!-- c --><script>var a="</p>";</script><p>One &amp; two</p><div>Three<br>four<span style="display: none">x</span></div>'
            "<table><tr><td>no</td></tr></table><p aria-hidden=\"true\">gone</p><li>five &copy;</body>")
    assert one(spark, extract_html, page) == "One & two\n\nThree\n\nfour\n\nfive ©"  # two line breaks for a br, as for any block tag
    nested = "<div hidden><div>in</div>still in</div><p>out <b>bold</b></p><table><table></table>x</table>"
    assert visible_text(nested).strip() == "out bold"
    assert visible_text(None) == ""


PIECES = (
    "<p> </p> <div> </div> <b> </b> <table> </table> <tr> <td> </td> <li> </li> <ul> </ul> <br> <br/> <hr> <option> <select> </select> <dl> <dt> <dd> </dl> <section hidden> </section> <h2> </h2>"
    " <span_style='x:y;_display_:_none'> </span> <i_aria-hidden=true> </i> <p_HIDDEN> <div_title='a>b'> <ix:hidden> </ix:hidden> <svg/> <div/> <!--_<p>_--> <script>var_a='<p>';</script> <button> </button>"
    " word two_words 12 &amp; &#8217; &#x41; &ampx &nosuch; &eacute; &notit; &#150; &#0; a_<_b \n _ <a_href=x> </a> </nothing> é😀 <td_hidden> <FORM> </form>"
).split()


def test_pages_as_a_parser_reads_them(spark, sf):
    """Random and broken pages, the given ones, and those as the query rewrites them, against the standard library's parser."""
    rng = random.Random(11)
    soup = ["".join(rng.choice(PIECES).replace("_", " ") for _ in range(rng.randrange(1, 200))) for _ in range(250)]
    given = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    odd = [None, "", "<", "<p", "a<p>b</p", "<p>" * 300 + "x", "<b>" * 200 + "y" + "</b>" * 100 + "z", "<div hidden>" * 50 + "in" + "</div>" * 50 + "out", "x" * 5000 + "<p>" + "y" * 5000]
    pages = soup + given + odd
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string").repartition(4)
    got = {r.i: r.t for r in df.select("i", decode_entities(visible(F.col("html"))).alias("t")).collect()}
    for i, page in enumerate(pages):
        assert got[i].rstrip("\n") == visible_text(page).rstrip("\n"), page


def test_pages_that_break_off_in_an_entity_equal_their_sql(spark, tmp_path):
    """A title is cut after some number of characters, in the midst of an entity too."""
    import duckdb

    from marginalia import catalog, oracles

    whole = "token = &quot;ab&quot; &amp; &lt;x&gt; &nbsp;y&copy;&middot; &amp;quot; z"
    pages = [(i, f"<head><title>{whole[:i]}</title></head><h1>{whole[:i]}</h1><p>{whole[:i]} and {whole[:i]}x</p>") for i in range(len(whole) + 1)]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("html_extract", "html_nested"):
        got = {r.page_id: r.text for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == dict(con.sql(oracles.ORACLES[name]).fetchall())


def test_no_page_leaves_the_jvm(spark):
    df = spark.createDataFrame([("<p>a",)], "html string").select(extract_html(F.col("html")).alias("t"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_small_functions(spark):
    assert one(spark, T.clean_label, " a ;; ") == "a"
    assert [one(spark, T.normalize_kind, k) for k in ("Mitigation", "RISK", "risk mitigation", "x ")] == ["Risk Mitigation", "Risk", "Risk Mitigation", "x"]
    assert [one(spark, T.to_strength, k) for k in ("2.0", "n/a", None, " 3 ", "")] == [2, None, None, 3, None]
    assert [one(spark, T.path_token, k) for k in ("A/B: C?", None, "..", " x  y ")] == ["A-B-_C-".rstrip("-"), "unknown", "unknown", "x_y"]
    company, year = T.doc_slug(F.lit("face_book_2024"), {"face_book": "meta"})
    assert tuple(spark.range(1).select(company, year).first()) == ("meta", 2024)
    assert spark.range(1).select(T.params_text(F.create_map(F.lit("n"), F.lit("2")))).first()[0] == "n=2"
    assert spark.range(1).select(T.table_row(F.lit("a\nb"), F.lit(None))).first()[0] == "| a b |  |"
    names = spark.createDataFrame([("A", "x"), ("A", None), (None, None)], "c string, n string").select(T.coder_name(F.col("c"), F.col("n")))
    assert [r[0] for r in names.collect()] == ["A — x", "A", "Human"]


def test_marks_take_two_passes_over_a_text(spark):
    """What five replacements in a row said: a sign after a mark's white space, gone before small letters, gone after abbreviations and initials; one after line breaks."""
    from pyspark.sql import functions as F

    from marginalia.operators.sentences import ABBREVIATIONS, CUT, mark_boundaries

    short = rf"(^|[^\p{{L}}\p{{N}}])({'|'.join(ABBREVIATIONS)}|\p{{Lu}})\.(\s+){CUT}"
    five = [(r"([.!?…][\"”’)\]]*)(\s+)", rf"$1$2{CUT}"), (rf"{CUT}(\p{{Ll}})", "$1"), (short, "$1$2.$3"), (short, "$1$2.$3"), (r"(\n\s*)", rf"$1{CUT}")]
    want = F.replace("t", F.lit(CUT), F.lit(" "))
    for pattern, to in five:
        want = F.regexp_replace(want, pattern, to)
    bits = ["Mr", "Dr", "A", "B", "É", "x", "\U0001d400", "\U0001f600", "1", "_", ".", ". ", ".  ", "? ", '." ', ".) ", "\n", " \n ", " ", CUT, "\u00a0", "(", "é", "St. "]
    rng = random.Random(4)
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(20_000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", want.alias("want"), F.expr(mark_boundaries("t")).alias("got"))
    assert rows.where("want != got").take(3) == []
    assert mark_boundaries("t").count("regexp_replace") == 2
