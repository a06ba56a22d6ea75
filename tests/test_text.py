import pytest
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import chunking, sections


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make("x")).first()[0]


def test_block(spark):
    assert one(spark, "a\r\nb\tc\n\n\n\nd ", tx.normalized_block) == "a\nb c\n\nd"


def test_inline_takes_unicode_space(spark):
    assert one(spark, "　a \x1cb\n c ", tx.normalized_inline) == "a b c"


def test_tokens(spark):
    text = "环路增益 loop_gain X1 a é ab2cd"
    assert one(spark, text, tx.token_list) == ["环路增益", "loop_gain", "ab", "cd"]


def test_decoded_drops_bad_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb\r\nc"),)], "b binary")
    assert df.select(tx.decoded("b")).first()[0] == "ab\nc"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("# A\n\nx\n### C\ny\n## B\nz", [("A", "x"), ("A > C", "y"), ("A > B", "z")]),
        ("intro\n# A\n# B", [("", "intro")]),
        ("# A\n# B", [("", "# A\n# B")]),
        ("x\n # A\ny", [("", "x\n # A\ny")]),
        ("####### x\n#x", [("", "####### x\n#x")]),
        ("# A ##\nb", [("A ##", "b")]),
        ("", []),
    ],
)
def test_sections(spark, text, expected):
    rows = sections.text_sections(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("sec_ord").collect()
    assert [(r.title, r.body) for r in rows] == expected


@pytest.mark.parametrize("n, sizes", [(2500, [1200, 1200, 500]), (1200, [1200]), (1201, [1200, 201]), (0, [0])])
def test_windows(spark, n, sizes):
    rows = spark.createDataFrame([("x" * n,)], "t string").select(F.transform(chunking.windows("t"), F.length)).first()[0]
    assert rows == sizes


def test_long_titles_end(spark):
    secs = spark.createDataFrame([(1, 0, "T" * 1000, "b" * 3000)], "doc_id int, sec_ord int, title string, body string")
    rows = chunking.chunk_sections(secs).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(len(rows))) and len(rows) < 20


def test_gaps_stay(spark):
    secs = spark.createDataFrame([(1, i, "", "b" * n) for i, n in enumerate((60, 10, 60))], "doc_id int, sec_ord int, title string, body string")
    assert sorted(r.idx for r in chunking.chunk_sections(secs).collect()) == [0, 2]
