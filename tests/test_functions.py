import pytest
from pyspark.sql import functions as F

from pagewright.functions import dates as D, text as T


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "line, expected",
    [("Nov. 9", (11, 9, None)), ("Aug.30", (8, 30, None)), ("Feb 2nd", (2, 2, None)), ("Oct. 31, 1997", (10, 31, 1997)), ("March 8 –", (3, 8, None)), ("sept 12.", (9, 12, None)), ("  december 1st, ", (12, 1, None)),
     ("Juniper berries", None), ("Feb 2   Larkmoor", None), ("Oct 40", None), ("Jan 5, 2200", None), ("July", None), ("", None), (None, None)],
)
def test_date_lines(spark, line, expected):
    got = one(spark, line, D.parse_date_line)
    assert (tuple(got) if got else None) == expected


def test_inline_and_near(spark):
    got = one(spark, "Nov. 9 fog all morning", D.inline_date)
    assert (got.date.month, got.date.day, got.rest) == (11, 9, "fog all morning")
    assert one(spark, "Marching was hard", D.inline_date) is None and one(spark, "Feb 2   Larkmoor", D.is_near_date) and one(spark, "March on", D.is_month_word)


@pytest.mark.parametrize(
    "name, date",
    [("VID-20190630.mov", "2019-06-30"), ("fog 99999999 20110228.png", "2011-02-28"), ("1500000000000.png", "2017-07-14"), ("9999999999999.jpg", None), ("DSC_20191340.jpg", None), ("120110228.jpg", None), ("a.jpg", None)],
)
def test_file_dates(spark, name, date):
    assert one(spark, name, D.file_date) == date


def test_exif_is_last(spark):
    row = spark.createDataFrame([("a.jpg", "2011:02:03 10:00:00")], "n string, e string").select(D.file_date(F.col("n"), F.col("e")).alias("d")).first()
    assert row.d == "2011-02-03"


@pytest.mark.parametrize("q, year", [("in 2022?", 2022), ("1994 or 2001", 1994), ("2050", None), ("1899", None), ("x12022", None)])
def test_years(spark, q, year):
    assert one(spark, q, D.detect_year) == year


def test_dates_that_are_none(spark):
    assert one(spark, "2011-02-29", D.nearest_valid) == "2011-02-28" and one(spark, "2012-02-29", D.nearest_valid) is None and one(spark, "x", D.nearest_valid) is None


@pytest.mark.parametrize(
    "raw, path",
    [("file:///D:\\old\\1999\\fen\\two%20owls.png", "1999/fen/two owls.png"), ("..\\fen\\owl.png", "fen/owl.png"), ("a+b.jpg", "a+b.jpg"), ("x/y/1999/fen/owl.png", "1999/fen/owl.png"), ("100%/a.jpg", "100%/a.jpg")],
)
def test_paths(spark, raw, path):
    assert one(spark, raw, T.normalise_path) == path


def test_photo_references(spark):
    got = one(spark, "Fog (1999\\fen\\owl - one.jpg, 1999\\fen\\two.jpg) , and\nfen\\moss.png with d.mov too", T.strip_photo_refs)
    assert got.refs[0] == "(1999\\fen\\owl - one.jpg, 1999\\fen\\two.jpg)" and len(got.refs) == 3
    assert "(" not in got.text and ".jpg" not in got.text


def test_text(spark):
    assert one(spark, "a\n\n\nb  c\t", T.normalise) == "a\n\nb c"
    assert one(spark, "Étoile & Co - 2", T.slug) == "toile-co-2"
    assert [one(spark, n, T.caption) for n in ("moss garden7.jpg", "GOPR0042.jpg", "19991231_235900.jpg", ".jpg")] == ["moss garden", None, None, None]
    assert one(spark, "L'été à 3 ans", T.tokens) == ["l'été", "à", "3", "ans"]
    assert one(spark, "“A”  –\nb’s", T.folded) == "\"a\" - b's" and one(spark, "ﬁn", T.folded) == "fin"
    assert one(spark, "The cook met Anna. Then Bob and I met Carl on Monday.", T.names_in) == ["anna", "bob", "carl"]
    assert one(spark, "glass orangery", T.is_short_query) and not one(spark, "the of", T.is_short_query)
    assert one(spark, 'x, "y, z", “a, b”, c | d; e', T.quoted_list) == ["x", "y, z", "a, b", "c | d; e"]
    assert one(spark, "```\n{\"statement\": \"s\", \"evidence\": \"e\"},\nnoise\n{bad", T.reply_statements)[0].statement == "s"
    assert one(spark, "<bash-input> ls </bash-input>", T.shell_command) == "ls"
    assert [one(spark, b, T.image_fault, "binary") for b in (b"", b"\0\0\0\0", b"\xff\xd8x\xff\xd9", b"\xff\xd8xx", b"text")] == [
        "zero-length", "zero-filled", None, "valid JPEG header, truncated or damaged body", "not an image (wrong magic bytes)",
    ]


def test_snippet(spark):
    text = "2012-01-01, x — " + "filler words go on. " * 40 + "The glass orangery stood there. " + "more filler here. " * 40
    df = spark.createDataFrame([(text, 16, "where is the orangery"), (text, 16, "zzz"), (None, 0, "a")], "t string, h int, q string")
    got = [r.s for r in df.select(T.snippet(120)("t", "h", "q").alias("s")).collect()]
    assert "orangery" in got[0] and got[0].startswith("…") and len(got[0]) <= 121 and got[1].startswith("filler") and got[2] is None
