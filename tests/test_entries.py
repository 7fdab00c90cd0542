import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import entries as E
from pagewright.operators.ordered import with_neighbours, with_running

LINES = "file string, line_no int, line string, links array<string>, new_par boolean"


def test_neighbours_and_sums_across_blocks(spark):
    rng = random.Random(3)
    rows = [(g, k, str(rng.randint(0, 99))) for g in "ab" for k in sorted(rng.sample(range(200), 60))]
    df = spark.createDataFrame(rows, "g string, k int, v string")
    got = {(r.g, r.k): (r.before2, r.before1, r.after1) for r in with_neighbours(df, "g", "k", F.col("v"), block=7).collect()}
    sums = {(r.g, r.k): r.s for r in with_running(df, "g", "k", {"s": F.col("v").cast("int")}, block=7).collect()}
    for g in "ab":
        own = [r for r in rows if r[0] == g]
        for n, (_, k, _) in enumerate(own):
            at = lambda i: own[i][2] if 0 <= i < len(own) else None
            assert got[g, k] == (at(n - 2), at(n - 1), at(n + 1))
            assert sums[g, k] == sum(int(r[2]) for r in own[: n + 1])


def test_segmentation(spark):
    rows = [
        ("Klow - 2012.docx", 0, "before", [], True), ("Klow - 2012.docx", 1, "Dec. 30", [], True), ("Klow - 2012.docx", 2, "We  left", ["2012/a/b.jpg"], True), ("Klow - 2012.docx", 3, "late.", [], False),
        ("Klow - 2012.docx", 4, "", [], True), ("Klow - 2012.docx", 5, "Second (x\\y.jpg) .", [], True), ("Klow - 2012.docx", 6, "Jan 2nd. we rested", [], True), ("Klow - 2012.docx", 7, "Feb 29, 2013", [], True), ("Klow - 2012.docx", 8, "x", None, True),
        ("notes.docx", 0, "no date here", [], True),
    ]
    df = spark.createDataFrame(rows, LINES)
    got = E.segment(df).orderBy("id").collect()
    assert [(r.id, r.entry_date, r.month_day) for r in got] == [
        ("klow-2012#0000", None, ""), ("klow-2012#0001", "2012-12-30", "12-30"), ("klow-2012#0002", "2013-01-02", "01-02"), ("klow-2012#0003", "2013-02-29", "02-29"),
    ]
    assert got[0].warnings == ["preamble"] and got[0].text == "before"
    assert got[1].text == "We left\nlate.\n\nSecond." and got[1].links == ["2012/a/b.jpg"] and "y.jpg" in got[1].inline_refs[0]
    assert got[2].warnings == ["year_rollover", "date_on_same_line"] and got[2].text == "we rested"
    assert got[3].warnings == ["year_from_entry", "invalid_date:suggest=2013-02-28"]
    assert {(r.file, r.warning) for r in E.file_warnings(df).collect()} == {("notes.docx", "no_year_in_filename"), ("notes.docx", "no_date_lines")}
    assert E.segment(df.limit(0)).count() == 0


def sequential(months, inline, base):
    """The rule told month by month."""
    year, before, out = base, None, []
    for m, given in zip(months, inline):
        flag = None
        if given:
            year, flag = given, "year_from_entry"
        elif year is not None and before is not None and m < before:
            if before >= 11 and m <= 2 and (base is None or year < base + 1):
                year, flag = year + 1, "year_rollover"
            else:
                flag = "out_of_order"
        before = m
        out.append((year, flag))
    return out


def test_rollover_equals_the_sequential_rule(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for f in range(150):
        n, base = rng.randint(1, 14), rng.choice([None, 2010, 2011])
        months = [rng.choice([1, 2, 6, 11, 12]) for _ in range(n)]
        inline = [rng.choice([None] * 6 + [2009, 2010, 2012]) for _ in range(n)]
        rows += [(f"f{f}", k, months[k], inline[k], base) for k in range(n)]
        expected |= {(f"f{f}", k): v for k, v in enumerate(sequential(months, inline, base))}
    df = spark.createDataFrame(rows, "file string, k int, month int, inline int, base int")
    got = E.rollover(df, "file", "k", "month", "inline", "base").collect()
    for r in got:
        assert (r.year, r.year_warnings[0] if r.year_warnings else None) == expected[r.file, r.k], (r, expected[r.file, r.k])
    assert len(got) == len(rows)


def test_chronology(spark):
    dates = {"a": ["2012-07-02", "2012-06-03", "2012-07-04"], "b": ["2012-01-01", "2012-01-01", "2012-01-05", "2012-01-03", "2012-01-04"], "c": ["2012-02-30", "2012-03-01", None, "2012-02-01"], "d": ["2012-05-09", "2012-04-02", "2012-04-03"]}
    df = spark.createDataFrame([(f, k, d) for f, ds in dates.items() for k, d in enumerate(ds)], "f string, k int, d string")
    got = {(r.f, r.k): r.chronology for r in E.chronology(df, "f", "k", "d").collect()}
    assert got == {
        ("a", 1): ["date_out_of_sequence", "suspect_month_typo:2012-07-03"],
        ("b", 1): ["duplicate_date"],
        ("b", 2): ["date_out_of_sequence"],
        ("c", 3): ["date_out_of_sequence"],
        ("d", 0): ["date_out_of_sequence"],
    }


def test_corrections_manifest_and_sizes(spark):
    df = spark.createDataFrame([("e1", "2012-01-01", ["no_photos", "date_out_of_sequence", "suspect_month_typo:x"], "f"), ("e2", None, [], "f"), ("e3", "2012-01-02", None, "g")], "id string, entry_date string, warnings array<string>, source_file string")
    fix = spark.createDataFrame([("e1", "2012-02-01"), ("e2", "2012-02-02"), ("zz", "2012-01-01")], "entry_id string, entry_date string")
    fixed, unknown = E.apply_corrections(df, fix)
    got = {r.id: r for r in fixed.collect()}
    assert got["e1"].entry_date == "2012-02-01" and got["e1"].warnings == ["no_photos", "date_corrected:from=2012-01-01"]
    assert got["e2"].warnings == ["date_corrected:from=none"] and got["e3"].warnings is None and [r.entry_id for r in unknown.collect()] == ["zz"]
    assert {r.warning: r.entries for r in E.warning_counts(fixed).collect()} == {"no_photos": 1, "date_corrected": 2}
    sized = E.sizes(spark.createDataFrame([(k,) for k in [5, 1, 9, 9, 3, None]], "s int"), F.col("s"), 4).first()
    assert (sized.n, sized.least, sized.middle, sized.ninety, sized.greatest, sized.over) == (5, 1, 5, 9, 9, 3)
    photo = "array<struct<path:string,source:string,resolved:string>>"
    rows = spark.createDataFrame([("f", [("p", "link", "exact")])], f"source_file string, photos {photo}")
    said = spark.createDataFrame([("g", "no_date_lines")], "file string, warning string")
    assert sorted(map(tuple, E.manifest(rows, said).collect())) == [("f", 1, 1, ""), ("g", 0, 0, "no_date_lines")]


def test_probe(spark):
    df = spark.createDataFrame([("f", k, line, ["a"], True) for k, line in enumerate(["Apr. 3", "Apr 4 we left", "May be", "Jun 15   Zenda"])], LINES)
    r = E.format_probe(df).first()
    assert (r.date_lines, r.inline_dates, r.month_words, r.links) == (1, 2, 1, 4)


def test_conversion_end_to_end(spark):
    lines = [
        ("Fen - 2001.docx", 1, "before it all", [], True), ("Fen - 2001.docx", 2, "June 3", [], True), ("Fen - 2001.docx", 3, "Owls (moss.jpg, fen/far.png) and moss", ["../fen/moss.jpg", "fen/moss.jpg"], True),
        ("Fen - 2001.docx", 4, "June 9", [], True), ("Fen - 2001.docx", 5, "Fog.", [], True), ("Fen - 2001.docx", 6, "June 5", [], True), ("Fen - 2001.docx", 7, "Rain.", [], True), ("Fen - 2001.docx", 8, "June 12", [], True), ("Bare.docx", 1, "no dates here", [], True),
    ]
    df = spark.createDataFrame(lines, "file string, line_no int, line string, links array<string>, new_par boolean")
    media = spark.createDataFrame([("2001/fen/moss.jpg", None), ("x/walk.jpg", "2001-06-09"), ("2001/fen/moss.jpg", "2001-06-03")], "path string, date string")
    made = {r.id: r for r in E.convert(df, media).collect()}
    assert sorted(made) == ["fen-2001#0000", "fen-2001#0001", "fen-2001#0002", "fen-2001#0003", "fen-2001#0004"]
    photos = lambda r: [tuple(p) for p in r.photos]
    # links stay as often as they stand, references already linked do not come again, nor do files of the day that are linked
    assert photos(made["fen-2001#0001"]) == [("2001/fen/moss.jpg", "link", "year_prefix")] * 2 + [("fen/far.png", "inline", "missing")]
    assert made["fen-2001#0001"].text == "Owls and moss" and made["fen-2001#0001"].chars == 13
    assert photos(made["fen-2001#0002"]) == [("x/walk.jpg", "date", "exact")] and "photos_by_date" in made["fen-2001#0002"].warnings and "no_photos" not in made["fen-2001#0002"].warnings
    assert "no_photos" in made["fen-2001#0003"].warnings and "preamble" in made["fen-2001#0000"].warnings
    assert [k for k, r in made.items() if "date_out_of_sequence" in r.warnings] == ["fen-2001#0003"]
    # a correction resolves the warning, also of its neighbours
    fixed = {r.id: r for r in E.convert(df, media, spark.createDataFrame([("fen-2001#0003", "2001-06-10")], "entry_id string, entry_date string")).collect()}
    assert not [k for k, r in fixed.items() if any(w.startswith("date_out") for w in r.warnings)] and "date_corrected:from=2001-06-05" in fixed["fen-2001#0003"].warnings
    said = {(r.what, r.kind): r.n for r in E.conversion_report(E.convert(df, media)).collect()}
    assert said["total", "entries"] == 5 and said["total", "undated"] == 1 and said["photos", "year_prefix"] == 2 and said["warnings", "no_photos"] >= 1
    assert E.convert(df).where("exists(photos, p -> p.resolved <> 'unchecked')").count() == 0 and E.convert(df.limit(0), media).count() == 0
