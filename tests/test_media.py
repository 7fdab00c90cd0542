from pagewright.operators import media as M

FILES = ["2012/klow/a.jpg", "2012/klow/b - c.jpg", "2013/zenda/a.jpg", "2013/zenda/Only.JPG", "2014/x/two.jpg", "2015/y/two.jpg", "2016/klow/q.jpg"]


def test_resolution_in_turn(spark):
    cases = {
        ("2012/klow/a.jpg", 2012): ("2012/klow/a.jpg", "exact"), ("klow/a.jpg", 2012): ("2012/klow/a.jpg", "year_prefix"), ("old/klow/q.jpg", None): ("2016/klow/q.jpg", "place_tail"),
        ("pics/only.jpg", 2000): ("2013/zenda/Only.JPG", "basename"), ("2012/klow/b – c.jpg", 2012): ("2012/klow/b - c.jpg", "dash_fix"), ("z/two.jpg", 2012): ("z/two.jpg", "ambiguous"),
        ("z/none.jpg", 2012): ("z/none.jpg", "missing"), ("no–ne.jpg", None): ("no–ne.jpg", "missing"),
    }
    links = spark.createDataFrame([(p, y) for p, y in cases] * 2, "path string, year int")
    media = spark.createDataFrame([(f,) for f in FILES * 2], "path string")
    rows = M.resolve(links, media).collect()
    assert len(rows) == 2 * len(cases) and {(r.path, r.year): (r.resolved, r.how) for r in rows} == cases
    assert M.resolve(links.limit(0), media).count() == 0 and {r.how for r in M.resolve(links, media.limit(0)).collect()} == {"missing"}


SCHEMA = "id string, source_file string, entry_date string, photos array<struct<path:string,source:string,resolved:string>>, warnings array<string>"


def test_files_of_the_day(spark):
    entries = spark.createDataFrame([("e1", "f", "2012-01-01", [], ["no_photos"]), ("e2", "f", "2012-01-01", [("a.jpg", "link", "exact")], []), ("e3", "g", "2012-01-01", [], []), ("e4", "g", None, [], [])], SCHEMA)
    media = spark.createDataFrame([("a.jpg", "2012-01-01"), ("b.jpg", "2012-01-01"), ("b.jpg", "2012-01-01"), ("c.jpg", "2013-01-01"), ("d.jpg", None)], "path string, date string")
    found = M.attach_by_day(entries, media)
    assert sorted((r.id, r.path) for r in found.collect()) == [("e1", "b.jpg"), ("e2", "b.jpg"), ("e3", "a.jpg"), ("e3", "b.jpg")]
    got = {r.id: r for r in M.with_attached(entries, found).collect()}
    assert got["e1"].warnings == ["photos_by_date"] and [p.path for p in got["e2"].photos] == ["a.jpg", "b.jpg"] and got["e4"].photos == []


def test_orphans_and_reconstruction(spark):
    media = spark.createDataFrame([("2012/a/old mill2.jpg", "2012-05-01"), ("2012/a/old mill3.jpg", "2012-05-01"), ("2012/a/IMG_1.jpg", "2012-05-02"), ("2012/a/x.jpg", None), ("2012/b/y.jpg", "2012-05-01")], "path string, date string")
    linked = spark.createDataFrame([("2012/b/z.jpg",)], "path string")
    lost = M.orphans(media, linked)
    assert {r.path for r in lost.collect()} == {f"2012/a/{n}.jpg" for n in ("old mill2", "old mill3", "IMG_1", "x")}
    one, two = M.reconstruct(lost).orderBy("id").collect()
    assert one.id == "a-2012#r0001" and one.warnings == ["reconstructed"] and one.text.endswith("Photographed in a: old mill.") and len(one.photos) == 2
    assert two.entry_date == "2012-05-02" and two.warnings == ["reconstructed", "no_captions"] and two.chars == len(two.text)


def test_broken_images(spark):
    df = spark.createDataFrame([("a/x.jpg", b""), ("a/y.jpg", b"\0\0\0\0"), ("b/z.jpg", b"\xff\xd8..\xff\xd9")], "path string, content binary")
    assert sorted(map(tuple, M.image_report(df).collect())) == [("zero-filled", "a", 1), ("zero-length", "a", 1)]
