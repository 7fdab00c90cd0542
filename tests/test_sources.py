import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright.operators import entries as E, index as I
from pagewright.sources import config, journals, lists, media, store
from pagewright.streaming import index as S

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def docx(path, body, rels=""):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')


def test_journals_become_entries(spark, tmp_path):
    p = lambda *runs: "<w:p>" + "".join(runs) + "</w:p>"
    t = lambda s: f"<w:r><w:t>{s}</w:t></w:r>"
    link = '<w:hyperlink r:id="r1"><w:r><w:t>photo</w:t></w:r></w:hyperlink>'
    rel = '<Relationship Id="r1" Type="http://x/hyperlink" Target="file:///C:\\p\\2012\\klow\\a%20b.JPG"/>'
    docx(tmp_path / "klow - 2012.docx", p(t("Apr. 3")) + p(t("We left"), link, "<w:r><w:br/></w:r>", t("late.")), rel)
    (tmp_path / "~$klow.docx").write_bytes(b"lock")
    (tmp_path / "old.doc").write_bytes(b"not a zip")
    lines = journals.read_lines(spark, str(tmp_path)).cache()
    bad = [r.file for r in lines.where("error IS NOT NULL").collect()]
    assert bad == ["old.doc"]
    good = lines.where("error IS NULL")
    rows = [(r.line, r.links, r.new_par) for r in good.orderBy("line_no").collect()]
    assert rows == [("Apr. 3", [], True), ("We leftphoto", ["file:///C:\\p\\2012\\klow\\a%20b.JPG"], True), ("late.", [], False)]
    entry = E.segment(good).first()
    assert (entry.entry_date, entry.text) == ("2012-04-03", "We leftphoto\nlate.")
    found = journals.photo_links(good).first()
    assert (found.anchor_text, found.path, found.paragraph) == ("photo", "2012/klow/a b.JPG", 1)


def exif(day):
    value = day.encode() + b"\0"
    sub = 8 + 2 + 12 + 4
    top = struct.pack("<H", 1) + struct.pack("<HHII", 0x8769, 4, 1, sub) + struct.pack("<I", 0)
    inner = struct.pack("<H", 1) + struct.pack("<HHII", 36867, 2, len(value), sub + 2 + 12 + 4) + struct.pack("<I", 0) + value
    return b"\xff\xd8\xff\xe1\0\0Exif\0\0" + b"II*\0" + struct.pack("<I", 8) + top + inner + b"\xff\xd9"


def test_media_tree(spark, tmp_path):
    tree = tmp_path / "tree"
    for name, data in {"2012/klow/PXL_20120304_1.jpg": b"x", "2012/klow/holiday.JPG": exif("2011:05:06 07:08:09"), "2012/klow/plain.png": b"x", "2012/.hidden.jpg": b"x", "2012/a.txt": b"x"}.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_bytes(data)
    root = str(tree)
    assert {r.path for r in media.scan(spark, root).collect()} == {"2012/klow/PXL_20120304_1.jpg", "2012/klow/holiday.JPG", "2012/klow/plain.png"}
    want = {"2012/klow/PXL_20120304_1.jpg": "2012-03-04", "2012/klow/holiday.JPG": "2011-05-06", "2012/klow/plain.png": None}
    kept = media.cached_days(spark, root, str(tmp_path / "days"))
    assert {r.path: r.date for r in kept.collect()} == want
    (tree / "2012/klow/20130101_1.jpg").write_bytes(b"x")
    assert media.cached_days(spark, root, str(tmp_path / "days")).count() == 3 and media.cached_days(spark, root, str(tmp_path / "days"), rescan=True).count() == 4
    assert media.exif_day(b"Exif\0\0II*\0\xff\xff") is None and media.exif_day(b"") is None


def test_lists(spark, tmp_path):
    f = tmp_path / "q.txt"
    f.write_text('# comment\n// too\n\nWhere? | 2012-01-01, e#0001 | SAYS "a, b", c | NOT 2012-02-02\nnever | NONE\nno bar\nempty | \n')
    good, bad = lists.questions(spark, str(f))
    rows = [(r.question, r.expected, r.wrong, r.says) for r in good.orderBy("line_no").collect()]
    assert rows == [("Where?", ["2012-01-01", "e#0001"], ["2012-02-02"], ["a, b", "c"]), ("never", ["NONE"], [], [])] and bad.count() == 2
    f = tmp_path / "c.txt"
    f.write_text("// note\na#0001: 2012-01-01 #! typo\na#0001: 2012-01-02\nbad line\nb#0002: 2012-13\n")
    good, bad = lists.corrections(spark, str(f))
    assert [tuple(r) for r in good.collect()] == [("a#0001", "2012-01-02")] and bad.count() == 2
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "s.jsonl").write_text('{"type": "user", "message": {"role": "user", "content": "hi"}}\n\n{"type": "assistant", "message": {"content": [{"type": "text", "text": "yo"}]}}\n{"type": "us')
    got = [(r.line_no, r.type, r.message.content) for r in lists.session_logs(spark, str(logs)).orderBy("line_no").collect()]
    assert got == [(1, "user", "hi"), (3, "assistant", '[{"type":"text","text":"yo"}]'), (4, None, None)]


def test_config(tmp_path, monkeypatch):
    f = tmp_path / "c.yaml"
    f.write_text("paths:\n  data_root: /d\n  index: ${data_root}/i\nretrieval:\n  rare_slots: 3\ngeneration:\n  think: true\n")
    c = config.load(str(f))
    assert c.paths["index"] == "/d/i" and c.retrieval.rare_slots == 3 and c.generation.think and c.chunking.max_chars == 1600
    monkeypatch.setenv("PAGEWRIGHT_DATA", "/e")
    assert config.load("missing", str(f)).paths["index"] == "/e/i"
    f.write_text("retrival: {}\n")
    with pytest.raises(ValueError, match="retrival"):
        config.load(str(f))


def test_private_questions_and_template(spark, tmp_path):
    path = str(tmp_path / "q.txt")
    assert lists.write_template(spark, path) and not lists.write_template(spark, path)
    assert (tmp_path / "q.txt").read_text() == lists.TEMPLATE and lists.private_questions(spark, path).count() == 0
    (tmp_path / "p.txt").write_text('# no\nWho sang? | NONE\n\nWhere? | 2001-02-03 | says: "glass owl", moss,\nbare question')
    assert sorted(tuple(r) for r in lists.private_questions(spark, str(tmp_path / "p.txt")).collect()) == [("Where?", False, ["glass owl", "moss"]), ("Who sang?", True, []), ("bare question", False, [])]


def test_session_logs_in_blocks(spark, tmp_path):
    text = "\n".join(json.dumps({"type": "user", "message": {"role": "user", "content": f"line {k}"}}) if k % 7 else "" for k in range(400))
    (tmp_path / "a.jsonl").write_text(text)
    (tmp_path / "b.jsonl").write_text("{broken")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = lists.session_logs(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.line_no, r.message.content) for r in rows if r.log_file == "a.jsonl"} == {(k + 1, f"line {k}") for k in range(400) if k % 7}
    assert [(r.line_no, r.type) for r in rows if r.log_file == "b.jsonl"] == [(1, None)]


def test_signatures(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = (
        f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:rPr><w:b/><w:sz w:val="28"/></w:rPr><w:t>Day</w:t></w:r></w:p>'
        '<w:p><w:r><w:rPr><w:i/></w:rPr><w:t>a</w:t></w:r><w:r><w:rPr><w:i w:val="0"/></w:rPr><w:t>b</w:t></w:r></w:p><w:p/></w:body></w:document>'
    )
    styles = f'<w:styles xmlns:w="{w}"><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/styles.xml", styles)
    (tmp_path / "bad.docx").write_bytes(b"x")
    assert {(r.file, r.signature, r.paragraphs) for r in journals.read_signatures(spark, str(tmp_path)).collect()} == {("a.docx", "heading 1+bold+14pt", 1), ("a.docx", "Normal", 2)}


def test_store(spark, tmp_path):
    path = str(tmp_path / "t")
    assert store.latest(spark, path) is None
    store.publish(spark.range(3), path)
    before = store.latest(spark, path)
    store.publish(spark.range(5), path)
    (tmp_path / "t" / "v9").mkdir()  # cut off while written
    assert before.count() == 3 and store.latest(spark, path).count() == 5
    (tmp_path / "t" / "claims" / "3").write_text("")  # another writer's
    assert store.publish(spark.range(7), path).endswith("/v4") and store.latest_before(spark, path, 4).count() == 5
    assert store.expire(spark, path, 1) == [1, 2] and store.latest(spark, path).count() == 7
    assert store.export_json(spark.range(2), str(tmp_path / "j"), dry=True) == 2 and not (tmp_path / "j").exists()
    store.export_json(spark.range(2), str(tmp_path / "j"))
    store.export_csv(spark.range(2), str(tmp_path / "c"))
    store.save_run(spark.range(2), spark.range(1), str(tmp_path / "r"))
    statements = spark.createDataFrame([("a", None), ("b", "x")], "statement string, rejected string")
    store.save_statements(statements, str(tmp_path / "s"))
    store.save_patterns(spark.createDataFrame([("word", "b"), ("word", "a")], "kind string, value string"), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and spark.read.json(str(tmp_path / "s" / "state=kept")).count() == 1
    assert [r.value for r in spark.read.text(str(tmp_path / "p" / "word")).collect()] == ["a", "b"]


def entry(k, text):
    return json.dumps({"id": f"e{k}", "source_file": "f", "trip": "t", "entry_date": "2012-01-0%d" % k, "month_day": "", "text": text, "photos": [], "chars": len(text), "warnings": []})


def test_stream_keeps_the_index(spark, tmp_path):
    folder, path, check = tmp_path / "in", str(tmp_path / "index"), str(tmp_path / "check")
    folder.mkdir()
    seen = []

    def embedder(texts):
        seen.extend(texts)
        return I.hashed_words(8)(texts)

    def run():
        S.keep_index(S.entry_stream(spark, str(folder)), path, check, I.hashed_words(8), "m").awaitTermination()
        return {r.chunk_id: r.text for r in store.latest(spark, path).collect()}

    (folder / "1.json").write_text(entry(1, "a" * 1500 + "\n\n" + "b" * 1500) + "\n" + entry(2, "short"))
    assert set(run()) == {"e1/0", "e1/1", "e2/0"}
    (folder / "2.json").write_text(entry(1, "now short") + "\n" + entry(3, "new"))
    got = run()
    assert set(got) == {"e1/0", "e2/0", "e3/0"} and got["e1/0"].endswith("now short")
    # of one batch the later version holds, though it is the shorter one
    (folder / "3.json").write_text(entry(2, "a much longer wording than before") + "\n" + entry(2, "brief"))
    assert run()["e2/0"].endswith("brief")


def test_daily_counts_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 10:00:00", "a"), ("2024-01-01 11:00:00", "a"), ("2024-01-03 10:00:00", "b"), ("2024-01-06 10:00:00", "b")], "t string, event_type string")
    rows.select(F.to_timestamp("t").alias("ts"), "event_type").write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "ev"))
    q = S.daily_counts(stream).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((str(r.day), r.event_type, r.n) for r in spark.table("days").collect()) == [("2024-01-01", "a", 2), ("2024-01-03", "b", 1), ("2024-01-06", "b", 1)]


def test_every_query_is_registered(spark):
    import __spark_entry__ as e

    known = e.queries()
    assert set(e.oracle_sql()) <= set(known) and len(known) > 60
    assert e.entry(spark).columns


def test_lines_of_hand_kept_files_are_numbered(spark, tmp_path):
    (tmp_path / "c.txt").write_text("a#0001: 2001-02-03\nb#0001: 2001-02-04\na#0001: 2001-02-05\nodd")
    fixed, bad = lists.corrections(spark, str(tmp_path / "c.txt"))
    assert {r.entry_id: r.entry_date for r in fixed.collect()} == {"a#0001": "2001-02-05", "b#0001": "2001-02-04"} and [r.line_no for r in bad.collect()] == [3]
