import json

from pagewright import cli


def test_build_search_lookup_ask(spark, tmp_path, capsys):
    rows = [("e1", "2012-01-01", "We won a tombola at the weir."), ("e2", "2013-01-02", "It rained on the mill."), ("e3", None, "undated")]
    text = "\n".join(json.dumps({"id": i, "source_file": "f", "trip": "t", "entry_date": d, "text": t, "photos": [], "warnings": []}) for i, d, t in rows)
    (tmp_path / "e.json").write_text(text)
    index = str(tmp_path / "index")
    cli.build(spark, str(tmp_path / "e.json"), index)
    hits = cli.search(spark, index, "the tombola", 1).collect()
    assert [(r.chunk_id, r.snippet) for r in hits] == [("e1/0", "We won a tombola at the weir.")]
    assert [r.chunk_id for r in cli.search(spark, index, "tombola in 2013").collect()] == ["e2/0"] and cli.search(spark, index, "tombola in 2013", year=0).count() == 2
    (tmp_path / "e.json").write_text(text.splitlines()[1])
    cli.build(spark, str(tmp_path / "e.json"), index)
    cli.main(["lookup", index, "mill"])
    assert "1 entries, 1 chunks, 1 occurrences" in capsys.readouterr().out
    cli.main(["ask", index, "rain on the mill?"])
    assert "2013-01-02" in capsys.readouterr().out
    cli.main(["search", index, "mill", "-k", "1"])
    assert "e2/0" in capsys.readouterr().out


def test_convert_patterns_evaluate_transcript(spark, tmp_path, capsys):
    from tests.test_sources import docx

    raw = tmp_path / "raw"
    raw.mkdir()
    t = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    docx(raw / "Fenmoor - 2012.docx", t("Apr. 3") + t("Owls sang by the orangery.") + t("Apr. 5") + t("Rain on the moor."))
    (raw / "2012").mkdir()
    (raw / "2012" / "20120405_1.jpg").write_bytes(b"x")
    cli.main(["convert", str(raw), str(tmp_path / "out")])
    out = capsys.readouterr().out
    assert "2 entries" in out and "photos_by_date" in out
    cli.build(spark, str(tmp_path / "out" / "entries"), str(tmp_path / "index"))
    questions = tmp_path / "q.txt"
    cli.main(["evaluate", str(tmp_path / "index"), str(questions)])
    assert "created" in capsys.readouterr().out
    questions.write_text("owls by the orangery | 2012-04-03 | SAYS orangery\nrain on the moor | 2012-04-05\nno bar here\n")
    cli.main(["evaluate", str(tmp_path / "index"), str(questions), "--save", str(tmp_path / "run")])
    out = capsys.readouterr().out
    assert "recall_1: 1.0" in out and "line 3 is no question" in out
    cli.main(["evaluate", str(tmp_path / "index"), str(questions), "--compare", str(tmp_path / "run"), "--filter", "owls"])
    out = capsys.readouterr().out
    assert "1 of 2 questions" in out and "not comparable" in out and "gone" in out
    cli.main(["evaluate", str(tmp_path / "index"), str(questions), "--validate"])
    cli.main(["patterns", str(tmp_path / "out" / "entries"), str(tmp_path / "lists"), "--questions", str(questions)])
    assert "fenmoor" in (next((tmp_path / "lists" / "name").glob("part*"))).read_text()
    cli.main(["stage", str(tmp_path / "out" / "entries"), str(tmp_path / "staged")])
    cli.main(["reconstruct", str(raw), str(tmp_path / "out")])
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_text("\n".join(json.dumps({"type": k, "message": {"role": k, "content": c}}) for k, c in (("user", "hello"), ("assistant", "hi"))))
    cli.main(["transcript", str(logs), str(tmp_path / "text")])
    assert "'exchanges': 1" in capsys.readouterr().out
