import pytest
from pyspark.sql import functions as F

from pagewright.operators import answer as A, evaluate as X, index as I, privacy as P, retrieve as R, staging as G, transcript as L

CHUNKS = [
    ("a/0", "a", "2012-01-01", 0, 2012, "klow", "The tombola was won at the weir.", [1.0, 0.0]), ("a/1", "a", "2012-01-01", 1, 2012, "klow", "The tombola again, and 100% rain.", [0.9, 0.1]),
    ("b/0", "b", "2013-02-02", 0, 2013, "zenda", "A weir and a weird tombola.", [0.0, 1.0]), ("c/0", "c", "2013-02-03", 0, 2013, "zenda", "Nothing much at all here.", [0.6, 0.8]), ("d/0", "d", "2013-02-04", 0, 2013, "", "Rain on the mill.", None),
]
SCHEMA = "chunk_id string, entry_id string, entry_date string, chunk_index int, year int, trip string, text string, vector array<float>"


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, SCHEMA)


def asked(spark, *rows):
    return spark.createDataFrame([(k, q, v) for k, (q, v) in enumerate(rows)], "q bigint, query string, qv array<float>")


def test_lookup(chunks):
    ids = lambda df: [r.chunk_id for r in df.collect()]
    assert ids(R.lookup(chunks, "Weir")) == ["a/0", "b/0"] and ids(R.lookup(chunks, "weird")) == ["b/0"]
    assert [r["count"] for r in R.lookup(chunks, "weir", whole=False).collect()] == [1, 2]
    assert ids(R.lookup(chunks, "100%", whole=False)) == ["a/1"] and ids(R.lookup(chunks, "%", whole=False)) == ["a/1"] and ids(R.lookup(chunks, " ")) == []
    assert ids(R.lookup(R.narrowed(chunks, 2013), "weir")) == ["b/0"] and ids(R.lookup(R.narrowed(chunks, trip="klow"), "weir")) == ["a/0"]


def test_literal_counts_agree_with_and_without_the_automaton(chunks, monkeypatch):
    import sys

    got = lambda whole: sorted(map(tuple, R.literal_counts(chunks, "chunk_id", "text", ["weir", "weird", "tombola", ""], whole).collect()))
    assert ("b/0", "weir", 2) in got(False) and ("b/0", "weir", 1) in got(True)
    both = got(False), got(True)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    assert both == (got(False), got(True))


def test_vectors(spark, chunks):
    rows = R.nearest(chunks, asked(spark, ("x", [1.0, 0.0]), ("y", [0.0, 0.0]), ("z", None)), 3, 2).orderBy("rank").collect()
    assert [(r.q, r.chunk_id) for r in rows if r.q == 0] == [(0, "a/0"), (0, "a/1"), (0, "c/0")] and rows[0].distance == 0
    assert R.nearest(chunks.limit(0), asked(spark, ("x", [1.0, 0.0])), 3, 2).count() == 0


def test_keywords(spark, chunks):
    rows = R.keyword(chunks, asked(spark, ("the tombola weir", None), ("the of", None)), 3).orderBy("rank").collect()
    assert {r.q for r in rows} == {0} and rows[0].chunk_id in ("a/0", "b/0") and len(rows) == 3


def test_fusion(spark):
    run = lambda *ids: spark.createDataFrame([(0, c, k + 1) for k, c in enumerate(ids)], "q int, chunk_id string, rank int")
    order = lambda *runs: [r.chunk_id for r in R.fuse(list(runs), 3).orderBy("rank").collect()]
    assert order((run("a", "b", "c"), 1.0), (run("d", "b"), 1.0))[0] == "b"
    assert order((run("a", "b"), 1.0), (run("c"), 0.02))[:2] == ["a", "b"] and order((run("a"), 1.0), (run(), 1.0)) == ["a"]
    assert order((run("a"), 1.0), (run("b"), 1.0)) == ["a", "b"]


def test_reserved_places(spark, chunks):
    q = asked(spark, ("the time I won a tombola", [0.6, 0.8]))
    rare = R.rare_hits(chunks, q, 2, 2).orderBy("rank").collect()
    assert [r.chunk_id for r in rare] == ["b/0", "a/1"]
    got = R.search(chunks, asked(spark, ("again", [0.6, 0.8])), 2, 2, rare_slots=2).orderBy("rank").collect()
    assert [(r.chunk_id, r.rare) for r in got] == [("c/0", False), ("a/1", True)]
    assert R.search(chunks, q, 1, 2).count() == 1
    assert {tuple(r) for r in R.literal_coverage(chunks, asked(spark, ("tombola nothing", None))).collect()} == {(0, "nothing", 1)}


def test_near_tie_is_kept(spark):
    rows = [(f"e{k}/0", f"e{k}", "tombola", [s, (1 - s * s) ** 0.5]) for k, s in enumerate([0.3668, 0.32823, 0.32805, 0.1])]
    df = spark.createDataFrame(rows, "chunk_id string, entry_id string, text string, vector array<float>")
    assert R.rare_hits(df, asked(spark, ("tombola", [1.0, 0.0])), 2, 2).count() == 3


def test_index(spark, chunks):
    made = I.embed(chunks, I.hashed_words(8)).withColumn("hash", I.T.content_hash(I.F.col("text"), "m"))
    assert I.pending(chunks, made, "m").count() == 0 and I.pending(chunks, made, "other").count() == 5 and I.pending(chunks, made.limit(0), "m").count() == 5
    fresh = made.where("chunk_id = 'a/0'").withColumn("text", I.F.lit("new"))
    after = I.upsert(made, fresh, made.where("chunk_id = 'b/0'"))
    assert {r.chunk_id: r.text for r in after.collect()}["a/0"] == "new" and after.count() == 4
    assert [r.chunk_id for r in I.stale(chunks.where("chunk_id <> 'c/0'"), made).collect()] == ["c/0"]
    r = I.verify(made.unionByName(made.limit(1).withColumn("vector", I.F.array(I.F.lit(float("nan"))).cast("array<float>"))), 8).first()
    assert (r.rows, r.repeated_ids, r.wrong_length, r.with_nan, r.undated) == (6, 1, 1, 1, 0)
    with pytest.raises(Exception, match="vectors"):
        I.embed(chunks, lambda texts: I.np.zeros((1, 8))).count()


def test_answers(spark, chunks):
    hits = spark.createDataFrame([(0, 1, "2012-01-01", "x" * 50), (0, 2, "2012-01-02", "y" * 50), (0, 3, "2012-01-03", "z"), (1, 1, "2012-01-04", "w" * 500)], "q bigint, rank int, entry_date string, text string")
    got = {r.q: r for r in A.context(hits, 100).collect()}
    assert got[0].kept == 1 and got[0].context == "[2012-01-01] " + "x" * 50 and got[1].kept == 1
    made = A.ask(chunks, asked(spark, ("who won the tombola", [1.0, 0.0]), ("in 2013?", [1.0, 0.0])), A.first_sentences, 2, 2, rare_slots=0).orderBy("q").collect()
    assert made[0].cited == ["2012-01-01"] and not made[0].refused and made[1].cited[0].startswith("2013")
    empty = A.ask(chunks.limit(0), asked(spark, ("x", [1.0, 0.0])), A.first_sentences, 2, 2, rare_slots=0).first()
    assert empty.refused and empty.cited == []
    with pytest.raises(Exception, match="no text"):
        A.ask(chunks, asked(spark, ("x", [1.0, 0.0])), lambda q, p: iter(()), 2, 2, rare_slots=0).count()
    cov = A.coverage(chunks, asked(spark, ("tombola", None)), spark.createDataFrame([(0, 1, ["2012-01-01"])], "q bigint, kept int, cited array<string>")).first()
    assert (cov.term, cov.entries, cov.cited) == ("tombola", 2, 1) and A.budget(8192, 100, 10) > 2000 == A.budget(10, 100, 10)


def test_scores(spark):
    hits = spark.createDataFrame([(0, 1, "w/0", "w", "2012-01-09", 0.9), (0, 2, "a/0", "a", "2012-01-01", 0.8), (0, 3, "w/1", "w", "2012-01-09", 0.7), (0, 4, "b/0", "b", "2012-01-02", 0.6), (1, 1, "w/0", "w", "2012-01-09", 0.9)], "q int, rank int, chunk_id string, entry_id string, entry_date string, score double")
    qs = spark.createDataFrame([(0, ["2012-01-01", "b", "zz"], ["w"]), (1, ["NONE"], ["2012-01-09"]), (2, ["a"], [])], "q int, expected array<string>, wrong array<string>")
    a, b, c = X.score_hits(hits, qs).orderBy("q").collect()
    assert (a["rank"], a.matched, a.found, a.wrong_in_window, a.wrong_above, a.top_score) == (2, "2012-01-01", 2, 2, 2, 0.9)
    assert (b["rank"], b.found, b.wrong_above) == (None, 0, 1) and (c["rank"], c.found, c.wrong_in_window) == (None, 0, 0)
    entries = spark.createDataFrame([("2012-01-01", "Mashed potato")], "entry_date string, text string")
    bad = spark.createDataFrame([(0, ["2012-01-01", "2012-01-01", "2013-01-01"], ["mashed potatoes", "potato"])], "q int, expected array<string>, says array<string>")
    assert {(r.problem, r.value) for r in X.validate(bad, entries).collect()} == {("duplicate_date", "2012-01-01"), ("unknown_date", "2013-01-01"), ("missing_says", "mashed potatoes")}
    run = lambda rows: spark.createDataFrame(rows, "question string, rank int")
    got = {r.question: r.change for r in X.compare(run([("a", 1), ("b", 2), ("c", None), ("d", 3)]), run([("a", 2), ("b", 2), ("c", 4), ("e", 1)])).collect()}
    assert got == {"a": "worse", "b": "same", "c": "better", "d": "gone", "e": "new"}


def test_staging(spark):
    entry = "We met Anna at the “mill”.\nIt rained."
    rows = [("", "x"), ("s", " "), ("It rained", "it RAINED."), ("It snowed", "It snowed."), ("We met Bob and Anna", 'met Anna at the "mill"')]
    df = spark.createDataFrame([(s, e, entry) for s, e in rows], "s string, e string, t string")
    got = [r.r for r in df.select(G.rejection(*(G.F.col(c) for c in "set")).alias("r")).collect()]
    assert got == ["empty statement", "no evidence given", None, "evidence not found verbatim in the entry", "names not in its evidence: bob"]
    entries = spark.createDataFrame([("e1", "2012-01-01", "It rained.")], "id string, entry_date string, text string")
    made = G.stage(entries, lambda q, t: iter(['{"statement": "It rained", "evidence": "It rained."}\nbye'])).first()
    assert made.entry_id == "e1" and made.rejected is None and G.select(entries, number=1).count() == 1 and G.select(entries, dates=["x"]).count() == 0


def test_privacy(spark):
    entries = spark.createDataFrame([(f"e{k}", "2012-01-01", "common word" + (" orangery" if k < 3 else "")) for k in range(20)], "id string, entry_date string, text string")
    qs = spark.createDataFrame([("Where was the glass orangery", ["e1"], ["orangery", "common"]), ("the common ghost", ["NONE"], [])], "question string, expected array<string>, says array<string>")
    got = {(r.kind, r.value) for r in P.phrases(qs, entries).collect()}
    assert got == {("phrase", "where was the glass orangery"), ("phrase", "glass orangery"), ("word", "orangery")}
    texts = spark.createDataFrame([(1, "an Orangery on 2012-01-01, not 2012-01-01T10 or preorangery"), (2, "the glass orangery x"), (3, None)], "k int, t string")
    patterns = spark.createDataFrame([("word", "orangery"), ("date", "2012-01-01"), ("phrase", "glass orangery")], "kind string, value string")
    assert {tuple(r) for r in P.scan(texts, patterns, "k", "t").collect()} == {(1, "word", "orangery"), (1, "date", "2012-01-01"), (2, "word", "orangery"), (2, "phrase", "glass orangery")}
    places = spark.createDataFrame([("Old Klowburg",), ("2012",), ("bay",)], "place string")
    assert {r.value for r in P.names(places).collect()} == {"old klowburg", "klowburg"}
    files = spark.createDataFrame([("a.docx", 1), ("src/x.py", 9_000_000), ("src/y.py", 1)], "path string, size long")
    assert {r.path for r in P.file_policy(files).collect()} == {"a.docx", "src/x.py"}


def test_policy_takes_in_every_suffix_and_folder(spark):
    names = [f"a.{x}" for x in P.BLOCKED_SUFFIXES] + [f"x/{f}/y.py" for f in P.BLOCKED_FOLDERS] + ["A.RTF", "n.ipynb"]
    files = spark.createDataFrame([(n, 1) for n in names + ["src/x.py", "indexes/y.py", "notes.md"]] + [("big.py", 5 * 1024 * 1024 + 1), ("fits.py", 5 * 1024 * 1024)], "path string, size long")
    assert {r.path for r in P.file_policy(files).collect()} == {*names, "big.py"}


def test_patterns_are_searched_for_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 3)
    texts = spark.createDataFrame([(k, f"word{k} stands here") for k in range(10)], "k int, t string")
    patterns = spark.createDataFrame([("word", f"word{k}") for k in range(10)], "kind string, value string")
    assert {tuple(r) for r in P.scan(texts, patterns, "k", "t").collect()} == {(k, "word", f"word{k}") for k in range(10)}
    assert P.scan(texts, patterns.limit(0), "k", "t").count() == 0


def test_stored_keyword_index(spark, tmp_path):
    rows = spark.createDataFrame([("a", "glass owl moss"), ("b", "owl owl fen"), ("c", "rain")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "the owl and moss"), (2, "nothing")], "q int, query string")
    assert I.read_keyword_index(spark, str(tmp_path / "k")) is None
    I.write_keyword_index(rows, str(tmp_path / "k"))
    stored = I.read_keyword_index(spark, str(tmp_path / "k"))
    assert R.keyword(rows, asked, 5).collect() == R.keyword(rows.select("chunk_id"), asked, 5, stored).collect()
    # of the index only the chunks asked among, with the scores of the whole
    assert [r.chunk_id for r in R.keyword(rows.where("chunk_id = 'b'").select("chunk_id"), asked, 5, stored).collect()] == ["b"]


def test_filtered_questions_and_deltas(spark):
    asked = spark.createDataFrame([(1, "Where was the Owl"), (2, "moss")], "q int, query string")
    kept, note = X.filtered(asked, "owl")
    assert [r.q for r in kept.collect()] == [1] and tuple(note.first()) == (1, 2, False)
    one = lambda r1, misses: spark.createDataFrame([(r1, 0.5, misses)], "recall_1 double, recall_3 double, misses long").withColumn("recall_5", F.lit(None).cast("double"))
    changes = lambda c: spark.createDataFrame([("x", c)], "question string, change string")
    got = {r.metric: (r.delta, r.direction, r.comparable) for r in X.metric_deltas(one(0.25, 3), one(0.5, 2), changes("better")).collect()}
    assert got == {"recall_1": (0.25, "up", True), "recall_3": (0.0, "same", True), "misses": (-1.0, "down", True)}
    assert not X.metric_deltas(one(0.25, 3), one(0.5, 2), changes("new")).first().comparable


def test_transcripts(spark):
    say = lambda n, kind, text: ("f", n, kind, (kind, text))
    rows = [say(1, "assistant", "early"), say(2, "user", "hello"), say(3, "assistant", '[{"type": "text", "text": "hi"}, {"type": "thinking", "thinking": "x"}]'), say(3, "assistant", '[{"type": "text", "text": "hi"}, {"type": "thinking", "thinking": "x"}]'), say(4, "user", "<system-reminder> x"), say(5, "assistant", "there"), say(6, "user", "<bash-input>ls</bash-input>"), say(7, "user", "bye"), say(8, "assistant", '[{"ty')]
    df = spark.createDataFrame(rows, "log_file string, line_no int, type string, message struct<role:string,content:string>")
    got = [tuple(r) for r in L.turns(df).orderBy("turn").collect()]
    assert got == [("", 1, "hello", False, ["hi", "there"]), ("", 2, "ls", True, []), ("", 3, "bye", False, [])]
    assert tuple(L.counts(df).first()) == (3, 1, 1, 1) and "no reply" in L.render(L.turns(df)).orderBy("turn").collect()[2].text


def test_replies_belong_to_turns_of_earlier_files(spark):
    rows = [("p", "b", 1, 1, "assistant", "first of all"), ("p", "b", 2, 1, "user", "one"), ("p", "a", 1, 2, "assistant", "to one"), ("p", "a", 2, 2, "user", "two"), ("q", "c", 1, 1, "user", "other"), ("p", "z", 1, 3, "assistant", "to two")]
    df = spark.createDataFrame([(p, f, n, w, k, (k, t)) for p, f, n, w, k, t in rows], "project string, log_file string, line_no int, written int, type string, message struct<role:string,content:string>")
    got = sorted(tuple(r) for r in L.turns(df).collect())
    assert got == [("p", 1, "one", False, ["to one"]), ("p", 2, "two", False, ["to two"]), ("q", 1, "other", False, [])]
