import datetime as dt
import json

from pagewright.llm.conversations import rebuild_conversations

T0 = dt.datetime(2024, 1, 1, 12)
SCHEMA = "event_id bigint, session_id string, log_file string, line_no int, ts timestamp, uuid string, type string, message struct<role: string, content: string>, pos int"


def line(session, file, no, who, content, uuid=None, at=None, **extra):
    kind, role = extra.get("kind", who), extra.get("role", who)
    return (no, session, file, no, None if at is None else T0 + dt.timedelta(seconds=at), uuid or f"{file}-{no}", kind, None if content is None else (role, content), 0)


def blocks(*texts):
    return json.dumps([{"type": "thinking", "thinking": "hm"}] + [{"type": "text", "text": t} for t in texts])


ROWS = [
    # kept: two files, the later one logging a message again, injected and tool lines between
    line("a", "f2", 1, "user", "more?", "a-3", 100), line("a", "f2", 2, "assistant", blocks("again"), "a-2", 101), line(None, "f2", 3, "ASSISTANT", blocks("yes", "indeed"), "a-4", 102),
    line("a", "f1", 1, "user", "Caveat: local", at=1), line("a", "f1", 2, "human", "hello", "a-1", 2, role=None), line("a", "f1", 3, "assistant", blocks("again"), "a-2", 3),
    line("a", "f1", 4, "summary", None, at=4), line("a", "f1", 4, "summary", None, at=4), line("a", "f1", 5, "user", json.dumps([{"type": "tool_result", "content": "x"}]), at=5),
    # dropped: assistant first, unanswered at the end, two questions in a row, unreadable, a missing line, nothing spoken
    line("b", "g", 1, "assistant", "hi", at=1), line("b", "g", 2, "user", "x", at=2), line("b", "g", 3, "assistant", "y", at=3),
    line("c", "h", 1, "user", "x", at=1), line("d", "i", 1, "user", "x", at=1), line("d", "i", 2, "user", "y", at=2), line("d", "i", 3, "assistant", "z", at=3),
    line("e", "j", 1, "user", "x", at=1), line("e", "j", 2, "assistant", "y", at=2), line("e", "j", 3, "assistant", '[{"type": "te', at=3),
    line("f", "k", 1, "user", "x", at=1), line("f", "k", 3, "assistant", "y", at=3), line("g", "l", 1, "system", None, at=1), line("g", "l", 2, "user", "  ", at=2),
    # plain text that opens with a bracket is no block list; missing times stay in line order
    line("h", "m", 1, None, "[draft] is it long?", role="user"), line("h", "m", 2, None, "no", role="Assistant"),
]


def test_conversations(spark):
    rows = rebuild_conversations(spark.createDataFrame(ROWS, SCHEMA)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.session_id, r.pos)):
        got.setdefault(r.session_id, []).append((r.pos, r.uuid, r.speaker, r.text))
    assert got == {
        "a": [(1, "a-1", "user", "hello"), (2, "a-2", "assistant", "again"), (3, "a-3", "user", "more?"), (4, "a-4", "assistant", "yes\nindeed")],
        "h": [(1, "m-1", "user", "[draft] is it long?"), (2, "m-2", "assistant", "no")],
    }


def test_clock_offset(spark):
    # the assistant's clock is 60 s ahead; replies take 4 s either way
    rows = [line("a", "f", k + 1, ("user", "assistant")[k % 2], f"t{k}", at=4 * k + 60 * (k % 2)) for k in range(10)]
    out = rebuild_conversations(spark.createDataFrame(rows, SCHEMA)).orderBy("pos").collect()
    times = [r.corrected_ts for r in out]
    assert times == sorted(times) and all(abs((b - a).total_seconds() - 4) < 1e-3 for a, b in zip(times, times[1:]))
    assert all(r.feasible for r in out)


def test_clashing_clocks_and_empty(spark):
    rows = [line("a", "f", k + 1, ("user", "assistant")[k % 2], f"t{k}", at=t) for k, t in enumerate([0, 100, 10, -50])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.feasible for r in rebuild_conversations(df).collect()] == [False] * 4
    assert rebuild_conversations(df, reject_infeasible=True).count() == 0
    assert rebuild_conversations(df.limit(0)).count() == 0


def test_blocks_of_lines_meet(spark, monkeypatch):
    from pagewright.llm import conversations

    # the assistant's clock is 60 s ahead in one file and 7 s behind in the next; every second line is no message
    rows = []
    for name, shift, begun in (("f", 60, 0), ("g", -7, 1000)):
        for k in range(12):
            rows.append(line("a", name, 2 * k + 1, ("user", "assistant")[k % 2], f"{name}{k}", at=begun + 4 * k + shift * (k % 2)))
            rows.append(line("a", name, 2 * k + 2, "system", None, at=begun + 4 * k))
    df = spark.createDataFrame(rows, SCHEMA)
    whole = [tuple(r) for r in rebuild_conversations(df).orderBy("pos").collect()]
    assert [r[2] for r in whole] == [f"{n}-{2 * k + 1}" for n in "fg" for k in range(12)]
    times = [r[6] for r in whole]
    assert all(abs((b - a).total_seconds() - 4) < 1e-3 for k, (a, b) in enumerate(zip(times, times[1:])) if k != 11)
    for size in (1, 2, 3, 5):
        monkeypatch.setattr(conversations, "BLOCK", size)
        assert [tuple(r) for r in rebuild_conversations(df).orderBy("pos").collect()] == whole


def test_overlapping_files(spark):
    rows = [line("a", "f", 1, "user", "q1", at=0), line("a", "f", 2, "assistant", "a1", at=10), line("a", "g", 1, "user", "q2", at=3), line("a", "g", 2, "assistant", "a2", at=7)]
    df = spark.createDataFrame(rows, SCHEMA)
    follow = rebuild_conversations(df).orderBy("pos").collect()
    assert [r.text for r in follow] == ["q1", "a1", "q2", "a2"] and [r.corrected_ts for r in follow] == sorted(r.corrected_ts for r in follow)
    # merged by their clocks the two runs interleave, which leaves the first question unanswered
    assert rebuild_conversations(df, files_follow=False).count() == 0
    apart = spark.createDataFrame([*rows[:2], line("a", "g", 1, "user", "q2", at=13), line("a", "g", 2, "assistant", "a2", at=17)], SCHEMA)
    assert [r.text for r in rebuild_conversations(apart, files_follow=False).orderBy("pos").collect()] == ["q1", "a1", "q2", "a2"]
