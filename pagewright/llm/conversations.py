"""Conversations rebuilt from message rows.

Each log file is one sorted run of two senders, the user and the assistant, with
clocks of their own. That a line does not stand before the one above it bounds the
offset of the assistant's clock against the user's; the least-squares offset of a
file (equal mean delays in both directions) is moved into those bounds, and a file
whose bounds exclude each other has infeasible clocks. Times are corrected by the
offset and, where constraints are still broken or a time is missing, raised to the
latest before. Where a session's files are known to follow each other, a file's clock
is moved behind the end of the one before as well. The runs are then merged by
corrected time in one range sort.

Nothing is keyed by a session or file alone but one row per block of a file's lines,
or per part of the range sort; a session of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagewright.operators.transcript import INJECTED
from pagewright.session import cut

HEAD = 200
BLOCK = 4096
BLANK = r"(?U)^\s+|\s+$"


def speaker(kind: Column, role: Column) -> Column:
    """user, assistant or null, from an unevenly spelt type or, failing that, role."""
    name = lambda c: F.lower(F.trim(c))
    said = F.coalesce(F.nullif(name(kind), F.lit("")), name(role))
    return F.when(said.isin("user", "human"), "user").when(said == "assistant", "assistant")


def is_blocks(content: Column) -> Column:
    return content.rlike(r"^\s*\[\s*(\{|\]|$)")


def spoken_text(content: Column) -> Column:
    """Plain content, or the text blocks of a block list, joined by line breaks; null where the list cannot be read."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    return F.when(is_blocks(content), F.when(F.try_parse_json(content).isNotNull(), F.array_join(texts, "\n"))).otherwise(content)


def is_injected(text: Column) -> Column:
    head = F.substring(text, 1, HEAD)
    return F.exists(F.array(*map(F.lit, INJECTED)), lambda m: F.contains(head, m))


def _lines(events: DataFrame, with_text: bool) -> DataFrame:
    """One row per line of a file, repeated ones taken once, with its time in microseconds and whether it is spoken."""
    text = F.regexp_replace(spoken_text(F.col("message.content")), BLANK, "")
    read = events.select(
        "log_file", "line_no", "session_id", F.unix_micros("ts").alias("t"), "uuid",
        speaker(F.col("type"), F.col("message.role")).alias("speaker"),
        text.alias("text"),
        (is_blocks(F.col("message.content")) & text.isNull()).alias("unreadable"),
    )
    spoken = F.col("speaker").isNotNull() & (F.coalesce(F.col("text"), F.lit("")) != "") & ~((F.col("speaker") == "user") & is_injected(F.col("text")))
    kept = ["t", "uuid", "speaker", "spoken", "unreadable", *(["text"] if with_text else [])]
    return (
        read.withColumn("spoken", F.coalesce(spoken, F.lit(False)))
        .groupBy("log_file", "line_no")
        .agg(F.max("session_id").alias("session_id"), F.min_by(F.struct(*kept), F.struct("uuid", "t")).alias("l"))
        .select("log_file", "line_no", "session_id", "l.*")
        .withColumn("block", F.floor((F.col("line_no") - 1) / BLOCK))
    )


#: Stands for the beginning of a file without any time: behind all others.
_LATEST = 2**62


def clocks(spoken: DataFrame, files: DataFrame, *, files_follow: bool) -> DataFrame:
    """(file, block, session_id, started, offset, feasible, before, lowest, shift, behind): what corrects the times of a block.

    ``offset`` is added to the assistant's times, ``before`` is the latest corrected time
    before the block in its file, ``lowest`` the first in the file, ``shift`` what the file
    is moved by, and ``behind`` the end of the session's file before.
    """
    inner = W.partitionBy("file", "block").orderBy("line_no")
    timed = spoken.where(F.col("t").isNotNull()).select("file", "block", "line_no", "speaker", "t")
    gap = F.col("t") - F.lag("t").over(inner)
    reply = F.when(F.lag("speaker").over(inner) != F.col("speaker"), F.col("speaker") == "assistant")
    pairs = timed.select("*", gap.alias("gap"), reply.alias("reply"))

    def sums(forth: Column, back: Column) -> list[Column]:
        return [F.sum(forth).alias("there"), F.count(forth).alias("n_there"), F.sum(back).alias("back"), F.count(back).alias("n_back"), F.max(-forth).alias("least"), F.min(back).alias("most")]

    forth, back = F.when(F.col("reply"), F.col("gap")), F.when(~F.col("reply"), F.col("gap"))
    blocks = pairs.groupBy("file", "block").agg(
        *sums(forth, back),
        F.min_by(F.struct("speaker", "t"), "line_no").alias("first"),
        F.max_by(F.struct("speaker", "t"), "line_no").alias("last"),
        F.max(F.when(F.col("speaker") == "user", F.col("t"))).alias("user"),
        F.max(F.when(F.col("speaker") == "assistant", F.col("t"))).alias("assistant"),
    )
    # the pair across each block's edge
    line, whole = W.partitionBy("file").orderBy("block"), W.partitionBy("file")
    blocks = blocks.withColumn("past", F.lag("last").over(line))
    edge = F.when(F.col("past.speaker") != F.col("first.speaker"), F.col("first.t") - F.col("past.t"))
    over_forth, over_back = F.when(F.col("first.speaker") == "assistant", edge), F.when(F.col("first.speaker") == "user", edge)
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.select(
        "file", "block", "first", "user", "assistant",
        F.sum(zero(F.col("there")) + zero(over_forth)).over(whole).alias("there"), F.sum(F.col("n_there") + over_forth.isNotNull().cast("int")).over(whole).alias("n_there"),
        F.sum(zero(F.col("back")) + zero(over_back)).over(whole).alias("back"), F.sum(F.col("n_back") + over_back.isNotNull().cast("int")).over(whole).alias("n_back"),
        F.max(F.greatest("least", -over_forth)).over(whole).alias("least"), F.min(F.least("most", over_back)).over(whole).alias("most"),
    )
    best = zero(((F.try_divide("back", "n_back") - F.try_divide("there", "n_there")) / 2).cast("long"))
    blocks = blocks.withColumns({"offset": F.least(F.greatest(best, "least"), "most"), "feasible": F.coalesce(F.col("least") <= F.col("most"), F.lit(True))})
    moved = lambda c: c["t"] + F.when(c["speaker"] == "assistant", F.col("offset")).otherwise(0)
    blocks = blocks.withColumns({"opens": moved(F.col("first")), "top": F.greatest("user", F.col("assistant") + F.col("offset"))})
    blocks = blocks.withColumns(
        {
            "before": F.max("top").over(line.rowsBetween(W.unboundedPreceding, -1)),
            "lowest": F.min_by("opens", "block").over(whole),
            "highest": F.max("top").over(whole),
        }
    )
    ends = blocks.groupBy("file").agg(*(F.first(c).alias(c) for c in ("offset", "feasible", "lowest", "highest")))
    ends = files.select("file", "session_id", "started").join(ends, "file", "left")
    if files_follow:
        order = W.partitionBy("session_id").orderBy("started", "file")
        past = order.rowsBetween(W.unboundedPreceding, -1)
        ends = ends.withColumn("lasts", zero(F.col("highest") - F.col("lowest")))
        ends = ends.withColumn("spent", F.sum("lasts").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("lasts"))
        # the end of the files before is the largest of each one's beginning and all that followed it
        ends = ends.withColumn("behind", F.max(F.col("lowest") - F.col("spent")).over(past) + F.col("spent"))
        ends = ends.withColumn("shift", F.greatest(zero(F.col("behind") - F.col("lowest")), F.lit(0)))
    else:
        ends = ends.withColumns({"behind": F.lit(None).cast("long"), "shift": F.lit(0).cast("long")})
    ends = ends.select("file", "session_id", "started", "offset", "feasible", "lowest", "behind", "shift")
    known = blocks.select("file", "block", "before")
    every = spoken.select("file", "block").distinct()
    # blocks without any time take what stands before them
    every = every.join(known, ["file", "block"], "left").join(blocks.select("file", "block", "top"), ["file", "block"], "left")
    every = every.withColumn("before", F.max("top").over(line.rowsBetween(W.unboundedPreceding, -1)))
    return every.select("file", "block", "before").join(ends, "file")


def rebuild_conversations(events: DataFrame, *, files_follow: bool = True, reject_infeasible: bool = False, with_text: bool = True) -> DataFrame:
    """(session_id, pos, uuid, speaker, text, ts, corrected_ts, feasible) of every kept session.

    Order: by corrected time. With ``files_follow`` a session's files follow each other by
    their earliest time, so that is files by earliest time and lines by number; without
    it, runs that overlap are merged. A message met again counts
    where it first stood. Spoken are user and assistant messages with text that
    is not blank, without injected user messages. Dropped are sessions in which
    nothing is spoken, the assistant speaks first, a user message has no spoken
    reply before the next one or the end, a block list cannot be read, or a line
    is missing from a file; with ``reject_infeasible`` also those with a file whose
    clocks are. A missing session id is taken from the file's other lines; a file
    without any is left out. Repeated rows count once. Null and empty messages
    are not spoken; extra columns are ignored; no rows give no rows. Without
    ``with_text`` the text is null, and is not moved.
    """
    # a missing file name stands for one file
    lines = cut(_lines(events, with_text).withColumn("file", F.struct("log_file")).drop("log_file"))
    files = lines.groupBy("file").agg(
        F.max("session_id").alias("session_id"),
        F.coalesce(F.min("t"), F.lit(_LATEST)).alias("started"),
        ((F.count("*") < F.max("line_no")) | F.max("unreadable")).alias("broken"),
    ).where(F.col("session_id").isNotNull())
    spoken = lines.where("spoken").drop("session_id", "spoken", "unreadable")
    inner = W.partitionBy("file", "block").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    moved = F.col("t") + F.when(F.col("speaker") == "assistant", F.coalesce("offset", F.lit(0))).otherwise(0)
    raised = F.greatest("before", F.max("moved").over(inner))
    text = F.col("text") if with_text else F.lit(None).cast("string")
    timed = spoken.join(clocks(spoken, files, files_follow=files_follow), ["file", "block"]).withColumn("moved", moved)
    timed = timed.withColumn("at", F.coalesce(F.coalesce(raised, "lowest") + F.col("shift"), "behind"))
    who = F.coalesce("uuid", F.concat_ws("#", "file.log_file", "line_no"))
    place = F.struct("at", "started", "file", "line_no")
    messages = (
        timed.groupBy("session_id", who.alias("message"))
        .agg(F.min_by(F.struct("at", "started", "file", "line_no", "uuid", "speaker", text.alias("text"), "t", F.coalesce("feasible", F.lit(True)).alias("feasible")), place).alias("m"))
        .select("session_id", "m.*")
    )
    order = ["session_id", "at", "started", "file", "line_no"]
    merged = messages.repartitionByRange(*order).sortWithinPartitions(*order)
    merged = cut(merged.select("session_id", "uuid", "speaker", "text", "t", "at", "feasible", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    beside = W.partitionBy("session_id", "part").orderBy("row")
    merged = merged.withColumn("unanswered", (F.col("speaker") == "user") & (F.coalesce(F.lead("speaker").over(beside), F.lit("")) == "user"))
    parts = merged.groupBy("session_id", "part").agg(
        F.count("*").alias("n"), F.min("row").alias("begin"), F.min_by("speaker", "row").alias("first"), F.max_by("speaker", "row").alias("last"),
        F.max("unanswered").alias("unanswered"), F.min("feasible").alias("all_feasible"),
    )
    line, whole = W.partitionBy("session_id").orderBy("part"), W.partitionBy("session_id")
    bad = (
        F.col("unanswered")
        | (F.lag("last").over(line).isNull() & (F.col("first") == "assistant"))
        | ((F.col("last") == "user") & (F.coalesce(F.lead("first").over(line), F.lit("user")) == "user"))
    )
    if reject_infeasible:
        bad = bad | ~F.col("all_feasible")
    parts = parts.select("session_id", "part", "begin", bad.alias("bad"), F.coalesce(F.sum("n").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    parts = parts.withColumn("bad", F.max("bad").over(whole)).where(~F.col("bad"))
    broken = files.where("broken").select("session_id").distinct()
    kept = parts.join(broken, "session_id", "left_anti").select("session_id", "part", "begin", "before")
    return merged.join(kept, ["session_id", "part"]).select(
        "session_id", (F.col("before") + F.col("row") - F.col("begin") + 1).cast("int").alias("pos"), "uuid", "speaker", "text",
        F.timestamp_micros("t").alias("ts"), F.timestamp_micros("at").alias("corrected_ts"), "feasible",
    )
