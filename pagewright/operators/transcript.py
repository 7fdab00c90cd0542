"""Session logs as prompts with their replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagewright.functions import text as T
from pagewright.operators.ordered import with_running

# Openings of user messages that a harness injects.
INJECTED = [
    "<system-reminder>",
    "This session is being continued",
    "[Request interrupted",
    "Caveat:",
    "<command-name>",
    "<local-command",
    "[SYSTEM NOTIFICATION",
    "<task-notification>",
    "The user doesn't want to proceed",
    "Your questions have been answered",
]


def message_text(content: Column) -> Column:
    """Plain content, or the text blocks of a JSON list joined by line breaks; null where such a list cannot be read."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    return F.when(content.rlike(r"^\s*\[\s*(\{|\]|$)"), F.when(F.try_parse_json(content).isNotNull(), F.array_join(texts, "\n"))).otherwise(content)


def is_user_turn(text: Column) -> Column:
    """Whether a user's message is the user's, not injected."""
    head = F.substring(text, 1, 200)
    return ~F.exists(F.array(*map(F.lit, INJECTED)), lambda m: F.contains(head, m))


def _events(events: DataFrame) -> DataFrame:
    """One row per line of a file: project, log_file, line_no, place, turn, skipped, reply, text.

    ``place`` numbers a project's lines over its files, which follow each other by when they
    were last written (``written``, or the latest ``ts``) and name.
    """
    kind = F.lower(F.trim(F.coalesce("type", "message.role")))
    text = F.regexp_replace(message_text(F.col("message.content")), r"(?U)^\s+|\s+$", "")
    project = F.col("project") if "project" in events.columns else F.lit("").alias("project")
    written = next((F.col(c) for c in ("written", "ts") if c in events.columns), F.lit(0)).alias("written")
    rows = events.select(project, "log_file", "line_no", written, F.when(kind == "human", "user").otherwise(kind).alias("kind"), text.alias("text"))
    files = rows.groupBy("project", "log_file").agg(F.max("written").alias("written"), F.max("line_no").cast("bigint").alias("lines"))
    order = W.partitionBy("project").orderBy("written", "log_file").rowsBetween(W.unboundedPreceding, -1)
    files = files.select(F.col("project").alias("_p"), F.col("log_file").alias("_f"), F.coalesce(F.sum("lines").over(order), F.lit(0)).alias("before"))
    rows = rows.groupBy("project", "log_file", "line_no").agg(F.min(F.struct("kind", "text")).alias("m")).select("project", "log_file", "line_no", "m.*")
    rows = rows.join(files, F.equal_null("project", "_p") & F.equal_null("log_file", "_f")).drop("_p", "_f")
    said = F.coalesce(F.col("text"), F.lit("")) != ""
    user = (F.col("kind") == "user") & said
    own = is_user_turn(F.col("text"))
    return rows.withColumns(
        {
            "place": F.col("before") + F.col("line_no"),
            "turn": F.coalesce(user & own, F.lit(False)),
            "skipped": F.coalesce(user & ~own, F.lit(False)),
            "reply": F.coalesce((F.col("kind") == "assistant") & said, F.lit(False)),
        }
    ).drop("before")


def turns(events: DataFrame) -> DataFrame:
    """(project, turn, prompt, shell, replies): each user's message with the replies up to the next, over a project's files.

    A reply in a later file belongs to the last turn before it; replies before a project's first
    turn are dropped; injected messages open none. Repeated lines count once; unreadable ones say nothing.
    """
    rows = with_running(_events(events), "project", "place", {"n": F.col("turn")}).where("n > 0 AND (turn OR reply)")
    prompt = F.max(F.when(F.col("turn"), F.col("text")))
    replies = F.transform(F.array_sort(F.collect_list(F.when(F.col("reply"), F.struct("place", "text")))), lambda r: r["text"])
    whole = rows.groupBy("project", F.col("n").alias("turn")).agg(prompt.alias("said"), replies.alias("replies"))
    command = T.shell_command(F.col("said"))
    return whole.select("project", "turn", F.coalesce(command, "said").alias("prompt"), command.isNotNull().alias("shell"), "replies")


def counts(events: DataFrame) -> DataFrame:
    """One row: exchanges, shell commands, turns without a reply, injected messages."""
    t = turns(events).agg(
        F.count("*").alias("exchanges"), F.count_if("shell").alias("shell_commands"), F.count_if((F.size("replies") == 0) & ~F.col("shell")).alias("unanswered")
    )
    skipped = _events(events).agg(F.count_if("skipped").alias("skipped"))
    return t.join(F.broadcast(skipped))  # one row each


def render(made: DataFrame) -> DataFrame:
    """(project, turn, text): turns as readable text."""
    who = F.when(F.col("shell"), "YOU (in the shell)").otherwise("YOU")
    body = F.when(F.size("replies") > 0, F.concat(F.lit("\n\nREPLY\n\n"), F.array_join("replies", "\n\n"))).when(F.col("shell"), "").otherwise("\n\n[no reply recorded]")
    return made.select("project", "turn", F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), who, F.lit("\n\n"), "prompt", body).alias("text"))
