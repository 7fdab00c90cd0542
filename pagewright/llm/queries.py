"""Queries of the training-data operators, with their SQL where it can be."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.llm.containers import CAPACITY, pack_containers, token_counts
from pagewright.llm.conversations import rebuild_conversations
from pagewright.llm.leaks import SHARE, find_leaks
from pagewright.llm.neighbours import most_similar
from pagewright.llm.pairs import defects
from pagewright.llm.personal import collisions, mentions, redacted, secret_of
from pagewright.llm.sentences import sentences
from pagewright.llm.splitting import LIMIT, split_oversized
from pagewright.operators.transcript import INJECTED
from pagewright.plans import Query, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Entries over the limit and the boundary they were cut at; a section end is a paragraph end."""
    entries = table(spark, folder, "entries").select("id", "text").where(F.length("text") > LIMIT)
    cut = F.when(F.col("cut_at") == "section", "paragraph").otherwise(F.col("cut_at"))
    return (
        split_oversized(entries, "id", "text", with_text=False)
        .where((F.col("chunk_index") == 0) & F.col("cut_at").isNotNull())
        .select(F.col("id").alias("entry_id"), cut.alias("cut_at"))
        .distinct()
    )


def p1_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of every entry, repeated rows of one entry taken once."""
    entries = table(spark, folder, "entries").groupBy("id").agg(F.min_by("text", "loaded_at").alias("text"))
    return split_oversized(entries, "id", "text").withColumnRenamed("id", "entry_id")


#: Numbers in a chunk's vector.
DIM = 64


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks with a cosine of 0.85 or more, one among the 5 most similar of the other."""
    found = most_similar(table(spark, folder, "chunks"), "chunk_id", "vector", dim=DIM, minimum=0.85)
    return found.select(
        F.least("chunk_id", "neighbour").alias("chunk_a"), F.greatest("chunk_id", "neighbour").alias("chunk_b")
    ).distinct()


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 other chunks most similar to every chunk with a usable vector, however far."""
    return most_similar(table(spark, folder, "chunks"), "chunk_id", "vector", dim=DIM, route=0.025)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions of personal information in entries."""
    found = mentions(table(spark, folder, "entries"), "id", "text")
    return found.select(F.col("id").alias("entry_id"), "pii_type", "value").distinct()


def p3_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Entries with every mention replaced by a typed placeholder."""
    entries = table(spark, folder, "entries").groupBy("id").agg(F.min_by("text", "loaded_at").alias("text"))
    return redacted(entries, "id", "text", secret=secret_of(spark))


def p3_collisions(spark: SparkSession, folder: str) -> DataFrame:
    """Surrogates that stand for two different values anywhere, and values of two surrogates."""
    return collisions(mentions(table(spark, folder, "entries"), "id", "text", secret=secret_of(spark)))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Broken question and answer pairs with their defect."""
    return defects(table(spark, folder, "gen_results"), "gen_id").distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The spoken messages of every kept session."""
    return rebuild_conversations(table(spark, folder, "log_events"), with_text=False).select("session_id", "pos", "uuid")


def p6_by_clocks(spark: SparkSession, folder: str) -> DataFrame:
    """The messages in order of corrected times alone, files merged where they overlap, without sessions whose clocks are infeasible."""
    found = rebuild_conversations(table(spark, folder, "log_events"), files_follow=False, reject_infeasible=True, with_text=False)
    return found.select("session_id", "pos", "uuid")


def p6_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """One row per kept session: messages, clock offset feasibility and span of corrected times."""
    return (
        rebuild_conversations(table(spark, folder, "log_events"), with_text=False)
        .groupBy("session_id")
        .agg(
            F.count("*").alias("messages"),
            F.count_if(F.col("speaker") == "user").alias("questions"),
            F.min("feasible").alias("feasible"),
            F.min("corrected_ts").alias("began"),
            F.max("corrected_ts").alias("ended"),
        )
    )


#: The vocabulary file that documents are sized with.
VOCABULARY = os.environ.get("PAGEWRIGHT_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def p7_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, or of its pieces where it is larger than one."""
    sizes = token_counts(table(spark, folder, "documents"), "doc_id", "text", VOCABULARY)
    return pack_containers(sizes, "doc_id", "tokens", CAPACITY)


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every container with what it holds and the room left."""
    return (
        p7_assignment(spark, folder)
        .where(F.col("container_id").isNotNull())
        .groupBy("container_id")
        .agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), (F.lit(CAPACITY) - F.sum("tokens")).alias("unused"))
    )


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the items they hold or re-parameterise, and how much of them."""
    return find_leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least half of an item's words."""
    return p8_leaks(spark, folder).where(F.col("held") >= SHARE).select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of every document; doc_id is unique, so the rows are distinct."""
    return sentences(table(spark, folder, "documents"), "doc_id", "text")


_INJECTED_SQL = " OR ".join("contains(substr(text, 1, 200), '" + m.replace("'", "''") + "')" for m in INJECTED)

P6_SQL = rf"""
WITH l AS (
  SELECT DISTINCT log_file, line_no, session_id, ts, uuid,
         CASE WHEN lower(trim(coalesce(type, message.role))) IN ('user', 'human') THEN 'user'
              WHEN lower(trim(coalesce(type, message.role))) = 'assistant' THEN 'assistant' END AS speaker,
         message.content AS content,
         regexp_matches(coalesce(message.content, ''), '^\s*\[\s*(\{{|\]|$)') AS listed
  FROM log_events
), f AS (
  SELECT log_file, max(session_id) AS session, min(ts) AS started, count(DISTINCT line_no) < max(line_no) AS gap
  FROM l GROUP BY log_file
), t AS (
  SELECT f.session, f.started, f.gap, l.log_file, l.line_no, l.uuid, l.speaker, l.listed AND NOT json_valid(l.content) AS unreadable,
         CASE WHEN l.listed AND json_valid(l.content)
              THEN array_to_string(list_transform(list_filter(CAST(l.content AS JSON[]), lambda b: b->>'type' = 'text'), lambda b: b->>'text'), chr(10))
              WHEN NOT l.listed THEN l.content END AS raw
  FROM l JOIN f USING (log_file) WHERE f.session IS NOT NULL
), s AS (
  SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM t
), m AS (
  SELECT * FROM s WHERE speaker IS NOT NULL AND text <> '' AND NOT (speaker = 'user' AND ({_INJECTED_SQL}))
  QUALIFY row_number() OVER (PARTITION BY session, uuid ORDER BY started, log_file, line_no) = 1
), o AS (
  SELECT session, uuid, speaker, row_number() OVER w AS pos, lead(speaker) OVER w AS after
  FROM m WINDOW w AS (PARTITION BY session ORDER BY started, log_file, line_no)
), bad AS (
  SELECT session FROM s WHERE gap OR unreadable
  UNION SELECT session FROM o WHERE (pos = 1 AND speaker = 'assistant') OR (speaker = 'user' AND coalesce(after, 'user') = 'user')
)
SELECT session AS session_id, CAST(pos AS INTEGER) AS pos, uuid FROM o WHERE session NOT IN (SELECT session FROM bad)
"""

QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_chunks": p1_chunks,
    "p2_found": p2_found,
    "p2_neighbours": p2_neighbours,
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p3_collisions": p3_collisions,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_by_clocks": p6_by_clocks,
    "p6_conversations": p6_conversations,
    "p7_assignment": p7_assignment,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_found": p9_found,
}
SQL: dict[str, str] = {"p6_found": P6_SQL}
