"""Answers from retrieved excerpts: a budgeted context, a pluggable generator, and how much was covered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from pagewright.functions import text as T
from pagewright.operators import retrieve as R

#: (question, prompt) -> pieces of the answer, as they come
Generator = Callable[[str, str], Iterator[str]]

PROMPT = """You answer from a personal journal. Use the excerpts below and nothing else.
Each excerpt opens with its day in brackets. Name the day of everything you state.
If several days fit, give each of them. If the excerpts disagree, say so.
Do not guess names, places or numbers that are not there, and do not join events of
different days into one. Quote sparingly. Keep to what was asked.
If the excerpts do not answer the question, reply: I can't find that in the journals.

{context}

Question: {question}
Answer:"""


def budget(window: int, prompt: int, question: int) -> int:
    """Characters that excerpts may take of a window of tokens."""
    return max(window * 4 - prompt - question - 2000, 2000)


def context(hits: DataFrame, limit: int) -> DataFrame:
    """(q, context, kept) of hits (q, rank, entry_date, text): whole excerpts in order, up to the first that would exceed the limit; always one."""
    block = F.concat(F.lit("["), F.coalesce("entry_date", F.lit("None")), F.lit("] "), F.coalesce("text", F.lit("")))
    order = W.partitionBy("q").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    sized = hits.withColumn("_b", block).withColumn("_sum", F.sum(F.length("_b")).over(order))
    first = F.row_number().over(W.partitionBy("q").orderBy("rank"))
    kept = sized.withColumn("_at", first).where((F.col("_at") == 1) | (F.col("_sum") <= limit))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "_b"))), lambda p: p["_b"])
    return kept.groupBy("q").agg(F.array_join(parts, "\n\n").alias("context"), F.count("*").alias("kept"))


def first_sentences(question: str, prompt: str) -> Iterator[str]:
    """A generator without a model: the first excerpt's opening, with its day; it claims no quality."""
    body = prompt.split("\n\n[", 1)
    if len(body) < 2:
        yield "I can't find that in the journals."
        return
    day, rest = body[1].split("] ", 1)
    yield f"{rest.split('. ')[0].strip()}. "
    yield f"({day})"


def generate(asked: DataFrame, generator: Generator) -> DataFrame:
    """(q, query, context, answer) of rows (q, query, context); without context the canned refusal stands.

    A generator that returns nothing for a context is an error, not an answer.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = []
            for q, c in zip(frame["query"], frame["context"]):
                if not c:
                    said.append("I can't find that in the journals.")
                    continue
                text = "".join(generator(q, PROMPT.format(context=c, question=q)))
                if not text.strip():
                    raise RuntimeError("the generator returned no text")
                said.append(text)
            yield frame.assign(answer=said)

    kind = asked.schema["q"].dataType.simpleString()
    return asked.select("q", "query", "context").mapInPandas(run, f"q {kind}, query string, context string, answer string")


def ask(chunks: DataFrame, questions: DataFrame, generator: Generator, k: int, dim: int, window: int = 8192, **how) -> DataFrame:
    """(q, query, context, answer, refused, cited) of every question: searched, packed into a context and answered.

    A year named in a question narrows its search.
    """
    hits = R.search_by_year(chunks, questions, k, dim, **how).join(chunks.select("chunk_id", "entry_date", "text"), "chunk_id")
    made = questions.select("q", "query").join(context(hits, budget(window, len(PROMPT), 200)), "q", "left")
    said = generate(made, generator)
    return said.withColumns({"refused": T.is_refusal(F.col("answer")), "cited": T.citations(F.col("answer"))})


def coverage(chunks: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(q, term, entries, cited): answers (q, kept, cited) that used fewer excerpts than entries hold their rarest term."""
    rarest = R.literal_coverage(chunks, questions).join(answers, "q").where(F.col("entries") > F.col("kept"))
    held = R.literal_counts(chunks, "chunk_id", "text", [r.term for r in rarest.select("term").distinct().toLocalIterator()])
    days = held.join(chunks.select("chunk_id", "entry_date"), "chunk_id").select("term", "entry_date").distinct()
    cited = rarest.select("q", "term", F.explode(F.array_distinct("cited")).alias("entry_date")).join(days, ["term", "entry_date"]).groupBy("q").agg(F.count("*").alias("n"))
    return rarest.join(cited, "q", "left").select("q", "term", "entries", F.coalesce("n", F.lit(0)).alias("cited"))
