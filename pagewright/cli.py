"""Command line over the archive; settings come from a file named by --config, where there is one.

python -m pagewright.cli convert JOURNALS OUT [--corrections FILE] [--dry]
python -m pagewright.cli reconstruct JOURNALS OUT
python -m pagewright.cli build ENTRIES INDEX
python -m pagewright.cli search INDEX "words" [-k 5] [--year N | --year 0] [--trip T] [--mode vector|keyword|hybrid]
python -m pagewright.cli lookup INDEX TERM [--substring] [--year N] [--trip T]
python -m pagewright.cli ask INDEX "question" [-k 5]
python -m pagewright.cli evaluate INDEX QUESTIONS [--filter TEXT] [--save RUN] [--compare RUN] [--validate]
python -m pagewright.cli stage ENTRIES OUT
python -m pagewright.cli patterns ENTRIES OUT [--questions FILE]
python -m pagewright.cli transcript LOGS OUT
"""

from __future__ import annotations

import argparse
import json
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright import session
from pagewright.functions import text as T
from pagewright.operators import answer as A, chunking, entries as E, evaluate as X, index as I, media as M, privacy as P, retrieve as R, staging as G, transcript as L
from pagewright.sources import config, journals, lists, media as files, store
from pagewright.sources.lists import json_entries

DIM, MODEL = 64, "words-64"


def build(spark: SparkSession, entries: str, index: str, *more: str) -> str:
    """Chunk and embed the entries of JSON files whose wording the index lacks; returns the new version's path."""
    chunks = chunking.chunk_entries(json_entries(spark, entries, *more))
    held = store.latest(spark, index)
    hashed = chunks.withColumn("hash", T.content_hash(F.col("text"), MODEL))
    if held is None:
        return store.publish(I.embed(hashed, I.hashed_words(DIM)), index)
    fresh = I.embed(I.pending(chunks, held, MODEL), I.hashed_words(DIM))
    return store.publish(I.upsert(held, fresh, I.stale(chunks, held)), index)


def convert(spark: SparkSession, folder: str, out: str, corrections: str | None = None, dry: bool = False) -> DataFrame:
    """Journals of a folder to entries and a manifest under ``out``; the report, which alone is made when ``dry``."""
    lines = journals.read_lines(spark, folder)
    good, bad = lines.where("error IS NULL"), lines.where("error IS NOT NULL").select("file", F.col("error").alias("warning"))
    fixes = lists.corrections(spark, corrections)[0] if corrections else None
    made = session.cut(E.convert(good, files.days(spark, folder), fixes))
    if not dry:
        store.export_json(made.drop("idx"), f"{out}/entries")
        store.export_csv(E.manifest(made, E.file_warnings(good).unionByName(bad)), f"{out}/manifest")
    return E.conversion_report(made)


def reconstruct(spark: SparkSession, folder: str, out: str) -> int:
    """Entries of the folders that no journal links to, written apart from the others and sorted; how many."""
    days = files.days(spark, folder)
    linked = E.photo_lists(E.segment(journals.read_lines(spark, folder).where("error IS NULL")), days.select("path")).select(F.explode("photos.path").alias("path"))
    made = session.cut(M.reconstruct(M.orphans(days, linked)))
    store.export_json(made.orderBy("entry_date", "id"), f"{out}/reconstructed")
    return made.count()


def evaluate(spark: SparkSession, index: str, path: str, k: int = 10, needle: str | None = None, save: str | None = None, compare: str | None = None, check: bool = False) -> list[str]:
    """What there is to say of a question file's searches, line by line; a template is written where there is no file."""
    if lists.write_template(spark, path):
        return [f"created {path}: add questions, then run again"]
    rows, refused = lists.questions(spark, path)
    said = [f"line {r.line_no + 1} is no question: {r.line}" for r in refused.collect()]
    rows = session.cut(rows.select(F.col("line_no").cast("bigint").alias("q"), F.col("question").alias("query"), "expected", "wrong", "says"))
    chunks = store.latest(spark, index)
    if check:
        texts = chunks.select("entry_date", "text")
        return said + [f"{r.q + 1}: {r.problem} {r.value}" for r in X.validate(rows, texts).orderBy("q", "problem", "value").collect()]
    if needle:
        rows, note = X.filtered(rows, needle)
        kept = note.first()
        said.append(f"{kept.kept} of {kept.every} questions hold {needle!r}: rates are not comparable with those of all")
    embed = I.hashed_words(DIM)
    asked = spark.createDataFrame([(r.q, [float(x) for x in embed([r.query])[0]]) for r in rows.select("q", "query").collect()], "q bigint, qv array<float>").join(rows, "q")  # a hand-kept file
    hits = R.search(chunks, asked, k, DIM).join(chunks.select("chunk_id", "entry_id", "entry_date"), "chunk_id").withColumn("score", F.lit(0.0))
    scored = X.score_hits(hits, rows).join(rows.select("q", F.col("query").alias("question"), F.size("expected").alias("expected_n"), T.is_absent(F.col("expected")).alias("absent")), "q")
    scored = session.cut(scored)
    summary = X.summary(scored, k)
    said += [f"{name}: {value}" for name, value in summary.first().asDict().items()]
    if save:
        store.save_run(scored.select("question", "rank"), summary, save)
    if compare:
        before = spark.read.parquet(f"{compare}/results")
        changes = X.compare(before, scored.select("question", "rank"))
        for r in X.metric_deltas(spark.read.json(f"{compare}/summary"), summary, changes).collect():
            said.append(f"{r.metric}: {r.before:.2f} -> {r.after:.2f} {r.direction}{'' if r.comparable else ' (other questions, not comparable)'}")
        said += [f"{r.question}: {r.before} -> {r.after} {r.change}" for r in changes.where("change <> 'same'").orderBy("question").collect()]
    return said


def patterns(spark: SparkSession, entries: str, out: str, questions: str | None = None) -> DataFrame:
    """Names, days, phrases and words that tell of the archive, one sorted list of each under ``out``; how many of each."""
    rows = session.cut(json_entries(spark, entries))
    folders = rows.select(F.explode("photos.path").alias("path"))
    places = rows.select(F.col("trip").alias("place")).unionByName(folders.select(F.explode(F.split(M.folder_of(F.col("path")), "/")).alias("place")))
    made = P.names(places).select(F.lit("name").alias("kind"), "value").unionByName(P.dates(rows).select(F.lit("date").alias("kind"), "value"))
    if questions:
        asked = lists.private_questions(spark, questions)
        asked = asked.select("question", F.when(F.col("absent"), F.array(F.lit("NONE"))).otherwise(F.array().cast("array<string>")).alias("expected"), "says")
        made = made.unionByName(P.phrases(asked, rows))
    made = session.cut(made)
    store.save_patterns(made, out)
    return made.groupBy("kind").agg(F.count("*").alias("n"))


def quoting(_: str, text: str):
    """The generator without a model: an entry's first sentence as a statement that quotes itself."""
    first = " ".join((text or "").split(". ")[0].split())
    yield json.dumps({"statement": first, "evidence": first})


def one(spark: SparkSession, query: str, instruction: str = "") -> DataFrame:
    """A question as a row, with the vector of it and the instruction before it."""
    said = f"Instruct: {instruction}\nQuery: {query}" if instruction else query
    vector = [float(x) for x in I.hashed_words(DIM)([said])[0]]
    return spark.createDataFrame([(0, query, vector)], "q bigint, query string, qv array<float>")


def search(spark: SparkSession, index: str, query: str, k: int = 5, year: int | None = None, trip: str | None = None, mode: str = "vector", width: int = 160) -> DataFrame:
    """(rank, entry_date, chunk_id, rare, snippet). Without a year the one named in the query narrows; 0 does not."""
    named = re.search(r"\b(19[89]\d|20[0-4]\d)\b", query)
    year = int(named[1]) if year is None and named else year
    chunks, asked = R.narrowed(store.latest(spark, index), year, trip), one(spark, query)
    hits = R.search(chunks, asked, k, DIM, mode).join(chunks.select("chunk_id", "entry_date", "text", "header_len"), "chunk_id")
    return hits.select("rank", "entry_date", "chunk_id", "rare", T.snippet(width)("text", "header_len", F.lit(query)).alias("snippet")).orderBy("rank")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("what", choices=("convert", "reconstruct", "build", "search", "lookup", "ask", "evaluate", "stage", "patterns", "transcript"))
    parser.add_argument("where")
    parser.add_argument("words")
    parser.add_argument("-k", type=int)
    parser.add_argument("--year", type=int)
    parser.add_argument("--trip")
    for name in ("--corrections", "--filter", "--save", "--compare", "--questions", "--config"):
        parser.add_argument(name)
    parser.add_argument("--dry", action="store_true")
    parser.add_argument("--validate", action="store_true")
    parser.add_argument("--mode", choices=("vector", "keyword", "hybrid"))
    parser.add_argument("--substring", action="store_true")
    a = parser.parse_args(args)
    spark = session.build("pagewright")
    known = config.load(a.config) if a.config else config.Config()
    a.k, a.mode = a.k or known.retrieval.top_k, a.mode or known.retrieval.mode
    if a.what == "convert":
        for r in convert(spark, a.where, a.words, a.corrections, a.dry).orderBy("what", "kind").collect():
            print(f"{r.what:<9} {r.n:>9,} {r.kind}")
        return
    if a.what == "reconstruct":
        print(f"{reconstruct(spark, a.where, a.words)} entries")
        return
    if a.what == "evaluate":
        print("\n".join(evaluate(spark, a.where, a.words, a.k, a.filter, a.save, a.compare, a.validate)))
        return
    if a.what == "stage":
        staged = session.cut(G.stage(json_entries(spark, a.where), quoting))
        store.save_statements(staged, a.words)
        for r in G.reasons(staged).collect():
            print(f"{r.statements:>9,} {r.reason}")
        return
    if a.what == "patterns":
        for r in patterns(spark, a.where, a.words, a.questions).orderBy("kind").collect():
            print(f"{r.n:>9,} {r.kind}")
        return
    if a.what == "transcript":
        logs = session.cut(lists.session_logs(spark, a.where))
        made = L.render(L.turns(logs)).orderBy("project", "turn").select("text")
        made.coalesce(1).write.mode("overwrite").option("lineSep", "\n\n").text(a.words)  # one file to read, as the logs of one project are
        print(L.counts(logs).first().asDict())
        return
    if a.what == "build":
        print(build(spark, a.where, a.words))
        return
    if a.what == "lookup":
        found = R.lookup(R.narrowed(store.latest(spark, a.where), a.year, a.trip), a.words, whole=not a.substring)
        total = found.agg(F.count_distinct("entry_id").alias("e"), F.count("*").alias("c"), F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()
        for r in found.select("entry_date", "chunk_id", "count").toLocalIterator():
            print(r.entry_date, r.chunk_id, r["count"])
        print(f"{total.e} entries, {total.c} chunks, {total.n} occurrences")
        return
    if a.what == "search":
        for r in search(spark, a.where, a.words, a.k, a.year, a.trip, a.mode).collect():  # k rows
            print(f"{r['rank']}. {r.entry_date} {r.chunk_id}{' (rare term)' if r.rare else ''}\n   {r.snippet}")
        if one(spark, a.words).select(T.is_short_query(F.col("query")).alias("s")).first().s:
            print("A short query: lookup lists every place the term stands.")
        return
    made = A.ask(store.latest(spark, a.where), one(spark, a.words, known.embedding.instruction), A.first_sentences, a.k, DIM).first()
    print(made.answer)


if __name__ == "__main__":
    main()
