"""Hand-kept text files: questions, corrections, session logs, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from pagewright.functions.text import quoted_list
from pagewright.session import cut

ENTRY = (
    "id string, source_file string, trip string, entry_date string, month_day string, text string, "
    "photos array<struct<path:string,source:string,resolved:string>>, chars int, warnings array<string>"
)
TEMPLATE = "# question | expected, expected | NOT wrong, wrong | SAYS phrase, \"a phrase, with commas\"\n# an expected value is a date, an entry id or a chunk id, or NONE where it never happened\n"


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) in the file's order; such files are small and read as one row each."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).select("line_no", F.trim("line").alias("line"))


def _items(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions, refused lines) of lines "question | expected | NOT wrong | SAYS said", the last two in any order.

    Blank lines and comments (# or //) are passed over; a line without a bar or
    without expected values is refused.
    """
    rows = _numbered(spark, path).where((F.col("line") != "") & ~F.col("line").rlike("^(#|//)"))
    parts = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    rows = rows.withColumn("p", parts)
    later = F.slice("p", F.lit(3), F.greatest(F.size("p") - 2, F.lit(0)))
    field = lambda word: F.regexp_replace(F.try_element_at(F.filter(later, lambda x: F.upper(x).rlike(rf"^{word}\b")), F.lit(1)), rf"(?i)^{word}\s*:?\s*", "")
    none = F.array().cast("array<string>")
    made = rows.select(
        "line_no", "line", F.col("p")[0].alias("question"), F.coalesce(_items(F.try_element_at("p", F.lit(2))), none).alias("expected"),
        F.coalesce(_items(field("NOT")), none).alias("wrong"), F.coalesce(quoted_list(field("SAYS")), none).alias("says"),
    )
    good = (F.size("expected") > 0) & (F.col("question") != "")
    return made.where(good).drop("line"), made.where(~good).select("line_no", "line")


def private_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question, absent, says) of every line of a question file that is neither blank nor a comment, with or without expected values.

    Commas part what is said and quotes are trimmed, whatever they protect: for lists of
    what to keep out of sight, where every part counts.
    """
    rows = _numbered(spark, path).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    parts = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    rows = rows.select("line_no", parts.alias("p"))
    said = F.filter(F.slice("p", F.lit(3), F.greatest(F.size("p") - 2, F.lit(0))), lambda x: F.startswith(F.upper(x), F.lit("SAYS")))
    body = F.regexp_replace(F.try_element_at(said, F.lit(-1)), r"^.{4}[: ]*", "")
    values = F.transform(_items(body), lambda x: F.btrim(x, F.lit('"')))
    absent = F.coalesce(F.upper(F.try_element_at("p", F.lit(2))) == "NONE", F.lit(False))
    return rows.select(F.col("p")[0].alias("question"), absent.alias("absent"), F.coalesce(values, F.array().cast("array<string>")).alias("says"))


def write_template(spark: SparkSession, path: str) -> bool:
    """Write a question file to begin with, unless there is one; whether it was written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(at):
        return False
    system.setWriteChecksum(False)  # the file is for editing by hand, which a checksum beside it would call damage
    try:
        out = system.create(at, False)
        out.write(bytearray(TEMPLATE.encode()))
        out.close()
    finally:
        system.setWriteChecksum(True)
    return True


def corrections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entry_id, entry_date) of lines "id: YYYY-MM-DD", the last of an id holding, and malformed lines.

    // opens a comment line and #! a comment; # alone does not, as ids hold it.
    """
    bare = F.trim(F.regexp_replace("line", "#!.*$", ""))
    rows = _numbered(spark, path).select("line_no", bare.alias("line")).where((F.col("line") != "") & ~F.startswith("line", F.lit("//")))
    pattern = r"^(\S.*?)\s*:\s*(\d{4}-\d{2}-\d{2})$"
    good = rows.where(F.col("line").rlike(pattern)).select("line_no", F.regexp_extract("line", pattern, 1).alias("entry_id"), F.regexp_extract("line", pattern, 2).alias("entry_date"))
    return good.groupBy("entry_id").agg(F.max_by("entry_date", "line_no").alias("entry_date")), rows.where(~F.col("line").rlike(pattern))


def session_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Log events of all .jsonl files: (log_file, written, line_no, type, message{role, content}); unreadable lines have null types.

    Content is kept as text, be it a string or a list of blocks.
    """
    # a long log is read in blocks of bytes; line numbers follow from the blocks' order, not from the file as one row
    read_lines = spark.read.option("pathGlobFilter", "*.jsonl").text(folder)
    meta = F.col("_metadata")
    rows = read_lines.select(
        meta["file_name"].alias("log_file"), meta["file_modification_time"].alias("written"), meta["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"),
    )
    rows = cut(rows)
    sizes = rows.groupBy("log_file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    order = W.partitionBy("log_file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("log_file", "block", "first", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    numbered = rows.join(sizes, ["log_file", "block"]).withColumn("line_no", (F.col("before") + F.col("row") - F.col("first")).cast("int"))
    lines = numbered.where(F.trim("line") != "")
    read = F.get_json_object
    return lines.select(
        "log_file", "written", (F.col("line_no") + 1).alias("line_no"), F.when(F.try_parse_json("line").isNotNull(), read("line", "$.type")).alias("type"),
        F.struct(read("line", "$.message.role").alias("role"), read("line", "$.message.content").alias("content")).alias("message"),
    )


def json_entries(spark: SparkSession, path: str, *more: str) -> DataFrame:
    """Entries of JSON lines, with those of other such files that exist."""
    from pagewright.sources.store import exists

    rows = spark.read.schema(ENTRY).json(path)
    for other in more:
        if exists(spark, other):
            rows = rows.unionByName(spark.read.schema(ENTRY).json(other), allowMissingColumns=True)
    return rows
