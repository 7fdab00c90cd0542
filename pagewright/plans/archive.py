"""Queries of text, date, entry, media and chunk operators over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewright.functions import dates as D, text as T
from pagewright.operators import chunking, entries as E, index as I, media as M
from pagewright.plans import Query, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MODEL = "words-64"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def entries(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """The columns of entries, repeated rows of one entry taken once."""
    return table(s, d, "entries").select("id", *columns).distinct()


def first_loaded(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """The row of each entry that was loaded first."""
    row = F.struct(*columns)
    return table(s, d, "entries").groupBy("id").agg(F.min_by(row, "loaded_at").alias("r")).select("id", "r.*")


def chunks(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(s, d, "chunks").select("chunk_id", *columns).distinct()


_FIRST = "(SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"
_MONTHS = D.MONTHS
_DATE = D.DATE_LINE.replace("'", "''")
_ABBR = "['" + "','".join(D.ABBREVIATIONS) + "']"
_LINES = "(SELECT trim(unnest(string_split(text, chr(10)))) AS line FROM documents)"


def lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).select(F.trim("line").alias("line"))


@query(f"""
SELECT month, day, year, count(*) AS lines FROM (
  SELECT CAST(list_position({_ABBR}, lower(substr(regexp_extract(line, '{_DATE}', 1), 1, 3))) AS INTEGER) AS month,
         TRY_CAST(regexp_extract(line, '{_DATE}', 2) AS INTEGER) AS day, TRY_CAST(nullif(regexp_extract(line, '{_DATE}', 3), '') AS INTEGER) AS year
  FROM {_LINES} WHERE regexp_matches(line, '{_DATE}'))
WHERE day BETWEEN 1 AND 31 AND (year IS NULL OR year BETWEEN 1900 AND 2100) GROUP BY ALL""")
def date_lines(s: SparkSession, d: str) -> DataFrame:
    date = D.parse_date_line(F.col("line"))
    return lines(s, d).select(date.alias("d")).where("d IS NOT NULL").groupBy("d.month", "d.day", "d.year").agg(F.count("*").alias("lines"))


@query(rf"""
SELECT count(*) FILTER (regexp_matches(line, '{D.NEAR}') AND NOT regexp_matches(line, '{_DATE}')) AS near_misses,
       count(*) FILTER (regexp_matches(line, '{D.MONTH_WORD[:-2]}(?:[^\p{{L}}\p{{N}}_]|$)') AND NOT regexp_matches(line, '{D.NEAR}')) AS month_words FROM {_LINES}""")
def near_dates(s: SparkSession, d: str) -> DataFrame:
    line = F.col("line")
    return lines(s, d).agg(F.count_if(line.rlike(D.NEAR) & ~line.rlike(D.DATE_LINE)).alias("near_misses"), F.count_if(D.is_month_word(line)).alias("month_words"))


@query(r"""
SELECT DISTINCT source_file, CASE WHEN regexp_matches(stem, '^(.*\S)\s*-\s*([0-9]{4})\s*$') THEN trim(regexp_extract(stem, '^(.*\S)\s*-\s*([0-9]{4})\s*$', 1)) ELSE stem END AS trip,
  TRY_CAST(nullif(regexp_extract(stem, '^(.*\S)\s*-\s*([0-9]{4})\s*$', 2), '') AS INTEGER) AS year,
  trim(regexp_replace(lower(stem), '[^a-z0-9]+', '-', 'g'), '-') AS slug
FROM (SELECT source_file, regexp_replace(source_file, '\.[^.]*$', '') AS stem FROM entries)""")
def file_names(s: SparkSession, d: str) -> DataFrame:
    name = D.file_trip(F.col("source_file"))
    return table(s, d, "entries").select("source_file").distinct().select(
        "source_file", name["trip"].alias("trip"), name["year"].alias("year"), T.slug(F.regexp_replace("source_file", r"\.[^.]*$", "")).alias("slug")
    )


@query("""
SELECT DISTINCT id, entry_date, strftime(least(last_day(TRY_CAST(substr(entry_date, 1, 7) || '-01' AS DATE)),
  TRY_CAST(substr(entry_date, 1, 7) || '-01' AS DATE) + (CAST(substr(entry_date, 9, 2) AS INTEGER) - 1)), '%Y-%m-%d') AS suggested
FROM entries WHERE regexp_matches(entry_date, '^\\d{4}-\\d{2}-\\d{2}$') AND TRY_CAST(entry_date AS DATE) IS NULL AND TRY_CAST(substr(entry_date, 1, 7) || '-01' AS DATE) IS NOT NULL
""".replace("\\\\", "\\"))
def invalid_dates(s: SparkSession, d: str) -> DataFrame:
    return entries(s, d, "entry_date").select("id", "entry_date", D.nearest_valid(F.col("entry_date")).alias("suggested")).where("suggested IS NOT NULL")


@query(r"""
SELECT DISTINCT id, md5(trim(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), chr(10)),
  '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS digest FROM entries WHERE text IS NOT NULL""")
def normalised_texts(s: SparkSession, d: str) -> DataFrame:
    return entries(s, d, "text").where("text IS NOT NULL").select("id", F.md5(T.normalise(F.col("text"))).alias("digest"))


_REF = T.PHOTO_REF.replace("'", "''")


@query(rf"""
SELECT id, md5(regexp_replace(regexp_replace(regexp_replace(text, '{_REF}', ' ', 'g'), '\s*\(\s*\)', '', 'g'), '\s+([,.;:!?])', '\1', 'g')) AS digest,
  len(regexp_extract_all(text, '{_REF}')) AS refs FROM (SELECT DISTINCT id, text || ' (2020\place\' || id || '.jpg, other.png).' AS text FROM entries) WHERE text IS NOT NULL""")
def photo_references(s: SparkSession, d: str) -> DataFrame:
    clean = T.strip_photo_refs(F.col("text"))
    rows = entries(s, d, "text").where("text IS NOT NULL").withColumn("text", F.concat("text", F.lit(" (2020\\place\\"), "id", F.lit(".jpg, other.png).")))
    return rows.select("id", F.md5(clean["text"]).alias("digest"), F.size(clean["refs"]).cast("bigint").alias("refs"))


_PHOTOS = "(SELECT DISTINCT id, source_file, unnest(photos).path AS path, unnest(photos).resolved AS resolved FROM entries)"


def photos(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "entries").select("id", "source_file", F.explode("photos").alias("p")).select("id", "source_file", "p.path", "p.resolved").distinct()


@query(rf"""
SELECT DISTINCT written, array_to_string(list_filter(string_split_regex(replace(replace(written, 'file:///', ''), 'file://', ''), '[\\/]+'),
  lambda p: p <> '' AND p NOT IN ('.', '..') AND NOT p LIKE '%:')[-3:], '/') AS path
FROM (SELECT 'file:///C:\archive\.\' || replace(path, '/', '\') AS written FROM {_PHOTOS} UNION ALL SELECT '../pictures/' || path FROM {_PHOTOS})""")
def path_shapes(s: SparkSession, d: str) -> DataFrame:
    paths = photos(s, d).select("path").distinct()
    written = paths.select(F.concat(F.lit("file:///C:\\archive\\.\\"), F.replace("path", F.lit("/"), F.lit("\\"))).alias("written"))
    written = written.unionAll(paths.select(F.concat(F.lit("../pictures/"), "path")))
    return written.select("written", T.normalise_path(F.col("written")).alias("path"))


_WRITTEN = """CASE resolved WHEN 'year_prefix' THEN regexp_replace(path, '^\\d{4}/', '') WHEN 'basename' THEN 'pictures/' || regexp_extract(path, '[^/]*$')
  WHEN 'place_tail' THEN 'old/' || regexp_replace(path, '^\\d{4}/', '') WHEN 'dash_fix' THEN replace(path, '_', chr(8211)) ELSE path END""".replace("\\\\", "\\")


def written_links(s: SparkSession, d: str) -> DataFrame:
    bare = F.regexp_replace("path", r"^\d{4}/", "")
    written = (
        F.when(F.col("resolved") == "year_prefix", bare)
        .when(F.col("resolved") == "basename", F.concat(F.lit("pictures/"), F.regexp_extract("path", "[^/]*$", 0)))
        .when(F.col("resolved") == "place_tail", F.concat(F.lit("old/"), bare))
        .when(F.col("resolved") == "dash_fix", F.replace("path", F.lit("_"), F.lit("–")))
        .otherwise(F.col("path"))
    )
    return photos(s, d).select(written.alias("path"), F.regexp_extract("path", r"^(\d{4})/", 1).try_cast("int").alias("year")).distinct()


def media_files(s: SparkSession, d: str) -> DataFrame:
    return photos(s, d).where(F.col("resolved").isin("exact", "year_prefix", "basename", "place_tail")).select("path").distinct()


_LOOK = """
  SELECT l.path AS w, l.year AS y, CASE WHEN e.path IS NOT NULL THEN l.p WHEN ye.path IS NOT NULL THEN l.dated WHEN t.n = 1 THEN t.hit WHEN b.n = 1 THEN b.hit END AS hit,
    CASE WHEN e.path IS NOT NULL THEN 'exact' WHEN ye.path IS NOT NULL THEN 'year_prefix' WHEN t.n = 1 THEN 'place_tail' WHEN b.n = 1 THEN 'basename' END AS how, coalesce(b.n, 0) > 1 AS many
  FROM (SELECT path, year, {p} AS p, CASE WHEN len(string_split({p}, '/')) = 2 AND year <> 0 THEN year || '/' || {p} END AS dated FROM links) l
  LEFT JOIN media e ON e.path = l.p LEFT JOIN media ye ON ye.path = l.dated
  LEFT JOIN tails t ON t.key = lower(array_to_string(string_split(l.p, '/')[-2:], '/')) AND len(string_split(l.p, '/')) >= 2
  LEFT JOIN names b ON b.key = lower(string_split(l.p, '/')[-1])"""


@query(f"""
WITH links AS (SELECT DISTINCT {_WRITTEN} AS path, TRY_CAST(nullif(regexp_extract(path, '^(\\d{{4}})/', 1), '') AS INTEGER) AS year FROM {_PHOTOS}),
media AS (SELECT DISTINCT path FROM {_PHOTOS} WHERE resolved IN ('exact', 'year_prefix', 'basename', 'place_tail')),
tails AS (SELECT lower(array_to_string(string_split(path, '/')[-2:], '/')) AS key, count(*) AS n, min(path) AS hit FROM media GROUP BY 1),
names AS (SELECT lower(string_split(path, '/')[-1]) AS key, count(*) AS n, min(path) AS hit FROM media GROUP BY 1),
a AS ({_LOOK.format(p="path")}), b AS ({_LOOK.format(p="replace(replace(path, chr(8211), '-'), chr(8212), '-')")})
SELECT a.w AS path, a.y AS year, coalesce(a.hit, CASE WHEN replace(replace(a.w, chr(8211), '-'), chr(8212), '-') <> a.w THEN b.hit END, a.w) AS resolved,
  coalesce(a.how, CASE WHEN replace(replace(a.w, chr(8211), '-'), chr(8212), '-') <> a.w AND b.hit IS NOT NULL THEN 'dash_fix' END, CASE WHEN a.many THEN 'ambiguous' ELSE 'missing' END) AS how
FROM a JOIN b ON a.w = b.w AND a.y IS NOT DISTINCT FROM b.y""")
def media_resolve(s: SparkSession, d: str) -> DataFrame:
    return M.resolve(written_links(s, d), media_files(s, d))


_TS = "strftime(ts, '%Y%m%d_%H%M%S')"


def dated_files(s: SparkSession, d: str) -> DataFrame:
    """Media files named after the events of the stream: folder by type, name by time, with their day."""
    stamp = F.date_format("ts", "yyyyMMdd_HHmmss")
    path = F.concat(F.lit("2024/"), "event_type", F.lit("/"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("walk-"), stamp)).otherwise(stamp), F.lit(".jpg"))
    files = table(s, d, "events").select(path.alias("path")).distinct()
    return files.withColumn("date", D.file_date(F.element_at(F.split("path", "/"), -1)))


_FILES = f"""(SELECT DISTINCT '2024/' || event_type || '/' || CASE WHEN event_id % 3 = 0 THEN 'walk-' ELSE '' END || {_TS} || '.jpg' AS path, strftime(ts, '%Y-%m-%d') AS date FROM events)"""


@query(f"SELECT date, count(*) AS files FROM {_FILES} GROUP BY 1")
def photo_dates(s: SparkSession, d: str) -> DataFrame:
    return dated_files(s, d).groupBy("date").agg(F.count("*").alias("files"))


@query(f"SELECT DISTINCT string_split(path, '/')[-1] AS name, CASE WHEN path LIKE '%walk-%' THEN 'walk-' || regexp_extract(path, '(\\d{{8}})_', 1) END AS caption FROM {_FILES}")
def captions(s: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return dated_files(s, d).select(name.alias("name")).distinct().select("name", T.caption(F.col("name")).alias("caption"))


def _orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file"), F.col("o_orderkey").alias("line_no"),
        F.month("o_orderdate").alias("month"), F.dayofmonth("o_orderdate").alias("day"),
        F.when(F.col("o_orderkey") % 11 == 0, F.year("o_orderdate")).alias("inline_year"),
        F.when(F.col("o_custkey") % 5 > 0, F.lit(1995) + F.col("o_custkey") % 7).cast("int").alias("base_year"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
    )


_ORDERS = """(SELECT 'c' || o_custkey AS file, o_orderkey AS line_no, month(o_orderdate) AS month, day(o_orderdate) AS day,
  CASE WHEN o_orderkey % 11 = 0 THEN year(o_orderdate) END AS inline_year, CASE WHEN o_custkey % 5 > 0 THEN 1995 + o_custkey % 7 END AS base_year, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders)"""


@query(f"""
WITH a AS (SELECT *, lag(month) OVER w AS pm, count(inline_year) OVER (w ROWS UNBOUNDED PRECEDING) AS seg FROM {_ORDERS} WINDOW w AS (PARTITION BY file ORDER BY line_no)),
b AS (SELECT *, coalesce(pm >= 11 AND month <= 2 AND inline_year IS NULL, false) AS turn, max(inline_year) OVER (PARTITION BY file, seg) AS sy FROM a),
c AS (SELECT *, sum(turn::INT) OVER (PARTITION BY file, seg ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS n, coalesce(sy, base_year) AS start FROM b)
SELECT file, line_no, CAST(start + CASE WHEN base_year IS NULL THEN n ELSE least(n, greatest(base_year + 1 - start, 0)) END AS INTEGER) AS year,
  CASE WHEN inline_year IS NOT NULL THEN 'year_from_entry' WHEN turn AND start IS NOT NULL AND (base_year IS NULL OR n <= greatest(base_year + 1 - start, 0)) THEN 'year_rollover'
       WHEN month < pm AND start IS NOT NULL THEN 'out_of_order' END AS warning FROM c""")
def year_rollover(s: SparkSession, d: str) -> DataFrame:
    return E.rollover(_orders(s, d), "file", "line_no", "month", "inline_year", "base_year").select("file", "line_no", "year", F.try_element_at("year_warnings", F.lit(1)).alias("warning"))


@query(f"""
WITH v AS (SELECT file, line_no, date AS d, lag(date, 1) OVER w AS p, lag(date, 2) OVER w AS b, lead(date) OVER w AS a FROM {_ORDERS} WINDOW w AS (PARTITION BY file ORDER BY line_no)),
j AS (SELECT *, (b IS NULL OR b <= p) AND (a IS NULL OR p <= a) AS cur, substr(p, 1, 8) || substr(d, 9) AS pd, substr(d, 1, 8) || substr(p, 9) AS dp FROM v),
k AS (SELECT file, line_no, CASE WHEN d = p THEN 'duplicate_date' WHEN d < p AND cur THEN 'date_out_of_sequence' ||
        CASE WHEN pd <> d AND p < pd AND (a IS NULL OR pd < a) THEN ';suspect_month_typo:' || pd ELSE '' END ELSE '' END AS own,
      CASE WHEN d < p AND NOT cur THEN 'date_out_of_sequence' || CASE WHEN dp <> p AND (b IS NULL OR b < dp) AND dp < d THEN ';suspect_month_typo:' || dp ELSE '' END ELSE '' END AS given FROM j)
SELECT * FROM (SELECT file, line_no, trim(own || ';' || coalesce(lead(given) OVER (PARTITION BY file ORDER BY line_no), ''), ';') AS flags FROM k) WHERE flags <> ''""")
def chronology_flags(s: SparkSession, d: str) -> DataFrame:
    return E.chronology(_orders(s, d), "file", "line_no", "date").select("file", "line_no", F.array_join("chronology", ";").alias("flags"))


@query(f"""
SELECT id, CASE WHEN fix THEN month_date ELSE entry_date END AS entry_date, CASE WHEN fix THEN array_to_string(list_append(list_filter(warnings,
  lambda w: NOT regexp_matches(w, '^(?:date_out_of_sequence|suspect_month_typo|duplicate_date)')), 'date_corrected:from=' || coalesce(entry_date, 'none')), ';')
  ELSE array_to_string(warnings, ';') END AS warnings
FROM (SELECT *, list_contains(warnings, 'date_out_of_sequence') OR list_contains(warnings, 'duplicate_date') AS fix, '2000-' || month_day AS month_date FROM {_FIRST})""")
def corrections_applied(s: SparkSession, d: str) -> DataFrame:
    rows = first_loaded(s, d, "entry_date", "month_day", "warnings")
    fix = rows.where(F.array_contains("warnings", "date_out_of_sequence") | F.array_contains("warnings", "duplicate_date"))
    fix = fix.select(F.col("id").alias("entry_id"), F.concat(F.lit("2000-"), "month_day").alias("entry_date"))
    return E.apply_corrections(rows, fix)[0].select("id", "entry_date", F.array_join("warnings", ";").alias("warnings"))


@query(f"SELECT split_part(w, ':', 1) AS warning, count(*) AS entries FROM (SELECT unnest(warnings) AS w FROM {_FIRST}) GROUP BY 1")
def warning_counts(s: SparkSession, d: str) -> DataFrame:
    return E.warning_counts(first_loaded(s, d, "warnings"))


@query(f"SELECT source_file, count(*) AS entries, sum(len(photos)) AS photos, CASE WHEN regexp_matches(source_file, '- \\d{{4}}\\s*(\\.|$)') THEN '' ELSE 'no_year_in_filename' END AS file_warnings FROM {_FIRST} GROUP BY 1")
def manifest(s: SparkSession, d: str) -> DataFrame:
    rows = first_loaded(s, d, "source_file", "photos")
    year = D.file_trip(F.col("file"))["year"]
    said = rows.select(F.col("source_file").alias("file")).distinct().where(year.isNull()).select("file", F.lit("no_year_in_filename").alias("warning"))
    return E.manifest(rows, said)


_SIZES = "count(*) AS n, min(s) AS least, list_sort(list(s))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS middle, list_sort(list(s))[least(CAST(floor(count(*) * 0.9) AS BIGINT), count(*) - 1) + 1] AS ninety, max(s) AS greatest"


@query(f"SELECT {_SIZES}, count(*) FILTER (s > 2000) AS over FROM (SELECT CAST(length(text) AS BIGINT) AS s FROM {_FIRST} WHERE text IS NOT NULL)")
def entry_sizes(s: SparkSession, d: str) -> DataFrame:
    return E.sizes(first_loaded(s, d, "text"), F.length("text"), 2000)


@query("SELECT source_file, " + _SIZES + ", count(*) FILTER (s > 1600) AS over FROM (SELECT DISTINCT source_file, chunk_id, CAST(chars AS BIGINT) AS s FROM chunks) GROUP BY 1")
def chunk_sizes(s: SparkSession, d: str) -> DataFrame:
    return E.sizes(chunks(s, d, "source_file", "chars"), F.col("chars"), 1600, "source_file")


@query(f"""
WITH f AS {_FILES}, l AS (SELECT DISTINCT source_file, 'none' AS path FROM entries)
SELECT DISTINCT e.id, e.source_file, f.path FROM entries e JOIN f ON e.entry_date = f.date ANTI JOIN (SELECT DISTINCT source_file, unnest(photos).path AS path FROM entries) u ON u.source_file = e.source_file AND u.path = f.path""")
def photos_by_date(s: SparkSession, d: str) -> DataFrame:
    return M.attach_by_day(first_loaded(s, d, "source_file", "entry_date", "photos"), dated_files(s, d))


@query("""
WITH p AS (SELECT DISTINCT unnest(photos).path AS path, unnest(photos).source AS source FROM entries),
o AS (SELECT DISTINCT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM p WHERE source = 'date')
SELECT * FROM o WHERE folder NOT IN (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) FROM p WHERE source = 'link')""")
def orphan_files(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "entries").select(F.explode("photos").alias("p")).select("p.path", "p.source").distinct()
    return M.orphans(rows.where("source = 'date'").select("path").distinct(), rows.where("source = 'link'").select("path"))


@query(f"""
WITH f AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, date, path, CASE WHEN path LIKE '%walk-%' THEN 'walk-' || replace(date, '-', '') END AS caption FROM {_FILES}),
g AS (SELECT folder, date, count(*) AS n, count(caption) AS captions, min(caption) AS caption FROM f GROUP BY 1, 2)
SELECT trim(regexp_replace(lower(string_split(folder, '/')[2] || '-2024'), '[^a-z0-9]+', '-', 'g'), '-') || '#r' || lpad(CAST(row_number() OVER (PARTITION BY folder ORDER BY date) AS VARCHAR), 4, '0') AS id,
  string_split(folder, '/')[2] AS trip, date AS entry_date, CAST(n AS INTEGER) AS photos, CASE WHEN captions = 0 THEN 'reconstructed;no_captions' ELSE 'reconstructed' END AS warnings,
  CASE WHEN captions = 0 THEN '[Reconstructed: ' || n || ' photographs taken in ' || string_split(folder, '/')[2] || '; neither journal nor captions survive.]'
  ELSE '[Reconstructed from ' || n || ' photographs; the journal is missing and these are their captions.]' || chr(10) || chr(10) || 'Photographed in ' || string_split(folder, '/')[2] || ': ' || caption || '.' END AS text FROM g""")
def reconstructed_days(s: SparkSession, d: str) -> DataFrame:
    files = dated_files(s, d).withColumn("folder", M.folder_of(F.col("path")))
    return M.reconstruct(files).select("id", "trip", "entry_date", F.size("photos").alias("photos"), F.array_join("warnings", ";").alias("warnings"), "text")


# journals to entries


def journal_lines(s: SparkSession, d: str) -> DataFrame:
    """The documents as journals: a file each, named after its id and, but for every third, a year; every line a paragraph with its photo link."""
    docs = table(s, d, "documents").select("doc_id", "text").where("text IS NOT NULL")
    name = F.concat(F.lit("page "), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit(" - "), (1990 + F.col("doc_id") % 30).cast("string"))).otherwise(""), F.lit(".docx"))
    rows = docs.select("doc_id", name.alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    link = F.concat(F.lit("../pictures/p"), (F.col("line_no") % 5).cast("string"), F.lit(".jpg"))
    return rows.select("file", "line_no", "line", F.when((F.col("doc_id") + F.col("line_no")) % 4 == 0, F.array(link)).otherwise(F.array().cast("array<string>")).alias("links"), F.lit(True).alias("new_par"))


_HEAD = D.HEAD.replace("'", "''")
_SEGMENTED = rf"""
j AS (SELECT 'page ' || doc_id || CASE WHEN doc_id % 3 > 0 THEN ' - ' || (1990 + doc_id % 30) ELSE '' END || '.docx' AS file, CASE WHEN doc_id % 3 > 0 THEN CAST(1990 + doc_id % 30 AS INTEGER) END AS base_year, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, trim(line) AS t, regexp_extract(trim(line), '{_HEAD}', 1) AS head, regexp_extract(trim(line), '{_HEAD}', 2) AS rest FROM j),
p1 AS (SELECT *, regexp_matches(t, '{_DATE}') AND TRY_CAST(regexp_extract(t, '{_DATE}', 2) AS INTEGER) BETWEEN 1 AND 31 AND coalesce(TRY_CAST(nullif(regexp_extract(t, '{_DATE}', 3), '') AS INTEGER) BETWEEN 1900 AND 2100, true) AS whole,
  regexp_matches(head, '{_DATE}') AND TRY_CAST(regexp_extract(head, '{_DATE}', 2) AS INTEGER) BETWEEN 1 AND 31 AND rest <> '' AS part FROM w),
p2 AS (SELECT *, whole OR part AS dated, CASE WHEN whole THEN t WHEN part THEN head END AS said FROM p1),
p3 AS (SELECT *, count(*) FILTER (dated) OVER (PARTITION BY file ORDER BY line_no) AS idx, CAST(list_position({_ABBR}, lower(substr(regexp_extract(said, '{_DATE}', 1), 1, 3))) AS INTEGER) AS month,
  TRY_CAST(regexp_extract(said, '{_DATE}', 2) AS INTEGER) AS day, CASE WHEN whole THEN TRY_CAST(nullif(regexp_extract(said, '{_DATE}', 3), '') AS INTEGER) END AS inline_year, max(dated) OVER (PARTITION BY file) AS any_date FROM p2),
blk AS (SELECT file, idx, string_agg(CASE WHEN part AND NOT whole THEN rest ELSE line END, chr(10) || chr(10) ORDER BY line_no) AS body, list(CASE WHEN (doc_id + line_no) % 4 = 0 THEN 'pictures/p' || (line_no % 5) || '.jpg' END ORDER BY line_no) AS links FROM p3 WHERE NOT dated OR (part AND NOT whole) GROUP BY 1, 2),
st AS (SELECT *, lag(month) OVER f AS pm, count(inline_year) OVER (f ROWS UNBOUNDED PRECEDING) AS seg FROM p3 WHERE dated WINDOW f AS (PARTITION BY file ORDER BY idx)),
sb AS (SELECT *, coalesce(pm >= 11 AND month <= 2 AND inline_year IS NULL, false) AS turn, max(inline_year) OVER (PARTITION BY file, seg) AS sy FROM st),
sc AS (SELECT *, sum(turn::INT) OVER (PARTITION BY file, seg ORDER BY idx ROWS UNBOUNDED PRECEDING) AS n, coalesce(sy, base_year) AS start FROM sb),
sd AS (SELECT file, idx, month, day, part AND NOT whole AS inl, start + CASE WHEN base_year IS NULL THEN n ELSE least(n, greatest(base_year + 1 - start, 0)) END AS year,
  CASE WHEN inline_year IS NOT NULL THEN 'year_from_entry' WHEN turn AND start IS NOT NULL AND (base_year IS NULL OR n <= greatest(base_year + 1 - start, 0)) THEN 'year_rollover' WHEN month < pm AND start IS NOT NULL THEN 'out_of_order' END AS yw FROM sc),
ee AS (SELECT coalesce(sd.file, blk.file) AS file, coalesce(sd.idx, blk.idx) AS idx, sd.month, sd.day, sd.inl, sd.yw, coalesce(body, '') AS body, links, CASE WHEN sd.year IS NOT NULL AND month IS NOT NULL THEN printf('%04d-%02d-%02d', sd.year, month, day) END AS entry_date
  FROM sd FULL JOIN (SELECT * FROM blk WHERE file IN (SELECT file FROM sd)) blk ON sd.file = blk.file AND sd.idx = blk.idx),
ef AS (SELECT *, trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(body, '{_REF}', ' ', 'g'), '\s*\(\s*\)', '', 'g'), '\s+([,.;:!?])', '\1', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), chr(10)),
  '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text,
  CASE WHEN TRY_CAST(entry_date AS DATE) IS NULL AND TRY_CAST(substr(entry_date, 1, 7) || '-01' AS DATE) IS NOT NULL THEN strftime(last_day(CAST(substr(entry_date, 1, 7) || '-01' AS DATE)), '%Y-%m-%d') END AS suggest FROM ee)"""


@query(rf"""WITH {_SEGMENTED}
SELECT trim(regexp_replace(lower(regexp_replace(file, '\.[^.]*$', '')), '[^a-z0-9]+', '-', 'g'), '-') || '#' || lpad(CAST(idx AS VARCHAR), 4, '0') AS id, entry_date, CASE WHEN idx = 0 THEN '' ELSE printf('%02d-%02d', month, day) END AS month_day, md5(text) AS digest,
  array_to_string(list_filter([CASE WHEN idx = 0 THEN 'preamble' END, yw, CASE WHEN inl THEN 'date_on_same_line' END, 'invalid_date:suggest=' || suggest], lambda x: x IS NOT NULL), ';') AS warnings
FROM ef WHERE idx > 0 OR text <> ''""")
def segmented_entries(s: SparkSession, d: str) -> DataFrame:
    """Entries of the documents' lines: date lines, years, warnings and bodies."""
    return E.segment(journal_lines(s, d)).select("id", "entry_date", "month_day", F.md5("text").alias("digest"), F.array_join("warnings", ";").alias("warnings"))


def picture_files(s: SparkSession, d: str) -> DataFrame:
    """Picture files p0 to p2, of which p1 lies in two folders, and a dated one for every day of the entries table."""
    days = table(s, d, "entries").where(D.is_valid(F.col("entry_date"))).select("entry_date").distinct()
    dated = days.select(F.concat(F.lit("days/"), F.replace("entry_date", F.lit("-"), F.lit("")), F.lit(".jpg")).alias("path"), F.col("entry_date").alias("date"))
    plain = s.createDataFrame([("pictures/p0.jpg",), ("2001/fen/p1.jpg",), ("2002/fen/p1.jpg",), ("2003/moor/p2.jpg",)], "path string").withColumn("date", F.lit(None).cast("string"))
    return plain.unionByName(dated)


@query(rf"""WITH {_SEGMENTED},
days AS (SELECT DISTINCT entry_date AS date, 'days/' || replace(entry_date, '-', '') || '.jpg' AS path FROM entries WHERE regexp_matches(entry_date, '^\d{{4}}-\d{{2}}-\d{{2}}$') AND TRY_CAST(entry_date AS DATE) IS NOT NULL),
ph AS (SELECT file, idx, CASE l WHEN 'pictures/p0.jpg' THEN l || ':link:exact' WHEN 'pictures/p2.jpg' THEN '2003/moor/p2.jpg:link:basename' WHEN 'pictures/p1.jpg' THEN l || ':link:ambiguous' ELSE l || ':link:missing' END AS p, i FROM (SELECT file, idx, unnest(links) AS l, generate_subscripts(links, 1) AS i FROM ef WHERE idx > 0 OR text <> '') WHERE l IS NOT NULL
  UNION ALL SELECT file, idx, days.path || ':date:exact', 1000000 FROM ef JOIN days ON ef.entry_date = days.date WHERE idx > 0),
pp AS (SELECT file, idx, string_agg(p, ',' ORDER BY i, p) AS photos, bool_or(i = 1000000) AS by_date FROM ph GROUP BY 1, 2)
SELECT trim(regexp_replace(lower(regexp_replace(file, '\.[^.]*$', '')), '[^a-z0-9]+', '-', 'g'), '-') || '#' || lpad(CAST(idx AS VARCHAR), 4, '0') AS id, coalesce(photos, '') AS photos, photos IS NULL AS none, coalesce(by_date, false) AS by_date
FROM ef LEFT JOIN pp USING (file, idx) WHERE idx > 0 OR text <> ''""")
def converted_photos(s: SparkSession, d: str) -> DataFrame:
    """The photos of entries made of the documents: links looked up among files, and files of the entry's day."""
    made = E.convert(journal_lines(s, d), picture_files(s, d))
    shown = F.transform("photos", lambda p: F.concat_ws(":", p["path"], p["source"], p["resolved"]))
    return made.select("id", F.array_join(shown, ",").alias("photos"), F.array_contains("warnings", "no_photos").alias("none"), F.array_contains("warnings", "photos_by_date").alias("by_date"))


@query()
def conversion_report(s: SparkSession, d: str) -> DataFrame:
    """What the conversion of the documents came to; every tenth entry has a reviewed date."""
    fixes = E.segment(journal_lines(s, d)).where("idx % 10 = 1").select(F.col("id").alias("entry_id"), F.coalesce("entry_date", F.lit("2000-01-01")).alias("entry_date"))
    return E.conversion_report(E.convert(journal_lines(s, d), picture_files(s, d), fixes))


# chunks and index


@query()
def chunk_pack(s: SparkSession, d: str) -> DataFrame:
    """The chunks of all entries, packed anew."""
    return chunking.chunk_entries(first_loaded(s, d, "entry_date", "trip", "text", "source_file", "photos", "warnings"))


@query("""
SELECT chunk_id, CASE WHEN trim(trip) = '' THEN entry_date || ' — ' ELSE entry_date || ', ' || trim(trip) || ' — ' END AS header,
  starts_with(text, CASE WHEN trim(trip) = '' THEN entry_date || ' — ' ELSE entry_date || ', ' || trim(trip) || ' — ' END) AS opens
FROM (SELECT DISTINCT chunk_id, coalesce(trip, '') AS trip, entry_date, text FROM chunks)""")
def chunk_headers(s: SparkSession, d: str) -> DataFrame:
    head = T.header(F.col("entry_date"), F.col("trip"))
    return chunks(s, d, "trip", "entry_date", "text").select("chunk_id", head.alias("header"), F.startswith("text", head).alias("opens"))


@query(r"""
SELECT DISTINCT id, len(list_filter(list_transform(string_split_regex(text, '\n\s*\n+'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> '')) AS paragraphs,
  len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS sentences
FROM entries WHERE text IS NOT NULL""")
def paragraph_counts(s: SparkSession, d: str) -> DataFrame:
    rows = entries(s, d, "text").where("text IS NOT NULL")
    return rows.select("id", F.size(T.paragraphs(F.col("text"))).cast("bigint").alias("paragraphs"), F.size(T.sentence_parts(F.col("text"))).cast("bigint").alias("sentences"))


@query(f"SELECT DISTINCT chunk_id, substr(sha256('{MODEL}' || chr(0) || text), 1, 16) AS hash FROM chunks")
def content_hashes(s: SparkSession, d: str) -> DataFrame:
    return chunks(s, d, "text").select("chunk_id", T.content_hash(F.col("text"), MODEL).alias("hash"))


_HALF = f"(SELECT DISTINCT chunk_id, substr(sha256('{MODEL}' || chr(0) || text), 1, 16) AS hash FROM chunks WHERE month % 2 = 0)"


@query(f"SELECT chunk_id FROM (SELECT DISTINCT chunk_id, substr(sha256('{MODEL}' || chr(0) || text), 1, 16) AS hash FROM chunks) c ANTI JOIN {_HALF} h USING (chunk_id, hash)")
def index_pending(s: SparkSession, d: str) -> DataFrame:
    """Chunks to embed where the index holds those of even months."""
    held = chunks(s, d, "text", "month").where("month % 2 = 0").select("chunk_id", T.content_hash(F.col("text"), MODEL).alias("hash"))
    return I.pending(chunks(s, d, "text"), held, MODEL).select("chunk_id")


@query("""
WITH c AS (SELECT DISTINCT chunk_id, month, text FROM chunks)
SELECT chunk_id, CASE WHEN month = 1 THEN 'fresh' ELSE 'held' END AS state FROM c WHERE month <> 2""")
def index_upsert(s: SparkSession, d: str) -> DataFrame:
    """An index after January's chunks were renewed and February's went."""
    rows = chunks(s, d, "month")
    held = rows.where("month <= 12").select("chunk_id", F.lit("held").alias("state"))
    fresh = rows.where("month = 1").select("chunk_id", F.lit("fresh").alias("state"))
    return I.upsert(held, fresh, I.stale(rows.where("month <> 2"), held))


@query("""
SELECT count(*) AS rows, count(*) - count(DISTINCT chunk_id) AS repeated_ids, count(*) FILTER (vector IS NULL) AS no_vector, count(*) FILTER (len(vector) <> 64) AS wrong_length,
  count(*) FILTER (len(list_filter(vector, lambda x: isnan(x))) > 0) AS with_nan, count(*) FILTER (len(vector) = 64 AND len(list_filter(vector, lambda x: x <> 0)) = 0) AS zero_length,
  count(*) FILTER (entry_date IS NULL OR entry_date = '') AS undated, count(*) FILTER (hash IS NULL) AS no_hash FROM chunks""")
def index_verify(s: SparkSession, d: str) -> DataFrame:
    return I.verify(table(s, d, "chunks"), 64)


@query("SELECT DISTINCT chunk_id FROM chunks WHERE entry_id NOT IN (SELECT id FROM entries)")
def chunks_without_entry(s: SparkSession, d: str) -> DataFrame:
    from pagewright.operators import privacy

    return privacy.missing_upstream(chunks(s, d, "entry_id"), table(s, d, "entries")).select("chunk_id")


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+')"


@query(f"SELECT term, count(*) AS df, sum(tf) AS tf FROM (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest({_TOKENS}) AS term FROM (SELECT DISTINCT chunk_id, text FROM chunks)) GROUP BY 1, 2) GROUP BY 1")
def posting_stats(s: SparkSession, d: str) -> DataFrame:
    return I.postings(chunks(s, d, "text")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(f"SELECT DISTINCT chunk_id, len({_TOKENS}) AS len FROM chunks")
def doc_lengths(s: SparkSession, d: str) -> DataFrame:
    return I.doc_stats(chunks(s, d, "text")).withColumn("len", F.col("len").cast("bigint"))
