"""Dated entries made of document lines, and what is wrong with their dates.

Lines have columns file, line_no, line, links (array) and new_par. All order
is by window blocks (see ``ordered``), never by gathering a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagewright.functions import dates as D, text as T
from pagewright.operators import media as M
from pagewright.operators.ordered import with_neighbours, with_running
from pagewright.session import cut

def _none() -> Column:
    return F.array().cast("array<string>")


def _flag(condition: Column, warning: Column | str) -> Column:
    """A list of the warning where the condition holds, else none."""
    said = F.lit(warning) if isinstance(warning, str) else warning
    return F.when(F.coalesce(condition, F.lit(False)), F.array(said)).otherwise(_none())


def mark_starts(lines: DataFrame) -> DataFrame:
    """Lines with their date (struct month, day, year), the body text on a date's own line, and the number of the entry they belong to."""
    text = F.trim("line")
    head = D.inline_date(text)
    marked = lines.withColumns(
        {"date": F.coalesce(D.parse_date_line(text), head["date"]), "inline": F.when(D.parse_date_line(text).isNull(), head["rest"])}
    )
    return with_running(marked, "file", "line_no", {"idx": F.col("date").isNotNull()})


def rollover(starts: DataFrame, group: str, order: str, month: str, inline_year: str, base_year: str) -> DataFrame:
    """``starts`` with year and year_warnings.

    A year written in the line holds from there on; else the base year does,
    plus one once a month of winter's end follows one of its beginning - at most
    one year past the base. Any other step back of months is out_of_order.
    Closed form: per stretch since the last written year, the stretch's year plus
    its crossings so far, capped.
    """
    rows = with_neighbours(starts, group, order, F.col(month)).withColumnRenamed("before1", "_pm").drop("before2", "after1")
    written, crossing = F.col(inline_year).isNotNull(), (F.col("_pm") >= 11) & (F.col(month) <= 2)
    turn = F.coalesce(crossing & ~written & (F.col(month) < F.col("_pm")), F.lit(False))
    rows = with_running(rows.withColumns({"_w": written, "_turn": turn}), group, order, {"_seg": F.col("_w"), "_cum": F.col("_turn")})
    stretch = rows.groupBy(group, "_seg").agg(
        F.max(inline_year).alias("_sy"), (F.min("_cum") - F.min_by(F.col("_turn").cast("bigint"), F.col(order))).alias("_c0")
    )
    rows = rows.join(stretch, [group, "_seg"])
    n, base = F.col("_cum") - F.col("_c0"), F.col(base_year)
    start = F.coalesce("_sy", base)
    cap = F.greatest(base + 1 - start, F.lit(0))
    back = F.coalesce(F.col(month) < F.col("_pm"), F.lit(False)) & ~F.col("_w") & start.isNotNull()
    rolled = F.col("_turn") & (base.isNull() | (n <= cap)) & start.isNotNull()
    year = start + F.when(base.isNull(), n).otherwise(F.least(n, cap))
    warn = F.concat(_flag(F.col("_w"), "year_from_entry"), _flag(rolled, "year_rollover"), _flag(back & ~rolled, "out_of_order"))
    return rows.select(*(rows[c] for c in starts.columns), year.cast("int").alias("year"), warn.alias("year_warnings"))


def segment(lines: DataFrame) -> DataFrame:
    """Entries of document lines: id, source_file, trip, entry_date, month_day, text, links, inline_refs, warnings.

    A date line opens an entry; text before the first is a preamble without a
    date; a file without any gives none. Paragraphs are set apart by a blank
    line, soft breaks by a line break; references to media are taken out of the
    text. Null lines count as empty.
    """
    lines = lines.withColumn("line", F.coalesce("line", F.lit("")))
    marked = cut(mark_starts(lines))  # read for the starts, the bodies and the files
    name = D.file_trip(F.col("file"))
    starts = marked.where(F.col("date").isNotNull()).select(
        "file", "idx", F.col("date.month").alias("month"), F.col("date.day").alias("day"), F.col("date.year").alias("inline_year"),
        F.col("inline"), name["year"].alias("base_year"),
    )
    dated = rollover(starts, "file", "idx", "month", "inline_year", "base_year")
    body = marked.where(F.col("date").isNull() | F.col("inline").isNotNull())
    piece = F.struct("line_no", F.coalesce("inline", "line").alias("line"), "new_par", F.coalesce("links", _none()).alias("links"))
    blocks = body.groupBy("file", "idx").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    glued = F.aggregate(
        "pieces", F.lit(None).cast("string"), lambda s, p: F.when(s.isNull(), p["line"]).otherwise(F.concat(s, F.when(p["new_par"], "\n\n").otherwise("\n"), p["line"]))
    )
    clean = T.strip_photo_refs(F.coalesce(glued, F.lit("")))
    blocks = blocks.select("file", "idx", T.normalise(clean["text"]).alias("text"), clean["refs"].alias("inline_refs"), F.flatten(F.transform("pieces", lambda p: p["links"])).alias("links"))
    files = dated.select("file").distinct()
    numbers = dated.select("file", "idx").unionByName(blocks.where((F.col("idx") == 0) & (F.col("text") != "")).select("file", "idx"))
    rows = (
        numbers.join(files, "file", "left_semi")
        .join(dated.drop("base_year"), ["file", "idx"], "left")
        .join(blocks, ["file", "idx"], "left")
    )
    date = F.when(F.col("year").isNotNull() & F.col("month").isNotNull(), D.iso(F.col("year"), F.col("month"), F.col("day")))
    preamble = F.col("idx") == 0
    rows = rows.withColumn("entry_date", date)
    suggest = D.nearest_valid(F.col("entry_date"))
    warnings = F.concat(
        _flag(preamble, "preamble"), F.coalesce("year_warnings", _none()), _flag(F.col("inline").isNotNull(), "date_on_same_line"),
        _flag(suggest.isNotNull(), F.concat(F.lit("invalid_date:suggest="), suggest)),
    )
    return rows.select(
        F.concat(T.slug(F.regexp_replace("file", r"\.[^.]*$", "")), F.lit("#"), F.lpad(F.col("idx").cast("string"), 4, "0")).alias("id"),
        F.col("file").alias("source_file"), F.col("idx").cast("int").alias("idx"), D.file_trip(F.col("file"))["trip"].alias("trip"), "entry_date",
        F.when(preamble, "").otherwise(F.format_string("%02d-%02d", "month", "day")).alias("month_day"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce("links", _none()).alias("links"), F.coalesce("inline_refs", _none()).alias("inline_refs"),
        warnings.alias("warnings"),
    )


def file_warnings(lines: DataFrame) -> DataFrame:
    """(file, warning): no_year_in_filename and no_date_lines."""
    seen = mark_starts(lines).groupBy("file").agg(F.max(F.col("date").isNotNull()).alias("dated"))
    year = D.file_trip(F.col("file"))["year"]
    both = F.concat(_flag(year.isNull(), "no_year_in_filename"), _flag(~F.col("dated"), "no_date_lines"))
    return seen.select("file", F.explode(both).alias("warning"))


def chronology(entries: DataFrame, group: str, order: str, date: str) -> DataFrame:
    """(group, order, chronology): warnings of entries whose date breaks their file's order.

    Over calendar-valid dates: equal to the one before is duplicate_date; of a
    step back, that one of the pair is date_out_of_sequence whose removal
    restores order, with suspect_month_typo where a neighbour's month would.
    ``order`` is a whole number, unique in a group.
    """
    valid = entries.where(D.is_valid(F.col(date))).select(group, order, F.col(date).alias("d"))
    rows = with_neighbours(valid, group, order, F.col("d"))
    d, prev, before, after = F.col("d"), F.col("before1"), F.col("before2"), F.col("after1")
    equal, back = d == prev, d < prev
    current = (before.isNull() | (before <= prev)) & (after.isNull() | (prev <= after))

    def typo(culprit: Column, lo: Column, hi: Column) -> Column:
        def fits(donor: Column) -> Column:
            cand = F.concat(F.substring(donor, 1, 8), F.substring(culprit, 9, 2))
            return F.when((cand != culprit) & (lo.isNull() | (lo < cand)) & (hi.isNull() | (cand < hi)), F.concat(F.lit("suspect_month_typo:"), cand))

        found = F.coalesce(fits(prev), fits(d))
        return F.concat(F.array(F.lit("date_out_of_sequence")), F.when(found.isNotNull(), F.array(found)).otherwise(_none()))

    own = F.when(equal, F.array(F.lit("duplicate_date"))).when(back & current, typo(d, prev, after)).otherwise(_none())
    # of a pair whose culprit is the earlier one, the verdict belongs to the row before
    earlier = F.when(back & ~current, typo(prev, before, d)).otherwise(_none())
    judged = rows.select(group, order, own.alias("own"), earlier.alias("given"))
    passed = with_neighbours(judged, group, order, F.to_json("given")).select(
        group, order, F.concat("own", F.coalesce(F.from_json("after1", "array<string>"), _none())).alias("chronology")
    )
    return passed.where(F.size("chronology") > 0)


def photo_lists(entries: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """``entries`` of ``segment`` with photos (path, source, resolved) in place of links and inline_refs, and chars.

    Links come first, each as often as it stands; then references in the text, several
    between commas, those with a suffix and a path not met in the entry before. Paths are
    looked up among ``media`` (path); without it they are unchecked. An entry without
    any says no_photos.
    """
    parts = F.flatten(F.transform("inline_refs", lambda r: F.split(F.btrim(r, F.lit("() ")), r"\s*,\s*")))
    inline = F.filter(parts, lambda x: F.contains(x, F.lit(".")))
    link, ref = F.lit("link").alias("source"), F.lit("inline").alias("source")
    said = F.concat(F.transform("links", lambda x: F.struct(x.alias("raw"), link)), F.transform(inline, lambda x: F.struct(x.alias("raw"), ref)))
    rows = entries.select("id", D.file_trip(F.col("source_file"))["year"].alias("year"), F.posexplode(said).alias("at", "p"))
    rows = rows.select("id", "year", "at", "p.source", T.normalise_path(F.col("p.raw")).alias("path")).where("path <> ''")
    found = rows.withColumns({"resolved": F.col("path"), "how": F.lit("unchecked")}) if media is None else M.resolve(rows, media)
    first = F.row_number().over(W.partitionBy("id", "resolved").orderBy("at")) == 1
    kept = found.withColumn("_first", first).where(F.col("_first") | (F.col("source") == "link"))
    photo = F.struct("at", F.col("resolved").alias("path"), "source", F.col("how").alias("resolved"))
    photos = kept.groupBy("id").agg(F.array_sort(F.collect_list(photo)).alias("_photos"))
    joined = entries.join(photos, "id", "left")
    shown = F.transform(F.coalesce("_photos", F.array().cast(photos.schema["_photos"].dataType)), lambda p: F.struct(p["path"].alias("path"), p["source"].alias("source"), p["resolved"].alias("resolved")))
    return joined.withColumns(
        {"photos": shown, "chars": F.length("text"), "warnings": F.concat("warnings", _flag(F.col("_photos").isNull(), "no_photos"))}
    ).drop("_photos", "links", "inline_refs")


def flag_chronology(entries: DataFrame) -> DataFrame:
    """``entries`` (source_file, idx, entry_date, warnings) with warnings about sequence made anew."""
    kept = F.filter("warnings", lambda w: ~w.rlike(_SEQUENCE))
    found = chronology(entries, "source_file", "idx", "entry_date")
    joined = entries.join(found, ["source_file", "idx"], "left")
    return joined.withColumn("warnings", F.concat(kept, F.coalesce("chronology", _none()))).drop("chronology")


def convert(lines: DataFrame, media: DataFrame | None = None, corrections: DataFrame | None = None) -> DataFrame:
    """Entries of all journals' lines: id, source_file, idx, trip, entry_date, month_day, text, photos, chars, warnings.

    ``media`` has path and date: links are looked up among its paths, and files of an
    entry's day that its journal links nowhere are attached. ``corrections`` has
    entry_id and entry_date; warnings about sequence hold after it.
    """
    # each step reads what came before it more than once, so that is written in between
    entries = cut(photo_lists(cut(segment(lines)), None if media is None else media.select("path")))
    entries = cut(flag_chronology(entries))
    if media is not None:
        entries = cut(M.with_attached(entries, M.attach_by_day(entries, media.where("date IS NOT NULL"))))
    if corrections is not None:
        entries = flag_chronology(cut(apply_corrections(entries, corrections)[0]))
    return entries.select("id", "source_file", "idx", "trip", "entry_date", "month_day", "text", "photos", "chars", "warnings")


def conversion_report(entries: DataFrame) -> DataFrame:
    """(what, kind, n): entries, undated ones, photos by how they were found, warnings by kind."""
    total = entries.agg(F.count("*").alias("entries"), F.count_if(F.col("entry_date").isNull()).alias("undated"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))
    rows = total.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("entries", "undated", "chars"))), F.array("entries", "undated", "chars"))).alias("kind", "n"))
    photos = entries.select(F.explode("photos.resolved").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
    said = warning_counts(entries).select(F.col("warning").alias("kind"), F.col("entries").alias("n"))
    parts = [df.select(F.lit(what).alias("what"), "kind", "n") for what, df in (("total", rows), ("photos", photos), ("warnings", said))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


_SEQUENCE = r"^(?:date_out_of_sequence|suspect_month_typo|duplicate_date)"


def apply_corrections(entries: DataFrame, corrections: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(entries with reviewed dates, corrections without an entry). ``corrections`` has entry_id and entry_date, one each.

    A corrected entry loses its warnings about sequence and says what it was.
    """
    fix = corrections.select(F.col("entry_id").alias(key), F.col("entry_date").alias("_to"))
    joined = entries.join(fix, key, "left")
    kept = F.filter(F.coalesce("warnings", _none()), lambda w: ~w.rlike(_SEQUENCE))
    said = F.concat(F.lit("date_corrected:from="), F.coalesce("entry_date", F.lit("none")))
    fixed = joined.withColumn("warnings", F.when(F.col("_to").isNull(), F.col("warnings")).otherwise(F.array_append(kept, said)))
    fixed = fixed.withColumn("entry_date", F.coalesce("_to", "entry_date")).drop("_to")
    return fixed, corrections.join(entries.select(F.col(key).alias("entry_id")), "entry_id", "left_anti")


def warning_counts(entries: DataFrame) -> DataFrame:
    """(warning, entries): how often each kind of warning stands, without its details."""
    return entries.select(F.explode("warnings").alias("w")).groupBy(F.split("w", ":")[0].alias("warning")).agg(F.count("*").alias("entries"))


def manifest(entries: DataFrame, warnings: DataFrame) -> DataFrame:
    """(source_file, entries, photos, file_warnings) of every file, those without entries included."""
    sums = entries.groupBy("source_file").agg(F.count("*").alias("entries"), F.sum(F.size("photos")).alias("photos"))
    said = warnings.groupBy(F.col("file").alias("source_file")).agg(F.array_join(F.array_sort(F.collect_set("warning")), ";").alias("file_warnings"))
    zero = F.lit(0)
    return sums.join(said, "source_file", "full").select(
        "source_file", F.coalesce("entries", zero).alias("entries"), F.coalesce("photos", zero).alias("photos"), F.coalesce("file_warnings", F.lit("")).alias("file_warnings")
    )


def sizes(df: DataFrame, value: Column, over: int, group: str | None = None) -> DataFrame:
    """Count, least, middle, ninetieth-in-a-hundred and greatest size, by index, and how many exceed ``over``.

    The quantiles are the values at fixed places of the sorted sizes. Sizes are
    counted first, so what is sorted is one row per distinct size.
    """
    keys = [group] if group else []
    counts = df.select(*keys, value.cast("bigint").alias("s")).where("s IS NOT NULL").groupBy(*keys, "s").count()
    pair = F.array_sort(F.collect_list(F.struct("s", "count")))
    table = (counts.groupBy(*keys) if keys else counts.groupBy()).agg(F.sum("count").alias("n"), F.min("s").alias("least"), F.max("s").alias("greatest"), pair.alias("p"), F.sum(F.when(F.col("s") > over, F.col("count")).otherwise(0)).alias("over"))

    def at(place: Column) -> Column:
        state = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("found"))
        step = lambda a, x: F.struct(
            (a["seen"] + x["count"]).alias("seen"), F.coalesce(a["found"], F.when(a["seen"] + x["count"] > place, x["s"])).alias("found")
        )
        return F.aggregate("p", state, step, lambda a: a["found"])

    n = F.col("n")
    return table.select(*keys, "n", "least", at(F.floor(n / 2)).alias("middle"), at(F.least(F.floor(n * 0.9), n - 1)).alias("ninety"), "greatest", "over")


def format_probe(lines: DataFrame) -> DataFrame:
    """(file, date_lines, inline_dates, near_misses, month_words, links): the shapes of a file's lines."""
    text = F.trim("line")
    whole = D.parse_date_line(text).isNotNull()
    inline = D.inline_date(text).isNotNull()
    return lines.groupBy("file").agg(
        F.count_if(whole).alias("date_lines"), F.count_if(inline).alias("inline_dates"), F.count_if(D.is_near_date(text) & ~inline).alias("near_misses"),
        F.count_if(D.is_month_word(text)).alias("month_words"), F.sum(F.coalesce(F.size("links"), F.lit(0))).alias("links"),
    )
