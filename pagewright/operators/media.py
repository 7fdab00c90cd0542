"""Media files: resolving written paths, attaching by day, rebuilding lost journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagewright.functions import text as T


def _lookups(media: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact paths, and tails and names with how many files share them (an arbitrary one of which stands for one)."""
    paths = media.select("path").distinct()
    parts = F.split("path", "/")
    tail = F.lower(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/"))
    tails = paths.where(F.size(parts) >= 2).groupBy(tail.alias("key")).agg(F.count("*").alias("n"), F.min("path").alias("hit"))
    names = paths.groupBy(F.lower(F.element_at(parts, -1)).alias("key")).agg(F.count("*").alias("n"), F.min("path").alias("hit"))
    return paths, tails, names


def resolve(links: DataFrame, media: DataFrame) -> DataFrame:
    """``links`` (path, year) with resolved and how.

    In turn: the path itself, with the year before it, the only file of that
    folder and name, the only file of that name; then the same with typographic
    dashes made hyphens (dash_fix). Otherwise ambiguous, where several files
    have the name, or missing; the path then stays. Distinct paths are looked up
    once, so a path that most rows share is joined as one.
    """
    exact, tails, names = _lookups(media)

    def look(df: DataFrame, path: Column, tag: str) -> DataFrame:
        parts = F.split(path, "/")
        tail = F.lower(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/"))
        dated = F.when((F.size(parts) == 2) & (F.col("year") != 0), F.concat_ws("/", F.col("year").cast("string"), path))
        df = df.withColumns({"_p": path, "_y": dated, "_t": F.when(F.size(parts) >= 2, tail), "_n": F.lower(F.element_at(parts, -1))})
        df = df.join(exact.select(F.col("path").alias("_p"), F.lit(True).alias("_pe")), "_p", "left")
        df = df.join(exact.select(F.col("path").alias("_y"), F.lit(True).alias("_ye")), "_y", "left")
        df = df.join(tails.where("n = 1").select(F.col("key").alias("_t"), F.col("hit").alias("_th")), "_t", "left")
        df = df.join(names.select(F.col("key").alias("_n"), F.col("hit").alias("_nh"), F.col("n").alias("_nn")), "_n", "left")
        found = (
            F.when(F.col("_pe"), F.struct(F.col("_p").alias("path"), F.lit("exact").alias("how")))
            .when(F.col("_ye"), F.struct(F.col("_y").alias("path"), F.lit("year_prefix").alias("how")))
            .when(F.col("_th").isNotNull(), F.struct(F.col("_th").alias("path"), F.lit("place_tail").alias("how")))
            .when(F.col("_nn") == 1, F.struct(F.col("_nh").alias("path"), F.lit("basename").alias("how")))
        )
        return df.withColumns({tag: found, f"{tag}_many": F.coalesce(F.col("_nn") > 1, F.lit(False))}).drop("_p", "_y", "_t", "_n", "_pe", "_ye", "_th", "_nh", "_nn")

    asked = links.select("path", "year").distinct().withColumn("_path", F.col("path"))
    plain = F.translate("_path", "–—", "--")
    asked = look(look(asked, F.col("_path"), "a"), F.when(plain != F.col("_path"), plain), "b")
    answer = asked.select(
        F.col("path").alias("_ap"), F.col("year").alias("_ay"),
        F.coalesce("a.path", "b.path", "_path").alias("resolved"),
        F.coalesce("a.how", F.when(F.col("b").isNotNull(), "dash_fix"), F.when(F.col("a_many"), "ambiguous"), F.lit("missing")).alias("how"),
    )
    return links.join(answer, (F.col("path") == F.col("_ap")) & F.col("year").eqNullSafe(F.col("_ay")), "left").drop("_ap", "_ay")


def attach_by_day(entries: DataFrame, media: DataFrame) -> DataFrame:
    """(id, source_file, path): files of an entry's day that no entry of its source file links already."""
    linked = entries.select("source_file", F.explode("photos.path").alias("path")).distinct()
    dated = entries.where(F.col("entry_date").isNotNull()).select("id", "source_file", F.col("entry_date").alias("date"))
    return dated.join(media.select("date", "path").distinct(), "date").join(linked, ["source_file", "path"], "left_anti").select("id", "source_file", "path")


def with_attached(entries: DataFrame, attached: DataFrame) -> DataFrame:
    """Entries with attached files among their photos; no_photos goes, photos_by_date comes, once."""
    photo = F.struct("path", F.lit("date").alias("source"), F.lit("exact").alias("resolved"))
    more = attached.groupBy("id").agg(F.array_sort(F.collect_set(photo)).alias("_more"))
    said = F.array_union(F.filter("warnings", lambda w: w != "no_photos"), F.array(F.lit("photos_by_date")))
    joined = entries.join(more, "id", "left")
    return joined.withColumns(
        {"photos": F.when(F.col("_more").isNull(), F.col("photos")).otherwise(F.concat("photos", "_more")), "warnings": F.when(F.col("_more").isNull(), F.col("warnings")).otherwise(said)}
    ).drop("_more")


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def orphans(media: DataFrame, linked: DataFrame) -> DataFrame:
    """Media files of folders that no linked path lies in."""
    used = linked.select(folder_of(F.col("path")).alias("folder")).distinct()
    return media.withColumn("folder", folder_of(F.col("path"))).join(used, "folder", "left_anti")


def reconstruct(media: DataFrame) -> DataFrame:
    """Entries of orphaned files (folder, path, date): one per folder and day, told by their captions; undated files give none."""
    name = F.element_at(F.split("path", "/"), -1)
    shown = media.where(F.col("date").isNotNull()).select("folder", "date", "path", T.caption(name).alias("caption"))
    days = shown.groupBy("folder", "date").agg(F.array_sort(F.collect_set(F.struct("path", "caption"))).alias("files"))
    captions = F.array_distinct(F.filter(F.transform("files", lambda f: f["caption"]), lambda c: c.isNotNull()))
    parts = F.split("folder", "/")
    place, year = F.element_at(parts, -1), F.when(parts[0].rlike(r"^\d{4}$"), parts[0]).otherwise("undated")
    count = F.size("files").cast("string")
    told = F.concat(F.lit("[Reconstructed from "), count, F.lit(" photographs; the journal is missing and these are their captions.]\n\nPhotographed in "), place, F.lit(": "), F.array_join(captions, "; "), F.lit("."))
    bare = F.concat(F.lit("[Reconstructed: "), count, F.lit(" photographs taken in "), place, F.lit("; neither journal nor captions survive.]"))
    idx = F.row_number().over(W.partitionBy("folder").orderBy("date"))
    rows = days.select("*", idx.alias("idx"), F.when(F.size(captions) > 0, told).otherwise(bare).alias("text"), (F.size(captions) == 0).alias("mute"))
    return rows.select(
        F.concat(T.slug(F.concat_ws("-", place, year)), F.lit("#r"), F.lpad(F.col("idx").cast("string"), 4, "0")).alias("id"),
        F.concat(F.lit("(reconstructed: "), F.col("folder"), F.lit(")")).alias("source_file"),
        place.alias("trip"), F.col("date").alias("entry_date"), F.substring("date", 6, 5).alias("month_day"), "text",
        F.transform("files", lambda f: F.struct(f["path"].alias("path"), F.lit("reconstructed").alias("source"), F.lit("exact").alias("resolved"))).alias("photos"),
        F.length("text").alias("chars"),
        F.when(F.col("mute"), F.array(F.lit("reconstructed"), F.lit("no_captions"))).otherwise(F.array(F.lit("reconstructed"))).alias("warnings"),
    )


def image_report(files: DataFrame) -> DataFrame:
    """(fault, folder, files) of binary files (path, content) that are no whole images."""
    bad = files.select(folder_of(F.col("path")).alias("folder"), T.image_fault(F.col("content")).alias("fault")).where("fault IS NOT NULL")
    return bad.groupBy("fault", "folder").agg(F.count("*").alias("files"))
