"""Dates in lines, file names and questions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names of months; a name may stand by its first three letters, September also by four.
NAMES = "January February March April May June July August September October November December".split()
ABBREVIATIONS = [name[:3].lower() for name in NAMES]


def _spelt(name: str) -> str:
    short, rest = name[:3], name[3:]
    if name == "September":
        return short + "(?:t(?:ember)?)?"
    return f"{short}(?:{rest})?" if rest else short


MONTHS = "|".join(map(_spelt, NAMES))
# parts of a line: how it opens, a month, a day of one or two digits and its ending, a year, what may close it
_OPENS = r"(?i)^\s*"
_MONTH = f"({MONTHS})"
_DAY = r"\d{1,2}"
_ORDINAL = "(?:st|nd|rd|th)?"
_IN_YEAR = r"(?:\s*,?\s*(\d{4}))?"
_CLOSES = r"\s*[.,\-–—:;]*\s*$"
DATE_LINE = _OPENS + _MONTH + rf"\.?\s*({_DAY}){_ORDINAL}\.?" + _IN_YEAR + _CLOSES
NEAR = _OPENS + _MONTH + rf"\.?\s*({_DAY})\b"
MONTH_WORD = _OPENS + _MONTH + r"\b"
#: What could be a date, and the rest of its line.
HEAD = rf"^\s*([A-Za-z]+\.?\s*{_DAY}{_ORDINAL})\b[-\s.,:]*(.*)$"
#: Years that a question may name, by decades.
DECADES = range(198, 205)
YEAR = rf"\b({'|'.join(rf'{decade}[0-9]' for decade in DECADES)})\b"


def _int(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("int")


def parse_date_line(line: Column) -> Column:
    """struct(month, day, year) of a line that is nothing but a date; null otherwise. The year may be null."""
    month = F.array_position(F.array(*map(F.lit, ABBREVIATIONS)), F.lower(F.substring(F.regexp_extract(line, DATE_LINE, 1), 1, 3)))
    day, year = _int(F.regexp_extract(line, DATE_LINE, 2)), _int(F.regexp_extract(line, DATE_LINE, 3))
    good = line.rlike(DATE_LINE) & day.between(1, 31) & (year.isNull() | year.between(1900, 2100))
    return F.when(good, F.struct(month.cast("int").alias("month"), day.alias("day"), year.alias("year")))


def is_near_date(line: Column) -> Column:
    """Begins like a date but is none."""
    return line.rlike(NEAR) & parse_date_line(line).isNull()


def is_month_word(line: Column) -> Column:
    """Begins with a month's name without a day."""
    return line.rlike(MONTH_WORD) & ~line.rlike(NEAR)


def inline_date(line: Column) -> Column:
    """struct(date, rest) of a line that opens with a date and goes on; null otherwise."""
    date, rest = parse_date_line(F.regexp_extract(line, HEAD, 1)), F.regexp_extract(line, HEAD, 2)
    return F.when(date.isNotNull() & (rest != "") & parse_date_line(line).isNull(), F.struct(date.alias("date"), rest.alias("rest")))


def iso(year: Column, month: Column, day: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))


def nearest_valid(date: Column) -> Column:
    """The nearest valid day of the month for an ISO date that is none; null for valid or unreadable ones."""
    month = F.try_to_date(F.concat(F.substring(date, 1, 7), F.lit("-01")), "yyyy-MM-dd")
    day = F.least(F.substring(date, 9, 2).try_cast("int"), F.dayofmonth(F.last_day(month)))
    bad = date.rlike(r"^\d{4}-\d{2}-\d{2}$") & is_valid(date).eqNullSafe(False) & month.isNotNull()
    return F.when(bad, iso(F.year(month), F.month(month), day))


def is_valid(date: Column) -> Column:
    return F.when(date.isNotNull(), F.try_to_date(date, "yyyy-MM-dd").isNotNull() & date.rlike(r"^\d{4}-\d{2}-\d{2}$"))


def detect_year(query: Column) -> Column:
    """The first year from 1980 to 2049 named in a question."""
    return _int(F.regexp_extract(query, YEAR, 1))


# What cameras and phones write before a date.
CAMERAS = ["PXL", "IMG", "VID", "DSC", "MVI"]
#: Years that a date without such a prefix may have.
BARE_YEARS = (2000, 2029)
_EIGHT = r"(?<![0-9])[0-9]{8}(?![0-9])"


def _parts(digits: Column) -> tuple[Column, Column, Column]:
    """Year, month and day of eight digits."""
    return tuple(_int(F.substring(digits, at, n)) for at, n in ((1, 4), (5, 2), (7, 2)))


def file_date(name: Column, exif: Column | None = None) -> Column:
    """A media file's ISO day: from a camera's name, a bare date, epoch milliseconds, else its metadata."""

    def in_range(digits: Column, first: int, last: int) -> Column:
        y, m, d = _parts(digits)
        return y.between(first, last) & m.between(1, 12) & d.between(1, 31)

    camera = F.regexp_extract(name, f"(?:{'|'.join(CAMERAS)})[_-]([0-9]{{8}})", 1)
    bare = F.filter(F.regexp_extract_all(name, F.lit(_EIGHT), F.lit(0)), lambda x: in_range(x, *BARE_YEARS))
    bare = F.try_element_at(bare, F.lit(1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    stamp = F.when(stem.rlike("^1[0-9]{12}$"), F.timestamp_millis(stem.try_cast("bigint")))
    epoch = F.when(F.year(stamp).between(2000, 2100), F.date_format(stamp, "yyyy-MM-dd"))
    found = [F.when(in_range(camera, 1990, 2100), iso(*_parts(camera))), F.when(bare.isNotNull(), iso(*_parts(bare))), epoch]
    if exif is not None:
        day = F.translate(F.substring(exif, 1, 10), ":", "-")
        found.append(F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day))
    return F.coalesce(*found)


#: A file name that ends in a dash and a year.
TRIP_AND_YEAR = r"^(.*\S)\s*-\s*([0-9]{4})\s*$"


def file_trip(name: Column) -> Column:
    """struct(trip, year) of a journal's file name "<trip> - <year>"; the whole stem and null otherwise."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.struct(
        F.when(stem.rlike(TRIP_AND_YEAR), F.trim(F.regexp_extract(stem, TRIP_AND_YEAR, 1))).otherwise(stem).alias("trip"),
        _int(F.regexp_extract(stem, TRIP_AND_YEAR, 2)).alias("year"),
    )
