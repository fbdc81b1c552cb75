"""Scalar functions: sizes, dates, numbers and orders as people write them. Column versions stay in the JVM."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import cut

# Unit letters, date patterns, built-in date formats of spreadsheets, extension classes.
_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
BUILTIN_DATES = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
TYPE_GROUPS = {"word": ["doc", "docx", "odt", "rtf"], "excel": ["xls", "xlsx", "xlsb", "ods"], "powerpoint": ["ppt", "pptx", "odp"], "pdf": ["pdf"], "text": ["txt", "md", "csv", "html", "htm", "json", "xml", "log"]}


def parse_size(text: str) -> int | None:
    """Bytes of "10K", "1,5M", "3 GB", "700"; None if it is no size."""
    m = re.fullmatch(r"\s*(\d+(?:[.,]\d*)?|[.,]\d+)\s*([kmgt]?)b?\s*", text.lower())
    return int(float(m[1].replace(",", ".")) * _UNITS[m[2]]) if m else None


def size_bytes(text: Column) -> Column:
    low = F.lower(F.trim(text))
    number = F.regexp_replace(F.regexp_extract(low, r"^(\d+(?:[.,]\d*)?|[.,]\d+)\s*[kmgt]?b?$", 1), ",", ".")
    unit = F.regexp_extract(low, r"^[\d.,]+\s*([kmgt]?)b?$", 1)
    factor = reduce(lambda c, u: c.when(unit == u[0], float(u[1])), _UNITS.items(), F.when(F.lit(False), 1.0))
    return F.when(number != "", F.floor(number.cast("double") * factor)).cast("long")


def format_size(n: int) -> str:
    """In units of 1024 with one decimal and a comma, as the interface shows it."""
    if n < 1024:
        return f"{n} Б"
    for unit in ("КБ", "МБ", "ГБ", "ТБ"):
        n /= 1024
        if n < 1024 or unit == "ТБ":
            return f"{n:.1f} {unit}".replace(".", ",")
    raise AssertionError


def format_time(ms: int | None, zone: dt.tzinfo | None = None) -> str:
    """Day and minute of an instant in the local zone or the one given; "" for what no calendar holds."""
    try:
        return dt.datetime.fromtimestamp(ms / 1000, zone).strftime("%d.%m.%Y %H:%M")
    except (TypeError, ValueError, OSError, OverflowError):
        return ""


def shorten(text: str, most: int) -> str:
    """The end of a text in at most so many characters, a mark in place of its beginning."""
    return text if len(text) <= most else "…" + text[len(text) - most + 1 :]


def thousands(n: int) -> str:
    return f"{n:,}".replace(",", "\xa0")


def parse_date_ms(text: str, end_of_day: bool = False, zone: dt.tzinfo | None = None) -> int | None:
    """Milliseconds of "2024-03-15", "15.03.2024", each with or without " 14:30"; dates alone at the start or end of day."""
    for form, whole in (("%Y-%m-%d %H:%M", False), ("%d.%m.%Y %H:%M", False), ("%Y-%m-%d", True), ("%d.%m.%Y", True)):
        try:
            d = dt.datetime.strptime(text.strip(), form)
        except ValueError:
            continue
        if whole and end_of_day:
            d = d.replace(hour=23, minute=59, second=59)
        return max(0, int(d.replace(tzinfo=zone or dt.datetime.now().astimezone().tzinfo).timestamp() * 1000))
    return None


def serial_text(serial: float, epoch_1904: bool = False) -> str | None:
    """A spreadsheet's date number as "15.03.2024 2024-03-15[ 14:30]", less than a day as a time; None out of range."""
    if serial < 0:
        return None
    seconds = round(serial * 86400)
    if serial < 1:
        return f"{seconds // 3600 % 24:02d}:{seconds // 60 % 60:02d}"
    try:
        d = (dt.datetime(1904, 1, 1) if epoch_1904 else dt.datetime(1899, 12, 30)) + dt.timedelta(seconds=seconds)
    except OverflowError:
        return None
    if not 1900 <= d.year <= 2200:
        return None
    clock = f" {d:%H:%M}" if d.hour or d.minute or d.second else ""
    return f"{d:%d.%m.%Y} {d:%Y-%m-%d}{clock}"


def serial_text_column(serial: Column) -> Column:
    day = F.expr("date'1899-12-30'")
    seconds = F.round(serial * 86400).cast("long")
    date = F.date_add(day, (seconds / 86400).cast("int"))
    rest = seconds % 86400
    clock = F.format_string("%02d:%02d", (rest / 3600).cast("int"), (rest / 60 % 60).cast("int"))
    both = F.concat(F.date_format(date, "dd.MM.yyyy"), F.lit(" "), F.date_format(date, "yyyy-MM-dd"))
    return F.when(serial < 0, F.lit(None)).when(serial < 1, clock).when((F.year(date) < 1900) | (F.year(date) > 2200), F.lit(None)).when(rest == 0, both).otherwise(F.concat(both, F.lit(" "), clock))


def is_date_format(number: int, code: str | None = None) -> bool:
    """Whether a number format shows a date: a built-in one, or y, d, m, h, s outside quotes, brackets and escapes."""
    if code is None:
        return number in BUILTIN_DATES
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "", code).lower()
    return "general" not in bare and bool(re.search("[ydmhs]", bare))


def number_text(v: float) -> str:
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


def natural_key(name: str) -> tuple[str, int]:
    m = re.search(r"(\d+)(?:\.[^.]*)?$", name)
    return (name[: m.start()], int(m[1])) if m else (name, 0)


def natural_order(name: Column) -> list[Column]:
    number = F.regexp_extract(name, r"(\d+)(?:\.[^.]*)?$", 1)
    prefix = F.when(number == "", name).otherwise(F.regexp_replace(name, r"\d+(?:\.[^.]*)?$", ""))
    return [prefix, F.coalesce(number.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))]


def natural_positions(names: DataFrame, column: str) -> DataFrame:
    """(column, pos): the place of every distinct name in natural order, from 1. Names are sorted in key ranges spread over
    the cluster; a name's place is its place within its range behind the counts of the ranges before, of which there is one
    row each. Null is no name and gets no place."""
    order = [*natural_order(F.col(column)), F.col(column)]
    distinct = names.where(F.col(column).isNotNull()).select(column).distinct().select(column, *(o.alias(f"_o{i}") for i, o in enumerate(order[:-1])))
    keys = ["_o0", "_o1", column]
    parts = distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")
    # A range is read twice, for its count and for its rows, so it is cut: sampled bounds could differ otherwise.
    ranged = cut(distinct.repartitionByRange(int(parts), *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_range").select(column, (F.col("_before") + F.col("_own")).cast("long").alias("pos"))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{IsAlphabetic}]", ""))
