"""Calendar days as strict ISO strings, and the lines written from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from itinera.functions.text import trimmed

# Month names.
MONTHS = "January February March April May June July August September October November December".split()


def parse_day(text: Column) -> Column:
    """The day of a strict YYYY-MM-DD string, else null; years before 100 are real years."""
    said = trimmed(text)
    return F.when(said.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(said, "yyyy-MM-dd"))


def nights(arrive: Column, depart: Column) -> Column:
    """Nights between two days; null if one is missing or they are the wrong way round."""
    n = F.datediff(depart, arrive)
    return F.when(n >= 0, n)


def nights_text(n: Column) -> Column:
    return F.when(n == 1, "1 night").when(n > 1, F.concat(n.cast("string"), F.lit(" nights"))).otherwise("")


def _month(day: Column, form: str) -> Column:
    names = {"long": MONTHS, "short": [m[:3] for m in MONTHS], "upper": [m.upper() for m in MONTHS]}[form]
    return F.element_at(F.array(*map(F.lit, names)), F.month(day))


def _part(day: Column, *parts: str) -> Column:
    pick = {"d": F.dayofmonth(day).cast("string"), "y": F.year(day).cast("string")}
    return F.concat_ws(" ", *[pick[p] if p in pick else _month(day, p) for p in parts])


def stay_line(arrive: Column, depart: Column) -> Column:
    """The line under a stop: one day, a range, or a single end."""
    n = nights(arrive, depart)
    tail = F.when(n > 0, F.concat(F.lit(" · "), nights_text(n))).otherwise("")
    same_year = F.year(arrive) == F.year(depart)
    same_month = same_year & (F.month(arrive) == F.month(depart))
    dash = F.lit(" – ")
    return (
        F.when(arrive.isNull() & depart.isNull(), "")
        .when(depart.isNull(), F.concat(F.lit("Arrived "), _part(arrive, "d", "long", "y")))
        .when(arrive.isNull(), F.concat(F.lit("Departed "), _part(depart, "d", "long", "y")))
        .when(arrive == depart, _part(arrive, "d", "long", "y"))
        .when(same_month, F.concat(_part(arrive, "d"), F.lit("–"), _part(depart, "d", "long", "y"), tail))
        .when(same_year, F.concat(_part(arrive, "d", "short"), dash, _part(depart, "d", "short", "y"), tail))
        .otherwise(F.concat(_part(arrive, "d", "short", "y"), dash, _part(depart, "d", "short", "y"), tail))
    )


def range_plate(start: Column, end: Column) -> Column:
    """The title plate of a trip: its months in capitals."""
    end = F.coalesce(end, start)
    return (
        F.when(start.isNull(), "")
        .when(F.year(start) != F.year(end), F.concat(_part(start, "upper", "y"), F.lit(" — "), _part(end, "upper", "y")))
        .when(F.month(start) != F.month(end), F.concat(_month(start, "upper"), F.lit(" — "), _month(end, "upper"), F.lit(" · "), _part(start, "y")))
        .otherwise(F.concat(_month(start, "upper"), F.lit(" · "), _part(start, "y")))
    )


def exif_time(text: Column) -> Column:
    """Wall-clock time of ``YYYY:MM:DD HH:MM:SS`` text; days beyond a month's end roll over."""
    pattern = r"^(\d{4}):(\d{2}):(\d{2})[ T](\d{2}):(\d{2}):(\d{2})"
    y, mo, d, h, mi, s = (F.regexp_extract(text, pattern, i).try_cast("int") for i in range(1, 7))
    month = F.add_months(F.make_date(y, F.lit(1), F.lit(1)), mo - 1)
    seconds = (d - 1) * 86400 + h * 3600 + mi * 60 + s
    rolled = F.make_timestamp_ntz(F.year(month), F.month(month), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.when(text.rlike(pattern) & (y > 0), rolled)


def utc_day(micros: Column) -> Column:
    """YYYY-MM-DD of microseconds since the epoch; empty for null."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / 86_400_000_000).cast("int"))
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))


def micros_of(wall: Column) -> Column:
    """Microseconds from 1970-01-01 00:00 to a wall-clock time (timestamp_ntz), whatever the session's time zone."""
    span = wall.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.extract(F.lit("DAY"), span).cast("long") * 86_400 + F.extract(F.lit("HOUR"), span) * 3600 + F.extract(F.lit("MINUTE"), span) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), span) * 1_000_000).cast("long")


def era_year(text: Column, start: Column, end: Column) -> Column:
    """The year that an era's display text names (BCE is negative), or the middle of its window."""
    said = trimmed(F.coalesce(text, F.lit("")))
    year = F.regexp_extract(said, r"(-?\d+)", 1).try_cast("int")
    named = F.when(said.rlike("(?i)BCE"), -F.abs(year)).otherwise(year)
    return F.coalesce(named, F.floor((start + end) / 2 + 0.5).cast("int"))


def photo_time(original: Column, created: Column, modified: Column) -> Column:
    """The first of three EXIF texts that is there, as wall-clock time."""
    return exif_time(F.coalesce(*[F.nullif(t, F.lit("")) for t in (original, created, modified)]))
