"""Dates: half-open ranges, plausible dates in names, ages against a given day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_range(at: Column, since: str | None = None, until: str | None = None) -> Column:
    """since <= at < until; an absent bound doesn't bind, a null `at` isn't in any range."""
    out = F.lit(True)
    if since is not None:
        out = out & (at >= F.lit(since))
    if until is not None:
        out = out & (at < F.lit(until))
    return F.coalesce(out, F.lit(False)) if since is not None or until is not None else F.lit(True)


def any_in_range(dates: list[Column], since: str | None, until: str | None) -> Column:
    """Whether any of the dates lies in the range; rows without any date are kept."""
    known = [in_range(d, since, until) for d in dates]
    out, none = known[0], dates[0].isNull()
    for k, d in zip(known[1:], dates[1:], strict=True):
        out, none = out | k, none & d.isNull()
    return none | out


def day_in_name(name: Column) -> Column:
    """The first YYYY-MM-DD of 1990 to 2099 in a name that is a real day, as a date."""
    return F.try_to_date(F.nullif(F.regexp_extract(name, r"(?<!\d)((?:199\d|20\d\d)-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))(?!\d)", 1), F.lit("")), "yyyy-MM-dd")


def source_dates(birth: Column, modified: Column, name: Column) -> Column:
    """struct(created, modified): birth or modification time, else the name's date."""
    return F.struct(F.coalesce(F.to_date(birth), F.to_date(modified), day_in_name(name)).alias("created"), F.coalesce(F.to_date(modified), day_in_name(name)).alias("modified"))


def parse_day(text: Column) -> Column:
    """A day from several spellings; the first ten characters decide for ISO ones."""
    t = F.trim(text)
    return F.coalesce(F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"), F.try_to_date(t, "dd/MM/yyyy"), F.try_to_date(t, "yyyy/MM/dd"), F.try_to_date(t, "d MMM yyyy"))


def age_days(day: Column, as_of: str) -> Column:
    return F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), day))


def message_date(date: Column, resent: Column, received: Column) -> Column:
    """The first header that holds a date: Date, Resent-Date, then what follows the last ; of Received. All as UTC."""

    def read(c: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.regexp_replace(c, r"^\s*[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)\s*$", ""))
        return F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")))

    return F.coalesce(read(date), read(resent), read(F.substring_index(received, ";", -1)))
