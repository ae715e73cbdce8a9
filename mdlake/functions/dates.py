"""Dates of frontmatter fields, always relative to an explicit ``as_of``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# ten characters that are a date whatever follows, or a shorter one that is all or has a time of day behind it
_TEN = r"^(\d{4}-\d{2}-\d{2})"
_SHORT = r"^(\d{4}-\d{1,2}-\d{1,2})(?:(?:[Tt]|[ \t]+)\d{1,2}:\d\d.*)?$"


def day(raw: Column) -> Column:
    """The date a value starts with, NULL where it is none."""
    found = F.coalesce(F.nullif(F.regexp_extract(raw, _TEN, 1), F.lit("")), F.regexp_extract(raw, _SHORT, 1))
    return found.try_cast("date")


def as_date(as_of: dt.date | str) -> Column:
    return F.lit(str(as_of)).cast("date")


def days_since(day_col: Column, as_of: dt.date | str) -> Column:
    """Age in days; an unknown date counts as reviewed today."""
    return F.coalesce(F.date_diff(as_date(as_of), day_col), F.lit(0))


def age_text(day_col: Column, as_of: dt.date | str) -> Column:
    """'today', 'yesterday', days, months of 30 or years of 365 days; '' if unknown."""
    days = F.date_diff(as_date(as_of), day_col)
    return (
        F.when(days.isNull(), "")
        .when(days <= 0, "today")
        .when(days == 1, "yesterday")
        .when(days < 30, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(days < 365, F.concat(F.floor(days / 30).cast("string"), F.lit(" months ago")))
        .otherwise(F.concat(F.floor(days / 365).cast("string"), F.lit(" years ago")))
    )


def date_text(day_col: Column, raw: Column) -> Column:
    """The field as text: a date or time stamp as ISO day, '' where nothing is given."""
    stamped = raw.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[Tt ].*\d:\d\d")
    return F.when(stamped & day_col.isNotNull(), F.date_format(day_col, "yyyy-MM-dd")).otherwise(F.coalesce(raw, F.lit("")))
