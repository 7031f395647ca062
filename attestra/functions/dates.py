"""Date rules. The date of judgement is always an argument, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def review_due(last: Column, open_items: Column, asof: Column, days: int = 7) -> Column:
    """Due if something is open and the last review is unknown or at least ``days`` ago."""
    at = F.call_function("try_to_date", last)
    return (open_items > 0) & (at.isNull() | (F.datediff(asof, at) >= days))


def first_date(text: Column) -> Column:
    """The first ISO date inside a text, as a string; empty without one."""
    return F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0)


def archivable(status: Column, asof: Column) -> Column:
    """Resolved (actioned or declined) on a date before asof."""
    at = first_date(status)
    return F.upper(status).rlike("ACTIONED|DECLINED") & (at != "") & (at < F.date_format(asof, "yyyy-MM-dd"))


def recent_folder(name: Column, asof: Column, days: int) -> Column:
    """A folder named yyyyMMdd that isn't older than ``days``; false for other names and for no days."""
    at = F.when(name.rlike(r"^\d{8}$"), F.call_function("try_to_date", name, F.lit("yyyyMMdd")))
    return F.coalesce(at >= F.date_sub(asof, days), F.lit(False)) & F.lit(days > 0)


def off_cooldown(ignored: Column, asof: Column, days: int = 1) -> Column:
    """Never ignored, or longer ago than the cooldown."""
    return ignored.isNull() | (F.datediff(asof, ignored) > days)
