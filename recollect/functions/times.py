"""Dates and times as text and back. ``now`` is always given by the caller."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(now: str | Column) -> Column:
    return F.lit(now).cast("timestamp") if isinstance(now, str) else now


def message_tag(ts: Column, now: str | Column) -> Column:
    """``[HH:mm]`` the same day, ``[MM-dd HH:mm]`` within a week, ``[MM-dd]`` before."""
    days = F.datediff(F.to_date(at(now)), F.to_date(ts))
    fmt = F.when(days == 0, F.date_format(ts, "HH:mm")).when(
        days < 7, F.date_format(ts, "MM-dd HH:mm")).otherwise(F.date_format(ts, "MM-dd"))
    return F.concat(F.lit("["), fmt, F.lit("]"))


def date_tag(date_text: Column, now: str | Column) -> Column:
    """今日 / 昨天 / MM-dd; text that is no date stays as it is."""
    d = F.when(date_text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(date_text, "yyyy-M-d"))
    days = F.datediff(F.to_date(at(now)), d)
    tag = F.when(days == 0, F.lit("今日")).when(days == 1, F.lit("昨天")).otherwise(F.date_format(d, "MM-dd"))
    return F.when(d.isNull(), F.coalesce(date_text, F.lit(""))).otherwise(tag)


def normal_date(c: Column) -> Column:
    """``2026/6/1`` to ``2026-06-01``; other text unchanged."""
    parts = F.split(F.replace(c, F.lit("/"), F.lit("-")), "-")
    padded = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    return F.when(c.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$"), padded).otherwise(c)


def epoch_seconds(c: Column) -> Column:
    """Seconds from a numeric text or an ISO time; null when it is neither."""
    number = c.try_cast("double")
    iso = F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))
    return F.coalesce(number, F.unix_micros(iso) / 1e6)


def shown_time(c: Column) -> Column:
    """Epoch or ISO text as ``yyyy-MM-dd HH:mm:ss``; other text cut to 19 characters."""
    return F.coalesce(F.date_format(F.timestamp_seconds(epoch_seconds(c)), "yyyy-MM-dd HH:mm:ss"), F.substring(c, 1, 19))
