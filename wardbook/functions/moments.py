"""Typed date arguments and the date windows the reports use."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

Moment = str | date | datetime


def required(value, name: str):
    """Return ``value``, or raise if the caller left it out."""
    if value is None or value == "":
        raise ValueError(f"missing required parameter: {name}")
    return value


def parse_moment(value: Moment, name: str) -> datetime:
    """Read a ``YYYY-MM-DD`` text, a date or a datetime; anything else is a ValueError."""
    required(value, name)
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    try:
        return datetime.strptime(value, "%Y-%m-%d")
    except (TypeError, ValueError) as error:
        raise ValueError(f"{name} must be a YYYY-MM-DD date, got {value!r}") from error


def literal(moment: datetime) -> Column:
    """A zone-free timestamp literal, of the same type as the date columns."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def from_until(column: Column, start: Moment, end: Moment) -> Column:
    """Half-open window: the end day is left out."""
    first, last = parse_moment(start, "start"), parse_moment(end, "end")
    return (column >= literal(first)) & (column < literal(last))


def from_through(column: Column, start: Moment, end: Moment) -> Column:
    """Closed window on the two moments: of the end day only 00:00 is in."""
    first, last = parse_moment(start, "start"), parse_moment(end, "end")
    return column.between(literal(first), literal(last))


def now_or(as_of: Moment | None) -> Column:
    """The moment a report is run at; the session's clock unless given."""
    if as_of is None:
        return F.localtimestamp()
    return literal(parse_moment(as_of, "as_of"))


def last_days(column: Column, as_of: Moment | None, days: int = 30) -> Column:
    """Rolling window of whole days back from ``as_of``, time of day included, open to the future."""
    if as_of is None:
        return column >= F.localtimestamp() - F.expr(f"interval {days} days")
    return column >= literal(parse_moment(as_of, "as_of") - timedelta(days=days))


def start_of_day(column: Column) -> Column:
    """Midnight of the column's day, still a zone-free timestamp.

    Goes through the date type, because ``date_trunc`` would pass through the
    session's time zone.
    """
    return column.cast("date").cast("timestamp_ntz")
