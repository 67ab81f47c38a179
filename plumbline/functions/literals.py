"""Driver-side reconciliation of literals with column types, so that no cast can fail at run time."""

from __future__ import annotations

import re
from datetime import UTC, date, datetime, timedelta
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.model import ContractError

#: What ``literal_for`` returns for a literal that no value of the type can equal.
UNUSABLE = object()
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATS = (T.FloatType, T.DoubleType)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
STRINGS = (T.StringType, T.CharType, T.VarcharType)
_STEP = re.compile(r"\s*(\d+(?:\.\d+)?)\s*(weeks?|w|days?|d|hours?|hrs?|h|minutes?|mins?|m|seconds?|secs?|s)\s*", re.I)
_SECONDS = {"w": 604_800, "d": 86_400, "h": 3_600, "m": 60, "s": 1}


def col(name: str) -> Column:
    """A top-level column of any name."""
    return F.col("`" + name.replace("`", "``") + "`")


def moment(value: Any) -> datetime | None:
    """A datetime of a date, datetime or ISO text; naive values keep no zone."""
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    if isinstance(value, str):
        try:
            return datetime.fromisoformat(value.strip())
        except ValueError:
            return None
    return None


def literal_for(value: Any, kind: T.DataType) -> Any:
    """``value`` as a Python value of the column type, or ``UNUSABLE``."""
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else UNUSABLE
    if isinstance(kind, STRINGS):
        return value if isinstance(value, str) else UNUSABLE
    if isinstance(kind, NUMBERS):
        if isinstance(value, bool) or not isinstance(value, int | float | Decimal):
            return UNUSABLE
        if isinstance(kind, T.DecimalType):
            try:
                return Decimal(str(value))
            except InvalidOperation:
                return UNUSABLE
        return value
    if isinstance(kind, TIMES):
        at = moment(value)
        if at is None:
            return UNUSABLE
        if isinstance(kind, T.DateType):
            return at.date() if at.time() == datetime.min.time() else at.replace(tzinfo=None)
        if isinstance(kind, T.TimestampNTZType):
            return at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at
        return at if at.tzinfo else at.replace(tzinfo=UTC)
    return UNUSABLE


def time_literal(value: datetime, kind: T.DataType) -> Column:
    """A temporal literal of the column's own type; no session time zone takes part."""
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(int((value - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))))
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value.isoformat()
    return F.lit(text).cast("date" if isinstance(kind, T.DateType) and not isinstance(value, datetime) else "timestamp_ntz")


def duration(text: str | int | float | timedelta) -> timedelta:
    """``1h30m``, ``7 days``, ``2w`` and the like; plain numbers are seconds."""
    if isinstance(text, timedelta):
        return text
    if isinstance(text, int | float) and not isinstance(text, bool):
        return timedelta(seconds=text)
    total, at = 0.0, 0
    said = str(text)
    while at < len(said):
        m = _STEP.match(said, at)
        if not m:
            raise ContractError(f"{text!r} isn't a duration")
        total += float(m[1]) * _SECONDS[m[2][0].lower()]
        at = m.end()
    if not at or total <= 0:
        raise ContractError(f"{text!r} isn't a duration")
    return timedelta(seconds=total)
