"""Timestamp arithmetic on UTC ``TIMESTAMP_NTZ`` columns."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

HOUR = timedelta(hours=1)
DAY = timedelta(days=1)
# Epoch milliseconds beyond this, before or after 1970, are no instant.
LAST_MS = 8_640_000_000_000_000


def ts(value: datetime) -> Column:
    """A literal ``TIMESTAMP_NTZ``; aware datetimes are taken to UTC first.

    It goes through text because a datetime literal would be read in the time
    zone of this machine.
    """
    return F.lit(naive_utc(value).isoformat(sep=" ")).cast("timestamp_ntz")


def naive_utc(value: datetime) -> datetime:
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return value


def from_epoch_ms(column: Column) -> Column:
    return F.timestamp_millis(column).cast("timestamp_ntz")


def is_instant(milliseconds: Column) -> Column:
    return milliseconds.between(-LAST_MS, LAST_MS)


def from_any_epoch_ms(milliseconds: Column) -> Column:
    """The instant of a number from outside; NULL where it is none."""
    return from_epoch_ms(F.when(is_instant(milliseconds), milliseconds).try_cast("long"))


def is_stored_instant(column: Column) -> Column:
    """A comparison that holds for every instant.

    Spark prunes partitions at run time only by a side with a comparison on it.
    """
    return column >= from_epoch_ms(F.lit(-LAST_MS))


def to_epoch_ms(column: Column) -> Column:
    return F.unix_millis(column.cast("timestamp"))


def epoch_ms(value: datetime) -> int:
    return (naive_utc(value) - datetime(1970, 1, 1)) // timedelta(milliseconds=1)


def instant(milliseconds: int) -> datetime:
    return datetime(1970, 1, 1) + timedelta(milliseconds=milliseconds)


def millis_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", start, end)


def duration_ms() -> Column:
    """The generated column; NULL where the difference does not fit an INT."""
    return millis_between(F.col("started_at"), F.col("finished_at")).try_cast("int")


def wait_ms() -> Column:
    """Time a run spent queued: its wait pressure."""
    return millis_between(F.col("enqueued_at"), F.col("started_at"))


def trunc(unit: str, column: Column) -> Column:
    # date_trunc gives a zoned TIMESTAMP; in a UTC session the cast is exact.
    return F.date_trunc(unit, column).cast("timestamp_ntz")


def floor_to(unit: str, value: datetime) -> datetime:
    value = naive_utc(value).replace(minute=0, second=0, microsecond=0)
    return value.replace(hour=0) if unit == "day" else value


def label(column: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, the form in which charts carry instants."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


@dataclass(frozen=True)
class Window:
    """Bounds of a dashboard question."""

    start: datetime
    end: datetime
    grain: str

    @property
    def step(self) -> Column:
        return F.expr("interval 1 hour" if self.grain == "hour" else "interval 1 day")


def dashboard_window(as_of: datetime, days: int) -> Window:
    """The last ``days`` days up to ``as_of``: hour grain up to a week, else day grain."""
    grain = "hour" if days <= 7 else "day"
    end = naive_utc(as_of)
    return Window(floor_to(grain, end - days * DAY), end, grain)


def pressure_bounds(as_of: datetime, days: int) -> tuple[datetime, datetime]:
    """Half-open range of closed hours over which pressure is weighed."""
    end = naive_utc(as_of)
    return floor_to("hour", end - days * DAY), floor_to("hour", end)


def _clock(text: str) -> str:
    """The time part of ISO text, without its zone; empty for a bare date."""
    clock = text.upper().partition("T")[2].rstrip("Z")
    return clock.partition("+")[0].partition("-")[0]


def created_boundary(value: str, upper: bool = False) -> datetime:
    """Read one end of a created-at range given as text.

    A bare date means its first or last millisecond, text without a zone is UTC,
    and an upper end given to the minute, without a zone, includes that whole
    minute.
    """
    moment = datetime.fromisoformat(value)
    clock = _clock(value)
    if upper and not clock:
        moment += DAY - timedelta(milliseconds=1)
    elif upper and moment.tzinfo is None and clock.count(":") == 1:
        moment += timedelta(seconds=59, milliseconds=999)
    return naive_utc(moment)


def created_boundary_column(value: Column, upper: bool = False) -> Column:
    """The same reading for a column of texts; unreadable text gives NULL."""
    clock = F.substring_index(value, "T", -1)
    dated = ~value.contains("T")
    zoned = ~dated & (clock.contains("+") | clock.contains("-") | F.upper(clock).endswith("Z"))
    # Spark's cast wants seconds and a colon in the offset, the standard library neither.
    hands = F.when(zoned, F.regexp_extract(clock, "^[0-9:.]+", 0)).otherwise(clock)
    to_minute = F.length(hands) == 5
    offset = F.regexp_replace(F.substring(clock, F.length(hands) + 1, F.lit(6)), "^([+-]..)(..)$", "$1:$2")
    whole = F.concat(F.substring_index(value, "T", 1), F.lit("T"), hands, F.when(to_minute, ":00").otherwise(""),
                     F.when(zoned, offset).otherwise("Z"))
    moment = F.when(dated, F.concat(value, F.lit("T00:00:00Z"))).otherwise(whole).try_cast("timestamp").cast("timestamp_ntz")
    if not upper:
        return moment
    more = F.when(dated, F.lit(86_399_999)).when(~zoned & to_minute, F.lit(59_999)).otherwise(F.lit(0))
    return F.timestamp_add("MILLISECOND", more, moment)
