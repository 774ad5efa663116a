"""Keyset pages: one row more than asked tells whether another page follows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_LIMIT = 100
_NO = "_no"


@dataclass(frozen=True)
class Page:
    """``rows`` in display order under ``position``; ``cursors`` is one row."""

    rows: DataFrame
    cursors: DataFrame


def check_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must lie between 1 and {MAX_LIMIT}")
    return limit


def check_choice(what: str, value: str, choices: list[str]) -> str:
    if value not in choices:
        raise ValueError(f"{what} must be one of {', '.join(choices)}")
    return value


def flipped(direction: str, cursor_direction: str) -> str:
    """Sort direction of the scan: going back reads the order from its other end."""
    if cursor_direction == "next":
        return direction
    return "asc" if direction == "desc" else "desc"


def ordered(column: Column, direction: str) -> Column:
    return column.asc() if direction == "asc" else column.desc()


def cut_page(
    candidates: DataFrame, order: list[Column], limit: int, direction: str, has_cursor: bool, cursor: dict[str, Column]
) -> Page:
    """Take the first ``limit`` rows of the scan order and work out the cursors.

    The sort with its limit is a top-k per partition, so only ``limit + 1`` rows
    per task reach the last stage; everything after it works on those.
    """
    fetched = candidates.orderBy(*order).limit(limit + 1)
    numbered = fetched.withColumn(_NO, F.row_number().over(Window.orderBy(*order)))
    shown = F.col(_NO) <= limit
    going_back = direction == "prev"
    rows = numbered.filter(shown)
    position = F.count(F.lit(1)).over(Window.partitionBy()) - F.col(_NO) + 1 if going_back else F.col(_NO)
    rows = rows.withColumn("position", position.cast("int")).drop(_NO)

    place = F.when(shown, F.col(_NO))
    row = F.struct(*[column.alias(name) for name, column in cursor.items()])
    extra = F.max(_NO) > limit
    nearest, farthest = F.min_by(row, place), F.max_by(row, place)
    first, last = (farthest, nearest) if going_back else (nearest, farthest)
    more_after = F.lit(has_cursor) if going_back else extra
    more_before = extra if going_back else F.lit(has_cursor)
    both = numbered.agg(F.when(more_after, last).alias("next"), F.when(more_before, first).alias("prev"))
    flat = [F.col(f"{side}.{name}").alias(f"{side}_{name}") for side in ("next", "prev") for name in cursor]
    return Page(rows, both.select(*flat))
