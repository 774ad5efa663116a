"""Range predicates that also reach the partitions of a stored table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from runloom.functions.time import is_stored_instant, naive_utc, ts


def created_between(
    df: DataFrame, start: datetime | None, end: datetime | None, inclusive_end: bool = False
) -> DataFrame:
    """Rows created from ``start`` on and before (or up to) ``end``.

    Stored tables are partitioned by ``created_date``; where that column is
    present the same bounds are put on it, so whole days are never listed.
    """
    created = F.col("created_at")
    dated = "created_date" in df.columns
    if start is not None:
        df = df.filter(created >= ts(start))
        if dated:
            df = df.filter(F.col("created_date") >= F.lit(naive_utc(start).date()))
    if end is not None:
        df = df.filter(created <= ts(end) if inclusive_end else created < ts(end))
        if dated:
            df = df.filter(F.col("created_date") <= F.lit(naive_utc(end).date()))
    return df


def of_dates(df: DataFrame, moments: DataFrame, column: str) -> DataFrame:
    """Rows of the creation dates that a column of another frame names, if the table is stored by date.

    Spark prunes the other dates at run time. One row per date of the calendar
    at most is sent to the tasks.
    """
    if "created_date" not in df.columns:
        return df
    dates = moments.filter(is_stored_instant(F.col(column))).select(F.to_date(column).alias("created_date")).distinct()
    return df.join(F.broadcast(dates), "created_date", "left_semi")
