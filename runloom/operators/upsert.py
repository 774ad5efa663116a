"""Folding job events into the runs table.

Applying events one by one in arrival order has a closed form per run key:

* status: the last terminal status if there was one, else the last status;
* tags: the last non-empty tags, else none;
* every other column: its value in the last event.

The three parts are ``max_by`` aggregates, which combine on the map side; a key
with very many events is reduced before it is shuffled.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from runloom.functions.status import is_terminal
from runloom.functions.text import run_id
from runloom.functions.time import duration_ms, naive_utc, ts
from runloom.operators.pruning import of_dates
from runloom.schemas import RUN_KEY, RUN_VALUES

OP = "_op"
BEFORE = "_before"
# Columns of a fold state. States of one key combine to the state of all events.
STATE = ["_last", "_last_seq", "_terminal", "_terminal_seq", "_tags", "_tags_seq"]


def within_retention(events: DataFrame, as_of: datetime, retention: timedelta | None) -> DataFrame:
    """Drop events older than the retention; rows without a time stay."""
    if retention is None:
        return events
    moment = F.coalesce("created_at", "enqueued_at")
    return events.filter(moment.isNull() | (moment >= ts(naive_utc(as_of) - retention)))


def last_in_batch(events: DataFrame, batch: str, order: str = "seq") -> DataFrame:
    """Only the last event of each run key within a batch survives."""
    columns = [c for c in events.columns if c not in [*RUN_KEY, batch]]
    last = events.groupBy(*RUN_KEY, batch).agg(F.max_by(F.struct(*columns), order).alias("_row"))
    return last.select(*RUN_KEY, batch, "_row.*")


def fold_states(events: DataFrame, order: str = "seq") -> DataFrame:
    """One mergeable state per run key, so that batches can be folded apart."""
    terminal, tagged = is_terminal(F.col("status")), F.size("tags") > 0
    return events.groupBy(*RUN_KEY).agg(
        F.max_by(F.struct("status", *RUN_VALUES), order).alias("_last"),
        F.max(order).alias("_last_seq"),
        F.max_by("status", F.when(terminal, F.col(order))).alias("_terminal"),
        F.max(F.when(terminal, F.col(order))).alias("_terminal_seq"),
        F.max_by("tags", F.when(tagged, F.col(order))).alias("_tags"),
        F.max(F.when(tagged, F.col(order))).alias("_tags_seq"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """Combine states of the same key, in whatever order they come."""
    return states.groupBy(*RUN_KEY).agg(
        F.max_by("_last", "_last_seq").alias("_last"),
        F.max("_last_seq").alias("_last_seq"),
        F.max_by("_terminal", "_terminal_seq").alias("_terminal"),
        F.max("_terminal_seq").alias("_terminal_seq"),
        F.max_by("_tags", "_tags_seq").alias("_tags"),
        F.max("_tags_seq").alias("_tags_seq"),
    )


def runs_of_states(states: DataFrame) -> DataFrame:
    """Run rows of fold states."""
    rows = states.select(
        *RUN_KEY,
        F.coalesce("_terminal", "_last.status").alias("status"),
        F.coalesce("_tags", F.array().cast("array<string>")).alias("tags"),
        *[F.col(f"_last.{c}").alias(c) for c in RUN_VALUES],
    )
    return complete(rows)


def complete(rows: DataFrame) -> DataFrame:
    """Add the id and the duration that follow from the other columns."""
    return rows.withColumns({"id": run_id(), "duration_ms": duration_ms()})


def fold(events: DataFrame, order: str = "seq", semantics: str = "per_event", batch: str = "batch_id") -> DataFrame:
    """Events to run rows.

    ``per_event`` applies every event in order. ``last_in_batch`` first keeps
    only the last event of a key in each batch, so that an earlier terminal
    event of the same batch is lost.
    """
    if semantics == "last_in_batch":
        events = last_in_batch(events, batch, order)
    elif semantics != "per_event":
        raise ValueError(f"unknown semantics: {semantics}")
    return runs_of_states(fold_states(events, order))


def _old(c: str) -> Column:
    return F.col(f"_o_{c}")


def _merged(c: str) -> Column:
    """Value of a column after the incoming row meets the stored one."""
    if c == "status":
        keep = is_terminal(_old("status")) & ~is_terminal(F.col("status"))
        return F.when(F.coalesce(keep, F.lit(False)), _old("status")).otherwise(F.col("status"))
    if c == "tags":
        tagged = F.coalesce(F.size("tags") > 0, F.lit(False))
        return F.when(tagged | F.col("_stored").isNull(), F.col("tags")).otherwise(_old("tags"))
    return F.col(c)


def _merge(current: DataFrame, incoming: DataFrame, how: str, images: bool = False) -> DataFrame:
    values = ["status", "tags", *RUN_VALUES]
    old = current.select(*RUN_KEY, *[F.col(c).alias(f"_o_{c}") for c in values], F.lit(True).alias("_stored"))
    new = incoming.select(*RUN_KEY, *values, F.lit(True).alias("_fresh"))
    both = new.join(old, RUN_KEY, how)
    fresh, stored = F.col("_fresh").isNotNull(), F.col("_stored").isNotNull()
    merged = {c: F.when(fresh, _merged(c)).otherwise(_old(c)) for c in values}
    same = F.lit(True)
    for c in values:
        same = same & merged[c].eqNullSafe(_old(c))
    op = F.when(~stored, F.lit("insert")).when(~fresh | same, F.lit("keep")).otherwise(F.lit("update"))
    rows = [*RUN_KEY, *[merged[c].alias(c) for c in values], op.alias(OP)]
    if images:
        rows.append(F.when(op == "update", F.struct(*[_old(c).alias(c) for c in values])).alias(BEFORE))
    return complete(both.select(*rows))


def upsert_runs(current: DataFrame, incoming: DataFrame, images: bool = False) -> DataFrame:
    """The whole table after the upsert, with what happened to each row.

    ``incoming`` holds a key once (the outcome of a fold). Updates that would
    change nothing count as kept. With ``images`` updated rows say in
    ``_before`` what they held.
    """
    return _merge(current, incoming, "full_outer", images)


def upsert_changes(current: DataFrame, incoming: DataFrame, images: bool = False) -> DataFrame:
    """Only the inserted and updated rows; with ``images`` also what each held before, in ``_before``.

    The stored table is first cut to the keys of the batch, a semi join that
    Spark broadcasts while the batch is small, so the table itself is not
    shuffled.
    """
    touched = current.join(incoming.select(*RUN_KEY), RUN_KEY, "left_semi")
    return _merge(touched, incoming, "left", images).filter(F.col(OP) != "keep")


def touched_dates(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored runs of the dates a batch falls on.

    A run is stored under the date of its creation, which is part of its key, so
    no other partition can hold a run of the batch. Spark prunes the others at
    run time from the (few) dates of the batch.
    """
    return of_dates(current, incoming, "enqueued_at")


def change_feed(changes: DataFrame) -> DataFrame:
    """Ids and statuses to announce after an upsert."""
    return changes.filter(F.col(OP) != "keep").select("id", "status")
