"""Status rules of job runs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from runloom.schemas import NON_TERMINAL_STATUSES, TERMINAL_STATUSES

# Broker states stored as they are, and those stored as waiting.
STORED_STATES = ["completed", "failed", "active", "waiting", "delayed", "prioritized", "waiting-children"]
STATES_STORED_AS_WAITING = ["wait", "paused"]


def is_terminal(status: Column) -> Column:
    return status.isin(TERMINAL_STATUSES)


def is_open(status: Column) -> Column:
    return status.isin(NON_TERMINAL_STATUSES)


def normalise_state(state: Column) -> Column:
    """Stored status of a broker state; NULL when the state says nothing."""
    return F.when(state.isin(STORED_STATES), state).when(state.isin(STATES_STORED_AS_WAITING), F.lit("waiting"))


def derive_status(state: Column, finished_on: Column, failed_reason: Column, phase: Column) -> Column:
    """State first, then the finish time and failure text, then the phase."""
    failed = F.coalesce(failed_reason != "", F.lit(False))
    finished = F.coalesce(finished_on != 0, F.lit(False))
    return F.coalesce(
        normalise_state(state),
        F.when(finished, F.when(failed, F.lit("failed")).otherwise(F.lit("completed"))),
        F.when(phase == "waiting", F.lit("waiting")),
        F.lit("active"),
    )
