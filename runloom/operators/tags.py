"""The tag catalogue."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from runloom.functions.text import like_pattern
from runloom.functions.time import naive_utc, ts
from runloom.operators.pruning import created_between

LOOK_BACK = timedelta(hours=1)
# Fixed values of the search: shortest text, and the most tags returned.
MIN_SEARCH_LENGTH = 2
MAX_TAGS = 100


def tag_catalogue(runs: DataFrame, as_of: datetime, since: datetime | None = None) -> DataFrame:
    """Each tag with the creation time of the last run that carries it."""
    tagged = created_between(runs, since, None).filter(F.size("tags") > 0)
    tags = tagged.select("created_at", F.explode("tags").alias("tag"))
    named = tags.filter(F.col("tag").isNotNull() & (F.col("tag") != ""))
    return named.groupBy("tag").agg(F.max("created_at").alias("last_seen_at")).select(
        "tag", F.lower("tag").alias("tag_lower"), "last_seen_at", ts(as_of).alias("updated_at")
    )


def recent_tags(runs: DataFrame, as_of: datetime) -> DataFrame:
    """Catalogue rows of the runs of the last hour."""
    return tag_catalogue(runs, as_of, naive_utc(as_of) - LOOK_BACK)


def upsert_tags(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Catalogue after an upsert: last seen never goes back."""
    rows = stored.unionByName(fresh)
    return rows.groupBy("tag").agg(
        F.lower("tag").alias("tag_lower"),
        F.max("last_seen_at").alias("last_seen_at"),
        F.max("updated_at").alias("updated_at"),
    )


def search_tags(catalogue: DataFrame, search: str | None) -> DataFrame:
    """Tags that match a text, those beginning with it first."""
    text = (search or "").strip()
    if len(text) < MIN_SEARCH_LENGTH:
        return catalogue.filter(F.lit(False)).select("tag", F.lit(0).alias("rank"))
    text = text.lower()
    lower = F.col("tag_lower")
    prefix = lower.like(like_pattern(f"{text}%"))
    found = prefix if len(text) == MIN_SEARCH_LENGTH else lower.like(like_pattern(f"%{text}%"))
    hits = catalogue.filter(found & (F.col("tag") != ""))
    rank = F.when(prefix, F.lit(0)).otherwise(F.lit(1))
    return hits.select("tag", rank.alias("rank")).orderBy("rank", "tag").limit(MAX_TAGS)
