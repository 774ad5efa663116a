"""Text, array and JSON expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Fixed value: terminal escape sequences as the log producers strip them.
ANSI_ESCAPE = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"

_DIGEST = "^(.{8})(.{4})(.{3})(.{3})(.{12}).*$"
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", re.IGNORECASE)


def strip_ansi(column: Column) -> Column:
    return F.regexp_replace(column, ANSI_ESCAPE, "")


def like_pattern(text: str) -> str:
    """A pattern in which a backslash escapes any character, as Spark wants it.

    Wildcards in the text keep their meaning. Spark rejects a backslash before
    an ordinary character, where it only stands for that character.
    """
    return re.sub(r"\\(.)", lambda m: m.group(0) if m.group(1) in "%_\\" else m.group(1), text, flags=re.DOTALL)


def contains_ci(column: Column, text: str) -> Column:
    return column.ilike(like_pattern(f"%{text}%"))


def is_uuid(text: str) -> bool:
    return _UUID.fullmatch(text) is not None


def tags_text(tags: Column) -> Column:
    """Searchable text of a tag array; null elements are skipped."""
    return F.array_join(tags, " ")


def join_lines(lines: Column) -> Column:
    """Array of lines as one text; a null line counts as an empty one."""
    return F.array_join(lines, "\n", "")


def drop_blank(texts: Column) -> Column:
    return F.filter(texts, lambda x: x.isNotNull() & (x != ""))


def drop_zero(numbers: Column) -> Column:
    return F.filter(numbers, lambda x: x.isNotNull() & (x != 0))


def drop_null(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def canonical_json(column: Column) -> Column:
    """JSON text with sorted keys and plain numbers, so that equal values are equal strings."""
    return F.to_json(F.try_parse_json(column))


def uuid_of(*parts: Column) -> Column:
    """A UUID-shaped id computed from a key.

    Parts are length-prefixed so that different keys cannot give the same text.
    Reruns give the same id, which keeps every write idempotent.
    """
    tagged = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    # One reference to the digest: an id that is filtered or joined on gets
    # copied into several places of a plan.
    return F.regexp_replace(F.sha2(F.concat(*tagged), 256), _DIGEST, "$1-$2-8$3-8$4-$5")


def run_id() -> Column:
    """Id of a job run from its key columns."""
    millis = F.unix_millis(F.col("enqueued_at").cast("timestamp")).cast("string")
    return uuid_of(F.col("queue"), F.col("job_id"), millis)


def log_id() -> Column:
    """Id of a stored log line from its key columns."""
    millis = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    return uuid_of(F.col("job_run_id"), millis, F.col("log_seq").cast("string"))


def queue_name_candidates(name: Column) -> Column:
    """The name itself, then its variant with braces taken off or put on."""
    braced = name.startswith("{") & name.endswith("}") & (F.length(name) >= 2)
    inner = F.substring(name, F.lit(2), F.length(name) - 2)
    return F.array(name, F.when(braced, inner).otherwise(F.concat(F.lit("{"), name, F.lit("}"))))


def discovered_queue(key: Column) -> Column:
    """Queue name inside a broker key ``namespace:queue:id``; NULL when there is none."""
    return F.try_element_at(F.split(key, ":"), F.lit(2))
