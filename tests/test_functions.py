from datetime import datetime

import pytest
from pyspark.sql import functions as F

from runloom.functions import status, text, time


@pytest.mark.parametrize("value, upper, expected", [
    ("2024-01-05", False, datetime(2024, 1, 5)),
    ("2024-01-05", True, datetime(2024, 1, 5, 23, 59, 59, 999000)),
    ("2024-01-05T10:20", False, datetime(2024, 1, 5, 10, 20)),
    ("2024-01-05T10:20", True, datetime(2024, 1, 5, 10, 20, 59, 999000)),
    ("2024-01-05T10:20:30", True, datetime(2024, 1, 5, 10, 20, 30)),
    ("2024-01-05T10:20:30.250Z", True, datetime(2024, 1, 5, 10, 20, 30, 250000)),
    ("2024-01-05T10:20+02:00", True, datetime(2024, 1, 5, 8, 20)),
    ("2024-01-05T10:20:00-0330", False, datetime(2024, 1, 5, 13, 50)),
])
def test_created_boundary_reads_every_form(spark, value, upper, expected):
    assert time.created_boundary(value, upper) == expected
    column = time.created_boundary_column(F.lit(value), upper)
    assert spark.range(1).select(column.alias("b")).first().b == expected


def test_unreadable_boundary(spark):
    assert spark.range(1).select(time.created_boundary_column(F.lit("soon")).alias("b")).first().b is None
    with pytest.raises(ValueError):
        time.created_boundary("soon")


def test_windows():
    as_of = datetime(2024, 1, 31, 10, 17)
    assert time.dashboard_window(as_of, 7) == time.Window(datetime(2024, 1, 24, 10), as_of, "hour")
    assert time.dashboard_window(as_of, 8) == time.Window(datetime(2024, 1, 23), as_of, "day")
    assert time.pressure_bounds(as_of, 1) == (datetime(2024, 1, 30, 10), datetime(2024, 1, 31, 10))


@pytest.mark.parametrize("state, finished, reason, phase, expected", [
    ("paused", None, None, "active", "waiting"),
    ("wait", 5, "x", "terminal", "waiting"),
    ("unknown", 5, "", "terminal", "completed"),
    ("unknown", None, None, "waiting", "waiting"),
    (None, 5, "boom", "waiting", "failed"),
    (None, 5, None, "waiting", "completed"),
    (None, 0, "boom", "snapshot", "active"),
    ("waiting-children", None, None, "active", "waiting-children"),
])
def test_status_derivation(spark, state, finished, reason, phase, expected):
    row = spark.createDataFrame([(state, finished, reason, phase)], "s string, f long, r string, p string")
    column = status.derive_status(F.col("s"), F.col("f"), F.col("r"), F.col("p"))
    assert row.select(column.alias("x")).first().x == expected


def test_arrays_and_text(spark):
    row = spark.createDataFrame(
        [(["a", None, "", "b"], [5, None, 0], "\x1b[31mred\x1b[0m \x1bM!", None)],
        "t array<string>, n array<int>, m string, nothing array<string>",
    ).select(
        text.drop_blank(F.col("t")).alias("blank"), text.drop_zero(F.col("n")).alias("zero"),
        text.drop_null(F.col("t")).alias("null"), text.tags_text(F.col("t")).alias("text"),
        text.join_lines(F.col("t")).alias("lines"), text.strip_ansi(F.col("m")).alias("plain"),
        text.tags_text(F.col("nothing")).alias("nothing"),
    ).first()
    assert (row.blank, row.zero, row.null) == (["a", "b"], [5], ["a", "", "b"])
    assert (row.text, row.lines, row.plain, row.nothing) == ("a  b", "a\n\n\nb", "red !", None)


def test_canonical_json(spark):
    rows = spark.createDataFrame([('{"a":1,"b":{"d":[1, 2],"c":null}}', '{"b":{"c":null,"d":[1.0,2]},"a":1.0}')], "x string, y string")
    a, b = rows.select(text.canonical_json(F.col("x")), text.canonical_json(F.col("y"))).first()
    assert a == b


def test_ids_do_not_collide(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a", "bc")], "x string, y string")
    ids = [r.id for r in rows.select(text.uuid_of(F.col("x"), F.col("y")).alias("id")).collect()]
    assert ids[0] == ids[2] != ids[1]
    assert all(text.is_uuid(i) for i in ids)


@pytest.mark.parametrize("name, other", [("q1", "{q1}"), ("{q1}", "q1"), ("{", "{{}"), ("{}", "")])
def test_queue_name_candidates(spark, name, other):
    row = spark.range(1).select(text.queue_name_candidates(F.lit(name)).alias("c")).first()
    assert row.c == [name, other]


def test_like_pattern():
    assert text.like_pattern(r"%a\b\%\\c%") == r"%ab\%\\c%"
