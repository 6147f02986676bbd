"""Streams over hand-made deliveries: late rows, expiry of state, restarts, and tables in place of streams."""

import datetime as dt

import pytest

from demandgauge.streaming import event_time as E

START = dt.datetime(2024, 1, 1)
SCHEMA = "cp_id string, connector string, start_time timestamp, consumption_kwh double, duration_minutes double"


def at(hours):
    return START + dt.timedelta(hours=hours)


class Feed:
    """A folder of arrivals and the stream over it."""

    def __init__(self, spark, path, build, *schemas):
        self.spark, self.path, self.schemas, self.queries = spark, str(path), schemas, []
        for i, s in enumerate(schemas):
            spark.createDataFrame([], s).write.parquet(f"{self.path}/in-{i}")
        self.result = build(*[E.arrivals(spark, f"{self.path}/in-{i}", spark.createDataFrame([], s).schema) for i, s in enumerate(schemas)])

    def deliver(self, *rows):
        for i, (r, s) in enumerate(zip(rows, self.schemas, strict=True)):
            if r:
                self.spark.createDataFrame(r, s).write.mode("append").parquet(f"{self.path}/in-{i}")
        query = E.append_available(self.result, f"{self.path}/out", f"{self.path}/state")
        query.awaitTermination()
        return query

    def rows(self):
        return sorted((tuple(r) for r in self.spark.read.schema(self.result.schema).parquet(f"{self.path}/out").collect()), key=str)


def session(hours, cp="a", kwh=1.0, connector="1"):
    return (cp, connector, None if hours is None else at(hours), kwh, 10.0)


def test_windows_close_by_watermark_and_late_rows_stay_out(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda s: E.usage_windows(s, E.tumbling("1 hour"), ["cp_id"], "30 minutes"), SCHEMA)
    first = feed.deliver([session(0.1), session(0.5), session(0.6, cp=None), session(1.2, kwh=None), session(None)])
    assert E.rows_too_late(first) == 0 and feed.rows() == []  # the watermark stands at 0:42
    second = feed.deliver([session(0.9), session(2.4)])  # within the allowance; then the watermark passes 1:00
    assert E.rows_too_late(second) == 0
    assert feed.rows() == [(at(0), at(1), "a", 3, 3.0, 30.0), (at(0), at(1), None, 1, 1.0, 10.0)]
    third = feed.deliver([session(0.95), session(1.95)])  # too late for the first window and, at 1:54, still in time for the second
    assert E.rows_too_late(third) == 1
    feed.deliver([session(9)])
    assert feed.rows()[2:] == [(at(1), at(2), "a", 2, 1.0, 20.0), (at(2), at(3), "a", 1, 1.0, 10.0)]


def test_state_of_copies_expires(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda s: E.first_copies(s, ["cp_id", "connector", "start_time", "consumption_kwh"], "2 hours"), SCHEMA)
    feed.deliver([session(0), session(0), session(1), session(1, kwh=None), session(1, kwh=None)])
    again = feed.deliver([session(0), session(1), session(1, cp="b")])  # a repeated file with one new row
    assert len(feed.rows()) == 4 and E.rows_in_state(again) == 4
    later = feed.deliver([session(20)])
    assert E.rows_in_state(later) == 1  # all but the newest have expired
    feed.deliver([session(0), session(20)])  # far too late, and a copy
    assert len(feed.rows()) == 5


def test_join_waits_for_both_sides_and_survives_a_restart(spark, tmp_path):
    sessions, statuses = "cp_id string, id int, start_time timestamp", "cp_id string, code int, status_time timestamp"
    feed = Feed(spark, tmp_path, lambda s, e: E.with_status(s, e, ["cp_id"], "1 hour", "2 hours", "1 hour"), sessions, statuses)
    feed.deliver([("a", 1, at(1)), ("a", 2, at(5)), (None, 3, at(1))], [("a", 7, at(0))])
    assert [(r[1], r[3]) for r in feed.rows()] == [(1, 7)]
    # Another object over the same checkpoint, as after a failure; the match comes from state.
    again = Feed.__new__(Feed)
    again.__dict__.update(feed.__dict__)
    again.result = E.with_status(
        *[E.arrivals(spark, f"{tmp_path}/in-{i}", spark.createDataFrame([], s).schema) for i, s in enumerate((sessions, statuses))],
        ["cp_id"], "1 hour", "2 hours", "1 hour")
    again.deliver([], [("a", 8, at(3)), ("a", 9, at(4)), ("b", 9, at(5)), (None, 9, at(1))])
    assert sorted((r[1], r[3]) for r in again.rows() if r[3]) == [(1, 7), (1, 8), (2, 9)]
    end = again.deliver([("a", 4, at(40))], [("a", 5, at(30))])
    assert [r[1] for r in again.rows() if r[3] is None] == [3]  # alone for good, known after the watermark
    assert E.rows_in_state(end) == 2


@pytest.mark.parametrize("window", [(E.tumbling, "2 hours"), (E.sliding, "2 hours", "1 hour"), (E.inactivity, "90 minutes")])
def test_tables_give_what_streams_come_to(spark, tmp_path, window):
    kind, *widths = window
    rows = [session(h, cp) for h in (0, 0.5, 1.2, 3.5, 4.9, 5, 8) for cp in "ab"]
    feed = Feed(spark, tmp_path, lambda s: E.usage_windows(s, kind(*widths), ["cp_id"], "10 hours"), SCHEMA)
    feed.deliver(rows[::2])
    feed.deliver(rows[1::2])
    feed.deliver([session(500, cp="end")])
    table = E.usage_windows(spark.createDataFrame(rows, SCHEMA), kind(*widths), ["cp_id"], "10 hours")
    assert feed.rows() == sorted((tuple(r) for r in table.collect()), key=str)
