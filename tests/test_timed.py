"""Typed keyed state: waiting, restart, late rows, expiry."""

import datetime as dt

import pytest

from detlake.streaming import stateful as SF
from detlake.streaming.timed import dropped_rows

SCHEMA = "video_id bigint, track_id bigint, frame_no bigint, ts timestamp, angle double"
ZERO = dt.datetime(2024, 1, 1)


def row(track, no, angle, second=None):
    return (0, track, no, ZERO + dt.timedelta(seconds=no if second is None else second), angle)


class Stream:
    """A folder of files, one per micro-batch, read by queries that share a checkpoint."""

    def __init__(self, spark, tmp, delay="5 seconds", **kw):
        self.spark, self.tmp, self.delay, self.kw = spark, tmp, delay, kw

    def send(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.tmp}/in")
        s = SF.read_detection_stream(self.spark, f"{self.tmp}/in", SCHEMA, per_trigger=1).withWatermark("ts", self.delay)
        out = SF.reps_stream(s, late=True, **self.kw)
        self.schema = out.schema
        w = out.writeStream.format("parquet").option("checkpointLocation", f"{self.tmp}/check").trigger(availableNow=True)
        q = w.start(f"{self.tmp}/out")
        q.awaitTermination()
        return q

    def rows(self):
        got = self.spark.read.schema(self.schema).parquet(f"{self.tmp}/out").collect()
        return sorted((r.track_id, r.frame_no, r.stage or "", r.reps if r.reps is not None else -1, r.late) for r in got)


@pytest.fixture
def stream(spark, tmp_path):
    return Stream(spark, tmp_path)


ANGLES = [160, 100, 80, 120, 150, 80, 80, 170, 60, 100]
WANT = [(1, i, s, n, False) for i, (s, n) in enumerate([("up", 0), ("up", 0), ("down", 1), ("down", 1), ("up", 1), ("down", 2), ("down", 2), ("up", 2), ("down", 3), ("down", 3)])]


def test_restart_from_the_checkpoint_goes_on(stream):
    rows = [row(1, i, float(a)) for i, a in enumerate(ANGLES)]
    stream.send(rows[5:2:-1], rows[:3])
    stream.send([rows[8], rows[6]], [rows[9], rows[7]])
    stream.send([row(2, 1000, 10.0)], [row(2, 1001, 10.0)])
    assert [r for r in stream.rows() if r[0] == 1] == WANT


def test_rows_after_the_watermark_are_dropped_and_counted(stream):
    rows = [row(1, i, float(a)) for i, a in enumerate(ANGLES)]
    q = stream.send(rows, [row(2, 500, 100.0)], [row(2, 501, 100.0)], [row(1, 3, 10.0), row(1, 4, 10.0), row(1, 5, 10.0)], [row(2, 502, 100.0)])
    assert dropped_rows(q) == 3
    assert [r for r in stream.rows() if r[0] == 1] == WANT


def test_a_row_in_time_for_a_counted_frame_goes_out_as_late(stream):
    rows = [row(1, i, float(a)) for i, a in enumerate(ANGLES)]
    q = stream.send(rows, [row(2, 500, 100.0)], [row(2, 501, 100.0)], [row(1, 4, 10.0, second=600)], [row(2, 700, 1.0)], [row(2, 701, 1.0)])
    assert dropped_rows(q) == 0
    assert [r for r in stream.rows() if r[0] == 1] == sorted([*WANT, (1, 4, "", -1, True)])


def test_a_silent_key_ends_by_its_timer(spark, tmp_path):
    s = Stream(spark, tmp_path, idle="60 seconds")
    rows = [row(1, i, float(a)) for i, a in enumerate(ANGLES)]
    q = s.send(rows, [row(2, 30, 100.0)], [row(2, 31, 100.0)])
    held = q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    q = s.send([row(2, 400, 100.0)], [row(2, 401, 100.0)])
    # the key comes back with small frame numbers and begins anew
    s.send([row(1, 2, 160.0, second=500), row(1, 3, 80.0, second=501)], [row(2, 900, 100.0)], [row(2, 901, 100.0)])
    got = [r for r in s.rows() if r[0] == 1]
    assert got == sorted([*WANT, (1, 2, "up", 0, False), (1, 3, "down", 1, False)])
    assert held > 0


def test_rows_of_one_frame_and_missing_angles(stream):
    stream.send([row(1, 0, 160.0), row(1, 1, None), row(1, 1, 80.0), row(1, 1, 80.0)], [row(2, 100, 1.0)], [row(2, 101, 1.0)])
    got = [r for r in stream.rows() if r[0] == 1]
    # a missing angle is no event; rows of one frame are folded in the order in which they came
    assert got == [(1, 0, "up", 0, False), (1, 1, "down", 1, False), (1, 1, "down", 1, False), (1, 1, "up", 0, False)]
