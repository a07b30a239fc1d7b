import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from detlake.plans import tracking as T
from detlake.streaming import core, track


def run(frames, **kw):
    """Feed (boxes, scores) per frame; return the reported (id, det) pairs per frame."""
    s, o = core.State(), core.Options(**kw)
    out = []
    for boxes, scores in frames:
        info, _ = core.step(s, o, boxes, scores, [0] * len(boxes), list(range(len(boxes))))
        out.append(sorted((int(t["id"]), int(t["det"])) for t in info))
    return out


def moving(n, start=0.0, dx=5.0, gap=()):
    return [(([[start + dx * k, 0, start + dx * k + 40, 60]], [0.9]) if k not in gap else ([[900, 900, 901, 901]], [0.05])) for k in range(n)]


@pytest.mark.parametrize("kind", ["byte", "bot"])
def test_one_object_keeps_its_id(kind):
    assert run(moving(20), kind=kind) == [[(1, 0)]] * 20


@pytest.mark.parametrize("kind", ["byte", "bot"])
def test_lost_track_comes_back(kind):
    out = run(moving(20, dx=1.0, gap=(8, 9, 10)), kind=kind)
    assert out[7] == [(1, 0)] and out[8] == [] and out[11] == [(1, 0)]


def test_frames_are_stretches_of_arrays():
    """Frames read as stretches of the columns of many frames give what each frame gives by itself."""
    rng = np.random.default_rng(5)
    no = np.sort(rng.integers(0, 40, 300))
    corner = rng.integers(0, 60, (300, 2)).astype(float)
    box = np.hstack([corner, corner + [[40.0, 60.0]]])
    rows = pd.DataFrame(box, columns=track.BOX).assign(frame_no=no, det_id=range(300), cls=1, conf=rng.uniform(0.05, 1, 300))
    o, s, plain = core.Options(), core.State(), core.State()
    columns, cuts = track._arrays(rows, o), [*track._cuts(no), 300]
    assert cuts == [0, *[k for k in range(1, 300) if no[k] != no[k - 1]], 300]
    for a, b in zip(cuts, cuts[1:]):
        got = track._one_frame(s, o, columns, a, b)
        f = rows.iloc[a:b]
        info, want = core.step(plain, o, f[track.BOX].to_numpy(), f["conf"].to_numpy(), f["cls"].to_numpy(), f["det_id"].to_numpy())
        assert [(r[0], r[2], *r[3:7], r[8]) for r in got] == [(i["id"], i["score"], *x, i["det"]) for i, x in zip(info, want)]
        assert all(type(r[0]) is int and r[7] is None for r in got)


def test_track_ends_after_the_buffer():
    gap = range(5, 45)
    out = run(moving(60, dx=0.0, gap=gap), buffer=30)
    assert out[4] == [(1, 0)]
    assert out[45] == [] and out[46] == [(2, 0)]


def test_later_tracks_need_a_second_match():
    frames = [([[0, 0, 40, 60]], [0.9])] + [([[0, 0, 40, 60], [200, 0, 240, 60]], [0.9, 0.8])] * 3
    assert run(frames) == [[(1, 0)], [(1, 0)], [(1, 0), (2, 1)], [(1, 0), (2, 1)]]


def test_weak_detections_only_extend_tracks():
    frames = [([[0, 0, 40, 60]], [0.9])] * 3 + [([[0, 0, 40, 60], [300, 0, 340, 60]], [0.15, 0.15])] * 3
    assert run(frames) == [[(1, 0)]] * 6


def test_camera_warp_is_applied():
    s, o = core.State(), core.Options(kind="bot")
    core.step(s, o, [[0, 0, 40, 60]], [0.9], [0], [0])
    info, _ = core.step(s, o, [[100, 0, 140, 60]], [0.9], [0], [0], warp=[1, 0, 100, 0, 1, 0])
    assert info["id"].tolist() == [1]


def test_appearance_rescues_a_partial_overlap():
    feat = np.eye(4)
    s, o = core.State(), core.Options(kind="bot", reid=True, match=0.3, fuse=False)
    core.step(s, o, [[0, 0, 40, 60]], [0.9], [0], [0], feat=feat[:1])
    info, _ = core.step(s, o, [[12, 0, 52, 60]], [0.9], [0], [0], feat=feat[:1])
    assert info["id"].tolist() == [1]


def test_rotated_tracks():
    s, o = core.State(), core.Options()
    for k in range(5):
        info, _ = core.step(s, o, [[k, 0, k + 40, 20]], [0.9], [0], [0], angle=[0.3])
        assert info["id"].tolist() == [1] and info["angle"].tolist() == [0.3]


def test_batch_equals_stream_and_any_partitioning(tables, spark):
    det = T._det(tables)
    batch = sorted(map(tuple, T._tracks(track.track(det)).collect()))
    assert batch
    again = sorted(map(tuple, T._tracks(track.track(det.repartition(3, F.rand(1)))).collect()))
    assert again == batch
    stream = sorted(map(tuple, T.t01s(tables).collect()))
    assert stream == batch


def test_small_arrow_batches_change_nothing(tables, spark):
    det = T._det(tables)
    want = sorted(map(tuple, T._tracks(track.track(det)).collect()))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, T._tracks(track.track(det)).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_stream_over_several_batches_equals_batch(tables, spark):
    from detlake.session import scratch_path
    from detlake.streaming import stateful as SF

    rows = tables.tracks.select("video_id", "frame_no", "track_id", ((F.col("track_id") * 37 + F.col("frame_no") * 53) % 180).cast("double").alias("angle"))
    path = scratch_path(spark, "ordered")
    for lo in (0, 8, 16):  # three files, one after the other
        rows.filter((F.col("frame_no") >= lo) & (F.col("frame_no") < lo + (8 if lo < 16 else 1000))).coalesce(1).write.mode("append").parquet(path)
    s = SF.read_detection_stream(spark, path, rows.schema, per_trigger=1)
    got = sorted(map(tuple, T._drain(tables, SF.reps_stream(s)).collect()))
    from detlake.operators.video import count_reps

    want = count_reps(rows).select("video_id", "track_id", "frame_no", "stage", "reps")
    assert got == sorted(map(tuple, want.collect()))


def test_removed_ids_stay_within_the_live_tracks():
    s, o = core.State(), core.Options(buffer=3)
    for k in range(400):  # every object is seen in two frames of five, then another one comes
        x = 60.0 * (k // 5)
        boxes = [[x, 0, x + 40, 60]] if k % 5 < 2 else [[0, 500, 40, 560]]
        core.step(s, o, boxes, [0.9] if k % 5 < 2 else [0.05], [0], [0])
        assert s.removed <= set(s.info["id"].tolist())


def _video(spark, rows):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(v, f, i, base + dt.timedelta(seconds=s)) for v, f, i, s in rows], "video_id bigint, frame_no bigint, track_id bigint, ts timestamp"
    )


def _append(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def _alarm(spark, path, sink, check, schema):
    from detlake.streaming import stateful as SF

    s = SF.read_detection_stream(spark, path, schema, per_trigger=1).withWatermark("ts", "5 seconds")
    q = SF.alarm_stream(s, 5, idle="1 minute").writeStream.format("parquet").outputMode("append")
    q = q.option("checkpointLocation", check).trigger(availableNow=True).start(sink)
    q.awaitTermination()
    return q


def test_alarm_counts_split_frames_and_restarts(spark):
    from detlake.session import scratch_path

    path, sink, check = (scratch_path(spark, n) for n in ("alarm", "sink", "check"))
    one = _video(spark, [(1, 7, i, 7) for i in range(4)] + [(1, 3, 0, 3)])
    _append(one, path)
    _alarm(spark, path, sink, check, one.schema)
    # the other half of the frame comes after a restart, and then rows that close it
    _append(_video(spark, [(1, 7, i, 7) for i in range(4, 8)] + [(1, 5, 0, 5)]), path)
    _alarm(spark, path, sink, check, one.schema)
    _append(_video(spark, [(2, 100, 0, 100)]), path)
    q = _alarm(spark, path, sink, check, one.schema)
    assert [tuple(r) for r in spark.read.parquet(sink).collect()] == [(1, 7, 8)]
    # idle for a minute: the state of both videos goes
    _append(_video(spark, [(3, 500, 0, 500)]), path)
    q = _alarm(spark, path, sink, check, one.schema)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    assert [tuple(r) for r in spark.read.parquet(sink).collect()] == [(1, 7, 8)]


def test_retried_batch_writes_nothing_twice(spark):
    from detlake.session import scratch_path
    from detlake.streaming import stateful as SF

    path, sink = scratch_path(spark, "in"), scratch_path(spark, "latest")
    rows = _video(spark, [(1, f, 0, f) for f in range(3)])
    _append(rows, path)
    for _ in range(2):  # a new checkpoint runs batch 0 again
        s = SF.read_detection_stream(spark, path, rows.schema)
        SF.write_latest(s, sink, scratch_path(spark, "check")).trigger(availableNow=True).start().awaitTermination()
    assert [r.frame_no for r in spark.read.parquet(sink).collect()] == [2]


def test_rows_out_of_order_without_time_fail(spark):
    from detlake.session import scratch_path
    from detlake.streaming import stateful as SF

    path = scratch_path(spark, "unordered")
    schema = "video_id bigint, track_id bigint, frame_no bigint, angle double"
    for f in (5, 2):
        _append(spark.createDataFrame([(1, 1, f, 100.0)], schema), path)
    s = SF.read_detection_stream(spark, path, spark.createDataFrame([], schema).schema, per_trigger=1)
    q = SF.reps_stream(s).writeStream.format("noop").option("checkpointLocation", scratch_path(spark, "check")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="came after frame"):
        q.awaitTermination()
