"""Analytics over tracks: ``video_id, frame_no, ts, track_id, cls, conf`` and a box per row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import regions as RG
from ..functions.points import joint_angle
from ..functions.rotated import envelope
from . import joins as J
from .ordered import previous, running, scan, stream_sorted, trailing

TRACK = ("video_id", "track_id")
BLOCK = 4096


def frame_block(frame="frame_no", size: int | None = None) -> Column:
    return F.floor(F.col(frame) / (size or BLOCK))


def with_centers(tracks: DataFrame) -> DataFrame:
    return tracks.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})


def previous_point(tracks: DataFrame) -> DataFrame:
    """Adds the centre ``px, py`` and time ``pts`` of the same track's row before; NULL on the first."""
    t = tracks if "cx" in tracks.columns else with_centers(tracks)
    values = {"px": "cx", "py": "cy"} | ({"pts": "ts"} if "ts" in t.columns else {})
    return previous(t, TRACK, ["frame_no"], frame_block(), values)


def track_line(tracks: DataFrame, n: int = 30) -> DataFrame:
    """Adds ``line``, the last ``n`` centres of the track up to this row, oldest first."""
    t = with_centers(tracks)
    point = F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"))
    return trailing(t, TRACK, "frame_no", frame_block(), point, n, "line")


def crossings(tracks: DataFrame, regions: DataFrame) -> DataFrame:
    """First counting event of each track per region, with direction ``IN`` or ``OUT``.

    Lines count when the step meets them, polygons when the centre is strictly inside; a track needs an earlier point. The
    direction is the sign of movement across the region's long axis.
    """
    steps = previous_point(tracks).filter(F.col("px").isNotNull())
    near = J.near_regions(steps, regions)
    line = F.size("points") == 2
    hit = F.when(line, RG.step_meets_line("points", "px", "py", "cx", "cy")).otherwise(RG.in_polygon("points", "cx", "cy"))
    near = near.filter(hit)
    e = envelope("points")
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    goes_in = F.when(dx < dy, F.col("cx") > F.col("px")).otherwise(F.col("cy") > F.col("py"))
    event = F.struct("frame_no", "cls", F.when(goes_in, "IN").otherwise("OUT").alias("direction"))
    first = near.groupBy("region_id", *TRACK).agg(F.min_by(event, F.col("frame_no")).alias("e"))
    return first.select("region_id", *TRACK, "e.*")


def count_crossings(tracks: DataFrame, regions: DataFrame) -> DataFrame:
    """``IN`` and ``OUT`` counts per region, video and class; every class seen in a video has a row for each region that holds
    there: those with the video's ``video_id`` if regions belong to videos, else all."""
    c = crossings(tracks, regions)
    n = c.groupBy("region_id", "video_id", "cls").agg(
        F.count_if(F.col("direction") == "IN").alias("n_in"), F.count_if(F.col("direction") == "OUT").alias("n_out")
    )
    seen = tracks.select("video_id", "cls").distinct()
    if J.region_keys(regions):
        seen = seen.join(regions.select("video_id", "region_id"), "video_id")
    else:  # one row: the ids of the configured regions
        seen = seen.join(F.broadcast(regions.agg(F.collect_list("region_id").alias("_ids"))))
        seen = seen.select("video_id", "cls", F.explode("_ids").alias("region_id"))
    out = seen.join(n, ["region_id", "video_id", "cls"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_in", "n_out")})


def running_counts(events: DataFrame) -> DataFrame:
    """Totals of a ``crossings`` table up to each frame, per region and video."""
    flags = events.groupBy("region_id", "video_id", "frame_no").agg(
        F.count_if(F.col("direction") == "IN").alias("i"), F.count_if(F.col("direction") == "OUT").alias("o")
    )
    out = running(flags, ["region_id", "video_id"], ["frame_no"], frame_block(), sums={"total_in": "i", "total_out": "o"})
    return out.drop("i", "o")


def region_counts(tracks: DataFrame, regions: DataFrame) -> DataFrame:
    """Objects strictly inside each region per frame; frames without any have no row."""
    inside = J.in_region(with_centers(tracks), regions)
    return inside.groupBy("video_id", "frame_no", "region_id").agg(F.count("*").alias("n"))


def queue_length(tracks: DataFrame, region: DataFrame) -> DataFrame:
    """Objects inside the polygon that were seen before, per frame (0 when there are none)."""
    old = previous_point(tracks).filter(F.col("px").isNotNull())
    inside = J.in_region(old, region.filter(F.size("points") >= 3))
    n = inside.groupBy("video_id", "frame_no").agg(F.count("*").alias("n"))
    return _per_frame(tracks, n, "n")


def _per_frame(tracks, counts, name):
    frames = tracks.select("video_id", "frame_no").distinct()
    return frames.join(counts, ["video_id", "frame_no"], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def slot_occupancy(tracks: DataFrame, slots: DataFrame) -> DataFrame:
    """Occupied and free slots per frame; a whole-pixel centre inside or on the edge fills a slot."""
    t = with_centers(tracks).withColumns({c: F.col(c).cast("int").cast("double") for c in ("cx", "cy")})
    used = J.in_region(t, slots, inclusive=True).select("video_id", "frame_no", "region_id").distinct()
    n = used.groupBy("video_id", "frame_no").agg(F.count("*").alias("occupied"))
    out = _per_frame(tracks, n, "occupied")
    if J.region_keys(slots):
        out = out.join(slots.groupBy("video_id").agg(F.count("*").alias("_total")), "video_id", "left").fillna(0, ["_total"])
    else:
        out = out.join(F.broadcast(slots.agg(F.count("*").alias("_total"))))  # one row
    return out.withColumn("available", F.col("_total") - F.col("occupied")).drop("_total")


def speed(tracks: DataFrame, regions: DataFrame) -> DataFrame:
    """Vertical pixels per second at a track's first step that meets the region, by event time."""
    steps = previous_point(tracks).filter(F.col("px").isNotNull())
    dt = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("pts").cast("timestamp"))
    steps = steps.withColumn("speed", F.when(dt > 0, F.abs(F.col("cy") - F.col("py")) * 1e6 / F.when(dt > 0, dt)))
    hits = J.step_crosses(steps, regions)
    first = hits.groupBy("region_id", *TRACK).agg(F.min_by(F.struct("frame_no", "speed"), F.col("frame_no")).alias("e"))
    return first.select("region_id", *TRACK, "e.*")


def heatmap(tracks: DataFrame, weight: float = 2.0, width: int | None = None, height: int | None = None, keys=("video_id",)) -> DataFrame:
    """Heat per pixel: each box adds ``weight`` on the disc inscribed in it.

    A disc is written as one run per row. Run ends are added up as differences per pixel column, equal boxes first, and a
    sum along each row turns them into heat; no box is expanded to its pixels.
    """
    keys = list(keys)
    box = [F.col(c).cast("int").alias(c) for c in J.BOX]
    # integer boxes repeat: add equal ones up before expanding
    b = tracks.select(*keys, *box).groupBy(*keys, *J.BOX).agg(F.count("*").alias("k"))
    mid = lambda a, c: F.floor((F.col(a) + F.col(c)) / 2).cast("int")
    r = F.floor(F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / 2).cast("int")
    b = b.withColumns({"mx": mid("x1", "x2"), "my": mid("y1", "y2"), "r": r}).filter((F.col("r") >= 0) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    top, low = F.greatest(F.col("y1"), F.col("my") - F.col("r")), F.least(F.col("y2") - 1, F.col("my") + F.col("r"))
    if height is not None:
        top, low = F.greatest(top, F.lit(0)), F.least(low, F.lit(height - 1))
    b = b.withColumns({"_a": top, "_b": low}).filter("_a <= _b").withColumn("y", F.explode(F.sequence("_a", "_b")))
    dy = F.col("y") - F.col("my")
    half = F.floor(F.sqrt((F.col("r") * F.col("r") - dy * dy).cast("double"))).cast("int")
    a, z = F.greatest(F.col("x1"), F.col("mx") - half), F.least(F.col("x2") - 1, F.col("mx") + half)
    if width is not None:
        a, z = F.greatest(a, F.lit(0)), F.least(z, F.lit(width - 1))
    runs = b.select(*keys, "y", a.alias("a"), z.alias("z"), (F.col("k") * weight).alias("k")).filter("a <= z")
    ends = runs.select(*keys, "y", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("k").alias("d")), F.struct((F.col("z") + 1).alias("x"), (-F.col("k")).alias("d")))).alias("e"))
    diff = ends.groupBy(*keys, "y", F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d")).filter("d != 0")
    # one window row per run end of a pixel row, at most the frame width
    w = Window.partitionBy(*keys, "y").orderBy("x")
    level = diff.withColumns({"heat": F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_to": F.lead("x").over(w)})
    cells = level.filter("heat > 0 AND _to IS NOT NULL")
    return cells.select(*keys, F.explode(F.sequence(F.col("x"), F.col("_to") - 1)).alias("x"), "y", "heat")


def normalized_heat(heat: DataFrame, keys=("video_id",), pixels: int | None = None) -> DataFrame:
    """Heat scaled to 0..255 between the lowest and the highest value of the picture.

    Pixels without a row have heat 0. The lowest value is above that only if all ``pixels`` of a picture have rows; a picture
    of one heat throughout becomes 0.
    """
    ends = heat.groupBy(*keys).agg(F.max("heat").alias("_hi"), F.min("heat").alias("_lo"), F.count("*").alias("_n"))
    full = F.col("_n") >= pixels if pixels is not None else F.lit(False)
    ends = ends.withColumn("_lo", F.when(full, F.col("_lo")).otherwise(F.lit(0.0))).drop("_n")
    scaled = F.coalesce(F.try_divide((F.col("heat") - F.col("_lo")) * 255, F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return heat.join(ends, list(keys)).withColumn("heat", scaled).drop("_hi", "_lo")


def frame_counts(tracks: DataFrame, by_class: bool = False) -> DataFrame:
    keys = ["video_id", "frame_no"] + (["cls"] if by_class else [])
    return tracks.groupBy(*keys).agg(F.count("*").alias("n"))


def last_points(counts: DataFrame, n: int = 45, keys=("video_id",)) -> DataFrame:
    """The newest ``n`` frames of a count series."""
    w = Window.partitionBy(*keys).orderBy(F.col("frame_no").desc())
    return counts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def track_distance(tracks: DataFrame, a: int, b: int) -> DataFrame:
    """Pixel distance of two tracks in the frames that show both."""

    def side(uid, s):
        mid = [F.floor((F.col(p) + F.col(q)) / 2) for p, q in (("x1", "x2"), ("y1", "y2"))]
        return tracks.filter(F.col("track_id") == uid).select("video_id", "frame_no", mid[0].alias(f"x{s}"), mid[1].alias(f"y{s}"))

    both = side(a, "a").join(side(b, "b"), ["video_id", "frame_no"])
    dx, dy = F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")
    return both.select("video_id", "frame_no", F.sqrt((dx * dx + dy * dy).cast("double")).alias("distance"))


def with_angle(df: DataFrame, i: int, j: int, k: int, name: str = "angle") -> DataFrame:
    """Angle at keypoint ``j`` between ``i`` and ``k`` (0-based)."""
    p = [F.element_at("keypoints", n + 1) for n in (i, j, k)]
    return df.withColumn(name, joint_angle(*[c for q in p for c in (q["x"], q["y"])]))


def count_reps(angles: DataFrame, up: float = 145, down: float = 90, keys=TRACK, order="frame_no") -> DataFrame:
    """Adds ``stage`` after each row and the running number of repetitions ``reps`` per track.

    Below ``down`` a row is a down event, above ``up`` an up event; a down event counts when the event before it was up.
    """
    event = F.when(F.col("angle") < down, "down").when(F.col("angle") > up, "up")
    rep = lambda last, now: F.when((now["v"] == "down") & (last["v"] == "up"), 1).otherwise(0)
    e = angles.withColumn("_event", event)
    e = scan(e, keys, [order], frame_block(order), {"v": "_event"}, F.col("_event").isNotNull(), {"reps": rep}, before="_last")
    return e.withColumn("stage", F.coalesce("_event", "_last.v", F.lit("-"))).drop("_event", "_last")


def alarm(tracks: DataFrame, n: int = 5) -> DataFrame:
    """First frame of each video with more than ``n`` objects."""
    over = frame_counts(tracks).filter(F.col("n") > n)
    first = over.groupBy("video_id").agg(F.min(F.struct("frame_no", F.col("n").alias("objects"))).alias("f"))
    return first.select("video_id", "f.*")


def convex_hull(points: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """Hull of a configured region's corner points, in order."""
    pts = sorted({(float(x), float(y)) for x, y in points})
    if len(pts) < 3:
        return pts

    def chain(ps):
        out: list[tuple[float, float]] = []
        for p in ps:
            while len(out) > 1:
                (ax, ay), (bx, by) = out[-2], out[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(pts[::-1])


def restrict_to_zone(det: DataFrame, points: Sequence[tuple[float, float]]) -> DataFrame:
    """Detections whose centre lies in the convex hull of the points (edge included)."""
    hull = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in convex_hull(points)])
    d = with_centers(det)
    return d.filter(RG.in_polygon(hull, "cx", "cy", inclusive=True)).drop("cx", "cy")


def track_sequences(tracks: DataFrame, n: int = 8, stride: int = 2, overlap: float = 0.25) -> DataFrame:
    """Windows of a track's last ``n`` sampled frames, at the frames that trigger a classification.

    Every ``stride``-th frame is sampled. A full window is emitted at multiples of ``n * stride * (1 - overlap)`` and at a
    video's first frame with any full window.
    """
    s = tracks.filter(F.col("frame_no") % stride == 0)
    s = trailing(s, TRACK, "frame_no", frame_block(), F.col("frame_no"), n, "frames").filter(F.size("frames") == n)
    first = s.groupBy("video_id").agg(F.min("frame_no").alias("_first"))
    every = int(n * stride * (1 - overlap))
    s = s.join(first, "video_id").filter((F.col("frame_no") % every == 0) | (F.col("frame_no") == F.col("_first")))
    return s.select("video_id", "track_id", "frame_no", "frames")


def embedding_ema(df: DataFrame, alpha: float = 0.9, keys=TRACK, order="frame_no", column="embedding") -> DataFrame:
    """Adds ``smooth``: the moving average of unit embeddings along a track, brought back to unit length each step.

    The renormalised average depends on every step before, so it is folded over the sorted rows with one vector of state.
    """
    names = [*keys, order]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in names) + ", smooth array<double>"

    def unit(v):
        size = np.sqrt(v @ v)
        return v / size if size > 0 else v

    def step(state, rows):
        out = []
        for v in rows[column]:
            v = unit(np.asarray(v, dtype=np.float64))
            state["s"] = v if state["s"] is None else unit(alpha * state["s"] + (1 - alpha) * v)
            out.append(state["s"])
        return rows[names].assign(smooth=pd.Series(out, index=rows.index, dtype=object))

    return stream_sorted(df.select(*names, column), keys, [order], lambda key: {"s": None}, step, schema)


def track_sessions(tracks: DataFrame, buffer: int = 30) -> DataFrame:
    """Lifetimes: a track ends after ``buffer`` frames without a row. Rows per life: first and last frame, length."""
    new = lambda last, now: F.when(last["f"].isNull() | (now["f"] - last["f"] > buffer), 1).otherwise(0)
    t = scan(tracks.select(*TRACK, "frame_no"), TRACK, ["frame_no"], frame_block(), {"f": "frame_no"}, sums={"life": new})
    return t.groupBy(*TRACK, "life").agg(
        F.min("frame_no").alias("start_frame"), F.max("frame_no").alias("end_frame"), F.count("*").alias("length")
    )
