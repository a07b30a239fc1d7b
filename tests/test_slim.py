"""What goes through a shuffle or to disk: own columns only, detections counted once, compressed text."""

import glob

import pytest

from detlake import plans
from detlake.operators import masks as MA
from detlake.operators import match as M
from detlake.operators import suppress as X
from detlake.plans import ingest, tracking
from detlake.sources import commits
from detlake.sources import documents as D
from detlake.sources import sinks as K

from .conftest import DATA

plans.load()
ROTATED = "image_id long, det_id int, cls int, conf double, cx double, cy double, w double, h double, r double"


def joined(df) -> list[str]:
    """Names of the columns that each join of the plan takes from its sides."""
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = [plan.apply(i) for i in range(plan.toString().count("\n"))]
    found = []
    for n in (n for n in nodes if n.nodeName() == "Join"):
        for k in range(2):
            out = n.children().apply(k).output()
            found += [out.apply(i).name() for i in range(out.length())]
    return found


def written_out(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rotated_pairs_shuffle_no_box_beside_their_columns(spark):
    """F12"""
    d = spark.createDataFrame([(1, 1, 0, 0.9, 50.0, 50.0, 40.0, 20.0, 0.1), (1, 2, 0, 0.8, 52.0, 50.0, 40.0, 20.0, 0.1), (1, 3, 0, 0.7, 900.0, 50.0, 40.0, 20.0, 0.1)], ROTATED)
    p = M.rotated_pairs(d, d, ["image_id"], 0.5, lambda L, R: L("det_id") < R("det_id"))
    names = joined(p.select("det_id", "b_det_id", "sim"))
    assert "_gx" in names and not {"_x1", "_y2", "_s", "b__x1", "b__y2"} & set(names)
    assert [(r.det_id, r.b_det_id) for r in p.collect()] == [(1, 2)]


def test_keypoint_pairs_shuffle_no_wide_box(spark):
    """F9"""
    form = "image_id long, det_id int, ann_id int, cls int, conf double, x1 double, y1 double, x2 double, y2 double, keypoints array<struct<x:double,y:double,v:double>>"
    spots = [(10.0, 10.0, 1.0), (50.0, 60.0, 1.0)]
    d = spark.createDataFrame([(1, 1, 1, 0, 0.9, 10.0, 10.0, 50.0, 60.0, spots), (1, 2, 2, 0, 0.8, 510.0, 10.0, 550.0, 60.0, [(x + 500, y, v) for x, y, v in spots])], form)
    out = M.match_keypoints(d.drop("ann_id"), d.drop("det_id", "conf"), [0.2] * 2)
    names = joined(out)
    assert "_gx" in names and not {"_x1", "_y2", "_s", "b__x1", "b__y2"} & set(names)
    assert sorted((r.det_id, r.ann_id, r.tp_mask) for r in out.collect()) == [(1, 1, 1023), (2, 2, 1023)]


def test_tile_names_are_read_once(spark):
    """F7"""
    d = spark.createDataFrame([("P0__1024__0___0", 1, 0, 0.9, 150.0, 50.0, 40.0, 20.0, 0.1), ("P0__1024__100___0", 2, 0, 0.8, 50.0, 50.0, 40.0, 20.0, 0.1)], ROTATED.replace("image_id long", "image_id string"))
    out = X.merge_rotated_tiles(d)
    for line in written_out(out).split("\n"):  # one reading of name, x and y wherever the tiles are read
        assert line.count("regexp_extract") <= 3
    assert [(r.image_id, r.det_id) for r in out.collect()] == [("P0", 1)]


@pytest.mark.parametrize("name", ["x02_match_rotated", "x02_match_keypoints", "x02_match_masks", "m04_mask_iou", "x15_select_by_prompt", "x09_merge_rotated_tiles"])
def test_detections_are_counted_once(name, spark):
    """F3 F4 F6 F7 F9 F12: the ids of the boxes are not counted again by every reader."""
    assert "l_orderkey" not in written_out(plans.QUERIES[name](spark, DATA))


def test_snapshot_files_read_their_rows_once(spark, monkeypatch):
    """F14"""
    seen = []
    before = commits.LabelSnapshot.update

    def update(self, files, parse):
        seen.append(written_out(files))
        return before(self, files, parse)

    monkeypatch.setattr(ingest.LabelSnapshot, "update", update)
    plans.QUERIES["k07_snapshot_files"](spark, DATA)
    assert len(seen) == 2 and not any("l_orderkey" in s for s in seen)


def test_grounding_leaves_outlines_behind(spark):
    """F8"""
    doc = spark.createDataFrame(
        [("f", [(7, 100, 50, "7.jpg", None, "a photo", None, None)], [(1, 7, 1, [10.0, 5.0, 20.0, 10.0], 0, None, [[1.0, 2.0, 3.0, 4.0]], [1.0, 2.0, 2.0], [[2, 7]])])],
        "file string, images array<struct<id:bigint,width:int,height:int,file_name:string,coco_url:string,caption:string,name:string,sid:int>>, annotations array<struct<id:bigint,"
        "image_id:bigint,category_id:int,bbox:array<double>,iscrowd:int,area:double,segmentation:array<array<double>>,keypoints:array<double>,tokens_positive:array<array<int>>>>",
    )
    images = doc.selectExpr("file", "explode(images) AS i").select("file", "i.*")
    ann = doc.selectExpr("file", "posexplode(annotations) AS (pos, a)").select("file", "pos", "a.*")
    out = D.grounding_annotations(images, ann)
    assert not {"segmentation", "keypoints"} & set(joined(out)) and "segmentation" not in written_out(out).split("Aggregate")[1]
    assert [(r.image_id, r.ann_id, r.cls, r.phrase) for r in out.collect()] == [(7, 1, 0, "photo")]


@pytest.mark.parametrize("fmt", ["csv", "json", "xml"])
def test_summary_files_are_compressed(fmt, spark, tmp_path):
    """F10"""
    d = spark.createDataFrame([(1, 0, 0.5, 1.0, 2.0, 3.0, 4.0)], "image_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double")
    K.write_summary(K.summary(d, ["cat"]), f"{tmp_path}/out", fmt)
    files = [f for f in glob.glob(f"{tmp_path}/out/part-*")]
    assert files and all(f.endswith(".gz") for f in files)
    r = spark.read
    back = {"csv": lambda p: r.option("header", "true").csv(p), "json": r.json, "xml": lambda p: r.format("xml").option("rowTag", "detection").load(p)}[fmt](f"{tmp_path}/out")
    assert [x.name for x in back.collect()] == ["cat"]


def test_filled_polygons_become_pieces_at_once(spark):
    """F3 F6 F11"""
    form = "image_id long, cls int, {} long, polygon array<struct<x:double,y:double>>"

    def box(x, y, w, h):
        return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]

    a = spark.createDataFrame([(1, 0, 1, box(0.0, 0.0, 10.0, 150.0)), (1, 0, 2, box(500.0, 60.0, 10.0, 10.0)), (2, 0, 1, box(0.0, 0.0, 5.0, 5.0))], form.format("det_id"))
    b = spark.createDataFrame([(1, 0, 7, box(5.0, 50.0, 10.0, 150.0)), (1, 1, 8, box(0.0, 0.0, 10.0, 10.0)), (2, 0, 7, box(0.0, 0.0, 5.0, 5.0))], form.format("ann_id"))
    det, ann = MA.polygon_runs(a, ("image_id", "det_id", "cls")), MA.polygon_runs(b, ("image_id", "ann_id", "cls"))
    pieces = MA.pieces(det, ("image_id", "cls", "det_id"))
    assert written_out(pieces).count("MapInArrow") == 1  # once with the runs as rows in between: two

    def found(*sides):
        return sorted((r.image_id, r.det_id, r.ann_id, r.shared, round(r.iou, 6)) for r in MA.mask_overlap(*sides, "det_id", "ann_id", keys=("cls",)).collect())

    rows = [spark.createDataFrame(d.collect(), d.schema) for d in (det, ann)]
    assert found(det, ann) == found(*rows) == [(1, 1, 7, 500, round(500 / 2500, 6)), (2, 1, 7, 25, 1.0)]
    assert sorted(map(tuple, MA.run_area(det, ("image_id", "det_id")).collect())) == [(1, 1, 1500), (1, 2, 100), (2, 1, 25)]


def test_a_quarter_of_a_stream_is_many_files(spark, duck, monkeypatch):
    """F2 F5 F13"""
    monkeypatch.setattr(tracking, "QUARTER_FILE", 20)
    asked = []
    before = tracking.SF.read_detection_stream

    def read(spark, path, schema, **kw):
        asked.append((path, kw["per_trigger"]))
        return before(spark, path, schema, **kw)

    monkeypatch.setattr(tracking.SF, "read_detection_stream", read)
    out = plans.QUERIES["t01_track_scene_stream"](spark, DATA)
    mine = sorted((r.video_id, r.frame_no, r.det_id, r.track_id) for r in out.collect())
    (path, files), = asked
    assert files > 1 and len(glob.glob(f"{path}/*.parquet")) == 4 * files + 1
    theirs = duck.execute(f"SELECT video_id, frame_no, det_id, track_id FROM ({plans.ORACLES['t01_track_scene_stream']})").fetchall()
    assert mine == sorted(theirs)
