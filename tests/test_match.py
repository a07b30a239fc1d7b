"""Ties, copies and rows without confidence in the matching of detections and truths."""

from pyspark.sql import functions as F

from detlake.operators import match

BOX = (0.0, 0.0, 10.0, 10.0)


def _det(spark, rows):
    return spark.createDataFrame(rows, "image_id long, det_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double")


def _ann(spark, rows):
    return spark.createDataFrame(rows, "image_id long, ann_id long, cls int, x1 double, y1 double, x2 double, y2 double")


def test_ties_go_to_the_lowest_id_and_no_confidence_comes_last(spark):
    ann = _ann(spark, [(1, 7, 0, *BOX), (1, 8, 0, *BOX), (2, 9, 0, *BOX), (3, 4, 0, *BOX)])
    det = _det(spark, [(1, 5, 0, 0.9, *BOX), (1, 3, 0, 0.9, *BOX), (2, 1, 0, None, *BOX), (2, 2, 0, 0.1, *BOX), (3, 6, 0, None, *BOX)])
    got = {(r.image_id, r.det_id): (r.tp_mask > 0, r.ann_id) for r in match.match_predictions(det, ann).collect()}
    assert got == {(1, 3): (True, 7), (1, 5): (False, None), (2, 2): (True, 9), (2, 1): (False, None), (3, 6): (True, 4)}
    counts = match.evaluation_counts(det, ann).where("conf IS NULL AND n > 0").collect()
    assert [(r.n, r.tp0) for r in counts] == [(2, 1)]


def test_the_closer_taker_wins_only_where_both_reach_the_threshold(spark):
    ann = _ann(spark, [(1, 1, 0, *BOX)])
    det = _det(spark, [(1, 1, 0, 0.9, 0.0, 0.0, 10.0, 6.0), (1, 2, 0, 0.5, *BOX)])
    masks = {r.det_id: r.tp_mask for r in match.match_predictions(det, ann, (0.5, 0.75)).collect()}
    assert masks == {1: 1, 2: 2}


def test_counts_and_confusion_plan_no_sorts(spark):
    ann, det = _ann(spark, [(1, 1, 0, *BOX)]), _det(spark, [(1, 1, 0, 0.9, *BOX)])
    for df in (match.evaluation_counts(det, ann), match.match_for_confusion(det, ann).groupBy("pred_cls").agg(F.count("*"))):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
