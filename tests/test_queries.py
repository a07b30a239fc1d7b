"""Registered queries against DuckDB. All of them with DETLAKE_ALL=1, otherwise a cross-section."""

import os

import pytest

from detlake import plans

from .conftest import DATA

plans.load()
SOME = (
    "g04_xyxy2xywhn g12_min_area_box g18_polygon_box g26_transform_polygons m03_box_similarity m07_window_share j02_self_overlap "
    "x01_match a04_map a06_best_f1 a10_confusion x04_nms x05_nms_agnostic x06_rotated_nms s04_read_labels s06_read_coco "
    "s12_read_voc k01_label_lines q02_audit_labels q08_dataset_hash a13_image_stats w07_batch_shapes v01_crossing v06_heatmap "
    "v09_count_reps w01_track_line g44_overlap_index m04_mask_iou x15_select_by_prompt g28_mosaic9 f05_paste_candidates "
    "l06_sample_prompts w05_early_stop w06_smooth t03_latest_frame t06_windowed_counts t07_crossing_stream t07_reps_stream"
).split()
NAMES = sorted(plans.ORACLES) if os.environ.get("DETLAKE_ALL") else SOME


def text(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(name, spark, duck):
    df = plans.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(text(r[i]) for i in at) for r in cur.fetchall())
    assert mine and mine == theirs


def test_every_query_is_registered_once():
    assert set(plans.ORACLES) <= set(plans.QUERIES)
    assert len(plans.QUERIES) > 150
