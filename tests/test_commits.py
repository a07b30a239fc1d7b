"""Writers that run again, and snapshots that read changed files only."""

import os

import pytest
from pyspark.sql import functions as F

from detlake.sources import commits as C
from detlake.sources import sinks as K


def listed(path):
    out = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.startswith("part-"):
                with open(os.path.join(folder, n)) as f:
                    out.setdefault(os.path.relpath(folder, path), []).extend(f.read().splitlines())
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("shards", [None, 3])
def test_label_files_written_twice_are_the_same(spark, tmp_path, shards):
    path = str(tmp_path / "labels")
    lines = spark.createDataFrame([(i % 7, f"{i} 0.5") for i in range(40)] + [(3, "9 9"), (3, "9 9")], "image_id int, line string")
    K.write_labels(lines, path, shards)
    first = listed(path)
    assert sum(map(len, first.values())) == 42
    K.write_labels(lines, path, shards)
    assert listed(path) == first
    K.write_labels(spark.createDataFrame([(3, "only")], lines.schema), path, shards)
    got = sorted(x for v in listed(path).values() for x in v)
    rest = [f"{i} 0.5" for i in range(40) if i % 7 != 3]
    assert len(got) == len(rest) + 1 and sum("only" in x for x in got) == 1


def test_metric_rows_are_replaced_by_run_and_epoch(spark, tmp_path):
    schema = "run_id string, epoch int, loss double"
    for shards in (None, 2):
        path = str(tmp_path / f"log{shards}")
        K.append_metrics(spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.25), ("b", 1, 3.0)], schema), path, ["loss"], shards=shards)
        for _ in range(2):
            K.append_metrics(spark.createDataFrame([("a", 2, 0.125), ("a", 3, 1.0), ("c", 1, 7.0)], schema), path, ["loss"], shards=shards)
        back = spark.read.schema("run_id string, epoch int, loss string").option("header", "true").csv(path).select("run_id", "epoch", "loss")
        assert sorted(map(tuple, back.collect())) == [("a", 1, "0.5"), ("a", 2, "0.125"), ("a", 3, "1"), ("b", 1, "3"), ("c", 1, "7")]


def test_keys_with_nulls_and_repeated_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("x", None, 1), ("x", 2, 2), ("x", 2, 2), (None, 5, 5)], "f string, k int, v int")
    C.replace_keys(rows, path, "f", ["f", "k"])
    C.replace_keys(rows.filter("k IS NULL").withColumn("v", F.lit(9)), path, "f", ["f", "k"])
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = spark.read.schema("k int, v int, f string").parquet(path).select("k", "v").collect()
    assert sorted(map(tuple, got), key=key) == sorted([(2, 2), (2, 2), (5, 5), (None, 9)], key=key)


@pytest.fixture
def folder(spark, tmp_path):
    read = []

    def parse(files):
        names = [r.path for r in files.select("path").collect()]
        read.append(sorted(names))
        return files.select("path", F.explode(F.sequence(F.lit(1), F.col("length"))).alias("row"))

    return C.LabelSnapshot(spark, str(tmp_path / "snap")), parse, read


def table(spark, **files):
    return spark.createDataFrame(list(files.items()), "path string, length long")


def rows(snap):
    out = {}
    for r in snap.read().collect():
        out.setdefault(r.path, []).append(r.row)
    return {k: len(v) for k, v in out.items()}


def test_only_changed_files_are_parsed(spark, folder):
    snap, parse, read = folder
    assert snap.update(table(spark, a=2, b=3, c=1), parse) == {"added": 3, "changed": 0, "removed": 0, "kept": 0}
    assert snap.update(table(spark, a=2, b=3, c=1), parse)["kept"] == 3 and len(read) == 1
    assert snap.update(table(spark, a=2, b=5, d=4), parse) == {"added": 1, "changed": 1, "removed": 1, "kept": 1}
    assert read == [["a", "b", "c"], ["b", "d"]]
    assert rows(snap) == {"a": 2, "b": 5, "d": 4}
    assert snap.update(table(spark, b=5, d=4), parse)["removed"] == 1
    assert read[2:] == [[]] and rows(snap) == {"b": 5, "d": 4}
    assert snap.update(table(spark), parse) == {"added": 0, "changed": 0, "removed": 2, "kept": 0}
    assert rows(snap) == {}


def test_a_failed_update_is_not_seen_and_can_be_repeated(spark, folder):
    snap, parse, read = folder
    snap.update(table(spark, a=1, b=1), parse)

    def broken(files):
        return parse(files).withColumn("row", F.assert_true(F.lit(False)).cast("int"))

    with pytest.raises(Exception):
        snap.update(table(spark, a=1, b=2), broken)
    assert rows(snap) == {"a": 1, "b": 1}
    snap.update(table(spark, a=1, b=2), parse)
    assert rows(snap) == {"a": 1, "b": 2} and read[-1] == ["b"]


def test_files_listed_twice_and_files_without_rows(spark, folder):
    snap, parse, _ = folder
    twice = spark.createDataFrame([("a", 2), ("a", 2), ("empty", None)], "path string, length long")
    counts = snap.update(twice, parse)
    assert counts["added"] == 2 and rows(snap) == {"a": 2}
    with pytest.raises(ValueError):
        C.LabelSnapshot(spark, snap.path + "-none").read()
