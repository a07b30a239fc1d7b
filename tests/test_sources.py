import json
import struct

from pyspark.sql import functions as F

from detlake.sources import audit, documents, files, labels, regions, sinks

NAMES = ["person", "car"]


def test_label_folder_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.2 0.2\n0 0.5 0.5 0.2 0.2\n\n1 0.25 0.25 0.1 0.1\n")
    (tmp_path / "b.txt").write_text("1 0.1 0.1 0.5 0.1 0.5 0.4 0.1 0.4\n0 0.2 0.2 0.4 0.4\n")
    (tmp_path / "c.txt").write_text("1 1.5 0.5 0.2 0.2\n")
    (tmp_path / "d.txt").write_text("")
    (tmp_path / "e.txt").write_text("7 0.5 0.5 0.2 0.2\n")
    parsed = labels.parse_labels(labels.read_label_lines(spark, str(tmp_path)))
    a = {r.path.rsplit("/", 1)[1]: (r.rows, r.duplicates, r.reason) for r in labels.audit_labels(parsed, 2).collect()}
    assert a == {"a.txt": (3, 1, None), "b.txt": (2, 0, None), "c.txt": (1, 0, "out of bounds"), "e.txt": (1, 0, "class")}
    got = labels.read_labels(spark, str(tmp_path), 2).orderBy("image_id", "cls").collect()
    assert [(r.image_id, r.cls, r.polygon and len(r.polygon)) for r in got] == [("a", 0, None), ("a", 1, None), ("b", 0, 2), ("b", 1, 4)]
    status = labels.label_status(
        spark.createDataFrame([(str(tmp_path / f"{n}.txt"),) for n in "abcdefg"], "path string"),
        spark.createDataFrame([(str(tmp_path / f"{n}.txt"),) for n in "abcde"], "path string"),
        labels.audit_labels(parsed, 2),
    ).first()
    assert tuple(status) == (2, 5, 1, 2, 7)


def test_text_round_trip_is_exact(spark, tables, tmp_path):
    d = tables.det.join(tables.images, "image_id").select("image_id", "cls", "x1", "y1", "x2", "y2", "width", "height").distinct()
    sinks.write_labels(sinks.label_lines(d), str(tmp_path / "out"))
    folder = str(tmp_path / "out")
    n = labels.parse_labels(labels.read_label_lines(spark, folder)).filter("NOT bad").count()
    assert n == d.count()


def test_image_headers(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 64, 48)
    frame = b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 30, 40) + bytes(6)
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8" + frame + b"\xff\xd9")
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8" + frame)
    (tmp_path / "d.png").write_bytes(b"nonsense")
    (tmp_path / "e.bmp").write_bytes(b"BM" + bytes(16) + struct.pack("<ii", 5, 5))
    got = {r.image_id: (r.width, r.height, r.status) for r in audit.read_image_audit(spark, str(tmp_path)).collect()}
    assert got == {"a": (64, 48, "ok"), "b": (40, 30, "ok"), "c": (40, 30, "truncated"), "d": (None, None, "corrupt"), "e": (5, 5, "corrupt")}


def test_scans(spark, tmp_path):
    for p in ("train/cat/1.jpg", "train/dog/2.JPG", "train/dog/x.txt", "val/dog/3.png", "val/dog/m.mp4"):
        f = tmp_path / "d" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    root = str(tmp_path / "d")
    assert sorted(r.image_id for r in files.scan_images(spark, root).collect()) == ["1", "2", "3"]
    assert sorted(r.kind for r in files.scan_media(spark, root).collect()) == ["image"] * 3 + ["video"]
    tree = {(r.split, r.class_name, r.cls) for r in files.read_class_tree(spark, root).collect()}
    assert tree == {("train", "cat", 0), ("train", "dog", 1), ("val", "dog", 0)}
    (tmp_path / "list.txt").write_text("./images/a.jpg\n/abs/b.jpg\n\n")
    got = sorted(r.path for r in files.scan_list(spark, str(tmp_path / "list.txt")).collect())
    assert got == sorted([f"{tmp_path}/images/a.jpg", "/abs/b.jpg"])


def test_hash_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(f"/p/{i}", i) for i in range(100)], "path string, length long")
    assert files.dataset_hash(a).first() == files.dataset_hash(a.orderBy(F.rand(3))).first()
    b = a.withColumn("path", F.when(F.col("length") == 7, "/p/x").otherwise(F.col("path")))
    assert files.dataset_hash(a).first().digest != files.dataset_hash(b).first().digest


def test_coco_file(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "width": 100, "height": 50, "file_name": "1.jpg"}],
        "annotations": [
            {"id": 1, "image_id": 1, "category_id": 1, "bbox": [0, 0, 10, 10], "iscrowd": 0},
            {"id": 2, "image_id": 1, "category_id": 1, "bbox": [0, 0, 10, 10], "iscrowd": 0},
            {"id": 3, "image_id": 1, "category_id": 12, "bbox": [5, 5, 10, 10], "iscrowd": 0},
            {"id": 4, "image_id": 1, "category_id": 1, "bbox": [5, 5, 10, 10], "iscrowd": 1},
            {"id": 5, "image_id": 1, "category_id": 90, "bbox": [5, 5, 0, 10], "iscrowd": 0},
        ],
    }
    (tmp_path / "instances.json").write_text(json.dumps(doc, indent=1))
    got = documents.read_coco(spark, str(tmp_path), documents.to80()).orderBy("ann_id").collect()
    assert [(r.ann_id, r.cls, r.cx, r.cy) for r in got] == [(1, 0, 0.05, 0.1), (3, None, 0.1, 0.2)]
    assert documents.to80()[90] == 79 and documents.to91()[79] == 90


def test_class_lines(spark):
    df = spark.createDataFrame([(1, [0.25, 0.75])], "image_id int, probs array<double>")
    assert [r.line for r in sinks.class_lines(df, NAMES, 2).orderBy("rank").collect()] == ["0.75 car", "0.25 person"]


def test_snapshot_reuses_until_files_change(spark, tmp_path):
    a = spark.createDataFrame([("/p/1", 1)], "path string, length long")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for f in (a, a, a.withColumn("length", F.lit(2).cast("long"))):
        assert sinks.snapshot(spark, f, build, str(tmp_path / "s")).count() == 3
    assert len(calls) == 2


def test_equal_names_in_two_folders_stay_apart(spark, tmp_path):
    for split, row in (("train", "0 0.5 0.5 0.2 0.2"), ("val", "1 0.4 0.4 0.1 0.1")):
        for kind, name, content in (("images", "0001.jpg", b"x"), ("labels", "0001.txt", row.encode())):
            folder = tmp_path / kind / split
            folder.mkdir(parents=True)
            (folder / name).write_bytes(content)
    images = files.scan_images(spark, str(tmp_path / "images"), root=str(tmp_path / "images"))
    ann = labels.read_labels(spark, str(tmp_path / "labels"), nc=2, root=str(tmp_path / "labels"))
    got = images.join(ann, "image_id").select("image_id", "cls").collect()
    assert sorted((r.image_id, r.cls) for r in got) == [("train/0001", 0), ("val/0001", 1)]


def test_image_audit_reads_in_full_only_what_it_must(spark, tmp_path):
    def png(w, h):
        return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + bytes(200_000)

    exif = b"\xff\xe1" + struct.pack(">H", 65_000) + bytes(64_998)
    size = b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 48, 64) + bytes(10)
    content = {"a.png": png(30, 20), "late.jpg": b"\xff\xd8" + exif + exif + size + b"\xff\xd9", "cut.jpg": b"\xff\xd8" + size, "bad.jpg": bytes(100_000)}
    for name, b in content.items():
        (tmp_path / name).write_bytes(b)
    got = {r.path.rpartition("/")[2]: (r.width, r.height, r.status, r.reason) for r in audit.read_image_audit(spark, str(tmp_path)).collect()}
    assert got == {
        "a.png": (30, 20, "ok", None), "late.jpg": (64, 48, "ok", None), "cut.jpg": (64, 48, "truncated", "no end marker"),
        "bad.jpg": (None, None, "corrupt", "unreadable"),
    }


def test_regions_file(spark, tmp_path):
    (tmp_path / "slots.json").write_text(json.dumps([{"points": [[0, 0], [4, 0], [4, 4]]}, {"points": [[1, 1], [None, 2]]}, {"points": [[9, 9], [8, 8]]}], indent=1))
    got = regions.read_regions(spark, str(tmp_path / "slots.json")).collect()
    assert [len(r.points) for r in got] == [3, 2] and "video_id" not in got[0].asDict() and got[0].region_id < got[1].region_id


def test_regions_without_id_are_numbered_above_the_others(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"points": [[0, 0], [1, 1]]}\n{"region_id": 1, "points": [[0, 0], [2, 2]]}\n{"points": [[0, 0], [3, 3]]}\n')
    (tmp_path / "b.json").write_text('{"points": [[0, 0], [4, 4]]}\n' + '{"region_id": 0, "points": [[0, 0], [5, 5]]}\n' * 1)
    got = regions.read_regions(spark, str(tmp_path), multiline=False).collect()
    assert {r.points[1].x: r.region_id for r in got} == {1.0: 2, 2.0: 1, 3.0: 3, 4.0: 4, 5.0: 0}
