"""Sources whose inputs are large, malformed or many."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from probity.sources import datasets, records
from probity.sources.json_scan import scan_documents

TRICKY = ["}", "{", '"', "\\", "]", "[", "a}b", '\\"}', "é}", "x" * 900, "\\\\", '{"k":1}', "\n"]


@pytest.fixture
def small_ranges(spark):
    """Ranges of 700 bytes, so that small files are many."""
    mine = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in mine.items():
        spark.conf.set(k, v)
    yield
    for k in mine:
        spark.conf.unset(k)


def an_object(rng, i):
    return {"id": i, "s": rng.choice(TRICKY) + rng.choice(TRICKY), "n": {"a": [{"b": rng.choice(TRICKY)}, []]}, "z": rng.choice([None, 1.5, [1, 2], {}])}


def test_json_of_any_size_is_read_by_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    docs = {
        "a.json": [an_object(rng, i) for i in range(40)], "e.json": [], "o.json": {}, "mixed.json": [1, "}", {"a": 1}, [{"b": 2}], {"c": {}}],
        "w.json": {"info": {"contributor": "x}", "deep": {"a": {}}}, "images": [an_object(rng, i) for i in range(25)], "empty": [], "n": 3, "annotations": [an_object(rng, i) for i in range(30)], "e2": {}, "last": "}"},
    }
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc, ensure_ascii=False, indent=rng.choice([None, 1])))
    (tmp_path / "t.json").write_text(json.dumps(docs["a.json"])[:-30])
    (tmp_path / "l.json").write_text("\n".join(json.dumps(an_object(rng, i)) for i in range(5)))
    objects, files = scan_documents(spark, str(tmp_path))
    got = {}
    for r in objects.orderBy("file", "block", "k").collect():
        got.setdefault((os.path.basename(r.file), r.section), []).append((json.loads(r.value) if not r.file.endswith("t.json") else r.value, r.listed))
    for name, doc in docs.items():
        want = {None: [(v, True) for v in doc if isinstance(v, dict)]} if isinstance(doc, list) else {k: [(v, True) for v in y if isinstance(v, dict)] if isinstance(y, list) else [(y, False)] for k, y in doc.items() if isinstance(y, (list, dict))}
        for section, rows in want.items():
            assert got.get((name, section), []) == rows, (name, section)
    assert objects.select("file", "block").distinct().count() > 20
    known = {os.path.basename(r.file): (r.lead, r.tops, r.error) for r in files.collect()}
    assert known["a.json"] == ("[", 1, None) and known["w.json"] == ("{", 1, None) and known["l.json"] == ("{", 5, None) and known["t.json"][2] == "brackets don't match"


def test_large_records_are_read_whole(spark, tmp_path, small_ranges):
    rng = random.Random(2)
    (tmp_path / "a.json").write_text(json.dumps({"meta": {"records": 1}, "data": [an_object(rng, i) for i in range(50)], "inferences": [{"id": f"i{i}"} for i in range(30)]}))
    (tmp_path / "b.json").write_text(json.dumps([an_object(rng, i) for i in range(60)], indent=1))
    (tmp_path / "c.jsonl").write_text(",\n".join(json.dumps(an_object(rng, i)) for i in range(40)) + "\nnot json\n")
    (tmp_path / "d.json").write_text("\n".join(json.dumps(an_object(rng, i)) for i in range(40)))
    (tmp_path / "e.json").write_text('{"record_id": "small"}')
    (tmp_path / "f.json").write_text("not json at all" * 100)
    (tmp_path / "g.json").write_text(json.dumps({"record_id": "one", "data": {"x": "y" * 900}}))
    key = lambda d: sorted((os.path.basename(r.file), r.raw) for r in d.collect())
    whole, left = records.read_records(spark, str(tmp_path))
    by_ranges, missing = records.read_records(spark, str(tmp_path), whole=300)
    assert [x for x in key(whole) if x[0] != "g.json"] == key(by_ranges) and len(key(by_ranges)) == 30 + 60 + 40 + 40 + 1
    order = lambda d, name: [r.raw for r in d.orderBy("pos").collect() if r.file.endswith(name)]
    assert all(order(whole, n) == order(by_ranges, n) for n in ("a.json", "b.json", "c.jsonl", "d.json"))
    assert {os.path.basename(r.file) for r in left.collect()} == {"f.json"}
    assert {os.path.basename(r.file): r.error for r in missing.collect()}.keys() == {"f.json", "g.json"}
    assert records.load_records(spark, str(tmp_path), max_output=3).filter("output like '%_truncated%'").count() == 0


def test_large_coco_equals_the_whole_reader(spark, tmp_path, small_ranges):
    images = [{"id": i, "file_name": f"x/source_{i % 3}/{i}.jpg", "width": 4, "height": 5} | ({"contributor": "me}"} if i % 5 == 0 else {}) for i in range(60)]
    notes = [{"id": k, "image_id": k % 50, "category_id": k % 4, "bbox": [0, 0, k, 1], "s": "}{"} for k in range(200)]
    doc = {"info": {"metadata": {"note": "}"}}, "images": images + [{"file_name": "none"}], "annotations": notes + [{"id": 1}, {"id": 7, "image_id": 999}], "categories": [{"id": 1, "name": "t"}]}
    path = str(tmp_path / "c.json")
    (tmp_path / "c.json").write_text(json.dumps(doc))
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(datasets.load_coco(spark, path)) == rows(datasets.load_coco(spark, path, whole=100)) and datasets.load_coco(spark, path).count() == 61
    errors = datasets.coco_errors(spark, path, whole=100)
    assert rows(errors) == rows(datasets.coco_errors(spark, path)) and sorted(r.error for r in errors.collect()) == ["an annotation of no image", "an annotation without an image's id", "an image without an id"]
    assert datasets.find_coco(spark, str(tmp_path), whole=100).endswith("c.json")
    assert datasets.coco_image_dir(spark, path) == str(tmp_path)
    (tmp_path / "annotations").mkdir()
    (tmp_path / "val2017").mkdir()
    assert datasets.coco_image_dir(spark, str(tmp_path / "annotations" / "c.json")).endswith("val2017") and datasets.coco_image_dir(spark, path, str(tmp_path / "val2017")).endswith("val2017")


def test_format_is_judged_by_all_names(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    for i in range(1000):
        (tmp_path / "labels" / f"{i:04d}.txt").write_text("0 0.5 0.5 0.1 0.1\n")
    assert datasets.detect_format(spark, str(tmp_path)) == "yolo"
    (tmp_path / "zz.json").write_text(json.dumps({"images": [], "other": 1}))
    assert datasets.detect_format(spark, str(tmp_path)) == "yolo"
    (tmp_path / "zzz.json").write_text(json.dumps({"images": [], "annotations": []}))
    assert datasets.detect_format(spark, str(tmp_path)) == "coco"


def test_yolo_folders_names_and_errors(spark, tmp_path):
    (tmp_path / "data.yaml").write_text("names: [tank, truck]\n")
    for p in ("images/a.jpg", "images/b.jpg", "truck/c.jpg", "ship/d.jpg", "boat/e.jpg", "boat/f.jpg", "train/g.jpg"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "a.txt").write_text("1 0.5 0.5 0.2 0.2\nbroken line\n\n1 x 0.5 0.2 0.2\n")
    (tmp_path / "labels" / "lost.txt").write_text("0 0.5 0.5 0.2 0.2\n")
    (tmp_path / "labels" / "b.txt").write_text("")
    got = {r.sample_id: (r.primary_label, r.class_name, r.labels) for r in datasets.load_yolo(spark, str(tmp_path)).collect()}
    assert got == {"a.jpg": (1, "truck", [1]), "b.jpg": (-1, "class_-1", []), "c.jpg": (1, "truck", [1]), "d.jpg": (3, "ship", [3]), "e.jpg": (2, "boat", [2]), "f.jpg": (2, "boat", [2]), "g.jpg": (-1, "class_-1", [])}
    errors = datasets.yolo_errors(spark, str(tmp_path)).collect()
    assert sorted((os.path.basename(r.file), r.error) for r in errors) == [("a.txt", "malformed label line: 1 x 0.5 0.2 0.2"), ("a.txt", "malformed label line: broken line"), ("lost.txt", "a label file without an image")]
    _, fmt, said = datasets.load_dataset(spark, str(tmp_path))
    assert fmt == "yolo" and said == ["3 label lines or files couldn't be read"]
    assert datasets.load_yolo(spark, str(tmp_path), limit=2).count() == 2
    (tmp_path / "data.yaml").write_text("names: {4: tank, 9: ship}\n")
    assert {r.sample_id: r.primary_label for r in datasets.load_yolo(spark, str(tmp_path)).collect() if r.sample_id in "c.jpg d.jpg e.jpg"} == {"c.jpg": 11, "d.jpg": 9, "e.jpg": 10}
    d = spark.createDataFrame([("images/a.jpg", 1), ("images/no.jpg", 2), (str(tmp_path / "ship" / "d.jpg"), 3)], "path string, full int")
    assert [r.exists for r in datasets.with_existing(d, str(tmp_path)).orderBy("full").collect()] == [True, False, True]
