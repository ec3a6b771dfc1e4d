"""Image copies confirmed on pixels, and a scan of a folder with planted damage."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.functions import images as I
from probity.operators import cells, duplicates, image_copies, outliers
from probity.operators.generators import precision_recall
from probity.operators.neighbours import nearest
from probity.plans import folders
from probity.sources.datasets import decode_images


def png(path, rgb):
    raw = b"".join(b"\0" + r.tobytes() for r in rgb.astype(np.uint8))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def picture(rng, label, side=64):
    """A smooth picture whose stripes are those of its label, with its own blobs."""
    y, x = np.mgrid[0:side, 0:side] / side
    g = 110 + 45 * np.sin(2 * np.pi * (2 + label) * (x if label % 2 else y))
    for _ in range(6):
        cy, cx, s = rng.random(3)
        g = g + rng.normal(0, 35) * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (0.02 + 0.05 * s))
    return np.clip(g[..., None] + np.array([12, 0, -12]) + rng.normal(0, 2, (side, side, 3)), 0, 255)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two contributors of 60 pictures each in three classes; contributor_b flips six labels, floods one picture and stamps patches on four."""
    root, rng = tmp_path_factory.mktemp("folder"), np.random.default_rng(5)
    flipped, flood, stamped = set(), set(), set()
    for who in ("contributor_a", "contributor_b"):
        (root / who / "images").mkdir(parents=True)
        (root / who / "labels").mkdir()
        for i in range(60):
            label, name = i % 3, f"{who}/images/p{i:02d}.png"
            g = picture(rng, label)
            if who == "contributor_b" and i < 4:
                g[44:60, 44:60] = np.where(np.indices((16, 16)).sum(0)[..., None] % 2, 255, 0)
                stamped.add(name)
            png(root / name, g)
            if who == "contributor_b" and 20 <= i < 26:
                label = (label + 1) % 3
                flipped.add(name)
            (root / who / "labels" / f"p{i:02d}.txt").write_text(f"{label} 0.5 0.5 0.5 0.5\n")
            if who == "contributor_a" and 10 <= i < 13:  # taken twice, as happens
                png(root / who / "images" / f"twice{i}.png", np.clip(g + 1, 0, 255))
                (root / who / "labels" / f"twice{i}.txt").write_text(f"{label} 0.5 0.5 0.5 0.5\n")
            if name == "contributor_b/images/p50.png":
                flood.add(name)
                for k in range(7):
                    copy = f"{who}/images/copy{k}.png"
                    png(root / copy, np.clip(g + rng.normal(0, 0.6, g.shape) + k, 0, 255))
                    (root / who / "labels" / f"copy{k}.txt").write_text(f"{label} 0.5 0.5 0.5 0.5\n")
                    flood.add(copy)
    (root / "classes.txt").write_text("one\ntwo\nthree\n")
    (root / "contributor_a" / "images" / "broken.png").write_bytes(b"no image")
    return root, flipped, flood, stamped


def test_copies_are_confirmed_on_pixels(spark, folder):
    root, _, flood, _ = folder
    rows = I.image_rows(decode_images(spark, str(root)))
    members, pairs, cut = image_copies.image_clusters(rows)
    assert 0.5 <= cut < 0.98  # pictures of a label are alike
    size = {r.cluster: r.n for r in members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    big = [c for c, n in size.items() if n > 2]
    assert sorted(n for n in size.values() if n > 1) == [2, 2, 2, 8] and {r.id.split("/folder0/")[-1] for r in members.filter(F.col("cluster") == big[0]).collect()} == flood
    assert image_copies.repeated(members).count() == 10 and members.count() == 130
    same = rows.withColumn("phash", F.lit(1).cast("bigint"))
    assert image_copies.image_clusters(same, cut=0.9)[0].select("cluster").distinct().count() > 100
    assert image_copies.image_clusters(rows.limit(0))[0].collect() == []


def test_a_folder_is_scanned_end_to_end(spark, folder):
    root, flipped, flood, stamped = folder
    a = folders.scan_folder(spark, str(root))
    assert a.status == "ASSESSED" and any("1 samples have no image" in n for n in a.limitations)
    short = lambda c: F.regexp_replace(c, ".*/folder0/", "")
    found = a.findings.withColumn("id", short("affected_asset")).cache()
    truth = lambda names: spark.createDataFrame([(n,) for n in names], "id string")
    flips = precision_recall(truth(flipped), found.filter("attack_class = 'LABEL_FLIPPING'").select("id"), 130).first()
    assert flips.recall >= 0.8 and flips.precision >= 0.6
    marks = precision_recall(truth(stamped), found.filter("attack_class = 'TRIGGER_INJECTION' and confidence >= 0.45").select("id"), 130).first()
    print("flips", flips, "triggers", marks)
    assert marks.recall >= 0.75 and marks.false_positive_rate <= 0.15  # one signal alone is held at 0.45
    (one,) = found.filter("attack_class = 'NEAR_DUPLICATE_FLOODING'").collect()
    assert one.id in flood and int(one.evidence["size"]) == 8
    assert {r.contributor for r in found.filter("attack_class = 'LABEL_FLIPPING'").select("contributor").distinct().collect()} <= {"contributor_a", "contributor_b"}


def test_a_coco_folder_is_scanned(spark, tmp_path):
    rng = np.random.default_rng(6)
    (tmp_path / "images").mkdir()
    for i in range(24):
        png(tmp_path / "images" / f"{i}.png", picture(rng, i % 2))
    doc = {"images": [{"id": i, "file_name": f"images/{i}.png", "contributor": f"v{i % 2}"} for i in range(25)], "annotations": [{"id": i, "image_id": i, "category_id": i % 2, "bbox": [0, 0, 1, 1]} for i in range(25)], "categories": []}
    (tmp_path / "annotations.json").write_text(json.dumps(doc))
    samples, images, notes = folders.folder_tables(spark, str(tmp_path))
    assert samples.count() == 25 and samples.join(images, "path").count() == 24 and notes == ["1 samples have no image that can be read: not assessed"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.txt").write_text("no")
    assert folders.scan_folder(spark, str(tmp_path / "none")).status == "NOT_ASSESSED"


def test_ids_of_any_type_and_null_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(f"id{i}", i % 2, (rng.normal(i % 2, 1, 4)).tolist()) for i in range(60)] + [("none", 0, None)]
    df = spark.createDataFrame(rows, "vec_id string, label int, embedding array<double>")
    key = lambda d: sorted((r.id, r["rank"], r.neighbour) for r in d.collect())
    assert key(nearest(df, 3)) == key(cells.indexed(df, 3, exact=True)) and nearest(df, 3).count() == 180
    for d in (outliers.mahalanobis_ood(df), outliers.spectral_signatures(df), outliers.isolation_forest(df)):
        assert d.count() == 60 and isinstance(d.first().id, str)
    assert outliers.activation_clusters(df).count() == 2
    pairs = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string")
    spark.sparkContext.setCheckpointDir("/tmp/probity-test-checkpoints")
    assert sorted(map(tuple, duplicates.components(pairs).collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]


def test_silhouettes_of_all_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, rng.normal(4 * (i % 7 == 0), 1, 5).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r.label: r.silhouette for r in outliers.activation_clusters(df, silhouette_rows=None).collect()}
    want = {r.label: r.silhouette for r in outliers.activation_clusters(df).collect()}  # all rows are below the bound
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
