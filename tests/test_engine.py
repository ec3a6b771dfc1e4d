"""The engine's operators: known vectors, edge inputs, sources, planted damage."""

import json
import math
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.functions import images as I
from probity.functions import stats as S
from probity.functions import text as X
from probity.operators import correlate, drift, duplicates, generators, labels, models, office, outliers, provenance, triggers
from probity.operators import findings as fnd
from probity.plans import queries as plans
from probity.plans import scan, store
from probity.sources import datasets, records
from probity.sources.tables import Store

SF = "/root/testdata/sf0.001"
F6 = "finding_id string, attack_class string, affected_asset string, severity string, confidence double, disposition string, contributor string, module string, evidence map<string,string>"


def found(spark, rows):
    full = [(f"F{k:03d}", r[0], r[1], r[2], r[3], r[4] if len(r) > 4 else "REVIEW", r[5] if len(r) > 5 else None, r[6] if len(r) > 6 else "data_scanner", r[7] if len(r) > 7 else {}) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, F6)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "documents", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(plans.ORACLES[name]).df()
    got = plans.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)

    def text(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{float(v):.4f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)

    rows = lambda df: sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_records_are_accepted_as_if_inserted_one_by_one(spark):
    from probity.plans import store

    rng = np.random.default_rng(5)
    pick = lambda k: None if rng.random() < 0.1 else f"{k}{rng.integers(12)}"
    kept = [(0, "r1", "n1")]
    new = [(1, "r2", "n2"), (2, "r2", "n3"), (3, "r3", "n3"), *((k, pick("r"), pick("n")) for k in range(4, 60))]
    ids, nonces, want = {"r1"}, {"n1"}, []
    for k, r, n in new:
        if r not in ids and n not in nonces:
            want.append(k)
            ids |= {r} - {None}
            nonces |= {n} - {None}
    cols = "seq long, record_id string, nonce string"
    got = store.accept_records(spark.createDataFrame(kept, cols), spark.createDataFrame(new, cols), "seq")
    assert sorted(r.seq for r in got.collect()) == want and {1, 3} <= set(want)


def test_lookups(spark):
    from probity.plans import store

    scans = spark.createDataFrame([("a", 1), ("b", 2)], "scan_id string, started_ns long")
    assert [r.started_ns for r in store.get_scan(scans, "b").collect()] == [2] and store.get_scan(scans, "c").collect() == []
    risks = spark.createDataFrame([("a", "x", 0.2), ("a", "y", 0.9), ("b", "x", 0.5)], "scan_id string, name string, risk_score double")
    assert [r.name for r in store.get_contributor_risks(risks, "a").collect()] == ["y", "x"] and store.get_contributor_risks(risks).count() == 3
    records = spark.createDataFrame([("r2", "m", 2, 5), ("r1", "m", 1, 9), ("r3", "k", 0, 1)], "record_id string, model_id string, sequence_number long, timestamp_ns long")
    assert [r.record_id for r in store.get_provenance_records(records, "m").collect()] == ["r1", "r2"] and store.get_provenance_records(records, limit=1).first().record_id == "r3"
    models_ = spark.createDataFrame([("h", "one")], "weight_hash string, name string")
    assert store.find_model(models_, "h").first().name == "one" and store.find_model(models_, "g").collect() == []


def test_merkle_proofs_of_odd_trees(spark):
    import hashlib

    for n in (0, 1, 2, 3, 255, 257, 300):
        leaves = spark.createDataFrame([(k, f"x{k}") for k in range(n)], "pos long, hash string")
        level = [hashlib.sha256(b"\x00" + f"x{k}".encode()).digest() for k in range(n)]
        depth = 1 if n else 0
        while len(level) > 1:
            level = [hashlib.sha256(b"\x01" + level[k] + level[min(k + 1, len(level) - 1)]).digest() for k in range(0, len(level), 2)]
            depth += 1
        top = provenance.merkle_root(leaves).first()
        assert (top.root, top.depth, top.leaves) == (level[0].hex() if n else "0" * 64, depth, n)
        proofs = provenance.merkle_proofs(leaves)
        assert provenance.verify_proofs(proofs).filter("valid").count() == n
        assert n == 0 or {r.root for r in proofs.collect()} == {top.root}


def test_activation_clusters_count_whole_classes(spark):
    rng = np.random.default_rng(9)
    one, two = rng.normal(0, 1, (300, 12)), rng.normal(0, 1, (260, 12))
    one[:60] += 9.0
    rows = [(i, 0, [float(x) for x in v]) for i, v in enumerate(one)] + [(1000 + i, 1, [float(x) for x in v]) for i, v in enumerate(two)] + [(5000 + i, 2, [0.0] * 12) for i in range(5)]
    got = {r.label: r for r in outliers.activation_clusters(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)).collect()}
    assert (got[0].n, got[1].n, got[2].n) == (300, 260, 5) and got[0].imbalance == 0.8 and got[0].silhouette > 0.5 and got[0].flagged
    assert got[1].imbalance < 0.7 and not got[1].flagged and not got[2].flagged and math.isnan(got[2].imbalance)


def test_data_scan_finds_what_is_planted(spark):
    from probity.plans.scan import scan_data

    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    images = emb.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") == 7, 0.6).otherwise(0.1 + 0.001 * (F.col("vec_id") % 9)).alias("high_freq_ratio"), F.when(F.col("vec_id") == 7, 50.0).otherwise(1.0 + 0.1 * (F.col("vec_id") % 7)).alias("patch_score"), F.lit(0.9).alias("patch_uniformity"), (5.0 + F.col("vec_id") % 5).alias("spectral_peak_ratio"))
    docs = spark.createDataFrame([(k, f"only text number {k} about thing{k} and item{k}") for k in range(30)] + [(100 + k, "the same words in every copy of this text, again and again") for k in range(9)] + [(200, "the same words in every copy of this text, again and yet")] + [(300 + k, f"pair number{k // 2} says thing{k // 2} twice over again{k // 2}") for k in range(10)], "doc_id long, text string")
    who = emb.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("contributor"))
    hit = emb.withColumn("label", F.when(F.col("vec_id") % 10 == 1, (F.col("label") + 3) % 10).otherwise(F.col("label")))
    got = scan_data(hit, who, images=images, docs=docs).findings.collect()
    kinds = {r.attack_class for r in got}
    assert {"LABEL_FLIPPING", "TRIGGER_INJECTION", "NEAR_DUPLICATE_FLOODING"} <= kinds
    assert "7" in {r.affected_asset for r in got if r.attack_class == "TRIGGER_INJECTION"}
    assert [r.affected_asset for r in got if r.attack_class == "NEAR_DUPLICATE_FLOODING"] == ["100"]


def test_documented_vectors(spark):
    one = fnd.summarise(found(spark, [("LABEL_FLIPPING", "a", "CRITICAL", 0.95)])).first()
    many = fnd.summarise(found(spark, [("LABEL_FLIPPING", "a", "LOW", 0.25)] * 100)).first()
    none = fnd.summarise(found(spark, [])).first()
    assert (one.risk_score, one.verdict) == (0.7125, "COMPROMISED") and many.risk_score == 0.0375 and (none.risk_score, none.verdict) == (0.0, "CLEAN")
    leaves = spark.createDataFrame([], "pos long, hash string")
    assert provenance.merkle_root(leaves).first().root == "0" * 64
    r = spark.createDataFrame([([1.0, 2.0, 3.0], 2.5)], "v array<double>, z double")
    got = r.select(S.softmax(F.col("v")).alias("p"), S.confidence_from_zscore(F.col("z"), 2.5).alias("c"), S.energy_score(F.col("v")).alias("e"), S.clamp(F.lit(float("nan"))).alias("k")).first()
    assert abs(sum(got.p) - 1) < 1e-12 and got.c == 0.5 and abs(got.e + math.log(sum(math.exp(x) for x in (1, 2, 3)))) < 1e-12 and got.k == 0.0
    assert spark.createDataFrame([], "x double").agg(S.noisy_or(F.col("x"))).first()[0] == 0.0
    ran = spark.createDataFrame([], "module string")
    empty = found(spark, [])
    im = correlate.immunity(correlate.pillar_scores(empty, ran), correlate.stories(empty)).first()
    assert (im.score, im.band, im.confidence) == (70.0, "ADEQUATE", 0.0)


def test_edge_inputs(spark):
    emb = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, [0.0, 1.0], 0)], [(i, [0.0, 0.0], 0) for i in range(5)], [(1, None, 0), (2, [float("nan"), 1.0], 0)]):
        a = scan.scan_data(spark.createDataFrame(rows, emb))
        assert a.status == "NOT_ASSESSED" and a.verdict().first().verdict == "NOT_ASSESSED"
    flat = scan.scan_data(spark.createDataFrame([(i, [1.0, 0.0], i % 2) for i in range(40)], emb))
    assert flat.status == "ASSESSED" and flat.findings.count() >= 0
    x = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", None), ("b", float("nan")), ("c", float("inf")), ("c", 2.0)], "g string, x double")
    got = {r.g: r for r in S.robust_stats(x, "x", ["g"]).collect()}
    assert got["a"].mad == 0 and got["a"].skewness == 0 and got["c"].n == 1 and "b" not in got
    assert {r.modified_z for r in S.modified_zscore(x.filter("g = 'a'"), "x").collect()} == {0.0}
    bad = found(spark, [("NONSENSE", "a", "??", 7.0, "??")])
    n = fnd.normalise(bad).first()
    assert (n.attack_class, n.severity, n.disposition, n.confidence) == ("UNKNOWN", "CRITICAL", "QUARANTINE", 1.0)
    v = fnd.invalid(bad).first()
    assert v.bad_class == v.bad_severity == v.bad_confidence == 1 and v.no_id == 0
    assert office.office_verdict(spark.createDataFrame([], "contributor string, risk_score double"), bad).first().verdict == "NOT_ASSESSED"
    none, why = scan.compare(x.limit(0), x.limit(0), ["x"])
    assert none is None and why


def test_planted_label_flips_are_found(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(4, 16)) * 3
    rows = [(i, [float(v) for v in centre[i % 4] + rng.normal(size=16)], i % 4) for i in range(400)]
    emb = generators.flip_labels(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.1, classes=4)
    hit = labels.label_flips(emb).filter("confidence >= 0.65").select(F.col("id"))
    s = generators.precision_recall(emb.filter("flipped").select(F.col("vec_id").alias("id")), hit, 400).first()
    assert s.recall >= 0.95 and s.precision >= 0.95
    m = labels.mislabelled(emb).agg(F.max("confidence")).first()[0]
    assert m > 0.5


def test_spectral_and_mahalanobis_agree_with_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    x[:4] += 6
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    c = x - x.mean(0)
    want = np.abs(c @ np.linalg.svd(c, full_matrices=False)[2][0])
    got = outliers.spectral_signatures(df).orderBy("id").toPandas()
    assert np.allclose(got.score, want) and got.flagged[:4].all()
    cov = np.cov(x.T)
    cov = 0.9 * cov + 0.1 * np.trace(cov) / 5 * np.eye(5) + 1e-6 * np.eye(5)
    d = np.sqrt(np.einsum("ij,jk,ik->i", c, np.linalg.inv(cov), c))
    assert np.allclose(outliers.mahalanobis(df).orderBy("id").toPandas().distance, d)
    iso = outliers.isolation_forest(df).orderBy("id").toPandas()
    assert iso.score[:4].mean() > iso.score[4:].mean()


def test_chain_damage_is_named(spark):
    base = [("c", i, f"r{i}", f"n{i}", 1000 + i, "out") for i in range(6)]
    rec = spark.createDataFrame(base, "chain string, k int, record_id string, nonce string, timestamp_ns long, output string")
    rec = rec.withColumns({"input_hash": F.lit("i"), "model_hash": F.lit("m"), "config_hash": F.lit("g"), "output_hash": F.sha2("output", 256)})
    linked = provenance.link_records(rec, "chain", ["k"])
    assert provenance.verify_chain(linked, "chain", ["k"]).count() == 0
    kinds = lambda d: sorted(r.break_type for r in provenance.verify_chain(d, "chain", ["k"]).collect())
    assert kinds(linked.filter("k <> 2")) == ["BROKEN_LINK", "SEQUENCE_GAP"]
    assert kinds(linked.filter("k <> 0")) == ["MISSING_GENESIS"]
    assert kinds(linked.withColumn("output", F.when(F.col("k") == 3, "x").otherwise(F.col("output")))) == ["PAYLOAD_MISMATCH"]
    assert kinds(linked.withColumn("nonce", F.when(F.col("k") == 5, "n1").otherwise(F.col("nonce")))) == ["DUPLICATE_NONCE", "HASH_MISMATCH"]
    s = provenance.chain_summary(linked, provenance.verify_chain(linked, "chain", ["k"]), "chain", ["k"]).first()
    assert s.chain_valid and s.first_break_index == -1
    proofs = provenance.merkle_proofs(linked.select((F.col("k")).cast("long").alias("pos"), F.col("record_hash").alias("hash")))
    assert all(r.valid for r in provenance.verify_proofs(proofs).collect())


def test_banded_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 60))
    fps = [base ^ sum(1 << int(b) for b in rng.choice(60, rng.integers(0, 9), replace=False)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    got = {(r.a, r.b) for r in duplicates.near_pairs(df).collect()}
    first = {}
    for i, f in enumerate(fps):
        first.setdefault(f, i)
    want = {(min(i, j), max(i, j)) for f, i in first.items() for g, j in first.items() if i < j and (f ^ g).bit_count() <= 5}
    assert got == want
    docs = generators.flood_duplicates(spark.createDataFrame([(i, f"text number {i} " + " ".join(f"w{(i * 37 + k * 11) % 500}" for k in range(60))) for i in range(60)], "doc_id long, text string"), sources=2, copies=7)
    flood = scan.scan_texts(docs, Store(spark, "t")).findings.collect()
    assert len(flood) == 2 and all(f.attack_class == "NEAR_DUPLICATE_FLOODING" for f in flood)


def test_drift_ladder(spark):
    rows = [(i, 100.0 + i % 7, 50.0 + i % 5, 30.0 + i % 3, 10.0 + i % 2) for i in range(200)]
    base = spark.createDataFrame(rows, "id long, brightness double, contrast double, sharpness double, edge_density double")
    same, _ = scan.compare(base, base, plans.PROPS)
    dusk, _ = scan.compare(base, base.withColumns({c: F.col(c) * 0.4 for c in ("brightness", "contrast", "sharpness")}), plans.PROPS)
    odd, _ = scan.compare(base, base.withColumn("contrast", F.col("contrast") * 3), plans.PROPS)
    assert [x.first().shift_type for x in (same, dusk, odd)] == ["NO_SIGNIFICANT_DRIFT", "NATURAL_OPERATIONAL_DRIFT", "SUSPICIOUS_MANIPULATION"]
    b = S.bimodality(spark.createDataFrame([(float(i % 3),) for i in range(60)] + [(100.0 + i % 3,) for i in range(20)], "x double"), "x").first()
    assert b.bimodal and abs(b.minority_fraction - 0.25) < 1e-9


def test_stories_and_report(spark):
    e = {"target_class": "3", "corner": "top-left"}
    f = found(spark, [("TRIGGER_INJECTION", "a", "CRITICAL", 0.9, "QUARANTINE", "x", "data_scanner", e), ("TRIGGER_INJECTION", "b", "CRITICAL", 0.9, "QUARANTINE", "y", "data_scanner", e), ("MODEL_BACKDOOR", "m", "CRITICAL", 0.9, "QUARANTINE", None, "model_auditor", e), ("CHAIN_BREAK", "r", "HIGH", 0.7, "REVIEW", None, "crypto_chain", {}), ("DISTRIBUTION_SHIFT", "s", "HIGH", 0.9, "REVIEW", None, "drift_detector", {"shift_type": "NATURAL_OPERATIONAL_DRIFT"})])
    got = {r.pattern: r for r in correlate.stories(f).collect()}
    assert set(got) == {"TARGETED_CLASS", "COORDINATED_CONTRIBUTORS", "COVER_UP"}  # the chain break isn't corroborated, so no kill chain
    assert got["COORDINATED_CONTRIBUTORS"].key == "TRIGGER_INJECTION|corner=top-left|target_class=3"
    doc = scan.report(f, spark.createDataFrame([("data_scanner",)], "module string"), "s1")
    assert scan.missing_keys(doc) == [] and "Not assessed" in scan.briefing(doc) and json.dumps(doc)
    assert scan.exit_code("NOT_ASSESSED", "CLEAN") == 3 and scan.exit_code("ASSESSED", "COMPROMISED") == 2


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_images_and_label_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    for who in ("contributor_a", "contributor_b"):
        (tmp_path / who / "images").mkdir(parents=True)
        (tmp_path / who / "labels").mkdir()
        for i in range(6):
            g = np.linspace(60, 180, 64)[None, :, None] + rng.normal(0, 6, (64, 64, 1)) + np.array([20, 0, -20])
            if who == "contributor_b" and i == 0:
                g[48:, 48:] = 255
            png(tmp_path / who / "images" / f"im{i}.png", np.clip(g, 0, 255))
            (tmp_path / who / "labels" / f"im{i}.txt").write_text(f"{i % 3} 0.5 0.5 0.25 0.5\n2 0.5 0.5 0.1 0.1\nbroken line here x y\n" if i else "")
    (tmp_path / "bad.png").write_bytes(b"no image")
    root = str(tmp_path)
    assert datasets.list_images(spark, root, 3).count() == 3
    s = {r.path.split("contributor_")[1]: r for r in datasets.load_yolo(spark, root).filter("contributor is not null").collect()}
    assert len(s) == 12 and s["a/images/im0.png"].primary_label == -1 and s["a/images/im2.png"].primary_label == 2 and s["b/images/im1.png"].contributor == "contributor_b"
    assert s["a/images/im1.png"].boxes[0] == [0.375, 0.25, 0.25, 0.5]
    f = I.image_features(datasets.decode_images(spark, root)).cache()
    assert f.count() == 12
    r = f.filter("path like '%contributor_a%'").first()
    assert r.width == 64 and 1.2 < r.color_warmth < 1.6 and 0 <= r.high_freq_ratio <= 1
    spectral = spark.createDataFrame([], "id string, z double, flagged boolean")
    top = triggers.detect_triggers(f, spectral, id_col="path").orderBy(F.col("confidence").desc()).first()
    assert "contributor_b/images/im0" in top.id
    assert "contributor_b/images/im0" in triggers.consensus_triggers(f, spectral, id_col="path").orderBy(F.col("confidence").desc()).first().id
    a = I.grey(rng.integers(0, 255, (40, 50, 3)))
    assert abs(I.ssim(a, a) - 1) < 1e-9 and I.phash(a) == I.phash(a + 1) and abs(I.radial_profile(a).sum() - 1) < 1e-9
    assert I.corner(2, 60, 64, 64) == "top-right" and I.box_mean(np.ones((9, 9)), 4).shape == (9, 9)


def test_records_of_many_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"records": [{"id": "1", "seq": 2, "timestamp": "2024-01-01T00:00:01Z", "prediction": {"b": 1, "a": 2}}, {"uuid": "2", "sequence": "1", "provenance": {"salt": "n"}}]}))
    (tmp_path / "b.jsonl").write_text('{"rid": "3", "index": 5},\nnot json\n{"rid": "4", "index": 4, "output": "' + "x" * 1_100_000 + '"}\n')
    (tmp_path / "c.ndjson").write_text('[{"record_id": "5"}, 7]')
    (tmp_path / "d.json").write_text('{"record_id": "6", "ts": 12}')
    (tmp_path / "e.txt").write_text('{"record_id": "no"}')
    got = records.load_records(spark, str(tmp_path), max_output=1 << 20).collect()
    assert [r.record_id for r in got] == ["5", "6", "2", "1", "4", "3"]
    by = {r.record_id: r for r in got}
    assert by["1"].timestamp_ns == 1704067201 * 10**9 and by["1"].output == '{"a":2,"b":1}' and by["2"].nonce == "n" and "_truncated" in by["4"].output
    records.save_records(spark.createDataFrame([(1, float("nan"))], "a int, b double"), str(tmp_path / "out"))
    assert spark.read.schema("a int, b double").json(str(tmp_path / "out")).first().b is None


def test_coco(spark, tmp_path):
    doc = {"info": {"metadata": {"vendor": "v0"}}, "images": [{"id": 1, "file_name": "x/source_9/a.jpg", "width": 4, "height": 5}, {"id": 2, "file_name": "b.jpg", "contributor": "me"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 3, "bbox": [0, 0, 1, 2]}, {"id": 2, "image_id": 1, "category_id": 3, "bbox": [0, 0, 1, 1]}]}
    (tmp_path / "i.json").write_text(json.dumps(doc))
    got = {r.image_id: r for r in datasets.load_coco(spark, str(tmp_path / "i.json")).collect()}
    assert got[1].contributor == "v0" and got[1].primary_label == 3 and got[2].contributor == "me" and got[2].labels == []
    names = spark.createDataFrame([(3, "tank")], "class_id int, name string")
    assert {r.class_name for r in datasets.with_class_names(datasets.load_coco(spark, str(tmp_path / "i.json")), names).collect()} == {"tank", "class_-1"}


def test_models_registry_and_text(spark):
    c = spark.createDataFrame([(i, 100.0 if i else 5.0, 0.9, 0.01) for i in range(3)], "target_class int, mask_l1 double, attack_success_rate double, coverage double")
    assert [r.backdoor for r in models.trigger_candidates(c).orderBy("target_class").collect()] == [True, False, False]
    reg = spark.createDataFrame([("k1", "One", "f1", "TRUSTED")], "key string, display_name string, folder string, trust_level string")
    got = office.with_registry(spark.createDataFrame([("f1",), ("zz",)], "contributor string"), reg).orderBy("contributor").collect()
    assert (got[0].display_name, got[0].registered, got[1].trust_level) == ("One", True, "UNVERIFIED")
    r = spark.range(1).select(X.safe_filename(F.lit("a b/c?.txt")).alias("a"), X.format_bytes(F.lit(1536)).alias("b"), X.format_duration(F.lit(75)).alias("c"), X.truncate(F.lit("abcdef"), 4).alias("d"), X.to_int(F.lit("12")).alias("e"), X.contributor_from_path(F.lit("/d/vendor_1/x/source_2.jpg")).alias("f"), S.percentage(F.lit(1), F.lit(0)).alias("g"), X.verify_hash(F.lit(" AB"), F.lit("ab")).alias("h")).first()
    assert tuple(r) == ("a_b_c_.txt", "1.5 KB", "1 m 15 s", "abc…", 12, "source_2.jpg", 0.0, True)
    s = spark.createDataFrame([("s1", 1, None), ("s2", 2, None)], "scan_id string, started_ns long, status string")
    assert {x.scan_id: x.status for x in store.complete(s, spark.createDataFrame([("s1", "done")], "scan_id string, status string")).collect()} == {"s1": "done", "s2": None}
    assert store.audit_head(spark.createDataFrame([], "id long, entry_hash string")).first().head == "0" * 64


def test_streams(spark, tmp_path):
    from probity.streaming import monitor

    spark.createDataFrame([("2024-01-01 00:00:00", "a", "view", 1.0), ("2024-01-01 00:10:00", "a", "view", 3.0), ("2024-01-02 00:00:00", "b", "view", 5.0)], "ts string, nonce string, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "nonce", "event_type", "value").write.parquet(str(tmp_path / "in"))
    src = lambda: spark.readStream.schema("ts timestamp, nonce string, event_type string, value double").parquet(str(tmp_path / "in"))
    monitor.run_once(monitor.without_replays(src()), "nonces", str(tmp_path / "c1"))
    assert spark.table("nonces").count() == 2
    monitor.run_once(monitor.rate_by_window(src()), "rates", str(tmp_path / "c2"), "complete")
    assert {(r.n, r["mean"]) for r in spark.table("rates").collect()} == {(2, 2.0), (1, 5.0)}


def test_entry_without_the_training_data_subpackage():
    import __spark_entry__ as entry

    assert {"contributor_risk", "robust_stats"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_config_and_dispatch(spark, tmp_path):
    from probity.config import Config, flatten

    (tmp_path / "s.yaml").write_text("a:\n  b: 2\n  c: [1]\nout: ../x\n")
    c = Config.load(str(tmp_path / "s.yaml"), str(tmp_path / "none.yaml"), defaults={"a": {"b": 1, "d": 3}}, root=str(tmp_path))
    assert (c.get("a.b"), c.get("a.d"), c.get("a.x", 9)) == (2, 3, 9) and dict(flatten({"a": {"b": 1}})) == {"a.b": 1}
    with pytest.raises(ValueError):
        c.path("out")
    (tmp_path / "d" / "images").mkdir(parents=True)
    png(tmp_path / "d" / "images" / "a.png", np.zeros((4, 4, 3)))
    d, fmt, errors = datasets.load_dataset(spark, str(tmp_path / "d"))
    assert fmt == "images-only" and errors and d.first().primary_label == -1
    (tmp_path / "d" / "classes.txt").write_text("tank\n\ntruck\n")
    assert datasets.detect_format(spark, str(tmp_path / "d")) == "yolo"
    assert [tuple(r) for r in datasets.read_class_names(spark, str(tmp_path / "d" / "classes.txt")).orderBy("class_id").collect()] == [(0, "tank"), (2, "truck")]
    doc = {"images": [{"id": 1, "file_name": "a.png", "width": 4, "height": 4}], "annotations": [{"id": 5, "image_id": 1, "category_id": 2, "bbox": [0, 0, 2, 3]}]}
    (tmp_path / "d" / "instances.json").write_text(json.dumps(doc))
    d, fmt, _ = datasets.load_dataset(spark, str(tmp_path / "d"))
    assert fmt == "coco"
    again = json.loads(datasets.coco_document(d, spark.createDataFrame([(2, "truck")], "class_id int, name string")).first().value)
    assert again["annotations"][0]["area"] == 6.0 and again["images"][0]["file_name"] == "a.png"
    assert datasets.discover_contributors(d).first().contributor == "root"
    assert datasets.yolo_lines(d, 4, 4).first().value == "2 0.250000 0.375000 0.500000 0.750000"


def test_model_audit(spark):
    w = spark.createDataFrame([(f"l{k}", i, float((i * 7 + k) % 5 - 2) * (40 if k == 3 else 1)) for k in range(4) for i in range(50)], "layer string, pos long, value double")
    a = scan.audit_model(w, w.withColumn("value", F.when(F.col("layer") == "l1", F.col("value") + 1).otherwise(F.col("value"))))
    assert [r.layer for r in a["layers"].filter("flags > 0").collect()] == ["l3"] and [r.layer for r in a["divergence"].collect()] == ["l1"]
    assert a["confidence"] == 0.45 and a["limitations"]
