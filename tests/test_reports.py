"""What assessments emit: drift and story findings, contributors asked for, trigger searches."""

import numpy as np
from pyspark.sql import functions as F

from probity.operators import correlate, labels, office, trigger_search
from probity.plans import scan, store


def test_drift_becomes_a_finding(spark):
    rng = np.random.default_rng(1)
    side = lambda m: spark.createDataFrame([(i, float(rng.normal(m, 1)), float(rng.normal(m, 2))) for i in range(60)], "vec_id int, brightness double, contrast double")
    moved, _ = scan.compare(side(10), side(30), ["brightness", "contrast"])
    (f,) = scan.drift_findings(moved, "new").collect()
    assert (f.attack_class, f.affected_asset, f.module) == ("DISTRIBUTION_SHIFT", "new", "drift_detector") and f.severity == f.evidence["severity"] and f.confidence >= 0.6
    same, _ = scan.compare(side(10), side(10), ["brightness", "contrast"])
    assert scan.drift_findings(same, "new").collect() == [] and scan.drift_findings(None, "x") is None


def test_stories_become_findings(spark):
    rows = [("F1", "LABEL_FLIPPING", "DATA", 0.9), ("F2", "MODEL_BACKDOOR", "MODEL", 0.9), ("F3", "CHAIN_BREAK", "PROVENANCE", 0.9)]
    story = spark.createDataFrame([("KILL_CHAIN", "DATA,MODEL", 0.91, 2), ("COVER_UP", "provenance", 0.42, 3)], "pattern string, key string, confidence double, supporting long")
    got = {r.detector: r for r in correlate.story_findings(story).collect()}
    assert got["kill_chain"].severity == "CRITICAL" and got["kill_chain"].affected_asset == "KILL_CHAIN:DATA,MODEL" and got["cover_up"].disposition == "ACCEPT" and got["cover_up"].evidence["supporting"] == "3"
    assert correlate.story_findings(story.limit(0)).collect() == [] and len(rows) == 3


def test_contributors_asked_for_and_usable_reports(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "contributor string, x int")
    mine, missing = office.wanted(d, ["a", "zz", "a"])
    assert sorted(r.x for r in mine.collect()) == [1, 2] and [tuple(r) for r in missing.collect()] == [("zz", "contributor not found")]
    reports = spark.createDataFrame([("a", "OK", 0.2), ("b", "ERROR", 0.9), ("c", "OK", 0.7), ("d", None, 0.1), ("e", "OK", 0.7)], "contributor string, status string, risk_score double")
    ok, left = office.usable(reports)
    assert [r.contributor for r in ok.collect()] == ["c", "e", "a"] and {r.contributor for r in left.collect()} == {"b", "d"}
    flips = spark.createDataFrame([(1, 0.2, 1.0), (2, 0.1, 1.0), (3, 0.1, 2.0)], "id int, agreement double, ratio double")
    assert [r.id for r in labels.flip_order(flips).collect()] == [3, 2, 1]


def test_a_planted_backdoor_is_found(spark):
    rng = np.random.default_rng(7)
    rows = [(16, 16, 3, np.clip(rng.normal(0.2 + 0.2 * (i % 4), 0.05, 16 * 16 * 3), 0, 1).tolist()) for i in range(48)]
    probes = spark.createDataFrame(rows, "height int, width int, channels int, pixels array<double>").repartition(3)

    def predict(x):
        """Class by mean brightness; a checkered corner of 3 x 3 means class 2."""
        mean = x.mean((1, 2, 3))
        out = -np.abs(mean[:, None] - (0.2 + 0.2 * np.arange(4))[None])
        mark = (np.indices((3, 3)).sum(0) % 2)[None, :, :, None]
        hit = np.abs(x[:, -3:, -3:] - mark).mean((1, 2, 3)) < 0.05
        out[hit, 2] += 10
        return out

    found = trigger_search.search_triggers(probes, predict, 4).orderBy("target_class").collect()
    assert [r.target_class for r in found] == [0, 1, 2, 3] and (found[2].side, found[2].place, found[2].fill, found[2].attack_success_rate) == (3, "bottom-right", "checker", 1.0)
    verdict = trigger_search.find_backdoors(probes, predict, 4).orderBy("target_class")
    assert [r.backdoor for r in verdict.collect()] == [False, False, True, False]
    w = spark.createDataFrame([("l", 0, 1.0)], "layer string, pos long, value double")
    assert scan.audit_model(w, triggers=verdict)["confidence"] == 0.48
    assert trigger_search.search_triggers(probes.limit(0), predict, 4).collect() == []


def test_one_audit_log_of_many_rows(spark):
    entries = spark.range(300).selectExpr("'log' as chain", "id", "id * 10 as timestamp_ns", "concat('a', id % 3) as actor", "'act' as action", "cast(null as string) as target", "'d' as details")
    log = store.append_audit(entries, "chain")
    assert store.verify_audit(log).collect() == [] and store.verify_audit(log, ["chain"]).collect() == []
    bad = log.filter("id <> 100").withColumn("details", F.when(F.col("id") == 200, "other").otherwise(F.col("details")))
    assert sorted((r.id, r.break_type) for r in store.verify_audit(bad).collect()) == [(101, "BROKEN_LINK"), (200, "HASH_MISMATCH")]
    assert [r.id for r in store.list_audit(log, 2, actor="a1").collect()] == [298, 295]
    left = store.reset({"audit": log, "findings": log})
    assert left["audit"].count() == 300 and left["findings"].count() == 0
