"""Whole assessments: data, models, records, drift, and the report over all of them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.operators import correlate, drift, duplicates, labels, outliers, provenance, signatures
from probity.operators import findings as fnd


@dataclass(frozen=True)
class Thresholds:
    """All limits that the assessments read; defaults are the working ones."""

    neighbours: int = 10
    min_class: int = 8
    spectral_min_class: int = 12
    min_gap: float = 0.30
    hamming: int = 5
    jaccard: float = 0.8
    drift_min_rows: int = 10
    detectors: tuple[str, ...] = ("label_flip", "ood", "mislabel", "spectral")


@dataclass
class Assessment:
    """Findings with an account of what was assessed: a part that couldn't run is never clean."""

    findings: DataFrame
    status: str
    limitations: list[str] = field(default_factory=list)

    def verdict(self) -> DataFrame:
        s = fnd.summarise(self.findings)
        return s.withColumn("verdict", F.when(F.lit(self.status == "NOT_ASSESSED"), "NOT_ASSESSED").otherwise(F.col("verdict")))


def _finding(d: DataFrame, attack: str, asset: str, module: str, detector: str, evidence: dict[str, str] | None = None) -> DataFrame:
    ev = F.create_map(*[x for k, c in (evidence or {"detector": f"'{detector}'"}).items() for x in (F.lit(k), F.expr(c).cast("string"))])
    return d.select(F.lit(attack).alias("attack_class"), F.col(asset).cast("string").alias("affected_asset"), fnd.severity(F.col("confidence")).alias("severity"), F.col("confidence").cast("double").alias("confidence"), fnd.disposition(F.col("confidence")).alias("disposition"), ev.alias("evidence"), F.lit(module).alias("module"), F.lit(detector).alias("detector"))


def scan_data(emb: DataFrame, contributors: DataFrame | None = None, th: Thresholds = Thresholds(), images: DataFrame | None = None, docs: DataFrame | None = None, repeats: DataFrame | None = None, neighbours=None) -> Assessment:
    """Label flips, mislabelling, out-of-distribution rows and spectral outliers of embeddings(vec_id, embedding, label).

    With images(id, high_freq_ratio, patch_score, patch_uniformity, spectral_peak_ratio) the triggers are fused with what the images
    show, where repeats(id), known copies, count less; with docs(doc_id, text) near-duplicate floods are found; with contributors(id, contributor) each finding gets
    its contributor, and contributors of high risk get a finding. neighbours(df, k) finds the neighbours of label flips, such as
    cells.indexed where all pairs are too many; without it they are exact over all pairs.
    """
    emb = emb.filter("embedding is not null and label is not null and not exists(embedding, x -> x is null or isnan(x))")
    size = emb.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= th.min_class).count()
    empty = emb.sparkSession.createDataFrame([], "attack_class string, affected_asset string, severity string, confidence double, disposition string, evidence map<string,string>, module string, detector string")
    if not size:
        return Assessment(empty, "NOT_ASSESSED", [f"no class has {th.min_class} rows with a vector"])
    parts, notes = [], []
    if "label_flip" in th.detectors:
        parts.append(_finding(labels.label_flips(emb, th.neighbours, th.min_class, neighbours=neighbours), "LABEL_FLIPPING", "id", "data_scanner", "label_flip", {"to_class": "suggested", "agreement": "agreement"}))
    if "mislabel" in th.detectors and size > 1:
        parts.append(_finding(labels.report_mislabelled(labels.mislabelled(emb, th.min_gap)), "SYSTEMATIC_MISLABELING", "id", "data_scanner", "mislabel", {"predicted_class": "predicted", "gap": "gap"}))
    if "ood" in th.detectors:
        logits = outliers.centroid_logits(emb)
        parts.append(_finding(outliers.fuse_ood(outliers.mahalanobis_ood(emb, min_class=th.min_class), outliers.energy_ood(logits)), "OUT_OF_DISTRIBUTION", "id", "data_scanner", "ood", {"detectors": "detectors"}))
    if "spectral" in th.detectors:
        from probity.functions.stats import confidence_from_zscore

        s = outliers.spectral_signatures(emb, th.spectral_min_class)
        if images is None:
            notes.append("no images: triggers are judged by spectral signatures alone")
            s = s.filter("flagged").withColumn("confidence", F.least(confidence_from_zscore(F.col("z"), 2.0), F.lit(0.45)))
            parts.append(_finding(s, "TRIGGER_INJECTION", "id", "data_scanner", "spectral", {"spectral_class": "label", "z": "z"}))
        else:
            from probity.operators import triggers

            parts.append(_finding(triggers.detect_triggers(images, s, repeats), "TRIGGER_INJECTION", "id", "data_scanner", "trigger", {"detection_methods_agreed": "signals"}))
    if docs is not None:
        from probity.sources.tables import Store

        parts.append(scan_texts(docs, Store(emb.sparkSession, "scan"), th).findings)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if contributors is not None:
        out = out.join(contributors.select(F.col("id").cast("string").alias("affected_asset"), "contributor"), "affected_asset", "left")
        risky = fnd.contributor_findings(fnd.contributor_risk(out, contributors))
        out = out.unionByName(risky.withColumn("evidence", F.create_map(F.lit("risk_score"), F.col("confidence").cast("string"))).withColumns({"module": F.lit("data_scanner"), "detector": F.lit("contributor")}))
    return Assessment(out, "ASSESSED", notes)


def scan_office(emb: DataFrame, contributor: str = "contributor", th: Thresholds = Thresholds(), registry: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every contributor scored against its own population, then compared: findings, risks, disparity, targeting, inversion, verdict."""
    from probity.operators import office

    f = labels.label_flips(emb, th.neighbours, th.min_class, within=contributor)
    who = emb.select(F.col("vec_id").cast("string").alias("affected_asset"), contributor)
    found = _finding(f, "LABEL_FLIPPING", "id", "data_scanner", "label_flip", {"to_class": "suggested"}).join(who, "affected_asset")
    risks = fnd.contributor_risk(found, emb, contributor)
    trusted = office.with_registry(risks, registry) if registry is not None else risks.withColumn("trust_level", F.lit("UNVERIFIED"))
    return {"findings": found, "risks": risks, "disparity": office.disparity(risks), "targeting": office.class_targeting(found), "inversion": office.trust_inversion(trusted), "verdict": office.office_verdict(risks, found)}


def audit_model(weights: DataFrame, reference: DataFrame | None = None, probes: tuple[DataFrame, DataFrame] | None = None, triggers: DataFrame | None = None) -> dict:
    """Layer anomalies, divergence from a reference, behaviour against a second model, and the suspect classes of a trigger search
    (trigger_search.find_backdoors); with the confidence that the parts run allow."""
    from probity.operators import models

    out: dict = {"layers": models.layer_stats(weights.select("layer", "value")), "confidence": 0.30, "limitations": []}
    if reference is None:
        out["limitations"].append("no reference weights: divergence not assessed")
    else:
        out["divergence"] = models.top_changes(models.weight_divergence(weights, reference))
        out["confidence"] += 0.15
    if probes is None:
        out["limitations"].append("no probes: behaviour not assessed")
    else:
        out["behaviour"], out["outputs"] = models.mismatch(*probes), models.output_shape(probes[0])
        out["confidence"] += 0.25
    if triggers is None:
        out["limitations"].append("no trigger search: backdoors not assessed")
    else:
        out["triggers"] = triggers
        out["confidence"] += 0.30 - 0.12  # a search without gradients says less
    out["confidence"] = round(min(0.98, max(0.05, out["confidence"])), 2)
    return out


def scan_texts(docs: DataFrame, store, th: Thresholds = Thresholds()) -> Assessment:
    """Near-duplicate floods of documents; store.keep writes intermediate tables."""
    fps = store.keep(duplicates.fingerprints(docs))
    pairs = duplicates.jaccard(docs, duplicates.near_pairs(fps, th.hamming)).filter(F.col("jaccard") >= th.jaccard)
    pairs = store.keep(pairs)
    members = duplicates.clusters(fps, duplicates.components(pairs, store.keep))
    flood = duplicates.flood_clusters(members, pairs).filter("flood")
    return Assessment(_finding(flood, "NEAR_DUPLICATE_FLOODING", "cluster", "data_scanner", "duplicates", {"size": "size", "threshold": "threshold"}), "ASSESSED")


def scan_records(records: DataFrame, chain: str, order: list[str], key=None) -> Assessment:
    """Chain defects, tampered records and replays; with a public key (hex, or a column of keys), signatures that don't hold."""
    b = provenance.chain_findings(provenance.verify_chain(records, chain, order))
    t = provenance.find_tampered(records).withColumn("confidence", F.lit(0.97))
    r = provenance.find_replays(records, [chain], order)
    out = _finding(b.withColumnRenamed("attack_class", "ac"), "CHAIN_BREAK", "affected_asset", "crypto_chain", "chain", {"break_type": "break_type", "class": "ac"})
    out = out.withColumn("attack_class", F.when(F.element_at("evidence", F.lit("class")) == "INFERENCE_REPLAY", "INFERENCE_REPLAY").otherwise("CHAIN_BREAK"))
    out = out.unionByName(_finding(t, "INFERENCE_TAMPER", "record_id", "crypto_chain", "tamper", {"tamper": "tamper"})).unionByName(_finding(r, "INFERENCE_REPLAY", "record_id", "crypto_chain", "replay", {"replay_type": "replay_type"}))
    if key is None or "signature" not in records.columns:
        return Assessment(out, "ASSESSED", ["signatures: unavailable"])
    checked = signatures.verify_signatures(records, key)
    out = out.unionByName(_finding(signatures.signature_findings(checked), "SIGNATURE_INVALID", "record_id", "crypto_chain", "signature", {"reason": "reason"}))
    return Assessment(out, "ASSESSED", ["signatures: records without one, or without a key, were not checked"])


def compare(baseline: DataFrame, current: DataFrame, properties: list[str], vector: str | None = None, th: Thresholds = Thresholds()) -> tuple[DataFrame | None, list[str]]:
    """Characterised drift of two collections, or None and why it wasn't assessed."""
    d = baseline.withColumn("side", F.lit(0)).unionByName(current.withColumn("side", F.lit(1)))
    n = {r["side"]: r["count"] for r in d.groupBy("side").count().collect()}  # two rows
    if min(n.get(0, 0), n.get(1, 0)) < th.drift_min_rows:
        return None, [f"at least {th.drift_min_rows} rows a side are needed, there are {n.get(0, 0)} and {n.get(1, 0)}"]
    props = drift.property_drift(d, properties)
    f = None
    if vector:
        f = drift.centroid_drift(d, vector).crossJoin(drift.mmd(d, vector).select("mmd")).crossJoin(drift.projection_bimodality(d, vector).select("concentrated"))  # one row each
    return drift.characterise(props, f, drift.match_signatures(props)), [] if vector else ["feature-level analysis unavailable: pixel statistics alone can't show semantic manipulation"]


def drift_findings(result: DataFrame | None, asset: str) -> DataFrame | None:
    """At most one finding of characterised drift (compare): none without significant drift or below a risk of 0.15; severity by the risk."""
    if result is None:
        return None
    d = result.filter((F.col("shift_type") != "NO_SIGNIFICANT_DRIFT") & (F.col("risk_score") >= 0.15)).withColumn("asset", F.lit(asset))
    out = _finding(d.withColumn("kind", F.col("severity")), "DISTRIBUTION_SHIFT", "asset", "drift_detector", "distribution_shift", {"shift_type": "shift_type", "risk_score": "risk_score", "severity": "kind"})
    return out.withColumn("severity", F.element_at("evidence", F.lit("severity")))


def report(findings: DataFrame, modules: DataFrame, scan_id: str) -> dict:
    """The report document: summary, counts, top findings, pillars, stories, coverage, and a hash over all but the hash."""
    import hashlib

    f = findings.withColumn("confidence", F.round("confidence", 4))
    story = correlate.stories(f)
    rows = lambda d: [r.asDict(True) for r in d.collect()]  # noqa: E731  each is a few rows
    pillars = correlate.pillar_scores(f, modules)
    doc = {
        "scan_id": scan_id, "summary": rows(fnd.summarise(f))[0], "counts": sorted(rows(fnd.counts_by(f)), key=str), "top_findings": rows(fnd.sort_findings(f).select("finding_id", "attack_class", "severity", "confidence", "affected_asset").limit(20)),
        "pillars": sorted(rows(pillars), key=str), "immunity": rows(correlate.immunity(pillars, story))[0], "stories": sorted(rows(story), key=str), "coverage": sorted(rows(correlate.coverage(modules)), key=str),
    }
    doc["report_hash"] = hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    return doc


def write_report(spark, folder: str, doc: dict) -> str:
    """The path of the report, written whole or not at all, an earlier one of the same scan being replaced."""
    from probity.sources.publish import publish_json

    path = f"{folder.rstrip('/')}/{doc['scan_id']}.json"
    publish_json(spark, path, doc)
    return path


def read_report(spark, path: str) -> tuple[dict, bool]:
    """(report, whether its hash is that of its contents)."""
    import hashlib

    from probity.sources.publish import read_bytes

    doc = json.loads(read_bytes(spark, path))
    rest = {k: v for k, v in doc.items() if k != "report_hash"}
    return doc, doc.get("report_hash") == hashlib.sha256(json.dumps(rest, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


REQUIRED = ("scan_id", "summary", "counts", "top_findings", "pillars", "immunity", "stories", "coverage", "report_hash")


def missing_keys(doc: dict) -> list[str]:
    return [k for k in REQUIRED if k not in doc]


def briefing(doc: dict) -> str:
    """A plain-language summary of a report, from a template."""
    s, i = doc["summary"], doc["immunity"]
    lines = [f"Verdict {s['verdict']} with risk {s['risk_score']:.2f} over {s['total']} findings ({s['critical']} critical, {s['high']} high).", f"Immunity {i['score']:.1f} ({i['band']})."]
    lines += [f"{x['pattern']}: {x['key']} at {x['confidence']:.0%} confidence." for x in doc["stories"]]
    gaps = [c["module"] for c in doc["coverage"] if not c["ran"]]
    return " ".join(lines + ([f"Not assessed: {', '.join(gaps)}."] if gaps else []))


def exit_code(status: str, verdict: str) -> int:
    return 3 if status == "NOT_ASSESSED" else 2 if verdict == "COMPROMISED" else 0 if verdict in ("CLEAN", "UNKNOWN") else 1
