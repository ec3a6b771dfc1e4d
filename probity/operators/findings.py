"""The uniform finding: ladders, normalisation, ids, order, summary and contributor risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.functions.stats import clamp

#: Attack classes by the stage they attack (fixed values).
STAGES = {
    "TRIGGER_INJECTION": "DATA", "LABEL_FLIPPING": "DATA", "NEAR_DUPLICATE_FLOODING": "DATA", "OUT_OF_DISTRIBUTION": "DATA", "SYSTEMATIC_MISLABELING": "DATA",
    "MODEL_BACKDOOR": "MODEL", "MODEL_SUBSTITUTION": "MODEL", "WEIGHT_ANOMALY": "MODEL", "ACTIVATION_ANOMALY": "MODEL", "BEHAVIORAL_DEVIATION": "MODEL",
    "INFERENCE_TAMPER": "INFERENCE", "INFERENCE_REPLAY": "INFERENCE", "CHAIN_BREAK": "INFERENCE", "SIGNATURE_INVALID": "INFERENCE", "DISTRIBUTION_SHIFT": "OPERATIONS",
}
OTHER_CLASSES = ("COORDINATED_ATTACK", "COVER_UP_ATTEMPT", "CONTRIBUTOR_RISK", "CROSS_CONTRIBUTOR_DISPARITY", "MODEL_DISAGREEMENT", "UNKNOWN")
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
DISPOSITIONS = ("QUARANTINE", "REVIEW", "ACCEPT")
WEIGHTS = {"CRITICAL": 1.0, "HIGH": 0.7, "MEDIUM": 0.4, "LOW": 0.15, "INFO": 0.0}
FINDING = (
    "finding_id string, attack_class string, affected_asset string, severity string, confidence double, reason string, evidence map<string,string>, disposition string, "
    "contributor string, module string, detector string, asset_type string, timestamp_ns bigint, related_findings array<string>"
)


def lookup(col: Column, values: dict, other) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out


def severity(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "CRITICAL").when(confidence >= 0.65, "HIGH").when(confidence >= 0.40, "MEDIUM").otherwise("LOW")


def drift_severity(risk: Column) -> Column:
    return F.when(risk >= 0.85, "CRITICAL").when(risk >= 0.65, "HIGH").when(risk >= 0.40, "MEDIUM").when(risk >= 0.15, "LOW").otherwise("INFO")


def disposition(confidence: Column) -> Column:
    return F.when(confidence >= 0.80, "QUARANTINE").when(confidence >= 0.50, "REVIEW").otherwise("ACCEPT")


def severity_rank(col: Column) -> Column:
    return lookup(col, {s: k for k, s in enumerate(SEVERITIES)}, -1)


def severity_weight(col: Column, other: float = 0.1) -> Column:
    return lookup(col, WEIGHTS, other)


def normalise(findings: DataFrame) -> DataFrame:
    """Confidence in [0, 1]; an unknown class is UNKNOWN, an invalid severity or disposition is recomputed."""
    c = clamp(F.col("confidence"))
    return findings.withColumns({
        "confidence": c,
        "attack_class": F.when(F.col("attack_class").isin(*STAGES, *OTHER_CLASSES), F.col("attack_class")).otherwise("UNKNOWN"),
        "severity": F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise(severity(c)),
        "disposition": F.when(F.col("disposition").isin(*DISPOSITIONS), F.col("disposition")).otherwise(disposition(c)),
    })


def project(findings: DataFrame) -> DataFrame:
    """Output form: confidence to 4 places and the four aliases."""
    return findings.withColumn("confidence", F.round("confidence", 4)).withColumns({"id": F.col("finding_id"), "type": F.col("attack_class"), "asset": F.col("affected_asset"), "score": F.col("confidence")})


def invalid(findings: DataFrame) -> DataFrame:
    """One row: how many findings break each rule of the schema."""
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(True))).alias
    return findings.agg(
        bad(F.col("finding_id").isNull() | (F.col("finding_id") == ""))("no_id"), bad(~F.col("attack_class").isin(*STAGES, *OTHER_CLASSES))("bad_class"), bad(~F.col("severity").isin(*SEVERITIES))("bad_severity"),
        bad(~F.col("disposition").isin(*DISPOSITIONS))("bad_disposition"), bad(~F.col("confidence").between(0, 1))("bad_confidence"), bad(F.col("affected_asset").isNull())("no_asset"),
    )


def with_ids(findings: DataFrame, prefix: str, order: list[Column]) -> DataFrame:
    """PREFIX-001 and on, in the given total order. Numbers come from per-partition counts, not from one sorted task."""
    ranged = findings.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    part = F.shiftright("__m", 33)
    counts = ranged.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("__b"))  # one row a partition
    out = ranged.withColumn("__p", part).join(F.broadcast(base), "__p")
    number = F.col("__b") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return out.withColumn("finding_id", F.format_string(f"{prefix}-%03d", number)).drop("__m", "__p", "__b")


def sort_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")).desc(), F.col("confidence").desc(), "finding_id")


def summarise(findings: DataFrame) -> DataFrame:
    """One row: count, risk (worst finding plus a saturating share for breadth), verdict and counts by severity."""
    sev = F.col("severity")
    a = findings.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.max(severity_weight(sev) * F.col("confidence")), F.lit(0.0)).alias("worst"), *(F.count_if(sev == s).alias(s.lower()) for s in reversed(SEVERITIES)), F.count_if(F.col("disposition") == "QUARANTINE").alias("quarantine"))
    n = F.col("total").cast("double")
    risk = F.when(F.col("total") == 0, 0.0).otherwise(clamp(0.75 * F.col("worst") + 0.25 * (1 - F.exp(-(n - 1) / 6)) * F.col("worst")))
    a = a.withColumn("risk_score", F.round(risk, 4)).drop("worst")
    return a.withColumn("verdict", F.when(F.col("critical") > 0, "COMPROMISED").when(F.col("high") > 0, "SUSPICIOUS").when(F.col("medium") > 0, "CAUTION").when(F.col("total") > 0, "MINOR_ANOMALIES").otherwise("CLEAN"))


def counts_by(findings: DataFrame) -> DataFrame:
    """Counts by severity, class and disposition in one pass."""
    g = findings.groupingSets([["severity"], ["attack_class"], ["disposition"]], "severity", "attack_class", "disposition").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    return g.select(F.when(F.col("gid") == 3, "severity").when(F.col("gid") == 5, "attack_class").otherwise("disposition").alias("dimension"), F.coalesce("severity", "attack_class", "disposition").alias("value"), "n")


def contributor_risk(findings: DataFrame, samples: DataFrame, contributor: str = "contributor") -> DataFrame:
    """Risk of each contributor of samples: 0.60 noisy-or of weighted confidences, 0.25 density, 0.15 diversity of classes.

    Names are folded to lower case; findings of contributors without samples, and roll-ups, don't count. Both sides are
    aggregated before they meet, so what is joined is one row a contributor.
    """
    fold = lambda c: F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("_unattributed"))
    n = samples.groupBy(fold(F.col(contributor)).alias("name")).agg(F.count(F.lit(1)).alias("num_samples"))
    f = findings.filter("attack_class <> 'CONTRIBUTOR_RISK'").withColumn("name", fold(F.col("contributor")))
    hit = f.groupBy("name").agg(
        F.product(1 - clamp(severity_weight(F.col("severity")) * F.col("confidence"), 0.0, 0.999)).alias("keep"),
        F.count(F.lit(1)).alias("num_findings"), F.countDistinct("attack_class").alias("types"), F.countDistinct("affected_asset").alias("assets"),
    )
    j = n.join(hit, "name", "left").fillna(0, ["num_findings", "types", "assets"])
    density = clamp(F.col("assets") / F.greatest(F.col("num_samples"), F.lit(1)) * 2)
    diversity = clamp((F.col("types") - 1) / 4)
    risk = F.when(F.col("num_findings") == 0, 0.0).otherwise(clamp(0.60 * (1 - F.col("keep")) + 0.25 * density + 0.15 * diversity))
    return j.select(F.col("name").alias("contributor"), F.round(risk, 4).alias("risk_score"), "num_findings", "num_samples", F.col("types").alias("num_attack_types"))


def contributor_findings(risks: DataFrame, least: float = 0.60) -> DataFrame:
    r = risks.filter(F.col("risk_score") >= least)
    return r.select(F.lit("CONTRIBUTOR_RISK").alias("attack_class"), F.col("contributor").alias("affected_asset"), severity(F.col("risk_score")).alias("severity"), F.col("risk_score").alias("confidence"), F.when(F.col("risk_score") >= 0.8, "QUARANTINE").otherwise("REVIEW").alias("disposition"), "contributor")
