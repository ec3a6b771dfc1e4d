"""Contributors compared with their peers: disparity, shared targets, trust inversion, verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.functions.text import normalise_label
from probity.operators.findings import lookup

TRUST = {"UNVERIFIED": 0, "VERIFIED": 1, "TRUSTED": 2}
#: Evidence keys that can name the class an attack aims at, the first that is present counts (fixed values).
TARGET_KEYS = ("target_class", "spectral_class", "class", "to_class", "new_label", "predicted_class")
TARGETING = ("LABEL_FLIPPING", "SYSTEMATIC_MISLABELING", "TRIGGER_INJECTION", "MODEL_BACKDOOR")


def disparity(risks: DataFrame, ratio_limit: float = 1.8, floor: float = 0.45, z_limit: float = 1.5) -> DataFrame:
    """risks(contributor, risk_score), one row a contributor -> every contributor with peer median, ratio, z-scores, trigger, confidence.

    attainable_max_zscore is (n - 1) / sqrt(n). The median of a contributor's peers is one of the three middle scores, which depends on
    its rank; ranks come from counts of different scores (four decimals: ten thousand at most), so contributors are never paired.
    """
    r = risks.select("contributor", F.col("risk_score").cast("double").alias("risk"))
    s = r.agg(F.count(F.lit(1)).alias("n"), F.avg("risk").alias("mean"), F.stddev_pop("risk").alias("sd"), F.median("risk").alias("med"))  # one row
    mad = r.crossJoin(F.broadcast(s.select("med"))).agg((F.median(F.abs(F.col("risk") - F.col("med"))) * 1.4826).alias("mad"))
    r = r.crossJoin(F.broadcast(s)).crossJoin(F.broadcast(mad))
    up = risks.select(F.col("risk_score").cast("double").alias("risk")).groupBy("risk").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy("risk")))
    rank = F.col("upto") - F.col("c")  # of equal scores any one may be left out
    k = F.floor((F.col("n") - 1) / 2)
    value = lambda q: F.max(F.when((rank <= q) & (q < F.col("upto")), F.col("risk")))
    mid = up.crossJoin(F.broadcast(s.select("n"))).agg(value(k - 1).alias("m0"), value(k).alias("m1"), value(k + 1).alias("m2"))  # one row
    r = r.join(up.select("risk", rank.alias("own")), "risk").crossJoin(F.broadcast(mid))
    at_k, before_k = F.when(k >= F.col("own"), F.col("m2")).otherwise(F.col("m1")), F.when(k - 1 >= F.col("own"), F.col("m1")).otherwise(F.col("m0"))
    m = F.col("n") - 1
    r = r.withColumn("peer_median", F.when(m < 1, 0.0).when(m % 2 == 1, at_k).otherwise((before_k + at_k) / 2))
    z = F.when(F.col("sd") > 1e-9, (F.col("risk") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    rz = F.when(F.col("mad") > 1e-9, (F.col("risk") - F.col("med")) / F.col("mad")).otherwise(0.0)
    ratio = F.when(F.col("peer_median") > 1e-9, F.col("risk") / F.col("peer_median"))
    by_ratio = F.when(ratio.isNotNull(), ratio >= ratio_limit).otherwise(F.col("risk") > floor) & (F.col("risk") >= floor)
    by_z = (z >= z_limit) & (F.col("risk") >= floor)
    margin = F.least(F.lit(1.0), (F.col("risk") - F.col("peer_median")) / F.greatest("peer_median", F.lit(0.15)))
    c = F.least(F.lit(0.90), 0.45 + 0.35 * margin + F.when(by_z, 0.10).otherwise(0.0))
    return r.select("contributor", F.col("risk").alias("risk_score"), "peer_median", ratio.alias("ratio"), z.alias("zscore"), rz.alias("robust_zscore"), ((F.col("n") - 1) / F.sqrt(F.col("n").cast("double"))).alias("attainable_max_zscore"), F.when(by_ratio, "median_ratio").when(by_z, "zscore").alias("triggered_by"), F.when(by_ratio | by_z, c).alias("confidence"))


def class_targeting(findings: DataFrame, least: float = 0.5) -> DataFrame:
    """Classes that findings of two contributors or more aim at."""
    t = normalise_label(F.coalesce(*(F.element_at("evidence", F.lit(k)) for k in TARGET_KEYS)))
    d = findings.filter(F.col("attack_class").isin(*TARGETING) & (F.col("confidence") >= least)).withColumn("target", t).filter("target is not null and contributor is not null")
    g = d.groupBy("target").agg(F.countDistinct("contributor").alias("contributors"), F.count(F.lit(1)).alias("findings"), F.avg("confidence").alias("mean"))
    return g.filter("contributors >= 2").select("target", "contributors", "findings", F.least(F.lit(0.92), F.greatest(F.lit(0.40), 0.40 + 0.18 * F.col("contributors") + 0.25 * (F.col("mean") - 0.5))).alias("confidence"))


def trust_inversion(risks: DataFrame, gap: float = 0.15, floor: float = 0.45) -> DataFrame:
    """Contributors (contributor, risk_score, trust_level) that are riskier than the best one of a lower trust level."""
    r = risks.withColumn("rank", lookup(F.col("trust_level"), TRUST, 0))
    best = r.groupBy("rank").agg(F.min("risk_score").alias("best")).select(F.col("rank").alias("lower"), "best")  # a row a level
    j = r.join(F.broadcast(best), F.col("lower") < F.col("rank")).groupBy("contributor", "risk_score", "trust_level").agg(F.min("best").alias("peer_risk"))
    j = j.withColumn("gap", F.col("risk_score") - F.col("peer_risk"))
    return j.filter((F.col("gap") >= gap) & (F.col("risk_score") >= floor)).withColumn("confidence", F.least(F.lit(0.85), 0.45 + F.col("gap")))


def office_verdict(risks: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: the office's verdict, peak risk and who has it. No usable contributor: NOT_ASSESSED, never CLEAN."""
    r = risks.agg(F.count(F.lit(1)).alias("contributors"), F.max("risk_score").alias("peak"), F.max_by("contributor", F.struct("risk_score", "contributor")).alias("worst"))
    f = findings.agg(F.count(F.lit(1)).alias("findings"))
    v = F.when(F.col("contributors") == 0, "NOT_ASSESSED").when(F.col("peak") >= 0.75, "COMPROMISED").when((F.col("peak") >= 0.45) | (F.col("findings") > 0), "CAUTION").otherwise("CLEAN")
    return r.crossJoin(f).select(v.alias("verdict"), "peak", "worst", "contributors", "findings")  # one row each


def wanted(samples: DataFrame, names: list[str], contributor: str = "contributor") -> tuple[DataFrame, DataFrame]:
    """(rows of the contributors named, (contributor, error) of those that have no rows)."""
    ask = samples.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "asked string")
    mine = samples.join(F.broadcast(ask), F.col(contributor) == F.col("asked"), "left_semi")
    there = samples.select(F.col(contributor).alias("asked")).distinct()
    return mine, ask.join(there, "asked", "left_anti").select(F.col("asked").alias("contributor"), F.lit("contributor not found").alias("error"))


def usable(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """reports(contributor, status, risk_score, ...) -> (those with status OK, riskiest first, (contributor, limitation) of the others)."""
    ok = F.coalesce(F.col("status") == "OK", F.lit(False))
    left = reports.filter(~ok).select("contributor", F.concat(F.lit("not compared: its status is "), F.coalesce("status", F.lit("unknown"))).alias("limitation"))
    return reports.filter(ok).orderBy(F.col("risk_score").desc_nulls_last(), "contributor"), left


def with_registry(df: DataFrame, registry: DataFrame, contributor: str = "contributor") -> DataFrame:
    """df with display_name, trust_level and registered: by registry key, else by folder, else unverified."""
    by_key = registry.select(F.col("key").alias("__k"), F.struct("display_name", "trust_level").alias("__a"))
    by_folder = registry.groupBy(F.col("folder").alias("__f")).agg(F.min(F.struct("display_name", "trust_level")).alias("__b"))
    j = df.join(by_key, F.col(contributor) == F.col("__k"), "left").join(by_folder, F.col(contributor) == F.col("__f"), "left")
    r = F.coalesce("__a", "__b")
    return j.select(*[df[c] for c in df.columns], F.coalesce(r["display_name"], F.col(contributor)).alias("display_name"), F.coalesce(r["trust_level"], F.lit("UNVERIFIED")).alias("trust_level"), r.isNotNull().alias("registered"))


__all__ = ["class_targeting", "disparity", "office_verdict", "trust_inversion", "usable", "wanted", "with_registry"]
