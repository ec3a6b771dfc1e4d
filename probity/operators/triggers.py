"""Trigger patches: image measurements, spectral signatures and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.functions.stats import clamp, confidence_from_zscore, modified_zscore


def _population(features: DataFrame, id_col: str) -> DataFrame:
    f = features
    for value, out in (("high_freq_ratio", "hz"), ("patch_score", "pz"), ("spectral_peak_ratio", "ez")):
        f = modified_zscore(f, value, out=out)
    return f.withColumnRenamed(id_col, "id")


def _fuse(signals: list[Column]) -> tuple[Column, Column]:
    """(number of signals, noisy-or of those present)."""
    n = sum((s.isNotNull().cast("int") for s in signals[1:]), signals[0].isNotNull().cast("int"))
    keep = F.lit(1.0)
    for s in signals:
        keep = keep * (1 - clamp(F.coalesce(s, F.lit(0.0)), 0.0, 0.99))
    return n, 1 - keep


def detect_triggers(features: DataFrame, spectral: DataFrame, duplicate_ids: DataFrame | None = None, id_col: str = "id", hf_ratio: float = 0.32, hf_z: float = 2.5, patch_z: float = 4.0, spectral_z: float = 2.0, single_cap: float = 0.45) -> DataFrame:
    """(id, signals, confidence): frequency, patch, peak and spectral signals fused. One signal alone is capped; a spectral signal on a
    known duplicate counts less, and not at all when nothing else fires."""
    f = _population(features, id_col).join(spectral.filter("flagged").select("id", F.col("z").alias("sz")), "id", "left")
    dup = F.lit(False)
    if duplicate_ids is not None:
        f = f.join(duplicate_ids.select("id").distinct().withColumn("dup", F.lit(True)), "id", "left")
        dup = F.coalesce("dup", F.lit(False))
    a = F.when((F.col("high_freq_ratio") >= hf_ratio) | (F.col("hz") >= hf_z), F.greatest(F.when(F.col("hz") > 0, confidence_from_zscore(F.col("hz"), hf_z)).otherwise(0.0), F.least(F.lit(0.9), F.col("high_freq_ratio") / hf_ratio * 0.5)))
    b = F.when(F.col("pz") >= patch_z, F.least(F.lit(0.97), confidence_from_zscore(F.col("pz"), patch_z) * (0.70 + 0.30 * F.col("patch_uniformity"))))
    c = F.when((F.col("ez") >= hf_z) & (F.col("spectral_peak_ratio") > 20), F.least(F.lit(0.70), confidence_from_zscore(F.col("ez"), hf_z)))
    other = a.isNotNull() | b.isNotNull() | c.isNotNull()
    s = F.when(F.col("sz").isNotNull() & (~dup | other), confidence_from_zscore(F.col("sz"), spectral_z) * F.when(dup, 0.7).otherwise(1.0))
    n, fused = _fuse([a, b, c, s])
    one = F.least(F.greatest(*(F.coalesce(x, F.lit(0.0)) for x in (a, b, c, s))), F.lit(single_cap))
    f = f.select("id", n.cast("bigint").alias("signals"), F.when(n == 1, one).otherwise(F.least(F.lit(0.99), fused * 1.05)).alias("confidence"))
    return f.filter("signals > 0")


def consensus_triggers(features: DataFrame, spectral: DataFrame, id_col: str = "id", hf_z: float = 2.5, patch_z: float = 4.0, spectral_z: float = 2.0, bonus: float = 0.12) -> DataFrame:
    """The standalone form: strict thresholds on z-scores alone, a bonus when two methods agree; (id, methods, confidence)."""
    f = _population(features, id_col).join(spectral.filter("flagged").select("id", F.col("z").alias("sz")), "id", "left")
    parts = [F.when(F.col("hz") > hf_z, confidence_from_zscore(F.col("hz"), hf_z)), F.when(F.col("pz") > patch_z, confidence_from_zscore(F.col("pz"), patch_z)), F.when(F.col("sz").isNotNull(), confidence_from_zscore(F.col("sz"), spectral_z))]
    n, fused = _fuse(parts)
    methods = F.array_compact(F.array(*(F.when(p.isNotNull(), name) for p, name in zip(parts, ("fft", "blocks", "spectral")))))
    return f.select("id", methods.alias("methods"), F.when(n >= 2, F.least(F.lit(0.99), fused + bonus)).otherwise(fused).alias("confidence")).filter(F.size("methods") > 0)
