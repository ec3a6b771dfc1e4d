"""Weight tensors and model outputs: layer statistics, divergence, behaviour."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probity.functions.stats import clamp, normalised_entropy, softmax


def layer_stats(weights: DataFrame) -> DataFrame:
    """weights(layer, value) -> count, mean, std, min, max, sparsity, kurtosis, abs_max and anomaly flags with a confidence.

    Flags: std over 3 medians of the layers' stds, excess kurtosis over 12, over 90 % zeros in over 100 values.
    """
    s = weights.groupBy("layer").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg((F.abs("value") < 1e-8).cast("double")).alias("sparsity"), F.when(F.stddev_pop("value") < 1e-12, 0.0).otherwise(F.kurtosis("value")).alias("kurtosis"), F.max(F.abs("value")).alias("abs_max"))
    s = s.crossJoin(F.broadcast(s.agg(F.median("std").alias("typical"))))  # one row
    wide, peaked, empty = F.col("std") > 3 * F.col("typical"), F.col("kurtosis") > 12, (F.col("sparsity") > 0.9) & (F.col("n") > 100)
    k = wide.cast("int") + peaked.cast("int") + empty.cast("int")
    ratio = F.col("std") / F.greatest("typical", F.lit(1e-12))
    return s.withColumn("flags", k.cast("bigint")).withColumn("confidence", F.when(k > 0, F.least(F.lit(0.88), 0.42 + 0.16 * k + F.least(F.lit(0.22), 0.02 * ratio)))).drop("typical")


def weight_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b(layer, pos, value): relative L2 change of each layer of either; 1 where sizes differ, a layer is missing or b is zero."""
    j = a.withColumnRenamed("value", "x").join(b.withColumnRenamed("value", "y"), ["layer", "pos"], "full")
    g = j.groupBy("layer").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)).alias("num"), F.sqrt(F.sum(F.col("y") ** 2)).alias("den"), F.max(F.col("x").isNull() | F.col("y").isNull()).alias("shape"), F.count(F.lit(1)).alias("n"))
    change = F.when(F.col("shape") | (F.coalesce("den", F.lit(0.0)) == 0), F.when(F.col("shape") | (F.coalesce("num", F.lit(0.0)) > 0), 1.0).otherwise(0.0)).otherwise(F.col("num") / F.col("den"))
    return g.select("layer", change.alias("change"), (change > 1e-6).alias("changed"), "n")


#: Values of a tensor that are hashed at once.
CHUNK = 1 << 16


@F.pandas_udf(T.StringType())
def _chunk_digest(values: pd.Series) -> pd.Series:
    return pd.Series([hashlib.sha256(np.asarray(v, "<f8").tobytes()).hexdigest() for v in values])


def tensor_digests(weights: DataFrame) -> DataFrame:
    """weights(layer, pos, value) -> (layer, n, digest): SHA-256 over the digests of CHUNK little-endian doubles each, in order of pos.

    A tree, so that no tensor is one task's, and so another digest than one pass over its bytes gives. Null values are NaN; equal for any
    partitioning; positions count, shapes don't."""
    d = weights.select("layer", "pos", F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))).alias("value"))
    chunks = d.groupBy("layer", F.expr(f"pos div {CHUNK}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    chunks = chunks.select("layer", "chunk", F.size("v").cast("bigint").alias("n"), F.concat_ws(":", "chunk", F.sha2(F.array_join(F.transform("v.pos", lambda p: p.cast("string")), ","), 256), _chunk_digest(F.col("v.value"))).alias("d"))
    return chunks.groupBy("layer").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "d"))), lambda x: x["d"]), ","), 256).alias("digest"))


def model_digest(weights: DataFrame) -> DataFrame:
    """One row: digest over the layers' digests in order of their names; 64 zeros without any."""
    d = tensor_digests(weights)
    return d.agg(F.when(F.count(F.lit(1)) == 0, "0" * 64).otherwise(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("layer", "digest"))), lambda x: F.concat_ws("=", x["layer"], x["digest"])), "\n"), 256)).alias("digest"))


def argmax(v: Column) -> Column:
    return F.array_position(v, F.array_max(v)) - 1


def mismatch(a: DataFrame, b: DataFrame, limit: float = 0.05) -> DataFrame:
    """One row over probes(probe, logits) of two models: share of differing answers, mean absolute gap of probabilities, confidence."""
    j = a.select("probe", F.col("logits").alias("x")).join(b.select("probe", F.col("logits").alias("y")), "probe")
    gap = F.aggregate(F.zip_with(softmax(F.col("x")), softmax(F.col("y")), lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, d: s + d) / F.size("x")
    r = j.agg(F.count(F.lit(1)).alias("probes"), F.avg((argmax(F.col("x")) != argmax(F.col("y"))).cast("double")).alias("mismatch_rate"), F.avg(gap).alias("probability_gap"))
    return r.withColumn("confidence", F.when(F.col("mismatch_rate") > limit, clamp(0.45 + 2 * (F.col("mismatch_rate") - 0.05), 0.0, 0.94)))


def disagreement(predictions: DataFrame, limit: float = 0.20) -> DataFrame:
    """predictions(model, probe, answer) -> mismatch rate of every pair of models, finding confidence above the limit."""
    x, y = predictions.alias("x"), predictions.alias("y")
    j = x.join(y, (F.col("x.probe") == F.col("y.probe")) & (F.col("x.model") < F.col("y.model")))
    r = j.groupBy(F.col("x.model").alias("model_a"), F.col("y.model").alias("model_b")).agg(F.count(F.lit(1)).alias("probes"), F.avg((F.col("x.answer") != F.col("y.answer")).cast("double")).alias("mismatch_rate"))
    return r.withColumn("confidence", F.when(F.col("mismatch_rate") > limit, F.least(F.lit(0.90), 0.50 + F.col("mismatch_rate"))))


def output_shape(probes: DataFrame) -> DataFrame:
    """Mean normalised entropy of a model's answers: SHARP below 0.15, FLAT above 0.90."""
    e = probes.agg(F.count(F.lit(1)).alias("probes"), F.avg(normalised_entropy(softmax(F.col("logits")))).alias("entropy"))
    return e.withColumn("shape", F.when(F.col("entropy") < 0.15, "SHARP").when(F.col("entropy") > 0.90, "FLAT").otherwise("NORMAL")).withColumn("confidence", F.when(F.col("shape") == "SHARP", 0.55).when(F.col("shape") == "FLAT", 0.48))


def in_distribution(probes: DataFrame) -> DataFrame:
    """Whether probes suit a model: mean top probability at least min(0.5, 2 / classes)."""
    p = probes.agg(F.avg(F.array_max(softmax(F.col("logits")))).alias("mean_top"), F.max(F.size("logits")).alias("classes"))
    return p.withColumn("in_distribution", F.col("mean_top") >= F.least(F.lit(0.5), 2 / F.col("classes")))


def trigger_candidates(candidates: DataFrame, index_limit: float = 2.0) -> DataFrame:
    """candidates(target_class, mask_l1, attack_success_rate, coverage) -> anomaly index and verdict. With 8 classes or more a
    mask is anomalous at 2 MADs below the median; with fewer, at 0.34 of the median size and 6 % of the frame."""
    from probity.functions.stats import modified_zscore

    z = modified_zscore(candidates, "mask_l1", out="z").withColumn("anomaly_index", -F.col("z"))
    m = candidates.agg(F.median("mask_l1").alias("med"), F.count(F.lit(1)).alias("classes"))
    j = z.crossJoin(F.broadcast(m))  # one row
    hit = F.when(F.col("classes") >= 8, F.col("anomaly_index") >= index_limit).otherwise((F.col("mask_l1") / F.greatest("med", F.lit(1e-9)) <= 0.34) & (F.col("coverage") <= 0.06)) & (F.col("attack_success_rate") >= 0.45)
    c = clamp(0.45 + 0.14 * (F.col("anomaly_index") - 2) + 0.25 * F.col("attack_success_rate"), 0.0, 0.96)
    return j.select("target_class", "mask_l1", "attack_success_rate", "anomaly_index", hit.alias("backdoor"), F.when(hit, c).alias("confidence"))


def top_changes(divergence: DataFrame, most: int = 5) -> DataFrame:
    return divergence.filter("changed").orderBy(F.col("change").desc(), "layer").limit(most)


__all__ = ["argmax", "disagreement", "in_distribution", "layer_stats", "mismatch", "model_digest", "output_shape", "tensor_digests", "top_changes", "trigger_candidates", "weight_divergence"]
