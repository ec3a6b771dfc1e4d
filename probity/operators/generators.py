"""Labelled damage for testing detectors, and the scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _picked(id_col: str, rate: float, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1_000_000)) < int(rate * 1_000_000)


def flip_labels(df: DataFrame, rate: float = 0.12, seed: int = 7, source: int | None = None, target: int | None = None, classes: int = 10, id_col: str = "vec_id", label: str = "label") -> DataFrame:
    """df with flipped labels and the column `flipped`; targeted (source -> target) or to another class by hash."""
    hit = _picked(id_col, rate, seed) & (F.lit(True) if source is None else F.col(label) == source)
    other = F.lit(target) if target is not None else (F.col(label) + 1 + F.pmod(F.xxhash64(F.col(id_col), F.lit(seed + 1)), F.lit(classes - 1))) % classes
    return df.withColumn("flipped", hit).withColumn(label, F.when(F.col("flipped"), other).otherwise(F.col(label)).cast(df.schema[label].dataType))


def flood_duplicates(df: DataFrame, sources: int = 2, copies: int = 7, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df plus `copies` jittered copies of `sources` rows (in hash order); copies have negative ids and copy_of set."""
    few = df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(sources)
    more = few.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    more = more.withColumn("copy_of", F.col(id_col)).withColumn(id_col, -(F.col(id_col) * 1000 + F.col("__k")) - 1).withColumn(text_col, F.concat(F.col(text_col), F.lit(" "), F.col("__k").cast("string"))).drop("__k")
    return df.withColumn("copy_of", F.lit(None).cast(df.schema[id_col].dataType)).unionByName(more.select(*df.columns, "copy_of"))


def stamp_triggers(df: DataFrame, rate: float = 0.05, target: int = 1, strength: float = 0.5, seed: int = 1337, id_col: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """df with a constant pattern added to the vectors of some rows, which get the target label; column `stamped`."""
    hit = _picked(id_col, rate, seed)
    moved = F.transform(vector, lambda x, i: (x + F.when(i % 8 == 0, strength).otherwise(0.0)).cast("float"))
    d = df.withColumn("stamped", hit)
    return d.withColumn(vector, F.when(F.col("stamped"), moved).otherwise(F.col(vector))).withColumn(label, F.when(F.col("stamped"), F.lit(target)).otherwise(F.col(label)).cast(df.schema[label].dataType))


def shift_properties(df: DataFrame, factors: dict[str, float], side: str = "side") -> DataFrame:
    """Current rows (side 1) with some properties scaled."""
    return df.withColumns({c: F.when(F.col(side) == 1, F.col(c) * k).otherwise(F.col(c)) for c, k in factors.items()})


def precision_recall(truth: DataFrame, flagged: DataFrame, universe: int | Column, key: str = "id", baseline: DataFrame | None = None) -> DataFrame:
    """One row: confusion counts, precision, recall, F1, false positive rate. Keys in `baseline` that aren't true are not held against
    the detector."""
    a, b = truth.select(key).distinct().withColumn("t", F.lit(1)), flagged.select(key).distinct().withColumn("f", F.lit(1))
    j = a.join(b, key, "full")
    if baseline is not None:
        j = j.join(baseline.select(key).distinct().withColumn("nat", F.lit(1)).hint("merge"), key, "left").filter("t = 1 or nat is null")
    u = F.lit(universe) if isinstance(universe, int) else universe
    c = j.agg(F.count("t").alias("ground_truth"), F.count("f").alias("flagged"), F.count_if((F.col("t") == 1) & (F.col("f") == 1)).alias("true_positives"))
    tp, fp, fn = F.col("true_positives"), F.col("flagged") - F.col("true_positives"), F.col("ground_truth") - F.col("true_positives")
    p, r = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
    return c.select("ground_truth", "flagged", "true_positives", fp.alias("false_positives"), fn.alias("false_negatives"), F.greatest(u - tp - fp - fn, F.lit(0)).cast("bigint").alias("true_negatives"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(2 * p * r / F.greatest(p + r, F.lit(1e-9)), 4).alias("f1"), F.round(fp / F.greatest(u - F.col("ground_truth"), F.lit(1)), 4).alias("false_positive_rate"))
