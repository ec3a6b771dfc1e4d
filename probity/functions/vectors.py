"""Vectors held as array<double>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(1e-8))
    return F.transform(a, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-9)) * F.greatest(norm(b), F.lit(1e-9)))


def centroids(df: DataFrame, by: str, vector: str = "embedding", least: int = 1) -> DataFrame:
    """(by, n, centroid) of the groups of at least `least` rows. Sums are partial: one row a group and position is shuffled."""
    long = df.select(by, F.posexplode(vector).alias("pos", "x"))
    mean = long.groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    out = mean.groupBy(by).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("v"))
    return out.filter(F.col("n") >= least).select(by, "n", F.col("v.m").alias("centroid"))


def separability(df: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """One row: between-class and within-class scatter over n, and their ratio."""
    d = df.select(by, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    cls, whole = centroids(d, by, "v"), centroids(d.withColumn("__all", F.lit(0)), "__all", "v").select(F.col("centroid").alias("g"))
    between = cls.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("n") * squared_distance(F.col("centroid"), F.col("g"))).alias("between"), F.sum("n").alias("n"))  # one row
    within = d.join(cls.select(by, "centroid"), by).agg(F.sum(squared_distance(F.col("v"), F.col("centroid"))).alias("within"))
    both = between.crossJoin(within)  # one row each
    return both.select((F.col("between") / F.col("n")).alias("between"), (F.col("within") / F.col("n")).alias("within"), (F.col("between") / F.greatest("within", F.lit(1e-12))).alias("ratio"))
