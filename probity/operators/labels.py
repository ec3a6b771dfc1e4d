"""Label errors over embeddings: flipped labels and systematic mislabelling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions.selection import quantiles
from probity.functions.stats import clamp, softmax
from probity.functions.vectors import centroids, squared_distance
from probity.operators.neighbours import nearest


def centroid_distances(df: DataFrame, min_class: int = 8, std_multiplier: float = 2.0, id_col: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(id, label, n, distance, threshold, distance_flag); classes below min_class keep their row with null threshold."""
    d = df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    c = centroids(d, "label", "v")
    d = d.join(c, "label").select("id", "label", "n", F.sqrt(squared_distance(F.col("v"), F.col("centroid"))).alias("distance"))
    s = d.groupBy("label").agg(F.avg("distance").alias("m"), F.stddev_pop("distance").alias("sd"))
    big = F.col("n") >= min_class
    d = d.join(s, "label").withColumn("threshold", F.when(big, F.col("m") + std_multiplier * F.col("sd")))
    return d.select("id", "label", "n", "distance", "threshold", (big & (F.col("sd") >= 1e-9) & (F.col("distance") > F.col("threshold"))).alias("distance_flag"))


def label_flips(df: DataFrame, k: int = 10, min_class: int = 8, std_multiplier: float = 2.0, disagreement: float = 0.6, majority: float = 0.5, id_col: str = "vec_id", label: str = "label", vector: str = "embedding", within: str | None = None, neighbours: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Rows whose label its neighbours or its class's centroid contradict, with a confidence.

    Of the k nearest rows of all classes: agreement is the share with the row's own label; the suggested label is the most
    frequent one (the smallest of ties). With `within` (a contributor, say) each of its values is a population of its own.
    `neighbours(df, k)` gives (id, neighbour), such as cells.indexed for tables too large for all pairs; without it they are exact.
    """
    if within is None:
        dist = centroid_distances(df, min_class, std_multiplier, id_col, label, vector)
    else:
        own_class = df.withColumn("__class", F.struct(F.col(within).alias("g"), F.col(label).alias("label")))
        dist = centroid_distances(own_class, min_class, std_multiplier, id_col, "__class", vector).withColumn("label", F.col("label.label"))
    labels = df.select(F.col(id_col).alias("neighbour"), F.col(label).alias("nl"))
    votes = (neighbours(df, k) if neighbours else nearest(df, k, id_col, vector, within=within)).join(labels, "neighbour").groupBy("id", "nl").agg(F.count(F.lit(1)).alias("c"))
    own = df.select(F.col(id_col).alias("id"), F.col(label).alias("own"))
    votes = votes.join(own, "id").groupBy("id").agg(F.sum("c").alias("k"), F.coalesce(F.sum(F.when(F.col("nl") == F.col("own"), F.col("c"))), F.lit(0)).alias("same"), F.max_by(F.struct("nl", "c"), F.struct("c", -F.col("nl"))).alias("top"))
    j = dist.filter("threshold is not null").join(votes, "id")
    agree, share = F.col("same") / F.col("k"), F.col("top.c") / F.col("k")
    # 1 - disagreement in floating point can lie just below the share it stands for
    neighbour_flag = (agree <= 1 - disagreement + 1e-12) & (F.col("top.nl") != F.col("label")) & (share >= majority)
    j = j.select("id", "label", "distance", "threshold", (F.col("distance") / F.greatest("threshold", F.lit(1e-9))).alias("ratio"), agree.alias("agreement"), F.col("top.nl").alias("suggested"), share.alias("share"), "distance_flag", neighbour_flag.alias("neighbour_flag"))
    j = j.filter("distance_flag or neighbour_flag")
    c = clamp(0.20 + 0.60 * (1 - F.round("agreement", 4)) + 0.15 * F.greatest(F.round("ratio", 4) - 1, F.lit(0.0)), 0.0, 0.97)
    c = F.when((F.col("suggested") != F.col("label")) & (F.col("share") >= 0.5), F.least(c + 0.15, F.lit(0.97))).otherwise(c)
    c = F.when(F.col("distance_flag") & F.col("neighbour_flag"), F.least(c + 0.08, F.lit(0.98))).otherwise(c)
    return j.withColumn("confidence", c)


def flip_order(flips: DataFrame) -> DataFrame:
    """label_flips, those that their neighbours contradict most first, then the farthest from their class, then by id."""
    return flips.orderBy(F.col("agreement").asc(), F.col("ratio").desc(), "id")


def class_probabilities(df: DataFrame, min_class: int = 8, id_col: str = "vec_id", label: str = "label", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """((id, label, classes, probs) by softmax of -d2 / median d2 to the centroids of classes of min_class rows, the class sizes)."""
    d = df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    c = centroids(d, "label", "v", min_class)
    table = c.agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("c"))  # one row: a class each
    d2 = d.crossJoin(F.broadcast(table)).select("id", "label", F.transform("c", lambda x: x["label"]).alias("classes"), F.transform("c", lambda x: squared_distance(F.col("v"), x["centroid"])).alias("d2"))
    scale = quantiles(d2.select(F.explode("d2").alias("x")), "x", (), {"scale": 0.5})
    p = d2.crossJoin(F.broadcast(scale)).select("id", "label", "classes", softmax(F.transform("d2", lambda x: -x / F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")))).alias("probs"))
    return p, c.select("label", "n")


def mislabelled(df: DataFrame, min_gap: float = 0.30, margin: float = 0.15, min_class: int = 8, **names: str) -> DataFrame:
    """Rows whose most probable class beats the given one by min_gap: id, given, predicted, probabilities, gap, rate of the pair
    given -> predicted, systematic (3 rows and 10 % of the class), confidence."""
    p, sizes = class_probabilities(df, min_class, **names)
    given = F.get("probs", F.array_position("classes", F.col("label")).cast("int") - 1)
    p = p.filter(F.array_contains("classes", F.col("label"))).select("id", "label", given.alias("pg"), F.array_max("probs").alias("pp"), F.element_at("classes", F.array_position("probs", F.array_max("probs")).cast("int")).alias("predicted"))
    own = p.groupBy(F.col("label").alias("predicted")).agg(F.avg("pg").alias("need"))
    e = p.filter("predicted <> label").join(own, "predicted").withColumn("gap", F.col("pp") - F.col("pg")).filter((F.col("gap") >= min_gap) & (F.col("pp") >= F.col("need") - margin))
    pairs = e.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("pair_count")).join(sizes, "label").withColumn("rate", F.col("pair_count") / F.col("n"))
    pairs = pairs.withColumn("systematic", (F.col("pair_count") >= 3) & (F.col("rate") >= 0.10)).drop("n")
    c = clamp(0.30 + 0.55 * F.round("gap", 4), 0.0, 0.90)
    e = e.join(pairs, ["label", "predicted"]).withColumn("confidence", F.when(F.col("systematic"), F.least(c + 0.15, F.lit(0.93))).otherwise(c))
    return e.select("id", F.col("label").alias("given"), "predicted", F.col("pg").alias("given_probability"), F.col("pp").alias("predicted_probability"), "gap", "pair_count", "rate", "systematic", "confidence")


def report_mislabelled(errors: DataFrame, least: float = 0.40, most: int = 60) -> DataFrame:
    """The reported rows: the `most` widest gaps of at least `least` confidence."""
    return errors.filter(F.col("confidence") >= least).orderBy(F.col("gap").desc(), "id").limit(most)


def pair_findings(errors: DataFrame) -> DataFrame:
    p = errors.filter("systematic").select("given", "predicted", "pair_count", "rate").distinct()
    return p.withColumn("confidence", clamp(0.50 + F.col("rate"), 0.0, 0.95))


__all__ = ["centroid_distances", "class_probabilities", "flip_order", "label_flips", "mislabelled", "pair_findings", "report_mislabelled"]
