"""Distribution drift between a baseline (side 0) and current data (side 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions.selection import quantiles
from probity.functions.stats import bimodality, clamp, ks_two_sample
from probity.functions.vectors import centroids, cosine, norm, squared_distance
from probity.operators import kernels
from probity.sources.tables import Store

#: Movements that go together for a physical reason: code, direction of each property (0: either), required ones, matches needed (fixed values but for the codes).
SIGNATURES = (
    ("LOW_LIGHT", {"brightness": -1, "contrast": -1, "sharpness": -1, "color_warmth": 0}, ("brightness",), 2),
    ("HAZE", {"brightness": 1, "contrast": -1, "edge_density": -1, "sharpness": -1}, ("contrast", "edge_density", "sharpness"), 2),
    ("OPTICS_CHANGE", {"sharpness": 1, "edge_density": 1, "contrast": 0}, ("sharpness",), 1),
    ("SEASON", {"color_warmth": 0, "brightness": 0, "contrast": 0}, ("color_warmth",), 2),
)


def long_form(df: DataFrame, properties: list[str], side: str) -> DataFrame:
    pairs = ", ".join(f"'{p}', cast({p} as double)" for p in properties)
    return df.select(F.col(side).alias("side"), F.expr(f"stack({len(properties)}, {pairs}) as (property, value)")).filter("value is not null")


def property_drift(df: DataFrame, properties: list[str], side: str = "side", material: float = 0.15, z_limit: float = 2.0) -> DataFrame:
    """Per property: means, z of the mean's move in baseline sds (1.4826 MAD where the sd is 0), relative change, direction, flags, KS.

    A written table of one row a property; medians are only selected for properties whose baseline doesn't vary, since no other's count."""
    d, store = long_form(df, properties, side), Store(df.sparkSession, "drift")
    one = lambda s: F.col("side") == s
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    a = d.groupBy("property").agg(F.avg(F.when(one(0), F.col("value"))).alias("baseline_mean"), F.stddev_pop(F.when(one(0), F.col("value"))).alias("sd"), F.avg(F.when(one(1), F.col("value"))).alias("current_mean"), F.count_if(one(0) & finite).alias("n0"), F.count_if(one(1)).alias("n1"))
    a = store.keep(a.filter("n0 > 0 and n1 > 0"))
    flat = [r["property"] for r in a.filter(~(F.col("sd") > 1e-9)).collect()]  # properties are few
    if flat:
        base = d.filter(one(0) & F.col("property").isin(flat))
        med = quantiles(base, "value", ["property"], {"med": 0.5})
        a = a.join(quantiles(base.join(med, "property"), F.abs(F.col("value") - F.col("med")), ["property"], {"mad": 0.5}), "property", "left")
    else:
        a = a.withColumn("mad", F.lit(None).cast("double"))
    a = a.join(ks_two_sample(d, "value", "side", ["property"]).select("property", "statistic", "p_value"), "property")
    sd = F.when(F.col("sd") > 1e-9, F.col("sd")).otherwise(1.4826 * F.col("mad"))
    move = F.col("current_mean") - F.col("baseline_mean")
    z = F.when(sd > 1e-9, move / sd).otherwise(0.0)
    rel = move / F.greatest(F.abs("baseline_mean"), F.lit(1e-9))
    return store.keep(a.select("property", "baseline_mean", "current_mean", z.alias("zscore"), rel.alias("relative_change"), F.when(move > 0, "increase").otherwise("decrease").alias("direction"), (F.abs(rel) >= material).alias("material"), ((F.abs(rel) >= material) & (F.abs(z) > z_limit)).alias("shifted"), F.col("statistic").alias("ks"), "p_value"))


def match_signatures(props: DataFrame, most: int = 2) -> DataFrame:
    """The (at most two) most complete signatures that the moved properties fit: enough agree, none contradicts, a required one and
    a properly shifted one are among them."""
    rows = [(k, name, p, d, p in req, need) for k, (name, dirs, req, need) in enumerate(SIGNATURES) for p, d in dirs.items()]
    sig = props.sparkSession.createDataFrame(rows, "k int, name string, property string, expected int, required boolean, need int")
    moved = props.filter("material or shifted").select("property", F.when(F.col("direction") == "increase", 1).otherwise(-1).alias("observed"), "shifted")
    j = F.broadcast(sig).join(moved, "property").withColumn("ok", (F.col("expected") == 0) | (F.col("expected") == F.col("observed")))
    m = j.groupBy("k", "name").agg(F.count_if(F.col("ok")).alias("matches"), F.count_if(~F.col("ok")).alias("against"), F.max("need").alias("need"), F.max(F.col("ok") & F.col("required")).alias("has"), F.max(F.col("ok") & F.col("shifted")).alias("proper"), F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("property")))).alias("properties"))
    m = m.filter("against = 0 and matches >= need and has and proper").orderBy(F.col("matches").desc(), "k").limit(most)
    return m.select("name", F.col("matches").cast("bigint").alias("matches"), "properties")


def centroid_drift(df: DataFrame, vector: str = "embedding", side: str = "side", limit: float = 0.15) -> DataFrame:
    """One row: centroid shift and cosine, variance ratio, share of current rows beyond the baseline's mean + 2 sd, flags."""
    d = df.select(F.col(side).alias("side"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    c = centroids(d, "side", "v")
    both = c.groupBy().agg(F.max(F.when(F.col("side") == 0, F.col("centroid"))).alias("c0"), F.max(F.when(F.col("side") == 1, F.col("centroid"))).alias("c1"))
    dist = d.crossJoin(F.broadcast(both)).withColumn("d0", F.sqrt(squared_distance(F.col("v"), F.col("c0")))).withColumn("own", squared_distance(F.col("v"), F.when(F.col("side") == 0, F.col("c0")).otherwise(F.col("c1"))))  # one row
    s = dist.groupBy().agg(
        F.avg(F.when(F.col("side") == 0, F.col("own"))).alias("v0"), F.avg(F.when(F.col("side") == 1, F.col("own"))).alias("v1"),
        F.avg(F.when(F.col("side") == 0, F.col("d0"))).alias("m"), F.stddev_pop(F.when(F.col("side") == 0, F.col("d0"))).alias("sd"),
    )
    out = dist.crossJoin(F.broadcast(s)).groupBy().agg(F.avg(F.when(F.col("side") == 1, (F.col("d0") > F.col("m") + 2 * F.col("sd")).cast("double"))).alias("outlier_fraction"))
    ratio = F.col("v1") / F.greatest("v0", F.lit(1e-12))
    r = both.crossJoin(s).crossJoin(out)  # one row each
    return r.select(
        (F.sqrt(squared_distance(F.col("c0"), F.col("c1"))) / F.greatest(norm(F.col("c0")), F.lit(1e-9))).alias("centroid_shift"), cosine(F.col("c0"), F.col("c1")).alias("cosine"), ratio.alias("variance_ratio"), "outlier_fraction",
        (F.sqrt(squared_distance(F.col("c0"), F.col("c1"))) / F.greatest(norm(F.col("c0")), F.lit(1e-9)) > limit).alias("centroid_significant"), (ratio < 0.60).alias("variance_collapsed"), (ratio > 1.70).alias("variance_inflated"),
    )


def projection_bimodality(df: DataFrame, vector: str = "embedding", side: str = "side") -> DataFrame:
    """Bimodality of the current rows' distances to the baseline centroid; concentrated if a 2 to 80 % minority stands apart."""
    d = df.select(F.col(side).alias("side"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    base = centroids(d.filter("side = 0"), "side", "v").select("centroid")
    x = d.filter("side = 1").crossJoin(F.broadcast(base)).select(F.sqrt(squared_distance(F.col("v"), F.col("centroid"))).alias("distance"))
    b = bimodality(x, "distance")
    return b.withColumn("concentrated", F.col("bimodal") & (F.col("minority_fraction") > 0.02) & (F.col("minority_fraction") < 0.80))


def mmd(df: DataFrame, vector: str = "embedding", side: str = "side", id_col: str = "vec_id", features: int | None = None) -> DataFrame:
    """(mmd, gamma, n0, n1, error_bound): RBF maximum mean discrepancy with the median heuristic, of all rows that have a vector.

    Exact over all pairs, by tiles (kernels.mmd_exact), with error_bound 0; its work is quadratic. Vectors of floats move as floats. With `features` one pass over the rows by
    that many random features, for tables where pairs are too many: error_bound then bounds what mmd^2 can be off by, at 99 %.
    """
    d = df.filter(F.col(vector).isNotNull() & F.col(side).isin(0, 1)).select(F.col(side).cast("int").alias("side"), F.col(id_col).alias("id"), (F.col(vector) if df.schema[vector].dataType.simpleString() == "array<float>" else F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    value, gamma, n, bound = (*kernels.mmd_exact(d), 0.0) if features is None else kernels.mmd_features(d, features)
    return df.sparkSession.createDataFrame([(value, gamma, n.get(0, 0), n.get(1, 0), bound)], "mmd double, gamma double, n0 bigint, n1 bigint, error_bound double")


def characterise(props: DataFrame, features: DataFrame | None, signatures: DataFrame, mmd_limit: float = 0.05, centroid_limit: float = 0.15) -> DataFrame:
    """One row: shift_type, risk_score, severity, confidence. features: one row with mmd, centroid_shift, variance flags, concentrated."""
    from probity.operators.findings import drift_severity

    explained = signatures.select(F.explode("properties").alias("property")).distinct().withColumn("fits", F.lit(True))
    p = props.join(F.broadcast(explained), "property", "left").agg(F.count_if(F.col("shifted")).alias("num_shifted"), F.count_if(F.col("material")).alias("num_material"), F.coalesce(F.max(F.abs("zscore")), F.lit(0.0)).alias("max_z"), F.count_if(F.col("shifted") & F.col("fits").isNull()).alias("unexplained"), F.count(F.lit(1)).alias("np"))
    n = signatures.agg(F.count(F.lit(1)).alias("natural"))
    r = p.crossJoin(n)  # one row each
    if features is None:
        r = r.selectExpr("*", "0D as mmd", "0D as centroid_shift", "false as variance_collapsed", "false as variance_inflated", "false as concentrated", "false as has_features")
    else:
        r = r.crossJoin(features.select("mmd", "centroid_shift", "variance_collapsed", "variance_inflated", "concentrated").withColumn("has_features", F.lit(True)))
    big = (F.col("mmd") > mmd_limit) | (F.col("centroid_shift") > centroid_limit)
    signals = (big & (F.col("num_material") == 0)).cast("int") + (F.col("unexplained") > 0).cast("int") + F.col("variance_collapsed").cast("int") + F.col("variance_inflated").cast("int") + F.col("concentrated").cast("int")
    r = r.withColumn("suspicious", signals)
    drift = (F.col("num_shifted") > 0) | big | F.col("variance_collapsed") | F.col("variance_inflated")
    kind = F.when(~drift, "NO_SIGNIFICANT_DRIFT").when((F.col("suspicious") > 0) & (F.col("natural") > 0), "MIXED_DRIFT").when(F.col("suspicious") > 0, "SUSPICIOUS_MANIPULATION").when(F.col("natural") > 0, "NATURAL_OPERATIONAL_DRIFT").otherwise("MIXED_DRIFT")
    part = F.greatest(F.least(F.lit(1.0), F.col("mmd") / (mmd_limit * 4)), F.least(F.lit(1.0), F.col("centroid_shift") / (centroid_limit * 4)))
    r = r.withColumn("shift_type", kind).withColumn("base", 0.35 * F.least(F.lit(1.0), F.col("max_z") / 8) + 0.20 * F.least(F.lit(1.0), F.col("num_shifted") / 3) + 0.45 * part)
    sus = F.least(F.lit(0.45), 0.15 * F.col("suspicious"))
    risk = F.when(F.col("shift_type") == "SUSPICIOUS_MANIPULATION", F.least(F.lit(1.0), 0.45 + 0.55 * F.col("base") + sus)).when(F.col("shift_type") == "MIXED_DRIFT", F.least(F.lit(1.0), 0.30 + 0.45 * F.col("base") + sus * 0.8)).when(F.col("shift_type") == "NATURAL_OPERATIONAL_DRIFT", F.least(F.lit(0.55), 0.12 + 0.40 * F.col("base"))).otherwise(F.least(F.lit(0.15), 0.30 * F.col("base")))
    strong = (F.col("num_shifted") >= 2) | ((F.col("mmd") > mmd_limit) & (F.col("centroid_shift") > centroid_limit))
    conf = 0.35 + F.when(F.col("np") > 0, 0.25).otherwise(0.0) + F.when(F.col("has_features"), 0.30).otherwise(0.0) + F.when(strong, 0.10).otherwise(0.0)
    return r.select("shift_type", F.round(clamp(risk), 4).alias("risk_score"), drift_severity(clamp(risk)).alias("severity"), F.round(clamp(conf, 0.0, 0.95), 3).alias("confidence"), "num_shifted", F.col("natural").alias("num_natural"), F.col("suspicious").cast("bigint").alias("num_suspicious"))
