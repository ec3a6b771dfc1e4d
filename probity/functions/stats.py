"""Robust statistics as column expressions and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.functions import scans, selection
from probity.sources.tables import Store

TINY = 1e-12


def finite(x: Column) -> Column:
    """x as a double, null where it is null, NaN or infinite."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x held to [low, high]; what isn't a number becomes low."""
    d = x.cast("double")
    return F.coalesce(F.when(F.isnan(d), None).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), d))), F.lit(low))


def percentage(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(100 * part / F.nullif(whole.cast("double"), F.lit(0.0)), 2), F.lit(0.0))


def softmax(v: Column, temperature: float = 1.0) -> Column:
    """Of an array of doubles, shifted by its maximum."""
    t = max(temperature, 1e-6)
    e = F.transform(v, lambda x: F.exp((x - F.array_max(v)) / t))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def energy_score(v: Column, temperature: float = 1.0) -> Column:
    """-T * logsumexp(v / T), shifted by the maximum."""
    t = max(temperature, 1e-6)
    top = F.array_max(v)
    return -(top + t * F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp((x - top) / t))))


def entropy(v: Column) -> Column:
    """Natural-log entropy of the positive entries of an array, which are made to sum to 1."""
    pos = F.filter(v, lambda x: x > 0)
    total = F.aggregate(pos, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(pos) == 0, 0.0).otherwise(-F.aggregate(pos, F.lit(0.0), lambda a, x: a + x / total * F.log(x / total)))


def normalised_entropy(v: Column) -> Column:
    """entropy over the log of the array's length, zeros counted."""
    return F.when(F.size(v) < 2, 0.0).otherwise(entropy(v) / F.log(F.size(v).cast("double")))


def confidence_from_zscore(z: Column, threshold: float, ceiling: float = 0.99) -> Column:
    """0.5 at the threshold; a saturating curve on either side of it."""
    r = F.abs(z) / max(abs(threshold), 1e-6)
    below = 0.5 * (1 - F.exp(-0.8 * r)) / (1 - F.exp(F.lit(-0.8)))
    above = 0.5 + 0.5 * (1 - F.exp(-1.2 * (r - 1)))
    return clamp(F.when(r <= 1, below).otherwise(above), 0.0, ceiling)


def noisy_or(x: Column, cap: float = 0.999) -> Column:
    """Aggregate: 1 - prod(1 - x), each x held to [0, cap]; 0 for no rows."""
    return F.coalesce(1 - F.product(1 - clamp(x, 0.0, cap)), F.lit(0.0))


def aggregate_risk(x: Column, weight: Column | None = None, method: str = "noisy_or") -> Column:
    if method == "max":
        return F.coalesce(F.max(clamp(x)), F.lit(0.0))
    if method == "weighted_mean":
        w = F.lit(1.0) if weight is None else weight
        return F.coalesce(F.sum(w * clamp(x)) / F.nullif(F.sum(w), F.lit(0.0)), F.lit(0.0))
    return noisy_or(x if weight is None else x * weight)


def zscore(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "zscore") -> DataFrame:
    """Population z-score within each group, 0 where the group doesn't vary. One row a group is joined back."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    j = df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))  # one row
    return j.withColumn(out, F.when(F.col("__s") < TINY, 0.0).otherwise((F.col(value) - F.col("__m")) / F.col("__s"))).drop("__m", "__s")


def modified_zscore(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "modified_z", least: int = selection.LEAST) -> DataFrame:
    """0.6745 * (x - median) / MAD; where the MAD is 0, (x - median) / (1.253314 * mean absolute deviation); else 0.

    Medians are of the finite values and exact; groups of over `least` rows are selected from by counting passes, so none is sorted or
    mapped in one task. A null group is a group; null where x is null or its group has no finite value."""
    med, dev, mad, mean = scans.free(df, "med", "dev", "mad", "mean")
    store = Store(df.sparkSession, "z")
    df = store.keep(df)  # read four times
    d = scans.join_on(df, selection.quantiles(df, value, by, {med: 0.5}, least, True), by, "left") if by else _one(df, selection.quantiles(df, value, (), {med: 0.5}, least, True))
    d = d.withColumn(dev, F.col(value) - F.col(med))
    size = F.abs(F.col(dev))
    means = store.keep(d.filter(~F.isnan(dev) & (size < float("inf"))).groupBy(*by).agg(F.avg(size).alias(mean)))
    mads = selection.quantiles(d, size, by, {mad: 0.5}, least, True)
    d = scans.join_on(scans.join_on(d, mads, by, "left"), means, by, "left") if by else _one(_one(d, mads), means)
    z = F.when(F.col(dev).isNull(), None).when(F.col(mad) >= TINY, 0.6745 * F.col(dev) / F.col(mad)).when(F.col(mean) >= TINY, F.col(dev) / (1.253314 * F.col(mean))).otherwise(0.0)
    return d.drop(out).withColumn(out, z).drop(med, dev, mad, mean)


def _one(df: DataFrame, row: DataFrame) -> DataFrame:
    """df with the columns of row, a table of one row or none, where they are null."""
    return df.join(F.broadcast(row), F.lit(True), "left")


def robust_stats(df: DataFrame, value: str, by: Sequence[str] = (), least: int = selection.LEAST) -> DataFrame:
    """n, mean, population sd, median, mad, min, max, q1, q3, iqr, skewness, kurtosis (excess) of the finite values.

    Order statistics are exact and selected by counting in groups of over `least` rows. A null group is a group."""
    d = Store(df.sparkSession, "robust").keep(df.select(*by, finite(F.col(value)).alias("x")).filter("x is not null"))
    ranks = selection.quantiles(d, "x", by, {"median": 0.5, "q1": 0.25, "q3": 0.75}, least, True)
    meds = ranks.select(*by, F.col("median").alias("m"))
    dev = scans.join_on(d, meds, by, "left") if by else _one(d, meds)  # rows, however small as written, are never what is broadcast
    mads = selection.quantiles(dev, F.abs(F.col("x") - F.col("m")), by, {"mad": 0.5}, least, True)
    flat = F.stddev_pop("x") < TINY
    sums = d.groupBy(*by).agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.when((F.count("x") < 3) | flat, 0.0).otherwise(F.skewness("x")).alias("skewness"), F.when((F.count("x") < 4) | flat, 0.0).otherwise(F.kurtosis("x")).alias("kurtosis"),
    )
    both = scans.join_on(scans.join_on(sums, ranks, by, "left"), mads, by, "left") if by else _one(_one(sums, ranks), mads)
    return both.select(*by, "n", "mean", "std", "median", "mad", "min", "max", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), "skewness", "kurtosis")


def percentile_threshold(value: str, p: float) -> Column:
    """Exact percentile with linear interpolation, p held to [0, 100]; 0 for no rows. For groups that fit a task; percentile_limits for others."""
    return F.coalesce(F.percentile(value, F.lit(min(100.0, max(0.0, p)) / 100)), F.lit(0.0))


def percentile_limits(df: DataFrame, value: str, p: float, by: Sequence[str] = (), out: str = "limit", least: int = selection.LEAST) -> DataFrame:
    """One row a group with that percentile, for groups of any size; without `by` one row, 0 where there are no values."""
    q = selection.quantiles(df, value, by, {out: min(100.0, max(0.0, p)) / 100}, least)
    return q if by else q.agg(F.coalesce(F.max(out), F.lit(0.0)).alias(out))


def ks_two_sample(df: DataFrame, value: str, side: str, by: Sequence[str] = (), least: int = scans.LEAST) -> DataFrame:
    """Largest gap between the distributions of side 0 and side 1, with the asymptotic p-value. Ties are counted once each.

    A group with rows of one side only has neither. Equal values are summed first. Groups of over `least` different values are scanned in two levels (scans.Scan), so none is one task's."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum((F.col(side) == 0).cast("bigint")).alias("a"), F.sum((F.col(side) == 1).cast("bigint")).alias("b"))
    store = Store(df.sparkSession, "ks")
    counts = store.keep(counts)
    if scans.largest_group(counts, by) > least:
        scan = scans.Scan(counts, by, [F.col(value).asc_nulls_first()], store)
        whole = counts.groupBy(*by).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
        c = scans.join_on(scan.clean(scan.sums(ca=F.col("a"), cb=F.col("b"))), whole, by)
        c = c.select(*by, (F.col("ca") + F.col("a")).alias("ca"), (F.col("cb") + F.col("b")).alias("cb"), "na", "nb")
    else:
        run, whole = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by)
        c = counts.select(*by, F.sum("a").over(run).alias("ca"), F.sum("b").over(run).alias("cb"), F.sum("a").over(whole).alias("na"), F.sum("b").over(whole).alias("nb"))
    out = c.groupBy(*by).agg(F.max(F.abs(F.try_divide("ca", "na") - F.try_divide("cb", "nb"))).alias("statistic"), F.max("na").alias("n_baseline"), F.max("nb").alias("n_current"))
    lam = F.sqrt(F.col("n_baseline") * F.col("n_current") / (F.col("n_baseline") + F.col("n_current"))) * F.col("statistic")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + 2 * F.pow(F.lit(-1.0), k - 1) * F.exp(-2 * lam * lam * k * k))
    return out.withColumn("p_value", F.when(lam < 0.2, 1.0).when(F.col("statistic").isNotNull(), clamp(series)))


def bimodality(df: DataFrame, value: str, by: Sequence[str] = (), least: int = scans.LEAST) -> DataFrame:
    """Best split of a group's sorted values between its 10th and 90th percentile: the distance of the sides' means over their
    pooled sd. Bimodal above 5 with over 8 % on the smaller side; groups of fewer than 8 are never. The earliest best wins.

    Groups of over `least` rows are scanned in two levels (scans.Scan), so none is one task's."""
    d = df.select(*by, F.col(value).cast("double").alias("x")).filter("x is not null")
    square = F.col("x") * F.col("x")
    store = Store(df.sparkSession, "split")
    d = store.keep(d)
    if scans.largest_group(d, by) > least:
        scan = scans.Scan(d, by, [F.col("x").asc()], store)
        whole = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("ts"), F.sum(square).alias("tq"))
        d = scans.join_on(scan.clean(scan.sums(k=F.lit(1).cast("bigint"), s=F.col("x"), q=square)), whole, by).withColumn("k", F.col("k") + 1)
    else:
        w = Window.partitionBy(*by)
        upto = w.orderBy("x", "tie").rowsBetween(Window.unboundedPreceding, -1)
        d = d.withColumn("tie", F.monotonically_increasing_id())
        d = d.select(*by, "x", F.row_number().over(w.orderBy("x", "tie")).alias("k"), F.count("x").over(w).alias("n"), F.sum("x").over(upto).alias("s"), F.sum(square).over(upto).alias("q"), F.sum("x").over(w).alias("ts"), F.sum(square).over(w).alias("tq"))
    left, right = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k") + 1).cast("double")
    ml, mr = F.col("s") / left, (F.col("ts") - F.col("s")) / right
    vl, vr = F.greatest(F.col("q") / left - ml * ml, F.lit(0.0)), F.greatest((F.col("tq") - F.col("q")) / right - mr * mr, F.lit(0.0))
    sd = F.sqrt((left * vl + right * vr) / F.col("n"))
    inside = (F.col("k") - 1 >= F.greatest(F.floor(F.col("n") * 0.1), F.lit(1))) & (F.col("k") - 1 <= F.ceil(F.col("n") * 0.9)) & (F.col("n") >= 8)
    d = d.filter(inside).select(*by, "k", "n", F.when(sd > TINY, F.abs(mr - ml) / sd).otherwise(0.0).alias("separation"), (F.least(left, right) / F.col("n")).alias("minority"))
    best = d.groupBy(*by).agg(F.max_by(F.struct("separation", "minority", "n"), F.struct("separation", -F.col("k"))).alias("b"))
    return best.select(*by, F.col("b.n").alias("n"), F.col("b.separation").alias("separation"), F.col("b.minority").alias("minority_fraction"), ((F.col("b.separation") > 5) & (F.col("b.minority") > 0.08)).alias("bimodal"))
