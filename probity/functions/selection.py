"""Exact order statistics of groups of any size, by counting passes over ordered 64-bit keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from probity.sources.tables import Store

#: Groups of more rows are selected from by counting, others by Spark's percentile, which maps a group's distinct values in one task.
LEAST = 1 << 16
#: Bits that a pass resolves, and so the logarithm of the rows of a histogram.
BITS = 16
#: A bin of so many rows, at most, is sorted by one task.
FINISH = 1 << 16


@F.pandas_udf(T.LongType())
def _key(x: pd.Series) -> pd.Series:
    """Doubles as integers of the same order; -0.0 comes before 0.0."""
    bits = x.to_numpy(np.float64).view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


@F.pandas_udf(T.DoubleType())
def _value(k: pd.Series) -> pd.Series:
    bits = k.to_numpy(np.int64)
    return pd.Series((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64))


def order_statistics(rows: DataFrame, targets: DataFrame, store: Store, finish: int = FINISH) -> DataFrame:
    """(g, r, x): the value of rank r, counted from 0, in each group, for targets(g, r) of rows(g, x); x is a double without NaN or null.

    A pass counts rows by the next BITS bits of their key, only where a rank is still open, in histograms that are added up in
    every task before they meet; all ranks of all groups go in step. A bin of few rows is sorted; one of many is
    counted on, until after 64 bits it is one value, however many rows have it.
    """
    keyed = store.keep(rows.select("g", _key("x").alias("k")))
    targets = store.keep(targets)  # its size is known, so rows needn't be dealt by their few groups to meet it
    todo = targets.select("g", "r", F.lit(0).cast("bigint").alias("prefix"), F.col("r").alias("rest"))
    found = []
    for level in range(64 // BITS):
        shift = 64 - BITS * (level + 1)
        inside = keyed.withColumn("prefix", F.lit(0).cast("bigint") if level == 0 else F.shiftright("k", shift + BITS))
        if level:  # at first all rows have prefix 0, and would meet in one task a group
            inside = inside.join(todo.select("g", "prefix").distinct(), ["g", "prefix"], "left_semi")
        bins = inside.groupBy("g", "prefix", F.shiftright("k", shift).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("g", "prefix").orderBy("bin"))  # 2^BITS rows at most
        bins = bins.select("g", "prefix", "bin", "n", (upto - F.col("n")).alias("before"))
        hit = todo.join(bins, ["g", "prefix"]).filter("rest >= before and rest < before + n")
        hit = store.keep(hit.select("g", "r", F.col("bin").alias("prefix"), (F.col("rest") - F.col("before")).alias("rest"), "n"))
        if shift == 0:
            found.append(hit.select("g", "r", F.col("prefix").alias("k")))
            break
        few, todo = hit.filter(F.col("n") <= finish), hit.filter(F.col("n") > finish).drop("n")
        sorted_ = keyed.withColumn("prefix", F.shiftright("k", shift)).join(few.select("g", "prefix").distinct(), ["g", "prefix"], "left_semi")
        sorted_ = sorted_.select("g", "prefix", "k", (F.row_number().over(Window.partitionBy("g", "prefix").orderBy("k")) - 1).cast("bigint").alias("rest"))
        found.append(few.join(sorted_, ["g", "prefix", "rest"]).select("g", "r", "k"))
        if todo.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("g", "r", _value("k").alias("x"))


def quantiles(df: DataFrame, value: str | Column, by: Sequence[str], probs: Mapping[str, float], least: int = LEAST, stored: bool = False) -> DataFrame:
    """One row a group: its columns, and under each name of probs that quantile, linearly interpolated, of the values that are finite numbers.

    Exact at every size. Null in a group's column is a group like others; groups without such values have no row. `stored`: df is read from
    a written table or made cheaply from one, so that reading it several times costs little.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    own = F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0).alias("all"))
    rows = df.select(own.alias("g"), x.alias("x")).filter(~F.isnan("x") & (F.abs("x") < float("inf")))
    names = [F.col(f"g.{c}").alias(c) for c in by]
    store = Store(df.sparkSession, "select")
    rows = rows if stored else store.keep(rows)  # two columns, so that what made them runs once
    sizes = store.keep(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= least:
        return rows.groupBy("g").agg(*(F.percentile("x", F.lit(float(p))).alias(k) for k, p in probs.items())).select(*names, *probs)
    at = {k: F.lit(float(p)) * (F.col("n") - 1) for k, p in probs.items()}
    ends = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(a).cast("bigint"), F.ceil(a).cast("bigint")) for a in at.values()))))
    values = order_statistics(rows, sizes.select("g", F.explode(ends).alias("r")), store)
    values = values.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("r", "x"))).alias("m"))  # two a quantile
    low = {k: F.col("m")[F.floor(a).cast("bigint")] for k, a in at.items()}
    high = {k: F.col("m")[F.ceil(a).cast("bigint")] for k, a in at.items()}
    mixed = {k: F.when(F.floor(a) == F.ceil(a), low[k]).otherwise((F.ceil(a) - a) * low[k] + (a - F.floor(a)) * high[k]) for k, a in at.items()}
    return store.keep(sizes.join(values, "g").select(*names, *(c.alias(k) for k, c in mixed.items())))  # small, and known to be
