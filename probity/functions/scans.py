"""Running sums, ranks and last values over the rows of a group in order, with no group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probity.sources.tables import Store

#: Groups of more rows are scanned in two levels, others by one window.
LEAST = 1 << 16


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df has no column of, whatever its case."""
    used, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys of the same names, null meeting null; right's keys are dropped. Without keys, right is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    own = free(left, *(f"{k}_of" for k in keys))
    r = right.withColumnsRenamed(dict(zip(keys, own)))
    cond = None
    for k, o in zip(keys, own):
        c = F.col(k).eqNullSafe(F.col(o))
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*own)


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


class Scan:
    """The rows of df in `order` within the groups `by`, dealt over tasks by ranges and written once.

    Ties keep one order, by a number that each row gets. A first level runs inside the ranges; the ranges' totals, one row a group and
    range, are scanned by a second one and added. `order` says where null goes. Columns that are made get the names given.
    """

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[Column], store: Store):
        self.by, self.order = list(by), list(order)
        self.tie, self.part = free(df, "tie", "part")
        d = df.withColumn(self.tie, F.monotonically_increasing_id())
        n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
        d = d.repartitionByRange(n, *(F.col(c).asc_nulls_first() for c in by), *self.order, F.col(self.tie))
        self.rows = store.keep(d.withColumn(self.part, F.spark_partition_id()))

    def _second(self, totals: DataFrame, values: Mapping[str, Column]) -> DataFrame:
        before = Window.partitionBy(*self.by).orderBy(self.part).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*self.by, self.part, *(v(before).alias(k) for k, v in values.items()))

    def sums(self, rows: DataFrame | None = None, **values: Column) -> DataFrame:
        """Adds under each name the sum of the value over the rows before, this one left out; 0 before the first."""
        d = self.rows if rows is None else rows
        names = dict(zip(values, free(d, *(f"carry_{k}" for k in values))))
        inside = Window.partitionBy(*self.by, self.part).orderBy(*self.order, self.tie).rowsBetween(Window.unboundedPreceding, -1)
        totals = d.groupBy(*self.by, self.part).agg(*(F.sum(v).alias(names[k]) for k, v in values.items()))
        carry = self._second(totals, {n: lambda w, n=n: F.sum(n).over(w) for n in names.values()})
        d = d.withColumns({k: F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in values.items()})
        d = join_on(d, carry, [*self.by, self.part], "left")
        return d.withColumns({k: F.col(k) + F.coalesce(n, F.lit(0)) for k, n in names.items()}).drop(*names.values())

    def lasts(self, rows: DataFrame | None = None, **values: Column) -> DataFrame:
        """Adds under each name the last value before this row that isn't null; null if there is none."""
        d = self.rows if rows is None else rows
        names = dict(zip(values, free(d, *(f"carry_{k}" for k in values))))
        inside = Window.partitionBy(*self.by, self.part).orderBy(*self.order, self.tie).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*self.by, self.part).orderBy(*self.order, self.tie).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ends = d.select(*self.by, self.part, *(F.last(v, ignorenulls=True).over(whole).alias(names[k]) for k, v in values.items())).dropDuplicates([*self.by, self.part])
        carry = self._second(ends, {n: lambda w, n=n: F.last(n, ignorenulls=True).over(w) for n in names.values()})
        d = d.withColumns({k: F.last(v, ignorenulls=True).over(inside) for k, v in values.items()})
        d = join_on(d, carry, [*self.by, self.part], "left")
        return d.withColumns({k: F.coalesce(F.col(k), F.col(n)) for k, n in names.items()}).drop(*names.values())

    def clean(self, rows: DataFrame) -> DataFrame:
        return rows.drop(self.tie, self.part)
