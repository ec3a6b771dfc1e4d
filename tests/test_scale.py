"""Operators that spread one group of all rows over tasks, against their one-task forms and brute force."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probity.functions import scans
from probity.functions import stats as S
from probity.functions.selection import order_statistics, quantiles
from probity.operators import cells, drift, kernels, labels, provenance
from probity.operators.neighbours import nearest
from probity.sources.tables import Store

SF = "/root/testdata/sf0.01"


def odd_values(spark, n=3000):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=n // 2) * 10.0 ** rng.integers(-200, 200, n // 2), np.zeros(n // 4), np.full(n // 4, 7.25), [1e308, -1e308, 5e-324, -0.0]])
    rows = [(None if i % 3 == 0 else f"g{i % 3}", float(v), i) for i, v in enumerate(x)] + [("g1", None, -1), ("g1", float("nan"), -2), (None, float("inf"), -3), ("empty", None, -4)]
    return spark.createDataFrame(rows, "g string, x double, med long"), rows


@pytest.mark.parametrize("finish", [1 << 16, 5])
def test_order_statistics_are_exact(spark, finish):
    df, rows = odd_values(spark)
    d = df.filter("x is not null and not isnan(x) and abs(x) < double('inf')").select(F.struct("g").alias("g"), "x")
    want = {}
    for g, v, _ in rows:
        if v is not None and np.isfinite(v):
            want.setdefault(g, []).append(v)
    ranks = spark.createDataFrame([((g,), r) for g, v in want.items() for r in {0, 1, 17, len(v) // 2, len(v) - 1}], "g struct<g: string>, r long")
    got = order_statistics(d, ranks, Store(spark, "t"), finish).collect()
    assert len(got) == ranks.count() and all(sorted(want[r.g.g])[r.r] == r.x for r in got)


def test_quantiles_by_counting_equal_percentiles(spark):
    df, _ = odd_values(spark)
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
    for by in (["g"], []):
        key = lambda d: sorted(map(tuple, d.collect()), key=str)
        assert key(quantiles(df, "x", by, probs, least=10)) == key(quantiles(df, "x", by, probs))
    assert quantiles(df.limit(0), "x", [], probs).collect() == []


def test_robust_statistics_do_not_depend_on_the_path(spark):
    str = lambda r: repr([f"{v:.9g}" if isinstance(v, float) else v for v in r])  # noqa: A001, E731  sums differ in their last places
    df, _ = odd_values(spark)
    df = df.filter("abs(x) < 1e6 or x is null or isnan(x)")
    for by in (["g"], []):
        few, many = (sorted(map(str, S.robust_stats(df, "x", by, least=k).collect())) for k in (1 << 16, 10))
        assert few == many and len(few) == (3 if by else 1)
        few, many = (sorted(map(str, S.modified_zscore(df, "x", by, least=k).collect())) for k in (1 << 16, 10))
        assert few == many and len(few) == df.count()
    assert S.percentile_limits(df.limit(0), "x", 99).collect() == [(0.0,)]


def test_two_level_scans_equal_windows(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 > 0, F.col("id") * 37 % 101).alias("x"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"), "id")
    df = df.withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    scan = scans.Scan(df, ["g"], [F.col("x").asc_nulls_first(), F.col("id").asc()], Store(spark, "t"))
    got = scan.clean(scan.lasts(scan.sums(k=F.lit(1).cast("bigint"), s=F.col("id")), last=F.col("v"), before=F.col("id")))
    w = Window.partitionBy("g").orderBy(F.col("x").asc_nulls_first(), "id")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", (F.row_number().over(w) - 1).alias("k"), F.coalesce(F.sum("id").over(upto), F.lit(0)).alias("s"), F.last("v", True).over(upto).alias("last"), F.lag("id").over(w).alias("before"))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, (tuple(r) for r in want.collect())))
    assert scan.rows.select("part").distinct().count() > 2


def test_tests_and_splits_of_one_large_group(spark):
    rng = np.random.default_rng(9)
    x = np.round(np.concatenate([rng.normal(0, 1, 700), rng.normal(30, 1, 200)]), 2)
    df = spark.createDataFrame([(float(v), i % 2, "a" if i % 4 else None) for i, v in enumerate(x)] + [(None, 0, "a")], "x double, side int, g string")
    for by in ([], ["g"]):
        near = lambda d: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in d.collect())
        assert near(S.ks_two_sample(df, "x", "side", by)) == near(S.ks_two_sample(df, "x", "side", by, least=5))
        assert near(S.bimodality(df, "x", by)) == near(S.bimodality(df, "x", by, least=5))
    assert S.bimodality(df, "x", least=5).first().bimodal


def test_one_chain_of_all_records(spark):
    n = 400
    base = spark.range(n).select(F.lit("c").alias("chain"), "id", F.format_string("r%d", "id").alias("record_id"), F.sha2(F.col("id").cast("string"), 256).alias("input_hash"), F.lit("m").alias("model_hash"), F.lit("c").alias("config_hash"), F.lit("o").alias("output_hash"), F.when(F.col("id") % 3 == 0, "").otherwise(F.col("id").cast("string")).alias("nonce"), (F.col("id") * 10**9 * 5).alias("timestamp_ns"))
    linked = provenance.link_records(base, "chain", ["id"])
    assert provenance.verify_chain(linked, "chain", ["id"]).collect() == []
    bad = linked.filter("id <> 100").withColumn("nonce", F.when(F.col("id") == 300, "7").otherwise(F.col("nonce"))).withColumn("timestamp_ns", F.when(F.col("id") == 200, 1).otherwise(F.col("timestamp_ns"))).withColumn("prev", F.lit(1))
    got = {(r["index"], r.break_type) for r in provenance.verify_chain(bad, "chain", ["id"]).collect()}
    assert got == {(100, "BROKEN_LINK"), (100, "SEQUENCE_GAP"), (299, "HASH_MISMATCH"), (299, "DUPLICATE_NONCE"), (199, "HASH_MISMATCH"), (199, "TIMESTAMP_REGRESSION")}


def brute_nearest(x, ids, asked, k):
    out = {}
    for q in asked:
        d = ((x - x[q]) ** 2).sum(1)
        order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (d[i], ids[i]))[:k]
        out[ids[q]] = [ids[i] for i in order]
    return out


def test_cell_index_finds_neighbours(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(500, 6)), np.repeat(rng.normal(size=(1, 6)), 300, axis=0), rng.normal(4, 0.2, (100, 6))])
    ids = [f"v{i:04d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)] + [("none", None)], "vec_id string, embedding array<double>")
    index = cells.CellIndex(df, cells=20, block_rows=64)
    asked = list(range(0, 900, 10))
    q = df.filter(F.col("vec_id").isin([ids[i] for i in asked])).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    want = brute_nearest(x, ids, asked, 7)
    got = {}
    for r in index.search(q, k=7, probes=3, exact=True).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == want
    near = {}
    for r in index.search(q, k=7, probes=6).collect():
        near.setdefault(r.id, set()).add(r.neighbour)
    assert np.mean([len(near[i] & set(want[i])) / 7 for i in want]) >= 0.9
    assert index.rows.count() == len(x) and cells.indexed(df.limit(0)).collect() == []


def test_index_recall_and_flips_on_the_tables(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    true = nearest(e, 10).filter("id % 100 = 0").select("id", "neighbour")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    found = cells.CellIndex(e).search(q, k=10).select("id", "neighbour")
    assert found.join(true, ["id", "neighbour"]).count() >= 0.9 * true.count() > 0
    key = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())
    assert key(labels.label_flips(e, neighbours=lambda df, k: cells.indexed(df, k, exact=True))) == key(labels.label_flips(e))


def test_mmd_of_all_rows(spark):
    rng = np.random.default_rng(1)
    for n0, n1 in ((150, 131), (40, 41)):
        a, b = rng.normal(size=(n0, 5)), rng.normal(0.6, 1, (n1, 5))
        x = np.concatenate([a, b])
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        gamma = 1 / np.median(d[np.triu_indices(len(x), 1)])
        k = np.exp(-gamma * d)
        mean = lambda m: m[np.triu_indices(len(m), 1)].mean()
        want = max(0, mean(k[:n0, :n0]) + mean(k[n0:, n0:]) - 2 * k[:n0, n0:].mean()) ** 0.5
        df = spark.createDataFrame([(i, int(i >= n0), v.tolist()) for i, v in enumerate(x)] + [(-1, 0, None), (-2, None, x[0].tolist())], "vec_id long, side int, embedding array<double>")
        got = drift.mmd(df).first()
        assert (got.n0, got.n1, got.error_bound) == (n0, n1, 0) and abs(got.mmd - want) < 1e-9 and abs(got.gamma - gamma) < 1e-9
        small = kernels.mmd_exact(df.filter("side is not null and embedding is not null").select("side", F.col("vec_id").alias("id"), F.col("embedding").alias("v")), tile=32)
        assert abs(small[0] - want) < 1e-9
        near = drift.mmd(df, features=20000).first()
        assert abs(near.mmd**2 - want**2) <= near.error_bound < 0.3 and abs(near.mmd - want) < 0.05
    assert drift.mmd(df.limit(0)).first().mmd == 0


def test_mmd_query_reads_all_rows(spark):
    from probity.plans import queries

    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert tuple(queries.QUERIES["mmd"](spark, SF).first()) == con.sql(queries.ORACLES["mmd"]).fetchall()[0]
