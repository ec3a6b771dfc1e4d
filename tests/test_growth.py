"""What grows with the rows stays out of the driver, out of one task, and in proportion to the input."""

import numpy as np
import pytest

from probity.functions.selection import quantiles as QUANTILES
from probity.operators import drift, duplicates, kernels, provenance
from probity.operators.generators import precision_recall
from probity.operators.neighbours import BYTES, block_count, nearest
from probity.sources.tables import Store

SF = "/root/testdata/sf0.001"


def joins(df):
    """Kinds of joins in the plan; a small table's plan has broadcasts where nothing rules them out."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {k for k in ("BroadcastHashJoin", "BroadcastNestedLoopJoin", "SortMergeJoin") if k in plan}


@pytest.fixture(scope="module")
def flood(spark):
    store, docs = Store(spark, "growth"), spark.read.parquet(f"{SF}/documents.parquet")
    fps = store.keep(duplicates.fingerprints(docs))
    pairs = store.keep(duplicates.near_pairs(fps))
    kept = []
    roots = duplicates.components(pairs, lambda df: kept.append(df) or store.keep(df))
    return docs, fps, pairs, kept, roots


def test_pairs_components_and_clusters_are_not_broadcast(flood):
    _, fps, pairs, kept, roots = flood
    for df in (duplicates.near_pairs(fps), *kept, duplicates.clusters(fps, roots)):
        assert joins(df) == {"SortMergeJoin"}


def test_contributor_shares_are_not_broadcast(flood):
    docs, fps, _, _, roots = flood
    assert joins(duplicates.contributor_shares(duplicates.clusters(fps, roots), docs)) == {"SortMergeJoin"}


def test_flood_thresholds_join_members_by_shuffling(flood, monkeypatch):
    _, fps, pairs, _, roots = flood
    seen = []
    monkeypatch.setattr(duplicates, "quantiles", lambda d, *a: seen.append(d) or QUANTILES(d, *a))
    duplicates.flood_clusters(duplicates.clusters(fps, roots), pairs)
    assert joins(seen[0]) == {"SortMergeJoin"}  # the next one adds medians, which are one row


def test_similarities_join_texts_by_shuffling(flood):
    docs, _, pairs, _, _ = flood
    assert joins(duplicates.jaccard(docs, pairs)) == {"SortMergeJoin"}


def test_scores_join_keys_by_shuffling(spark):
    keys = Store(spark, "growth").keep(spark.range(9))
    assert joins(precision_recall(keys, keys, 9, baseline=keys)) == {"SortMergeJoin"}


def test_blocks_of_pairs_do_not_grow_with_the_rows():
    assert [block_count(n, 64, 2048) for n in (1, 2048, 10_000, 100_000, 600_000)] == [1, 1, 5, 16, 16]
    assert block_count(600_000, 768, 2048) * BYTES >= 600_000 * 768 * 8  # but no block is over BYTES


@pytest.mark.parametrize("n", [1, 5, 700])
def test_discrepancy_and_neighbours_over_many_blocks(spark, n):
    rng = np.random.default_rng(n)
    x = np.repeat(rng.normal(size=(-(-n // 2), 5)).round(1), 2, axis=0)[:n]
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id long, side int, v array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    up = d[np.triu_indices(n, 1)]
    gamma = 1 / np.median(up) if n > 1 else 1.0
    kernel, side = np.exp(-gamma * d), np.arange(n) % 2
    mean = lambda a, b: kernel[np.triu(np.ones((n, n), bool), 1) & (np.sort([side[:, None] + 0 * side, side + 0 * side[:, None]], axis=0) == np.array([a, b])[:, None, None]).all(0)]
    part = [m.mean() if len(m := mean(a, b)) else 0.0 for a, b in ((0, 0), (1, 1), (0, 1))]
    got = kernels.mmd_exact(df, tile=32)
    assert got[0] == pytest.approx(max(0.0, part[0] + part[1] - 2 * part[2]) ** 0.5, abs=1e-6) and got[1] == pytest.approx(gamma)
    np.fill_diagonal(d, np.inf)
    near = nearest(df, 3, "id", "v", block_rows=32).collect()
    assert len(near) == n * min(3, n - 1)
    assert all(r.distance2 == pytest.approx(np.sort(d[r.id])[r["rank"] - 1], abs=1e-9) for r in near)


@pytest.mark.parametrize("least", [0, 1 << 16])
def test_breaks_by_one_window_or_two_levels(spark, least):
    """What verify_chain moves is narrower than the records, and odd hashes, nonces and nulls come back as they were."""
    genesis, names = "0" * 64, "chain string, at long, record_id string, input_hash string, model_hash string, config_hash string, output_hash string, nonce string, timestamp_ns long, sequence_number long, prev_record_hash string, record_hash string"
    rows = [
        ("a", 1, "r1", "i", "m", "c", "o", "AB", None, 0, genesis, "ab"), ("a", 2, "r2", "i", "m", "c", "o", "ab", None, 1, "ab", "AB"), ("a", 3, "r3", "i", "m", "c", "o", "AB", None, None, "ab", "\u00e9"),
        (None, 1, "s1", "i", "m", "c", "o", "", None, 5, "x", "0a0"), (None, 2, "s2", "i", "m", "c", "o", "", None, 5, "0a0", None), (None, 3, None, "i", "m", "c", "o", None, None, 7, None, "y"),
    ]
    got = {(r.chain, r["index"], r.break_type, r.found) for r in provenance.verify_chain(spark.createDataFrame(rows, names), "chain", ["at"], least=least).collect()}
    alone = {(c, i, "HASH_MISMATCH", h) for c, i, h in (("a", 0, "ab"), ("a", 1, "AB"), ("a", 2, "\u00e9"), (None, 0, "0a0"), (None, 2, "y"))}
    assert got == alone | {("a", 2, "BROKEN_LINK", "ab"), ("a", 2, "DUPLICATE_NONCE", "AB"), (None, 0, "MISSING_GENESIS", "x"), (None, 1, "DUPLICATE_SEQUENCE", "5"), (None, 1, "SEQUENCE_REGRESSION", "5"), (None, 2, "BROKEN_LINK", ""), (None, 2, "SEQUENCE_GAP", "7")}


def test_a_linked_record_moves_once(spark):
    linked = provenance.link_records(spark.range(4).selectExpr("id % 2 as chain", "id", *(f"'{c}' as {c}" for c in ("record_id", "input_hash", "model_hash", "config_hash", "output_hash", "nonce")), "0L as timestamp_ns"), "chain", ["id"])
    plan = linked._jdf.queryExecution().optimizedPlan().toString()
    assert "__row" not in plan and linked.columns[:3] == ["chain", "id", "record_id"]


def test_breaks_are_told_apart_before_they_are_cast(spark):
    """No literal of a kind that is filtered out is judged while planning."""
    rows = spark.range(4).selectExpr("0 as chain", "id", "id * 2 as sequence_number", *(f"'{c}' as {c}" for c in ("record_id", "input_hash", "model_hash", "config_hash", "output_hash", "nonce", "prev_record_hash", "record_hash")), "0L as timestamp_ns")
    gaps = provenance.verify_chain(rows, "chain", ["id"]).filter("break_type = 'SEQUENCE_GAP'").selectExpr("cast(expected as bigint) as e").collect()
    assert sorted(r.e for r in gaps) == [1, 3, 5]


def test_quantiles_of_large_groups_are_a_written_table(spark):
    rows = Store(spark, "growth").keep(spark.range(5000).selectExpr("id % 3 as g", "cast(id as double) as x"))
    found = QUANTILES(rows, "x", ["g"], {"m": 0.5}, 10, True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan  # so what joins it knows its size
    assert sorted(map(tuple, found.collect())) == [(0, 2499.0), (1, 2500.0), (2, 2499.5)]


def discrepancy(x, side):
    """(mmd, gamma) by numpy."""
    d = np.stack([((x - v) ** 2).sum(1) for v in x])
    up = np.triu_indices(len(x), 1)
    gamma = 1 / np.median(d[up])
    k, kind = np.exp(-gamma * d[up]), (side[:, None] + side[None])[up]
    return max(0.0, k[kind == 0].mean() + k[kind == 2].mean() - 2 * k[kind == 1].mean()) ** 0.5, gamma


def sided(spark, x, side):
    return spark.createDataFrame([(i, int(s), v.tolist()) for i, (s, v) in enumerate(zip(side, x))], "id long, side int, v array<double>")


def test_discrepancy_meets_each_pair_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, side = np.concatenate([rng.normal(size=(700, 200)), rng.normal(0.4, 1, (500, 200))]), np.repeat([0, 1], [700, 500])
    passes, pairs = [], kernels.Tiles.pairs
    monkeypatch.setattr(kernels, "SAMPLE", 60)
    monkeypatch.setattr(kernels, "FINISH", 100)
    monkeypatch.setattr(kernels.Tiles, "pairs", lambda self, *a: passes.append(1) or pairs(self, *a))
    got = kernels.mmd_exact(sided(spark, x, side), tile=512)
    assert got[:2] == pytest.approx(discrepancy(x, side), abs=1e-9) and len(passes) == 1


@pytest.mark.parametrize("kind", ["one-hot", "gap", "crowded"])
def test_discrepancy_where_the_bracket_does_not_serve(spark, monkeypatch, kind):
    rng = np.random.default_rng(9)
    n, side = 301, np.arange(301) % 2
    if kind == "one-hot":
        x = np.eye(4)[rng.integers(0, 4, n)]
    elif kind == "gap":  # half of the pairs are within a place, half between, so the median is far from any of the sample
        x = rng.normal(size=(n, 3)) * 0.01 + np.where(rng.random(n) < 0.5, 0, 5)[:, None]
    else:
        x = rng.normal(size=(n, 3))
        monkeypatch.setattr(kernels, "LISTED", 8)
    monkeypatch.setattr(kernels, "SAMPLE", 40)
    got = kernels.mmd_exact(sided(spark, x, side), tile=32)
    assert got[:2] == pytest.approx(discrepancy(x, side), abs=1e-9)


def test_values_are_selected_by_rank(spark, monkeypatch):
    monkeypatch.setattr(kernels, "FINISH", 4)
    v = np.repeat([0.0, 1e-300, 2.0, 2.0000000000000004, 3.0, 7.0, 7.5, 1e9], [1, 2, 3, 4, 5, 1, 1, 1])
    df = spark.createDataFrame([(float(x), 1) for x in v], "value double, n long")
    for r in range(len(v)):
        assert kernels._at(df, [r]) == [v[r]]
    assert kernels._at(df, [5, 6]) == [2.0, 2.0000000000000004] and kernels._at(df, [16, 17]) == [7.5, 1e9]
    assert kernels._at(df, [-1]) is None and kernels._at(df, [len(v)]) is None and kernels._at(df.limit(0), [0]) is None


def test_drift_selects_medians_of_flat_properties_only(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(drift, "quantiles", lambda d, *a: seen.append({r.property for r in d.select("property").distinct().collect()}) or QUANTILES(d, *a))
    rows = [(i % 2, float(i), 2.0 + (i % 2), None if i % 2 else float("inf")) for i in range(40)]
    df = spark.createDataFrame(rows, "side int, moving double, still double, odd double")
    got = drift.property_drift(df, ["moving", "still", "odd"])
    assert {r.property: (r.baseline_mean, r.current_mean, r.zscore) for r in got.collect()} == {"moving": (19.0, 20.0, 1 / np.std(np.arange(0, 40, 2))), "still": (2.0, 3.0, 0.0)}
    assert seen == [{"still"}] * 2
    seen.clear()
    drift.property_drift(df, ["moving"])
    assert not seen and "Join" not in got._jdf.queryExecution().executedPlan().toString()
