"""Out-of-distribution rows, spectral signatures, isolation forest, activation clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.functions.stats import energy_score, modified_zscore, percentile_limits
from probity.functions.vectors import centroids, squared_distance

#: Rows of a class, at most, that its silhouette is computed from.
SILHOUETTE_ROWS = 2000


def _stack(v: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in v]) if len(v) else np.empty((0, 0))


def class_moments(df: DataFrame, label: str = "label", vector: str = "embedding", chunk: int = 4096) -> DataFrame:
    """(label, n, sums, cross): counts, sums and cross products of each class, added up per Arrow batch before the shuffle, so a
    class of any size comes down to one row a task."""

    def part(batches):
        for pdf in batches:
            for key, g in pdf.groupby("label"):
                x = _stack(g["v"])
                yield pd.DataFrame({"label": [key], "n": [len(x)], "dim": [x.shape[1]], "s": [x.sum(0).tolist()], "c": [(x.T @ x).ravel().tolist()]})

    src = df.filter(F.col(vector).isNotNull()).select(F.col(label).alias("label"), F.col(vector).alias("v"))
    kind = src.schema["label"].dataType.simpleString()
    parts = src.mapInPandas(part, f"label {kind}, n bigint, dim int, s array<double>, c array<double>")
    add = lambda name, by: parts.select("label", F.posexplode(name).alias("p", "x")).groupBy("label", "p").agg(F.sum("x").alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias(by)).select("label", F.col(f"{by}.x").alias(by))
    return parts.groupBy("label").agg(F.sum("n").alias("n")).join(add("s", "sums"), "label").join(add("c", "cross"), "label")


def mahalanobis(df: DataFrame, min_class: int = 8, shrink: float = 0.1, id_col: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(id, label, distance, scope) of the rows with a vector: distance to the class under its shrunk sample covariance, or to all rows for small classes."""
    whole = class_moments(df.withColumn("__all", F.lit(0)), "__all", vector).select("n", "sums", "cross").toPandas().iloc[:1]
    per = {}

    def solve(n: int, sums: list, cross: list) -> tuple[np.ndarray, np.ndarray | None]:
        s = np.asarray(sums)
        mean, d = s / n, len(s)
        if n < 2:
            return mean, None
        cov = (np.asarray(cross).reshape(d, d) - n * np.outer(mean, mean)) / (n - 1)
        cov = (1 - shrink) * cov + shrink * np.trace(cov) / d * np.eye(d) + 1e-6 * np.eye(d)
        try:
            return mean, np.linalg.inv(cov)
        except np.linalg.LinAlgError:
            return mean, np.linalg.pinv(cov)

    for r in class_moments(df, label, vector).filter(F.col("n") >= min_class).toLocalIterator():  # one row a class
        per[r["label"]] = solve(r["n"], r["sums"], r["cross"])
    base = solve(int(whole["n"].iloc[0]), whole["sums"].iloc[0], whole["cross"].iloc[0]) if len(whole) else None

    def score(batches):
        for pdf in batches:
            x = _stack(pdf["v"])
            out, scope = np.zeros(len(pdf)), np.array(["global"] * len(pdf), object)
            for key in pdf["label"].unique():
                at = np.flatnonzero((pdf["label"] == key).to_numpy())
                mean, inv = per.get(key, base)
                diff = x[at] - mean
                out[at] = np.sqrt(np.maximum((diff @ inv * diff).sum(1), 0)) if inv is not None else np.linalg.norm(diff, axis=1)
                scope[at] = "class" if key in per else "global"
            yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "distance": out, "scope": scope})

    src = df.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    return src.mapInPandas(score, f"id {src.schema['id'].dataType.simpleString()}, label {src.schema['label'].dataType.simpleString()}, distance double, scope string")


def mahalanobis_ood(df: DataFrame, percentile: float = 99.0, **names) -> DataFrame:
    """mahalanobis with a robust z over all rows; flagged strictly above its class's percentile (class scope only)."""
    d = modified_zscore(mahalanobis(df, **names), "distance", out="z")
    limit = percentile_limits(d.filter("scope = 'class'"), "distance", percentile, ["label"])
    return d.join(limit, "label", "left").select("id", "label", "distance", "z", F.coalesce((F.col("scope") == "class") & (F.col("distance") > F.col("limit")), F.lit(False)).alias("flagged"))


def energy_ood(df: DataFrame, logits: str = "logits", threshold: float = 2.5, id_col: str = "id") -> DataFrame:
    d = modified_zscore(df.select(F.col(id_col).alias("id"), energy_score(F.col(logits)).alias("energy")), "energy", out="z")
    return d.withColumn("flagged", F.col("z") >= threshold)


def fuse_ood(maha: DataFrame, energy: DataFrame) -> DataFrame:
    """Rows flagged by both detectors, or strongly by one: (id, confidence, detectors)."""
    j = maha.filter("flagged").select("id", F.col("z").alias("mz")).join(energy.filter("flagged").select("id", F.col("z").alias("ez")), "id", "full")
    both = F.col("mz").isNotNull() & F.col("ez").isNotNull()
    c = F.when(both, F.least(F.lit(0.95), 0.55 + 0.08 * F.greatest(F.col("mz") - 2, F.lit(0.0)))).when(F.col("mz") >= 5, F.least(F.lit(0.80), 0.35 + 0.06 * (F.col("mz") - 5))).when(F.col("mz").isNull() & (F.col("ez") >= 4), F.least(F.lit(0.72), 0.32 + 0.06 * (F.col("ez") - 4)))
    return j.select("id", c.alias("confidence"), F.when(both, "both").when(F.col("mz").isNotNull(), "mahalanobis").otherwise("energy").alias("detectors")).filter("confidence is not null")


def spectral_signatures(df: DataFrame, min_class: int = 12, threshold: float = 2.0, share: float = 0.15, id_col: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(id, label, score, z, explained, flagged) of the rows with a vector: |projection| on the top right singular vector of each centred class.

    The singular vector is the top eigenvector of the class's scatter matrix, which comes from summed moments; no class is
    gathered in one place. At most ceil(n * share * 1.5) rows a class are flagged, the highest z first.
    """
    axes = {}
    for r in class_moments(df, label, vector).filter(F.col("n") >= min_class).toLocalIterator():  # one row a class
        n, mean = r["n"], np.asarray(r["sums"]) / r["n"]
        scatter = np.asarray(r["cross"]).reshape(len(mean), -1) - n * np.outer(mean, mean)
        value, vec = np.linalg.eigh(scatter)
        axes[r["label"]] = (mean, vec[:, -1], float(max(value[-1], 0) / max(value.clip(0).sum(), 1e-12)))

    def score(batches):
        for pdf in batches:
            x = _stack(pdf["v"])
            keep = pdf["label"].isin(list(axes)).to_numpy()
            s, explained = np.zeros(len(pdf)), np.zeros(len(pdf))
            for y in pdf["label"][keep].unique():
                at = np.flatnonzero((pdf["label"] == y).to_numpy())
                s[at], explained[at] = np.abs((x[at] - axes[y][0]) @ axes[y][1]), axes[y][2]
            yield pd.DataFrame({"id": pdf["id"][keep], "label": pdf["label"][keep], "score": s[keep], "explained": explained[keep]})

    src = df.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    d = src.mapInPandas(score, f"id {src.schema['id'].dataType.simpleString()}, label {src.schema['label'].dataType.simpleString()}, score double, explained double")
    d = modified_zscore(d, "score", ["label"], out="z")
    n = d.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    top = d.filter(F.col("z") >= threshold).join(n, "label").withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.col("z").desc(), "id"))).filter(F.col("rank") <= F.ceil(F.col("n") * share * 1.5))
    return d.join(top.select("id", F.lit(True).alias("flagged")), "id", "left").fillna(False, ["flagged"])


def isolation_forest(df: DataFrame, trees: int = 100, sample: int = 256, contamination: float = 0.05, seed: int = 7, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, score, flagged): trees are grown on samples of `sample` rows in hash order; all rows are scored by Arrow batches."""
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(vector).alias("v"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("h")).orderBy("h").limit(sample * 16).toPandas()  # the bounded sample
    pool, rng = _stack(rows["v"]), np.random.default_rng(seed)
    size = min(sample, len(pool))
    limit = int(np.ceil(np.log2(max(size, 2))))
    norm = lambda n: 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(x: np.ndarray, depth: int):
        if depth >= limit or len(x) < 2:
            return depth + norm(len(x))
        f = int(rng.integers(x.shape[1]))
        lo, hi = x[:, f].min(), x[:, f].max()
        if lo == hi:
            return depth + norm(len(x))
        cut = rng.uniform(lo, hi)
        return f, cut, grow(x[x[:, f] < cut], depth + 1), grow(x[x[:, f] >= cut], depth + 1)

    forest = [grow(pool[rng.choice(len(pool), size, replace=False)], 0) for _ in range(trees)] if size else []

    def path(tree, x: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
        if not isinstance(tree, tuple):
            out[at] += tree
            return
        f, cut, low, high = tree
        left = x[at, f] < cut
        path(low, x, at[left], out)
        path(high, x, at[~left], out)

    def score(batches):
        for pdf in batches:
            x, total = _stack(pdf["v"]), np.zeros(len(pdf))
            for t in forest:
                path(t, x, np.arange(len(pdf)), total)
            yield pd.DataFrame({"id": pdf["id"], "score": 2 ** (-total / max(trees, 1) / max(norm(size), 1e-9))})

    src = df.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    d = src.mapInPandas(score, f"id {src.schema['id'].dataType.simpleString()}, score double")
    limit_row = percentile_limits(d, "score", 100 * (1 - contamination))
    return d.crossJoin(F.broadcast(limit_row)).select("id", "score", (F.col("score") > F.col("limit")).alias("flagged"))  # one row


def activation_clusters(df: DataFrame, min_class: int = 10, components: int = 10, limit: float = 0.70, id_col: str = "vec_id", label: str = "label", vector: str = "embedding", silhouette_rows: int | None = SILHOUETTE_ROWS) -> DataFrame:
    """Per class: two-means on its PCA scores; (label, n, imbalance, silhouette, confidence, flagged).

    Axes come from summed moments and each two-means step is one pass with sums a batch, so all rows of a class of any size count in
    n and imbalance. The silhouette, which is quadratic, is the mean over silhouette_rows rows a class in the order of a hash of
    their ids, against each other; with None it is exact, over all pairs of a class's rows, in tiles of a bounded size.
    """
    from probity.sources.tables import Store

    store = Store(df.sparkSession, "clusters")
    src = df.filter(F.col(vector).isNotNull()).select(F.col(label).alias("label"), F.col(vector).alias("v"), F.xxhash64(F.col(id_col)).alias("h"))
    kind = src.schema["label"].dataType.simpleString()
    axes, rows = {}, []
    for r in class_moments(df, label, vector).toLocalIterator():  # one row a class
        n, mean = r["n"], np.asarray(r["sums"]) / r["n"]
        rows.append((r["label"], n))
        if n >= min_class:
            vec = np.linalg.eigh(np.asarray(r["cross"]).reshape(len(mean), -1) - n * np.outer(mean, mean))[1]
            axes[r["label"]] = (mean, vec[:, ::-1][:, : min(components, n - 1)])

    def by_class(pdf: pd.DataFrame, known: dict):
        for key in pdf["label"].unique():
            if key in known:
                yield key, pdf[pdf["label"] == key]

    def project(batches):
        for pdf in batches:
            for key, g in by_class(pdf, axes):
                y = (_stack(g["v"]) - axes[key][0]) @ axes[key][1]
                yield pd.DataFrame({"label": g["label"], "h": g["h"], "y": list(y)})

    scores = store.keep(src.mapInPandas(project, f"label {kind}, h bigint, y array<double>"))
    order = F.struct(F.col("y")[0].alias("a"), "h")
    ends = scores.groupBy("label").agg(F.min_by("y", order).alias("low"), F.max_by("y", order).alias("high")).collect()  # one row a class
    centre = {r["label"]: np.array([r["low"], r["high"]]) for r in ends}
    nearest = lambda y, c: ((y[:, None] - c[None]) ** 2).sum(2).argmin(1)
    share, moving = {}, set(centre)
    for _ in range(100):
        if not moving:
            break

        def sums(batches, centre=dict(centre)):
            for pdf in batches:
                for key, g in by_class(pdf, centre):
                    y = _stack(g["y"])
                    side = nearest(y, centre[key])
                    for s in (0, 1):
                        yield pd.DataFrame({"label": [key], "side": [s], "n": [int((side == s).sum())], "s": [y[side == s].sum(0).tolist()]})

        part = scores.mapInPandas(sums, f"label {kind}, side int, n bigint, s array<double>")
        total = part.select("label", "side", "n", F.posexplode("s").alias("p", "x")).groupBy("label", "side", "p").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toPandas()  # two short vectors a class
        for key, g in total.groupby("label"):
            new = centre[key].copy()
            for s, x in g.sort_values("p").groupby("side"):
                if x["n"].iloc[0]:
                    new[s] = x["x"].to_numpy() / x["n"].iloc[0]
            n = g[g["p"] == 0].set_index("side")["n"]
            share[key] = float(n.max() / n.sum())
            if np.allclose(new, centre[key]):
                moving.discard(key)
            centre[key] = new
    size = dict(rows)
    few = [(k, min(1.0, 1.2 * (silhouette_rows or 0) / size[k])) for k in centre]

    def sampled(batches):
        keep = dict(few)
        for pdf in batches:
            u = pdf["h"].to_numpy().view(np.uint64) / 2.0**64
            yield pdf[u < pdf["label"].map(keep).to_numpy()]

    picked = scores.mapInPandas(sampled, f"label {kind}, h bigint, y array<double>")

    def silhouette(key, pdf: pd.DataFrame) -> pd.DataFrame:
        y = _stack(pdf.sort_values("h")["y"])[:silhouette_rows]
        side, d = nearest(y, centre[key[0]]), np.sqrt(np.maximum(((y[:, None] - y[None]) ** 2).sum(2), 0)) if len(y) <= 500 else np.stack([np.sqrt(((y - x) ** 2).sum(1)) for x in y])
        mine, n = np.stack([side == 0, side == 1]).astype(float), np.array([(side == 0).sum(), (side == 1).sum()])
        if n.min() == 0:
            return pd.DataFrame({"label": [key[0]], "silhouette": [0.0]})
        to = d @ mine.T
        own, other = to[np.arange(len(y)), side], to[np.arange(len(y)), 1 - side]
        a, b = own / np.maximum(n[side] - 1, 1), other / n[1 - side]
        return pd.DataFrame({"label": [key[0]], "silhouette": [float(np.where(n[side] < 2, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-12)).mean())]})

    if silhouette_rows is None:
        sil = exact_silhouettes(store, scores, kind, centre, size)
    else:
        sil = picked.groupBy("label").applyInPandas(silhouette, f"label {kind}, silhouette double")
    table = df.sparkSession.createDataFrame([(k, n, share.get(k, float("nan"))) for k, n in rows], f"label {kind}, n bigint, imbalance double")
    out = table.join(sil, "label", "left").withColumn("silhouette", F.coalesce("silhouette", F.lit(float("nan"))))
    flagged = F.coalesce(~F.isnan("imbalance") & (F.col("imbalance") >= limit), F.lit(False))
    c = F.greatest(F.lit(0.0), F.least(F.lit(0.90), 0.35 + 0.9 * (F.col("imbalance") - limit) + 0.3 * F.greatest("silhouette", F.lit(0.0))))
    return out.withColumn("flagged", flagged).withColumn("confidence", F.when(F.col("flagged"), c))


def exact_silhouettes(store, scores: DataFrame, kind: str, centre: dict, size: dict, tile: int = 1024) -> DataFrame:
    """(label, silhouette) of scores(label, h, y): the mean over all rows of a class, by pairs of packed blocks. A task holds two blocks; each gives
    a row's sums of distances to either side, which are added."""
    blocks = scores.sparkSession.createDataFrame([(k, -(-n // tile)) for k, n in size.items() if k in centre], f"label {kind}, blocks bigint")
    rows = scores.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(blocks), "label")  # a row a class
    packed = rows.groupBy("label", "blocks", F.pmod(F.xxhash64("row"), F.col("blocks")).alias("blk")).agg(F.collect_list("row").alias("row"), F.collect_list("y").alias("y"))
    packed = store.keep(packed)
    left = packed.select("label", "row", "y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("blk"))
    both = left.join(packed.select("label", "blk", F.col("y").alias("z")), ["label", "blk"])

    def work(batches):
        for pdf in batches:
            for key, row, y, z in zip(pdf["label"], pdf["row"], pdf["y"], pdf["z"]):
                y, z = np.stack(y), np.stack(z)
                d = np.sqrt(np.maximum((y * y).sum(1)[:, None] + (z * z).sum(1)[None, :] - 2 * y @ z.T, 0))
                one = lambda x: ((x[:, None] - centre[key][None]) ** 2).sum(2).argmin(1)  # noqa: B023, E731
                far = one(z)
                yield pd.DataFrame({"label": key, "row": row, "side": one(y), "s0": d[:, far == 0].sum(1), "s1": d[:, far == 1].sum(1)})

    sums = both.select("label", "row", "y", "z").mapInPandas(work, f"label {kind}, row bigint, side int, s0 double, s1 double").groupBy("label", "row", "side").agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))
    sums = store.keep(sums)
    n = sums.groupBy("label").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    d = sums.join(F.broadcast(n), "label")  # a row a class
    first = F.col("side") == 0
    own, other = F.when(first, F.col("s0")).otherwise(F.col("s1")), F.when(first, F.col("s1")).otherwise(F.col("s0"))
    mine, theirs = F.when(first, F.col("n0")).otherwise(F.col("n1")), F.when(first, F.col("n1")).otherwise(F.col("n0"))
    a, b = own / F.greatest(mine - 1, F.lit(1)), F.try_divide(other, theirs)
    s = F.when((mine < 2) | (theirs == 0), 0.0).otherwise((b - a) / F.greatest(a, b, F.lit(1e-12)))
    return d.groupBy("label").agg(F.avg(s).alias("silhouette"))


def centroid_logits(df: DataFrame, id_col: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(id, label, logits): negative distances to the class centroids, in label order; stands in for a model's outputs."""
    d = df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    table = centroids(d, "label", "v").agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("c"))  # one row
    return d.crossJoin(F.broadcast(table)).select("id", "label", F.transform("c", lambda x: -F.sqrt(squared_distance(F.col("v"), x["centroid"]))).alias("logits"))
