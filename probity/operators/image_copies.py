"""Near-duplicate images: perceptual hashes propose pairs, structural similarity of the pixels confirms them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from probity.functions.images import tile_similarity
from probity.operators import duplicates
from probity.sources.tables import Store

#: Images, at most, whose neighbours in the order of a hash tell how alike unlinked pairs are.
SAMPLE = 2000


def _similar(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs(a, b, ...) with the similarity of their tiles; a tile is sent to each pair that has it."""
    tile = rows.select("path", "tile")
    j = pairs.join(tile.select(F.col("path").alias("a"), F.col("tile").alias("ta")), "a").join(tile.select(F.col("path").alias("b"), F.col("tile").alias("tb")), "b")
    return j.withColumn("similarity", F.pandas_udf(tile_similarity, T.DoubleType())("ta", "tb")).drop("ta", "tb")


def usual_similarity(rows: DataFrame, most: int = 5, sample: int = SAMPLE, least: float = 0.5) -> float:
    """The 99th percentile of the similarity of unlinked pairs, `least` at least: of up to `sample` images in the order of a hash, each
    with the next, but for pairs whose perceptual hashes are `most` bits or less apart. A bounded sample, the same on every run."""
    few = rows.select("path", "phash", F.xxhash64("path").alias("h")).orderBy("h", "path").limit(sample)
    order = Window.orderBy("h", "path")  # `sample` rows
    pairs = few.select(F.col("path").alias("a"), F.lead("path").over(order).alias("b"), duplicates.hamming(F.col("phash"), F.lead("phash").over(order)).alias("distance"))
    scores = _similar(pairs.filter(F.col("distance") > most), rows)
    return max(least, scores.agg(F.percentile("similarity", F.lit(0.99))).first()[0] or least)


def image_clusters(rows: DataFrame, most: int = 5, cut: float | None = None) -> tuple[DataFrame, DataFrame, float]:
    """(members, pairs, cut) of rows(path, phash, tile): members(id, cluster) of every image, the confirmed pairs(a, b, distance, similarity).

    Pairs at most `most` bits apart are confirmed if their pixels are more alike than `cut`, by default usual_similarity. Equal hashes are confirmed
    against their group's smallest path, so that a group of copies makes one comparison a row, not pairs; what isn't confirmed stands
    for itself. Components are found over confirmed pairs.
    """
    store = Store(rows.sparkSession, "images")
    rows = store.keep(rows.select("path", "phash", "tile"))
    cut = usual_similarity(rows, most) if cut is None else cut
    first = rows.groupBy("phash").agg(F.min("path").alias("a"))
    same = rows.join(first, "phash").filter("path <> a").select("a", F.col("path").alias("b"), F.lit(0).alias("distance"))
    near = duplicates.near_pairs(rows.select(F.col("path").alias("id"), F.col("phash").alias("fp")), most, 64)
    pairs = store.keep(_similar(near.select("a", "b", "distance").unionByName(same), rows).filter(F.col("similarity") > cut))
    roots = duplicates.components(pairs, store.keep)
    members = rows.join(roots, F.col("path") == F.col("node"), "left").select(F.col("path").alias("id"), F.coalesce("root", "path").alias("cluster"))
    return members, pairs, cut


def repeated(members: DataFrame) -> DataFrame:
    """(id): every row of a cluster but the first."""
    first = members.groupBy("cluster").agg(F.min("id").alias("first"))
    return members.join(first, "cluster").filter("id <> first").select("id")
