"""Near-duplicate flooding: fingerprints, banded candidates, confirmation, clusters, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.functions.selection import quantiles
from probity.functions.stats import clamp


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast. Tables here grow with the rows, and neither the compressed size of a written one nor
    the size before an explode tells Spark what they would take of the driver."""
    return df.hint("merge")


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def hash60(c: Column) -> Column:
    """First 60 bits of SHA-256 as a number that any engine can compute."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 15), 16, 10).cast("bigint")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 60) -> DataFrame:
    """(id, fp): majority bits of the hashes of a document's distinct tokens. A document's tokens are in one partition, so its bit
    counts are complete before the shuffle: one row a document moves."""
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), token_set(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    d = d.select("row", "id", F.explode_outer("tokens").alias("token")).select("row", "id", hash60(F.col("token")).alias("h"))
    bit = lambda i: F.sum(F.shiftright("h", i).bitwiseAND(F.lit(1).cast("bigint"))).alias(f"b{i}")
    c = d.groupBy("row", "id").agg(F.count("h").alias("n"), *(bit(i) for i in range(bits)))
    fp = F.lit(0).cast("bigint")
    for i in range(bits):
        fp = fp + F.when(2 * F.col(f"b{i}") > F.col("n"), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return c.select("id", fp.alias("fp"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_pairs(fps: DataFrame, most: int = 5, bits: int = 60) -> DataFrame:
    """(a, b, distance): pairs of different fingerprints' representatives at most `most` bits apart.

    Of most + 2 bands, two fingerprints within `most` bits agree on two whole ones, so an equi-join on pairs of bands finds all, by keys
    of some 17 bits. Equal fingerprints are one row before (the smallest id stands for them), so a large group of copies makes no pairs.
    """
    rep = fps.groupBy("fp").agg(F.min("id").alias("id"))
    cuts = [bits * k // (most + 2) for k in range(most + 3)]
    band = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    both = [(i, j) for j in range(most + 2) for i in range(j)]
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.shiftleft(band[i], 31).bitwiseOR(band[j]).alias("key")) for k, (i, j) in enumerate(both)])
    keyed = rep.select("id", "fp", F.explode(bands).alias("b")).select("id", "fp", "b.band", "b.key")
    x, y = keyed.alias("x"), keyed.alias("y")
    j = x.join(shuffled(y), (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")))
    j = j.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), hamming(F.col("x.fp"), F.col("y.fp")).alias("distance"))
    return j.filter(F.col("distance") <= most).distinct()


def jaccard(docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pairs with the token Jaccard of their texts."""
    t = docs.select(F.col(id_col).alias("id"), token_set(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    j = pairs.join(shuffled(t.select(F.col("id").alias("a"), F.col("t").alias("ta"))), "a").join(shuffled(t.select(F.col("id").alias("b"), F.col("t").alias("tb"))), "b")
    both = F.size(F.array_intersect("ta", "tb"))
    return j.withColumn("jaccard", F.when(F.size(F.array_union("ta", "tb")) == 0, 1.0).otherwise(both / F.size(F.array_union("ta", "tb")))).drop("ta", "tb")


def components(pairs: DataFrame, checkpoint=None, rounds: int = 50) -> DataFrame:
    """(node, root): smallest node reachable over pairs(a, b), by repeated minimum of neighbours' roots with pointer jumping."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    cur = both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    for _ in range(rounds):
        near = both.join(shuffled(cur.withColumnRenamed("node", "b")), "b").groupBy("a").agg(F.min("root").alias("m"))
        low = cur.join(shuffled(near), F.col("node") == F.col("a"), "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root"))
        jump = low.select(F.col("node").alias("root"), F.col("root").alias("up"))
        cur = low.join(shuffled(jump), "root", "left").select("node", F.coalesce("up", "root").alias("root"), "old")
        cur = checkpoint(cur) if checkpoint else cur.checkpoint()
        settled = cur.filter("root <> old").isEmpty()
        cur = cur.drop("old")
        if settled:
            return cur
    raise RuntimeError("components did not settle")


def clusters(fps: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, cluster): the cluster of every row; rows with one fingerprint share one."""
    rep = fps.groupBy("fp").agg(F.min("id").alias("rep"))
    return fps.join(shuffled(rep), "fp").join(shuffled(roots), F.col("rep") == F.col("node"), "left").select("id", F.coalesce("root", "rep").alias("cluster"))


def flood_clusters(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Clusters of two rows and more: size, exact, the flood threshold max(4, ceil(median + 3 max(1.4826 MAD, 1))), confidence."""
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    far = pairs.join(shuffled(members.select(F.col("id").alias("a"), "cluster")), "a").groupBy("cluster").agg(F.max("distance").alias("most"))
    s = size.join(shuffled(far), "cluster", "left").select("cluster", "size", (F.coalesce("most", F.lit(0)) == 0).alias("exact"))
    med = quantiles(s, "size", (), {"med": 0.5})
    mad = quantiles(s.crossJoin(F.broadcast(med)), F.abs(F.col("size") - F.col("med")), (), {"mad": 0.5}).crossJoin(med)  # one row
    s = s.crossJoin(F.broadcast(mad)).withColumn("threshold", F.greatest(F.lit(4), F.ceil(F.col("med") + 3 * F.greatest(1.4826 * F.col("mad"), F.lit(1.0)))).cast("bigint"))
    flood = F.col("size") >= F.col("threshold")
    c = clamp(0.55 + 0.06 * (F.col("size") - F.col("threshold")), 0.0, 0.95)
    c = F.when(flood & F.col("exact"), F.least(c + 0.08, F.lit(0.97))).when(flood, c).when(F.col("exact"), F.lit(0.30))
    return s.select("cluster", "size", "exact", "threshold", flood.alias("flood"), c.alias("confidence"))


def contributor_shares(members: DataFrame, docs: DataFrame, id_col: str = "doc_id", contributor: str = "source", least_rows: int = 20, least_share: float = 0.20) -> DataFrame:
    """Share of a contributor's rows that repeat an earlier row of their cluster (all but the smallest id of a cluster)."""
    first = members.groupBy("cluster").agg(F.min("id").alias("first"))
    again = members.join(shuffled(first), "cluster").filter("id > first").select(F.col("id").alias("__id"))
    d = docs.select(F.col(id_col).alias("__d"), F.coalesce(F.col(contributor), F.lit("UNKNOWN")).alias("contributor"))
    d = d.join(shuffled(again.distinct()), F.col("__d") == F.col("__id"), "left")
    s = d.groupBy("contributor").agg(F.count(F.lit(1)).alias("total"), F.count("__id").alias("redundant")).withColumn("share", F.col("redundant") / F.col("total"))
    s = s.filter((F.col("total") >= least_rows) & (F.upper("contributor") != "UNKNOWN"))
    return s.withColumn("confidence", F.when(F.col("share") >= least_share, clamp(0.45 + F.col("share") - 0.20, 0.0, 0.90)))


__all__ = ["clusters", "components", "contributor_shares", "fingerprints", "flood_clusters", "hamming", "jaccard", "near_pairs", "token_set"]
