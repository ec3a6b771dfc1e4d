"""Exact duplicates by content sort. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_names, input_splits

#: A text with over one in so many sampled rows is dealt out by a hash of its ids; so there are less than that many such texts.
HEAVY = 200


def _judged(docs: DataFrame, id_col: str, text_col: str, keep: str, partitions: int | None, carry: list[str], judge: list[str]) -> DataFrame:
    """Columns `carry` of docs, and under the names in `judge`: the id that stays, the rows with that text, whether this row stays, the
    text's SHA-256. Without names for the first two, rows that don't stay may be missing."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    n = partitions or max(input_splits(docs), int(spark.conf.get("spark.sql.shuffle.partitions")))
    i, text, head, h, salt, rank, here, rows_here, sha, heavy = free_names([*docs.columns, *judge], "i", "text", "head", "h", "salt", "rank", "here", "rows_here", "sha", "heavy")
    src = docs.select(*carry, F.col(id_col).alias(i), F.coalesce(F.col(text_col), F.lit("")).alias(text))
    src = src.withColumn(head, F.substring(text, 1, 32)).withColumn(h, F.xxhash64(text))
    seen = scratch.keep(src.select(head, h).sample(False, 0.05, 11).groupBy(head, h).agg(F.count(F.lit(1)).alias("n")).filter("n > 4"), "sample")
    least = (seen.agg(F.sum("n")).first()[0] or 0) // HEAVY
    often = F.broadcast(seen.filter(F.col("n") > least).orderBy(F.desc("n")).limit(HEAVY).select(head, h, F.lit(True).alias(heavy)))
    src = src.join(often, [head, h], "left").withColumn(salt, F.when(F.col(heavy), F.pmod(F.xxhash64(i), F.lit(n))).otherwise(-1)).drop(heavy)
    # a heavy text is summed where its rows lie; those sums meet by their whole text
    pick = F.max(F.struct(F.col(i).isNotNull().alias("a"), F.col(i).alias("b"))) if keep == "largest" else F.min(F.struct(F.col(i).isNull().alias("a"), F.col(i).alias("b")))
    met = src.filter(F.col(salt) >= 0).groupBy(text).agg(pick.alias("best"), F.count(F.lit(1)).alias("all"))
    new = free_names([*docs.columns, *judge, i, text, head, h, salt], "met_sha", "met_keep", "all")
    met = scratch.keep(met.select(F.sha2(text, 256).alias(new[0]), F.col("best.b").alias(new[1]), F.col("all").alias(new[2])), "met")
    src = src.repartitionByRange(n, head, h, salt)
    order = F.col(i).desc_nulls_last() if keep == "largest" else F.col(i).asc_nulls_last()
    run = Window.partitionBy(head, h, text, salt)
    first = run.orderBy(order)
    rows = src.select(
        *carry,
        salt,
        F.row_number().over(first).alias(rank),
        F.first(i).over(first).alias(here),
        F.count(F.lit(1)).over(run).alias(rows_here),
        F.sha2(text, 256).alias(sha),
    )
    if len(judge) < 4:
        rows = rows.filter(F.col(rank) == 1)
    out = rows.join(F.broadcast(met), (F.col(sha) == F.col(new[0])) & (F.col(salt) >= 0), "left")
    own = F.col(new[0]).isNull()
    values = [
        F.when(own, F.col(here)).otherwise(F.col(new[1])),
        F.when(own, F.col(rows_here)).otherwise(F.col(new[2])),
        (F.col(rank) == 1) & (own | F.col(here).eqNullSafe(F.col(new[1]))),
        F.col(sha),
    ]
    return out.select(*carry, *(v.alias(c) for v, c in zip(values[-len(judge) :] if len(judge) < 4 else values, judge)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", partitions: int | None = None) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are range-partitioned by their first 32 characters and, among equal ones, by a hash, at splitters that Spark samples (so what
    is sampled is short); each partition is sorted externally by head, hash and whole text, which puts equal texts next to each other,
    and the window compares neighbours in full. A text has one key, so its rows meet in one run. Only a text that a sample shows to
    hold more than one in HEAVY of all rows is dealt over several runs by a hash of the id; such texts are summed where they lie, compared
    whole, and their result is sent to all tasks: at most HEAVY rows. The sample decides where rows lie, never the result. Texts cross the network once.

    Nulls: a null text counts as empty; a null id sorts behind all others and is kept only if its group has no other.
    Empty texts are equal to each other; long ones are rows like others. Repeated ids with one text all count in group_size, and of rows
    that repeat the kept id one (any, the rows being alike) is kept. An empty table gives an empty result. Other columns are not read.
    """
    (name,) = free_names(["keep_id", "group_size", "kept", "text_sha256"], id_col)
    found = _judged(docs.select(F.col(id_col).alias(name), F.col(text_col).alias(free_names([name], text_col)[0])), name, free_names([name], text_col)[0], keep, partitions, [name], ["keep_id", "group_size", "kept", "text_sha256"])
    return found.withColumnRenamed(name, id_col) if name != id_col else found


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that exact_groups keeps, one for each text, with all their columns, whatever their names.

    Nulls, ties, repeated rows and empty tables are as exact_groups says."""
    stays, digest = free_names(docs.columns, "stays", "digest")
    return _judged(docs, id_col, text_col, keep, None, docs.columns, [stays, digest]).filter(stays).select(*docs.columns)
