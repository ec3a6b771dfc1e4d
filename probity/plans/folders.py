"""A data scan of a folder of images and labels, end to end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.functions.images import embed_pixels, image_rows
from probity.operators import duplicates, image_copies
from probity.operators import findings as fnd
from probity.plans.scan import Assessment, Thresholds, _finding, scan_data
from probity.sources.datasets import decode_images, load_dataset
from probity.sources.tables import Store


def _plain(c: str):
    """A path without its scheme, by which sources that spell schemes differently meet."""
    return F.regexp_replace(c, r"^[a-z0-9]+:/+", "/")


def folder_tables(spark: SparkSession, root: str, embed: Callable = embed_pixels) -> tuple[DataFrame, DataFrame, list[str]]:
    """(samples, images, notes): labelled samples and measured images of a folder, both by path; notes tell what was left out.

    COCO samples, which name files below the document's folder, meet their images by the end of the path."""
    samples, fmt, notes = load_dataset(spark, root)
    store = Store(spark, "folder")
    images = store.keep(image_rows(decode_images(spark, root), embed).withColumn("path", _plain("path")))
    samples = samples.select(_plain("path").alias("path"), "primary_label", F.coalesce("contributor", F.lit("root")).alias("contributor"))
    if fmt == "coco":
        name = F.element_at(F.split("path", "/"), -1)
        full = images.select(F.col("path").alias("full"), name.alias("name"))
        j = samples.withColumn("name", name).join(full, "name", "left").filter(F.col("full").isNull() | F.col("full").endswith(F.col("path")))
        samples = j.groupBy("path").agg(F.min("full").alias("full"), F.first("primary_label").alias("primary_label"), F.first("contributor").alias("contributor"))
        samples = samples.select(F.coalesce("full", "path").alias("path"), "primary_label", "contributor")
    samples = store.keep(samples)
    lost = samples.join(images.select("path"), "path", "left_anti").count()
    return samples, images, notes + ([f"{lost} samples have no image that can be read: not assessed"] if lost else [])


def scan_folder(spark: SparkSession, root: str, th: Thresholds = Thresholds(), embed: Callable = embed_pixels, neighbours: Callable | None = None) -> Assessment:
    """Findings of a folder: label flips, mislabelling, outliers and triggers over its images' vectors and pixels, floods of near
    copies confirmed on pixels, contributors with many repeats, and contributors of high risk; each with its contributor.

    embed gives an image's vector, by default pixels (functions.images.embed_pixels); pass a model's features to judge by those. neighbours is as
    scan_data says. Images that
    are known copies count less as triggers. What couldn't be assessed is in limitations, never clean.
    """
    samples, images, notes = folder_tables(spark, root, embed)
    who = samples.select(F.col("path").alias("id"), "contributor")
    both = samples.join(images.select("path", "embedding"), "path").filter("primary_label >= 0").select(F.col("path").alias("vec_id"), "embedding", F.col("primary_label").alias("label"))
    members, pairs, cut = image_copies.image_clusters(images, th.hamming)
    members = Store(spark, "scan").keep(members)
    measured = images.select(F.col("path").alias("id"), "high_freq_ratio", "patch_score", "patch_uniformity", "spectral_peak_ratio")
    found = scan_data(both, None, th, measured, repeats=image_copies.repeated(members), neighbours=neighbours)
    flood = duplicates.flood_clusters(members, pairs).filter("flood")
    parts = [_finding(flood, "NEAR_DUPLICATE_FLOODING", "cluster", "data_scanner", "duplicates", {"size": "size", "threshold": "threshold", "similarity_cut": f"{cut:.6f}"})]
    shares = duplicates.contributor_shares(members, who.withColumnRenamed("id", "doc_id"), "doc_id", "contributor").filter("confidence is not null")
    parts.append(_finding(shares, "NEAR_DUPLICATE_FLOODING", "contributor", "data_scanner", "duplicates", {"share": "share", "redundant": "redundant"}))
    if found.status == "NOT_ASSESSED":
        notes = notes + found.limitations
    else:
        parts.append(found.findings)
        notes = notes + found.limitations
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = Store(spark, "scan").keep(out.join(who.withColumnRenamed("id", "affected_asset"), "affected_asset", "left"))
    risky = fnd.contributor_findings(fnd.contributor_risk(out, who))
    out = out.unionByName(risky.withColumn("evidence", F.create_map(F.lit("risk_score"), F.col("confidence").cast("string"))).withColumns({"module": F.lit("data_scanner"), "detector": F.lit("contributor")}))
    return Assessment(out, "NOT_ASSESSED" if images.isEmpty() else "ASSESSED", notes)
