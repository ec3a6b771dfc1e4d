"""Threat stories across modules, and the immunity score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.functions.stats import clamp, noisy_or
from probity.operators.findings import STAGES, disposition, lookup, severity
from probity.operators.office import TARGET_KEYS

ORDER = ("DATA", "MODEL", "INFERENCE", "OPERATIONS")
#: Evidence keys that make up an attack's signature, in this order (fixed values).
SIGNATURE_KEYS = ("corner", "patch_corner", "target_class", "spectral_class", "to_class", "new_label", "block_size")
CONCEALMENT = ("INFERENCE_TAMPER", "INFERENCE_REPLAY", "CHAIN_BREAK", "SIGNATURE_INVALID")
DAMAGE = {"CRITICAL": 1.00, "HIGH": 0.55, "MEDIUM": 0.22, "LOW": 0.07, "INFO": 0.02}
PILLARS = {"data_integrity": (0.30, ("data_scanner", "trigger_detector")), "model_integrity": (0.30, ("model_auditor",)), "provenance": (0.25, ("crypto_chain",)), "drift_stability": (0.15, ("drift_detector",))}
STORY = ("pattern", "key", "confidence", "supporting")


def _ev(key: str) -> Column:
    return F.element_at("evidence", F.lit(key))


def stage(findings: DataFrame) -> DataFrame:
    return findings.withColumn("stage", lookup(F.col("attack_class"), STAGES, "UNKNOWN"))


def material(findings: DataFrame, least: float = 0.50) -> DataFrame:
    return stage(findings.filter(F.col("confidence") >= least))


def corroborated() -> Column:
    return F.coalesce(_ev("detection_methods_agreed").try_cast("int") >= 2, F.lit(False)) | (F.col("confidence") >= 0.85)


def benign() -> Column:
    return F.coalesce(_ev("shift_type") == "NATURAL_OPERATIONAL_DRIFT", F.lit(False)) | (F.coalesce(_ev("natural_signatures"), F.lit("")).isin("", "[]") == False) & F.coalesce(_ev("suspicious_signals"), F.lit("")).isin("", "[]")  # noqa: E712


def _fuse(x: list[Column]) -> Column:
    """Noisy-or of a few columns, each held to 0.99."""
    return 1 - reduce(lambda a, b: a * b, [1 - clamp(c, 0.0, 0.99) for c in x])


def _story(pattern: str, key: Column, confidence: Column, supporting: Column) -> list[Column]:
    return [F.lit(pattern).alias("pattern"), key.cast("string").alias("key"), F.round(confidence, 4).alias("confidence"), supporting.cast("bigint").alias("supporting")]


def kill_chain(findings: DataFrame) -> DataFrame:
    """At most one row: two stages or more, each with a corroborated finding that isn't explained as benign."""
    f = findings.filter(F.col("stage").isin(*ORDER) & ~benign())
    s = f.groupBy("stage").agg(F.max("confidence").alias("best"), F.max(corroborated()).alias("ok"), F.count(F.lit(1)).alias("n"))
    g = s.agg(F.count(F.lit(1)).alias("k"), F.min("ok").alias("ok"), noisy_or(F.col("best"), 0.99).alias("f"), F.sum("n").alias("n"), F.array_sort(F.collect_list("stage")).alias("stages"))
    return g.filter("k >= 2 and ok").select(*_story("KILL_CHAIN", F.concat_ws(",", "stages"), F.least(F.lit(0.95), clamp(F.col("f") * (0.70 + 0.07 * F.col("k")))), F.col("n")))


def target_classes(findings: DataFrame, order: str = "finding_id", first: int = 6) -> DataFrame:
    """One row for each class that two modules and three findings or more name; the first six findings are fused."""
    f = findings.withColumn("target", F.coalesce(*(_ev(k) for k in TARGET_KEYS))).filter("target is not null")
    f = f.withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy(order)))
    g = f.groupBy("target").agg(F.countDistinct("module").alias("m"), F.count(F.lit(1)).alias("n"), (1 - F.product(F.when(F.col("r") <= first, 1 - clamp(F.col("confidence"), 0.0, 0.99)).otherwise(1.0))).alias("f"))
    return g.filter("m >= 2 and n >= 3").select(*_story("TARGETED_CLASS", F.col("target"), clamp(F.col("f") * 0.85), F.col("n")))


def signature() -> Column:
    return F.concat_ws("|", "attack_class", *(F.when(_ev(k).isNotNull(), F.concat(F.lit(f"{k}="), _ev(k))) for k in SIGNATURE_KEYS))


def coordinated(findings: DataFrame, order: str = "finding_id") -> DataFrame:
    """At most one row: the signature in corroborated findings of most contributors (two at least), the earliest of ties."""
    f = findings.filter((F.coalesce("contributor", F.lit("_unattributed")) != "_unattributed") & (F.col("attack_class") != "CONTRIBUTOR_RISK") & corroborated()).withColumn("sig", signature())
    f = f.withColumn("r", F.row_number().over(Window.partitionBy("sig").orderBy(F.col("confidence").desc(), order)))
    g = f.groupBy("sig").agg(F.countDistinct("contributor").alias("c"), F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), (1 - F.product(F.when(F.col("r") <= 5, 1 - clamp(F.col("confidence"), 0.0, 0.99)).otherwise(1.0))).alias("f"))
    return g.filter("c >= 2").orderBy(F.col("c").desc(), "first").limit(1).select(*_story("COORDINATED_CONTRIBUTORS", F.col("sig"), clamp(F.col("f") * 0.80), F.col("n")))


def cover_up(findings: DataFrame) -> DataFrame:
    """At most one row: provenance failures beside data or model findings."""
    hide, real = F.col("attack_class").isin(*CONCEALMENT), F.col("stage").isin("DATA", "MODEL")
    g = findings.agg(F.max(F.when(hide, F.col("confidence"))).alias("a"), F.max(F.when(real, F.col("confidence"))).alias("b"), F.count_if(hide | real).alias("n"))
    return g.filter("a is not null and b is not null").select(*_story("COVER_UP", F.lit("provenance"), clamp(_fuse([F.col("a"), F.col("b")]) * 0.82), F.col("n")))


def stories(findings: DataFrame, least: float = 0.50) -> DataFrame:
    f = material(findings, least)
    return kill_chain(f).unionByName(target_classes(f)).unionByName(coordinated(f)).unionByName(cover_up(f))


def story_findings(story: DataFrame) -> DataFrame:
    """Findings of stories, one each: how strongly findings belong together, not how sure they are."""
    c = F.col("confidence")
    return story.select(
        F.when(F.col("pattern") == "COVER_UP", "COVER_UP_ATTEMPT").otherwise("COORDINATED_ATTACK").alias("attack_class"), F.concat_ws(":", "pattern", "key").alias("affected_asset"), severity(c).alias("severity"), c.cast("double").alias("confidence"), disposition(c).alias("disposition"),
        F.create_map(F.lit("pattern"), F.col("pattern"), F.lit("key"), F.col("key"), F.lit("supporting"), F.col("supporting").cast("string")).alias("evidence"), F.lit("threat_story").alias("module"), F.lower("pattern").alias("detector"),
    )


def campaign(story: DataFrame) -> DataFrame:
    """One row: whether a campaign is seen, its confidence and patterns."""
    return story.agg((F.count(F.lit(1)) > 0).alias("campaign_detected"), F.coalesce(F.max("confidence"), F.lit(0.0)).alias("confidence"), F.array_sort(F.collect_set("pattern")).alias("patterns"))


def pillar_scores(findings: DataFrame, modules: DataFrame) -> DataFrame:
    """Score of each pillar: 70 if none of its modules(module) ran, 100 without findings, else 100 (1 - damage)."""
    spark = findings.sparkSession
    table = F.broadcast(spark.createDataFrame([(p, w, m) for p, (w, ms) in PILLARS.items() for m in ms], "pillar string, weight double, module string"))
    ran = table.join(modules.select("module").distinct().withColumn("ran", F.lit(1)), "module", "left").groupBy("pillar", "weight").agg(F.max("ran").alias("ran"))
    d = findings.join(table, "module").withColumn("damage", lookup(F.upper("severity"), DAMAGE, 0.05) * F.coalesce("confidence", F.lit(0.5)))
    # equal damages take consecutive ranks, so a damage and its count say all; few distinct values are left to rank
    v = d.groupBy("pillar", "damage").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("pillar").orderBy(F.col("damage").desc())
    v = v.withColumn("upto", F.sum("c").over(w)).withColumn("r", F.explode(F.sequence(F.col("upto") - F.col("c") + 1, F.col("upto"))))
    g = v.groupBy("pillar").agg(F.max("damage").alias("worst"), F.sum(F.when(F.col("r") > 1, F.col("damage") / F.col("r"))).alias("tail"), F.count(F.lit(1)).alias("n"))
    j = ran.join(g, "pillar", "left")
    hurt = clamp(0.55 * F.col("worst") + 0.45 * (1 - F.exp(-F.coalesce("tail", F.lit(0.0)) / 6)), 0.0, 0.98)
    score = F.when(F.col("ran").isNull(), 70.0).when(F.col("n").isNull(), 100.0).otherwise(F.round(100 * (1 - hurt), 1))
    return j.select("pillar", "weight", F.col("ran").isNotNull().alias("assessed"), F.when(F.col("ran").isNotNull(), F.coalesce("n", F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint")).alias("findings"), score.alias("score"))


def immunity(pillars: DataFrame, story: DataFrame) -> DataFrame:
    """One row: score, band, confidence (weight assessed), campaign penalty. HARDENED needs full coverage."""
    p = pillars.agg(F.sum(F.col("score") * F.col("weight")).alias("base"), F.sum(F.when(F.col("assessed"), F.col("weight")).otherwise(0.0)).alias("confidence"), F.max(~F.col("assessed")).alias("gaps"))
    c = campaign(story).select(F.when(F.col("campaign_detected"), clamp(8 * F.col("confidence") + 2 * F.size("patterns"), 0.0, 25.0)).otherwise(0.0).alias("penalty"))
    r = p.crossJoin(c).withColumn("score", F.round(clamp(F.col("base") - F.col("penalty"), 0.0, 100.0), 1))  # one row each
    band = F.when(F.col("score") >= 85, "HARDENED").when(F.col("score") >= 70, "ADEQUATE").when(F.col("score") >= 50, "MARGINAL").otherwise("COMPROMISED")
    band = F.when((band == "HARDENED") & (F.col("gaps") | (F.col("confidence") < 0.85)), "ADEQUATE").otherwise(band)
    return r.select("score", band.alias("band"), F.round("confidence", 3).alias("confidence"), F.round("penalty", 4).alias("penalty"))


def coverage(modules: DataFrame, expected: tuple[str, ...] = ("data_scanner", "model_auditor", "crypto_chain", "drift_detector")) -> DataFrame:
    """Expected modules and whether they ran."""
    e = modules.sparkSession.createDataFrame([(m,) for m in expected], "module string")
    return F.broadcast(e).join(modules.select("module").distinct().withColumn("ran", F.lit(True)), "module", "left").fillna(False, ["ran"])
