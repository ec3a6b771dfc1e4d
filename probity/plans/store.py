"""The result store as tables: upserts, filters, replay guard, audit chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.functions import scans
from probity.functions.text import GENESIS
from probity.sources.tables import Store


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str, keep: list[str] | None = None) -> DataFrame:
    """Latest row of each key of both; columns in `keep` stay as first written."""
    both = old.unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc())
    d = both.withColumn("__r", F.row_number().over(w))
    for c in keep or []:
        d = d.withColumn(c, F.first(c, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.col(version).asc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return d.filter("__r = 1").drop("__r")


def complete(scans: DataFrame, done: DataFrame) -> DataFrame:
    """UPDATE by key: fields of done(scan_id, ...) replace those of scans where present."""
    extra = [c for c in done.columns if c != "scan_id"]
    j = scans.join(done.select("scan_id", *[F.col(c).alias(f"__{c}") for c in extra]), "scan_id", "left")
    return j.select(*[F.coalesce(f"__{c}", c).alias(c) if c in extra and c in scans.columns else F.col(c) for c in scans.columns])


def list_scans(scans: DataFrame, limit: int = 50) -> DataFrame:
    return scans.orderBy(F.col("started_ns").desc(), "scan_id").limit(limit)


def get_findings(findings: DataFrame, attack_class: str | None = None, severity: str | None = None, scan_id: str | None = None, limit: int = 1000) -> DataFrame:
    d = findings
    for c, v in (("attack_class", attack_class), ("severity", severity), ("scan_id", scan_id)):
        d = d if v is None else d.filter(F.col(c) == v)
    return d.orderBy(F.col("confidence").desc(), "finding_id").limit(limit)


def accept_records(store: DataFrame, new: DataFrame, order: str, keep=None) -> DataFrame:
    """The rows of new that inserting one by one, by `order` (unique), would accept: neither the id nor the nonce is in the store or was
    accepted before. Null ids and nonces clash with nothing.

    In each round those that are first of all rows left by id and by nonce are accepted, and rows that clash with them go; so many
    rounds as the longest run of clashes that hang on one another. `keep` writes a table and reads it again.
    """
    keep = keep or Store(new.sparkSession, "accept").keep
    left = keep(new.join(store.select("record_id"), "record_id", "left_anti").join(store.select("nonce"), "nonce", "left_anti").select(new.columns))
    out = left.limit(0)
    while not left.isEmpty():
        first = lambda c: left.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min(order).alias(f"__{c}"))  # noqa: B023, E731
        d = left.join(first("record_id"), "record_id", "left").join(first("nonce"), "nonce", "left")
        free = lambda c: F.col(c).isNull() | (F.col(order) == F.col(f"__{c}"))
        yes = keep(d.filter(free("record_id") & free("nonce")).select(new.columns))
        out = out.unionByName(yes)
        left = keep(left.join(yes.select(order), order, "left_anti").join(yes.select("record_id"), "record_id", "left_anti").join(yes.select("nonce"), "nonce", "left_anti").select(new.columns))
    return out


def get_scan(scans: DataFrame, scan_id: str) -> DataFrame:
    """The scan of that id: one row or none."""
    return scans.filter(F.col("scan_id") == scan_id)


def get_contributor_risks(risks: DataFrame, scan_id: str | None = None) -> DataFrame:
    """Risks of contributors, of one scan or all, the highest first."""
    d = risks if scan_id is None else risks.filter(F.col("scan_id") == scan_id)
    return d.orderBy(F.col("risk_score").desc(), "name")


def get_provenance_records(records: DataFrame, model_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Records in sequence, of one model or all."""
    d = records if model_id is None else records.filter(F.col("model_id") == model_id)
    d = d.orderBy("sequence_number", "timestamp_ns", "record_id")
    return d if limit is None else d.limit(limit)


def find_model(registry: DataFrame, weight_hash: str) -> DataFrame:
    """The registered model with these weights: one row or none."""
    return registry.filter(F.col("weight_hash") == weight_hash).limit(1)


def nonce_exists(store: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.join(store.select("nonce").distinct(), "nonce", "left_semi")


def register_models(registry: DataFrame, new: DataFrame) -> DataFrame:
    """INSERT OR IGNORE by weight hash."""
    return registry.unionByName(new.dropDuplicates(["weight_hash"]).join(registry.select("weight_hash"), "weight_hash", "left_anti").select(registry.columns))


def _entry(prev: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.col("timestamp_ns").cast("string"), "actor", "action", F.coalesce("target", F.lit("")), "details", prev), 256)


def verify_audit(log: DataFrame, chain: list[str] | None = None) -> DataFrame:
    """(id, break_type): BROKEN_LINK where prev_hash isn't the stored hash before, HASH_MISMATCH where a row's own hash is wrong.

    The hash before is scanned in two levels (scans.Scan), so one log of all rows is spread like many."""
    (before,) = scans.free(log, "before")
    scan = scans.Scan(log, chain or [], [F.col("id").asc_nulls_first()], Store(log.sparkSession, "audit"))
    d = scan.clean(scan.lasts(**{before: F.col("entry_hash")}))
    b = F.array_compact(F.array(F.when(F.col("prev_hash") != F.coalesce(before, F.lit(GENESIS)), "BROKEN_LINK"), F.when(F.col("entry_hash") != _entry(F.col("prev_hash")), "HASH_MISMATCH")))
    return d.select(*(chain or []), "id", F.explode(b).alias("break_type"))


def list_audit(log: DataFrame, limit: int = 100, actor: str | None = None, action: str | None = None) -> DataFrame:
    """The newest entries of a log, of one actor or action where given."""
    d = log if actor is None else log.filter(F.col("actor") == actor)
    d = d if action is None else d.filter(F.col("action") == action)
    return d.orderBy(F.col("id").desc()).limit(limit)


def reset(tables: dict[str, DataFrame], keep: tuple[str, ...] = ("audit",)) -> dict[str, DataFrame]:
    """The tables without their rows, but for those kept: the audit log isn't forgotten."""
    return {name: d if name in keep else d.limit(0) for name, d in tables.items()}


def append_audit(entries: DataFrame, chain: str) -> DataFrame:
    """Chained entries of each log: entries(chain, id, timestamp_ns, actor, action, target, details), one fold a log."""
    logs = entries.groupBy(chain).agg(F.array_sort(F.collect_list(F.struct("id", "timestamp_ns", "actor", "action", "target", "details"))).alias("r"))

    def step(acc, x):
        h = F.sha2(F.concat_ws("|", x["timestamp_ns"].cast("string"), x["actor"], x["action"], F.coalesce(x["target"], F.lit("")), x["details"], acc["h"]), 256)
        return F.struct(h.alias("h"), F.array_append(acc["o"], F.struct(acc["h"].alias("prev_hash"), h.alias("entry_hash"))).alias("o"))

    start = F.struct(F.lit(GENESIS).alias("h"), F.array().cast("array<struct<prev_hash:string,entry_hash:string>>").alias("o"))
    d = logs.select(chain, F.explode(F.arrays_zip("r", F.aggregate("r", start, step, lambda a: a["o"]).alias("o"))).alias("x"))
    return d.select(chain, "x.r.*", "x.o.*")


def audit_head(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max_by("entry_hash", "id"), F.lit(GENESIS)).alias("head"))


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, d in tables.items():
        one = d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
