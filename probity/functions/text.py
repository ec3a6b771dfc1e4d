"""Hashes, canonical JSON, labels, paths, times and display helpers as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

GENESIS = "0" * 64
#: The fields a record's hash covers, in the alphabetical order of canonical JSON (fixed values).
CHAINED = ("config_hash", "input_hash", "model_hash", "nonce", "output_hash", "prev_record_hash", "record_id", "sequence_number", "timestamp_ns")
#: Path parts that name a contributor (fixed values).
CONTRIBUTOR_PREFIXES = ("contributor", "source", "vendor", "supplier", "batch", "partner")


def sha256_text(c: Column) -> Column:
    return F.sha2(c, 256)


def canonical_json(fields: Sequence[tuple[str, Column]]) -> Column:
    """JSON with sorted keys and tight separators; nulls are written."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields, key=lambda x: x[0]))), {"ignoreNullFields": "false"})


def sha256_json(fields: Sequence[tuple[str, Column]]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def record_hash(prev: Column | None = None, sequence: Column | None = None) -> Column:
    """Hash of a record's chained fields; missing texts are empty, missing numbers 0."""
    cols = []
    for n in CHAINED:
        c = prev if n == "prev_record_hash" and prev is not None else sequence if n == "sequence_number" and sequence is not None else F.col(n)
        cols.append((n, F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")) if n in ("sequence_number", "timestamp_ns") else F.coalesce(c.cast("string"), F.lit(""))))
    return sha256_json(cols)


def hash_concat(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def verify_hash(found: Column, expected: Column) -> Column:
    return F.coalesce(F.lower(F.trim(found)) == F.lower(F.trim(expected)), F.lit(False))


def short_hash(c: Column, n: int = 12) -> Column:
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, "-").when(F.length(c) <= n, c).otherwise(F.concat(F.left(c, F.lit(n)), F.lit("…")))


def normalise_label(c: Column) -> Column:
    return F.regexp_replace(F.trim(c.cast("string")), "(?i)^(class|label)[_-]", "")


def safe_filename(c: Column, limit: int = 120) -> Column:
    clean = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(F.length(clean) == 0, "unnamed").otherwise(F.left(clean, F.lit(limit)))


def truncate(c: Column, limit: int = 80) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.left(c, F.lit(max(limit - 1, 0))), F.lit("…")))


def format_bytes(c: Column) -> Column:
    out, size = None, c.cast("double")
    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        text = F.format_string("%.1f %s", size / 1024**k, F.lit(unit))
        out = F.when(F.abs(size) < 1024 ** (k + 1), text) if out is None else (out.when(F.abs(size) < 1024 ** (k + 1), text) if k < 4 else out.otherwise(text))
    return out


def format_duration(seconds: Column) -> Column:
    s = seconds.cast("double")
    return F.when(s < 1, F.format_string("%.0f ms", s * 1000)).when(s < 60, F.format_string("%.1f s", s)).otherwise(F.format_string("%d m %02d s", F.floor(s / 60), F.floor(s % 60)))


def ns_to_iso(c: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.floor(c / 1_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def to_int(c: Column) -> Column:
    """Digits as a number, an ISO time as nanoseconds, anything else 0."""
    return F.coalesce(c.try_cast("bigint"), c.try_cast("double").cast("bigint"), F.unix_micros(c.try_cast("timestamp")) * 1000, F.lit(0).cast("bigint"))


def contributor_from_path(path: Column) -> Column:
    """The deepest part of a path, the file name included, that begins with a contributor word."""
    rule = "(?i)^(" + "|".join(CONTRIBUTOR_PREFIXES) + ")"
    return F.get(F.filter(F.reverse(F.split(path, "/")), lambda x: x.rlike(rule)), F.lit(0))
