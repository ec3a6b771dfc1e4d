"""Inference records from JSON of many shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probity.functions.text import to_int
from probity.sources.json_scan import ANY_JSON, scan_documents

#: Files of more bytes are read by ranges.
MAX_FILE = 50 * 1024 * 1024
NAMES, LINES = r"(?i)\.(json|jsonl|ndjson)$", r"(?i)\.(jsonl|ndjson)$"
WRAPPERS = ("records", "inferences", "entries", "data", "chain")
#: Names a field can have, in order of preference (fixed values).
SYNONYMS = {
    "record_id": ("record_id", "id", "uuid", "inference_id", "rid"),
    "input_hash": ("input_hash", "image_hash", "input_sha256", "input_digest"),
    "model_hash": ("model_hash", "weights_hash", "model_sha256", "model_digest"),
    "config_hash": ("config_hash", "preprocessing_hash", "preproc_hash", "cfg_hash"),
    "output_hash": ("output_hash", "result_hash", "prediction_hash", "output_digest"),
    "timestamp_ns": ("timestamp_ns", "timestamp", "ts", "time_ns", "created_at"),
    "sequence_number": ("sequence_number", "seq", "sequence", "index", "seq_no"),
    "nonce": ("nonce", "salt", "random"),
    "prev_record_hash": ("prev_record_hash", "previous_hash", "prev_hash", "parent_hash"),
    "signature": ("signature", "sig", "ed25519_signature"),
    "record_hash": ("record_hash", "self_hash", "digest", "hash"),
    "output": ("output", "prediction", "predictions", "result", "detections"),
    "input_path": ("input_path", "image_path", "image", "input", "file"),
    "model_id": ("model_id", "model", "model_name"),
    "contributor": ("contributor", "source", "vendor", "operator", "unit"),
}


def pick(v: Column, field: str, kind: str = "string") -> Column:
    """First non-null of a field's names at the top level, then under provenance, then under metadata."""
    return F.coalesce(*(F.try_variant_get(v, f"$.{head}{n}", kind) for head in ("", "provenance.", "metadata.") for n in SYNONYMS[field]))


def parse_objects(text: DataFrame) -> DataFrame:
    """text(file, value), a file a row -> (file, pos, v) for every object: of an array, under a wrapper key, alone, or one a line."""
    d = text.withColumn("j", F.try_parse_json("value"))
    kind = F.schema_of_variant("j")
    inner = F.coalesce(*(F.try_variant_get("j", f"$.{w}", "array<variant>") for w in WRAPPERS))
    whole = F.when(kind.startswith("ARRAY"), F.try_variant_get("j", "$", "array<variant>")).when(kind.startswith("OBJECT"), F.coalesce(inner, F.array("j")))
    full = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    lines = F.transform(full, lambda x: F.try_parse_json(F.regexp_replace(F.trim(x), r",\s*$", "")))
    # the parser takes the first value and leaves what follows it, so an object that ends on the first of several lines is lines
    first = F.get(full, F.lit(0))
    several = (F.size(full) > 1) & kind.startswith("OBJECT") & first.rlike(r"\}\s*,?\s*$") & F.get(lines, F.lit(0)).isNotNull()
    d = d.select("file", F.posexplode(F.when(F.col("j").isNotNull() & ~several, whole).otherwise(lines)).alias("pos", "v"))
    return d.filter(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))


def normalise(objects: DataFrame, max_output: int | None = None) -> DataFrame:
    """One typed row per object; an output of over max_output bytes of JSON, where that is given, is replaced by a marker."""
    v = F.col("v")
    out = F.to_json(pick(v, "output", "variant"))
    text = {f: pick(v, f).alias(f) for f in SYNONYMS if f not in ("timestamp_ns", "sequence_number", "output")}
    return objects.select(
        "file", "pos", *text.values(), to_int(pick(v, "timestamp_ns")).alias("timestamp_ns"), to_int(pick(v, "sequence_number")).alias("sequence_number"),
        F.when(F.octet_length(out) > (1 << 62 if max_output is None else max_output), F.concat(F.lit('{"_truncated":true,"size":'), F.octet_length(out).cast("string"), F.lit("}"))).otherwise(out).alias("output"), F.to_json(v).alias("raw"),
    )


def _lines(src: DataFrame) -> DataFrame:
    """src(file, at, value), a line a row -> (file, pos, v); positions grow in a file, without being dense."""
    d = src.withColumn("v", F.try_parse_json(F.regexp_replace(F.trim("value"), r",\s*$", "")))
    return d.filter(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT")).select("file", F.col("at").alias("pos"), "v")


def large_objects(spark: SparkSession, path: str, above: int = MAX_FILE) -> tuple[DataFrame, DataFrame]:
    """((file, pos, v), (file, size, error)) of files of over `above` bytes, by ranges in many tasks; the second has the files not read."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", ANY_JSON).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), (F.col("_metadata.file_block_start") + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33))).alias("at"))
    text = text.filter((F.col("size") > above) & F.col("file").rlike(NAMES))
    objects, files = scan_documents(spark, path, r"(?i)\.json$", above)
    one = files.filter("tops = 1 and error is null")
    wanted = F.coalesce(*(F.when(F.array_contains("found", w), w) for w in WRAPPERS))
    which = objects.filter("listed and section is not null").groupBy("file").agg(F.collect_set(F.when(F.col("section").isin(*WRAPPERS), F.col("section"))).alias("found")).select("file", wanted.alias("wanted"))
    which = one.join(which, "file", "left").filter("lead = '[' or wanted is not null").select("file", F.when(F.col("lead") == "{", F.col("wanted")).alias("wanted"))
    mine = objects.filter("listed").join(F.broadcast(which), "file").filter(F.col("section").eqNullSafe(F.col("wanted")))  # a row a large file
    # places: ranks in a range, and the sizes of the ranges before
    local = mine.withColumn("pos", F.row_number().over(Window.partitionBy("file", "block").orderBy("k")) - 1)
    before = mine.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("file", "block", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    whole = local.join(before, ["file", "block"]).select("file", (F.col("base") + F.col("pos")).alias("pos"), F.try_parse_json("value").alias("v")).filter("v is not null")
    many = text.join(F.broadcast(files.filter("tops > 1").select("file")), "file", "left_semi")
    lines = _lines(text.filter(F.col("file").rlike(LINES)).unionByName(many))
    bad = files.filter("tops <= 1").join(which.select("file"), "file", "left_anti")
    return whole.unionByName(lines), bad.select("file", "size", F.coalesce("error", F.lit("one object larger than a row should be")).alias("error"))


def _small(spark: SparkSession, path: str, most: int) -> DataFrame:
    src = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", ANY_JSON).text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    return src.filter(F.col("file").rlike(NAMES) & (F.col("size") <= most))


def listing(spark: SparkSession, path: str, names: str = NAMES) -> DataFrame:
    """(file, size) of the files under path whose names match; contents aren't read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return d.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).filter(F.col("file").rlike(names))


def read_records(spark: SparkSession, path: str, whole: int = MAX_FILE, max_output: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, left_out) of a file or folder of .json, .jsonl and .ndjson files: what load_records gives, and (file, size, error) of every
    file that no record comes from (Spark lists no empty files). Files of up to `whole` bytes are a row each; larger ones are read by ranges in many tasks."""
    objects, bad = parse_objects(_small(spark, path, whole)), None
    if not listing(spark, path).filter(F.col("size") > whole).isEmpty():
        more, bad = large_objects(spark, path, whole)
        objects = objects.withColumn("pos", F.col("pos").cast("bigint")).unionByName(more)
    records = normalise(objects, max_output).orderBy("sequence_number", "timestamp_ns", "file", "pos")
    none = listing(spark, path).join(records.select("file").distinct(), "file", "left_anti")
    if bad is not None:
        none = none.join(bad.select("file", "error"), "file", "left")
    else:
        none = none.withColumn("error", F.lit(None).cast("string"))
    return records, none.select("file", "size", F.coalesce("error", F.lit("no JSON object was found")).alias("error"))


def load_records(spark: SparkSession, path: str, whole: int = MAX_FILE, max_output: int | None = None) -> DataFrame:
    """Records of a file or folder of .json, .jsonl and .ndjson files of any size, by (sequence_number, timestamp_ns)."""
    return read_records(spark, path, whole, max_output)[0]


def save_records(records: DataFrame, path: str) -> None:
    """JSON lines; NaN and infinite numbers become null."""
    clean = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in records.dtypes]
    records.select(*clean).write.mode("overwrite").json(path)
