"""Files that appear whole or not at all, on any file system that Spark writes to."""

from __future__ import annotations

import json
import math
import uuid
from typing import Any

from pyspark.sql import SparkSession


def to_plain(v: Any) -> Any:
    """v as JSON can hold it: numbers that aren't finite become null, unknown objects text."""
    if isinstance(v, dict):
        return {str(k): to_plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple, set, frozenset)):
        return [to_plain(x) for x in (sorted(v, key=str) if isinstance(v, (set, frozenset)) else v)]
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        v = v.item()
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


def publish(spark: SparkSession, path: str, data: bytes, replace: bool = False, before_rename=None) -> bool:
    """Writes data to a hidden file beside path, then renames it: path has all of it or doesn't change. False if path is there and replace
    is not set, so of two writers one wins. before_rename is called in between (for tests); if it fails, the hidden file goes."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    target = system.makeQualified(target)
    system.mkdirs(target.getParent())
    staged = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    kinds = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.OVERWRITE if replace else kinds.NONE
    try:
        out = system.create(staged, False)
        out.write(bytearray(data))
        out.hsync() if hasattr(out, "hsync") else None
        out.close()
        if before_rename:
            before_rename()
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(staged, target, how)
            return True
        except Exception:
            if not replace and system.exists(target):
                return False
            raise
    finally:
        if system.exists(staged):
            system.delete(staged, False)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def publish_json(spark: SparkSession, path: str, payload: Any, replace: bool = True, indent: int = 2) -> bool:
    return publish(spark, path, json.dumps(to_plain(payload), indent=indent, ensure_ascii=False).encode(), replace)
