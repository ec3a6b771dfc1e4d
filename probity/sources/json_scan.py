"""Objects of large JSON documents, read by byte ranges in many tasks.

Spark's text source splits a file at any one-character separator. Cut at closing braces, a document is rows of fragments, and each range of them
is a function of the state that it begins in: inside a string or not, and how deep. A first pass states that function for each range, the
functions are composed over a file's ranges by running sums, and a last pass, in which each range knows its state, cuts the objects out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probity.sources.tables import Store

QUOTE, SLASH, OPEN, CLOSE, LIST, END = (ord(c) for c in '"\\{}[]')
#: File names that can be JSON.
ANY_JSON = "*[jJ][sS][oO][nN]*"
KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')


def fragments(spark: SparkSession, paths: str | list[str], names: str = ".*", above: int = 0) -> DataFrame:
    """(file, block, size, value): the text between closing braces, in order within a block; a block is a byte range that one task reads.
    Of files whose name matches and that have over `above` bytes."""
    src = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", ANY_JSON).option("lineSep", "}").text(paths)
    src = src.filter((F.col("_metadata.file_size") > above) & F.col("_metadata.file_path").rlike(names))
    return src.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value")


def _structure(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how many quotes that begin or end a string come before each byte, +1 or -1 where the byte is a bracket)."""
    at = np.arange(len(raw))
    other = np.maximum.accumulate(np.where(raw != SLASH, at, -1))
    run = np.zeros(len(raw), np.int64)  # of backslashes before the byte
    run[1:] = at[:-1] - other[:-1]
    quote = (raw == QUOTE) & (run % 2 == 0)
    before = np.cumsum(quote) - quote
    step = ((raw == OPEN) | (raw == LIST)).astype(np.int64) - ((raw == CLOSE) | (raw == END))
    return before, step


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int, int], int, int]]:
    """((file, block, size), first row, end row) of rows that follow each other in one block."""
    files, blocks, sizes = (batch.column(c).to_pylist() for c in range(3))
    a = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or (files[i], blocks[i]) != (files[a], blocks[a]):
            yield (files[a], blocks[a], sizes[a]), a, i
            a = i


def _bytes(batch: pa.RecordBatch, a: int, b: int, column: int) -> bytes:
    return b"".join(v.encode() + b"}" for v in batch.column(column).slice(a, b - a).to_pylist())


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every block: its bytes, quotes, change of depth if it begins outside (d0) and inside (d1) a string, and first character."""
    names = ["file", "block", "size", "bytes", "quotes", "d0", "d1", "lead"]
    key, state = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, *state[:4])] + [pa.array([state[4]], pa.string())], names=names)

    for batch in batches:
        for k, a, b in _runs(batch):
            if k != key:
                if key is not None:
                    yield out()
                key, state = k, [0, 0, 0, 0, None]
            text = _bytes(batch, a, b, 3)
            before, step = _structure(np.frombuffer(text, np.uint8))
            odd = (before + state[1]) % 2
            quotes = int(before[-1]) + int(text[-1] == QUOTE)
            state[0] += len(text)
            state[2], state[3] = state[2] + int(step[odd == 0].sum()), state[3] + int(step[odd == 1].sum())
            state[1] += quotes
            if state[4] is None and (t := text.lstrip(b"\xef\xbb\xbf \t\r\n")):
                state[4] = chr(t[0])
    if key is not None:
        yield out()


def _key(text: bytes) -> str | None:
    m = KEY.search(text[-65536:])
    return m[1].decode(errors="replace") if m else None


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every block: how often a value at the top ends in it, and the last container that opens at depth 1, with its key."""
    key, state = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state[2]]), pa.array([state[3]], pa.string()), pa.array([state[4]], pa.string())], names=["file", "block", "tops", "kind", "section"])

    for batch in batches:
        inside, depth = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        for k, a, b in _runs(batch):
            if k != key:
                if key is not None:
                    yield out()
                key, state = k, [inside[a], depth[a], 0, None, None]
            text = _bytes(batch, a, b, 3)
            raw = np.frombuffer(text, np.uint8)
            before, step = _structure(raw)
            step = np.where((before + state[0]) % 2 == 0, step, 0)
            deep = state[1] + np.cumsum(step)
            state[2] += int(((step < 0) & (deep == 0)).sum())
            opened = np.flatnonzero((step > 0) & (deep == 2))
            if len(opened):
                state[3], state[4] = chr(raw[opened[-1]]), _key(text[: opened[-1]])
            state[0], state[1] = (state[0] + int(before[-1]) + int(text[-1] == QUOTE)) % 2, int(deep[-1])
    if key is not None:
        yield out()


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects, and parts of those that a block's edge cuts: part 0 whole, 1 head, 2 middle or 3 tail."""
    names = ["file", "block", "k", "section", "listed", "part", "value"]
    key, state = None, None  # state: inside a string, depth, container at depth 2, its key, open part, its section, next k, whether it began here, whether in an array
    rows: list[tuple] = []

    def flush(last: bool):
        if last and key is not None and state[4] is not None:
            rows.append((key[0], key[1], state[6], state[5], state[8], 1 if state[7] else 2, state[4].decode(errors="replace")))
        if rows:
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.string()))], names=names)
            rows.clear()
            return [done]
        return []

    for batch in batches:
        extra = [batch.column(c).to_pylist() for c in (4, 5, 6, 7, 8)]
        for k, a, b in _runs(batch):
            if k != key:
                yield from flush(True)
                inside, depth, top, kind, section = (c[a] for c in extra)
                # an object is open where a block begins if it lies deeper than its place
                base = 1 if top == "[" or kind == "{" else 2
                state = [inside, depth, kind, section, b"" if depth > base else None, section if top == "{" else None, 0, False, top == "[" or kind != "{"]
                key = k
            text = _bytes(batch, a, b, 3)
            raw = np.frombuffer(text, np.uint8)
            before, step = _structure(raw)
            step = np.where((before + state[0]) % 2 == 0, step, 0)
            deep = state[1] + np.cumsum(step)
            top = extra[2][a]
            from_ = 0 if state[4] is not None else None
            for i in np.flatnonzero((step != 0) & (deep <= 3)):
                up, d = step[i] > 0, int(deep[i])
                if up and d == 2 and from_ is None:
                    state[2], state[3] = chr(raw[i]), _key(text[:i]) if top == "{" else None
                place = 1 if top == "[" else 1 if state[2] == "{" else 2
                if up and raw[i] == OPEN and d == place + 1 and from_ is None:
                    from_, state[5], state[7], state[8] = int(i), state[3] if top == "{" else None, True, top == "[" or place == 2
                elif not up and d == place and from_ is not None and raw[i] == CLOSE:
                    whole = (state[4] or b"") + text[from_ : i + 1]
                    rows.append((key[0], key[1], state[6], state[5], state[8], 0 if state[7] else 3, whole.decode(errors="replace")))
                    state[6], state[4], from_ = state[6] + 1, None, None
            if from_ is not None:
                state[4] = (state[4] or b"") + text[from_:]
            state[0], state[1] = (state[0] + int(before[-1]) + int(text[-1] == QUOTE)) % 2, int(deep[-1])
        yield from flush(False)
    yield from flush(True)


def scan_documents(spark: SparkSession, paths: str | list[str], names: str = ".*", above: int = 0) -> tuple[DataFrame, DataFrame]:
    """(objects, files) of JSON documents of any size.

    objects(file, block, k, section, listed, value): of an array, its objects (section null); of an object, the objects that its keys have or that
    lie in their arrays (listed), by key. (block, k) is their order in the file. files(file, size, lead, tops, error): first character, values at the top (more than
    one: lines of JSON, to be read as such), and what is wrong with a document that doesn't end as it should. No task reads more than a range;
    a file's ranges, one row each, meet in a window. An object may span ranges: its parts, two rows a range at most, are joined.
    """
    store = Store(spark, "json")
    frags = fragments(spark, paths, names, above)
    own = frags.mapInArrow(_functions, "file string, block bigint, size bigint, bytes bigint, quotes bigint, d0 bigint, d1 bigint, lead string")
    own = store.keep(own)
    order = Window.partitionBy("file").orderBy("block")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    starts = own.withColumn("inside", zero(F.sum("quotes").over(before)) % 2)
    starts = starts.withColumn("change", F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1")))
    starts = starts.withColumn("depth", zero(F.sum("change").over(before))).withColumn("top", F.first("lead", True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # the last fragment gets a brace that the file doesn't have, unless it ends in one
    extra = (F.sum("bytes").over(whole) - F.col("size")).cast("bigint")
    starts = store.keep(starts.withColumn("end", F.sum("change").over(whole) + F.when(extra > 0, 1).otherwise(0)).withColumn("quotes_all", F.sum("quotes").over(whole)))
    known = F.broadcast(starts.select("file", "block", "inside", "depth", "top"))  # a row a range of 128 MB or so
    made = frags.join(known, ["file", "block"]).select("file", "block", "size", "value", "inside", "depth").mapInArrow(_sections, "file string, block bigint, tops bigint, kind string, section string")
    made = store.keep(made)
    carry = made.select("file", "block", "tops", F.last("kind", True).over(before).alias("kind"), F.last(F.when(F.col("kind").isNotNull(), F.struct("section")), True).over(before)["section"].alias("section"))
    full = F.broadcast(starts.select("file", "block", "inside", "depth", "top").join(carry.select("file", "block", "kind", "section"), ["file", "block"]))
    pieces = frags.join(full, ["file", "block"]).select("file", "block", "size", "value", "inside", "depth", "top", "kind", "section").mapInArrow(_objects, "file string, block bigint, k bigint, section string, listed boolean, part int, value string")
    pieces = store.keep(pieces)
    parts = pieces.filter("part > 0").withColumn("n", F.sum(F.when(F.col("part") == 1, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("block", "k")))
    joined = parts.groupBy("file", "n").agg(F.sort_array(F.collect_list(F.struct("block", "k", "section", "listed", "value"))).alias("p"))
    joined = joined.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["k"].alias("k"), F.col("p")[0]["section"].alias("section"), F.col("p")[0]["listed"].alias("listed"), F.array_join(F.col("p.value"), "").alias("value"))
    objects = pieces.filter("part = 0").drop("part").unionByName(joined)
    files = starts.groupBy("file").agg(F.max("size").alias("size"), F.first("top").alias("lead"), F.max("end").alias("end"), F.max("quotes_all").alias("q")).join(made.groupBy("file").agg(F.sum("tops").alias("tops")), "file")
    bad = F.when(F.col("lead").isNull(), "an empty document").when(F.col("q") % 2 > 0, "a string doesn't end").when(F.col("end") != 0, "brackets don't match")
    return objects, files.select("file", "size", "lead", "tops", bad.alias("error"))
