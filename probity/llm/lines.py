"""Substring dedup by hashing sentences, lines or paragraphs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_SPACE, Scratch, chunks, free_names, input_splits, words

#: Words of a unit that a line without sentence ends may have before it is cut at words chosen by their own hash.
LONG = 24
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


@lru_cache(1 << 16)
def cuts_after(word: bytes) -> bool:
    """Whether a long unit is cut after this word: one word in eight, by its MD5, so that copies are cut alike wherever they stand."""
    return hashlib.md5(word).digest()[0] < 32


def units(buf: np.ndarray, offs: np.ndarray, kind: str = "sentence") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, words) of the units of a chunk of texts, in order; a unit is whole words and the white space after them.

    A paragraph ends at a blank line, a line at a line feed, a sentence there and after a word that ends in . ! or ?; a
    sentence of over LONG words also ends after each word that `cuts_after` names. White space before a text's first word is in none.
    """
    start, end, row, _ = words(buf, offs, NOT_SPACE)
    n = len(start)
    if not n:
        return row, start, end, start
    after = np.append(start[1:], len(buf))
    after = np.minimum(after, offs[row + 1])
    feeds = np.concatenate(([0], np.cumsum(buf == 10)))
    feeds = feeds[after] - feeds[end]
    stop = feeds > (kind == "paragraph")
    if kind == "sentence":
        stop |= _ENDS[buf[end - 1]]
    stop[:-1] |= row[1:] != row[:-1]
    stop[-1] = True
    if kind == "sentence":
        last = np.flatnonzero(stop)
        first = np.concatenate(([0], last[:-1] + 1))
        low = LOWER[buf].tobytes()
        for f, e in zip(first[last - first >= LONG].tolist(), last[last - first >= LONG].tolist()):
            stop[f : e + 1] |= np.fromiter((cuts_after(low[a:b]) for a, b in zip(start[f : e + 1].tolist(), end[f : e + 1].tolist())), bool, e + 1 - f)
    last = np.flatnonzero(stop)
    first = np.concatenate(([0], last[:-1] + 1))
    return row[first], start[first], after[last], last - first + 1


def _by_document(ids: pa.Array, salt: np.ndarray, place: np.ndarray) -> list[pa.Array]:
    """(id, salt, places) of units, a row for each document."""
    rank = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    order = np.lexsort((place, salt, rank))
    rank, salt = rank[order], salt[order]
    first = np.flatnonzero(np.concatenate(([True], (rank[1:] != rank[:-1]) | (salt[1:] != salt[:-1]))))
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(place[order]))
    return [ids.take(pa.array(order[first])), pa.array(salt[first]), places]


def _first_of_each(ids: pa.Array, salt: np.ndarray, place: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Whether each unit is the first with its digest (two columns), by id, salt and place."""
    rank = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    order = np.lexsort((place, salt, rank, digest[:, 1], digest[:, 0]))
    d = digest[order]
    out = np.zeros(len(order), bool)
    out[order[np.concatenate(([True], (d[1:] != d[:-1]).any(axis=1)))]] = True
    return out


def _digests(batches: Iterator[pa.RecordBatch], kind: str, shards: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, salt) -> the first unit of each digest in a batch, packed by shard, and the other units by document."""
    names, z = ["shard", "packed", "id", "salt", "gone"], pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        parts = []
        for a, b, buf, offs in chunks(batch.column(1)):
            row, start, end, _ = units(buf, offs, kind)
            low = LOWER[buf].tobytes()
            digest = b"".join(hashlib.md5(b" ".join(low[s:e].split())).digest() for s, e in zip(start.tolist(), end.tolist()))
            parts.append((row + a, np.arange(len(row)) - np.searchsorted(row, row), np.frombuffer(digest, np.int64).reshape(-1, 2)))
        row, place, digest = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64),) * 2 + (np.empty((0, 2), np.int64),)
        if not len(row):
            continue
        ids, salt = batch.column(0).take(pa.array(row)), batch.column(2).to_numpy()[row]
        first = _first_of_each(ids, salt, place, digest)
        if not first.all():
            late = np.flatnonzero(~first)
            found = _by_document(ids.take(pa.array(late)), salt[late], place[late])
            n = len(found[0])
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *found], names=names)
        at = np.flatnonzero(first)
        to = (digest[at, 0].view(np.uint64) % np.uint64(shards)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        at, to = at[by], to[by]
        cuts = np.searchsorted(to, np.arange(shards + 1)).tolist()
        for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                i = at[a:b]
                sink = pa.BufferOutputStream()
                part = pa.RecordBatch.from_arrays([ids.take(pa.array(i)), *(pa.array(np.ascontiguousarray(x)) for x in (salt[i], place[i], digest[i, 0], digest[i, 1]))], names=list("ispde"))
                with pa.ipc.new_stream(sink, part.schema, options=z) as w:
                    w.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.nulls(1, batch.column(0).type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64()))], names=names)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed units by shard -> those that aren't the first with their digest, by document."""
    last, held = None, []

    def work() -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in held).combine_chunks()
        ids, salt, place = t.column(0).combine_chunks(), t.column(1).to_numpy(), t.column(2).to_numpy()
        late = np.flatnonzero(~_first_of_each(ids, salt, place, np.stack([t.column(3).to_numpy(), t.column(4).to_numpy()], axis=1)))
        if len(late):
            yield pa.RecordBatch.from_arrays(_by_document(ids.take(pa.array(late)), salt[late], place[late]), names=["id", "salt", "gone"])

    for batch in batches:
        for s, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            if held and s != last:
                yield from work()
                held = []
            last = s
            held.append(x.as_py())
    if held:
        yield from work()


def dedup_units(docs: DataFrame, kind: str = "sentence", min_words: int = 20, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, keep_text: bool = True) -> DataFrame:
    """Columns `keep` of docs (None: all), then n_units, n_removed, removed_spans, kept_sha256, kept_text (with keep_text).

    Units (see `units`) are known by the 128-bit MD5 of their words, A-Z lower-cased and one space apart. Of units with one digest the
    first, by id and then by place, stays, and the others are repeats, within a document too. Repeats that follow one another are one
    passage; passages of at least min_words words are removed. removed_spans holds their (start, end) byte offsets in the original
    text, n_removed their units.

    Of the units that an Arrow batch of documents holds, the first with each digest goes to the digest's shard, packed; the others are
    repeats at once. So a line that most documents hold is one row a batch, and a shard holds bounded arrays. Shards tell the
    repeats by document; texts are shuffled once, to meet theirs.

    Nulls: a null text is empty and has no units; a null id ranks first. Texts of any length are one row. Rows that repeat an id rank
    by a hash of their text, and rows that repeat both are judged together and share a verdict. Columns whose names clash with the
    result's are replaced; other names are free. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    new = ["n_units", "n_removed", "removed_spans", "kept_sha256", "kept_text"]
    carry = [c for c in (docs.columns if keep is None else keep) if c not in new]
    salt, gone_id, gone_salt, gone = free_names(docs.columns, "salt", "gone_id", "gone_salt", "gone")

    shards = max(input_splits(docs), int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(1 << 31))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), salted.alias("salt"))
    told = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("packed", T.BinaryType()), src.schema["id"], T.StructField("salt", T.LongType()), T.StructField("gone", T.ArrayType(T.LongType()))])
    rows = scratch.keep(src.mapInArrow(lambda x: _digests(x, kind, shards), told), "units", "uncompressed")
    met = rows.filter("packed is not null").select("shard", "packed").repartition(shards, "shard").sortWithinPartitions("shard")
    again = met.mapInArrow(_meet, T.StructType(told.fields[2:])).unionByName(rows.filter("packed is null").select("id", "salt", "gone"))
    spans = scratch.keep(again.groupBy("id", "salt").agg(F.flatten(F.collect_list("gone")).alias("gone")), "gone")
    scratch.drop("units")
    scratch.tidy()

    d = docs.select(*dict.fromkeys([*carry, id_col, text_col])).withColumn(salt, salted)
    d = d.join(spans.select(F.col("id").alias(gone_id), F.col("salt").alias(gone_salt), F.col("gone").alias(gone)), F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(salt) == F.col(gone_salt)), "left").drop(salt, gone_id, gone_salt)
    out = [T.StructField("n_units", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept_sha256", T.StringType())]
    if keep_text:
        out.append(T.StructField("kept_text", T.StringType()))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeats = batch.column(batch.schema.get_field_index(gone))
            for a, b, buf, offs in chunks(batch.column(batch.schema.get_field_index(text_col))):
                part = batch.slice(a, b - a)
                row, start, end, count = units(buf, offs, kind)
                edge = np.searchsorted(row, np.arange(b - a + 1))
                raw, o = buf.tobytes(), offs.tolist()
                removed, spans, digests, texts = [], [], [], []
                for r, g in enumerate(repeats.slice(a, b - a).to_pylist()):
                    body, cut_here, n = raw[o[r] : o[r + 1]], [], 0
                    if g:
                        at = np.sort(np.array(g, np.int64)) + edge[r]
                        lead = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + 1)))
                        size = np.add.reduceat(count[at], lead)
                        close = np.append(lead[1:], len(at)) - 1
                        for x, y in zip(lead[size >= min_words].tolist(), close[size >= min_words].tolist()):
                            cut_here.append([int(start[at[x]]) - o[r], int(end[at[y]]) - o[r]])
                            n += y + 1 - x
                        left, p = [], 0
                        for s, e in cut_here:
                            left.append(body[p:s])
                            p = e
                        body = b"".join(left) + body[p:]
                    removed.append(n)
                    spans.append(cut_here)
                    digests.append(hashlib.sha256(body).hexdigest())
                    if keep_text:
                        texts.append(body.decode())
                more = [pa.array(np.diff(edge).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(digests, pa.string())] + ([pa.array(texts, pa.string())] if keep_text else [])
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in carry] + more, names=[*carry, *(f.name for f in out)])

    return d.mapInArrow(apply, T.StructType([T.StructField(f.name, f.dataType) for f in d.schema.fields if f.name in carry] + out))
