"""SimHash near-duplicates with Golay-code fuzzy keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_SPACE, Scratch, chunks, input_splits, join_spread, mix, scan_layout, trimmed, words
from .components import connected_components

U64 = np.uint64
#: Generator polynomial of the binary [23,12] Golay code (fixed value).
GOLAY = 0b110001110101
#: The three segments of a 64-bit fingerprint: (shift, bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_LANES = ((np.arange(256, dtype=np.uint8)[:, None] >> np.arange(8, dtype=np.uint8)) & 1).copy().view(U64).ravel()


def fingerprints(texts: Iterator[bytes], shingle: int = 4, seed: int = 42) -> np.ndarray:
    """SimHash of each text: bit j is 1 if it is set in over half of the XXH64 values of all word shingles."""
    digest, hashes, sizes = xxhash.xxh64_intdigest, [], []
    for raw in texts:
        w = raw.lower().split()
        if not w:
            sizes.append(0)
            continue
        n = len(w) - shingle + 1
        joined = b" ".join(w)
        if n <= 1:
            hashes.append(digest(joined, seed))
            sizes.append(1)
            continue
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        starts = [0, *ends[: n - 1].tolist()]
        hashes += [digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
        sizes.append(n)
    return majority(np.array(hashes, U64), np.array(sizes, np.int64))


def majority(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each of texts with size[i] hashes, end to end: bit j is 1 if it is set in over half of them; zero without hashes."""
    out = np.zeros(len(size), U64)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    h = hashes.view(np.uint8).reshape(-1, 8)
    size, first = size[full], np.cumsum(size[full]) - size[full]
    # bits are counted eight to a word, at most 255 shingles at a time, then summed by text
    parts = -(-size // 255)
    begin = np.repeat(first - 255 * (np.cumsum(parts) - parts), parts) + 255 * np.arange(int(parts.sum()))
    lanes = np.add.reduceat(_LANES[h], begin, axis=0)
    counts = np.add.reduceat(lanes.view(np.uint8).reshape(len(begin), 64), np.cumsum(parts) - parts, axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * counts > size[:, None], axis=1, bitorder="little").view(U64).ravel()
    return out


_tables: list[np.ndarray] = []


def golay_index(x: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word; the code is perfect, so it is unique, at most 3 bits off."""
    if not _tables:
        high = np.arange(1 << 12, dtype=np.int64) << 11
        rem = high.copy()
        for k in range(22, 10, -1):
            rem = np.where(rem >> k & 1 == 1, rem ^ (GOLAY << (k - 11)), rem)
        leader, bit = np.zeros(1 << 11, np.int64), 1 << np.arange(23)
        one = np.concatenate(([0], bit))
        errors = np.unique((one[:, None, None] ^ one[None, :, None] ^ one[None, None, :]).ravel())
        weights = np.bitwise_count(errors)
        errors = errors[np.argsort(-weights.astype(int), kind="stable")]
        leader[rem[errors >> 11] ^ (errors & 2047)] = errors
        _tables.extend((rem, leader))
    rem, leader = _tables
    return (x ^ leader[rem[x >> 11] ^ (x & 2047)]) >> 11


def near_indices(x: np.ndarray, bits: int) -> np.ndarray:
    """Codeword indices of x and of all words one bit away, -1 for repeats: any two words at most 2 bits apart share one,
    because the word halfway between them decodes to a single codeword."""
    words = np.concatenate((x[:, None], x[:, None] ^ (1 << np.arange(bits))), axis=1)
    idx = np.sort(golay_index(words), axis=1)
    idx[:, 1:][idx[:, 1:] == idx[:, :-1]] = -1
    idx = -np.sort(-idx, axis=1)
    return idx[:, : max(1, int((idx >= 0).sum(axis=1).max(initial=1)))]


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): two fingerprints at most 4 bits apart share at least one key.

    Four errors fall on three segments. If a segment A has none, of the other two one, B, has at most 2: key (A, index near
    B). Otherwise each has one at least, so two segments have exactly one error: their parities differ in both; a word of even
    parity gives its own index, one of odd parity all near ones, and those of a pair meet.
    """
    fp = fp.astype(U64)
    seg = [((fp >> U64(s)) & U64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    near = [near_indices(x, b) for x, (_, b) in zip(seg, SEGMENTS)]
    own = [golay_index(x) for x in seg]
    odd = [np.bitwise_count(x).astype(np.int64) & 1 for x in seg]
    keys, rows, tag, here = [], [], 0, np.arange(len(fp))
    for a in range(3):
        for b in range(3):
            if a != b:
                k = (((tag << 22) | seg[a])[:, None] << 12) | near[b]
                good = near[b] >= 0
                keys.append(k[good])
                rows.append(np.broadcast_to(here[:, None], k.shape)[good])
                tag += 1
    one = []
    for k in range(3):
        m = np.where(odd[k][:, None] == 1, near[k], -1)
        m[:, 0] = np.where(odd[k] == 1, near[k][:, 0], own[k])
        one.append(m)
    for a, b in ((0, 1), (0, 2), (1, 2)):
        head = ((tag << 1) | (odd[a] ^ odd[b])) << 24
        k = head[:, None, None] | (one[a][:, :, None] << 12) | one[b][:, None, :]
        good = (one[a][:, :, None] >= 0) & (one[b][:, None, :] >= 0)
        keys.append(k[good])
        rows.append(np.broadcast_to(here[:, None, None], k.shape)[good])
        tag += 1
    return np.concatenate(keys), np.concatenate(rows)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links a-b: (node, smallest node), without the smallest itself."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, lab = flat[: len(a)], flat[len(a) :], np.arange(len(nodes))
    while True:
        m = np.minimum(lab[x], lab[y])
        new = lab.copy()
        np.minimum.at(new, lab[x], m)
        np.minimum.at(new, lab[y], m)
        new = new[new]
        while not np.array_equal(nxt := new[new], new):
            new = nxt
        if (new == lab).all():
            break
        lab = new
    moved = lab != np.arange(len(nodes))
    return nodes[moved], nodes[lab[moved]]


def _close(p: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count((p ^ q).view(U64)) <= most


def _links(p: np.ndarray, q: np.ndarray, most: int, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among all verified pairs of fingerprints p and q, in blocks."""
    la, lb = [p[:0]], [p[:0]]
    for i in range(0, len(p), step):
        x, y = np.nonzero(_close(p[i : i + step, None], q[None, :], most))
        a, b = p[i : i + step][x], q[y]
        s = spanning(a[a != b], b[a != b])
        la.append(s[0])
        lb.append(s[1])
    return spanning(np.concatenate(la), np.concatenate(lb))


def _verify(batches: Iterator[pa.RecordBatch], most: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key -> verified links (part 0: a, b) or, for keys of over `block` rows, the rows (part 1: key, fp)."""

    def rows(part: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), part, np.int32)), pa.array(a), pa.array(b)], names=["part", "a", "b"])

    keys: list[np.ndarray] = []
    fps: list[np.ndarray] = []
    held, streaming = 0, None

    def work(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.concatenate((first, [len(k)])))
        la, lb, small = [], [], np.repeat(size, size) <= 32
        for gap in range(1, 32):
            i = np.flatnonzero((k[gap:] == k[:-gap]) & small[gap:])
            if not len(i):
                break
            i = i[_close(f[i], f[i + gap], most)]
            la.append(f[i])
            lb.append(f[i + gap])
        for s, n in zip(first[size > 32].tolist(), size[size > 32].tolist()):
            if n > block:
                yield rows(1, k[s : s + n], f[s : s + n])
                continue
            a, b = _links(f[s : s + n], f[s : s + n], most)
            la.append(a)
            lb.append(b)
        if la:
            a, b = spanning(np.concatenate(la), np.concatenate(lb))
            if len(a):
                yield rows(0, a, b)

    for batch in batches:
        k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if streaming is not None:  # a key that outgrew the block: its rows pass through
            cut = int(np.searchsorted(k, streaming, "right"))
            if cut:
                yield rows(1, k[:cut], f[:cut])
            if cut == len(k):
                continue
            k, f, streaming = k[cut:], f[cut:], None
        keys.append(k)
        fps.append(f)
        held += len(k)
        if held > 50 * block:
            k, f = np.concatenate(keys), np.concatenate(fps)
            cut = int(np.searchsorted(k, k[-1]))
            yield from work(k[:cut], f[:cut]) if cut else ()
            keys, fps, held = [k[cut:]], [f[cut:]], len(k) - cut
            if held > 25 * block:
                yield rows(1, keys[0], fps[0])
                streaming, keys, fps, held = int(k[-1]), [], [], 0
    if held:
        yield from work(np.concatenate(keys), np.concatenate(fps))


def _verify_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, side, fp) sorted by key, i, j: compares block i with block j of a key."""
    held: list[pa.RecordBatch] = []

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        side, f = t.column(3).to_numpy(), t.column(4).to_numpy()
        same = t.column(1)[0].as_py() == t.column(2)[0].as_py()
        a, b = _links(f[side == 0], f[side == 0] if same else f[side == 1], most)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    last = None
    for batch in batches:
        trio = np.stack([batch.column(c).to_numpy() for c in range(3)])
        cuts = np.flatnonzero((trio[:, 1:] != trio[:, :-1]).any(axis=0)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), trio.shape[1]]):
            if e == s:
                continue
            now = tuple(trio[:, s].tolist())
            if held and now != last:
                yield from work(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(s, e - s))
            last = now
    if held:
        yield from work(pa.Table.from_batches(held))


def link_fingerprints(fps: DataFrame, scratch: Scratch, most: int = 4, parts: int = 0, block: int = 4096) -> DataFrame:
    """(a, b) links that connect whatever rows of fps(fp BIGINT), distinct, at most `most` (up to 4) bits apart connect.

    Fingerprints are compared where they share a key; keys of over `block` of them in blocks, one task a pair of blocks. No null is
    expected; an empty table gives no links.
    """
    parts = parts or int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy()
            for s in range(0, len(f), 20000):
                k, r = fuzzy_keys(f[s : s + 20000].view(U64))
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(f[s : s + 20000][r])], names=["key", "fp"])

    keyed = fps.select("fp").mapInArrow(trimmed(expand), "key bigint, fp bigint").repartition(parts, "key").sortWithinPartitions("key")
    found = scratch.keep(keyed.mapInArrow(trimmed(lambda x: _verify(x, most, block)), "part int, a bigint, b bigint"), "found")
    links = found.filter("part = 0").select("a", "b").distinct()
    big = found.filter("part = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if big.isEmpty():
        return links
    nb = big.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).alias("nb"))
    dealt = big.join(nb, "key").withColumn("own", F.expr("pmod(xxhash64(fp), nb)")).withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).cast("bigint").alias("side"), "fp")
    dealt = dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return links.unionByName(dealt.mapInArrow(trimmed(lambda x: _verify_blocks(x, most)), "a bigint, b bigint")).distinct()


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp) of every document; a null text has fingerprint zero, as an empty one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for s in range(0, len(text), 256):
                buf, offs = scan_layout(text.slice(s, 256))
                raw, o = buf.tobytes(), offs.tolist()
                fp = fingerprints((raw[a:b] for a, b in zip(o, o[1:])), shingle, seed)
                yield pa.RecordBatch.from_arrays([ids.slice(s, 256), pa.array(fp.view(np.int64))], names=["id", "fp"])

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return d.mapInArrow(trimmed(scan), T.StructType([d.schema["id"], T.StructField("fp", T.LongType())]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, most: int = 4) -> DataFrame:
    """One row per document: id_col, fingerprint, component_id.

    Equal fingerprints are one node before any search, so a large group of copies costs one row. Keys of Golay
    codeword indices (fuzzy_keys) bring together all fingerprints at most 4 bits apart; candidates are verified on
    the fingerprints; components are found on the links, and each has the smallest id of its documents.

    Nulls: a null text has no words; its fingerprint is zero, as is that of an empty text, and links like any other. A null
    id is ordered before no id (it names a component only if all its ids are null). Texts of fewer words than a shingle are
    one shingle; long ones are one row. Repeated rows stay rows of their component. Other columns are not read, whatever their names. An
    empty table gives an empty result.
    """
    if most > 4:
        raise ValueError("the key scheme proves links up to 4 bits")
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    fps = scratch.keep(fingerprint_table(docs, id_col, text_col, shingle, seed), "fps")
    nodes = scratch.keep(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    parts = max(input_splits(docs), int(spark.conf.get("spark.sql.shuffle.partitions")))
    roots = connected_components(link_fingerprints(nodes, scratch, most, parts), scratch)
    owner = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    comp = owner.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.keep(owner.join(comp, "root").select("fp", "n", "component_id"), "named")
    return join_spread(fps, named, ["fp"], "n", fps.count()).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(buf: np.ndarray, offs: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of all word shingles of a chunk of texts, in order; a text of fewer words is one shingle."""
    _, _, row, h = words(buf, offs, NOT_SPACE)
    n = len(h)
    if not n:
        return row, h
    size = np.bincount(row, minlength=len(offs) - 1)
    place = np.arange(n) - (np.cumsum(size) - size)[row]
    left = size[row] - place
    at = np.flatnonzero((left >= shingle) | (place == 0))
    out = np.zeros(len(at), U64)
    for k in range(shingle):
        out = out * U64(0x9E3779B97F4A7C15) + np.where(left[at] > k, h[np.minimum(at + k, n - 1)] | U64(1), U64(0))
    return row[at], mix(out)


#: Words of a set's bitmap: one bit for the parity of the hashes in each of its buckets.
BITMAP = 8
BITS = [f"b{k}" for k in range(BITMAP)]
#: Words of the longer bitmap that pairs are judged by before their sets meet.
SKETCH = 64


def _parities(values: np.ndarray, cut: np.ndarray, factor: int, words_: int) -> np.ndarray:
    """A row of `words_` 64-bit words for each set values[cut[i]:cut[i+1]]: the parity of the number of hashes in each bucket."""
    width, out = 64 * words_, []
    bucket = (values.astype(U64) * U64(factor) >> U64(65 - width.bit_length())).astype(np.int64)
    for s in range(0, len(cut) - 1, 256):
        c = cut[s : s + 257]
        row = np.repeat(np.arange(len(c) - 1), np.diff(c))
        odd = (np.bincount(bucket[c[0] : c[-1]] + row * width, minlength=(len(c) - 1) * width) & 1).astype(np.uint8)
        out.append(np.packbits(odd.reshape(-1, width), axis=1, bitorder="little").view(np.int64))
    return np.concatenate(out)


def shingle_sets(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(id, fp, node, hs, sketch, b0, b1, ...) for docs(id, text): SimHash of the shingles, hash of the shingle set, the distinct 32-bit
    hashes of the shingles, sorted, and their bitmaps."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in chunks(batch.column(1)):
                row, h = shingle_hashes(buf, offs, shingle)
                fp = majority(h, np.bincount(row, minlength=b - a))
                flat = np.unique(row.astype(U64) << U64(32) | h >> U64(32))
                cut = np.searchsorted(flat, np.arange(b - a + 1, dtype=U64) << U64(32))
                values = flat.astype(np.uint32)
                node = np.array([xxhash.xxh64_intdigest(values[s:e].tobytes()) for s, e in zip(cut.tolist(), cut[1:].tolist())], U64)
                hs = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values.view(np.int32)))
                bits, long = _parities(values, cut, 0xD6E8FEB86659FD93, BITMAP), _parities(values, cut, 0xA0761D6478BD642F, SKETCH)
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * SKETCH), pa.array(long.ravel()))
                cols = [batch.column(0).slice(a, b - a), pa.array(fp.view(np.int64)), pa.array(node.view(np.int64)), hs, sketch, *(pa.array(np.ascontiguousarray(x)) for x in bits.T)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "fp", "node", "hs", "sketch", *BITS])

    schema = [docs.schema["id"], T.StructField("fp", T.LongType()), T.StructField("node", T.LongType()), T.StructField("hs", T.ArrayType(T.IntegerType())), T.StructField("sketch", T.ArrayType(T.LongType()))]
    return docs.mapInArrow(trimmed(scan), T.StructType([*schema, *(T.StructField(c, T.LongType()) for c in BITS)]))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, size of each row) of a list column of 32-bit hashes."""
    size = np.diff(column.offsets.to_numpy()).astype(np.int64)
    return np.repeat(np.arange(len(size)), size), column.flatten().to_numpy().view(np.uint32).astype(np.int64), size


def _signed(h: np.ndarray) -> np.ndarray:
    """32-bit hashes as Spark's INT holds them."""
    return h.astype(np.uint32).view(np.int32).astype(np.int64)


def common_shingles(sets: DataFrame, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) that repeat in a hash sample of rows with about `most` shingles, and how often. They only order the shingles of
    all sets, the common last: pairs are found by any order, by this one from fewer candidates."""
    total = sets.agg(F.coalesce(F.sum(F.size("hs")), F.lit(0))).first()[0]
    some = sets.filter(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(max(1, -(-total // most)))) == 0)
    t = some.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").toArrow()
    h, n = t.column("h").to_numpy().view(np.uint32).astype(np.int64), t.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _in_order(column: pa.Array, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, place, size of each row): each set's hashes from the rarest to the most common, in one order for all sets."""
    row, h, size = _flat(column)
    often, times = common
    n = np.zeros(len(h), np.int64)
    if len(often) and len(h):
        at = np.minimum(np.searchsorted(often, h), len(often) - 1)
        n = np.where(often[at] == h, times[at], 0)
    order = np.lexsort((h, n, row))
    return row, h[order], np.arange(len(h)) - (np.cumsum(size) - size)[row], size


def prefixes(sets: DataFrame, similarity: float, common) -> DataFrame:
    """(key, node) of sets(node, hs): the first shingles of each set. Two sets of that Jaccard similarity share one of these, since
    each holds more shingles before its last `similarity` part than it can lack."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                b = batch.slice(s, 256)
                row, h, place, size = _in_order(b.column(1), common.value)
                keep = place <= size[row] - np.ceil(similarity * size[row] - 1e-6)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(h[keep])), pa.array(b.column(0).to_numpy()[row[keep]])], names=["key", "node"])

    return sets.select("node", "hs").mapInArrow(trimmed(scan), "key bigint, node bigint")


def _columns(batches: Iterator[pa.RecordBatch], carry: int) -> Iterator[tuple[np.ndarray, int]]:
    """Columns of sorted rows batch by batch, each after the last `carry` rows of the one before: (columns, rows seen before)."""
    held = None
    for batch in batches:
        if batch.num_rows:
            c = np.stack([batch.column(j).to_numpy() for j in range(batch.num_columns)])
            seen = 0 if held is None else held.shape[1]
            c = c if held is None else np.concatenate((held, c), axis=1)
            yield c, seen
            held = c[:, max(0, c.shape[1] - carry) :].copy()


def _held_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node) sorted by both -> (node, key) of keys that two nodes hold, each once. One row is held back."""
    told = None  # (key, node) of the last row that was given out
    for c, _ in _columns(batches, 1):
        key, node = c
        i = np.flatnonzero((key[1:] == key[:-1]) & (node[1:] != node[:-1]))
        at = np.unique(np.concatenate((i, i + 1)))
        at = at[np.concatenate(([True], (key[at][1:] != key[at][:-1]) | (node[at][1:] != node[at][:-1])))] if len(at) else at
        if len(at) and told == (int(key[at[0]]), int(node[at[0]])):
            at = at[1:]
        if len(at):
            told = (int(key[at[-1]]), int(node[at[-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(key[at])], names=["node", "key"])


def _held_apart(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Rows (key, root, node) sorted by all three -> (node, key) of keys that nodes of two roots hold. A key's rows wait until a second
    root comes; when more than `most` wait, they are given out in any case."""
    last, first_root, open_, waiting, count = None, None, False, [], 0
    out = lambda c: pa.RecordBatch.from_arrays([pa.array(c[2]), pa.array(c[0])], names=["node", "key"])
    for c, _ in _columns(batches, 0):
        edges = np.flatnonzero(np.concatenate(([True], c[0, 1:] != c[0, :-1], [True])))
        first, end = edges[:-1], edges[1:]
        several = c[1, first] != c[1, end - 1]
        mine = np.repeat(several, end - first)
        k = int(c[0, 0])
        if k == last:  # the first key goes on from the batch before
            a = int(end[0])
            if open_ or several[0] or int(c[1, 0]) != first_root:
                for w in waiting:
                    yield out(w)
                waiting, count, open_ = [], 0, True
                mine[:a] = True
        else:
            waiting, count, open_ = [], 0, False
        if len(first) > 1:
            waiting, count, open_ = [], 0, False
        if mine.any():
            yield out(c[:, mine])
        s = int(first[-1])
        if len(first) > 1 or k != last:
            first_root = int(c[1, s])
            open_ = bool(several[-1])
        last = int(c[0, s])
        if not open_:
            waiting.append(c[:, s:].copy())
            count += c.shape[1] - s
            if count > most:
                for w in waiting:
                    yield out(w)
                waiting, count, open_ = [], 0, True


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])


def search_keys(sets: DataFrame, count: int = 8) -> DataFrame:
    """(key, other, size, node, fp) of sets(node, fp, hs): the Golay keys of the fingerprint, and the least value of each of `count`
    permutations of the shingle hashes. `other` is the least value of another permutation, by which like texts are neighbours."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                b = batch.slice(s, 256)
                row, h, size = _flat(b.column(2))
                has = np.flatnonzero(size)
                if not len(has):
                    continue
                first, node, fp = np.cumsum(size)[has] - size[has], b.column(0).to_numpy()[has], b.column(1).to_numpy()[has]
                least = []
                for k in range(count):
                    x = h.astype(U64) * U64(0x9E3779B97F4A7C15 + 2 * k * 0x1F83D9AB5BE0CD19 & (1 << 64) - 1) >> U64(32)
                    least.append(np.minimum.reduceat(x, first).astype(np.int64) | k << 32)
                key, at = fuzzy_keys(fp.view(U64))
                at = np.concatenate((np.tile(np.arange(len(has)), count), at))
                cols = [np.concatenate((*least, key | 1 << 60)), np.concatenate((*least[1:], *least[:1], least[0][at[len(has) * count :]])), size[has][at], node[at], fp[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "other", "size", "node", "fp"])

    return sets.select("node", "fp", "hs").mapInArrow(trimmed(scan), "key bigint, other bigint, size bigint, node bigint, fp bigint")


def _next_of_key(batches: Iterator[pa.RecordBatch], similarity: float, gaps: int = 2) -> Iterator[pa.RecordBatch]:
    """Rows (key, other, size, node, fp) sorted -> each node of a key with the next ones, where sizes allow the similarity; fingerprints
    that met under a Golay key must be near as well."""
    for c, seen in _columns(batches, gaps):
        key, _, size, node, fp = c
        for gap in range(1, gaps + 1):
            ok = (key[gap:] == key[:-gap]) & (node[gap:] != node[:-gap]) & (np.minimum(size[gap:], size[:-gap]) >= similarity * np.maximum(size[gap:], size[:-gap]) - 1e-6)
            i = np.flatnonzero(ok)
            i = i[(i + gap >= seen) & ((key[i] < 1 << 60) | (np.bitwise_count((fp[i] ^ fp[i + gap]).view(U64)) <= 12))]
            if len(i):
                yield _pairs(node[i], node[i + gap])


#: Keys of a node right before a key that go with it.
BEFORE = 4
WIDE = ["size", "place", *(f"p{k}" for k in range(BEFORE)), *BITS]


def _wide_rows(batches: Iterator[pa.RecordBatch], common) -> Iterator[pa.RecordBatch]:
    """(node, root, hs, keys, BITS) -> a row for each key: key, node, root, the set's size, the key's place in it, the node's keys right before, bitmap."""
    for batch in batches:
        for s in range(0, batch.num_rows, 128):
            b = batch.slice(s, 128)
            row, h, place, size = _in_order(b.column(2), common)
            krow, keys, _ = _flat(b.column(3))
            wanted, own = np.unique(krow << 32 | keys), row << 32 | h
            keep = wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own if len(wanted) else np.zeros(len(own), bool)
            row, h, place = row[keep], h[keep], place[keep]
            before = [np.where(np.concatenate((np.full(min(k, len(row)), -1), row[:-k])) == row, np.concatenate((np.full(min(k, len(row)), -1), h[:-k])), -1) for k in range(1, BEFORE + 1)]
            cols = [_signed(h), *(b.column(j).to_numpy()[row] for j in (0, 1)), size[row], place, *before, *(b.column(4 + k).to_numpy()[row] for k in range(BITMAP))]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["key", "node", "root", *WIDE])


def _can_be_alike(rows: np.ndarray, u: np.ndarray, v: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs u[i], v[i] of rows (node, root, WIDE) under one key: those of different roots whose sets can have that similarity
    and which don't meet under a key before this one as well.

    Sets share no more than what follows the key in either; and at most half of what their sizes sum to above the bits in
    which their bitmaps differ, since each such bit needs a shingle that only one of them holds.
    """
    root, size, rest = rows[1], rows[2], rows[2] - rows[3]
    apart = root[u] != root[v]
    u, v = u[apart], v[apart]
    need = similarity / (1 + similarity) * (size[u] + size[v]) - 1e-6
    ok = np.minimum(rest[u], rest[v]) >= need
    u, v, need = u[ok], v[ok], need[ok]
    bits, before = rows[4 + BEFORE :], rows[4 : 4 + BEFORE]
    differ = np.zeros(len(u), np.int64)
    for b in bits:
        differ += np.bitwise_count((b[u] ^ b[v]).view(U64))
    ok = (size[u] + size[v] - differ) / 2 >= need
    u, v = u[ok], v[ok]
    met = np.zeros(len(u), bool)
    for a in before:
        for b in before:
            met |= (a[u] == b[v]) & (a[u] >= 0)
    return u[~met], v[~met]


def _apart(batches: Iterator[pa.RecordBatch], similarity: float, least: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, side, node, root, WIDE) sorted by key, i, j -> pairs of nodes of block i with block j of a key, if they can be alike."""

    def work(c: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(np.concatenate(([0], (c[:3, 1:] != c[:3, :-1]).any(axis=0))))
        count = np.bincount(group)
        small = count[group] <= 32
        side, row = c[3], c[4:]
        cross = c[1] != c[2]
        for gap in range(1, 32):
            i = np.flatnonzero((group[gap:] == group[:-gap]) & small[gap:])
            if not len(i):
                break
            i = i[~cross[i] | (side[i] != side[i + gap])]
            u, v = _can_be_alike(row, i, i + gap, similarity)
            if len(u):
                yield _pairs(row[0, u], row[0, v])
        first = np.cumsum(count) - count
        for g in np.flatnonzero(count > 32).tolist():
            at = np.arange(first[g], first[g] + count[g])
            x, y = (at[side[at] == 0], at[side[at] == 1]) if cross[at[0]] else (at, at)
            for s in range(0, len(x), 128):
                some = x[s : s + 128]
                u, v = np.repeat(some, len(y)), np.tile(y, len(some))
                if x is y:
                    u, v = u[u < v], v[u < v]
                u, v = _can_be_alike(row, u, v, similarity)
                if len(u):
                    yield _pairs(row[0, u], row[0, v])

    held, size = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(j).to_numpy() for j in range(batch.num_columns)]))
        size += batch.num_rows
        if size > least:
            c = np.concatenate(held, axis=1)
            cut = int(np.flatnonzero((c[:3] != c[:3, -1:]).any(axis=0)).max(initial=-1)) + 1
            if cut:
                yield from work(c[:, :cut])
            held, size = [c[:, cut:]], c.shape[1] - cut
    if size:
        yield from work(np.concatenate(held, axis=1))


def maybe_alike(links: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) that the sizes and bitmaps of sketches(node, size, sketch) don't rule out; see _can_be_alike."""
    side = lambda end, tag: sketches.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}{tag}") for c in ("size", "sketch")))
    both = links.join(side("a", "_a"), "a").join(side("b", "_b"), "b")
    total = F.col("size_a") + F.col("size_b")
    differ = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return both.filter((total - differ) / 2 >= similarity / (1 + similarity) * total - 1e-6).select("a", "b")


def alike(links: DataFrame, sets: DataFrame, similarity: float, most: int = 256, slots: int = 1 << 19) -> DataFrame:
    """The links (a, b) between nodes whose sets(node, hs) have at least that Jaccard similarity.

    Sets of other nodes stay where they are, by a broadcast of at most `slots` hash slots of the nodes. A node with many links is
    dealt over one part for every `most` of them, and its set copied to each part. Empty sets have no links; empty tables give none.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots))
    for end, out in (("a", "ha"), ("b", "hb")):
        used = links.select(slot(end).alias("slot")).distinct()
        some = sets.select("node", "hs").withColumn("slot", slot("node")).join(F.broadcast(used), "slot", "left_semi").drop("slot")
        hot = links.groupBy(F.col(end).alias("node")).agg(F.ceil(F.count(F.lit(1)) / most).alias("deal")).filter("deal > 1")
        dealt = some.join(hot, "node", "left").select("node", "hs", F.explode(F.expr("sequence(0, coalesce(deal, 1) - 1)")).alias("part"))
        many = links.join(hot.withColumnRenamed("node", end), end, "left").withColumn("part", F.expr(f"pmod(xxhash64(a, b, '{end}'), coalesce(deal, 1))")).drop("deal")
        links = many.join(dealt.select(F.col("node").alias(end), "part", F.col("hs").alias(out)), [end, "part"]).drop("part")
    both = F.size(F.array_intersect("ha", "hb"))
    return links.filter((both > 0) & (both >= similarity * (F.size("ha") + F.size("hb") - both) - 1e-9)).select("a", "b")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, block: int = 4096) -> DataFrame:
    """One row per document: id_col, fingerprint, component_id, for copies whose sets of word shingles are `similarity` alike (Jaccard).

    All pairs count, whatever was edited. A text's rarest shingles, its prefix, hold one of every text as alike as that; texts whose
    prefixes share nothing with others' are left out first. Then pairs are compared on their whole sets, and those found alike are
    joined into groups, in two rounds:

    1. neighbours under the Golay keys of their fingerprints and under least hashes of their shingles;
    2. every pair that shares a prefix shingle, is not yet in one group and isn't ruled out by what bounds its similarity from
       above: sizes, the shingle's places, bitmaps.

    Round 1 makes two pairs at most for each text and key; it only saves work for the other, which passes over no pair but those in
    one group or proven apart. Keys of over `block` texts are compared in blocks.

    Rows with equal sets of shingles are one node. A null id is ordered before no id; a null text has no words, as an empty
    one. Documents without words are alike only to each other. Long texts are one row of 4 bytes a word. Repeated rows stay rows
    of their component. Other columns are not read, whatever their names. Empty tables give empty results.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "copies")
    parts = max(input_splits(docs), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = scratch.keep(shingle_sets(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), shingle), "rows")
    ids = scratch.keep(rows.select("id", "fp", "node"), "ids")
    nodes = scratch.keep(ids.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    common = spark.sparkContext.broadcast(common_shingles(rows))
    twice = prefixes(rows, similarity, common).repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(trimmed(_held_twice), "node bigint, key bigint")
    twice = scratch.keep(twice.groupBy("node").agg(F.collect_list(F.col("key").cast("int")).alias("keys")), "twice")
    scratch.tidy()
    sets = scratch.keep(rows.select("node", "fp", "hs", "sketch", *BITS).join(twice, "node").dropDuplicates(["node"]), "sets")
    scratch.drop("twice")
    scratch.drop("rows")
    scratch.tidy()
    sketches = sets.select("node", F.size("hs").cast("bigint").alias("size"), "sketch")

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        some = scratch.keep(maybe_alike(pairs.distinct(), sketches, similarity), f"{name}_pairs")
        links = scratch.keep(alike(some, sets, similarity), f"{name}_links")
        scratch.tidy()
        return links

    near = search_keys(sets).repartition(parts, "key").sortWithinPartitions("key", "other", "size", "node")
    sure = compared(near.mapInArrow(trimmed(lambda x: _next_of_key(x, similarity)), "a bigint, b bigint"), "first")
    roots = connected_components(sure, Scratch(spark, "copies")).select("node", "root")
    rooted = lambda part: part.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keyed = rooted(sets.select("node", "keys")).select(F.explode("keys").alias("key"), "root", "node")
    keyed = keyed.withColumn("key", F.col("key").cast("bigint")).repartition(parts, "key").sortWithinPartitions("key", "root", "node")
    apart = scratch.keep(keyed.mapInArrow(trimmed(_held_apart), "node bigint, key bigint"), "apart")
    crowded = scratch.keep(apart.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).alias("nb")).filter("nb > 1"), "crowded")
    crowded = F.broadcast(crowded) if crowded.count() <= 1 << 20 else crowded
    chosen = rooted(sets.select("node", "hs", *BITS).join(apart.groupBy("node").agg(F.collect_list(F.col("key").cast("int")).alias("keys")), "node"))
    wide = chosen.select("node", "root", "hs", "keys", *BITS).mapInArrow(trimmed(lambda x: _wide_rows(x, common.value)), ", ".join(f"{c} bigint" for c in ("key", "node", "root", *WIDE)))
    wide = wide.join(crowded, "key", "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("own", F.expr("pmod(xxhash64(node), nb)")).withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
    wide = wide.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).cast("bigint").alias("side"), "node", "root", *WIDE)
    wide = wide.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    sure = sure.unionByName(compared(wide.mapInArrow(trimmed(lambda x: _apart(x, similarity)), "a bigint, b bigint"), "rest"))
    roots = connected_components(sure, scratch)
    owner = nodes.join(roots, "node", "left").select("node", "least", "n", F.coalesce("root", "node").alias("root"))
    comp = owner.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.keep(owner.join(comp, "root").select("node", "n", "component_id"), "named")
    for name in ("sets", "nodes", "apart", "crowded", "first_pairs", "first_links", "rest_pairs", "rest_links"):
        scratch.drop(name)
    scratch.tidy()
    return join_spread(ids, named, ["node"], "n", ids.count()).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
