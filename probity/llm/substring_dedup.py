"""Repeated substrings across documents: enhanced suffix arrays with common-prefix interval trees, sharded by content."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, input_splits, join_spread, mix, scan_layout
from .suffix import ranges, repeat_tree

U64 = np.uint64
#: Bytes of the grams whose hashes route strings: long enough that unrelated texts seldom share one.
GRAM = 24
NO_ID = -(1 << 63)
#: Output of the pieces below: a kind, a shard or block, a block, and packed arrays.
ROW = "kind int, at bigint, block bigint, data binary"


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    k, a, b, d = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.binary())], names=["kind", "at", "block", "data"])


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes at every position."""
    n = len(buf) - GRAM + 1
    if n <= 0:
        return np.empty(0, U64)
    data = np.ascontiguousarray(buf)
    word = np.ndarray((len(buf) - 7,), "<u8", data, 0, (1,))
    h = word[:n] * U64(0x9E3779B97F4A7C15)
    h ^= (word[8 : 8 + n] + U64(0x632BE59BD9B4E019)) * U64(0xC2B2AE3D27D4EB4F)
    h ^= (word[16 : 16 + n] + U64(0x2545F4914F6CDD1D)) * U64(0x165667B19E3779F9)
    return mix(h)


def window_minima(buf: np.ndarray, length: int) -> np.ndarray:
    """For every start of a `length`-byte string, the least hash of the grams in it. Equal strings have equal minima."""
    m, width, need = gram_hashes(buf), 1, length - GRAM + 1
    while 2 * width <= need:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if need > width:
        m = np.minimum(m[: len(m) - (need - width)], m[need - width :])
    return m


class Runs:
    """Maximal runs of starts with one minimum inside one text: row, first start in the text, number of starts, minimum; with `looks` also
    a hash of the run's length and of its text's first and last gram, which tells how a minimum's texts differ."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, length: int, step: int = 1 << 20, looks: bool = False):
        parts: list[tuple[np.ndarray, ...]] = []
        n, a = len(offs) - 1, 0
        while a < n:
            b = min(n, max(a + 1, int(np.searchsorted(offs, offs[a] + step, "right")) - 1))
            o = offs[a : b + 1] - offs[a]
            m = window_minima(buf[offs[a] : offs[b]], length)
            if len(m):
                edge = np.zeros(len(m) + 1, np.int32)
                size = np.diff(o)
                big = size >= length
                np.add.at(edge, o[:-1][big], 1)
                np.add.at(edge, o[1:][big] - length + 1, -1)
                good = np.cumsum(edge[:-1]) > 0
                first = good.copy()
                first[1:] &= (m[1:] != m[:-1]) | ~good[:-1]
                first[o[:-1][big]] = True
                s = np.flatnonzero(first)
                row = np.searchsorted(o, s, "right") - 1
                stop = np.minimum(np.append(s[1:], len(m)), o[row + 1] - length + 1)
                look = m[:0]
                if looks:
                    g = gram_hashes(buf[offs[a] : offs[b]])
                    look = mix(g[s] + mix(g[stop + length - 1 - GRAM] + (stop - s).astype(U64)))
                parts.append((row + a, s - o[row], stop - s, m[s], look))
            a = b
        self.row, self.start, self.count, self.low, self.look = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64),) * 3 + (np.empty(0, U64),) * 2


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) -> rows (block, ids, offsets, digests, z): whole documents, about block_bytes of text a row."""
    from pyspark import TaskContext

    serial = TaskContext.get().partitionId() << 28
    z = zstandard.ZstdCompressor(level=3)
    ids, offs, texts, total = [], [0], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal serial, ids, offs, texts, total
        digests = b"".join(hashlib.sha256(t).digest() for t in texts)
        arrays = [pa.array([serial], pa.int64()), *(pa.array([x], pa.binary()) for x in (np.array(ids, np.int64).tobytes(), np.array(offs, np.int64).tobytes(), digests, z.compress(b"".join(texts))))]
        serial += 1
        ids, offs, texts, total = [], [0], [], 0
        return pa.RecordBatch.from_arrays(arrays, names=["block", "ids", "offsets", "digests", "z"])

    for batch in batches:
        keys = batch.column(0).to_pylist()
        for s in range(0, batch.num_rows, 512):
            buf, o = scan_layout(batch.column(1).slice(s, 512))
            raw = buf.tobytes()
            for k, i in enumerate(keys[s : s + 512]):
                ids.append(NO_ID if i is None else i)
                texts.append(raw[o[k] : o[k + 1]])
                total += len(texts[-1])
                offs.append(total)
                if total >= block_bytes or len(ids) >= 50000:
                    yield flush()
    if ids:
        yield flush()


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(row["z"])
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["offsets"], np.int64), np.frombuffer(raw, np.uint8)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(j)[k].as_py() for j, c in enumerate(batch.schema.names)}


def _anchor_keys(runs: Runs, shards: int) -> np.ndarray:
    return (runs.low >> U64(32)) % U64(shards) << U64(32) | (runs.low & U64(0xFFFFFFFF))


def _anchors(batches: Iterator[pa.RecordBatch], length: int, shards: int) -> Iterator[pa.RecordBatch]:
    """A block's distinct minima by shard, 5 bytes each: a byte that says whether two of its documents hold it (1), whether it has several
    texts (2) and six bits of a text's hash, then four of the minimum."""
    for row in _each(batches):
        ids, offs, buf = _open(row)
        runs = Runs(buf, offs, length, looks=True)
        if not len(runs.row):
            continue
        key, doc = _anchor_keys(runs, shards), ids[runs.row]
        order = np.argsort(key, kind="stable")
        key, doc, look = key[order], doc[order], runs.look[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        twice = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)
        one = np.minimum.reduceat(look, first)
        several = np.maximum.reduceat(look, first) != one
        note = twice.astype(np.uint8) | several.astype(np.uint8) << 1 | (one & U64(63)).astype(np.uint8) << 2
        key = key[first]
        cuts = np.searchsorted(key, np.arange(shards + 1, dtype=U64) << U64(32))
        low = key.astype(np.uint32)
        out = [(0, s, row["block"], note[a:b].tobytes() + low[a:b].tobytes()) for s, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if b > a]
        yield _rows(out)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """Rows sorted by `at`, gathered: (at, [(kind, block, data)])."""
    last, held = None, []
    for batch in batches:
        kind, at, block = (batch.column(j).to_pylist() for j in range(3))
        for k in range(batch.num_rows):
            if held and at[k] != last:
                yield last, held
                held = []
            last = at[k]
            held.append((kind[k], block[k], batch.column(3)[k].as_py()))
    if held:
        yield last, held


def _shared(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """Of a shard's minima, which are in more than one document, and which have other texts than their commonest one in `hot` blocks or
    more: bits for each block. A minimum of one text is one segment a block, wherever it is found."""
    for shard, rows in _grouped(batches):
        sizes, notes, values = [], [], []
        for _, _, data in rows:
            n = len(data) // 5
            sizes.append(n)
            notes.append(np.frombuffer(data, np.uint8, n))
            values.append(np.frombuffer(data, np.uint32, n, n))
        value, note = np.concatenate(values), np.concatenate(notes)
        order = np.argsort(value.astype(U64) << U64(6) | (note >> 2), kind="stable")
        v, note = value[order], note[order]
        new = np.concatenate(([True], v[1:] != v[:-1]))
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(v)))
        yes = (count > 1) | (np.maximum.reduceat(note & 1, first) > 0)
        text = np.flatnonzero(new | np.concatenate(([True], note[1:] >> 2 != note[:-1] >> 2)))
        alike = np.add.reduceat((note & 2 == 0).astype(np.int64), text)
        odd = count - np.maximum.reduceat(alike, np.searchsorted(text, first))
        shared, often = np.empty(len(v), bool), np.empty(len(v), bool)
        shared[order], often[order] = np.repeat(yes, count), np.repeat(odd >= hot, count)
        cut, out = np.concatenate(([0], np.cumsum(sizes))).tolist(), []
        for (_, block, _), a, b in zip(rows, cut, cut[1:]):
            out.append((0, shard, block, np.packbits(shared[a:b]).tobytes() + np.packbits(often[a:b]).tobytes()))
        yield _rows(out)


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Spans packed: sorted, starts as differences, compressed."""
    by = np.lexsort((start, doc))
    doc, start, end = (np.asarray(x, np.int64)[by] for x in (doc, start, end))
    return zstandard.ZstdCompressor(level=3).compress(np.stack([np.diff(doc, prepend=0), np.diff(start, prepend=0), end - start]).tobytes())


def _unpacked_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc, start, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64).reshape(3, -1)
    start = np.cumsum(start)
    return np.cumsum(doc), start, start + size


def _alike(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal rows of a byte matrix are neighbours, where each group of them begins, and a hash of each row. Neighbours
    are compared in full; should different rows share a hash, the order is that of the bytes."""
    n, width = strings.shape
    h = np.zeros(n, U64)
    for at in (*range(0, width - 7, 8), width - 8):
        h = mix(h ^ np.ndarray((n,), "<u8", strings, at, (width,)))
    order = np.argsort(h, kind="stable")
    differ = (strings[order[1:]] != strings[order[:-1]]).any(axis=1)
    if (differ & (h[order[1:]] == h[order[:-1]])).any():
        order = np.argsort(strings.view(f"V{width}").ravel(), kind="stable")
        differ = (strings[order[1:]] != strings[order[:-1]]).any(axis=1)
    return order, np.flatnonzero(np.concatenate((np.ones(min(n, 1), bool), differ))), h


def _late(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of ids in groups that begin at `first`, which are over the least of their group."""
    return ids > np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(ids))))


def _strings(buf: np.ndarray, offs: np.ndarray, start: np.ndarray, row: np.ndarray, count: np.ndarray, length: int, unit: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, start in the text, bytes) of every string of `length` bytes that starts in the given runs, `unit` at a time."""
    if not len(row):
        return
    end = np.cumsum(count)
    window = np.lib.stride_tricks.sliding_window_view(buf, length)
    for a in range(0, int(end[-1]), unit):
        k = np.arange(a, min(a + unit, int(end[-1])))
        run = np.searchsorted(end, k, "right")
        q = start[run] + k - (end[run] - count[run])
        yield row[run], q, np.ascontiguousarray(window[offs[row[run]] + q])


def _segments(batches: Iterator[pa.RecordBatch], length: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Text around shared minima, to the minima's shards (kind 0); spans settled inside the block (kind 1); the strings around hot
    minima, one by one, to shards by their own bytes (kind 2).

    A run of starts with one minimum is one segment: all strings of `length` bytes that start there. Segments with equal bytes
    in a block need only the smallest id to travel; the others are covered by it.
    """
    z = zstandard.ZstdCompressor(level=3)
    for row in _each(batches):
        ids, offs, buf = _open(row)
        runs = Runs(buf, offs, length)
        copies = set(row["copies"] or ())
        settled: tuple[list, list, list] = ([], [], [])
        ship: dict[int, list] = {}
        hot = np.empty(0, np.int64)
        if len(runs.row) and row["bits"]:
            key = _anchor_keys(runs, shards)
            distinct, back = np.unique(key, return_inverse=True)
            cuts = np.searchsorted(distinct, np.arange(shards + 1, dtype=U64) << U64(32)).tolist()
            shared, often = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
            for x in row["bits"]:
                a, b = cuts[x["at"]], cuts[x["at"] + 1]
                raw, n = np.frombuffer(x["data"], np.uint8), (b - a + 7) // 8
                shared[a:b], often[a:b] = np.unpackbits(raw[:n], count=b - a) > 0, np.unpackbits(raw[n:], count=b - a) > 0
            skip = np.isin(ids, np.array(sorted(copies), np.int64)) if copies else np.zeros(len(ids), bool)
            take = np.flatnonzero(shared[back] & ~skip[runs.row])
            raw, base = buf.tobytes(), offs
            owner: dict[bytes, list] = {}
            hot, take = take[often[back][take]], take[~often[back][take]]
            rows_, starts, counts, homes = runs.row[take].tolist(), runs.start[take].tolist(), runs.count[take].tolist(), (key[take] >> U64(32)).tolist()
            id_list, base_list = ids.tolist(), base.tolist()
            for r, s, c, home in zip(rows_, starts, counts, homes):
                p = base_list[r] + s
                owner.setdefault(raw[p : p + c + length - 1], [home]).append((id_list[r], r, s))
            for text, (shard, *seen) in owner.items():
                least = min(seen)[0]
                for i, r, q in seen:
                    if i > least:
                        settled[0].append(r)
                        settled[1].append(q)
                        settled[2].append(q + len(text))
                    else:
                        ship.setdefault(shard, []).append((i, r, q, text))
        out = []
        for shard, found in ship.items():
            head = np.array([[i, r, q, len(t)] for i, r, q, t in found], np.int64)
            out.append((0, shard, row["block"], z.compress(np.int64(len(head)).tobytes() + np.ascontiguousarray(head.T).tobytes() + b"".join(x[3] for x in found))))
        # one string each, spread by its own bytes: a common minimum of many texts never meets in one shard
        for r, q, strings in _strings(buf, offs, runs.start[hot], runs.row[hot], runs.count[hot], length):
            order, first, h = _alike(strings)
            late = _late(ids[r[order]], first)
            gone, stay = order[late], order[~late]
            if len(gone):
                out.append((1, row["block"] % shards, row["block"], _spans(r[gone], q[gone], q[gone] + length)))
            home = (h[stay] >> U64(32)) % U64(shards)
            by = np.argsort(home, kind="stable")
            stay, home = stay[by], home[by]
            cuts = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1], [True]))).tolist()
            for a, b in zip(cuts, cuts[1:]):
                k = stay[a:b]
                out.append((2, int(home[a]), row["block"], z.compress(np.stack([ids[r[k]], r[k], q[k]]).tobytes() + strings[k].tobytes())))
        if settled[0]:
            out.append((1, row["block"] % shards, row["block"], _spans(*map(np.array, settled))))
        if out:
            yield _rows(out)


def _repeats(texts: list[bytes], ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the parts of texts that a repeat of at least `length` bytes covers which a text with a smaller id
    holds too, overlapping parts joined."""
    n = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    seq = np.zeros(int(begin[-1]), np.int64)
    body = np.ones(len(seq), bool)
    body[begin[1:] - 1] = False
    seq[body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + n
    seq[~body] = np.arange(n)
    owner = np.repeat(ids, size + 1)
    # the intervals as a tree: each suffix's innermost interval, each interval's parent, the least id inside
    found, _, _, parent, inner, order = repeat_tree(seq, length, separator=n - 1)
    own = owner[order]
    inside = np.flatnonzero(inner >= 0)
    least = np.full(len(parent), np.iinfo(np.int64).max)
    np.minimum.at(least, inner[inside], own[inside])
    lows, above = least.tolist(), parent.tolist()
    for k in range(len(above) - 1, -1, -1):
        if above[k] >= 0 and lows[k] < lows[above[k]]:
            lows[above[k]] = lows[k]
    for k, p in enumerate(above):  # the nearest interval around that has a smaller least id
        if p >= 0 and lows[p] == lows[k]:
            above[k] = above[p]
    # a suffix is covered by its longest repeat that a smaller id holds too: climb from the innermost
    least, up, todo = np.array(lows, np.int64), np.array(above, np.int64), inside
    while len(todo):
        now = inner[todo]
        alone = least[now] >= own[todo]
        todo = todo[alone]
        inner[todo] = up[now[alone]]
        todo = todo[inner[todo] >= 0]
    hit = np.flatnonzero(inner >= 0)
    at, span = order[hit], found[inner[hit]]
    delta = np.bincount(at, minlength=len(seq) + 1) - np.bincount(at + span, minlength=len(seq) + 1)
    covered = np.diff(np.concatenate(([0], (np.cumsum(delta) > 0).astype(np.int8))))
    a, b = np.flatnonzero(covered > 0), np.flatnonzero(covered < 0)
    which = np.searchsorted(begin, a, "right") - 1
    return which, a - begin[which], b - begin[which]


def _least_grams(body: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The minimum that each of the texts laid end to end in `body` was routed by."""
    begin = np.cumsum(size) - size
    hashes = gram_hashes(body)
    cross = ranges(begin[1:] - GRAM + 1, np.full(len(begin) - 1, GRAM - 1))
    hashes[cross] = U64(0xFFFFFFFFFFFFFFFF)
    return np.minimum.reduceat(hashes, begin)


def _covered(batches: Iterator[pa.RecordBatch], length: int, unit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Segments of a shard -> spans by block; spans that blocks settled themselves pass through.

    A shard is held as packed arrays. Its segments are ordered by their minimum and taken in groups of about `unit` bytes of
    text, never parting those of one minimum: only such segments can share strings.
    """
    z = zstandard.ZstdDecompressor()
    for _, rows in _grouped(batches):
        through = [(1, 0, b, d) for k, b, d in rows if k == 1]
        if through:
            yield _rows(through)
        heads, bodies, lows, blocks = [], [], [], []
        yield from _met([(b, d) for k, b, d in rows if k == 2], length)
        for kind, block, data in rows:
            if kind == 0:
                raw = z.decompress(data)
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                head = np.frombuffer(raw, np.int64, 4 * n, 8).reshape(4, n)
                bodies.append(raw[8 + 32 * n :])
                heads.append(head)
                lows.append(_least_grams(np.frombuffer(bodies[-1], np.uint8), head[3]))
                blocks.append(np.full(n, block, np.int64))
        del rows
        if not heads:
            continue
        (ids, row, start, size), low, block = np.concatenate(heads, axis=1), np.concatenate(lows), np.concatenate(blocks)
        body = b"".join(bodies)
        del heads, bodies, lows, blocks
        at = np.cumsum(size) - size
        order = np.argsort(low, kind="stable")
        group = np.cumsum(np.concatenate(([0], low[order][1:] != low[order][:-1])))
        weight = np.cumsum(size[order]) // unit
        # a group goes with the unit its first segment falls into
        share = weight[np.searchsorted(group, group, "left")]
        cuts = np.flatnonzero(np.concatenate(([True], share[1:] != share[:-1], [True]))).tolist()
        spans: list[tuple[np.ndarray, ...]] = []
        for a, b in zip(cuts, cuts[1:]):
            part = order[a:b]
            spans.append(_settle(part, group[a:b], body, at, size, ids, row, start, block, length))
        yield from _by_block(*(np.concatenate(x) for x in zip(*spans)))


def _by_block(where: np.ndarray, r: np.ndarray, s: np.ndarray, e: np.ndarray) -> Iterator[pa.RecordBatch]:
    by = np.argsort(where, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], where[by][1:] != where[by][:-1], [True]))).tolist() if len(by) else [0]
    for a, b in zip(edges, edges[1:]):
        k = by[a:b]
        yield _rows([(1, 0, int(where[k[0]]), _spans(r[k], s[k], e[k]))])


def _met(rows: list[tuple[int, bytes]], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of the single strings sent to a shard that one with a smaller id equals."""
    if not rows:
        return
    z, heads, bodies, blocks = zstandard.ZstdDecompressor(), [], [], []
    for block, data in rows:
        raw = z.decompress(data)
        n = len(raw) // (24 + length)
        heads.append(np.frombuffer(raw, np.int64, 3 * n).reshape(3, n))
        bodies.append(np.frombuffer(raw, np.uint8, n * length, 24 * n).reshape(n, length))
        blocks.append(np.full(n, block, np.int64))
    (ids, row, start), strings, block = np.concatenate(heads, axis=1), np.concatenate(bodies), np.concatenate(blocks)
    order, first, _ = _alike(strings)
    late = order[_late(ids[order], first)]
    yield from _by_block(block[late], row[late], start[late], start[late] + length)


def _settle(part, group, body, at, size, ids, row, start, block, length) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans (block, row, start, end) of the segments in `part`, which holds whole groups of equal minima."""
    code: dict[bytes, int] = {}
    a, n = at[part], size[part]
    which = np.fromiter((code.setdefault(body[x : x + k], len(code)) for x, k in zip(a.tolist(), n.tolist())), np.int64, len(part))
    own, texts = ids[part], list(code)
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, which, own)
    late = own > least[which]
    k = part[late]
    out = [(block[k], row[k], start[k], start[k] + size[k])]
    kind = np.empty(len(texts), np.int64)
    kind[which] = group
    kinds, back = np.unique(kind, return_inverse=True)
    several = np.bincount(back) > 1
    low, high = np.full(len(kinds), np.iinfo(np.int64).max), np.full(len(kinds), np.iinfo(np.int64).min)
    np.minimum.at(low, back, least)
    np.maximum.at(high, back, least)
    members = np.flatnonzero((several & (low < high))[back])
    if len(members):
        text, s, e = _repeats([texts[m] for m in members.tolist()], least[members], length)
        text = members[text]
        # each span of a text, at every place that holds the text's smallest id
        hold = np.flatnonzero(~late)
        hold = hold[np.argsort(which[hold], kind="stable")]
        first, last = np.searchsorted(which[hold], text, "left"), np.searchsorted(which[hold], text, "right")
        k = part[hold[ranges(first, last - first)]] if len(text) else part[:0]
        s, e = np.repeat(s, last - first), np.repeat(e, last - first)
        out.append((block[k], row[k], start[k] + s, start[k] + e))
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def _cut(batches: Iterator[pa.RecordBatch], length: int, with_text: bool, with_spans: bool) -> Iterator[pa.RecordBatch]:
    for row in _each(batches):
        ids, offs, buf = _open(row)
        n = len(ids)
        delta = np.zeros(len(buf) + 1, np.int32)
        for data in row["spans"] or ():
            doc, s, e = _unpacked_spans(data)
            np.add.at(delta, offs[doc] + s, 1)
            np.add.at(delta, offs[doc] + e, -1)
        gone = np.cumsum(delta[:-1]) > 0
        copies = np.isin(ids, np.array(row["copies"] or [NO_ID], np.int64)) & (np.diff(offs) >= length) if row["copies"] else np.zeros(n, bool)
        for r in np.flatnonzero(copies).tolist():
            gone[offs[r] : offs[r + 1]] = True
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = total[offs[1:]] - total[offs[:-1]]
        start = gone.copy()
        start[1:] &= ~gone[:-1]
        inner = offs[:-1][offs[:-1] < len(buf)]
        start[inner] = gone[inner]
        firsts = np.concatenate(([0], np.cumsum(start)))
        spans = firsts[offs[1:]] - firsts[offs[:-1]]
        raw, kept = buf.tobytes(), buf[~gone].tobytes()
        at = (offs - total[offs]).tolist()
        size = np.diff(offs)
        bodies = [kept[a:b] for a, b in zip(at, at[1:])]
        cols = [
            pa.array([None if i == NO_ID else i for i in ids.tolist()], pa.int64()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in bodies], pa.string()),
        ]
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_spans:
            lists: list[list] = [[] for _ in range(n)]
            end = gone.copy()
            end[:-1] &= ~gone[1:]
            last = offs[1:][(offs[1:] > 0)] - 1
            end[last] = gone[last]
            for a, b in zip(np.flatnonzero(start).tolist(), np.flatnonzero(end).tolist()):
                r = int(np.searchsorted(offs, a, "right")) - 1
                lists[r].append([a - int(offs[r]), b + 1 - int(offs[r])])
            cols.append(pa.array(lists, pa.list_(pa.list_(pa.int64()))))
            names.append("removed_spans")
        if with_text:
            cols.append(pa.array(bodies, pa.binary()))
            names.append("kept")
        del raw
        yield pa.RecordBatch.from_arrays(cols, names=names)


def remove_repeats(
    docs: DataFrame,
    length: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = False,
    with_spans: bool = False,
    block_bytes: int = 2 << 20,
    hot_blocks: int = 256,
) -> DataFrame:
    """One row per document: id_col, n_bytes, n_removed, n_spans, kept_sha256 (and removed_spans, kept on request).

    Removed is every byte covered by a `length`-byte string of the document's UTF-8 text that a document with a smaller id holds
    too. Strings are sent to shards by the least hash of the 24-byte grams in them, so all occurrences of one meet:

    1. texts are packed into compressed blocks; 5 bytes of each distinct minimum say in which shard's tables
       it is shared by two documents (a false alarm costs time only) and whether its texts differ;
    2. around shared minima, text is sent to the minimum's shard, once per block for equal pieces, and not at
       all for documents that are whole copies of one with a smaller id;
    3. a shard builds the enhanced suffix array of the different pieces with equal minima, scans the tree of its
       common-prefix intervals with a stack, and reports left-diverse intervals: maximal repeats with all their occurrences;
    4. spans go back to their blocks, where the bytes are cut.

    Minima whose text differs from their commonest one in hot_blocks blocks or more are spread over all shards string by string; one with
    the same text everywhere sends one segment a block to its shard, where the copies are settled by comparing bytes.

    Nulls: a null text is empty; a null id is smaller than all others. Texts shorter than `length` lose nothing. Rows that
    repeat an id count as one document: neither makes the other lose a byte. Ids must be integers. A very long text is a block of its own and
    one task's, at some twenty times its size. Other columns are not read, so their names don't matter. An empty table gives an empty result.
    """
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(least_parts, 2 * input_splits(docs))
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = scratch.keep(src.mapInArrow(lambda x: _blocks(x, block_bytes), "block bigint, ids binary, offsets binary, digests binary, z binary"), "blocks", "uncompressed")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            d = row["digests"]
            ids = np.frombuffer(row["ids"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["block"], np.int64)), pa.array(ids), pa.array([d[k : k + 32] for k in range(0, len(d), 32)], pa.binary())], names=["block", "id", "digest"])

    known = blocks.select("block", "ids", "digests").mapInArrow(listed, "block bigint, id bigint, digest binary")
    known = scratch.keep(known, "known")
    first = known.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")).filter("least < most").select("digest", "least", "n")
    copies = join_spread(known, scratch.keep(first, "first"), ["digest"], "n", known.count()).filter("id > least").groupBy("block").agg(F.collect_set("id").alias("copies"))
    copies = scratch.keep(copies, "copies")

    anchors = blocks.select("block", "ids", "offsets", "z").mapInArrow(lambda x: _anchors(x, length, shards), ROW)
    shared = anchors.repartition(shards, "at").sortWithinPartitions("at").mapInArrow(lambda x: _shared(x, hot_blocks), ROW)
    shared = scratch.keep(shared, "shared")
    scratch.tidy()
    bits = shared.groupBy("block").agg(F.collect_list(F.struct("at", "data")).alias("bits"))
    whole = blocks.select("block", "ids", "offsets", "z").join(bits.join(copies, "block", "left"), "block")
    segments = whole.select("block", "ids", "offsets", "z", "bits", "copies").mapInArrow(lambda x: _segments(x, length, shards), ROW)
    spans = segments.repartition(shards, "at").sortWithinPartitions("at").mapInArrow(lambda x: _covered(x, length), ROW)
    spans = scratch.keep(spans.select("block", "data"), "spans")
    scratch.drop("shared")
    scratch.tidy()
    out = blocks.select("block", "ids", "offsets", "z").join(spans.groupBy("block").agg(F.collect_list("data").alias("spans")), "block", "left").join(copies, "block", "left")
    schema = f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", removed_spans array<array<bigint>>" if with_spans else "") + (", kept binary" if with_text else "")
    named = out.select("block", "ids", "offsets", "z", "spans", "copies").mapInArrow(lambda x: _cut(x, length, with_text, with_spans), schema.replace(f"`{id_col}`", "id", 1))
    return named.withColumnRenamed("id", id_col)
