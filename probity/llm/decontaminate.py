"""Benchmark decontamination with one FM-index per training shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import LOWER, chunks, free_names, trimmed, words
from .suffix import FMIndex

#: Words of the item alphabet: digits, letters after lower-casing A-Z, and every byte of non-ASCII characters.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


class PhraseBook:
    """Test phrases of a block of items: every window of `window` words, or the whole of a shorter item."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        phrases: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            low = LOWER[np.frombuffer(text, np.uint8)] if text else np.empty(0, np.uint8)
            raw = low.tobytes()
            s, e, _, _ = words(low, np.array([0, len(low)]), WORD)
            toks = [raw[a:b] for a, b in zip(s.tolist(), e.tolist())]
            for i in range(max(1, len(toks) - window + 1) if toks else 0):
                phrases.setdefault(tuple(toks[i : i + window]), set()).add(item)
        vocab = sorted({w for p in phrases for w in p})
        joined = np.frombuffer(b"".join(vocab), np.uint8)
        offs = np.concatenate(([0], np.cumsum([len(w) for w in vocab], dtype=np.int64)))
        hashes = words(joined, offs, WORD)[3] if vocab else np.empty(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, ids = hashes[order], {vocab[int(i)]: k + 2 for k, i in enumerate(order)}
        self.vocab = [vocab[int(i)] for i in order]
        self.sigma = len(vocab) + 2  # 0 ends the text, 1 parts runs
        self.lengths = np.array([len(p) for p in phrases], np.int64)
        self.rows = np.zeros((len(phrases), window), np.int64)
        for r, p in enumerate(phrases):
            self.rows[r, window - len(p) :] = [ids[w] for w in p]
        self.items = [sorted(x) for x in phrases.values()]
        self.least = int(self.lengths.min()) if len(phrases) else 0

    def hits(self, buf: np.ndarray, offs: np.ndarray):
        """Words of a shard (starts, ends, rows) and all occurrences (first word, phrase)."""
        starts, ends, row, h = words(buf, offs, WORD)
        none = np.empty(0, np.int64)
        if not len(self.lengths) or not len(h):
            return starts, ends, row, none, none
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        # only runs of item words that are as long as the shortest phrase can hold one
        cut = np.concatenate(([True], (row[1:] != row[:-1]) | (known[1:] != known[:-1])))
        first = np.flatnonzero(cut)
        size = np.diff(np.concatenate((first, [len(h)])))
        good = known[first] & (size >= self.least)
        first, size = first[good], size[good]
        if not len(first):
            return starts, ends, row, none, none
        where = np.repeat(first - np.concatenate(([0], np.cumsum(size + 1)[:-1])), size + 1) + np.arange(int((size + 1).sum()))
        seq = np.where(np.isin(np.arange(len(where)), np.cumsum(size + 1) - 1), 1, at[np.minimum(where, len(at) - 1)] + 2)
        index = FMIndex(seq, self.sigma)
        lo, hi = index.find(self.rows, self.lengths)
        found = np.flatnonzero(hi > lo)
        count = hi[found] - lo[found]
        phrase = np.repeat(found, count)
        ranks = np.repeat(lo[found] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
        pos = where[index.locate(ranks)] if len(ranks) else none
        # words were matched by 64-bit hashes; compare the bytes themselves
        raw, ok = LOWER[buf].tobytes(), np.ones(len(pos), bool)
        for p in np.unique(phrase).tolist():
            want = [self.vocab[i - 2] for i in self.rows[p, self.window - self.lengths[p] :].tolist()]
            for k in np.flatnonzero(phrase == p).tolist():
                q = int(pos[k])
                ok[k] = all(raw[starts[q + j] : ends[q + j]] == w for j, w in enumerate(want))
        return starts, ends, row, pos[ok], phrase[ok]


def item_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[PhraseBook]:
    """The items in blocks of at most block_bytes of text (a longer item is a block), so that what is broadcast is bounded."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        t = (r[1] or "").encode()
        if block and size + len(t) > block_bytes:
            yield PhraseBook(block, window)
            block, size = [], 0
        block.append(("null" if r[0] is None else str(r[0]), t))
        size += len(t)
    yield PhraseBook(block, window)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 8,
    min_items: int = 2,
    text_col: str = "text",
    keep: list[str] | None = None,
    cut_text: bool = False,
    shard_bytes: int = 4 << 20,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """Columns `keep` of docs (None: all), then n_words, n_hit, n_items, items_sha256, contaminated, leak_spans, clean_text.

    Texts are read in shards of about shard_bytes. A shard's words are encoded in the items' alphabet, runs that can hold
    a phrase are indexed (FM-index: wavelet ranks over the transformed text, sampled suffix positions), all phrases
    are searched backward in step, occurrences are located, and overlapping ones are merged into spans: leak_spans
    holds (start, end) byte offsets in the UTF-8 text; clean_text (with cut_text) is the text without them. Benchmark items
    come in blocks of block_bytes, each a pass over the documents; nothing else is broadcast. No shuffle.

    Nulls: a null text has no words; a null item text has none either, and a null item_id is written as 'null' in the
    digest. An item of no words never occurs. Item ids of any type count as their text. Repeated documents are judged row by row. A text
    longer than a shard is a shard of its own. Columns of docs whose names clash with the result's are replaced; other
    names are free. Empty tables give empty results, an empty benchmark no hits.
    """
    spark = docs.sparkSession
    inner = free_names(docs.columns, "spans", "items")
    keep = [c for c in (docs.columns if keep is None else keep)]
    new = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("leak_spans", T.ArrayType(T.ArrayType(T.LongType())))]
    if cut_text:
        new.append(T.StructField("clean_text", T.StringType()))
    fixed = {f.name for f in new}
    carry = [c for c in keep if c not in fixed]
    df = docs.select(*dict.fromkeys([*carry, text_col]))
    books = list(item_blocks(benchmark, window, block_bytes))
    for k, book in enumerate(books):
        last = k == len(books) - 1
        old = [f for f in df.schema.fields if f.name not in inner]
        names = [f.name for f in old if not last or f.name in carry]
        mid = [T.StructField(inner[0], T.ArrayType(T.ArrayType(T.LongType()))), T.StructField(inner[1], T.ArrayType(T.StringType()))]
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in old if f.name in names] + (new if last else mid))
        sent = spark.sparkContext.broadcast(book)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, names=names, last=last) -> Iterator[pa.RecordBatch]:
            book = sent.value
            for batch in batches:
                text = batch.column(batch.schema.get_field_index(text_col))
                for a, b, buf, offs in chunks(text, shard_bytes):
                    part = batch.slice(a, b - a)
                    more = _judge(book, part, buf, offs, min_items, cut_text, last, inner)
                    yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in names] + [x for _, x in more], names=names + [c for c, _ in more])

        df = df.mapInArrow(trimmed(scan), schema)
    return df


def _judge(book: PhraseBook, part: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray, min_items: int, cut_text: bool, last: bool, inner: list[str]):
    n = len(offs) - 1
    starts, ends, row, pos, phrase = book.hits(buf, offs)
    length = book.lengths[phrase] if len(phrase) else phrase
    delta = np.zeros(len(starts) + 1, np.int64)
    np.add.at(delta, pos, 1)
    np.add.at(delta, pos + length, -1)
    hit = np.cumsum(delta[:-1]) > 0
    items: list[set] = [set() for _ in range(n)]
    for r, p in set(zip(row[pos].tolist(), phrase.tolist())):
        items[r].update(book.items[p])
    spans: list[list] = [[] for _ in range(n)]
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    newrow = np.flatnonzero(hit[1:] & hit[:-1] & (row[1:] != row[:-1])) + 1
    first = np.sort(np.concatenate((np.flatnonzero(edge > 0), newrow)))
    final = np.sort(np.concatenate((np.flatnonzero(edge < 0), newrow))) - 1
    for f, e in zip(first.tolist(), final.tolist()):
        r = int(row[f])
        spans[r].append([int(starts[f] - offs[r]), int(ends[e] - offs[r])])
    earlier = part.schema.get_field_index(inner[0])
    if earlier >= 0:
        was, had = part.column(earlier).to_pylist(), part.column(part.schema.get_field_index(inner[1])).to_pylist()
        for r in range(n):
            items[r].update(had[r])
            spans[r] = _merge(spans[r] + was[r])
    kind = pa.list_(pa.list_(pa.int64()))
    if not last:
        return [(inner[0], pa.array(spans, kind)), (inner[1], pa.array([list(x) for x in items], pa.list_(pa.string())))]
    n_words = np.bincount(row, minlength=n)
    n_hit = np.zeros(n, np.int64)
    at = starts + 0
    for r in range(n):
        if spans[r]:
            a, b = np.searchsorted(row, [r, r + 1])
            for s, e in spans[r]:
                x, y = np.searchsorted(at[a:b] - offs[r], [s, e])
                n_hit[r] += y - x
    digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    out = [("n_words", pa.array(n_words, pa.int64())), ("n_hit", pa.array(n_hit, pa.int64())), ("n_items", pa.array([len(x) for x in items], pa.int64())), ("items_sha256", pa.array(digest, pa.string())), ("contaminated", pa.array([len(x) >= min_items for x in items], pa.bool_())), ("leak_spans", pa.array(spans, kind))]
    if cut_text:
        raw, cleaned = buf.tobytes(), []
        for r in range(n):
            p, keep = int(offs[r]), []
            for s, e in spans[r]:
                keep.append(raw[p : int(offs[r]) + s])
                p = int(offs[r]) + e
            cleaned.append((b"".join(keep) + raw[p : int(offs[r + 1])]).decode())
        out.append(("clean_text", pa.array(cleaned, pa.string())))
    return out


def _merge(spans: list[list[int]]) -> list[list[int]]:
    """Overlapping byte spans joined; spans of neighbouring words stay apart, which changes no count and no word."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out
