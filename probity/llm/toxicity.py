"""Toxicity by class-conditional Kneser-Ney models that share their lowest counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, chunks, free_names, input_splits, mix, trimmed, words
from .decontaminate import WORD

#: Labelled rows, at most, that the calibration of the score is fitted on.
CALIBRATION_ROWS = 20000
#: Hash slots of the filter of labelled ids that is sent to tasks; a fixed size, so a full filter merely keeps less away.
FILTER = 1 << 21
#: Absolute discount of all counts: an expression that a class has seen no more often falls back on the counts below.
DISCOUNT = 3
#: Shares of a toxic text's words that the toxic model may speak for, the others following the ordinary one; and how the score may grow with
#: the difference. Both are chosen by cross-validation inside the rows that may be learnt from.
SHARES = (0.5, 0.1, 0.03, 0.01, 0.003)
CURVES = {"linear": (lambda x: x, lambda c: c), "asinh": (np.arcsinh, F.asinh)}
#: Rows of the model's tables that are sent to tasks at once; more of them are more passes over the texts.
PART = 2_000_000
#: The word before a text's first.
START = 1
_COUNTS = ("a0", "a1", "b0", "b1", "c0", "c1", "d0", "d1", "ba", "bb")


@dataclass
class Model:
    """Ratios of the classes' likelihoods, toxic to ordinary, in written tables."""

    words: DataFrame  # (w, ev): of words seen more often than the discount
    pairs: DataFrame  # (w, h, ev): of such pairs
    contexts: DataFrame  # (h, ev): ratio of what the classes leave to the counts below after a word
    unseen: float  # ratio of other words
    share: float = SHARES[0]
    curve: str = "linear"
    weights: tuple[float, float] = (0.0, 0.0)  # calibration: slope and intercept


def _fold(id_col: Column, k: int) -> Column:
    return F.pmod(F.floor(F.crc32(id_col.cast("string")) / 4), F.lit(k))


def _slot(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(FILTER))


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, word before, row) of every word, as 64-bit hashes."""
    _, _, row, h = words(buf, offs, WORD)
    w = h.view(np.int64)
    before = np.full(len(w), START, np.int64)
    if len(w):
        before[1:] = np.where(row[1:] == row[:-1], w[:-1], START)
    return w, before, row


def _packed(docs: DataFrame, labelled: np.ndarray) -> DataFrame:
    """Texts compressed before they are shuffled, without most that have no label: `labelled` has a mark for each of FILTER
    hash slots with a labelled id."""
    sent = docs.sparkSession.sparkContext.broadcast(labelled)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            b = b.filter(pa.array(sent.value[b.column(2).to_numpy()]))
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                data = [z.compress((t or "").encode()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], names=["id", "z"])

    return docs.withColumn("slot", _slot("id")).mapInArrow(trimmed(pack), T.StructType([docs.schema["id"], T.StructField("z", T.BinaryType())]))


def _unpacked(column: pa.Array) -> pa.Array:
    z = zstandard.ZstdDecompressor()
    return pa.array([z.decompress(x) for x in column.to_pylist()], pa.large_binary())


def count_pairs(train: DataFrame) -> DataFrame:
    """(w, h, n) counts of words w after words h over train(z, y, held), all rows, summed per task before the shuffle; n is four times the
    count, 1 more for toxic rows and 2 more for held ones. Each text with words also has its start, after nothing. A batch is in order of
    w: rows of a word lie together, so that the shuffle's compression stores it about once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        size = 0

        def flush() -> pa.RecordBatch:
            w, h, code = (np.concatenate(x) for x in held)
            u = mix(h.view(np.uint64) * np.uint64(4) + code)
            u ^= w.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            _, at, n = np.unique(u, return_index=True, return_counts=True)
            by = np.argsort(w[at])
            at, n = at[by], n[by]
            return pa.RecordBatch.from_arrays([pa.array(w[at]), pa.array(h[at]), pa.array(n << 2 | code[at])], names=["w", "h", "n"])

        for batch in batches:
            code = batch.column(1).to_numpy().astype(np.uint8) + 2 * batch.column(2).to_numpy().astype(np.uint8)
            for s in range(0, batch.num_rows, 256):
                for a, b, buf, offs in chunks(_unpacked(batch.column(0).slice(s, 256))):
                    w, h, row = _tokens(buf, offs)
                    full = np.unique(row)
                    of = code[s + a : s + b]
                    for x, more in zip(held, ((w, np.full(len(full), START)), (h, np.zeros(len(full), np.int64)), (of[row], of[full]))):
                        x += more
                    size += len(w) + len(full)
                    if size > 4_000_000:
                        yield flush()
                        held, size = ([], [], []), 0
        if size:
            yield flush()

    return train.select("z", "y", "held").mapInArrow(trimmed(count), "w bigint, h bigint, n bigint")


def _gather(batches: Iterator[pa.RecordBatch], discount: int) -> Iterator[pa.RecordBatch]:
    """Counts sorted by word and word before -> of each word, how often it is seen (a without held rows, b with them, by class), after
    how many different words (c, d; ba, bb in either class); of each pair how often. Words and pairs that no class has seen more often
    than the discount only add to the totals (kind 2). One word's sums and one pair's rows are held, however many rows there are."""
    names = ["kind", "w", "h", *_COUNTS]
    total, carry, word = np.zeros(12, np.int64), None, None  # word: (hash, ten sums)

    def out(kind: int, w: np.ndarray, h: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(w), kind, np.int32)), pa.array(w), pa.array(h), *(pa.array(np.ascontiguousarray(x)) for x in sums)], names=names)

    def finished(w: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept = np.maximum(s[4:8] - discount, 0).sum(axis=1)
        total[:] += np.concatenate((kept, s[4:].sum(axis=1), [(s[8] > 0).sum(), (s[9] > 0).sum()]))
        strong = np.maximum(s[2], s[3]) > discount
        if strong.any():
            yield out(0, w[strong], np.zeros(int(strong.sum()), np.int64), s[:, strong])

    def work(c: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows (w, h, n) of whole pairs."""
        nonlocal word
        w, h, n = c
        code, n = n & 3, n >> 2
        first = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (h[1:] != h[:-1]))))
        by = [np.add.reduceat(np.where(code == k, n, 0), first) for k in range(4)]
        pair = np.stack([by[0], by[1], by[0] + by[2], by[1] + by[3]])
        w, h = w[first], h[first]
        strong = np.maximum(pair[2], pair[3]) > discount
        if strong.any():
            yield out(1, w[strong], h[strong], np.concatenate((pair[:, strong], np.zeros((6, int(strong.sum())), np.int64))))
        start = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        seen = (pair > 0).astype(np.int64)
        s = np.stack([np.add.reduceat(x, start) for x in (*pair, *seen, seen[0] | seen[1], seen[2] | seen[3])])
        w = w[start]
        if word is not None:
            if word[0] == w[0]:
                s[:, 0] += word[1]
            else:
                yield from finished(np.array([word[0]]), word[1][:, None])
        yield from finished(w[:-1], s[:, :-1])
        word = (int(w[-1]), s[:, -1])

    for batch in batches:
        if not batch.num_rows:
            continue
        c = np.stack([batch.column(j).to_numpy() for j in range(3)])
        c = c if carry is None else np.concatenate((carry, c), axis=1)
        last = np.flatnonzero((c[0] != c[0, -1]) | (c[1] != c[1, -1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from work(c[:, :cut])
        carry = c[:, cut:]
    if carry is not None:
        yield from work(carry)
        yield from finished(np.array([word[0]]), word[1][:, None])
    yield out(2, total[10:11], total[11:12], total[:10, None])


def fit(counts: DataFrame, scratch: Scratch, name: str, held: bool, discount: int = DISCOUNT) -> Model:
    """Interpolated Kneser-Ney from gathered counts: pair -> class continuation -> continuation shared by both classes.

    Everything is a table of the corpus's words and pairs; only the totals come to the driver. With `held`, held rows count as well. Without
    rows of both classes nothing counts.
    """
    u, c, both = (("b0", "b1"), ("d0", "d1"), "bb") if held else (("a0", "a1"), ("c0", "c1"), "ba")
    sums = counts.filter("kind = 2").agg(F.sum("w"), F.sum("h"), *(F.sum(x) for x in _COUNTS)).first()
    sums = [x or 0 for x in sums]
    size, kept, seen, either = sums[held], sums[2 + 2 * held : 4 + 2 * held], sums[6 + 2 * held : 8 + 2 * held], sums[10 + held]
    rest = [1 - k / n if n else 1.0 for k, n in zip(kept, seen)]
    ready = min(seen) > 0 and min(rest) > 0
    low = (F.col(both) + 0.5) / F.lit(float(either + 0.5 * (size + 1)))
    over = lambda x: F.greatest(F.col(x) - discount, F.lit(0))
    p = [over(c[k]) / F.lit(float(max(1, seen[k]))) + F.lit(rest[k]) * low for k in (0, 1)]
    known = counts.filter("kind = 0").filter(F.lit(ready)).select("w", F.col(u[0]).alias("u0"), F.col(u[1]).alias("u1"), p[0].alias("p0"), p[1].alias("p1"))
    known = scratch.keep(known, f"{name}_known")
    pairs = counts.filter("kind = 1").select("w", "h", F.col(u[0]).alias("n0"), F.col(u[1]).alias("n1")).filter(F.greatest("n0", "n1") > discount)
    left = pairs.groupBy("h").agg(F.sum(over("n0")).alias("k0"), F.sum(over("n1")).alias("k1"))
    left = left.join(known.select(F.col("w").alias("h"), F.col("u0").alias("t0"), F.col("u1").alias("t1")), "h")
    rest_of = lambda k: F.when(F.col(f"t{k}") > 0, 1 - F.col(f"k{k}") / F.col(f"t{k}")).otherwise(F.lit(1.0))
    q = [F.when(F.col(f"t{k}") > 0, over(f"n{k}") / F.col(f"t{k}")).otherwise(F.lit(0.0)) + rest_of(k) * F.col(f"p{k}") for k in (0, 1)]
    full = pairs.join(left, "h").join(known.select("w", "p0", "p1"), "w").select("w", "h", (q[1] / q[0]).alias("ev"))
    contexts = left.select("h", (rest_of(1) / rest_of(0)).alias("ev"))
    tables = [scratch.keep(df, f"{name}_{what}") for df, what in ((known.select("w", (F.col("p1") / F.col("p0")).alias("ev")), "words"), (full, "pairs"), (contexts, "contexts"))]
    return Model(*tables, rest[1] / rest[0] if ready else 1.0)


def _ratios(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    """values at the wanted ones of sorted keys, `other` for those that are none."""
    if not len(keys):
        return np.full(len(wanted), other)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


def _pair_key(w: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(h.view(np.uint64) * np.uint64(4)) ^ w.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def difference(texts: DataFrame, model: Model, scratch: Scratch, part: int = PART, shares: tuple[float, ...] | None = None) -> DataFrame:
    """(t1, t2, x) of texts(t1, t2, text) with words: the log-likelihood of the whole text by the toxic model, interpolated with the
    ordinary one, less that by the ordinary model, normalised by length: nats in 1000 words; x has one for each of shares (the model's own).

    Every word counts: by its pair's ratio, or its own times what its context leaves to it, or that of unseen words. Tables of over
    `part` rows are dealt by word, and each part is a pass over the texts; contexts, of the words' number at most, go with each.
    """
    sc, unseen, shares = texts.sparkSession.sparkContext, model.unseen, shares or (model.share,)
    parts = max(1, -(-(model.words.count() + model.pairs.count()) // part))
    fetched = lambda df, *names: [x.to_numpy() for x in df.select(*names).toArrow().columns]

    def ordered(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(keys)
        return keys[by], values[by]

    columns = [f"s{i}" for i in range(len(shares))]
    contexts = sc.broadcast(ordered(*fetched(model.contexts, "h", "ev")))

    def one(k: int) -> DataFrame:
        mine = F.pmod(F.col("w"), F.lit(parts)) == k
        w, h, ev = fetched(model.pairs.filter(mine), "w", "h", "ev")
        sent = sc.broadcast((*ordered(*fetched(model.words.filter(mine), "w", "ev")), *ordered(_pair_key(w, h), ev)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words_, word_ev, pairs_, pair_ev = sent.value
            for batch in batches:
                t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for a, b, buf, offs in chunks(batch.column(2)):
                    w, h, row = _tokens(buf, offs)
                    size = np.bincount(row, minlength=b - a)
                    if parts > 1:
                        at = np.flatnonzero(np.mod(w, parts) == k)
                        w, h, row = w[at], h[at], row[at]
                    # a chunk's pairs are looked up once each, in order
                    key, first, back = np.unique(_pair_key(w, h), return_index=True, return_inverse=True)
                    ratio = _ratios(pairs_, pair_ev, key, 0.0)
                    weak = np.flatnonzero(ratio == 0)
                    ratio[weak] = _ratios(words_, word_ev, w[first[weak]], unseen) * _ratios(*contexts.value, h[first[weak]], 1.0)
                    full = np.flatnonzero(size)
                    totals = [np.bincount(row, np.log(1 - v + v * ratio)[back], minlength=b - a)[full] for v in shares]
                    cols = (t1[a + full], t2[a + full], *totals, size[full])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["t1", "t2", *columns, "n"])

        sums = texts.select("t1", "t2", "text").mapInArrow(trimmed(scan), "t1 bigint, t2 bigint, " + ", ".join(f"{c} double" for c in columns) + ", n bigint")
        return sums.groupBy("t1", "t2").agg(*(F.max(c).alias(c) for c in (*columns, "n")))  # copies add up alike

    sums = one(0)
    if parts > 1:
        sums = scratch.keep(sums, "sums_0")
        for k in range(1, parts):
            sums = sums.unionByName(scratch.keep(one(k), f"sums_{k}"))
        sums = sums.groupBy("t1", "t2").agg(*(F.sum(c).alias(c) for c in columns), F.max("n").alias("n"))
    return sums.select("t1", "t2", F.array(*(1000 * F.col(c) / F.col("n") for c in columns)).alias("x"))


def _hashed(docs: DataFrame, text: Column) -> DataFrame:
    return docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"), text.alias("text"))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a logistic regression of y on x, by Newton steps; the slope is never negative."""
    prior = (y.sum() + 0.5) / (len(y) + 5.0)
    w = np.array([0.0, np.log(prior / (1 - prior))])
    if len(y) < 8 or y.min() == y.max():
        return 0.0, float(w[1])
    z, start = np.stack([x, np.ones(len(x))], axis=1), w.copy()
    reg = np.diag([ridge, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + reg, z.T @ (y - p) - reg @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (0.0, float(start[1]))


def choose(x: np.ndarray, y: np.ndarray, folds: int = 4) -> tuple[int, str]:
    """Which column of x (a share each) and which curve give the least log loss on rows left out of the calibration, the first of equals."""
    best = (np.inf, 0, "linear")
    fold = np.arange(len(y)) % folds
    for k in range(x.shape[1]):
        for name, (curve, _) in CURVES.items():
            z, loss = curve(x[:, k]), 0.0
            for f in range(folds):
                slope, base = calibrate(z[fold != f], y[fold != f])
                p = np.clip(1 / (1 + np.exp(-np.clip(slope * z[fold == f] + base, -30, 30))), 1e-9, 1 - 1e-9)
                loss -= float((y[fold == f] * np.log(p) + (1 - y[fold == f]) * np.log(1 - p)).sum())
            if loss < best[0] - 1e-9:
                best = (loss, k, name)
    return best[1:]


def train_model(docs: DataFrame, labels: DataFrame, trainable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Counts of all labelled rows that may be used. A quarter of these, CALIBRATION_ROWS at most, is scored under counts without that quarter;
    on it the share and the curve are chosen by cross-validation, and the score is calibrated. Other rows' labels are never read.

    Null labels are none; of several labels of a document the highest counts; null texts are empty, very long ones are counted a chunk at a time.
    Repeated rows count each; columns other than those named aren't read, so their names don't matter.
    Empty tables or one class give a model in which nothing counts and every score is the smoothed share of toxic rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxic")
    y = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    d = docs.filter(F.lit(True) if trainable is None else trainable).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    y = scratch.keep(y, "labels")
    marks = np.zeros(FILTER, bool)
    marks[y.select(_slot("id").alias("slot")).distinct().toArrow().column(0).to_numpy()] = True
    rows = _packed(d, marks).hint("merge").join(y.hint("merge"), "id").select("id", "z", "y", (_fold(F.col("id"), 4) == 0).cast("int").alias("held"))
    rows = scratch.keep(rows, "rows", "uncompressed")
    scratch.tidy(last=True)
    parts = max(input_splits(docs), int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = count_pairs(rows).repartition(parts, "w").sortWithinPartitions("w", "h")
    counts = scratch.keep(counts.mapInArrow(trimmed(lambda x: _gather(x, DISCOUNT)), "kind int, w bigint, h bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS)), "counts")
    scratch.tidy(last=True)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x.decode() for x in _unpacked(b.column(0)).to_pylist()), b.column(1)], names=["text", "y"])

    bounded = rows.filter("held = 1").orderBy(F.xxhash64("id"), "id").limit(CALIBRATION_ROWS).select("z", "y").mapInArrow(trimmed(texts), "text string, y int")
    bounded = scratch.keep(bounded.select(F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2"), "text", "y"), "calibration")
    scratch.tidy()  # once more, should the shuffled pairs still have been in use
    found = difference(bounded, fit(counts, scratch, "part", False), scratch, shares=SHARES)
    none = F.array(*(F.lit(0.0) for _ in SHARES))
    got = bounded.join(found, ["t1", "t2"], "left").select("t1", "t2", F.coalesce("x", none).alias("x"), "y").orderBy("t1", "t2", "y").toArrow()
    x, y = np.array(got.column("x").to_pylist()).reshape(-1, len(SHARES)), got.column("y").to_numpy().astype(float)
    model = fit(counts, scratch, "all", True)
    k, model.curve = choose(x, y)
    model.share, model.weights = SHARES[k], calibrate(CURVES[model.curve][0](x[:, k]), y)
    for name in ("labels", "rows", "counts", "calibration", "part_known", "part_words", "part_pairs", "part_contexts", "all_known"):
        scratch.drop(name)
    return model


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (None: all), then score and predicted.

    Texts are scanned where they lie, a chunk at a time; every word's ratio is looked up in the model's tables; rows meet their text's sum by
    two 64-bit hashes of it. Scores come from whole texts of any length alone. Nulls: a null text is scored as an empty one, which gets
    what the calibration gives to no difference. Repeated rows get equal scores. Columns named score or predicted are replaced; other
    names are free. Empty tables give empty results.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    t1, t2, x = free_names(docs.columns, "t1", "t2", "x")
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = _hashed(docs, text)
    found = difference(hashed, model, Scratch(docs.sparkSession, "toxic_sums"))
    found = found.select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("x")[0].alias(x))
    d = docs.select(*keep, F.xxhash64(text).alias(t1), F.xxhash64(text, F.lit(1)).alias(t2)).join(found, [t1, t2], "left")
    slope, base = model.weights
    z = F.coalesce(F.col(x), F.lit(0.0))
    score = 1 / (1 + F.exp(-(F.lit(slope) * CURVES[model.curve][1](z) + F.lit(base))))
    return d.withColumn(x, score).select(*keep, F.col(x).alias("score"), (F.col(x) >= threshold).cast("int").alias("predicted"))


def held_out(id_col: Column, part: int = 2, of: int = 4) -> Column:
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(of)) == part
