"""Maximum mean discrepancy of two sets of vectors: exact over tiles of pairs, or by random features with a stated error."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.operators.cells import _matrix, _squares
from probity.operators.neighbours import count_and_blocks
from probity.sources.tables import Store

#: Rows of a tile's side.
TILE = 512
#: Bits of a distance's key that a counting pass resolves.
BITS = 16
#: Distances of a bin, at most, that are listed and sorted.
FINISH = 1 << 16
#: Rows, at most, whose pairs tell the driver where about the median is.
SAMPLE = 1024
#: Different distances near the median that one pair of blocks lists, at most; beyond, the median is found by counting passes.
LISTED = 1 << 21
#: Distances of a tile that are worked on at a time, so that they stay in a core's cache.
CHUNK = 1 << 14
#: Relative move of gamma up to which kernel sums are carried over by their first three derivatives: a pair is then off by 3e-13 at most.
NEAR = 1e-3


def _keys(d: np.ndarray) -> np.ndarray:
    """Squared distances as integers of the same order; none is negative."""
    return np.ascontiguousarray(d).view(np.int64)


def _sides(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(side, its vectors) of a block."""
    side, v = t["side"].to_numpy(), _matrix(t["v"])
    for s in (0, 1):
        if (mine := side == s).any():
            yield s, v[mine]


class Listed:
    """Values with how often they occur; equal ones are put together whenever `most` have come in."""

    def __init__(self, most: int):
        self.most, self.new, self.size = most, [], 0
        self.value, self.n, self.whole = np.empty(0), np.empty(0, np.int64), True

    def add(self, v: np.ndarray) -> None:
        if self.whole and len(v):
            self.new.append(v)
            self.size += len(v)
            if self.size >= self.most:
                self.pack()

    def pack(self) -> None:
        """If over `most` values differ none is kept, and the list is no longer whole."""
        value, at = np.unique(np.concatenate((self.value, *self.new)), return_inverse=True)
        self.n = np.bincount(at, np.concatenate((self.n, np.ones(self.size))), len(value)).astype(np.int64)
        self.value, self.new, self.size = value, [], 0
        if len(value) > self.most:
            self.value, self.n, self.whole = value[:0], self.n[:0], False


class Tiles:
    """All unordered pairs of rows of df(side, id, v), as pairs of blocks (neighbours.block_count); a task holds two blocks and a tile of their product."""

    def __init__(self, df: DataFrame, store: Store, tile: int = TILE):
        self.rows, self.tile, self.store = store.keep(df), tile, store
        self.n = {r[0]: r[1] for r in self.rows.groupBy("side").count().collect()}  # two sides
        _, blocks = count_and_blocks(self.rows, tile)
        self.dealt = d = self.rows.select("side", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("blk"))
        left = d.withColumn("to", F.explode(F.sequence("blk", F.lit(blocks - 1).cast("bigint"))))
        right = d.filter("blk > 0").withColumnRenamed("blk", "to").withColumn("blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("to") - 1)))
        # by number, since few bytes are much work: coalescing by size would leave a task or two a core
        self.left, self.right = (x.repartition(min(2000, blocks * (blocks + 1) // 2), "blk", "to") for x in (left, right))

    def pairs(self, schema: str, f) -> DataFrame:
        """What f(whether it is one block, left block, right block) gives for a pair of blocks, a table of schema."""

        def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            one = key[0].as_py() == key[1].as_py()
            return f(one, left, left if one else right)

        return self.left.groupBy("blk", "to").cogroup(self.right.groupBy("blk", "to")).applyInArrow(work, schema)

    def each(self, schema: str, f) -> DataFrame:
        """What f(iterator over (squared distances of a tile's pairs as a vector, their side sums 0, 1, 2)) gives for a pair of blocks, a table of schema."""
        tile = self.tile

        def tiles(one: bool, left: pa.Table, right: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if not (left.num_rows and right.num_rows):
                return
            (sa, va), (sb, vb) = ((x["side"].to_numpy(), _matrix(x["v"])) for x in (left, right))
            for i in range(0, len(va), tile):
                for j in range(i if one else 0, len(vb), tile):
                    d = _squares(va[i : i + tile], vb[j : j + tile])
                    kind = sa[i : i + tile, None] + sb[None, j : j + tile]
                    yield (d[(pick := np.triu_indices(len(d), 1))], kind[pick]) if one and i == j else (d.ravel(), kind.ravel())

        return self.pairs(schema, lambda one, left, right: f(tiles(one, left, right)))

    def bracket(self) -> tuple[float, float, float]:
        """(lo, about the median, hi) of all squared distances; that the median is within is likely, and for the caller to check.

        The pairs of SAMPLE rows say where to count finely. Then rows are dealt at random into groups of four tiles, and the pairs within groups are counted:
        each row is in as many pairs, so the share of pairs under a value is off by about what as many independent pairs would be; five times that is taken."""
        some = self.rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
        x = np.stack([np.asarray(v, np.float64) for v in some])
        d = _squares(x, x)[np.triu_indices(len(x), 1)]
        if len(x) == sum(self.n.values()):
            cut = sorted({(len(d) - 1) // 2, len(d) // 2})
            d = np.partition(d, cut)
            return float(d[cut[0]]), float(d[cut].mean()), float(d[cut[-1]])
        cut = [int(len(d) * q) for q in (0.3, 0.5, 0.7)]
        a, m, b = (float(y) for y in np.partition(d, cut)[cut])
        if not (np.isfinite(b) and a < b):
            return a, m, b
        group, bins = 4 * self.tile, 1 << BITS

        def count(t: pa.Table) -> pa.Table:
            v, n = _matrix(t["v"]), np.zeros(bins + 2, np.int64)
            for mine in np.array_split(np.random.default_rng(7).permutation(len(v)), -(-len(v) // group)):
                at = (_squares(v[mine], v[mine])[np.triu_indices(len(mine), 1)] - a) * (bins / (b - a))
                n += np.bincount(np.clip(np.nan_to_num(np.floor(at), nan=bins), -1, bins).astype(np.int64) + 1, minlength=bins + 2)
            return pa.table({"bin": np.flatnonzero(n), "n": n[n > 0]})

        got = self.dealt.groupBy("blk").applyInArrow(count, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").toPandas()  # 2^BITS + 2 rows
        ends = np.cumsum(got["n"].to_numpy())
        if not len(ends):
            return a, m, b
        total, edge = int(ends[-1]), lambda k: a + k * (b - a) / bins
        low, mid, high = (int(got["bin"][min(np.searchsorted(ends, total / 2 + k * (2.5 * total**0.5 + 1), "right"), len(ends) - 1)]) for k in (-1, 0, 1))
        return edge(low - 1) if low else 0.0, edge(min(max(mid - 0.5, 0), bins)), edge(high) if high <= bins else np.inf

    def ranked(self, ranks: list[int]) -> list[float]:
        """The squared distances of these ranks among all pairs, by counting passes over ordered keys: no pair is written."""
        state = {r: (0, r) for r in ranks}  # rank -> prefix, rank within the prefix
        out: dict[int, float] = {}
        for level in range(64 // BITS):
            shift = 64 - BITS * (level + 1)
            wanted = np.unique([p for r, (p, _) in state.items() if r not in out])

            def count(tiles, shift=shift, wanted=wanted, level=level):
                total = np.zeros((len(wanted), 1 << BITS), np.int64)
                for d, _ in tiles:
                    k = _keys(d)
                    high = None if level == 0 else k >> (shift + BITS)
                    for at, prefix in enumerate(wanted):
                        total[at] += np.bincount((k if high is None else k[high == prefix]) >> shift & (1 << BITS) - 1, minlength=1 << BITS)
                at, low = np.nonzero(total)
                return pa.table({"bin": (wanted[at] << BITS) + low, "n": total[at, low]})

            # at most 2^BITS bins for each of a few prefixes
            hist = self.each("bin bigint, n bigint", count).groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").toPandas()
            bins, n = hist["bin"].to_numpy(), hist["n"].to_numpy()
            few = []
            for r, (prefix, rest) in state.items():
                if r in out:
                    continue
                mine = np.flatnonzero((bins >> BITS) == prefix) if level else np.arange(len(bins))
                ends = np.cumsum(n[mine])
                at = int(np.searchsorted(ends, rest, "right"))
                state[r] = (int(bins[mine[at]]), rest - int(ends[at] - n[mine[at]]))
                if shift == 0:
                    out[r] = float(np.array([bins[mine[at]]], np.int64).view(np.float64)[0])
                elif n[mine[at]] <= FINISH:
                    few.append(r)
            if few:
                ask = np.unique([state[r][0] for r in few])

                def listed(tiles, shift=shift, ask=ask):
                    found = [np.empty(0, np.int64)]
                    for d, _ in tiles:
                        k = _keys(d)
                        high = k >> shift
                        found += [k[high == p] for p in ask]
                    return pa.table({"k": np.concatenate(found)})

                keys = np.sort(self.each("k bigint", listed).toPandas()["k"].to_numpy())  # FINISH for each rank at most
                for r in few:
                    mine = keys[(keys >> shift) == state[r][0]]
                    out[r] = float(mine[state[r][1] : state[r][1] + 1].view(np.float64)[0])
            if len(out) == len(ranks):
                break
        return [out[r] for r in ranks]


def _gamma(median: float | None) -> float:
    return 1 / median if median and median > 0 else 1.0


def _meet(tiles: Tiles, gamma: float, lo: float, hi: float) -> tuple[np.ndarray, np.ndarray, int, DataFrame | None]:
    """(sums of k, k e, k e^2 and k e^3 by kind, pairs by kind, pairs under lo, (value, n) of the squared distances from lo to hi) over all pairs, each met once.

    e is -gamma times the squared distance, k is exp(e); kinds are side sums. The list is None where a pair of blocks has over LISTED different values."""
    tile, chunk, most = tiles.tile, CHUNK, LISTED
    least, top = -gamma * hi, -gamma * lo if lo > 0 else np.inf

    def work(one: bool, left: pa.Table, right: pa.Table) -> pa.Table:
        sums, n, under, found = np.zeros((3, 4)), np.zeros(3, np.int64), 0, Listed(most)
        room, k = np.empty(tile * tile), np.empty(chunk)
        for s, x in _sides(left):
            q = (x * x).sum(1)
            x = np.column_stack((2 * gamma * x, -gamma * q, np.full(len(x), -gamma)))  # one product gives e
            for t, y in _sides(right):
                if one and t < s:
                    continue
                y = np.column_stack((y, np.ones(len(y)), (y * y).sum(1)))
                for i in range(0, len(x), tile):
                    for j in range(i if one and s == t else 0, len(y), tile):
                        a, b = x[i : i + tile], y[j : j + tile]
                        e = np.dot(a, b.T, out=room[: len(a) * len(b)].reshape(len(a), len(b)))
                        e = e[np.triu_indices(len(e), 1)] if one and s == t and i == j else e.ravel()
                        n[s + t] += len(e)
                        for c in range(0, len(e), chunk):
                            z = e[c : c + chunk]
                            p = np.exp(z, out=k[: len(z)])
                            reach = z >= least
                            inside = z[reach & (z <= top)]
                            under += np.count_nonzero(reach) - len(inside)
                            found.add(inside)
                            sums[s + t, 0] += p.sum()
                            p *= z
                            sums[s + t, 1:3] += p.sum(), p @ z
                            p *= z
                            sums[s + t, 3] += p @ z
        found.pack()
        d = np.maximum(found.value / -gamma, 0)
        kind, zero = np.concatenate((np.arange(5), np.full(len(d), 5))), np.zeros(len(d) + 2)
        cols = [np.concatenate((sums[:, 0], [0, 0], d)), *(np.concatenate((sums[:, c], zero)) for c in (1, 2, 3)), np.concatenate((n, [under, not found.whole], found.n))]
        return pa.table(dict(zip(("kind", "a", "b", "c", "d", "n"), (kind, *cols))))

    out = tiles.store.keep(tiles.pairs("kind bigint, a double, b double, c double, d double, n bigint", work))
    sums, n = np.zeros((3, 4)), np.zeros(5, np.int64)
    for r in out.filter("kind < 5").groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("a", "b", "c", "d", "n"))).collect():  # five rows
        n[r["kind"]] = r["n"]
        if r["kind"] < 3:
            sums[r["kind"]] = r["a"], r["b"], r["c"], r["d"]
    return sums, n[:3], int(n[3]), None if n[4] else out.filter("kind = 5").select(F.col("a").alias("value"), "n")


def _at(values: DataFrame, ranks: list[int]) -> list[float] | None:
    """The values of these ranks in (value, n), where each value counts n times; None if there are not as many."""
    many, total, lo, hi = values.agg(F.count(F.lit(1)), F.sum("n"), F.min("value"), F.max("value")).first()
    if not many or ranks[0] < 0 or ranks[-1] >= total:
        return None
    if lo == hi:
        return [lo] * len(ranks)
    if many > FINISH:
        bins = values.withColumn("bin", F.least(F.floor((F.col("value") - lo) / (hi - lo) * float(1 << BITS)), F.lit(1 << BITS)))
        got = bins.groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").toPandas()  # 2^BITS + 1 rows
        ends = np.cumsum(got["n"].to_numpy())
        at = [int(np.searchsorted(ends, r, "right")) for r in ranks]
        if at[0] != at[-1]:
            return [_at(values, [r])[0] for r in ranks]
        before = int(ends[at[0]] - got["n"][at[0]])
        return _at(bins.filter(F.col("bin") == int(got["bin"][at[0]])).select("value", "n"), [r - before for r in ranks])
    got = values.orderBy("value").toPandas()  # FINISH rows
    return got["value"].to_numpy()[np.searchsorted(np.cumsum(got["n"].to_numpy()), ranks, "right")].tolist()


def mmd_exact(df: DataFrame, tile: int = TILE) -> tuple[float, float, dict]:
    """(mmd, gamma, rows by side) over all pairs of all rows of df(side, id, v), each met once as a rule.

    A bracket of the median is found first. One pass over all pairs counts what is under it, lists what is in it, and sums kernels at about the right gamma
    with three derivatives; the list gives the median of all pairs and the derivatives the sums at its gamma. Where the bracket misses the median or holds too
    much, counting passes (Tiles.ranked) find it; where gamma moves further than NEAR, kernels are summed anew."""
    tiles = Tiles(df, Store(df.sparkSession, "mmd"), tile)
    n = sum(tiles.n.values())
    pairs = n * (n - 1) // 2
    if not pairs:
        return 0.0, _gamma(None), tiles.n
    ranks = sorted({(pairs - 1) // 2, pairs // 2})
    lo, about, hi = tiles.bracket()
    near = _gamma(about)
    sums, kinds, under, listed = _meet(tiles, near, lo * (1 - 1e-12), hi * (1 + 1e-12))
    middle = _at(listed, [r - under for r in ranks]) if listed is not None else None
    middle = middle or tiles.ranked(ranks)
    gamma = _gamma(sum(middle) / len(middle))
    move = gamma / near - 1
    if abs(move) > NEAR:
        (sums, kinds, _, _), move = _meet(tiles, gamma, np.inf, -1.0), 0.0
    k = sums @ np.array([1, move, move**2 / 2, move**3 / 6])
    own0, both, own1 = (float(k[i] / kinds[i]) if kinds[i] else 0.0 for i in range(3))
    return max(0.0, own0 + own1 - 2 * both) ** 0.5, gamma, tiles.n


def mmd_features(df: DataFrame, features: int = 4096, seed: int = 7, sample: int = 1024, sure: float = 0.99) -> tuple[float, float, dict, float]:
    """(mmd, gamma, rows by side, bound) in one pass over all rows of df(side, id, v): the kernel as a mean of `features` random cosines.

    gamma is from all pairs of `sample` rows by hash of their ids, so it is an estimate; given gamma, mmd^2 lies within `bound` of the exact
    one with probability `sure` at least, by Hoeffding's inequality for `features` independent terms in [-8, 8].
    """
    some = df.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"]
    x = np.stack([np.asarray(v) for v in some]) if len(some) else np.empty((0, 1))
    d = _squares(x, x)[np.triu_indices(len(x), 1)]
    gamma = _gamma(float(np.median(d)) if len(d) else None)
    rng = np.random.default_rng(seed)
    w, shift = rng.normal(size=(x.shape[1], features)) * (2 * gamma) ** 0.5, rng.uniform(0, 2 * np.pi, features)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                side, v = b.column(0).slice(a, 1024).to_numpy(zero_copy_only=False), _matrix(b.column(1).slice(a, 1024))
                z = 2**0.5 * np.cos(v @ w + shift)
                for s in np.unique(side):
                    old = total.get(int(s), (0, np.zeros(features), np.zeros(features)))
                    mine = z[side == s]
                    total[int(s)] = (old[0] + len(mine), old[1] + mine.sum(0), old[2] + (mine * mine).sum(0))
        for s, (n, t, q) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([s] * features), pa.array(np.arange(features)), pa.array([n] * features), pa.array(t), pa.array(q)], names=["side", "p", "n", "t", "q"])

    sums = df.select("side", "v").mapInArrow(part, "side bigint, p bigint, n bigint, t double, q double").groupBy("side", "p").agg(*(F.sum(c).alias(c) for c in ("n", "t", "q"))).orderBy("side", "p").toPandas()
    n, t, q = {}, {}, {}
    for s, g in sums.groupby("side"):
        n[s], t[s], q[s] = int(g["n"].iloc[0]), g["t"].to_numpy(), g["q"].to_numpy()
    if not (n.get(0) and n.get(1)):
        return 0.0, gamma, n, 0.0
    own = lambda s: float(((t[s] ** 2 - q[s]) / (n[s] * (n[s] - 1))).mean()) if n[s] > 1 else 0.0  # noqa: E731  without a row's pair with itself
    value = own(0) + own(1) - 2 * float((t[0] * t[1]).mean()) / (n[0] * n[1])
    return max(0.0, value) ** 0.5, gamma, n, float(16 * (np.log(2 / (1 - sure)) / (2 * features)) ** 0.5)
