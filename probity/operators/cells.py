"""An index of vectors by cells around fitted centres: nearest neighbours without meeting all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probity.sources.tables import Store

#: Rows that centres are fitted on, at most: those of the smallest hashes of their ids.
SAMPLE = 16384
#: Cells, at most, so that centres of any dimension up to a few thousand fit a task.
CELLS = 4096
#: Rows of a block and queries of a pack.
BLOCK = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0)


def fit_centres(x: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's means of the sample, from its first distinct rows; an empty cell keeps its centre."""
    centre = np.unique(x, axis=0)
    centre = centre[np.linspace(0, len(centre) - 1, min(cells, len(centre))).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([_squares(x[a : a + 2048], centre).argmin(1) for a in range(0, len(x), 2048)])
        n = np.bincount(own, minlength=len(centre))
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        centre[n > 0] = sums[n > 0] / n[n > 0, None]
    return centre


def best(q: np.ndarray, qi: np.ndarray, t: np.ndarray, ti: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, squared distance) of the k nearest rows of t for each row of q, itself left out, ties by the smaller id.

    A matrix product picks those that can be among the k; their distances are then taken from differences, so that equal vectors tie."""
    out = ([], [], [])
    for i, d in enumerate(_squares(q, t)):
        d[ti == qi[i]] = np.inf
        m = min(k, int(np.isfinite(d).sum()))
        if m:
            cut = np.partition(d, m - 1)[m - 1]
            near = np.flatnonzero(d <= cut + 1e-9 * (cut + (q[i] @ q[i])))
            exact = ((t[near] - q[i]) ** 2).sum(1)
            order = np.lexsort((ti[near], exact))[:m]
            out[0].append(np.repeat(qi[i : i + 1], m))
            out[1].append(ti[near[order]])
            out[2].append(exact[order])
    return tuple(np.concatenate(x) if x else np.empty(0) for x in out)


def enough_probes(x: np.ndarray, centre: np.ndarray, k: int = 10, asked: int = 256, recall: float = 0.97) -> int:
    """Nearest cells to search for that share of the k nearest rows of the sample, judged by `asked` of its rows."""
    if len(x) < 2:
        return 1
    own = np.concatenate([_squares(x[a : a + 2048], centre).argmin(1) for a in range(0, len(x), 2048)])
    at = np.linspace(0, len(x) - 1, min(asked, len(x))).astype(int)
    d = _squares(x[at], x)
    d[np.arange(len(at)), at] = np.inf
    near = np.argsort(d, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(_squares(x[at], centre), axis=1), axis=1)  # of each cell, by its centre's distance
    return int(np.quantile(np.take_along_axis(place, own[near], 1), recall, method="higher")) + 1


class CellIndex:
    """All rows of df that have a vector, each in the cell of its nearest centre; vectors are of one length.

    Centres are fitted on SAMPLE rows at most; every row is indexed. Blocks hold BLOCK rows or so: crowded cells are cut by a hash of
    the id, so a cell with a third of all rows is many blocks. Only centres, sizes and radii, CELLS rows at most, are on the driver.
    """

    def __init__(self, df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE, block_rows: int = BLOCK):
        self.store = Store(df.sparkSession, "cells")
        self.block_rows = block_rows
        src = df.filter(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
        self.id_type = src.schema["id"].dataType.simpleString()
        src = self.store.keep(src)
        some = src.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"]
        x = np.stack([np.asarray(v) for v in some]) if len(some) else np.empty((0, 0))
        self.n = src.count()
        wanted = cells or int(min(CELLS, max(1, self.n**0.5), max(1, len(x) // 8)))
        self.centres = centre = fit_centres(x, wanted) if len(x) else x
        self.probes = enough_probes(x, centre)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    v = _matrix(b.column(1))
                    own = _squares(v, centre).argmin(1)
                    far = np.sqrt(((v - centre[own]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32)), pa.array(far)], names=["id", "v", "cell", "far"])

        self.rows = self.store.keep(src.mapInArrow(place, f"id {self.id_type}, v array<double>, cell int, far double"))
        self.radius, self.size = np.zeros(len(centre)), np.zeros(len(centre), np.int64)
        for r in self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():  # CELLS at most
            self.radius[r["cell"]], self.size[r["cell"]] = r["far"], r["n"]
        self.blocks = self.store.keep(self._packed(self.rows, self.size).select("cell", F.col("r.id").alias("ti"), F.col("r.v").alias("tv")))

    def _packed(self, rows: DataFrame, size: np.ndarray) -> DataFrame:
        """rows(cell, id, v) in packs of about block_rows of a cell."""
        cut = rows.sparkSession.createDataFrame([(c, int(-(-n // self.block_rows))) for c, n in enumerate(size.tolist()) if n], "cell int, cut int")
        sub = F.pmod(F.xxhash64("id"), F.col("cut"))
        return rows.join(F.broadcast(cut), "cell").groupBy("cell", sub.alias("sub")).agg(F.collect_list(F.struct("id", "v")).alias("r"))

    def _meet(self, probes: DataFrame, k: int) -> DataFrame:
        """(id, neighbour, distance2): k candidates for each row of probes(id, v, cell) from each block of its cell."""
        probes = self.store.keep(probes)
        size = np.zeros(len(self.centres), np.int64)
        for r in probes.groupBy("cell").count().collect():  # CELLS at most
            size[r["cell"]] = r["count"]
        asked = self._packed(probes, size).select("cell", F.col("r.id").alias("qi"), F.col("r.v").alias("qv"))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    qi, qv, ti, tv = (b.column(c)[r].values for c in range(4))
                    ids, near, d2 = best(_matrix(qv), qi.to_numpy(zero_copy_only=False), _matrix(tv), ti.to_numpy(zero_copy_only=False), k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, qi.type), pa.array(near, qi.type), pa.array(d2, pa.float64())], names=["id", "neighbour", "distance2"])

        return asked.join(self.blocks, "cell").select("qi", "qv", "ti", "tv").mapInArrow(work, f"id {self.id_type}, neighbour {self.id_type}, distance2 double")

    def _rank(self, found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("id").orderBy("distance2", "neighbour")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def search(self, queries: DataFrame | None = None, k: int = 10, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(id, neighbour, distance2, rank) of the k nearest rows of each of queries(id, v), or of every row; a row isn't its own neighbour.

        The `probes` cells of the nearest centres are searched, as many as the sample asks for (enough_probes) if not given. With `exact`, so are in a second round all cells that by the triangle
        inequality can hold one as near as the k-th found, so nothing is lost; without, recall depends on probes. Ties by the smaller id.
        """
        q = (self.rows if queries is None else queries.filter(F.col("v").isNotNull())).select("id", "v")
        centre, radius, size = self.centres, self.radius, self.size
        probes = min(probes or self.probes, len(centre))
        kind = f"id {self.id_type}, v array<double>, cell int"

        def rows(b: pa.RecordBatch, r: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            at = pa.array(r)
            return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(c.astype(np.int32))], names=["id", "v", "cell"])

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows and probes:
                    c = np.argsort(_squares(_matrix(b.column(1)), centre), axis=1, kind="stable")[:, :probes]
                    yield rows(b, np.repeat(np.arange(b.num_rows), probes), c.ravel())

        found = self.store.keep(self._meet(q.mapInArrow(first, kind), k))
        if not exact:
            return self._rank(found, k)
        reach = self._rank(found, k).groupBy("id").agg(F.when(F.count(F.lit(1)) == k, F.sqrt(F.max("distance2"))).alias("reach"))
        reach = q.join(reach, "id", "left").select("id", "v", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    d = np.sqrt(_squares(_matrix(b.column(1)), centre))
                    far = b.column(2).to_numpy()
                    open_ = (d - radius[None, :] <= far[:, None] * (1 + 1e-9) + 1e-9) & (size > 0)[None, :]
                    np.put_along_axis(open_, np.argsort(d * d, axis=1, kind="stable")[:, :probes], False, axis=1)
                    yield rows(b, *np.nonzero(open_))

        # cells that were probed may differ where two centres are equally far: their rows may come twice, and count once
        more = self._meet(reach.mapInArrow(rest, kind), k)
        return self._rank(found.unionByName(more).distinct(), k)


def indexed(df: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", probes: int | None = None, exact: bool = False, **build) -> DataFrame:
    """The k nearest other rows of every row by a CellIndex, with the columns of neighbours.nearest."""
    return CellIndex(df, id_col, vector, **build).search(k=k, probes=probes, exact=exact)
