"""Search for patches that turn any image into one class, without gradients, over a model given as a function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.operators.models import trigger_candidates

#: Where a patch is put: the corners and the middle.
PLACES = ("top-left", "top-right", "bottom-left", "bottom-right", "center")
FILLS = ("dark", "bright", "checker", "stripes")


def stamp(x: np.ndarray, side: int, place: str, fill: str) -> np.ndarray:
    """Images x (n, height, width, channels) in [0, 1] with a square patch."""
    h, w = x.shape[1:3]
    side = min(side, h, w)
    row = 0 if place.startswith("top") else h - side if place.startswith("bottom") else (h - side) // 2
    col = 0 if place.endswith("left") else w - side if place.endswith("right") else (w - side) // 2
    i, j = np.indices((side, side))
    patch = {"dark": 0.0 * i, "bright": 1.0 + 0.0 * i, "checker": (i + j) % 2 * 1.0, "stripes": j % 2 * 1.0}[fill]
    out = x.copy()
    out[:, row : row + side, col : col + side] = patch[None, :, :, None]
    return out


def search_triggers(probes: DataFrame, predict: Callable[[np.ndarray], np.ndarray], classes: int, sizes: tuple[int, ...] = (2, 3, 4, 6, 8, 12, 16), success: float = 0.9) -> DataFrame:
    """(target_class, side, place, fill, mask_l1, attack_success_rate, coverage) for each class: the smallest patch that sends `success` of the other
    classes' probes there, or else the best of the largest.

    probes(height, width, channels, pixels): doubles in [0, 1], row by row, of one shape. predict gives logits (n, classes) of images (n, height,
    width, channels); it is sent to tasks, which stamp and judge a batch of probes at once. Sizes ascend, one pass over the probes each, for
    classes still open; a pass brings one row a class and patch to the driver. No class has a row without probes of others.
    """
    best: dict[int, tuple] = {}
    open_ = set(range(classes))
    area = 1.0
    for side in sorted(sizes):
        if not open_:
            break

        def judge(batches: Iterator[pd.DataFrame], side=side, wanted=tuple(sorted(open_))) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for shape, g in pdf.groupby(["height", "width", "channels"]):
                    x = np.stack([np.asarray(p, float).reshape(shape) for p in g["pixels"]])
                    was, rows = predict(x).argmax(1), []
                    for place in PLACES:
                        for fill in FILLS:
                            now = predict(stamp(x, side, place, fill)).argmax(1)
                            rows += [(c, place, fill, int(((now == c) & (was != c)).sum()), int((was != c).sum()), min(1.0, side * side / (shape[0] * shape[1]))) for c in wanted]
                    yield pd.DataFrame(rows, columns=["c", "place", "fill", "hits", "n", "coverage"])

        got = probes.select("height", "width", "channels", "pixels").mapInPandas(judge, "c int, place string, fill string, hits bigint, n bigint, coverage double")
        got = got.groupBy("c", "place", "fill").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"), F.max("coverage").alias("coverage"))
        for r in got.filter("n > 0").orderBy(F.desc(F.col("hits") / F.col("n")), "place", "fill").collect():  # classes x patches
            rate, area = r["hits"] / r["n"], r["coverage"]
            if r["c"] in open_ and (r["c"] not in best or best[r["c"]][0] != side):
                best[r["c"]] = (side, r["place"], r["fill"], float(side * side), rate, area)
        open_ -= {c for c in open_ if c in best and best[c][4] >= success}
    rows = [(c, *v) for c, v in sorted(best.items())]
    return probes.sparkSession.createDataFrame(rows, "target_class int, side int, place string, fill string, mask_l1 double, attack_success_rate double, coverage double")


def find_backdoors(probes: DataFrame, predict: Callable[[np.ndarray], np.ndarray], classes: int, **search) -> DataFrame:
    """trigger_candidates over search_triggers: a class is suspect if its patch is far smaller than the other classes' and works."""
    return trigger_candidates(search_triggers(probes, predict, classes, **search))
