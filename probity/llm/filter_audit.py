"""How filters of a corpus act on each other in every order of applying them, by adjacent transpositions."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_names

#: Words are parted by ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"
#: Output rows that a task builds at once.
ROWS = 1 << 15


def swaps(k: int) -> Iterator[int]:
    """Positions p whose swaps (p with p + 1), made one after another, lead from 0..k-1 through all k! orders, each once.

    Every item moves in a direction until it meets a larger one; the largest that can move does, and all larger ones turn round.
    """
    order, way = list(range(k)), [-1] * k
    while True:
        moves = [(f, i) for i, f in enumerate(order) if 0 <= i + way[f] < k and order[i + way[f]] < f]
        if not moves:
            return
        f, i = max(moves)
        j = i + way[f]
        order[i], order[j] = order[j], order[i]
        for g in range(f + 1, k):
            way[g] = -way[g]
        yield min(i, j)


def walk(cells: np.ndarray) -> Iterator[tuple[list[int], np.ndarray]]:
    """(order, removed) for every order of the filters; removed[part, step, measure] is what the step's filter takes away.

    cells[part, mask, measure]: measures of the documents that fail exactly the filters whose bits are set in mask. Only the first order
    is counted out. A swap of filters a, b behind the filters S hands what fails both and nothing of S from the earlier
    step to the later one; all other steps stay as they are. `removed` is updated in place: copy it to keep it.
    """
    k = cells.shape[1].bit_length() - 1
    masks = np.arange(1 << k)
    order = list(range(k))
    gone = np.zeros((cells.shape[0], k, cells.shape[2]), np.int64)
    for step in range(k):
        gone[:, step] = cells[:, (masks >> step & 1).astype(bool) & (masks & ((1 << step) - 1) == 0)].sum(axis=1)
    yield order, gone
    for p in swaps(k):
        before = sum(1 << f for f in order[:p])
        pair = 1 << order[p] | 1 << order[p + 1]
        both = cells[:, (masks & before == 0) & (masks & pair == pair)].sum(axis=1)
        first = gone[:, p].copy()
        gone[:, p] = gone[:, p + 1] + both
        gone[:, p + 1] = first - both
        order[p], order[p + 1] = order[p + 1], order[p]
        yield order, gone


def _rows(parts: list, cells: np.ndarray, names: str) -> pa.RecordBatch:
    """All orders and steps of some parts. cells' measures: documents, good ones, toxic ones."""
    k, n = len(names), len(parts)
    orders, removed = [], np.empty((n, factorial(k), k, 3), np.int64)
    shapley = np.zeros((n, k), np.int64)
    for i, (order, gone) in enumerate(walk(cells)):
        orders.append(list(order))
        removed[:, i] = gone
        shapley[:, order] += gone[:, :, 0]
    at = np.array(orders)  # filter by order and step
    masks = np.arange(1 << k)
    fails = np.stack([cells[:, (masks >> f & 1).astype(bool), 0].sum(axis=1) for f in range(k)], axis=1)
    alone = cells[:, 1 << np.arange(k), 0]
    docs = removed[..., 0]
    kept = cells[:, :, 0].sum(axis=1)[:, None, None] - np.cumsum(docs, axis=2)
    shape = (n, len(orders), k)
    whole = lambda x: pa.array(np.broadcast_to(x, shape).reshape(-1).astype(np.int64))
    texts = pa.array(["".join(names[f] for f in o) for o in orders])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(parts, pa.string()).take(pa.array(np.repeat(np.arange(n), len(orders) * k))),
            texts.take(pa.array(np.tile(np.repeat(np.arange(len(orders)), k), n))),
            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n * len(orders))),
            pa.array(list(names)).take(pa.array(np.tile(at.reshape(-1), n))),
            *(whole(x) for x in (kept, docs, fails[:, at] - docs, alone[:, at], removed[..., 1], removed[..., 2], shapley[:, at])),
        ],
        names=COLUMNS,
    )


COLUMNS = ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_orders(cells: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step (SCHEMA), zeros included.

    cells(part, mask, docs, good, toxic): bit f of mask is set for documents that fail the filter names[f]; a part may lack masks and
    repeat them. kept: documents after the step; removed: by it; redundant: fail its filter but went earlier; unique_fails:
    fail this filter alone; good_lost, toxic_lost: removed here; shapley: removed by the filter, summed over all orders, at any step.
    A part has 2^k cells at most, so it fits one row whatever its documents; parts are worked on side by side. The number of rows is
    k! * k a part, so k is for a handful of filters (8 at most). A null part is an empty string; without cells there are no rows.
    """
    k = len(names)
    if not 1 <= k <= 8:
        raise ValueError("from 1 to 8 filters")
    summed = cells.groupBy(F.coalesce("part", F.lit("")).alias("part"), "mask").agg(*(F.sum(c).alias(c) for c in ("docs", "good", "toxic")))
    packed = summed.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("c"))  # 2^k at most
    packed = packed.select("part", *(F.col(f"c.{c}").alias(c) for c in ("mask", "docs", "good", "toxic")))
    at_once = max(1, ROWS // (factorial(k) * k))

    def run(batches):
        for b in batches:
            for a in range(0, len(b), at_once):
                some = b.slice(a, at_once).to_pydict()
                grid = np.zeros((len(some["part"]), 1 << k, 3), np.int64)
                for i, row in enumerate(zip(some["mask"], some["docs"], some["good"], some["toxic"])):
                    grid[i, row[0]] = np.array(row[1:], np.int64).T
                yield _rows(some["part"], grid, names)

    return packed.mapInArrow(run, SCHEMA)


#: Of the text filters below, in the order of their bits.
NAMES = "ABCDE"


def failure_masks(docs: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, mask, first) of every row of docs; first is the text's smallest id. Bits of mask, from the lowest:

    A under 200 words; B distinct words under half of all; C over 3 % upper-case A-Z; D any of # $ % & * |; E the text is that of a
    smaller id, anywhere in the table. A null text is empty; a row without an id never fails E, nor does it make others fail.
    Ids that repeat with their text don't make each other fail.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, size = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.char_length(text)
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), words.alias("w"))
    n = F.size("w").cast("bigint")
    fails = [n < 200, F.lit(100) * F.size(F.array_distinct("w")) < F.lit(50) * n, F.lit(100) * (size - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))).cast("bigint") > F.lit(3) * size, text.rlike(r"[#$%&*|]")]
    bits = sum((F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    rows = scratch.keep(read.select("id", "part", bits.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "masks")
    # a digest's smallest id is pre-aggregated in every task; that pair, not the digest alone, is the key of the join, so no key is hot
    first = rows.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("own", F.lit(True))
    found = rows.join(first, ["digest", "id"], "left")
    return found.select("id", "part", (F.col("mask") + F.when(F.col("own").isNull() & F.col("id").isNotNull(), 16).otherwise(0)).alias("mask"))


def audit_filters(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """audit_orders of the five filters of failure_masks over docs, by part, with quality and toxic from labels(id_col, quality, toxic).

    Whole texts are read once, in one row each; what leaves the scan is an id, a mask and a digest, whatever the text's length. Rows meet
    labels by id and are summed to 32 cells a part before they are shuffled by part, so a part with most rows is no heavier than others.
    Labels that repeat an id count as 1 if any row does; null labels and ids without labels as 0. A null part is an empty string.
    Repeated rows count as often as they come. An empty table gives no rows. Other columns, whatever their names, aren't read.
    """
    flags = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")))
    rows = failure_masks(docs, part_col, id_col, text_col).join(flags, "id", "left")
    yes = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("bigint"))
    cells = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("docs"), yes("quality").alias("good"), yes("toxic").alias("toxic"))
    return audit_orders(cells, NAMES)


SQL = r"""with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') s from documents),
w as (select *, regexp_extract_all(s, '[^\x20\x09-\x0D]+') w, min(doc_id) over (partition by s) own from d),
l as (select doc_id, max((coalesce(quality, 0) = 1)::int) good, max((coalesce(toxic, 0) = 1)::int) toxic from labels where doc_id is not null group by 1),
m as (select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
  (case when len(w) < 200 then 'A' else '' end) || (case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end)
  || (case when 100 * (length(s) - length(regexp_replace(s, '[A-Z]', '', 'g'))) > 3 * length(s) then 'C' else '' end)
  || (case when regexp_matches(s, '[#$%&*|]') then 'D' else '' end) || (case when own < w.doc_id then 'E' else '' end) mask
  from w left join l on l.doc_id = w.doc_id),
cells as (select part, mask, count(*) n, sum(good) good, sum(toxic) toxic from m group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
orders as (select a.x || b.x || c.x || d.x || e.x o from f a, f b, f c, f d, f e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select o, i::int as step, o[i] as x, left(o, i - 1) as before from orders, range(1, 6) r(i)),
c as (select part, o, step, x, n, good, toxic, contains(mask, x) fails, mask = x as only_it, translate(mask, before, '') <> mask as gone from cells, steps),
s as (select part, o as filter_order, step, x as filter,
  sum(case when not gone and not fails then n else 0 end)::bigint as kept, sum(case when not gone and fails then n else 0 end)::bigint as removed,
  sum(case when gone and fails then n else 0 end)::bigint as redundant, sum(case when only_it then n else 0 end)::bigint as unique_fails,
  sum(case when not gone and fails then good else 0 end)::bigint as good_lost, sum(case when not gone and fails then toxic else 0 end)::bigint as toxic_lost
  from c group by part, o, step, x)
select *, (sum(removed) over (partition by part, filter))::bigint as shapley from s"""
