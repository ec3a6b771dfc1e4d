"""Mixing sources to target weights by hierarchical budgeting. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_names

#: Words as the token unit: runs of anything but ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
BIG = "decimal(38,0)"


def _weights(col: Column, given: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, w in given.items():
        out = F.when(col == name, F.lit(w)).otherwise(out)
    return out.cast("bigint")


def _pour(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Splits each parent's `budget` over its children (w, cap) in proportion to w, none above cap.

    Children fill in the order of cap/w. The first k that stay below their share take their whole cap; the rest share
    what is left. All in integers, so any engine gets the same figures; a share is rounded down.
    """
    part = Window.partitionBy(*parent)
    order = part.orderBy((F.col("cap").cast("double") / F.col("w")).asc(), "name")
    n = nodes.filter("w > 0")
    n = n.withColumn("s", F.coalesce(F.sum(F.col("cap").cast(BIG)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(BIG)))
    n = n.withColumn("wr", F.sum(F.col("w").cast(BIG)).over(order.rowsBetween(0, Window.unboundedFollowing)))
    # full: its cap is at most its share of what the fuller-than-it siblings leave
    n = n.withColumn("full", (F.col("budget").cast(BIG) - F.col("s")) * F.col("w") >= F.col("cap").cast(BIG) * F.col("wr"))
    n = n.withColumn("cut", F.min(F.when(~F.col("full"), F.row_number().over(order))).over(part))
    n = n.withColumn("k", F.row_number().over(order))
    at = lambda c: F.max(F.when(F.col("k") == F.col("cut"), F.col(c))).over(part)
    n = n.withColumn("s_cut", at("s")).withColumn("w_cut", at("wr"))
    share = F.expr("((cast(budget as decimal(38,0)) - s_cut) * w) div w_cut")
    return n.withColumn("alloc", F.when(F.col("cut").isNull() | (F.col("k") < F.col("cut")), F.col("cap")).otherwise(share).cast("bigint")).drop("s", "wr", "full", "cut", "k", "s_cut", "w_cut")


def leaf_budgets(leaves: DataFrame, weights: Sequence[Mapping[str, int]], budget_permille: int, max_epochs: int, default_weight: int = 1) -> DataFrame:
    """Adds `alloc`, the tokens each leaf (domain, lang, source, tokens) gives, to the leaves.

    The whole budget is budget_permille thousandths of all tokens. It is poured from the root to domains, to their
    languages, to their sources. A node can give max_epochs times its tokens. What a short child can't give goes to its
    siblings; only when all of them are full does it go to the next level up, because a node's own cap is the sum
    of its leaves' caps.
    """
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)).cast(BIG) * budget_permille / 1000).cast("bigint").alias("budget"))
    keys = ["domain", "lang", "source"]
    level = None
    for depth in range(3):
        path = keys[: depth + 1]
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("name", F.col(path[-1])).withColumn("w", _weights(F.col(path[-1]), weights[depth], default_weight))
        if level is None:
            nodes = nodes.crossJoin(F.broadcast(total)).withColumn("root", F.lit(0))  # one row
            level = _pour(nodes, ["root"]).select(*path, F.col("alloc").alias("budget"))
        else:
            level = _pour(nodes.join(level, keys[:depth]), keys[:depth]).select(*path, F.col("alloc").alias("budget"))
    return leaves.join(level.withColumnRenamed("budget", "alloc"), keys)


def mix(
    docs: DataFrame,
    domains: Mapping[str, str],
    weights: Sequence[Mapping[str, int]],
    budget_permille: int = 500,
    max_epochs: int = 2,
    seed: int = 7,
    id_col: str = "doc_id",
    rows_per_bucket: int = 2048,
) -> DataFrame:
    """Chosen documents: id_col, domain, lang, source, n_tokens, epoch; one row for each epoch a document is used in.

    Each leaf has its budget (leaf_budgets). Epochs 0, 1, ... use the leaf once each while the budget lasts; the last,
    partial one takes the longest prefix, in the order of md5(seed:epoch:id), whose tokens don't exceed what is left.
    Prefixes are found without sorting a leaf in one place: documents fall into hash ranges in proportion to the leaf's
    size, ranges are summed first, and only the range in which the budget ends is sorted.

    Nulls: a null lang or source is the name '(none)'; sources without a domain are in 'other'; a null or empty text has
    0 tokens and goes wherever the prefix reaches it; a null id is the text 'null' in the order. Repeated rows are
    separate rows; ties in the order are broken by id, and rows equal in id keep or leave together. Long texts are counted whole, in the
    task that reads them. Columns other than those named aren't read; an id column called like one of the results is
    renamed by an underscore. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    src = F.coalesce(F.col("source"), F.lit("(none)"))
    dom = F.lit("other")
    for s, d in domains.items():
        dom = F.when(src == s, F.lit(d)).otherwise(dom)
    scratch = Scratch(spark, "mix")
    d = scratch.keep(
        docs.select(
            F.col(id_col).alias("id"),
            dom.alias("domain"),
            F.coalesce(F.col("lang"), F.lit("(none)")).alias("lang"),
            src.alias("source"),
            F.regexp_count(text, F.lit(TOKEN)).cast("bigint").alias("n_tokens"),
        ),
        "tokens",
    )
    keys = ["domain", "lang", "source"]
    leaves = d.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    plan = leaf_budgets(leaves, weights, budget_permille, max_epochs)
    plan = plan.withColumn("whole", F.expr("case when tokens = 0 then 0 else alloc div tokens end").cast("int"))
    plan = plan.withColumn("rest", F.col("alloc") - F.col("whole") * F.col("tokens"))
    plan = plan.withColumn("ranges", F.expr(f"cast(rows div {rows_per_bucket} + 1 as bigint)")).select(*keys, "whole", "rest", "ranges")
    plan = scratch.keep(plan, "plan")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    # a domain can hold more leaves than a broadcast should carry, so the size decides how this joins
    e = d.join(plan, keys).withColumn("key", key)
    e = e.withColumn("range", F.expr("(cast(conv(substr(key, 1, 8), 16, 10) as bigint) * ranges) div 4294967296"))
    leaf = Window.partitionBy(*keys).orderBy("range")
    ranges = e.groupBy(*keys, "range").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("left"))
    ranges = ranges.withColumn("upto", F.sum("t").over(leaf)).select(*keys, "range", (F.col("upto") - F.col("t")).alias("before"), "upto")
    e = e.join(ranges, [*keys, "range"])
    inside = F.col("upto") <= F.col("rest")
    edge = ~inside & (F.col("before") <= F.col("rest"))
    cut = e.filter(edge).withColumn("run", F.sum("n_tokens").over(Window.partitionBy(*keys, "range").orderBy("key")) + F.col("before"))
    partial = cut.withColumn("inside", F.col("run") <= F.col("rest")).drop("run").unionByName(e.filter(~edge).withColumn("inside", inside))
    used = partial.withColumn("uses", F.col("whole") + F.when(F.col("inside") & (F.col("rest") > 0), 1).otherwise(0))
    (name,) = free_names([*keys, "n_tokens", "epoch"], id_col)
    return used.filter("uses > 0").select(F.col("id").alias(name), *keys, "n_tokens", F.explode(F.expr("sequence(0, uses - 1)")).alias("epoch"))


def mix_sql(domains: Mapping[str, str], weights: Sequence[Mapping[str, int]], budget_permille: int, max_epochs: int, seed: int, docs: str = "documents", tail: str | None = None) -> str:
    """The same mixture in DuckDB's SQL."""

    def case(col: str, given: Mapping, default: str, q: str = "") -> str:
        return f"case {col} " + " ".join(f"when '{k}' then {q}{v}{q}" for k, v in given.items()) + f" else {default} end" if given else default

    def pour(name: str, nodes: str, parent: str) -> str:
        by = f"partition by {parent}" if parent else ""
        return f"""
{name}_a as (select *, coalesce(sum(cap) over ({by} order by cap::double / w, name rows between unbounded preceding and 1 preceding), 0)::hugeint s,
  (sum(w) over ({by} order by cap::double / w, name rows between current row and unbounded following))::hugeint wr, row_number() over ({by} order by cap::double / w, name) k from ({nodes}) where w > 0),
{name}_b as (select *, min(case when not ((budget - s) * w >= cap::hugeint * wr) then k end) over ({by}) cut from {name}_a),
{name}_c as (select *, max(case when k = cut then s end) over ({by}) s_cut, max(case when k = cut then wr end) over ({by}) w_cut from {name}_b),
{name} as (select * exclude (budget), (case when cut is null or k < cut then cap else ((budget - s_cut) * w) // w_cut end)::bigint budget from {name}_c)"""

    w = [lambda c, g=g: case(c, g, "1") for g in weights]
    tail = tail or "select doc_id, domain, lang, source, n_tokens, unnest(range(uses))::int as epoch from used where uses > 0"
    return f"""with d as (select doc_id, coalesce(lang, '(none)') lang, coalesce(source, '(none)') source, {case("coalesce(source, '(none)')", domains, "'other'", "'")} as domain,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint n_tokens from {docs}),
leaves as (select domain, lang, source, sum(n_tokens)::bigint tokens from d group by all),
total as (select (sum(tokens)::hugeint * {budget_permille} // 1000)::bigint budget from leaves),
{pour("l1", f"select domain, domain as name, (sum(tokens) * {max_epochs})::bigint cap, {w[0]('domain')} w, any_value(budget)::hugeint budget from leaves, total group by domain", "")},
{pour("l2", f"select g.*, l1.budget::hugeint budget from (select domain, lang, lang as name, (sum(tokens) * {max_epochs})::bigint cap, {w[1]('lang')} w from leaves group by domain, lang) g join l1 using (domain)", "domain")},
{pour("l3", f"select g.*, l2.budget::hugeint budget from (select domain, lang, source, source as name, (tokens * {max_epochs})::bigint cap, {w[2]('source')} w from leaves) g join l2 using (domain, lang)", "domain, lang")},
plan as (select domain, lang, source, case when tokens = 0 then 0 else l3.budget // tokens end whole, l3.budget - case when tokens = 0 then 0 else l3.budget // tokens end * tokens rest from leaves join l3 using (domain, lang, source)),
e as (select d.*, whole, rest, sum(n_tokens) over (partition by domain, lang, source order by md5('{seed}:' || whole || ':' || coalesce(doc_id::varchar, 'null'))) run from d join plan using (domain, lang, source)),
used as (select *, whole + case when run <= rest and rest > 0 then 1 else 0 end uses from e)
{tail}"""
