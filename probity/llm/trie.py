"""The prefix trie of conversations and its subtree totals, by heavy-path decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_spread
from .ordered import LEAST, cut_groups

WORD = r"[^\x20\x09-\x0D]+"
#: Path nodes of an array, and turns of a conversation, that are summed in one run; sums of runs are added in a second level.
RUN = 1024
#: Ids of a node's ends that are joined at the first level.
IDS = 256
NODE = ["depth", "x", "y"]


def places(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_turns: int = LEAST) -> DataFrame:
    """(conv_id, pos, a, b, words) of every turn with an id: its place from 0, two 64-bit hashes of (role, text), its words.

    Turns go by turn_col, null first; ties by role, then the text's MD5. Texts stay in the tasks that read them.
    Conversations of many turns are counted in pieces (cut_groups), and the pieces' sizes added before them.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.unhex(F.md5(text)).alias("digest"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), text, role).alias("b"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]
    cut = cut_groups(rows, "conv_id", order, least=most_turns)
    local = cut.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id", "piece").orderBy(*order)).cast("bigint") - 1)
    sizes = cut.filter("piece > 0").groupBy("conv_id", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))  # a row a piece
    return local.join(sizes, ["conv_id", "piece"], "left").select("conv_id", (F.col("pos") + F.coalesce("n", F.lit(0))).alias("pos"), "a", "b", "words")


def rebuild(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): every conversation c of own (conv_id, pos, a, b, words) as the first h turns of conversation c - c % 20, as many
    as it has, then c's own behind its first h; h = crc32(c) % 4. conversations has conv_id, also where no turn is left, and n_own."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4))
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own")).select("conv_id", "n_own", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), h.alias("h"))
    first = own.filter("pos < 3 and conv_id % 20 = 0").select(F.col("conv_id").alias("base"), "pos", "a", "b", "words")
    heads = convs.join(first, "base").filter("pos < h").select("conv_id", "pos", "a", "b", "words")  # at most 3 of a base, for at most 20
    taken = convs.join(heads.groupBy("conv_id").agg(F.count(F.lit(1)).alias("taken")), "conv_id", "left").select("conv_id", "n_own", (F.col("h") - F.coalesce("taken", F.lit(0))).alias("short"))
    rest = own.filter(F.col("pos") >= h)
    moved = join_spread(rest, taken, ["conv_id"], "n_own", own.count()).select("conv_id", (F.col("pos") - F.col("short")).alias("pos"), "a", "b", "words")
    return heads.unionByName(moved), convs.select("conv_id", "n_own")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, x, y, px, py, words): the key (depth, x, y) of the prefix that ends with each turn, and its parent's (depth - 1, px, py).

    Keys are exclusive ors of hashes of (place, turn) over the prefix, 128 bits, so runs of a long conversation are summed apart, and
    the sums of earlier runs are added."""
    g = turns.select("conv_id", "pos", F.expr(f"pos div {RUN}").alias("run"), F.xxhash64("pos", "a", "b").alias("gx"), F.xxhash64("b", "a", "pos").alias("gy"), "words")
    upto = Window.partitionBy("conv_id", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = g.select("*", F.bit_xor("gx").over(upto).alias("x"), F.bit_xor("gy").over(upto).alias("y"))
    sums = g.groupBy("conv_id", "run").agg(F.bit_xor("gx").alias("sx"), F.bit_xor("gy").alias("sy"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "run", F.bit_xor("sx").over(before).alias("sx"), F.bit_xor("sy").over(before).alias("sy")).filter("sx is not null")
    full = local.join(sums, ["conv_id", "run"], "left")
    x, y = (F.col(c).bitwiseXOR(F.coalesce(s, F.lit(0))) for c, s in (("x", "sx"), ("y", "sy")))
    return full.select("conv_id", (F.col("pos") + 1).alias("depth"), x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("gx")).alias("px"), y.bitwiseXOR(F.col("gy")).alias("py"), "words")


def _digest_ids(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids of `ends` (NODE, conv_id) of each node, in order, comma-joined. Ids are unique, so a block has IDS at most."""
    text = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda v: v["s"]), ",")
    block = F.floor(F.col("conv_id") / IDS)
    parts = ends.groupBy(*NODE, block.alias("block")).agg(text(F.struct("conv_id", F.col("conv_id").cast("string").alias("s"))).alias("s"))
    return parts.groupBy(*NODE).agg(F.sha2(text(F.struct("block", "s")), 256).alias("ends_sha256"))


def _suffix_sums(rows: DataFrame, group: str, order: str, values: list[str]) -> DataFrame:
    """rows with each of values replaced by its sum over the rows of the group from this one on in `order` (0, 1, 2, ...).

    A group is an array cut into runs of RUN places: sums inside a run, then the runs' sums from the last on."""
    r = rows.withColumn("run", F.expr(f"{order} div {RUN}"))
    inside = Window.partitionBy(group, "run").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(group).orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    sums = r.groupBy(group, "run").agg(*(F.sum(v).alias(f"after_{v}") for v in values))
    sums = sums.select(group, "run", *(F.sum(f"after_{v}").over(after).alias(f"after_{v}") for v in values)).filter(f"after_{values[0]} is not null")
    keep = [c for c in rows.columns if c not in values]
    local = r.select(*keep, "run", *(F.sum(v).over(inside).alias(v) for v in values))
    return local.join(sums, [group, "run"], "left").select(*keep, *((F.col(v) + F.coalesce(f"after_{v}", F.lit(0))).alias(v) for v in values))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of turns (conv_id, pos, a, b, words) of the conversations convs (conv_id, n_own):

    conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves, saved_tokens, ends_sha256.

    A node's heavy child has the most members, the smallest id among equals; heavy children form paths that end in leaves. A light child
    has half its parent's members at most, so a conversation passes log2(n) light edges at most. A leaf's smallest member walks its
    whole path, so one pass over those members' turns tells each node's path and how many light edges lie above it. Rounds from the deepest
    paths up add each path's total to the node it hangs on; then suffix sums along the path arrays give every subtree's total.

    Counts and minima are pre-aggregated; rows that meet a node with very many members or children are joined by broadcast of that node
    (join_spread). Conversations are those of convs, also without turns; a table without any has no node, not even a root.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "trie")
    steps = scratch.keep(prefixes(turns), "steps")
    n_steps = max(1, steps.count())
    zero = lambda c: F.lit(0).cast("bigint").alias(c)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero("depth"), zero("x"), zero("y"), zero("px"), zero("py"), "conv_id", "n_convs", zero("words"))
    nodes = steps.groupBy(*NODE).agg(F.first("px").alias("px"), F.first("py").alias("py"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    nodes = scratch.keep(nodes.select(*NODE, "px", "py", "conv_id", "n_convs", "words").unionByName(root), "nodes")
    # parents with their number of children and the heavy one, known by its smallest member
    best = F.max_by("conv_id", F.struct("n_convs", -F.col("conv_id")))
    inner = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n_children"), best.alias("heavy"))
    inner = scratch.keep(nodes.join(inner, NODE).select("depth", "x", "y", "conv_id", "n_children", "heavy"), "inner")
    up = inner.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy"), F.col("n_children").alias("siblings"))
    below = join_spread(nodes.filter("depth > 0"), up, ["depth", "px", "py"], "siblings", nodes.count())
    tops = nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint")).withColumn("heavy", F.lit(None).cast("bigint"))
    tree = below.unionByName(tops).drop("px", "py").join(inner.select(*NODE, "n_children"), NODE, "left")
    tree = tree.select(*NODE, "conv_id", "parent_conv_id", "n_convs", "words", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), F.coalesce(F.col("conv_id") != F.col("heavy"), F.lit(True)).alias("light"))
    tree = scratch.keep(tree, "tree")
    # the smallest member of each leaf walks its path; the leaf's id is the path's
    leaves = tree.filter("n_children = 0").select(F.col("conv_id").alias("path"), F.col("depth").alias("last"))
    walked = steps.select(F.col("conv_id").alias("path"), *NODE).join(leaves.filter("last > 0").select("path"), "path", "left_semi")
    walked = join_spread(walked, tree.select(*NODE, "n_convs", F.col("n_convs").alias("members"), "conv_id", "parent_conv_id", "words", "n_children", "light"), NODE, "members", n_steps)
    walked = scratch.keep(walked, "walked")
    heads = walked.groupBy("path").agg(F.max(F.when(F.col("light"), F.struct("depth", "parent_conv_id"))).alias("head"), F.sum(F.col("light").cast("int")).alias("level"))
    heads = heads.select("path", F.coalesce("head.depth", F.lit(0)).cast("bigint").alias("head"), F.col("head.parent_conv_id").alias("parent"), "level")
    on_path = walked.join(heads, "path").filter("depth >= head").drop("level", "parent")
    # the root is on the one path without a light edge; where no conversation has turns it's a path of its own
    trunk = F.lit(heads.filter("level = 0").agg(F.min("path")).first()[0]).cast("bigint")
    on_root = tree.filter("depth = 0").select(F.coalesce(trunk, "conv_id").alias("path"), *NODE, "n_convs", "conv_id", "parent_conv_id", "words", "n_children", zero("head"))
    on_path = on_path.select(on_root.columns).unionByName(on_root)
    own = on_path.withColumn("n_leaves", (F.col("n_children") == 0).cast("bigint")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words"))
    own = scratch.keep(own, "paths")
    # paths hang on a node of another path; rounds from the deepest level up
    hung = heads.filter("level > 0").select("path", "level", F.col("parent").alias("conv_id"), (F.col("head") - 1).alias("depth"))
    held = own.filter("n_children > 1").select("conv_id", "depth", F.col("path").alias("on"), "n_children")
    hung = join_spread(hung, held, ["conv_id", "depth"], "n_children", max(1, nodes.count()))
    sums = own.groupBy("path").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    hung = scratch.keep(hung.join(sums, "path").select("path", "level", "on", F.col("depth").alias("at"), "n_leaves", "saved_tokens"), "hung")
    deepest = hung.agg(F.max("level")).first()[0] or 0
    totals, lower = [], None
    for level in range(deepest, 0, -1):
        here = hung.filter(F.col("level") == level)
        if lower is not None:
            more = lower.groupBy(F.col("on").alias("path")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
            here = here.join(more, "path", "left").select("path", "level", "on", "at", (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"))
        lower = scratch.keep(here, f"level{level}")
        totals.append(lower)
    if totals:
        light = totals[0]
        for t in totals[1:]:
            light = light.unionByName(t)
        light = light.groupBy(F.col("on").alias("path"), F.col("at").alias("depth")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        own = own.join(light, ["path", "depth"], "left").withColumn("n_leaves", F.col("n_leaves") + F.coalesce("l", F.lit(0))).withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("s", F.lit(0))).drop("l", "s")
    summed = _suffix_sums(own, "path", "depth", ["n_leaves", "saved_tokens"])
    last = steps.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("n"))
    ends = convs.select("conv_id").join(last, "conv_id", "left").select(*(F.coalesce(f"n.{c}", F.lit(0)).cast("bigint").alias(c) for c in NODE), "conv_id")
    done = summed.join(_digest_ids(ends), NODE, "left")
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def shared_trie(turns: DataFrame, most_turns: int = LEAST) -> DataFrame:
    """prefix_trie of the rebuilt conversations of turns (conv_id, turn, role, text).

    Rows without an id belong to no conversation and are left out; null roles and texts are empty; a null turn comes first; ties in turn go by
    role, then the text's MD5; repeated rows are repeated turns. Long texts are hashed where they are read. An empty table gives no rows. Other
    columns aren't read, so their names don't matter.
    """
    scratch = Scratch(turns.sparkSession, "rebuild")
    own = scratch.keep(places(turns, most_turns=most_turns), "own")
    rows, convs = rebuild(own)
    return prefix_trie(scratch.keep(rows, "turns"), scratch.keep(convs, "convs"))


SQL = r"""with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as t, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) - 1 as pos from conversations where conv_id is not null),
b as (select conv_id, conv_id - conv_id % 20 as base, flatten([[(ascii(c) >> j) & 1 for j in range(8)] for c in regexp_extract_all(conv_id::varchar, '.')]) bits from (select distinct conv_id from t)),
c as (select conv_id, base, xor(list_reduce(list_prepend(4294967295, bits), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) & 3 as h from b),
heads as (select c.conv_id, pos, role, t from c join t on t.conv_id = c.base and pos < h),
taken as (select conv_id, count(*) n from heads group by 1),
r as (select * from heads union all select c.conv_id, pos - h + coalesce(n, 0), role, t from c join t on t.conv_id = c.conv_id and pos >= h left join taken on taken.conv_id = c.conv_id),
p as (select conv_id, pos + 1 as d, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as words, md5(string_agg(md5(role) || md5(t), '') over (partition by conv_id order by pos)) as k from r
  union all select conv_id, 0, 0, '' from c),
own as (select d, k, min(conv_id) as conv_id, count(*) n, any_value(words) words from p group by d, k),
id as (select p.conv_id as member, p.d, own.conv_id from p join own using (d, k)),
kid as (select own.*, id.conv_id as parent from own left join id on id.member = own.conv_id and id.d = own.d - 1),
kids as (select parent as conv_id, d - 1 as d, count(*) n_children from kid where d > 0 group by all),
node as (select kid.*, coalesce(n_children, 0) n_children from kid left join kids on kids.conv_id = kid.conv_id and kids.d = kid.d),
total as (select id.conv_id, id.d, sum((node.n_children = 0)::int) n_leaves, sum((node.n - 1) * node.words) saved from node join id on id.member = node.conv_id and id.d <= node.d group by all),
last as (select member, max(d) as d from id group by 1),
ends as (select id.conv_id, id.d, sha256(string_agg(member::varchar, ',' order by member)) s from id join last using (member, d) group by all)
select node.conv_id, node.d::bigint as depth, case when node.d > 0 then parent end as parent_conv_id, n::bigint as n_convs, node.n_children::bigint as n_children, n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, coalesce(s, sha256('')) as ends_sha256
from node join total on total.conv_id = node.conv_id and total.d = node.d left join ends on ends.conv_id = node.conv_id and ends.d = node.d"""
