"""Hash chains, tamper and replay detection, Merkle trees."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probity.functions import scans
from probity.functions.text import CHAINED, GENESIS, record_hash
from probity.sources.tables import Store

#: Confidence and severity by break type (fixed values).
BREAKS = {
    "HASH_MISMATCH": (0.96, "CRITICAL"), "BROKEN_LINK": (0.94, "CRITICAL"), "DUPLICATE_NONCE": (0.92, "CRITICAL"), "DUPLICATE_SEQUENCE": (0.80, "HIGH"), "SEQUENCE_GAP": (0.75, "HIGH"),
    "SEQUENCE_REGRESSION": (0.78, "HIGH"), "TIMESTAMP_REGRESSION": (0.60, "MEDIUM"), "MISSING_GENESIS": (0.70, "HIGH"),
}


def link_records(records: DataFrame, chain: str, order: list[str], reseal: bool = True) -> DataFrame:
    """Links each chain from the genesis hash: sets sequence_number (from 0), prev_record_hash and record_hash.

    Hashing is serial within a chain by nature, so a chain is one fold over its ordered records; chains run in parallel.
    """
    fields = [c for c in CHAINED if c not in ("prev_record_hash", "sequence_number")]
    kept = [c for c in records.columns if c not in (chain, "prev_record_hash", "record_hash", "sequence_number")]
    rec = F.struct(*dict.fromkeys([*order, *fields, *kept]))
    chains = records.groupBy(chain).agg(F.array_sort(F.collect_list(rec)).alias("r"))

    def text(x: Column, c: str) -> Column:
        return F.coalesce(x[c].cast("bigint"), F.lit(0).cast("bigint")) if c == "timestamp_ns" else F.coalesce(x[c].cast("string"), F.lit(""))

    def step(acc: Column, x: Column) -> Column:
        prev = acc["h"]
        vals = {**{c: text(x, c) for c in fields}, "prev_record_hash": prev, "sequence_number": F.size(acc["out"]).cast("bigint")}
        h = F.sha2(F.to_json(F.struct(*(vals[c].alias(c) for c in CHAINED)), {"ignoreNullFields": "false"}), 256)
        return F.struct(h.alias("h"), F.array_append(acc["out"], F.struct(prev.alias("p"), h.alias("h"))).alias("out"))

    empty = F.struct(F.lit(GENESIS).alias("h"), F.array().cast("array<struct<p:string,h:string>>").alias("out"))
    folded = chains.select(chain, "r", F.aggregate("r", empty, step, lambda a: a["out"]).alias("l"))
    return folded.select(chain, F.posexplode(F.arrays_zip("r", "l")).alias("i", "x")).select(chain, *(F.col(f"x.r.{c}").alias(c) for c in kept), F.col("i").cast("bigint").alias("sequence_number"), F.col("x.l.p").alias("prev_record_hash"), F.col("x.l.h").alias("record_hash"))


def packed(c: Column) -> Column:
    """A string as bytes, lower-case hex at half its size; equal strings, and no others, have equal bytes."""
    raw = F.unhex(c)
    return F.when(F.lower(F.hex(raw)) == c, F.concat(F.unhex(F.lit("01")), raw)).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(c, "UTF-8")))


def unpacked(c: Column) -> Column:
    rest = F.substring(c, 2, 1 << 30)
    return F.when(F.substring(c, 1, 1) == F.unhex(F.lit("01")), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def verify_chain(records: DataFrame, chain: str, order: list[str], skew_ns: int = 1_000_000_000, least: int = scans.LEAST) -> DataFrame:
    """One row per break: chain, index, record_id, break_type, expected, found. A record can have several.

    Stored hashes are compared with their predecessor's stored hash, so every record is checked on its own. What comes before a record
    (its place, the last hash, sequence number and time) comes from one window where no chain is over scans.LEAST records, and else is scanned
    in two levels (scans.Scan): ranges of records, then one row a range, so that a chain of all records is spread like any other. What
    a record shows on its own is judged before; only what the order needs moves, digests at half their size. Firsts (nonce, sequence number) are
    aggregates that are joined back, so one nonce in very many records doesn't meet in a task. Records that tie in `order` keep one order.
    """
    txt = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    item = lambda t, cond, exp, got: F.when(cond, F.struct(F.lit(t).alias("break_type"), exp.cast("string").alias("expected"), got.cast("string").alias("found")))
    some = lambda *checks: F.filter(F.array(*checks), lambda x: x.isNotNull())
    store = Store(records.sparkSession, "chain")
    calc, said, nonce = F.col("__calc"), unpacked(F.col("__said")), F.col("__nonce")
    alone = [item("HASH_MISMATCH", (txt("record_hash") != "") & (F.col("record_hash") != calc), calc, F.col("record_hash"))]
    if "output" in records.columns:
        digest = F.sha2(F.col("output"), 256)
        alone.append(item("PAYLOAD_MISMATCH", F.col("output").isNotNull() & (txt("output_hash") != "") & (digest != F.col("output_hash")), digest, F.col("output_hash")))
    by = [F.col(c).alias(f"__by{i}") for i, c in enumerate(order)]
    d = records.withColumn("__calc", record_hash()).select(
        F.col(chain).alias("__chain"), *by, F.col("record_id").alias("__id"), packed(F.when(txt("record_hash") != "", txt("record_hash")).otherwise(calc)).alias("__own"), packed(txt("prev_record_hash")).alias("__said"),
        packed(txt("nonce")).alias("__nonce"), F.coalesce("timestamp_ns", F.lit(0)).alias("__ts"), F.col("sequence_number").cast("bigint").alias("__stated"), some(*alone).alias("__alone"),
    )
    d = store.keep(d, "zstd")
    asc = [F.col(f"__by{i}").asc_nulls_first() for i in range(len(order))]
    seq = F.coalesce("__stated", "index")
    before = {"__prev": F.col("__own"), "__pseq": F.col("__seq"), "__pts": F.when(F.col("__ts") > 0, F.col("__ts"))}
    if scans.largest_group(d, ["__chain"]) > least:
        scan = scans.Scan(d, ["__chain"], asc, store)
        d = store.keep(scan.sums(index=F.lit(1).cast("bigint")).withColumn("__seq", seq), "zstd")
        d = scan.lasts(d, **before)
    else:
        w = Window.partitionBy("__chain").orderBy(*asc, "__tie")
        d = d.withColumn("__tie", F.monotonically_increasing_id()).withColumn("index", (F.row_number().over(w) - 1).cast("bigint")).withColumn("__seq", seq)
        d = d.withColumns({k: F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for k, v in before.items()})
    prev = F.coalesce(unpacked(F.col("__prev")), F.lit(GENESIS))
    genesis = (F.col("index") == 0) & ~said.isin(GENESIS, "")
    checks = [
        item("MISSING_GENESIS", genesis, F.lit(GENESIS), said),
        item("BROKEN_LINK", ~genesis & (said != prev), prev, said),
        item("SEQUENCE_REGRESSION", F.col("__seq") <= F.col("__pseq"), F.concat(F.lit(">"), F.col("__pseq").cast("string")), F.col("__seq")),
        item("SEQUENCE_GAP", F.col("__seq") > F.col("__pseq") + 1, F.col("__pseq") + 1, F.col("__seq")),
        item("TIMESTAMP_REGRESSION", (F.col("__ts") > 0) & (F.col("__ts") < F.col("__pts") - skew_ns), F.concat(F.lit(">="), F.col("__pts").cast("string")), F.col("__ts")),
    ]
    d = store.keep(d.select("__chain", "index", "__id", "__nonce", "__seq", F.concat("__alone", some(*checks)).alias("__b")), "zstd")
    out = d.select("__chain", "index", "__id", F.explode("__b").alias("b"))
    for kind, key, found, rows in (("DUPLICATE_NONCE", "__nonce", unpacked(nonce), d.filter(unpacked(nonce) != "")), ("DUPLICATE_SEQUENCE", "__seq", F.col("__seq"), d)):
        rows = rows.select("__chain", "index", "__id", key)
        first = rows.groupBy("__chain", key).agg(F.min("index").alias("__first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        hit = scans.join_on(rows, first.hint("merge"), ["__chain", key]).filter(F.col("index") > F.col("__first"))
        out = out.unionByName(hit.select("__chain", "index", "__id", F.explode(F.array(item(kind, F.lit(True), F.lit("unique nonce" if key == "__nonce" else "unique sequence"), found))).alias("b")))
    return out.select(F.col("__chain").alias(chain), "index", F.col("__id").alias("record_id"), "b.break_type", "b.expected", "b.found")


def chain_summary(records: DataFrame, breaks: DataFrame, chain: str, order: list[str]) -> DataFrame:
    """One row a chain: records, chain_valid, first_break_index (-1 if none), breaks and the head hash."""
    head = records.groupBy(chain).agg(F.count(F.lit(1)).alias("records"), F.max_by("record_hash", F.struct(*order)).alias("head_hash"))
    b = breaks.groupBy(chain).agg(F.count(F.lit(1)).alias("breaks"), F.min("index").alias("first"))
    return head.join(b, chain, "left").select(chain, "records", F.col("breaks").isNull().alias("chain_valid"), F.coalesce("first", F.lit(-1).cast("bigint")).alias("first_break_index"), F.coalesce("breaks", F.lit(0).cast("bigint")).alias("breaks"), F.coalesce("head_hash", F.lit(GENESIS)).alias("head_hash"))


def chain_findings(breaks: DataFrame) -> DataFrame:
    """Findings of breaks; hash mismatches are left to the tamper detector, which says more."""
    from probity.operators.findings import lookup

    b = breaks.filter("break_type <> 'HASH_MISMATCH'")
    return b.select(F.when(F.col("break_type") == "DUPLICATE_NONCE", "INFERENCE_REPLAY").otherwise("CHAIN_BREAK").alias("attack_class"), F.col("record_id").alias("affected_asset"), "break_type", lookup(F.col("break_type"), {k: v[0] for k, v in BREAKS.items()}, 0.6).alias("confidence"), lookup(F.col("break_type"), {k: v[1] for k, v in BREAKS.items()}, "MEDIUM").alias("severity"))


def find_tampered(records: DataFrame) -> DataFrame:
    """Records whose hash (CHAIN_HASH), output (OUTPUT_PAYLOAD) or both no longer match what is stored."""
    a = F.coalesce((F.col("record_hash") != "") & (F.col("record_hash") != record_hash()), F.lit(False))
    b = F.coalesce((F.col("output_hash") != "") & (F.sha2("output", 256) != F.col("output_hash")), F.lit(False))
    d = records.withColumn("tamper", F.concat_ws("+", F.when(a, "CHAIN_HASH"), F.when(b, "OUTPUT_PAYLOAD")))
    return d.filter("tamper <> ''")


def find_replays(records: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Later uses of a nonce, a record id, or an identical payload, with the first record that used it.

    Firsts are partial aggregates joined back, so one value in very many records is one row.
    """
    at = F.struct(*order)
    out = None
    for kind, keys, c in (("DUPLICATE_NONCE", ["nonce"], 0.93), ("DUPLICATE_RECORD_ID", ["record_id"], 0.93), ("IDENTICAL_PAYLOAD", ["input_hash", "output_hash", "model_hash", "timestamp_ns"], 0.75)):
        d = records.filter(" and ".join(f"coalesce(cast({k} as string), '') <> ''" for k in keys))
        first = d.groupBy(*scope, *keys).agg(F.min(at).alias("first"), F.min_by("record_id", at).alias("first_record"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        hit = d.withColumn("at", at).join(first, [*scope, *keys]).filter("at > first").select(*scope, "record_id", F.lit(kind).alias("replay_type"), "first_record", F.lit(c).alias("confidence"))
        out = hit if out is None else out.unionByName(hit)
    return out


#: Levels of a Merkle tree that one task climbs: subtrees of 2^SUBTREE nodes.
SUBTREE = 8


def _pair(a: Column, b: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(a), F.unhex(b)), 256)


def _leaves(leaves: DataFrame) -> DataFrame:
    return leaves.select("pos", F.sha2(F.concat(F.unhex(F.lit("00")), F.encode("hash", "UTF-8")), 256).alias("hash"))


def _climb(nodes: DataFrame, n: int, paths: bool) -> tuple[DataFrame, DataFrame | None, int, int]:
    """From n nodes (pos, hash): the roots of their aligned subtrees, of every node the path to its root, how many roots, levels climbed."""
    levels = min(SUBTREE, max(n - 1, 0).bit_length())
    d = nodes.groupBy(F.shiftright("pos", levels).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("nodes"))
    d = d.withColumn("first", F.col("nodes")[0]["pos"]).withColumn("l0", F.col("nodes.hash"))
    for k in range(levels):  # an odd last node is paired with itself
        below = F.col(f"l{k}")
        at = F.sequence(F.lit(0), ((F.size(below) - 1) / 2).cast("int"))
        d = d.withColumn(f"l{k + 1}", F.transform(at, lambda i: _pair(F.get(below, 2 * i), F.coalesce(F.get(below, 2 * i + 1), F.get(below, 2 * i)))))  # noqa: B023
    roots = d.select(F.col("block").alias("pos"), F.col(f"l{levels}")[0].alias("hash"))
    if not paths:
        return roots, None, -(-n >> levels) if n else 0, levels

    def step(k: int, i: Column) -> Column:
        own = F.shiftright(i, k)
        right = own % 2 == 0
        return F.struct(F.coalesce(F.get(F.col(f"l{k}"), F.when(right, own + 1).otherwise(own - 1)), F.get(F.col(f"l{k}"), own)).alias("hash"), F.when(right, "right").otherwise("left").alias("position"))

    row = lambda x, i: F.struct(x["pos"].alias("pos"), x["hash"].alias("leaf"), F.array(*(step(k, i) for k in range(levels))).cast("array<struct<hash:string,position:string>>").alias("path"))
    return roots, d.select("block", F.explode(F.transform("nodes", row)).alias("x")).select("block", "x.*"), -(-n >> levels), levels


def merkle_root(leaves: DataFrame) -> DataFrame:
    """(root, depth, leaves) of leaves(pos from 0, hash): a leaf is sha256(00 | text), a node sha256(01 | left | right), an odd last node
    is paired with itself; 64 zeros for no leaves. Every round hashes whole subtrees in a task: one row a subtree moves on."""
    store, n, depth, level = Store(leaves.sparkSession, "merkle"), leaves.count(), 1, _leaves(leaves)
    left = n
    while left > 1:
        level, _, left, up = _climb(level, left, False)
        level, depth = store.keep(level), depth + up
    return level.agg(F.coalesce(F.max("hash"), F.lit(GENESIS)).alias("root")).select("root", F.lit(depth if n else 0).cast("bigint").alias("depth"), F.lit(n).cast("bigint").alias("leaves"))


def merkle_proofs(leaves: DataFrame) -> DataFrame:
    """(pos, leaf, path array<struct<hash, position>>, root) for every leaf: its path in its subtree, then that subtree's path above."""
    store, left, level, out = Store(leaves.sparkSession, "merkle"), leaves.count(), _leaves(leaves), None
    while left > 1 or out is None:
        roots, paths, left, _ = _climb(level, left, True)
        level, paths = store.keep(roots), store.keep(paths)
        if out is None:
            out = paths.withColumn("at", F.col("block"))
        else:
            up = paths.select(F.col("pos").alias("at"), F.col("path").alias("above"), F.col("block").alias("next"))
            out = out.join(up, "at").select("pos", "leaf", F.concat("path", "above").alias("path"), F.col("next").alias("at"))
    return out.select("pos", "leaf", "path").crossJoin(F.broadcast(level.select(F.col("hash").alias("root"))))  # one row


def verify_proofs(proofs: DataFrame) -> DataFrame:
    end = F.aggregate("path", F.col("leaf"), lambda h, s: F.when(s["position"] == "right", _pair(h, s["hash"])).otherwise(_pair(s["hash"], h)))
    return proofs.select("pos", (end == F.col("root")).alias("valid"))


def _digest_pair(a: str, b: str) -> str:
    return hashlib.sha256(b"\x01" + bytes.fromhex(a) + bytes.fromhex(b)).hexdigest()


def _cover(nodes: DataFrame, store: Store) -> list[tuple[int, int, str]]:
    """(level, index, hash) of the largest aligned subtrees that nodes(pos, hash), a run of leaves, consist of, from left to right.

    Every round hashes blocks of 2^SUBTREE nodes; a full block is one node of the next round, one at either end is cut up. So appended leaves
    cost their own subtrees alone, and two nodes a level reach the driver."""
    found, base, level = [], 0, nodes
    size = 1 << SUBTREE

    def block(key, pdf: pd.DataFrame, at: int) -> pd.DataFrame:
        row = {int(p): h for p, h in zip(pdf["pos"], pdf["hash"])}
        full, out = len(row) == size, []
        for k in range(SUBTREE):
            up = {i // 2: _digest_pair(row[i], row[i + 1]) for i in row if i % 2 == 0 and i + 1 in row}
            out += [(at + k, i, h, False) for i, h in row.items() if i // 2 not in up]
            row = up
        out += [(at + SUBTREE, i, h, full) for i, h in row.items()]
        return pd.DataFrame(out, columns=["level", "pos", "hash", "on"])

    def climb(at: int):
        return lambda key, pdf: block(key, pdf, at)

    while True:
        d = level.groupBy(F.shiftright("pos", SUBTREE).alias("block")).applyInPandas(climb(base), "level int, pos bigint, hash string, on boolean")
        d = store.keep(d)
        found += [(r["level"], r["pos"], r["hash"]) for r in d.filter("not on").collect()]  # of two blocks at most
        level, base = d.filter("on").select("pos", "hash"), base + SUBTREE
        if level.isEmpty():
            return sorted(found, key=lambda n: n[1] << n[0])


def _merged(nodes: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Neighbours of one level that have a parent are replaced by it, from the left on."""
    out: list[tuple[int, int, str]] = []
    for node in nodes:
        out.append(node)
        while len(out) > 1 and out[-2][0] == out[-1][0] and out[-2][1] % 2 == 0 and out[-2][1] + 1 == out[-1][1]:
            b, a = out.pop(), out.pop()
            out.append((a[0] + 1, a[1] // 2, _digest_pair(a[2], b[2])))
    return out


def frontier_root(frontier: list[tuple[int, int, str]]) -> str:
    """The root over a frontier: from the right, a subtree is paired with itself until it is as high as its left neighbour."""
    if not frontier:
        return GENESIS
    level, _, h = frontier[-1]
    for up, _, left in reversed(frontier[:-1]):
        while level < up:
            h, level = _digest_pair(h, h), level + 1
        h, level = _digest_pair(left, h), level + 1
    return h


def append_leaves(frontier: list[tuple[int, int, str]], leaves: DataFrame) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(new frontier, subtrees of the appended leaves): leaves(pos, hash) go on from the frontier's end, pos counted from 0 among them.

    A frontier is the peaks (level, index, hash) of the complete subtrees, one a bit of the number of leaves; [] is the empty tree. What was
    there before isn't read again. The second result is the proof that the new tree goes on from the old one (verify_append).
    """
    n = sum(1 << level for level, _, _ in frontier)
    own = _leaves(leaves).select((F.col("pos") + n).alias("pos"), "hash")
    cover = _cover(own, Store(leaves.sparkSession, "append"))
    return _merged([*frontier, *cover]), cover


def verify_append(old_root: str, new_root: str, frontier: list[tuple[int, int, str]], cover: list[tuple[int, int, str]]) -> bool:
    """Whether the tree of new_root has the leaves of old_root's tree first: the frontier gives the old root, and with the appended
    subtrees, which must follow it without a gap, the new one."""
    at = 0
    for level, i, _ in [*frontier, *cover]:
        if i << level != at:
            return False
        at += 1 << level
    falling = all(a[0] > b[0] for a, b in zip(frontier, frontier[1:]))
    return falling and frontier_root(frontier) == old_root and frontier_root(_merged([*frontier, *cover])) == new_root
