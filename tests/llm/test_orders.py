"""Filter audit, chat formatting and the prefix trie against brute force, and on odd rows."""

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from probity.llm import chat
from probity.llm.filter_audit import NAMES, audit_filters, audit_orders, swaps, walk
from probity.llm.ordered import cut_groups
from probity.llm.trie import shared_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_swaps_visit_every_order_once():
    for k in (1, 2, 3, 5, 6):
        order, seen = list(range(k)), {tuple(range(k))}
        for p in swaps(k):
            order[p], order[p + 1] = order[p + 1], order[p]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(k))))


def test_walk_counts_as_one_order_at_a_time():
    cells = np.random.default_rng(1).integers(0, 50, (3, 16, 2))
    for order, gone in walk(cells):
        left = cells.copy()
        for step, f in enumerate(order):
            hit = (np.arange(16) >> f & 1).astype(bool)
            assert (gone[:, step] == left[:, hit].sum(axis=1)).all()
            left[:, hit] = 0


def brute_audit(docs, labels):
    quality, toxic = defaultdict(int), defaultdict(int)
    for i, q, t in labels:
        if i is not None:
            quality[i], toxic[i] = max(quality[i], int(q == 1)), max(toxic[i], int(t == 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts = defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        bad = ("A" if len(w) < 200 else "") + ("B" if 100 * len(set(w)) < 50 * len(w) else "") + ("C" if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else "")
        parts[lang or ""].append((bad + ("D" if re.search(r"[#$%&*|]", t) else "") + ("E" if i is not None and least[t] < i else ""), quality[i] if i is not None else 0, toxic[i] if i is not None else 0))
    out, sums = [], defaultdict(int)
    for part, rows in parts.items():
        for order in itertools.permutations(NAMES):
            for s, f in enumerate(order):
                came = [r for r in rows if not set(r[0]) & set(order[:s])]
                gone = [r for r in came if f in r[0]]
                sums[part, f] += len(gone)
                out.append((part, "".join(order), s + 1, f, len(came) - len(gone), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == f for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)))
    return sorted((*r, sums[r[0], r[3]]) for r in out)


def test_filter_audit_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["", "a b", "A" * 50, "x y " * 150, " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i}" for i in range(250)) + " #", "É é x " * 120, "long " * 200_000, None]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(300)]
    docs += [(None, "a b", "en"), (None, "only here", "xx"), (7, docs[7][1], docs[7][2]), (-3, "a b", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    frame = spark.createDataFrame([(*r, "x", 1, True) for r in docs], "doc_id long, text string, lang string, part string, mask int, own boolean")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in audit_filters(frame, marks).collect())
    assert got == brute_audit(docs, labels)
    assert audit_filters(frame.limit(0), marks).collect() == [] and len(audit_filters(frame, marks.limit(0)).collect()) == len(got)


def test_audit_of_other_filters_and_many_parts(spark):
    cells = spark.range(5000).selectExpr("concat('p', id) as part", "cast(id % 4 as int) as mask", "id as docs", "id div 2 as good", "1L as toxic")
    got = audit_orders(cells.unionByName(cells), "xy")
    assert got.count() == 5000 * 4
    assert got.filter("part = 'p7' and filter_order = 'yx'").orderBy("step").select("kept", "removed", "redundant", "unique_fails", "good_lost", "shapley").collect() == [(0, 14, 0, 0, 6, 14), (0, 0, 14, 0, 0, 14)]


def test_cut_groups_keep_order(spark):
    rows = spark.createDataFrame([(k, None if i % 9 == 0 else i // 3) for k in (1, None) for i in range(500)] + [(2, 5)] * 3, "k long, t long")
    cut = cut_groups(rows, "k", [F.col("t").asc_nulls_first()], least=100).collect()
    assert sorted((str(r.k), str(r.t)) for r in cut) == sorted((str(r.k), str(r.t)) for r in rows.collect())
    for key in (1, None):
        mine = [(r.piece, -1 if r.t is None else r.t) for r in cut if r.k == key]
        assert len({p for p, _ in mine}) > 2 and min(p for p, _ in mine) > 0
        ranges = sorted((min(t for q, t in mine if q == p), max(t for q, t in mine if q == p)) for p in sorted({p for p, _ in mine}))
        assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
    assert {r.piece for r in cut if r.k == 2} == {0}


TRICKY = ["", "</s>", "[ROLE]x[/ROLE]", r"<\/s> [\\INST] \[INST]", "</s", "[", "<|im_end|>[IMAGE]", "é\n[/INST]😀", "\\", "<s></s></s>", "plain words here", "[[[INST]", "$1 \\1 {}"]


def brute_chat(rows):
    """Ties in turn go by role, then the escaped text."""
    escaped = lambda x: re.sub(rf"([<\[])(\\*)({chat._controls()})", r"\1\\\2\3", x)
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((((t is not None, t or 0), r or "", escaped(x or "")), r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, turns in by.items():
        turns.sort()
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(learnt), sha(learnt))
    return out


def test_chat_is_read_back(spark):
    rng = random.Random(2)
    roles = ["user", "assistant", "system", None, "", "odd[/ROLE]role</s>"]
    rows = [(c, t, rng.choice(roles), rng.choice([*TRICKY, None])) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", "first"), (77, 1, "user", "x" * 400_000 + "</s>"), (5, 0, rows[0][2], "tie")] + [(88, t % 50, "assistant", f"{TRICKY[t % len(TRICKY)]} {t // 50}") for t in range(900)]
    frame = spark.createDataFrame([(*r, "t", 3, []) for r in rows], "conv_id long, turn long, role string, text string, segment string, piece int, parts array<string>")
    for most in (4096, 100):
        made = chat.format_chat(frame, most_turns=most)
        got = {r.conv_id: tuple(r)[1:5] for r in chat.chat_digests(made).collect()}
        assert got == brute_chat(rows)
        assert made.filter("conv_id = 88").count() == 1 if most == 4096 else made.filter("conv_id = 88").count() > 3
    for r in made.collect():
        bare = r.formatted
        assert bare.count(chat.END) == r.n_turns and not re.search(r"\[/?INST\]|<\|im_|<s>", bare)
        assert all(bare[a:b] + chat.END == bare[a : b + 4] for _, a, b in r.loss_mask)
    assert chat.chat_digests(chat.format_chat(frame.limit(0))).collect() == []


def test_probe_is_a_conversation(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    (row,) = chat.chat_digests(chat.format_chat(chat.with_probe(none))).collect()
    assert tuple(row)[:5] == (-1, *brute_chat([(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)])[-1])


def test_typed_parts_become_placeholders(spark):
    inner = [{"type": "text", "text": "page [IMAGE] one"}, {"type": "image", "ref": "s3://fig", "width": 28, "height": 57}, None]
    parts = [
        {"type": "text", "text": "look at "}, {"type": "image", "ref": "a.png", "width": 280, "height": 140}, {"type": "audio", "ref": "b.wav", "seconds": 1.5},
        {"type": "document", "ref": "c.pdf", "pages": 2, "parts": inner}, {"type": "text", "text": None}, {"type": None, "text": "bye now"}, {"type": "image"}, None,
    ]
    frame = spark.read.json(spark.sparkContext.parallelize([json.dumps({"conv_id": 1, "turn": 0, "role": "assistant", "parts": parts}), json.dumps({"conv_id": 2, "turn": 0, "role": "user", "parts": None})]), schema=f"conv_id long, turn long, role string, parts {chat.PARTS}")
    made = {r.conv_id: r for r in chat.format_chat(frame, parts_col="parts").collect()}
    assert made[1].formatted == r"[ROLE]assistant[/ROLE]look at [IMAGE][AUDIO][DOCUMENT]page [\IMAGE] one[IMAGE]bye now[IMAGE]</s>"
    assert [tuple(a) for a in made[1].attachments] == [(0, 1, "image", "a.png", 55), (0, 2, "audio", "b.wav", 38), (0, 3, "document", "c.pdf", 1024), (0, 5, "image", "s3://fig", 6), (0, 8, "image", None, 0)]
    assert made[1].n_tokens == 55 + 38 + 1024 + 6 + 2 + 3 + 2 and made[2].formatted == "[ROLE]user[/ROLE]</s>"
    (back,) = chat.format_chat(frame, parts_col="parts").filter("conv_id = 1").select(chat.read_chat(F.col("formatted"), F.col("turn_starts"), F.col("loss_mask")).alias("r")).collect()
    assert [tuple(p) for p in back.r.turns[0].parts] == [("text", "look at "), ("image", None), ("audio", None), ("document", None), ("text", "page [IMAGE] one"), ("image", None), ("text", "bye now"), ("image", None)]
    assert back.r.learnt == ["look at page [IMAGE] onebye now"]


def brute_trie(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append(((t is not None, t or 0), r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in by.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + v[h:]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
            if d:
                kids[tuple(v[: d - 1])].add(tuple(v[:d]))
        ends[tuple(v)].append(c)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = sum(saved[k] for k in kids[n]) + ((len(members[n]) - 1) * len(WORD.findall(n[-1][1])) if n else 0)
    return sorted((min(members[n]), len(n), min(members[n[:-1]]) if n else -1, len(members[n]), len(kids[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n in members)


def trie_rows(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def test_trie_against_brute_force(spark, monkeypatch):
    from probity.llm import trie

    rng = random.Random(8)
    texts = ["hello there", "how are you", "fine", "", None, "a b  c\td"]
    rows = []
    for c in range(-30, 400):
        rows += [(c, t, rng.choice(["user", "assistant", None]) if t else "user", rng.choice(texts[: 1 + t % 6])) for t in range(rng.randint(1, 6))]
    rows += [(500 + c, t, "user", "same") for c in range(60) for t in range(5)]
    rows += [(None, 1, "user", "x"), (3, None, None, None), (3, 2, "user", "tie"), (3, 2, "user", "tie"), (9, 1, "user", "word " * 100_000)]
    rows += [(1000, t, "user", "turn" if t % 7 else None) for t in range(700)] + [(1001, t, "user", "turn" if t % 7 and t < 690 else None) for t in range(900)]
    frame = spark.createDataFrame([(*r, 1, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, x int, path string")
    want = brute_trie(rows)
    assert trie_rows(shared_trie(frame)) == want
    monkeypatch.setattr(trie, "RUN", 16)
    monkeypatch.setattr(trie, "IDS", 8)
    assert trie_rows(shared_trie(frame, most_turns=50)) == want


def test_tries_of_few_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert shared_trie(none).collect() == []
    turnless = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3][:2]
    for rows in ([(c, t, "user", "x") for c in turnless for t in range(2)], [(0, 0, None, None)], [(turnless[0], 0, "user", "a"), (0, 0, "user", "b b"), (0, 1, "user", "c")]):
        assert trie_rows(shared_trie(none.unionByName(spark.createDataFrame(rows, none.schema)))) == brute_trie(rows)
