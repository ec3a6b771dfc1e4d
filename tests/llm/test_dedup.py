"""Exact, near, line and substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from probity.llm import substring_dedup
from probity.llm.components import connected_components
from probity.llm.common import Scratch
from probity.llm.exact_dedup import drop_exact_copies, exact_groups
from probity.llm.lines import dedup_units
from probity.llm.simhash import _held_apart, _held_twice, alike, fingerprints, fuzzy_keys, golay_index, link_fingerprints, near_copies, near_duplicates
from probity.llm.substring_dedup import remove_repeats
from probity.llm.suffix import FMIndex, SuffixArray, maximal_repeats

DOCS = "doc_id long, text string, keep_id string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


def test_suffix_array_and_maximal_repeats_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        s = rng.integers(1, 4, rng.integers(1, 50))
        lst, sa = s.tolist(), SuffixArray(s)
        assert sa.order.tolist() == sorted(range(len(lst)), key=lambda i: lst[i:])
        length, first, last, order = maximal_repeats(s, 2, 0)
        got = {(int(n), tuple(sorted(order[a : b + 1].tolist()))) for n, a, b in zip(length, first, last)}
        want, subs = set(), {}
        for n in range(2, len(lst)):
            for i in range(len(lst) - n + 1):
                subs.setdefault(tuple(lst[i : i + n]), []).append(i)
        for sub, at in subs.items():
            left = {lst[p - 1] if p else "start" for p in at}
            right = {lst[p + len(sub)] if p + len(sub) < len(lst) else "end" for p in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.add((len(sub), tuple(at)))
        assert got == want
        index = FMIndex(s, 5, 4)
        p = rng.integers(1, 4, 3)
        lo, hi = index.find(p[None, :], np.array([3]))
        assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == [i for i in range(len(lst) - 2) if lst[i : i + 3] == p.tolist()]


def brute_repeats(rows, n):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - n + 1):
            first[b[s : s + n]] = min(i, first.get(b[s : s + n], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - n + 1):
            if first[b[s : s + n]] < i:
                gone[s : s + n] = True
        runs = int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 1500, "hot_blocks": 2}])
def test_substring_dedup(spark, options):
    random.seed(5)
    base = ["".join(random.choices("abcé \n", k=random.randint(40, 300))) for _ in range(8)]
    rows = [(1000, None), (1001, ""), (1002, "short"), (1003, "z" * 5000)]
    for i in range(80):
        b, c = random.choice(base), random.choice(base)
        kind = random.random()
        text = b if kind < 0.3 else "xy" * random.randint(20, 200) if kind < 0.4 else b[: random.randint(0, len(b))] + "Q" + c[random.randint(0, len(c) - 1) :]
        rows.append((random.randint(0, 60) if i % 10 == 0 else i * 3, text))
    got = sorted(tuple(r) for r in remove_repeats(frame(spark, rows).repartition(3), 50, **options).collect())
    assert got == brute_repeats(rows, 50)


def test_passages_of_one_text_are_not_dealt_string_by_string(spark, monkeypatch):
    """A passage in every block needs one segment a block; only minima with many texts are spread, and these in whole arrays."""
    rng = random.Random(3)
    own = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    line, passage = own(45), own(400)
    rows = [(i, own(rng.randint(30, 90)) + (passage if i % 2 else line) + own(rng.randint(30, 90))) for i in range(120)]
    dealt = []
    for k in range(0, 120, 6):
        ids, texts = zip(*rows[k : k + 6])
        offs = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        block = {"block": k, "ids": np.array(ids).tobytes(), "offsets": offs.tobytes(), "z": substring_dedup.zstandard.ZstdCompressor().compress("".join(texts).encode())}
        dealt.append(pa.RecordBatch.from_pylist([block]))
    found = [tuple(r.values()) for b in substring_dedup._anchors(iter(dealt), 50, 1) for r in b.to_pylist()]
    shared = [r for b in substring_dedup._shared(iter([substring_dedup._rows(found)]), 10) for r in b.to_pylist()]
    spread = in_passage = 0
    for block, (_, _, _, data), bits in zip(dealt, found, shared):
        row = block.to_pylist()[0]
        ids, offs, buf = substring_dedup._open(row)
        runs = substring_dedup.Runs(buf, offs, 50)
        keys, back = np.unique(substring_dedup._anchor_keys(runs, 1), return_inverse=True)
        often = np.unpackbits(np.frombuffer(bits["data"], np.uint8)[(len(keys) + 7) // 8 :], count=len(keys))[back] > 0
        text = buf.tobytes()
        for r, s, c, hot in zip(runs.row.tolist(), runs.start.tolist(), runs.count.tolist(), often.tolist()):
            whole = text[offs[r] + s : offs[r] + s + c + 49].decode() in passage
            in_passage += whole
            spread += hot
            assert not (whole and hot)
    assert spread > 100 and in_passage > 500
    want = brute_repeats(rows, 50)
    options = {"block_bytes": 1500, "hot_blocks": 2}
    assert sorted(tuple(r) for r in remove_repeats(frame(spark, rows).repartition(2), 50, **options).collect()) == want
    # strings that share a hash are told apart by their bytes
    some = np.frombuffer(b"".join(rng.choice([b"x", b"y", b"\0"]) * 50 for _ in range(99)), np.uint8).reshape(99, 50)
    plain = len(substring_dedup._alike(some)[1])
    monkeypatch.setattr(substring_dedup, "mix", np.zeros_like)
    order, first, _ = substring_dedup._alike(some)
    assert plain == len(first) == 3 and all(len({bytes(x) for x in part}) == 1 for part in np.split(some[order], first[1:]))


def test_substring_dedup_spans_text_and_empty_table(spark):
    p = "0123456789" * 6
    got = {r.doc_id: r for r in remove_repeats(frame(spark, [(2, "A" + p + "B"), (1, p), (None, "q")]), 50, with_text=True, with_spans=True).collect()}
    assert got[2].removed_spans == [[1, 61]] and bytes(got[2].kept) == b"AB" and got[1].n_removed == 0 and got[None].n_bytes == 1
    assert remove_repeats(frame(spark, []), 50).collect() == []


def test_exact_groups(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "A"), (5, "A"), (None, "n"), (7, "long " * 50000), (8, "long " * 50000), (None, "a")]
    for keep, pick in (("largest", max), ("smallest", min)):
        got = exact_groups(frame(spark, rows).repartition(3), keep=keep).collect()
        assert len(got) == len(rows)
        for r in got:
            same = [i for i, t in rows if (t or "") == next((u or "") for j, u in rows if j == r.doc_id and hashlib.sha256((u or "").encode()).hexdigest() == r.text_sha256)]
            ids = [i for i in same if i is not None]
            assert r.group_size == len(same) and r.keep_id == (pick(ids) if ids else None)
        for sha in {r.text_sha256 for r in got}:
            assert sum(r.kept for r in got if r.text_sha256 == sha) == 1
    assert exact_groups(frame(spark, [])).collect() == []
    assert sorted(r.doc_id for r in drop_exact_copies(frame(spark, [(1, "a"), (2, "a"), (3, "b")])).collect()) == [1, 3]


def brute_fingerprint(text, shingle=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def test_golay_keys_meet_for_all_pairs_within_four_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 500)
    again = golay_index(x ^ (1 << rng.integers(0, 23, 500)))
    assert (golay_index(x) >= 0).all() and (again < 4096).all()
    fp = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    for bits in range(5):
        other = fp.copy()
        for k in range(len(fp)):
            for b in rng.choice(64, bits, replace=False):
                other[k] ^= np.uint64(1) << np.uint64(b)
        k1, r1 = fuzzy_keys(fp)
        k2, r2 = fuzzy_keys(other)
        met = {r for _, r in set(zip(k1.tolist(), r1.tolist())) & set(zip(k2.tolist(), r2.tolist()))}
        assert len(met) == len(fp)


def test_near_duplicates_against_brute_force(spark):
    random.seed(2)
    vocab = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "one", "One", "a b c", "x " * 30000]
    for _ in range(25):
        base = random.choices(vocab, k=random.randint(150, 400))
        texts.append(" ".join(base))
        for _ in range(3):
            c = list(base)
            c[random.randrange(len(c))] = random.choice(vocab)
            texts.append("  ".join(c))
    rows = list(enumerate(texts)) + [(3, "one"), (None, "one")]
    random.shuffle(rows)
    fps = {t: brute_fingerprint(t) for _, t in rows}
    distinct = sorted(set(fps.values()))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        if i is not None:
            least[find(fps[t])] = min(i, least.get(find(fps[t]), i))
    want = sorted((str(i), f"{fps[t]:016x}", least[find(fps[t])]) for i, t in rows)
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in near_duplicates(frame(spark, rows)).collect())
    assert got == want
    assert near_duplicates(frame(spark, [])).collect() == []


def test_fingerprints_of_long_texts():
    t = b" ".join(b"q%d" % (i % 7) for i in range(255 + 3 + 255))
    assert fingerprints(iter([t])).tolist() == [brute_fingerprint(t.decode())]


def test_links_of_a_key_with_very_many_fingerprints(spark):
    rng = np.random.default_rng(4)
    base = 0x0123456789ABCDEF
    fps = {base}
    for _ in range(300):
        f = base
        for b in rng.choice(12, rng.integers(1, 6), replace=False):
            f ^= 1 << int(b)
        fps.add(f)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = link_fingerprints(df, Scratch(spark, "t"), block=40)
    roots = {r.node: r.root for r in connected_components(links, Scratch(spark, "t")).collect()}
    assert set(roots.values()) == {min(fps)} and set(roots) == fps


def test_lines(spark):
    a, b = "One two three four five", "six seven eight nine ten"
    rows = [(2, f"{a}\n{b}\nshort\n{a}"), (1, f"x\n{a.upper()}  \nshort"), (3, None), (4, ""), (5, b), (6, b), (6, b)]
    got = {(r.doc_id, r.kept_text): r for r in dedup_units(frame(spark, rows).repartition(2), kind="line", min_words=5).collect()}
    assert got[2, f"{b}\n"].removed_spans == [[0, 24], [49, 78]]  # a short line goes with the repeat that follows
    assert got[1, f"x\n{a.upper()}  \nshort"].n_removed == 0
    assert (3, "") in got and (4, "") in got and (5, "") in got and (6, "") in got
    assert got[3, ""].n_units == 0
    assert dedup_units(frame(spark, [])).collect() == []
    p = "one two three four five\nsix"
    two = dedup_units(frame(spark, [(1, f"{p}\n\n{p}\n \nend of the last one here")]), kind="paragraph", min_words=5).first()
    assert two.kept_text == f"{p}\n\nend of the last one here" and two.n_units == 3


def test_lines_with_clashing_columns_null_and_repeated_ids(spark):
    a = "one two three four five six seven. "
    rows = [(None, a, 1, 2), (7, a + "x", 3, 4), (7, "y " + a, 5, 6), (8, a, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int, n_removed int").withColumnRenamed("gone", "gone_id")
    got = sorted((r.doc_id or 0, r.gone_id, r.n_removed, r.kept_text) for r in dedup_units(df.withColumn("salt", df.gone_id), min_words=5).collect())
    assert got == [(0, 1, 0, a), (7, 3, 1, "x"), (7, 5, 0, "y " + a), (8, 7, 1, "")]


def test_passages_inside_lines_are_found_and_common_lines_stay(spark):
    """Passages of over 50 words, put between words of other lines, against short lines that all documents share."""
    rng = random.Random(17)
    vocab = [f"w{i}" for i in range(3000)]
    sentence = lambda: " ".join(rng.choices(vocab, k=rng.randint(4, 14))) + "."
    passages, rows = [" ".join(sentence() for _ in range(8)) for _ in range(20)] + [" ".join(rng.choices(vocab, k=70)) for _ in range(20)], []
    for i in range(200):
        own = " ".join(sentence() for _ in range(rng.randint(3, 12)))
        w = own.split()
        at = rng.randrange(len(w))
        text = " ".join([*w[:at], *([passages[i % 40]] if i % 2 else []), *w[at:]]) if i % 4 else "\n".join(sentence() for _ in range(6))
        rows.append((i, text + "\nall rights are reserved by us."))
    got = {r.doc_id: r.n_removed for r in dedup_units(frame(spark, rows)).collect()}
    later = [i for i in range(40, 200) if i % 2]
    assert sum(got[i] > 0 for i in later) >= 0.95 * len(later)
    assert all(got[i] == 0 for i in range(0, 200, 2))


def test_a_very_long_line(spark):
    rng = random.Random(2)
    a, b = (" ".join(f"v{rng.randrange(100000)}" for _ in range(200_000)) for _ in range(2))
    got = {r.doc_id: r for r in dedup_units(frame(spark, [(1, a), (2, b[:700_000] + " " + a), (3, "z" * 2_000_000)]), keep=["doc_id"]).collect()}
    assert got[1].n_removed == 0 and len(got[2].kept_text) < 701_000 and got[3].n_units == 1


def test_alike_decides_exactly_and_deals_hubs(spark):
    base = list(range(100))
    sets = [(0, base)] + [(k, base[: 100 - k % 40]) for k in range(1, 700)] + [(1000, [])]
    links = [(0, k) for k in range(1, 700)] + [(0, 1000)]
    got = alike(spark.createDataFrame(links, "a long, b long"), spark.createDataFrame(sets, "node long, hs array<int>"), 0.8, most=16).collect()
    assert sorted((r.a, r.b) for r in got) == [(0, k) for k in range(1, 700) if k % 40 <= 20]


def test_near_copies_are_as_alike_as_said(spark):
    """Texts under the limit stay apart, with ids that are null or repeated too."""
    random.seed(5)
    vocab, rows = [f"w{i}" for i in range(2000)], []
    for k in range(40):
        base = random.choices(vocab, k=300)
        for c in range(5):  # up to 4 % of the words: from 1.0 down to about 0.65
            w = list(base)
            for _ in range(c * 3):
                w[random.randrange(len(w))] = random.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    grams = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    linked = {(i, j) for i in grams for j in grams if i < j and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])}
    got = {r.doc_id: r.component_id for r in near_copies(frame(spark, rows)).collect()}
    for i, c in got.items():
        assert c == i or any(i in e and got[e[0]] == got[e[1]] for e in linked)
    assert sum(got[i] == got[j] for i, j in linked) / len(linked) > 0.9
    odd = [(None, rows[0][1]), (None, rows[0][1] + " more"), (3, rows[5][1]), (3, rows[10][1]), (900, None), (901, "")]
    out = near_copies(frame(spark, [(7, rows[0][1]), *odd])).collect()
    assert {r.component_id for r in out if r.doc_id is None} == {7} and len(out) == 7
    assert {r.component_id for r in out if r.doc_id in (900, 901)} == {900}
    assert near_copies(frame(spark, [])).collect() == []


def test_near_copies_that_are_cut_or_appended_to(spark):
    """Groups equal those of all pairs compared by brute force, whatever the edit."""
    rng = random.Random(8)
    vocab, rows = [f"w{i}" for i in range(4000)], []
    for _ in range(60):
        base = rng.choices(vocab, k=rng.randint(60, 900))
        cut, more = rng.choice((0.1, 0.15, 0.19)), rng.choice((0.1, 0.15, 0.19))
        rows += [base, base[: int(len(base) * (1 - cut))], base + rng.choices(vocab, k=int(len(base) * more)), base[int(len(base) * cut) :]]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    grams = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    root = list(range(len(rows)))
    for i in grams:
        for j in range(i):
            if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert {r.doc_id: r.component_id for r in near_copies(frame(spark, rows)).collect()} == dict(enumerate(root))


def test_near_copies_join_whatever_exact_linkage_joins(spark):
    """A family's pairs are over and under the limit; a link that passes counts though others lead round it that don't."""
    rng = random.Random(21)
    vocab, rows = [f"w{i}" for i in range(4000)], []
    for _ in range(20):
        base = rng.choices(vocab, k=rng.randint(150, 400))
        for _ in range(12):
            w = list(base)
            for _ in range(int(len(w) * rng.uniform(0.005, 0.025))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    grams = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    root = list(range(len(rows)))
    for i in grams:
        for j in range(i):
            if root[i] != root[j] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    # blocks of 5: keys of a family are compared block against block
    assert {r.doc_id: r.component_id for r in near_copies(frame(spark, rows), block=5).collect()} == dict(enumerate(root))


def test_near_copies_of_real_texts_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(rows)
    grams = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := re.sub("[A-Z]", lambda m: m[0].lower(), rows[i]).encode().split()) else set() for i in ids]
    names = {g: k for k, g in enumerate(set().union(*grams))}
    has = np.zeros((len(ids), len(names)), np.float32)
    for k, g in enumerate(grams):
        has[k, [names[x] for x in g]] = 1
    size, both = has.sum(axis=1), has @ has.T
    linked = (both >= 0.8 * (size[:, None] + size[None] - both) - 1e-6) & (both > 0) | ((size[:, None] == 0) & (size[None] == 0))
    root = list(range(len(ids)))
    for a, b in zip(*np.nonzero(np.triu(linked, 1))):
        if root[a] != root[b]:
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert len(set(root)) < len(root)
    assert {r.doc_id: r.component_id for r in near_copies(docs).collect()} == {i: ids[r] for i, r in zip(ids, root)}


def test_shared_keys_are_found_across_batches():
    rng = np.random.default_rng(3)
    rows = sorted({(int(k), int(n) % 3, int(n)) for k, n in zip(rng.integers(0, 60, 900), rng.integers(0, 40, 900))} | {(70, 1, n) for n in range(50)} | {(71, 1, 2), (71, 2, 3)})
    for step in (1, 2, 7, 5000):
        for pick, name in ((lambda r: r[2], _held_twice), (lambda r: r[1], _held_apart)):
            some = [r for r in rows if r[0] % 3 or r[1] == 1]
            use = sorted((r[0], r[2]) for r in some) if name is _held_twice else some
            cut = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*use[s : s + step])], names=[str(j) for j in range(len(use[0]))]) for s in range(0, len(use), step)]
            got = sorted((r["key"], r["node"]) for b in name(iter(cut)) for r in b.to_pylist())
            keys = {k: {pick(r) for r in some if r[0] == k} for k in {r[0] for r in some}}
            assert got == sorted((r[0], r[2]) for r in some if len(keys[r[0]]) > 1)


def test_exact_groups_with_heavy_texts(spark):
    rows = [(i if i % 50 else None, ("same" if i % 3 else "other") if i % 4 else f"t{i}") for i in range(3000)] + [(7, "same")] * 3
    df = frame(spark, rows).repartition(5)
    for keep, best in (("smallest", min), ("largest", max)):
        got = exact_groups(df, keep=keep).collect()
        assert len(got) == len(rows)
        for text in ("same", "other", "t4"):
            own = [i for i, t in rows if t == text]
            mine = [r for r in got if r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
            assert {(r.keep_id, r.group_size) for r in mine} == {(best(i for i in own if i is not None), len(own))}
            assert [r.doc_id for r in mine if r.kept] == [mine[0].keep_id]
        assert sorted(t for _, t in [(r.doc_id, r.text) for r in drop_exact_copies(df, keep=keep).collect()]) == sorted({t for _, t in rows})
