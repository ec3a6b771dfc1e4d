"""The pipeline's stages against brute force on the smallest tables, and on odd rows."""

import gc
import math
import re
import time
from pathlib import Path

import duckdb
from test_scan import brute_leaks, plain_difference

import corpus_pipeline
from probity.llm import common, queries
from probity.llm.mixing import mix_sql
from probity.llm.settings import DOMAINS, WEIGHTS
from probity.llm.toxicity import CURVES, held_out, train_model

SF = "/root/testdata/sf0.001"


def brute_near(texts):
    """Ids that go of {id: text}: all of a group of alike texts but the smallest id."""
    grams = {}
    for i, t in texts.items():
        w = "".join(c.lower() if c < "\x80" else c for c in t).encode().split()
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and root[i] != root[j] and grams[i] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return {i for i in texts if root[i] != i}


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {r.doc_id: r.text or "" for r in docs.collect()}
    labels, held = {}, {r[0] for r in docs.select("doc_id").filter(held_out(docs.doc_id)).collect()}
    for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic is not null").collect():
        labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.toxic)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id: r.text or "" for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        after = {r.doc_id: r.text or "" for r in out.collect()}
        if name == "toxicity":
            model = train_model(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~held_out(docs.doc_id))
            train = [i for i in before if i in labels and i not in held]
            x = dict(zip(before, plain_difference([(before[i], labels[i]) for i in train], share=model.share, others=[before[i] for i in before])[len(train) :]))
            score = {i: 1 / (1 + math.exp(-(model.weights[0] * CURVES[model.curve][0](v) + model.weights[1]))) for i, v in x.items()}
            want = {i for i in before if score[i] < 0.3}
        elif name == "exact dedup":
            want = {min(i for i, t in before.items() if t == u) for u in set(before.values())}
        elif name == "SimHash near-dedup":
            want = set(before) - brute_near(before)
        else:
            want = {r[0] for r in brute_leaks(list(before.items()), items) if r[2] == 0}
        assert set(after) == want and all(after[i] == before[i] for i in after), name
        out.write.parquet(f"{tmp_path}/{len(seen)}-{name.split()[0]}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}-{name.split()[0]}")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.sql(mix_sql(DOMAINS, WEIGHTS, 500, 2, 7)).df()
    got = corpus_pipeline.mixture(spark, docs, SF).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch").toPandas()
    key = lambda df: sorted(map(str, df[["doc_id", "domain", "n_tokens", "epoch"]].itertuples(index=False, name=None)))
    assert key(got) == key(want) and 0 < len(got)
    ran = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.epoch) for r in ran.collect()) == sorted(zip(got.doc_id, got.epoch))


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, columns with names that stages use, and empty tables."""
    names = ["score", "predicted", "n_hit", "domain", "epoch", "gone", "key", "text_", "head", "salt", "kept", "spans", "t1", "x"]
    long = "alpha beta gamma delta " * 30_000
    rows = [(1, "one two three four five six seven", "en", "src1", 7), (2, None, None, None, None), (3, "", "en", "src2", 0), (None, "no id here at all", "en", "src1", 4), (None, None, None, None, None)]
    rows += [(4, rows[0][1], "en", "src1", 7), (5, long, "de", "src9", 1), (6, long + "end", "de", "src9", 1), (7, "seven words of the benchmark are in here now", "fr", "src3", 9), (7, "seven words of the benchmark are in here now", "fr", "src3", 9)]
    docs = spark.createDataFrame([(*r, *(f"{c}{k}" for c in names)) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    spark.createDataFrame([(1, 0, 0), (None, 1, 1), (3, None, None), (4, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "words of the benchmark are in here now"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    gone = {"exact dedup": 4, "SimHash near-dedup": 2, "benchmark decontamination": 2}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns
        got = out.collect()
        was = {tuple(r) for r in docs.collect()}
        assert all(tuple(r)[: len(docs.columns)] in was for r in got)
        if name in gone:
            assert len(got) == len(rows) - gone[name], name
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.collect() == [] and none.columns == out.columns


def test_queries_match_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        want = con.sql(sql).df()
        got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
        key = lambda df: sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
        assert [x.replace(".0", "") for x in key(got)] == [x.replace(".0", "") for x in key(want)], name


def test_every_operator_has_one_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES if q.startswith("op")) == list(range(1, 14))


def test_written_tables_shrink_a_grown_heap(spark, monkeypatch):
    shrunk = []
    monkeypatch.setattr(common.Scratch, "tidy", lambda self, last=False: shrunk.append(last))
    for share in (1.0, 0.0):
        monkeypatch.setattr(common, "HEAP_SHARE", share)
        assert common.Scratch(spark, "heap").keep(spark.range(9), "nine").count() == 9
    assert shrunk == [False]


def test_written_tables_give_the_driver_s_free_memory_back(spark, monkeypatch):
    jvm, pid, seen = spark._jvm, spark._jvm.java.lang.ProcessHandle.current().pid(), []
    mb = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024
    monkeypatch.setattr(common, "trim_driver", lambda s, f=common.trim_driver: seen.extend((mb(), f(s), mb())))
    buffers = [jvm.java.nio.ByteBuffer.allocateDirect(1 << 16) for _ in range(1000)]
    used = buffers[::50]  # they hold back the free memory between them
    del buffers
    gc.collect()
    jvm.System.gc()
    time.sleep(2)
    assert common.Scratch(spark, "native").keep(spark.range(9), "nine").count() == 9
    assert len(used) == 20 and seen[0] - seen[-1] > 20
