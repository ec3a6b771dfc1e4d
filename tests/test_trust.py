"""Signatures, model files, tensor digests, appended Merkle trees and published files."""

import hashlib
import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.operators import models, provenance, signatures
from probity.plans import scan
from probity.sources import models as files
from probity.sources import publish as pub

#: RFC 8032, 7.1: public key, message, signature.
VECTORS = [
    ("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "r", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
]


def sign(secret: bytes, text: str) -> tuple[str, str]:
    h = hashlib.sha512(secret).digest()
    a = int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | 1 << 254
    times = lambda k: signatures.encode(signatures.combine([(k, signatures.BASE)]))
    key = times(a)
    r = int.from_bytes(hashlib.sha512(h[32:] + text.encode()).digest(), "little") % signatures.ORDER
    big = times(r)
    k = int.from_bytes(hashlib.sha512(big + key + text.encode()).digest(), "little") % signatures.ORDER
    return key.hex(), (big + ((r + k * a) % signatures.ORDER).to_bytes(32, "little")).hex()


def test_signatures_of_the_standard():
    keys, texts, sigs = zip(*VECTORS)
    assert signatures.verify(list(texts), list(sigs), list(keys)) == ["VALID"] * 2
    assert signatures.verify(["x", "r"], list(sigs), list(keys)) == ["INVALID", "VALID"]
    assert sign(bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60"), "") == (VECTORS[0][0], VECTORS[0][2])
    big = (int.from_bytes(bytes.fromhex(sigs[0])[32:], "little") + signatures.ORDER).to_bytes(32, "little").hex()
    odd = [None, "", " ", "zz", "ab", sigs[0][:-2], sigs[0][:64] + big, "ff" * 32 + sigs[0][64:], sigs[0]]
    assert signatures.verify([""] * 9, odd, [keys[0]] * 9) == ["NO_SIGNATURE"] * 3 + ["MALFORMED"] * 3 + ["INVALID"] * 2 + ["VALID"]
    assert signatures.verify([""] * 3, [sigs[0]] * 3, [None, "ab", "02" + "00" * 31]) == ["NO_KEY", "MALFORMED", "MALFORMED"]


def test_a_bad_signature_in_a_batch_is_found(spark):
    secrets = [hashlib.sha256(bytes([i])).digest() for i in range(3)]
    base = spark.range(150).select(F.lit("c").alias("chain"), F.format_string("r%d", "id").alias("record_id"), *(F.lit("h").alias(c) for c in ("input_hash", "model_hash", "config_hash", "output_hash")), F.col("id").cast("string").alias("nonce"), (F.col("id") * 10**10).alias("timestamp_ns"), F.lit("o").alias("output"))
    base = base.withColumn("output_hash", F.sha2("output", 256))
    linked = provenance.link_records(base, "chain", ["timestamp_ns"])
    rows = [(r.record_id, *sign(secrets[int(r.nonce) % 3], r.m)) for r in linked.withColumn("m", signatures.signed_payload()).collect()]
    flip = lambda s: ("0" if s[-40] != "0" else "1").join((s[:-40], s[-39:]))
    rows = [(i, k, flip(s) if i in ("r17", "r140") else "" if i == "r5" else "xy" if i == "r6" else s) for i, k, s in rows]
    signed = linked.join(spark.createDataFrame(rows, "record_id string, key string, signature string"), "record_id")
    got = {r.record_id: r.signature_check for r in signatures.verify_signatures(signed, F.col("key")).collect()}
    assert {k: v for k, v in got.items() if v != "VALID"} == {"r17": "INVALID", "r140": "INVALID", "r5": "NO_SIGNATURE", "r6": "MALFORMED"}
    a = scan.scan_records(signed, "chain", ["timestamp_ns"], F.col("key"))
    assert sorted(r.affected_asset for r in a.findings.filter("attack_class = 'SIGNATURE_INVALID'").collect()) == ["r140", "r17", "r6"] and a.limitations
    assert set(r[0] for r in signatures.verify_signatures(signed, None).select("signature_check").distinct().collect()) == {"NO_SIGNATURE", "NO_KEY"}


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def message(*parts):
    """Wire format of (number, value) pairs: numbers as varints, bytes and texts by length."""
    raw = [(k, v.encode() if isinstance(v, str) else v) for k, v in parts]
    return b"".join(varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v for k, v in raw)


def described(name, dims):
    return message((1, name), (2, message((1, message((1, 1), (2, b"".join(message((1, message((1, d) if isinstance(d, int) else (2, d)))) for d in dims)))))))


def test_onnx_weights_are_read_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(3)
    conv, fc, half = rng.normal(size=(4, 3, 2, 2)).astype("<f4"), rng.normal(size=(7, 4000)).astype("<f8"), rng.normal(size=9).astype("<f2")
    brain = (np.array([1.5, -2.0], "<f4").view("<u4") >> 16).astype("<u2")
    dims = lambda a: [(1, d) for d in a.shape]
    tensors = [
        message(*dims(conv), (2, 1), (8, "conv"), (9, conv.tobytes())), message((1, varint(7) + varint(4000)), (2, 11), (8, "fc.weight"), (10, fc.tobytes())), message((1, 9), (2, 10), (9, half.tobytes()), (8, "half")),
        message((1, 2), (2, 16), (8, "bf"), (9, brain.tobytes())), message((1, 3), (2, 1), (8, "short"), (9, b"1234")), message((1, 2), (2, 1), (8, "away"), (13, b"x"), (14, 1)), message((2, 7), (8, "scalar"), (9, struct.pack("<q", -5))),
    ]
    graph = message((1, b"node" * 30000), *((5, t) for t in tensors), (11, described("conv", [4])), (11, described("x", ["n", 3, 32, "w"])), (12, described("y", ["n", 7])))
    path = tmp_path / "m.onnx"
    path.write_bytes(message((1, 8), (2, "me"), (7, graph), (8, b"")))
    d = files.describe(str(path))
    assert (d["access"], d["classes"], d["input_shape"]) == ("WHITE_BOX", 7, (3, 32, 224)) and len(d["limitations"]) == 2
    w = files.load_weights(spark, str(path), range_bytes=1 << 12)
    assert w.rdd.getNumPartitions() > 50
    got = {r.layer: np.array(r.v) for r in w.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("l")).select("layer", F.col("l.value").alias("v")).collect()}
    assert set(got) == {"conv", "fc.weight", "half", "bf", "scalar"} and list(got["bf"]) == [1.5, -2.0] and list(got["scalar"]) == [-5]
    assert all((got[k] == v.astype(float).ravel()).all() for k, v in (("conv", conv), ("fc.weight", fc), ("half", half)))
    assert {r.layer: r.n for r in models.layer_stats(w).collect()}["fc.weight"] == 28000
    path.write_bytes(path.read_bytes()[:1000])
    assert files.describe(str(path))["access"] == "UNAVAILABLE" and files.describe(str(tmp_path / "no.onnx"))["limitations"] and "not opened" in files.describe("m.pt")["limitations"][0]


def test_tensor_digests_know_every_value(spark, monkeypatch):
    monkeypatch.setattr(models, "CHUNK", 64)
    w = spark.range(1000).select(F.when(F.col("id") < 700, "a").otherwise("b").alias("layer"), "id", F.sin(F.col("id").cast("double")).alias("value")).withColumnRenamed("id", "pos")
    digest = lambda d: models.model_digest(d).first()[0]
    first = digest(w)
    assert first == digest(w.repartition(7, "value")) == digest(w.coalesce(1).orderBy(F.desc("pos")))
    assert len({first, digest(w.withColumn("value", F.when(F.col("pos") == 123, F.col("value") + 1e-15).otherwise(F.col("value")))), digest(w.filter("pos <> 999")), digest(w.withColumn("pos", F.col("pos") + 1)), digest(w.withColumn("layer", F.concat("layer", F.lit("x"))))}) == 5
    assert digest(w.limit(0)) == "0" * 64 and {r.layer: r.n for r in models.tensor_digests(w).collect()} == {"a": 700, "b": 300}


def test_appended_trees_equal_rebuilt_ones(spark, monkeypatch):
    monkeypatch.setattr(provenance, "SUBTREE", 3)
    rng = random.Random(4)
    frontier, n, history = [], 0, []
    for m in (1, 2, 5, 8, 70, 1, 19):
        leaves = spark.range(m).select(F.col("id").alias("pos"), F.sha2((F.col("id") + n).cast("string"), 256).alias("hash"))
        old, (frontier, cover) = frontier, provenance.append_leaves(frontier, leaves)
        before, n = provenance.frontier_root(old), n + m
        whole = provenance.merkle_root(spark.range(n).select(F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))).first().root
        assert provenance.frontier_root(frontier) == whole and len(frontier) == bin(n).count("1")
        assert provenance.verify_append(before, whole, old, cover)
        bad = list(cover)
        k = rng.randrange(len(bad))
        bad[k] = (bad[k][0], bad[k][1], "0" * 64)
        assert not provenance.verify_append(before, whole, old, bad) and not provenance.verify_append(before, whole, old, cover[:-1])
        history.append((before, whole, old, cover))
    assert not provenance.verify_append(history[2][0], history[3][1], history[2][2], history[3][3])
    assert provenance.append_leaves(frontier, spark.range(0).selectExpr("id as pos", "'' as hash")) == (frontier, [])


def test_files_appear_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "deep" / "r.json")

    def killed():
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        pub.publish(spark, path, b"half", before_rename=killed)
    assert [p.name for p in (tmp_path / "deep").iterdir() if not p.name.endswith(".crc")] == []
    assert pub.publish(spark, path, b"first") and not pub.publish(spark, path, b"second") and pub.read_bytes(spark, path) == b"first"
    assert pub.publish(spark, path, b"third", replace=True) and pub.read_bytes(spark, path) == b"third"
    assert pub.publish_json(spark, path, {"a": float("nan"), "b": np.float64(2.5), "c": {3, 1}, "d": object}) and json.loads(pub.read_bytes(spark, path))["c"] == [1, 3]
    doc = {"scan_id": "s1", "summary": {"n": 1, "é": 0.1}}
    doc["report_hash"] = hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    where = scan.write_report(spark, str(tmp_path / "reports"), doc)
    assert scan.read_report(spark, where) == (doc, True)
    pub.publish_json(spark, where, doc | {"summary": {}})
    assert not scan.read_report(spark, where)[1]
