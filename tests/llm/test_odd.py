"""Very long texts, clashing names and folders that can't be opened."""

import hashlib

import numpy as np
import pytest

from probity.llm.decontaminate import find_leaks
from probity.llm.langid import TextModel, identify, text_scores, train_text
from probity.llm.mixing import mix
from probity.llm.settings import DOMAINS, WEIGHTS
from probity.llm.substring_dedup import remove_repeats
from probity.llm.warc import archive_round_trip
from probity.llm.ziparchive import open_system

ODD = "doc_id long, text string, lang string, source string, domain string, epoch int, block int, id int, w string"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", "d", 1, 2, 3, "w") for i, t in rows], ODD)


def test_repeats_in_a_very_long_text(spark):
    rng = np.random.default_rng(1)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    part, long = letters(80), letters(3_000_000)
    text = long[:1_500_000] + part + long[1_500_000:]
    got = {r.doc_id: r for r in remove_repeats(odd(spark, [(1, part), (2, text), (3, None), (4, "")])).collect()}
    assert (got[2].n_removed, got[2].n_spans, got[2].kept_sha256) == (80, 1, hashlib.sha256(long.encode()).hexdigest())
    assert all(got[i].n_removed == 0 for i in (1, 3, 4))


def test_leaks_in_a_very_long_text(spark):
    words = [f"w{i % 5000}x{i // 5000}" for i in range(400_000)]
    item = "one two three four five six seven eight nine"
    docs = odd(spark, [(1, " ".join(words[:200_000]) + " " + item + " " + " ".join(words[200_000:])), (2, "short")])
    got = {r.doc_id: r for r in find_leaks(docs, spark.createDataFrame([(7, item), (8, " ".join(words[-9:]))], "item_id long, text string"), keep=["doc_id"]).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (400_009, 18, 2, True) and got[2].n_hit == 0


def test_mixing_with_names_that_clash_and_long_texts(spark):
    docs = odd(spark, [(i, "word " * (500_000 if i == 3 else 3)) for i in range(40)])
    plain = mix(docs, DOMAINS, WEIGHTS).collect()
    other = mix(docs.drop("domain", "epoch").withColumnRenamed("doc_id", "domain"), DOMAINS, WEIGHTS, id_col="domain")
    assert other.columns == ["domain_", "domain", "lang", "source", "n_tokens", "epoch"] and sorted(map(tuple, other.collect())) == sorted(map(tuple, plain))


def test_archives_with_more_columns_and_unknown_stores(spark):
    pages = spark.createDataFrame([(1, "http://a", "x", 5, "r"), (2, "http://a", "x", 6, "r"), (3, None, "y" * 2_000_000, 7, "r")], "page_id long, url string, html string, id int, record_type string")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in archive_round_trip(pages).collect()}
    assert got == {1: ("revisit", 2, 1), 2: ("response", None, 1), 3: ("response", None, 2_000_000)}
    with pytest.raises(ValueError, match="pyarrow"):
        open_system("viewfs://store/x")


def test_language_models_of_odd_rows_and_evidence_of_any_weight(spark):
    rows = [("the cat and the dog", "en"), ("the cat and the dog", "en"), (None, "en"), ("le chat et le chien", "fr"), ("nothing", None)]
    model = train_text(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["en", "fr"] and isinstance(model, TextModel)
    raw = np.frombuffer(b"the dog and the cat " * 50, np.uint8)
    few, all_ = text_scores(model, raw, np.array([0, len(raw)])), text_scores(model, raw, np.array([0, len(raw)]), None)
    assert few.argmax() == all_.argmax() and all_.min() < few.min()
    pages = spark.createDataFrame([(1, "http://a.fr", "le chien " * 40)], "page_id long, url string, html string")
    assert [identify(pages, model, most=m).first().lang for m in (60.0, None)] == ["fr", "fr"]
