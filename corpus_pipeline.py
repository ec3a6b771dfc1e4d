"""The training-corpus pipeline: toxicity, exact and near duplicates, benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir) and gives the documents that stay, with the columns of documents (the last adds
domain, n_tokens and epoch, one row per use). Ids are unique in documents; nulls are treated as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm.common import Scratch, free_names, table
from probity.llm.decontaminate import find_leaks
from probity.llm.exact_dedup import drop_exact_copies
from probity.llm.mixing import TOKEN, mix
from probity.llm.settings import DOMAINS, WEIGHTS
from probity.llm.simhash import near_copies
from probity.llm.toxicity import held_out, score_documents, train_model


def _without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    (name,) = free_names(docs.columns, "gone")
    return docs.join(gone.select(F.col(key).alias(name)), F.col(key).eqNullSafe(F.col(name)), "left_anti").select(docs.columns)


def _set_aside(docs: DataFrame, *taken: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with other names for columns that an operator would replace, and what gives those their names back."""
    hit = [c for c in docs.columns if c in taken]
    names = dict(zip(hit, free_names([*docs.columns, *taken], *hit)))
    return docs.withColumnsRenamed(names), lambda df: df.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject. A null text is scored as an empty one; rows with one text share their fate; empty
    tables give empty results."""
    model = train_model(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    rows, back = _set_aside(docs, "score", "predicted")
    return back(score_documents(rows, model, threshold=0.3).filter("predicted = 0"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the smallest id, null ids last; a null text equals an empty one; an empty table stays empty."""
    return drop_exact_copies(docs, keep="smallest").select(docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id. Documents without words, null ones too, and rows without
    an id stay; rows that repeat an id share their fate; an empty table stays empty."""
    found = near_copies(docs, shingle=5, similarity=0.8)
    wordless = F.repeat(F.lit("0"), 16)
    gone = found.filter((F.col("doc_id") != F.col("component_id")) & (F.col("fingerprint") != wordless))
    return _without(docs, gone)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of 8 benchmark words occurs. Null texts have no words; an empty benchmark or table removes nothing."""
    rows, back = _set_aside(docs, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "leak_spans")
    return back(find_leaks(rows, table(spark, sf_dir, "benchmark"), window=8, shard_bytes=1 << 20).filter("n_hit = 0"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in target proportions, one row per epoch in which a document is used, with its domain, n_tokens and epoch, under
    other names where docs has such columns. Null ids, texts, languages and sources are as mix says; rows that repeat an id and a leaf
    are used together; an empty table stays empty."""
    key, lang, source, *new = free_names(docs.columns, "key", "leaf_lang", "leaf_source", "domain", "n_tokens", "epoch")
    chosen = mix(docs, DOMAINS, WEIGHTS).select(F.col("doc_id").alias(key), F.col("lang").alias(lang), F.col("source").alias(source), *(F.col(c).alias(n) for c, n in zip(("domain", "n_tokens", "epoch"), new))).distinct()
    leaf = lambda c: F.coalesce(F.col(c), F.lit("(none)"))
    tokens = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(TOKEN)).cast("bigint")
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (leaf("lang") == F.col(lang)) & (leaf("source") == F.col(source)) & (tokens == F.col(new[1]))
    return docs.join(chosen, same).drop(key, lang, source)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("SimHash near-dedup", simhash_dedup), ("benchmark decontamination", decontaminate), ("mixing", mixture)]

#: The toxicity model and the fingerprints have no SQL form; stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
