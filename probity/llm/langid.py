"""Language identification of web pages by Bayesian fusion of text, markup and address."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Scratch, chunks, join_spread

BUCKETS = 1 << 15
#: Letters keep their own symbol, bytes of non-ASCII characters one by value, everything else is a gap.
SYMBOL = np.zeros(256, np.int64)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[128:] = 27 + np.arange(128) % 37
_ENTITY = re.compile(rb"&[a-zA-Z#0-9]{1,10};")
_RAW = re.compile(rb"<(script|style|html)(?![A-Za-z0-9])", re.I)
_ATTRIBUTE = re.compile(rb"""[\s/]*([^\s=>"'/]+|["'])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_CODE = re.compile(rb"\s*([A-Za-z]{2,8})(?![A-Za-z])")
_HOST = re.compile(r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")


def read_markup(html: bytes) -> tuple[bytes, str | None]:
    """(visible text, declared language) of a page, in one scan from left to right.

    Tags, comments, scripts, styles and character references become spaces; one that never ends hides the rest, but a lone < is text.
    The language is the first subtag of the lang attribute of the first html tag, as it is written, in lower case.
    """
    out, at, low, declared, rooted = [], 0, html.lower(), None, False
    while (i := html.find(b"<", at)) >= 0:
        out.append(html[at:i])
        if html.startswith(b"<!--", i):
            j = html.find(b"-->", i + 4)
            at = len(html) if j < 0 else j + 3
        else:
            m = _RAW.match(html, i)
            close = html.find(b">", i + 1)
            if m and low[i + 1 : m.end()] == b"html" and not rooted:
                rooted, p = True, m.end()
                while (x := _ATTRIBUTE.match(html, p)) and x.end() > p:
                    p = x.end()
                    if x[1].lower() == b"lang" and declared is None and (c := _CODE.match(x[2] or x[3] or x[4] or b"")):
                        declared = c[1].decode().lower()
                close = html.find(b">", p)
            elif m and low[i + 1 : m.end()] != b"html":
                j = low.find(b"</" + low[i + 1 : m.end()], m.end())
                close = html.find(b">", j) if j >= 0 else -1
                if close < 0:
                    close = len(html)
            if close < 0:  # no tag ends from here on
                out.append(html[i:])
                at = len(html)
                break
            at = close + 1
        out.append(b" ")
    out.append(html[at:])
    return _ENTITY.sub(b" ", b"".join(out)), declared


def trigrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every byte trigram inside a text that holds a letter; runs of gaps count once."""
    n = len(buf)
    if n < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    s = SYMBOL[LOWER[buf]]
    t = (s[:-2] << 12 | s[1:-1] << 6 | s[2:]) * 40503 >> 3 & (BUCKETS - 1)
    row = np.searchsorted(offs, np.arange(n), "right") - 1
    ok = (row[2:] == row[:-2]) & (s[1:-1] > 0)
    return t[ok], row[:-2][ok]


@dataclass
class TextModel:
    languages: list[str]
    logp: np.ndarray  # languages x buckets


def train_text(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> TextModel:
    """Trigram counts of each declared language over all documents, added up in tasks first: a task sends one table a language.

    The model has BUCKETS numbers a language, however many documents there are. Documents without a language don't count, null texts
    add nothing; an empty table gives a model of one unknown language, "und". Repeated documents count each; texts of any
    length are counted whole.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for a, b, buf, offs in chunks(batch.column(0)):
                t, row = trigrams(buf, offs)
                names, code = np.unique(langs[a:b].astype(str), return_inverse=True)
                for k, name in enumerate(names.tolist()):
                    part = np.bincount(t[code[row] == k], minlength=BUCKETS) if len(t) else np.zeros(BUCKETS, np.int64)
                    sums[name] = sums.get(name, 0) + part
        for name, table in sums.items():
            k = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k)), pa.array(k), pa.array(table[k].astype(np.int64))], names=["lang", "t", "n"])

    rows = docs.filter(F.col(lang_col).isNotNull()).select(text_col, lang_col).mapInArrow(count, "lang string, t bigint, n bigint")
    got = rows.groupBy("lang", "t").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows a language
    lang, t, n = np.array(got.column("lang").to_pylist(), object), got.column("t").to_numpy(), got.column("n").to_numpy()
    languages = sorted(set(lang.tolist())) or ["und"]
    counts = np.zeros((len(languages), BUCKETS))
    for k, name in enumerate(languages):
        counts[k, t[lang == name]] = n[lang == name]
    counts += 0.1
    return TextModel(languages, np.log(counts / counts.sum(axis=1, keepdims=True)))


def text_scores(model: TextModel, buf: np.ndarray, offs: np.ndarray, most: float | None = 60.0) -> np.ndarray:
    """Log-likelihood of each text in each language, all trigrams counted; weighted as `most` independent ones at most, None as all of them."""
    n = len(offs) - 1
    t, row = trigrams(buf, offs)
    size = np.bincount(row, minlength=n)
    out = np.stack([np.bincount(row, weights=lp[t], minlength=n) for lp in model.logp], axis=1)
    return out * ((1.0 if most is None else np.minimum(1.0, most / np.maximum(size, 1))[:, None]) / 3)


def read_pages(pages: DataFrame, model: TextModel, most: float | None = 60.0) -> DataFrame:
    """id, host, declared, and the text's log-likelihoods ll and posteriors t of pages(page_id, url, html); nulls are read as empty."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                raw = [(h or "").encode() for h in part.column(2).to_pylist()]
                seen = [read_markup(h) for h in raw]
                hosts = [m[1].lower().rstrip(".") if (m := _HOST.match(u or "")) else None for u in part.column(1).to_pylist()]
                texts = pa.array([t for t, _ in seen], pa.large_binary())
                ll = np.concatenate([text_scores(sent.value, buf, offs, most) for _, _, buf, offs in chunks(texts)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hosts, pa.string()), pa.array([c for _, c in seen], pa.string()), _lists(ll), _lists(_softmax(ll))], names=["id", "host", "declared", "ll", "t"])

    src = pages.select(F.col("page_id").alias("id"), "url", "html")
    return src.mapInArrow(scan, T.StructType([src.schema["id"], T.StructField("host", T.StringType()), T.StructField("declared", T.StringType()), T.StructField("ll", T.ArrayType(T.DoubleType())), T.StructField("t", T.ArrayType(T.DoubleType()))]))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
    return e / e.sum(axis=1, keepdims=True)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _matrix(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy().reshape(-1, k)


def identify(pages: DataFrame, model: TextModel, strength: float = 4.0, most: float | None = 60.0) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared_lang, host, suffix; one row per page.

    The posterior multiplies the text's likelihood, P(declared language | language), and the host's prior. Text posteriors
    summed by grouped aggregation give, level by level, shares over all pages, the address suffix, the registered domain
    (last two labels) and the host; each level is smoothed towards the one above with `strength` pages' weight, and a
    page's own text is taken out of its counts. The confusion of declared and text languages comes from
    the same sums. A text weighs as `most` independent trigrams at most, since its trigrams aren't independent; None lets all weigh. Hosts and declared codes are summed in tasks first, and those of very many pages are joined by broadcast. Sums are
    one column a language of the model.

    Nulls: null html is empty and gives no text evidence; a page that declares no language has none of that
    evidence; a null or hostless url takes the prior of such pages together; a null page_id stays null. Ties go to
    the language that sorts first. Pages of any length are read whole. Repeated rows are separate rows; other columns are not read. An
    empty table gives an empty result.
    """
    names, k = model.languages, len(model.languages)
    scratch = Scratch(pages.sparkSession, "langid")
    raw = read_pages(pages, model, most)
    labels = F.split(F.coalesce("host", F.lit("")), r"\.")
    p = raw.select("id", "declared", "ll", "t", F.coalesce("host", F.lit("")).alias("host"))
    p = p.withColumn("suffix", F.when(F.col("host") == "", "").otherwise(F.element_at(labels, -1)))
    p = p.withColumn("domain", F.when(F.size(labels) > 2, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(F.col("host")))
    p = scratch.keep(p, "pages")
    t = [F.col("t")[i] for i in range(k)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(t)]
    by_host = scratch.keep(p.groupBy("suffix", "domain", "host").agg(F.count(F.lit(1)).alias("n"), *sums), "hosts")
    total = lambda d, by: d.groupBy(*by).agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(k)))
    *whole, pages_all = by_host.agg(*(F.coalesce(F.sum(f"s{i}"), F.lit(0.0)) for i in range(k)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_all = sum(whole)
    base = [(v + 1.0) / (n_all + k) for v in whole]
    # a host's counts with those of the levels above it: one row a host
    levels = by_host.select("suffix", "domain", "host", "n", F.array(*(F.col(f"s{i}") for i in range(k))).alias("h"))
    dom = total(by_host, ["suffix", "domain"]).select("suffix", "domain", F.array(*(F.col(f"s{i}") for i in range(k))).alias("d"))
    suf = total(by_host, ["suffix"]).select("suffix", F.array(*(F.col(f"s{i}") for i in range(k))).alias("u"))
    levels = scratch.keep(levels.join(dom, ["suffix", "domain"]).join(suf, "suffix"), "levels")
    declared = p.groupBy(F.coalesce("declared", F.lit("")).alias("said_code")).agg(F.count(F.lit(1)).alias("n"), *sums)
    declared = scratch.keep(declared, "declared")
    codes = declared.filter("said_code <> ''").agg(F.count(F.lit(1)), *(F.coalesce(F.sum(f"s{i}"), F.lit(0.0)) for i in range(k))).first()
    said = [F.log((F.col(f"s{i}") + 0.5 + F.when(F.col("said_code") == names[i], 5.0).otherwise(0.0)) / F.lit(codes[i + 1] + 0.5 * (codes[0] + 1) + 5.0)) for i in range(k)]
    given = declared.select("said_code", "n", F.when(F.col("said_code") == "", F.array(*[F.lit(0.0)] * k)).otherwise(F.array(*said)).alias("said"))
    j = join_spread(p, levels, ["suffix", "domain", "host"], "n", pages_all).withColumn("said_code", F.coalesce("declared", F.lit("")))
    j = join_spread(scratch.keep(j, "levelled"), given, ["said_code"], "n", pages_all)

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang = np.array(names, object)
        for batch in batches:
            ll, own = _matrix(batch, "ll", k), _matrix(batch, "t", k)
            prior = np.broadcast_to(np.array(base), ll.shape)
            for level in "udh":
                others = np.maximum(_matrix(batch, level, k) - own, 0)
                prior = (others + strength * prior) / (others.sum(axis=1, keepdims=True) + strength)
            q = _softmax(ll + _matrix(batch, "said", k) + np.log(np.maximum(prior, 1e-12)))
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [col("id"), pa.array(lang[q.argmax(axis=1)].tolist(), pa.string()), pa.array(q.max(axis=1)), pa.array(lang[own.argmax(axis=1)].tolist(), pa.string()), col("declared"), col("host"), col("suffix")],
                names=["page_id", "lang", "confidence", "text_lang", "declared_lang", "host", "suffix"],
            )

    text = [T.StructField(c, T.StringType()) for c in ("lang", "text_lang", "declared_lang", "host", "suffix")]
    schema = [T.StructField("page_id", raw.schema["id"].dataType), text[0], T.StructField("confidence", T.DoubleType()), *text[1:]]
    return j.select("id", "ll", "t", "u", "d", "h", "said", "declared", "host", "suffix").mapInArrow(fuse, T.StructType(schema))
