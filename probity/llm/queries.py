"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import find_leaks
from .exact_dedup import exact_groups
from . import chat, filter_audit, trie
from .langid import identify, train_text
from .lines import dedup_units
from .mixing import mix, mix_sql
from .secrets import BASE, find_secrets
from .settings import DOMAINS, WEIGHTS
from .simhash import near_duplicates
from .substring_dedup import remove_repeats
from .toxicity import held_out, score_documents, train_model
from .warc import archive_round_trip

def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=50)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("secrets", lambda x: x["kind"].isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("bigint")
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_model(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    scored = score_documents(docs, model, threshold=0.3, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, seed=42, most=4)


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train_text(table(spark, sf_dir, "documents"))
    return identify(table(spark, sf_dir, "pages"), model)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_units(table(spark, sf_dir, "documents"), kind="sentence", min_words=20, keep=["doc_id"], keep_text=False)
    spans = F.array_join(F.transform("removed_spans", lambda x: F.concat_ws(":", x[0], x[1])), ",")
    return found.select("doc_id", "n_units", "n_removed", spans.alias("removed_spans"), "kept_sha256")


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), DOMAINS, WEIGHTS)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=8, min_items=2, keep=["doc_id"])
    return found.drop("leak_spans")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(chat.format_chat(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.shared_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_repeats, op2_secrets, op3_toxicity, op4_warc, op5_simhash, op6_exact, op7_langid, op8_lines, op9_mixture, op10_decontaminate, op11_filter_audit, op12_chat, op13_prefix_trie, pipeline)}

ORACLES = {
    "op11_filter_audit": filter_audit.SQL,
    "op12_chat": chat.SQL,
    "op13_prefix_trie": trie.SQL,
    "op8_lines": """with t as (select doc_id, coalesce(text, '') s from documents),
p as (select doc_id, s, regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*') ps from t),
w as (select doc_id, strlen(s) size, unnest(ps) p, unnest(range(1, len(ps) + 1)) i from p),
x as (select *, translate(regexp_extract(p, '^[^\\x20\\x09-\\x0D]+'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') w,
  size - sum(strlen(p)) over (partition by doc_id order by i desc) as a from w),
y as (select *, contains(p, chr(10)) or right(w, 1) in ('.', '!', '?') as stop from x),
s as (select *, coalesce(sum(stop::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as sentence from y),
c as (select *, stop or (count(*) over (partition by doc_id, sentence) > 24 and left(md5(w), 1) in ('0', '1')) as cut from s),
k as (select *, coalesce(sum(cut::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as k from c),
u as (select doc_id, k, string_agg(w, ' ' order by i) u, string_agg(p, '' order by i) raw, min(a) a, count(*) n, sum(strlen(p)) bytes from k group by doc_id, k),
r as (select *, row_number() over (partition by u order by doc_id, k) > 1 as again from u),
g as (select *, k - row_number() over (partition by doc_id, again order by k) as run from r),
v as (select *, again and sum(n) over (partition by doc_id, again, run) >= 20 as gone from g),
spans as (select doc_id, string_agg(a || ':' || b, ',' order by a) as removed_spans from (select doc_id, min(a)::bigint a, (min(a) + sum(bytes))::bigint b from v where gone group by doc_id, run) group by doc_id),
d as (select doc_id, count(*) n_units, count(*) filter (gone) n_removed, min(a) lead, coalesce(string_agg(raw, '' order by k) filter (not gone), '') kept from v group by doc_id)
select t.doc_id, coalesce(n_units, 0)::bigint as n_units, coalesce(n_removed, 0)::bigint as n_removed, coalesce(removed_spans, '') as removed_spans,
  sha256(case when d.doc_id is null then s else left(s, lead::int) || kept end) as kept_sha256
from t left join d using (doc_id) left join spans using (doc_id)""",
    "op4_warc": """with p as (select page_id, coalesce(html, '') h from pages),
g as (select page_id, strlen(h) n, sha1(h) s, max(page_id) over (partition by h) own from p)
select page_id, n::bigint as payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_position(['00000','00001','00010','00011','00100','00101','00110','00111','01000','01001','01010','01011','01100','01101','01110','01111','10000','10001','10010','10011','10100','10101','10110','10111','11000','11001','11010','11011','11100','11101','11110','11111'], substr(unhex(s)::bit::varchar, 5 * i + 1, 5)) - 1, 1) for i in range(32)], 'string_agg', '') as payload_digest,
  case when own = page_id then 'response' else 'revisit' end as record_type, case when own <> page_id then own end as refers_to from g""",
    "op6_exact": """select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
  doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))""",
    "op9_mixture": mix_sql(DOMAINS, WEIGHTS, 500, 2, 7),
    "op10_decontaminate": """with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark),
bw as (select distinct item_id, least(len(w), 8) n, list_slice(w, i, i + least(len(w), 8) - 1) p from (select *, unnest(range(1, greatest(len(w) - 6, 2))) i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, i, list_slice(w, i, i + n - 1) p from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from w, sizes where len(w) >= n)),
hits as (select doc_id, item_id, i, n from dw join bw using (n, p)),
items as (select doc_id, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) s from (select distinct doc_id, item_id from hits) group by 1),
hit as (select doc_id, count(*) n_hit from (select distinct doc_id, unnest(range(i, i + n)) k from hits) group by 1)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from w left join items using (doc_id) left join hit using (doc_id)""",
}
