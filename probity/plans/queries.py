"""The engine's own queries over the test tables, each with the same computation in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.functions import stats as S
from probity.functions import text as X
from probity.functions import vectors as V
from probity.operators import cells, correlate, drift, duplicates, labels, models, office, outliers, provenance
from probity.operators import findings as fnd

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# ---------------------------------------------------------------- statistics
@query("""with b as (select l_returnflag g, l_extendedprice x from lineitem), m as (select g, median(x) m, avg(x) a, stddev_pop(x) s from b group by g)
select b.g as l_returnflag, count(*) as n, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, round(median(x), 6) as median, round(median(abs(x - m.m)), 6) as mad, min(x) as min, max(x) as max,
 round(quantile_cont(x, 0.25), 6) as q1, round(quantile_cont(x, 0.75), 6) as q3, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) as iqr,
 round(avg(power((x - a) / s, 3)), 6) as skewness, round(avg(power((x - a) / s, 4)) - 3, 6) as kurtosis from b join m using (g) group by b.g""")
def robust_stats(spark, d):
    s = S.robust_stats(t(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return s.select("l_returnflag", "n", *r6("mean", "std", "median", "mad"), "min", "max", *r6("q1", "q3", "iqr", "skewness", "kurtosis"))


MZ = """m as (select event_type, median(value) med from events group by 1), dv as (select e.*, value - med dev from events e join m using (event_type)),
a as (select event_type, median(abs(dev)) mad, avg(abs(dev)) mean from dv group by 1),
z as (select dv.*, case when mad >= 1e-12 then 0.6745 * dev / mad when mean >= 1e-12 then dev / (1.253314 * mean) else 0 end z from dv join a using (event_type))"""


@query(f"with {MZ} select event_id, round(z, 6) as modified_z, z >= 2.5 as flagged from z")
def modified_zscore(spark, d):
    z = S.modified_zscore(t(spark, d, "events"), "value", ["event_type"])
    return z.select("event_id", *r6("modified_z"), (F.col("modified_z") >= 2.5).alias("flagged"))


@query("select o_orderkey, round((o_totalprice - avg(o_totalprice) over ()) / stddev_pop(o_totalprice) over (), 5) as zscore from orders")
def zscore(spark, d):
    return S.zscore(t(spark, d, "orders"), "o_totalprice").select("o_orderkey", F.round("zscore", 5).alias("zscore"))


@query("select event_type, median(value) as median, round(mad(value), 6) as mad from events group by 1")
def mad(spark, d):
    return S.robust_stats(t(spark, d, "events"), "value", ["event_type"]).select("event_type", "median", *r6("mad"))


@query("""with c as (select user_id, event_type, count(*) n from events group by 1, 2), p as (select user_id, n / sum(n) over (partition by user_id) p, count(*) over (partition by user_id) k from c)
select user_id, round(-sum(p * ln(p)), 6) + 0.0 as entropy, case when max(k) < 2 then 0.0 else round(-sum(p * ln(p)) / ln(max(k)), 6) end as normalised from p group by 1""")
def entropy(spark, d):
    c = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    a = c.groupBy("user_id").agg(F.array_sort(F.collect_list(F.col("n").cast("double"))).alias("v"))
    return a.select("user_id", (F.round(S.entropy(F.col("v")), 6) + 0.0).alias("entropy"), F.round(S.normalised_entropy(F.col("v")), 6).alias("normalised"))


@query("""with p as (select event_type, quantile_cont(value, 0.99) lim from events group by 1) select event_id, event_type, value from events join p using (event_type) where value > lim""")
def percentile_outliers(spark, d):
    e = t(spark, d, "events")
    lim = S.percentile_limits(e, "value", 99, ["event_type"], "lim")
    return e.join(lim, "event_type").filter("value > lim").select("event_id", "event_type", "value")


@query("""with s as (select event_type, value, case when ts >= timestamp '2024-01-16' then 1 else 0 end side from events),
c as (select event_type, value, count(*) filter (side = 0) a, count(*) filter (side = 1) b from s group by 1, 2),
r as (select event_type, sum(a) over w ca, sum(b) over w cb, sum(a) over p na, sum(b) over p nb from c window w as (partition by event_type order by value), p as (partition by event_type))
select event_type, round(max(abs(ca / na - cb / nb)), 6) as statistic, max(na)::bigint as n_baseline, max(nb)::bigint as n_current from r group by 1""")
def ks_two_sample(spark, d):
    e = t(spark, d, "events").withColumn("side", (F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).cast("int"))
    return S.ks_two_sample(e, "value", "side", ["event_type"]).select("event_type", *r6("statistic"), "n_baseline", "n_current")


CONF = "case when abs(z) / 2.5 <= 1 then 0.5 * (1 - exp(-0.8 * abs(z) / 2.5)) / (1 - exp(-0.8)) else 0.5 + 0.5 * (1 - exp(-1.2 * (abs(z) / 2.5 - 1))) end"


@query(f"with {MZ} select event_id, round(least(0.99, {CONF}), 6) as confidence from z where z >= 1")
def confidence_from_zscore(spark, d):
    z = S.modified_zscore(t(spark, d, "events"), "value", ["event_type"]).filter("modified_z >= 1")
    return z.select("event_id", F.round(S.confidence_from_zscore(F.col("modified_z"), 2.5), 6).alias("confidence"))


# ---------------------------------------------------------------- findings made from events
_CLASSES = list(fnd.STAGES)
_MODULE = {"DATA": "data_scanner", "MODEL": "model_auditor", "INFERENCE": "crypto_chain", "OPERATIONS": "drift_detector"}
_case = lambda col, m, q="'": f"case {col} " + " ".join(f"when '{k}' then {q}{v}{q}" for k, v in m.items()) + " end"
FIND = f"""f0 as (select event_id e, 'F-' || lpad(event_id::varchar, 9, '0') finding_id, ([{", ".join(f"'{c}'" for c in _CLASSES)}])[(event_id % 15)::int + 1] attack_class, 'asset_' || (event_id % 40) affected_asset,
 ((event_id * 37) % 100) / 100::double confidence, 'contributor_' || (user_id % 5) contributor, 'class_' || (event_id % 4) target, case when event_id % 2 = 0 then 'top-left' else 'bottom-right' end corner from events where event_id % 3 > 0 or event_type <> 'view'),
f as (select *, {_case("attack_class", fnd.STAGES)} stage, {_case(_case("attack_class", fnd.STAGES), _MODULE)} as module,
 case when confidence >= 0.85 then 'CRITICAL' when confidence >= 0.65 then 'HIGH' when confidence >= 0.40 then 'MEDIUM' else 'LOW' end severity,
 case when confidence >= 0.80 then 'QUARANTINE' when confidence >= 0.50 then 'REVIEW' else 'ACCEPT' end disposition from f0)"""
W = "case severity when 'CRITICAL' then 1.0 when 'HIGH' then 0.7 when 'MEDIUM' then 0.4 when 'LOW' then 0.15 when 'INFO' then 0.0 else 0.1 end::double"
NOR = "(1 - product(1 - least(0.99, {x})))"


def made(spark: SparkSession, d: str) -> DataFrame:
    """Findings made from events by arithmetic on their ids, so that other engines can make the same ones."""
    e = t(spark, d, "events").filter("event_id % 3 > 0 or event_type <> 'view'")
    cls = F.get(F.array(*map(F.lit, _CLASSES)), (F.col("event_id") % 15).cast("int"))
    c = ((F.col("event_id") * 37) % 100) / F.lit(100.0)
    f = e.select(
        F.concat(F.lit("F-"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("finding_id"), cls.alias("attack_class"), F.concat(F.lit("asset_"), F.col("event_id") % 40).alias("affected_asset"), c.alias("confidence"),
        F.concat(F.lit("contributor_"), F.col("user_id") % 5).alias("contributor"),
        F.create_map(F.lit("target_class"), F.concat(F.lit("class_"), F.col("event_id") % 4), F.lit("corner"), F.when(F.col("event_id") % 2 == 0, "top-left").otherwise("bottom-right")).alias("evidence"),
    )
    return f.withColumns({"severity": fnd.severity(F.col("confidence")), "disposition": fnd.disposition(F.col("confidence")), "module": fnd.lookup(fnd.lookup(F.col("attack_class"), fnd.STAGES, "UNKNOWN"), _MODULE, "unknown")})


@query(f"with {FIND} select finding_id, severity, disposition, module from f")
def severity_ladder(spark, d):
    return fnd.normalise(made(spark, d).withColumn("severity", F.lit("?")).withColumn("disposition", F.lit(None).cast("string"))).select("finding_id", "severity", "disposition", "module")


@query(f"""with {FIND} select floor(e / 8)::bigint as batch, round(1 - product(1 - least(0.999, confidence)), 6) as noisy_or, round(sum({W} * confidence) / sum({W}), 6) as weighted_mean, max(confidence) as worst from f group by 1""")
def noisy_or(spark, d):
    """Of every eight events: on more the aggregate is 1."""
    f = made(spark, d).withColumn("batch", F.floor(F.substring("finding_id", 3, 9).cast("bigint") / 8))
    w = fnd.severity_weight(F.col("severity"))
    return f.groupBy("batch").agg(F.round(S.aggregate_risk(F.col("confidence")), 6).alias("noisy_or"), F.round(S.aggregate_risk(F.col("confidence"), w, "weighted_mean"), 6).alias("weighted_mean"), S.aggregate_risk(F.col("confidence"), method="max").alias("worst"))


@query(f"""with {FIND}, a as (select count(*) total, max({W} * confidence) worst, count(*) filter (severity = 'CRITICAL') critical, count(*) filter (severity = 'HIGH') high, count(*) filter (severity = 'MEDIUM') medium,
 count(*) filter (severity = 'LOW') low, count(*) filter (severity = 'INFO') info, count(*) filter (disposition = 'QUARANTINE') quarantine from f)
select total, critical, high, medium, low, info, quarantine, round(0.75 * worst + 0.25 * (1 - exp(-(total - 1) / 6.0)) * worst, 4) as risk_score, 'COMPROMISED' as verdict from a""")
def summarize_findings(spark, d):
    return fnd.summarise(made(spark, d))


@query(f"""with {FIND} select case when grouping(severity) = 0 then 'severity' when grouping(attack_class) = 0 then 'attack_class' else 'disposition' end as dimension, coalesce(severity, attack_class, disposition) as value, count(*) as n
from f group by grouping sets ((severity), (attack_class), (disposition))""")
def grouping_sets_summary(spark, d):
    return fnd.counts_by(made(spark, d))


@query(f"with {FIND} select finding_id, severity, confidence from f order by case severity when 'CRITICAL' then 4 when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end desc, confidence desc, finding_id limit 50")
def top_findings(spark, d):
    return fnd.sort_findings(made(spark, d)).limit(50).select("finding_id", "severity", "confidence")


RISK = """n as (select contributor, count(*) num_samples from {samples} group by 1),
h as (select contributor, product(1 - least(0.999, w * confidence)) keep, count(*) num_findings, count(distinct attack_class) types, count(distinct affected_asset) assets from ({findings}) group by 1)
select contributor, coalesce(case when num_findings is not null then round(least(1, 0.60 * (1 - keep) + 0.25 * least(1, 2 * assets / num_samples) + 0.15 * least(1, (types - 1) / 4)), 4) end, 0.0) as risk_score,
 coalesce(num_findings, 0) as num_findings, num_samples, coalesce(types, 0) as num_attack_types from n left join h using (contributor)"""


@query(f"with {FIND}, " + RISK.format(samples="(select 'contributor_' || (user_id % 7) contributor from events)", findings=f"select *, {W} w from f"))
def event_contributor_risk(spark, d):
    samples = t(spark, d, "events").select(F.concat(F.lit("contributor_"), F.col("user_id") % 7).alias("contributor"))
    return fnd.contributor_risk(made(spark, d), samples)


# ---------------------------------------------------------------- embeddings
E = "e as (select vec_id, label, embedding::double[] v from embeddings)"
CEN = f"{E}, pos as (select vec_id, label, unnest(v) x, generate_subscripts(v, 1) p from e), cm as (select label, p, avg(x) x, count(*) n from pos group by 1, 2), c as (select label, max(n) n, list(x order by p) c from cm group by 1)"


@query(f"with {CEN} select label, p - 1 as pos, n, round(x, 6) as x from cm")
def class_centroids(spark, d):
    c = V.centroids(t(spark, d, "embeddings"), "label")
    return c.select("label", "n", F.posexplode("centroid").alias("pos", "x")).select("label", F.col("pos").cast("bigint").alias("pos"), "n", *r6("x"))


@query(f"""with {CEN}, g as (select p, avg(x) x from pos group by 1), gl as (select list(x order by p) g from g), b as (select sum(n * power(list_distance(c, g), 2)) b, sum(n) n from c, gl), w as (select sum(power(list_distance(v, c), 2)) w from e join c using (label))
select round(b / n, 6) as between_scatter, round(w / n, 6) as within_scatter, round(b / w, 6) as ratio from b, w""")
def class_separability(spark, d):
    s = V.separability(t(spark, d, "embeddings"), "label")
    return s.select(F.round(F.col("between"), 6).alias("between_scatter"), F.round("within", 6).alias("within_scatter"), *r6("ratio"))


DIST = f"{CEN}, dd as (select vec_id, label, n, list_distance(v, c) distance from e join c using (label)), th as (select label, avg(distance) + 2 * stddev_pop(distance) threshold from dd group by 1)"


@query(f"with {DIST} select vec_id, label, round(distance, 6) as distance, distance > threshold and n >= 8 as flagged from dd join th using (label)")
def centroid_distance(spark, d):
    return labels.centroid_distances(t(spark, d, "embeddings")).select(F.col("id").alias("vec_id"), "label", *r6("distance"), F.col("distance_flag").alias("flagged"))


FLIP = f"""{DIST}, nn as (select a.vec_id, b.label nl, row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id) r from e a join e b on a.vec_id <> b.vec_id),
vt as (select vec_id, nl, count(*) c from nn where r <= 10 group by 1, 2), tp as (select vec_id, arg_max(nl, c * 1000 - nl) nl, max(c) c, sum(c) k from vt group by 1),
j as (select dd.vec_id, dd.label, distance / threshold ratio, coalesce(vt.c, 0) / k agreement, tp.nl suggested, tp.c / k share, distance > threshold df, coalesce(vt.c, 0) / k <= 0.4 + 1e-12 and tp.nl <> dd.label and tp.c / k >= 0.5 nf
 from dd join th using (label) join tp using (vec_id) left join vt on vt.vec_id = dd.vec_id and vt.nl = dd.label where n >= 8),
b as (select *, least(0.97, 0.20 + 0.60 * (1 - round(agreement, 4)) + 0.15 * greatest(round(ratio, 4) - 1, 0)) c0 from j where df or nf),
cf as (select *, case when suggested <> label and share >= 0.5 then least(c0 + 0.15, 0.97) else c0 end c1 from b),
flips as (select *, case when df and nf then least(c1 + 0.08, 0.98) else c1 end confidence from cf)"""


@query(f"with {FLIP} select vec_id, label, suggested, round(agreement, 6) as agreement, round(ratio, 6) as ratio, df as distance_flag, nf as neighbour_flag, round(confidence, 6) as confidence from flips")
def knn_label_flip(spark, d):
    f = labels.label_flips(t(spark, d, "embeddings"))
    return f.select(F.col("id").alias("vec_id"), "label", "suggested", *r6("agreement", "ratio"), "distance_flag", "neighbour_flag", *r6("confidence"))


@query(f"""with {E}, nn as (select a.vec_id, b.vec_id neighbour, power(list_distance(a.v, b.v), 2) d, row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id) r from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0)
select vec_id, neighbour, r::int as rank, round(d, 6) as distance2 from nn where r <= 10""")
def knn_index(spark, d):
    """The ten nearest of all rows for every row whose id is divisible by 100, by the cell index in its exact form."""
    e = t(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return cells.CellIndex(e).search(q, k=10, exact=True).select(F.col("id").alias("vec_id"), "neighbour", "rank", *r6("distance2"))


@query(f"with {FLIP}, " + RISK.format(samples="(select 'contributor_' || (vec_id % 5) contributor from e)", findings="select 'contributor_' || (vec_id % 5) contributor, confidence, 'LABEL_FLIPPING' attack_class, vec_id affected_asset, case when confidence >= 0.85 then 1.0 when confidence >= 0.65 then 0.7 when confidence >= 0.40 then 0.4 else 0.15 end::double w from flips"))
def contributor_risk(spark, d):
    emb = t(spark, d, "embeddings")
    who = lambda c: F.concat(F.lit("contributor_"), F.col(c) % 5)
    f = labels.label_flips(emb).select(who("id").alias("contributor"), "confidence", F.lit("LABEL_FLIPPING").alias("attack_class"), F.col("id").cast("string").alias("affected_asset"), fnd.severity(F.col("confidence")).alias("severity"))
    return fnd.contributor_risk(f, emb.select(who("vec_id").alias("contributor")))


PROB = f"""{CEN}, d2 as (select e.vec_id, e.label, c.label cl, power(list_distance(v, c), 2) d from e, c where c.n >= 8), sc as (select median(d) s from d2),
ex as (select vec_id, label, cl, exp(-d / s) x from d2, sc), pr as (select vec_id, label, cl, x / sum(x) over (partition by vec_id) p from ex)"""


@query(f"""with {PROB}, g as (select vec_id, label, max(p) filter (cl = label) pg, max(p) pp, arg_max(cl, p) predicted from pr group by 1, 2), ow as (select label predicted, avg(pg) need from g group by 1)
select vec_id, label as given, g.predicted, round(pp - pg, 5) as gap from g join ow using (predicted) where g.predicted <> label and pp - pg >= 0.005 and pp >= need - 0.15""")
def confident_learning(spark, d):
    e = labels.mislabelled(t(spark, d, "embeddings"), min_gap=0.005)
    return e.select(F.col("id").alias("vec_id"), "given", "predicted", F.round("gap", 5).alias("gap"))


@query(f"""with {CEN}, lg as (select e.vec_id, -list_distance(v, c) l from e, c), en as (select vec_id, -ln(sum(exp(l))) energy from lg group by 1), m as (select median(energy) m from en), a as (select median(abs(energy - m)) mad from en, m)
select vec_id, round(energy, 6) as energy, round(0.6745 * (energy - m) / mad, 4) as z from en, m, a""")
def softmax_energy_ood(spark, d):
    e = outliers.energy_ood(outliers.centroid_logits(t(spark, d, "embeddings")))
    return e.select(F.col("id").alias("vec_id"), *r6("energy"), F.round("z", 4).alias("z"))


@query(f"with {CEN} select a.label as a, b.label as b, round(list_cosine_similarity(a.c, b.c), 6) as cosine from c a join c b on a.label < b.label")
def cosine_pairs(spark, d):
    c = V.centroids(t(spark, d, "embeddings"), "label")
    x, y = c.alias("x"), c.alias("y")
    return x.join(y, F.col("x.label") < F.col("y.label")).select(F.col("x.label").alias("a"), F.col("y.label").alias("b"), F.round(V.cosine(F.col("x.centroid"), F.col("y.centroid")), 6).alias("cosine"))


@query(f"""with {E}, s as (select *, (vec_id % 2)::int side, md5(vec_id::varchar) k from e),
p as (select a.side s, b.side t, power(list_distance(a.v, b.v), 2) d from s a join s b on a.vec_id < b.vec_id), g as (select 1 / median(d) g from p), k as (select s, t, exp(-g * d) k from p, g)
select round(sqrt(greatest(0, avg(k) filter (s = 0 and t = 0) + avg(k) filter (s = 1 and t = 1) - 2 * avg(k) filter (s <> t))), 5) as mmd, round((select g from g), 6) as gamma from k""")
def mmd(spark, d):
    m = drift.mmd(t(spark, d, "embeddings").withColumn("side", (F.col("vec_id") % 2).cast("int")))
    return m.select(F.round("mmd", 5).alias("mmd"), *r6("gamma"))


@query()
def mahalanobis_ood(spark, d):
    m = outliers.mahalanobis_ood(t(spark, d, "embeddings"))
    return m.select(F.col("id").alias("vec_id"), "label", *r6("distance", "z"), "flagged")


@query()
def spectral_signature(spark, d):
    s = outliers.spectral_signatures(t(spark, d, "embeddings"))
    return s.select(F.col("id").alias("vec_id"), "label", *r6("score", "z", "explained"), "flagged")


@query()
def isolation_forest(spark, d):
    return outliers.isolation_forest(t(spark, d, "embeddings"))


@query()
def activation_kmeans(spark, d):
    return outliers.activation_clusters(t(spark, d, "embeddings"))


@query()
def fused_ood(spark, d):
    """Every ninety-seventh row moved far from its class, so that both detectors see it."""
    emb = t(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 97 == 3, F.transform("embedding", lambda x, i: (x + 0.2 * (1 - 2 * (i % 2))) * 6)).otherwise(F.transform("embedding", lambda x: x.cast("double"))))
    return outliers.fuse_ood(outliers.mahalanobis_ood(emb), outliers.energy_ood(outliers.centroid_logits(emb)))


# ---------------------------------------------------------------- models
LAYER = f"{E}, w as (select 'layer_' || label as layer, unnest(v) x from e)"


@query(f"""with {LAYER}, m as (select layer, avg(x) a, stddev_pop(x) s from w group by 1), g as (select layer, count(*) n, avg(x) mean, stddev_pop(x) std, min(x) mn, max(x) mx, avg(case when abs(x) < 1e-8 then 1.0 else 0.0 end) sp, avg(power((x - a) / s, 4)) - 3 k, max(abs(x)) am from w join m using (layer) group by 1)
select layer, n, round(mean, 6) as mean, round(std, 6) as std, round(mn, 6) as min, round(mx, 6) as max, round(sp, 6) as sparsity, round(k, 6) as kurtosis, round(am, 6) as abs_max,
 (case when std > 3 * (select median(std) from g) then 1 else 0 end + case when k > 12 then 1 else 0 end + case when sp > 0.9 and n > 100 then 1 else 0 end)::bigint as flags from g""")
def layer_weight_stats(spark, d):
    w = t(spark, d, "embeddings").select(F.concat(F.lit("layer_"), "label").alias("layer"), F.explode(F.transform("embedding", lambda x: x.cast("double"))).alias("value"))
    return models.layer_stats(w).select("layer", "n", *r6("mean", "std", "min", "max", "sparsity", "kurtosis", "abs_max"), "flags")


@query(f"""with {E}, r as (select vec_id % 2 side, 'layer_' || label || '_' || row_number() over (partition by label, vec_id % 2 order by vec_id) as layer, v from e),
a as (select * from r where side = 0), b as (select * from r where side = 1)
select layer, round(case when a.v is null or b.v is null then 1.0 else list_distance(a.v, b.v) / sqrt(list_dot_product(b.v, b.v)) end, 6) as change from a full join b using (layer)""")
def weight_divergence(spark, d):
    """All vectors of even ids against those of odd ids, a layer each by label and rank."""
    from probity.functions.scans import Scan
    from probity.sources.tables import Store

    store, emb = Store(spark, "layers"), t(spark, d, "embeddings").withColumn("side", F.col("vec_id") % 2)
    ranked = store.keep(Scan(emb, ["label", "side"], [F.col("vec_id").asc()], store).sums(rank=F.lit(1).cast("bigint")))

    def side(k):
        x = ranked.filter(F.col("side") == k)
        return x.select(F.concat_ws("_", F.lit("layer"), "label", F.col("rank") + 1).alias("layer"), F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.col("value").cast("double"))

    return models.weight_divergence(side(0), side(1)).select("layer", *r6("change"))


@query(f"""with {CEN}, q as (select e.vec_id, c.label cl, list_distance(v, c) d1, -list_dot_product(v, c) d2 from e, c), z as (select vec_id, arg_min(cl, d1) a, arg_min(cl, d2) b from q group by 1)
select count(*) as probes, round(avg(case when a <> b then 1.0 else 0.0 end), 6) as mismatch_rate from z""")
def model_mismatch(spark, d):
    emb = t(spark, d, "embeddings")
    a = outliers.centroid_logits(emb).select(F.col("id").alias("probe"), "logits")
    v = emb.select(F.col("vec_id").alias("probe"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    c = V.centroids(emb, "label").agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("c"))  # one row
    b = v.crossJoin(F.broadcast(c)).select("probe", F.transform("c", lambda x: V.dot(F.col("v"), x["centroid"])).alias("logits"))
    return models.mismatch(a, b).select("probes", *r6("mismatch_rate"))


@query(f"""with {CEN}, lg as (select e.vec_id, exp(-list_distance(v, c)) x from e, c), p as (select vec_id, x / sum(x) over (partition by vec_id) p from lg), h as (select vec_id, -sum(p * ln(p)) / ln(count(*)) h from p group by 1)
select count(*) as probes, round(avg(h), 6) as entropy, case when avg(h) < 0.15 then 'SHARP' when avg(h) > 0.90 then 'FLAT' else 'NORMAL' end as shape from h""")
def output_entropy(spark, d):
    return models.output_shape(outliers.centroid_logits(t(spark, d, "embeddings"))).select("probes", *r6("entropy"), "shape")


@query("""with p as (select event_type m, user_id u, floor(max(value) * 10)::bigint % 3 a from events group by 1, 2) select x.m as model_a, y.m as model_b, count(*) as probes, round(avg(case when x.a <> y.a then 1.0 else 0.0 end), 6) as mismatch_rate
from p x join p y on x.u = y.u and x.m < y.m group by 1, 2""")
def model_disagreement(spark, d):
    p = t(spark, d, "events").groupBy(F.col("event_type").alias("model"), F.col("user_id").alias("probe")).agg((F.floor(F.max("value") * 10) % 3).alias("answer"))
    return models.disagreement(p).select("model_a", "model_b", "probes", *r6("mismatch_rate"))


# ---------------------------------------------------------------- provenance
def event_records(spark: SparkSession, d: str) -> DataFrame:
    """Inference records made from events: a chain a user, ordered by event id."""
    e = t(spark, d, "events")
    h = lambda *c: F.sha2(F.concat_ws("|", *[F.col(x).cast("string") for x in c]), 256)
    return e.select(
        F.col("user_id").alias("chain"), "event_id", F.concat(F.lit("rec-"), "event_id").alias("record_id"), h("event_type").alias("input_hash"), F.sha2(F.lit("model"), 256).alias("model_hash"), F.sha2(F.lit("config"), 256).alias("config_hash"),
        F.sha2(F.coalesce("props", F.lit("")), 256).alias("output_hash"), F.coalesce("props", F.lit("")).alias("output"), h("event_id", "user_id").alias("nonce"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_ns"),
    )


REC = """rec as (select user_id chain, event_id, 'rec-' || event_id record_id, sha256(event_type) input_hash, sha256('model') model_hash, sha256('config') config_hash, sha256(coalesce(props, '')) output_hash, coalesce(props, '') payload, sha256(event_id || '|' || user_id) nonce,
 epoch_us(ts) * 1000 timestamp_ns, row_number() over (partition by user_id order by event_id) - 1 seq from events)"""
CANON = """'{"config_hash":"' || config_hash || '","input_hash":"' || input_hash || '","model_hash":"' || model_hash || '","nonce":"' || nonce || '","output_hash":"' || output_hash || '","prev_record_hash":"' || %s || '","record_id":"' || record_id || '","sequence_number":' || %s || ',"timestamp_ns":' || timestamp_ns || '}'"""
LINK = f"""recursive {REC}, ch as (select rec.*, repeat('0', 64) prev, sha256({CANON % ("repeat('0', 64)", "seq")}) h from rec where seq = 0
 union all select rec.*, ch.h, sha256({(CANON % ("ch.h", "rec.seq")).replace("config_hash ||", "rec.config_hash ||").replace("input_hash ||", "rec.input_hash ||").replace("model_hash ||", "rec.model_hash ||").replace("|| nonce", "|| rec.nonce").replace("|| output_hash", "|| rec.output_hash").replace("|| record_id", "|| rec.record_id").replace("|| timestamp_ns", "|| rec.timestamp_ns").replace("|| config_hash", "|| rec.config_hash").replace("|| input_hash", "|| rec.input_hash").replace("|| model_hash", "|| rec.model_hash")}) from ch join rec on rec.chain = ch.chain and rec.seq = ch.seq + 1)"""


@query(f"""with {REC} select event_id, sha256({CANON % ("''", "0")}) as record_hash from rec""")
def record_hash(spark, d):
    r = event_records(spark, d)
    return r.select("event_id", X.record_hash(F.lit(""), F.lit(0)).alias("record_hash"))


@query(f"with {LINK} select chain, event_id, seq::bigint as sequence_number, prev as prev_record_hash, h as record_hash from ch")
def chain_build(spark, d):
    return provenance.link_records(event_records(spark, d), "chain", ["event_id"]).select("chain", "event_id", "sequence_number", "prev_record_hash", "record_hash")


def tampered_records(spark: SparkSession, d: str) -> DataFrame:
    """Linked chains with planted damage: outputs edited, outputs edited and rehashed, records deleted, records replayed."""
    r = provenance.link_records(event_records(spark, d), "chain", ["event_id"])
    edit, rehash = F.col("event_id") % 101 == 7, F.col("event_id") % 103 == 9
    r = r.withColumn("output", F.when(edit | rehash, F.concat("output", F.lit("!"))).otherwise(F.col("output")))
    r = r.withColumn("output_hash", F.when(rehash, F.sha2("output", 256)).otherwise(F.col("output_hash"))).filter("event_id % 107 <> 11")
    again = r.filter("event_id % 109 = 13").withColumn("event_id", F.col("event_id") + 1_000_000_000).withColumn("record_id", F.concat("record_id", F.lit("-again")))
    from probity.sources.tables import Store

    return Store(spark, "tampered").keep(r.unionByName(again), "zstd")  # linked once, however often it is read


BROKEN = f"""{LINK}, tam as (select chain, event_id, record_id, input_hash, model_hash, config_hash, nonce, timestamp_ns, seq, prev, h, case when event_id % 101 = 7 or event_id % 103 = 9 then payload || '!' else payload end o,
 case when event_id % 103 = 9 then sha256(payload || '!') else output_hash end output_hash from ch where event_id % 107 <> 11),
al as (select * from tam union all select chain, event_id + 1000000000, record_id || '-again', input_hash, model_hash, config_hash, nonce, timestamp_ns, seq, prev, h, o, output_hash from tam where event_id % 109 = 13),
ca as (select *, sha256({CANON % ("prev", "seq")}) calc, row_number() over (partition by chain order by event_id) - 1 idx, repeat('0', 64) zero from al),
vi as (select *, coalesce(lag(h) over w, zero) pv, lag(seq) over w ps, lag(timestamp_ns) over w pt, min(idx) over (partition by chain, nonce) fn, min(idx) over (partition by chain, seq) fs from ca window w as (partition by chain order by event_id)),
br as (select chain, idx, record_id, 'MISSING_GENESIS' t, zero e, prev f from vi where idx = 0 and prev <> zero union all select chain, idx, record_id, 'BROKEN_LINK', pv, prev from vi where not (idx = 0 and prev <> zero) and prev <> pv
 union all select chain, idx, record_id, 'HASH_MISMATCH', calc, h from vi where h <> calc union all select chain, idx, record_id, 'DUPLICATE_NONCE', 'unique nonce', nonce from vi where idx > fn
 union all select chain, idx, record_id, 'DUPLICATE_SEQUENCE', 'unique sequence', seq::varchar from vi where idx > fs union all select chain, idx, record_id, 'SEQUENCE_REGRESSION', '>' || ps, seq::varchar from vi where seq <= ps
 union all select chain, idx, record_id, 'SEQUENCE_GAP', (ps + 1)::varchar, seq::varchar from vi where seq > ps + 1 union all select chain, idx, record_id, 'TIMESTAMP_REGRESSION', '>=' || pt, timestamp_ns::varchar from vi where timestamp_ns < pt - 1000000000
 union all select chain, idx, record_id, 'PAYLOAD_MISMATCH', sha256(o), output_hash from vi where sha256(o) <> output_hash)"""


@query(f"with {BROKEN} select chain, idx::bigint as index, record_id, t as break_type, e as expected, f as found from br")
def chain_verify(spark, d):
    return provenance.verify_chain(tampered_records(spark, d), "chain", ["event_id"])


@query(f"""with {BROKEN}, hd as (select chain, count(*) n, arg_max(h, event_id) h from al group by 1), bk as (select chain, count(*) n, min(idx) f from br group by 1)
select chain, hd.n as records, bk.n is null as chain_valid, coalesce(f, -1)::bigint as first_break_index, coalesce(bk.n, 0)::bigint as breaks, h as head_hash from hd left join bk using (chain)""")
def chain_summaries(spark, d):
    r = tampered_records(spark, d)
    return provenance.chain_summary(r, provenance.verify_chain(r, "chain", ["event_id"]), "chain", ["event_id"])


@query("""select event_id, case when event_id % 103 = 9 then 'CHAIN_HASH' when event_id % 101 = 7 then 'OUTPUT_PAYLOAD' end as tamper from events where (event_id % 103 = 9 or event_id % 101 = 7) and event_id % 107 <> 11
union all select event_id + 1000000000, case when event_id % 103 = 9 or event_id % 101 <> 7 then 'CHAIN_HASH' else 'CHAIN_HASH+OUTPUT_PAYLOAD' end from events where event_id % 109 = 13 and event_id % 107 <> 11""")
def tamper_detect(spark, d):
    return provenance.find_tampered(tampered_records(spark, d)).select("event_id", "tamper")


@query("""with r as (select event_id, user_id, event_type, coalesce(props, '') p, ts from events where event_id % 107 <> 11 union all select event_id + 1000000000, user_id, event_type, coalesce(props, '') p, ts from events where event_id % 109 = 13 and event_id % 107 <> 11),
b as (select *, event_id % 1000000000 n, user_id chain, case when event_id % 1000000000 % 101 = 7 and not event_id % 1000000000 % 103 = 9 then p when event_id % 1000000000 % 103 = 9 then p || '!' else p end o from r),
f as (select *, min(event_id) over (partition by chain, n) fn, min(event_id) over (partition by chain, event_type, o, ts) fp from b)
select event_id, 'DUPLICATE_NONCE' as replay_type from f where event_id > fn union all select event_id, 'IDENTICAL_PAYLOAD' from f where event_id > fp""")
def replay_detect(spark, d):
    r = tampered_records(spark, d)
    f = provenance.find_replays(r, ["chain"], ["event_id"])
    return f.join(r.select("chain", "record_id", "event_id"), ["chain", "record_id"]).select("event_id", "replay_type")


@query("""with e as (select user_id, event_id, row_number() over (partition by user_id order by event_id) s from events), k as (select *, lag(s) over (partition by user_id order by s) p from e where event_id % 10 <> 3)
select user_id, event_id, p + 1 as expected, s as found from k where s > p + 1""")
def sequence_gaps(spark, d):
    r = provenance.link_records(event_records(spark, d), "chain", ["event_id"]).withColumn("sequence_number", F.col("sequence_number") + 1).filter("event_id % 10 <> 3")
    b = provenance.verify_chain(r, "chain", ["event_id"]).filter("break_type = 'SEQUENCE_GAP'")
    return b.select(F.col("chain").alias("user_id"), F.substring("record_id", 5, 30).cast("bigint").alias("event_id"), F.col("expected").cast("bigint").alias("expected"), F.col("found").cast("bigint").alias("found"))


@query("""with recursive l as (select event_id - (select min(event_id) from events) p, sha256('\\x00'::blob || (sha256('e' || event_id))::blob) h from events), n as (select count(*) n from l),
t as (select 0 k, p, h from l union all select k + 1, (p / 2)::bigint, h from (select t.k, t.p, sha256('\\x01'::blob || unhex(t.h) || unhex(coalesce(r.h, t.h))) h from t left join t r on r.p = t.p + 1 where t.p % 2 = 0 and (select count(*) from t) > 1))
select h as root, (k + 1)::bigint as depth, (select n from n) as leaves from t order by k desc limit 1""")
def merkle_root(spark, d):
    e = t(spark, d, "events")
    low = e.agg(F.min("event_id").alias("low"))
    leaves = e.crossJoin(F.broadcast(low)).select((F.col("event_id") - F.col("low")).alias("pos"), F.sha2(F.concat(F.lit("e"), "event_id"), 256).alias("hash"))  # one row
    return provenance.merkle_root(leaves)


@query("""with recursive l as (select event_id - (select min(event_id) from events) p, sha256('\\x00'::blob || (sha256('e' || event_id))::blob) h from events),
t as (select 0 k, p, h from l union all select k + 1, (p / 2)::bigint, h from (select t.k, t.p, sha256('\\x01'::blob || unhex(t.h) || unhex(coalesce(r.h, t.h))) h from t left join t r on r.p = t.p + 1 where t.p % 2 = 0 and (select count(*) from t) > 1)),
top as (select h from t order by k desc limit 1) select l.p as pos, true as valid, l.h as leaf, top.h as root from l, top""")
def merkle_proofs(spark, d):
    """Every leaf's proof, climbed by the verifier, and the root it is a proof for."""
    e = t(spark, d, "events")
    low = e.agg(F.min("event_id").alias("low"))
    leaves = e.crossJoin(F.broadcast(low)).select((F.col("event_id") - F.col("low")).alias("pos"), F.sha2(F.concat(F.lit("e"), "event_id"), 256).alias("hash"))  # one row
    proofs = provenance.merkle_proofs(leaves)
    return provenance.verify_proofs(proofs).join(proofs.select("pos", "leaf", "root"), "pos")


# ---------------------------------------------------------------- duplicates
@query("with g as (select sha256(coalesce(text, '')) h, count(*) n, min(doc_id) first from documents group by 1) select h as text_hash, n as copies, first as first_id from g where n > 1")
def exact_duplicates(spark, d):
    g = t(spark, d, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))
    return g.filter("copies > 1")


TOK = r"""tk as (select doc_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')) tk from documents)"""
FP = TOK + """, hh as (select doc_id, len(tk) n, unnest(tk) w from tk), hx as (select doc_id, n, ('0x' || substr(sha256(w), 1, 15))::bigint h from hh),
bt as (select doc_id, any_value(n) n, i, sum((h >> i) & 1) o from hx, range(60) r(i) group by doc_id, i), fp0 as (select doc_id, sum(case when 2 * o > n then (1::bigint << i) else 0 end)::bigint fp from bt group by 1),
fp as (select doc_id id, coalesce(fp, 0) fp from documents left join fp0 using (doc_id)), rp as (select fp, min(id) id from fp group by 1)"""


@query(f"with {FP} select id as doc_id, fp from fp")
def text_fingerprints(spark, d):
    return duplicates.fingerprints(t(spark, d, "documents")).select(F.col("id").alias("doc_id"), "fp")


NEAR = f"{FP}, pr as (select a.id a, b.id b, bit_count(xor(a.fp, b.fp)) distance from rp a join rp b on a.id < b.id where bit_count(xor(a.fp, b.fp)) <= 5)"


@query(f"with {NEAR} select a, b, distance::int as distance from pr")
def near_duplicate_pairs(spark, d):
    return duplicates.near_pairs(duplicates.fingerprints(t(spark, d, "documents")))


def _members(spark, d):
    from probity.sources.tables import Store

    store = Store(spark, "duplicates")
    fps = store.keep(duplicates.fingerprints(t(spark, d, "documents")))
    pairs = store.keep(duplicates.near_pairs(fps))
    return duplicates.clusters(fps, duplicates.components(pairs, store.keep)), pairs


CLU = NEAR.replace("tk as", "recursive tk as", 1) + """, ed as (select a, b from pr union select b, a from pr), cc as (select a n, a r from ed union select ed.b, cc.r from cc join ed on ed.a = cc.n), rt as (select n, min(r) r from cc group by 1),
mb as (select fp.id, coalesce(rt.r, rp.id) cluster from fp join rp using (fp) left join rt on rt.n = rp.id)"""


@query(f"with {CLU} select id as doc_id, cluster from mb")
def duplicate_clusters(spark, d):
    return _members(spark, d)[0].select(F.col("id").alias("doc_id"), "cluster")


@query(f"""with {CLU}, sz as (select cluster, count(*) size from mb group by 1 having count(*) > 1), md as (select median(size) m from sz), ma as (select median(abs(size - m)) a from sz, md)
select cluster, size, greatest(4, ceil(m + 3 * greatest(1.4826 * a, 1)))::bigint as threshold, size >= greatest(4, ceil(m + 3 * greatest(1.4826 * a, 1))) as flood from sz, md, ma""")
def flood_threshold(spark, d):
    return duplicates.flood_clusters(*_members(spark, d)).select("cluster", "size", "threshold", "flood")


@query(f"""with {CLU}, fi as (select cluster, min(id) f from mb group by 1), ag as (select mb.id from mb join fi using (cluster) where mb.id > f)
select source as contributor, count(*) as total, count(ag.id) as redundant, round(count(ag.id) / count(*), 6) as share from documents left join ag on ag.id = doc_id group by 1 having count(*) >= 20 and upper(source) <> 'UNKNOWN'""")
def contributor_duplicate_share(spark, d):
    s = duplicates.contributor_shares(_members(spark, d)[0], t(spark, d, "documents"))
    return s.select("contributor", "total", "redundant", *r6("share"))


# ---------------------------------------------------------------- drift
PROPS = ["brightness", "contrast", "sharpness", "edge_density"]
PD = """pd as (select case when o_orderdate >= timestamp '1995-06-17' then 1 else 0 end side, o_totalprice brightness, (o_orderkey % 97)::double contrast, (o_custkey % 31)::double sharpness, (o_custkey % 7)::double edge_density from orders),
lg as (select side, p, case p when 'brightness' then brightness when 'contrast' then contrast when 'sharpness' then sharpness else edge_density end x from pd, (select unnest(['brightness', 'contrast', 'sharpness', 'edge_density']) p)),
ag as (select p, avg(x) filter (side = 0) a, avg(x) filter (side = 1) b, stddev_pop(x) filter (side = 0) s from lg group by 1)"""


def property_table(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    return o.select((F.col("o_orderdate") >= F.lit("1995-06-17").cast("timestamp_ntz")).cast("int").alias("side"), F.col("o_totalprice").alias("brightness"), (F.col("o_orderkey") % 97).cast("double").alias("contrast"), (F.col("o_custkey") % 31).cast("double").alias("sharpness"), (F.col("o_custkey") % 7).cast("double").alias("edge_density"))


@query(f"with {PD} select p as property, round(a, 4) as baseline_mean, round(b, 4) as current_mean, round((b - a) / s, 6) as zscore, round((b - a) / abs(a), 6) as relative_change, case when b > a then 'increase' else 'decrease' end as direction, abs((b - a) / abs(a)) >= 0.15 as material from ag")
def property_drift(spark, d):
    p = drift.property_drift(property_table(spark, d), PROPS)
    return p.select("property", F.round("baseline_mean", 4).alias("baseline_mean"), F.round("current_mean", 4).alias("current_mean"), *r6("zscore", "relative_change"), "direction", "material")


@query(f"""with {PD}, mv as (select p, b * case p when 'brightness' then 9.0 else 0.05 end / a - 1 rel from ag), sg as (select * from (values
 (0, 'LOW_LIGHT', 'brightness', -1, true, 2), (0, 'LOW_LIGHT', 'contrast', -1, false, 2), (0, 'LOW_LIGHT', 'sharpness', -1, false, 2), (1, 'HAZE', 'brightness', 1, false, 2), (1, 'HAZE', 'contrast', -1, true, 2), (1, 'HAZE', 'edge_density', -1, true, 2), (1, 'HAZE', 'sharpness', -1, true, 2),
 (2, 'OPTICS_CHANGE', 'sharpness', 1, true, 1), (2, 'OPTICS_CHANGE', 'edge_density', 1, false, 1), (2, 'OPTICS_CHANGE', 'contrast', 0, false, 1), (3, 'SEASON', 'brightness', 0, false, 2), (3, 'SEASON', 'contrast', 0, false, 2)) v(k, name, p, dir, req, need)),
 ok as (select k, name, need, req, dir = 0 or dir = sign(rel) as fits from sg join mv using (p) where abs(rel) >= 0.15)
select name, count(*) filter (fits) as matches from ok group by k, name having count(*) filter (not fits) = 0 and count(*) filter (fits) >= max(need) and bool_or(fits and req) order by matches desc, k limit 2""")
def drift_signatures(spark, d):
    o = property_table(spark, d)
    moved = o.select("side", *[F.when(F.col("side") == 1, F.col(p) * k).otherwise(F.col(p)).alias(p) for p, k in zip(PROPS, (9.0, 0.05, 0.05, 0.05))])
    props = drift.property_drift(moved, PROPS).withColumn("shifted", F.col("material"))
    return drift.match_signatures(props).select("name", "matches")


@query()
def drift_characterise(spark, d):
    emb = t(spark, d, "embeddings").withColumn("side", (F.col("vec_id") % 2).cast("int"))
    props = drift.property_drift(property_table(spark, d), PROPS)
    f = drift.centroid_drift(emb).crossJoin(drift.mmd(emb).select("mmd")).crossJoin(drift.projection_bimodality(emb).select("concentrated"))  # one row each
    return drift.characterise(props, f, drift.match_signatures(props))


@query(f"""with {E}, s as (select *, (vec_id % 2)::int side from e), pos as (select side, unnest(v) x, generate_subscripts(v, 1) p from s), cm as (select side, p, avg(x) x from pos group by 1, 2), c as (select side, list(x order by p) c from cm group by 1),
b as (select max(c) filter (side = 0) c0, max(c) filter (side = 1) c1 from c)
select round(list_distance(c0, c1) / sqrt(list_dot_product(c0, c0)), 6) as centroid_shift, round(list_cosine_similarity(c0, c1), 6) as cosine from b""")
def centroid_drift(spark, d):
    return drift.centroid_drift(t(spark, d, "embeddings").withColumn("side", (F.col("vec_id") % 2).cast("int"))).select(*r6("centroid_shift", "cosine"))


@query("""with x as (select event_type g, value x, row_number() over (partition by event_type order by value) k, count(*) over (partition by event_type) n, sum(value) over u s, sum(value * value) over u q, sum(value) over (partition by event_type) ts, sum(value * value) over (partition by event_type) tq
 from events window u as (partition by event_type order by value rows between unbounded preceding and 1 preceding)),
y as (select g, k, n, k - 1 l, n - k + 1 r, s / (k - 1) ml, (ts - s) / (n - k + 1) mr, greatest(q / (k - 1) - power(s / (k - 1), 2), 0) vl, greatest((tq - q) / (n - k + 1) - power((ts - s) / (n - k + 1), 2), 0) vr from x where k - 1 >= greatest(floor(n * 0.1), 1) and k - 1 <= ceil(n * 0.9) and n >= 8),
z as (select g, k, least(l, r) / n m, case when sqrt((l * vl + r * vr) / n) > 1e-12 then abs(mr - ml) / sqrt((l * vl + r * vr) / n) else 0 end sep from y)
select g as event_type, round(max(sep), 4) as separation, round(arg_max(m, sep), 4) as minority_fraction, max(sep) > 5 and arg_max(m, sep) > 0.08 as bimodal from z group by 1""")
def bimodality(spark, d):
    b = S.bimodality(t(spark, d, "events"), "value", ["event_type"])
    return b.select("event_type", F.round("separation", 4).alias("separation"), F.round("minority_fraction", 4).alias("minority_fraction"), "bimodal")


# ---------------------------------------------------------------- office, stories, immunity
RK = f"rk as (select contributor, round(max(confidence) * (1 + substr(contributor, 13, 1)::int) / 5, 4) risk from f0 group by 1)"


def office_risks(spark, d):
    return made(spark, d).groupBy("contributor").agg(F.round(F.max("confidence") * (1 + F.substring("contributor", 13, 1).cast("int")) / 5, 4).alias("risk_score"))


@query(f"""with {FIND}, {RK}, s as (select avg(risk) m, stddev_pop(risk) sd from rk), pm as (select a.contributor, median(b.risk) pm from rk a join rk b on a.contributor <> b.contributor group by 1)
select contributor, round(pm, 6) as peer_median, round((risk - m) / sd, 6) + 0.0 as zscore, case when risk / pm >= 1.8 and risk >= 0.45 then 'median_ratio' when (risk - m) / sd >= 1.5 and risk >= 0.45 then 'zscore' end as triggered_by from rk join pm using (contributor), s""")
def disparity(spark, d):
    return office.disparity(office_risks(spark, d)).select("contributor", *r6("peer_median"), (F.round("zscore", 6) + 0.0).alias("zscore"), "triggered_by")


@query(f"""with {FIND}, g as (select replace(target, 'class_', '') target, count(distinct contributor) contributors, count(*) findings, avg(confidence) m from f where attack_class in ('LABEL_FLIPPING', 'SYSTEMATIC_MISLABELING', 'TRIGGER_INJECTION', 'MODEL_BACKDOOR') and confidence >= 0.5 group by 1)
select target, contributors, findings, round(least(0.92, greatest(0.40, 0.40 + 0.18 * contributors + 0.25 * (m - 0.5))), 6) as confidence from g where contributors >= 2""")
def class_targeting(spark, d):
    return office.class_targeting(made(spark, d)).select("target", "contributors", "findings", *r6("confidence"))


@query(f"""with {FIND}, {RK}, r as (select *, substr(contributor, 13, 1)::int % 3 k from rk), j as (select a.contributor, a.risk, min(b.risk) p from r a join r b on b.k < a.k group by 1, 2)
select contributor, round(risk - p, 6) as gap, round(least(0.85, 0.45 + risk - p), 6) as confidence from j where risk - p >= 0.15 and risk >= 0.45""")
def trust_inversion(spark, d):
    k = F.substring("contributor", 13, 1).cast("int") % 3
    r = office_risks(spark, d).withColumn("trust_level", F.when(k == 2, "TRUSTED").when(k == 1, "VERIFIED").otherwise("UNVERIFIED"))
    return office.trust_inversion(r).select("contributor", *r6("gap", "confidence"))


MAT = f"{FIND}, m as (select * from f where confidence >= 0.5)"


@query(f"""with {MAT}, s as (select stage, max(confidence) best, bool_or(confidence >= 0.85) ok, count(*) n from m where stage in ('DATA', 'MODEL', 'INFERENCE', 'OPERATIONS') group by 1), g as (select count(*) k, bool_and(ok) ok, {NOR.format(x="best")} fz, sum(n) n, string_agg(stage, ',' order by stage) st from s)
select 'KILL_CHAIN' as pattern, st as key, round(least(0.95, fz * (0.70 + 0.07 * k)), 4) as confidence, n::bigint as supporting from g where k >= 2 and ok""")
def kill_chain(spark, d):
    return correlate.kill_chain(correlate.material(made(spark, d)))


@query(f"""with {MAT}, r as (select *, row_number() over (partition by target order by finding_id) r from m), g as (select target, count(distinct module) mo, count(*) n, 1 - product(case when r <= 6 then 1 - least(0.99, confidence) else 1 end) fz from r group by 1)
select 'TARGETED_CLASS' as pattern, target as key, round(fz * 0.85, 4) as confidence, n as supporting from g where mo >= 2 and n >= 3""")
def target_class(spark, d):
    return correlate.target_classes(correlate.material(made(spark, d)))


@query(f"""with {MAT}, s as (select *, attack_class || '|corner=' || corner || '|target_class=' || target sig from m where confidence >= 0.85), r as (select *, row_number() over (partition by sig order by confidence desc, finding_id) r from s),
g as (select sig, count(distinct contributor) c, count(*) n, min(finding_id) f1, 1 - product(case when r <= 5 then 1 - least(0.99, confidence) else 1 end) fz from r group by 1)
select 'COORDINATED_CONTRIBUTORS' as pattern, sig as key, round(fz * 0.80, 4) as confidence, n as supporting from g where c >= 2 order by c desc, f1 limit 1""")
def coordinated_signature(spark, d):
    return correlate.coordinated(correlate.material(made(spark, d)))


@query(f"""with {MAT}, g as (select max(confidence) filter (stage = 'INFERENCE') a, max(confidence) filter (stage in ('DATA', 'MODEL')) b, count(*) filter (stage in ('INFERENCE', 'DATA', 'MODEL')) n from m)
select 'COVER_UP' as pattern, 'provenance' as key, round((1 - (1 - least(0.99, a)) * (1 - least(0.99, b))) * 0.82, 4) as confidence, n as supporting from g where a is not null and b is not null""")
def cover_up(spark, d):
    return correlate.cover_up(correlate.material(made(spark, d)))


PILL = f"""{FIND}, dm as (select *, case module when 'data_scanner' then 'data_integrity' when 'model_auditor' then 'model_integrity' when 'crypto_chain' then 'provenance' when 'drift_detector' then 'drift_stability' end pillar,
 case severity when 'CRITICAL' then 1.0 when 'HIGH' then 0.55 when 'MEDIUM' then 0.22 when 'LOW' then 0.07 else 0.02 end::double * confidence d from f), rk as (select *, row_number() over (partition by pillar order by d desc) r from dm),
pg as (select pillar, max(d) w, coalesce(sum(d / r) filter (r > 1), 0) tl, count(*) n from rk group by 1),
ps as (select p pillar, coalesce(n, 0) n, case when n is null then 100.0 else round(100 * (1 - least(0.98, 0.55 * w + 0.45 * (1 - exp(-tl / 6)))), 1) end score from (select unnest(['data_integrity', 'model_integrity', 'provenance', 'drift_stability']) p) left join pg on pillar = p)"""


def _modules(spark):
    return spark.createDataFrame([(m,) for m in ("data_scanner", "model_auditor", "crypto_chain", "drift_detector")], "module string")


@query(f"with {PILL} select pillar, n as findings, score from ps")
def immunity_pillars(spark, d):
    return correlate.pillar_scores(made(spark, d), _modules(spark)).select("pillar", "findings", "score")


PATTERNS = " union all ".join(f"select * from ({ORACLES[k]})" for k in ("kill_chain", "target_class", "coordinated_signature", "cover_up"))


@query(f"""with c as (select least(25, 8 * max(confidence) + 2 * count(distinct pattern)) penalty from ({PATTERNS})), p as (select sum(score * case pillar when 'provenance' then 0.25 when 'drift_stability' then 0.15 else 0.30 end::double) base from (with {PILL} select * from ps)),
s as (select round(least(100, greatest(0, base - coalesce(penalty, 0))), 1) score, coalesce(penalty, 0) penalty from p, c)
select score, case when score >= 85 then 'HARDENED' when score >= 70 then 'ADEQUATE' when score >= 50 then 'MARGINAL' else 'COMPROMISED' end as band, 1.0::double as confidence, round(penalty, 4) as penalty from s""")
def immunity_score(spark, d):
    f = made(spark, d)
    return correlate.immunity(correlate.pillar_scores(f, _modules(spark)), correlate.stories(f))


# ---------------------------------------------------------------- store, set operations, scorer
@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def upsert_latest(spark, d):
    from probity.plans.store import upsert

    e = t(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id"], "event_id")


@query("""with n as (select event_id, event_type || '|' || user_id as nonce from events where event_id % 2 = 1), s as (select event_type || '|' || user_id as nonce from events where event_id % 10 = 0)
select min(event_id) as event_id, nonce from n where nonce not in (select nonce from s) group by nonce""")
def first_wins_nonce(spark, d):
    from probity.plans.store import accept_records

    e = t(spark, d, "events").select("event_id", F.col("event_id").cast("string").alias("record_id"), F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("nonce"))
    return accept_records(e.filter("event_id % 10 = 0"), e.filter("event_id % 2 = 1"), "event_id").select("event_id", "nonce")


@query("select event_id from events where event_id % 2 = 1 and user_id in (select user_id from events where event_id % 50 = 0)")
def nonce_exists(spark, d):
    from probity.plans.store import nonce_exists as probe

    e = t(spark, d, "events").select("event_id", F.col("user_id").alias("nonce"))
    return probe(e.filter("event_id % 50 = 0"), e.filter("event_id % 2 = 1")).select("event_id")


@query("select o_orderkey as scan_id, epoch_us(o_orderdate) * 1000 as started_ns from orders order by 2 desc, 1 limit 50")
def list_scans(spark, d):
    from probity.plans.store import list_scans as top

    return top(t(spark, d, "orders").select(F.col("o_orderkey").alias("scan_id"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("started_ns")))


AUD = """a as (select user_id, event_id id, epoch_us(ts) * 1000 timestamp_ns, event_type action, coalesce(props, '') details, row_number() over (partition by user_id order by event_id) k from events),
c as (select *, repeat('0', 64) prev, sha256(timestamp_ns || '|sys|' || action || '||' || details || '|' || repeat('0', 64)) h from a where k = 1
 union all select a.*, c.h, sha256(a.timestamp_ns || '|sys|' || a.action || '||' || a.details || '|' || c.h) from c join a on a.user_id = c.user_id and a.k = c.k + 1)"""


def _audit(spark, d):
    from probity.plans.store import append_audit

    e = t(spark, d, "events").select("user_id", F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_ns"), F.lit("sys").alias("actor"), F.col("event_type").alias("action"), F.lit(None).cast("string").alias("target"), F.coalesce("props", F.lit("")).alias("details"))
    return append_audit(e, "user_id")


@query(f"with recursive {AUD} select user_id, id, prev as prev_hash, h as entry_hash from c")
def audit_chain(spark, d):
    return _audit(spark, d).select("user_id", "id", "prev_hash", "entry_hash")


@query("""with e as (select user_id, event_id id, row_number() over (partition by user_id order by event_id) k from events), g as (select *, lag(id) over (partition by user_id order by id) p, lag(k) over (partition by user_id order by id) pk from e where id % 61 <> 3)
select user_id, id, 'HASH_MISMATCH' as break_type from g where id % 67 = 5 union all select user_id, id, 'BROKEN_LINK' from g where k <> coalesce(pk, 0) + 1""")
def audit_verify(spark, d):
    from probity.plans.store import verify_audit

    log = _audit(spark, d).filter("id % 61 <> 3").withColumn("action", F.when(F.col("id") % 67 == 5, "edited").otherwise(F.col("action")))
    return verify_audit(log, ["user_id"])


@query("""with t as (select doc_id id from labels where toxic = 1), f as (select doc_id id from documents where doc_id % 7 = 0), c as (select count(t.id) gt, count(f.id) fl, count(*) filter (t.id is not null and f.id is not null) tp from t full join f using (id)), u as (select count(*) u from documents)
select gt as ground_truth, fl as flagged, tp as true_positives, fl - tp as false_positives, gt - tp as false_negatives, u - tp - (fl - tp) - (gt - tp) as true_negatives, round(tp / fl, 4) as precision, round(tp / gt, 4) as recall,
 round(2 * (tp / fl) * (tp / gt) / ((tp / fl) + (tp / gt)), 4) as f1, round((fl - tp) / (u - gt), 4) as false_positive_rate from c, u""")
def precision_recall(spark, d):
    from probity.operators.generators import precision_recall as score

    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"))
    truth = t(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return score(truth, docs.filter("id % 7 = 0"), docs.count())


@query(f"with {FIND}, a as (select affected_asset x from f where severity = 'CRITICAL'), b as (select affected_asset x from f where disposition = 'REVIEW') select 'union' as op, count(*) as n from (select x from a union select x from b) union all select 'intersect', count(*) from (select x from a intersect select x from b) union all select 'except', count(*) from (select x from a except select x from b)")
def set_operations(spark, d):
    f = made(spark, d)
    a, b = f.filter("severity = 'CRITICAL'").select("affected_asset"), f.filter("disposition = 'REVIEW'").select("affected_asset")
    n = lambda x, op: x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return n(a.union(b).distinct(), "union").unionByName(n(a.intersect(b), "intersect")).unionByName(n(a.subtract(b), "except"))


@query("""select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso, case when event_id % 2 = 0 then 'class_7' else '7' end as raw, '7' as label, substr(sha256(event_type), 1, 12) || '…' as short from events""")
def text_helpers(spark, d):
    e = t(spark, d, "events")
    raw = F.when(F.col("event_id") % 2 == 0, "class_7").otherwise("7")
    return e.select("event_id", X.ns_to_iso(F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("iso"), raw.alias("raw"), X.normalise_label(raw).alias("label"), X.short_hash(F.sha2("event_type", 256)).alias("short"))


FLIPPED = FLIP.replace("select vec_id, label, embedding::double[] v", "select vec_id, case when vec_id % 9 = 4 then (label + 3) % 10 else label end as label, list_transform(embedding::double[], lambda x, i: x + case when (i - 1) % 10 = label then 0.25 else 0 end) v", 1)


@query(f"""with {FLIPPED}, score as (select count(*) filter (vec_id % 9 = 4) gt, count(f.vec_id) fl, count(f.vec_id) filter (vec_id % 9 = 4) tp, count(*) u from e left join (select distinct vec_id from flips) f using (vec_id))
select gt as ground_truth, fl as flagged, tp as true_positives, fl - tp as false_positives, gt - tp as false_negatives, u - fl - gt + tp as true_negatives, round(tp / fl, 4) as precision, round(tp / gt, 4) as recall,
 round(2 * (tp / fl) * (tp / gt) / ((tp / fl) + (tp / gt)), 4) as f1, round((fl - tp) / (u - gt), 4) as false_positive_rate from score""")
def flip_detection(spark, d):
    """How well planted label flips, one row in nine, are found."""
    from probity.operators.generators import precision_recall as score

    emb = t(spark, d, "embeddings")  # vectors of a class drawn together, so that there is something to find
    emb = emb.withColumn("embedding", F.transform("embedding", lambda x, i: x.cast("double") + F.when(i % 10 == F.col("label"), 0.25).otherwise(0.0)))
    hit = F.col("vec_id") % 9 == 4
    found = labels.label_flips(emb.withColumn("label", F.when(hit, (F.col("label") + 3) % 10).otherwise(F.col("label"))))
    return score(emb.filter(hit).select(F.col("vec_id").alias("id")), found.select("id"), emb.count())


@query()
def flood_detection(spark, d):
    """How well a planted flood, seven jittered copies of two documents, is found; floods that are there without it aren't held against
    the detector."""
    from probity.operators.generators import flood_duplicates
    from probity.operators.generators import precision_recall as score
    from probity.plans.scan import Thresholds
    from probity.sources.tables import Store

    docs, store, th = t(spark, d, "documents").select("doc_id", "text"), Store(spark, "floods"), Thresholds()

    def flooded(rows):
        fps = store.keep(duplicates.fingerprints(rows))
        pairs = store.keep(duplicates.jaccard(rows, duplicates.near_pairs(fps, th.hamming)).filter(F.col("jaccard") >= th.jaccard))
        members = store.keep(duplicates.clusters(fps, duplicates.components(pairs, store.keep)))
        return members.join(duplicates.shuffled(duplicates.flood_clusters(members, pairs).filter("flood").select("cluster")), "cluster").select("id")

    more = store.keep(flood_duplicates(docs))
    found, natural = flooded(more.select("doc_id", "text")), flooded(docs)
    planted = more.filter("copy_of is not null").select(F.explode(F.array("doc_id", "copy_of")).alias("id"))
    return score(planted, found, more.count(), baseline=natural)


@query()
def full_data_scan(spark, d):
    from probity.plans.scan import scan_data

    emb = t(spark, d, "embeddings")
    who = emb.select(F.col("vec_id").alias("id"), F.concat(F.lit("contributor_"), F.col("vec_id") % 5).alias("contributor"))
    return scan_data(emb, who).findings


RUNGS = "case when c >= 0.85 then 'CRITICAL' when c >= 0.65 then 'HIGH' when c >= 0.40 then 'MEDIUM' else 'LOW' end as severity, round(c, 6)::double as confidence, case when c >= 0.80 then 'QUARANTINE' when c >= 0.50 then 'REVIEW' else 'ACCEPT' end as disposition"
NAMED = "'rec-' || (event_id % 1000000000) || case when event_id >= 1000000000 then '-again' else '' end"


@query(f"""with {BROKEN}, f as (select case when t = 'DUPLICATE_NONCE' then 'INFERENCE_REPLAY' else 'CHAIN_BREAK' end attack_class, record_id affected_asset, 'chain' detector, t what,
 case t when 'BROKEN_LINK' then 0.94 when 'DUPLICATE_NONCE' then 0.92 when 'DUPLICATE_SEQUENCE' then 0.80 when 'SEQUENCE_REGRESSION' then 0.78 when 'SEQUENCE_GAP' then 0.75 when 'MISSING_GENESIS' then 0.70 else 0.60 end c from br where t <> 'HASH_MISMATCH'
 union all select 'INFERENCE_TAMPER', {NAMED}, 'tamper', tamper, 0.97 from ({ORACLES["tamper_detect"]})
 union all select 'INFERENCE_REPLAY', {NAMED}, 'replay', replay_type, case when replay_type = 'IDENTICAL_PAYLOAD' then 0.75 else 0.93 end from ({ORACLES["replay_detect"]}))
select attack_class, affected_asset, detector, what, {RUNGS} from f""")
def full_record_scan(spark, d):
    from probity.plans.scan import scan_records

    f = scan_records(tampered_records(spark, d), "chain", ["event_id"]).findings
    what = F.coalesce(*(F.element_at("evidence", F.lit(k)) for k in ("break_type", "tamper", "replay_type")))
    return f.select("attack_class", "affected_asset", "detector", what.alias("what"), "severity", *r6("confidence"), "disposition")


ALIKE = """pj as (select pr.* from pr join tk x on x.doc_id = pr.a join tk y on y.doc_id = pr.b where case when len(x.tk) + len(y.tk) = 0 then 1.0 else len(list_intersect(x.tk, y.tk)) / len(list_distinct(list_concat(x.tk, y.tk))) end >= 0.8), ed as (select a, b from pj union select b, a from pj)"""


@query(f"""with {CLU.replace("ed as (select a, b from pr union select b, a from pr)", ALIKE)}, sz as (select cluster, count(*) size from mb group by 1 having count(*) > 1), md as (select median(size) m from sz), ma as (select median(abs(size - m)) a from sz, md),
 far as (select distinct cluster from pj join mb on mb.id = pj.a), th as (select sz.*, greatest(4, ceil(m + 3 * greatest(1.4826 * a, 1)))::bigint threshold, far.cluster is null as same from sz left join far using (cluster), md, ma),
 f as (select *, least(0.95, greatest(0.0, 0.55 + 0.06 * (size - threshold))) c0 from th where size >= threshold), g as (select *, case when same then least(c0 + 0.08, 0.97) else c0 end c from f)
select cluster::varchar as affected_asset, size::bigint as size, threshold, {RUNGS} from g""")
def flood_findings(spark, d):
    from probity.plans.scan import scan_texts
    from probity.sources.tables import Store

    f = scan_texts(t(spark, d, "documents"), Store(spark, "flood")).findings
    return f.select("affected_asset", *(F.element_at("evidence", F.lit(k)).cast("bigint").alias(k) for k in ("size", "threshold")), "severity", *r6("confidence"), "disposition")


@query(f"with {FIND}, n as (select finding_id, row_number() over (order by confidence desc, finding_id) r from f) select finding_id as old_id, 'DATA-' || case when r < 1000 then lpad(r::varchar, 3, '0') else r::varchar end as finding_id from n")
def finding_ids(spark, d):
    return fnd.with_ids(made(spark, d).withColumn("old_id", F.col("finding_id")), "DATA", [F.col("confidence").desc(), F.col("old_id")]).select("old_id", "finding_id")


@query(f"""with {DIST.replace("e as (select vec_id, label, embedding::double[] v from embeddings)", "e as (select vec_id, (vec_id % 5) * 100 + label label, embedding::double[] v from embeddings)")}, nn as (select a.vec_id, b.label nl, row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id) r from e a join e b on a.vec_id <> b.vec_id and a.vec_id % 5 = b.vec_id % 5),
vt as (select vec_id, nl, count(*) c from nn where r <= 10 group by 1, 2), tp as (select vec_id, arg_max(nl, c * 10000 - nl) nl, max(c) c, sum(c) k from vt group by 1)
select dd.vec_id, (dd.label % 100)::int as label, (tp.nl % 100)::int as suggested from dd join th using (label) join tp using (vec_id) left join vt on vt.vec_id = dd.vec_id and vt.nl = dd.label
where n >= 8 and (distance > threshold or (coalesce(vt.c, 0) / k <= 0.4 + 1e-12 and tp.nl <> dd.label and tp.c / k >= 0.5))""")
def office_label_flips(spark, d):
    emb = t(spark, d, "embeddings").withColumn("contributor", F.col("vec_id") % 5)
    return labels.label_flips(emb, within="contributor").select(F.col("id").alias("vec_id"), "label", "suggested")


OFFICE = FLIP.replace("select vec_id, label, embedding", "select vec_id, (vec_id % 5) * 100 + label as label, embedding", 1).replace("on a.vec_id <> b.vec_id)", "on a.vec_id <> b.vec_id and a.vec_id % 5 = b.vec_id % 5)").replace("c * 1000 - nl", "c * 10000 - nl")
LADDER = "case when confidence >= 0.85 then 1.0 when confidence >= 0.65 then 0.7 when confidence >= 0.40 then 0.4 else 0.15 end::double"


@query(f"""with {OFFICE}, rt as (with {RISK.format(samples="(select 'contributor_' || (vec_id % 5) contributor from e)", findings=f"select 'contributor_' || (vec_id % 5) contributor, confidence, 'LABEL_FLIPPING' attack_class, vec_id affected_asset, {LADDER} w from flips")}),
s as (select count(*) n, avg(risk_score) m, stddev_pop(risk_score) sd, median(risk_score) med from rt), ma as (select median(abs(risk_score - med)) * 1.4826 mad from rt, s), pm as (select a.contributor, median(b.risk_score) pm from rt a join rt b on a.contributor <> b.contributor group by 1),
x as (select contributor, risk_score risk, pm, case when pm > 1e-9 then risk_score / pm end ratio, case when sd > 1e-9 then (risk_score - m) / sd else 0 end z, case when mad > 1e-9 then (risk_score - med) / mad else 0 end rz, (n - 1) / sqrt(n) top from rt join pm using (contributor), s, ma),
y as (select *, case when ratio is not null then ratio >= 1.8 else risk > 0.45 end and risk >= 0.45 br, z >= 1.5 and risk >= 0.45 bz from x)
select contributor, round(risk, 4) as risk_score, round(pm, 4) as peer_median, round(ratio, 4) as ratio, round(z, 4) as zscore, round(rz, 3) as robust_zscore, round(top, 6) as attainable_max_zscore, case when br then 'median_ratio' when bz then 'zscore' end as triggered_by,
 case when br or bz then round(least(0.90, 0.45 + 0.35 * least(1.0, (risk - pm) / greatest(pm, 0.15)) + case when bz then 0.10 else 0.0 end), 4) end as confidence from y""")
def office_disparity(spark, d):
    from probity.plans.scan import scan_office

    emb = t(spark, d, "embeddings").withColumn("contributor", F.concat(F.lit("contributor_"), F.col("vec_id") % 5))
    o = scan_office(emb)["disparity"]
    return o.select("contributor", *(F.round(c, k).alias(c) for c, k in (("risk_score", 4), ("peer_median", 4), ("ratio", 4), ("zscore", 4), ("robust_zscore", 3), ("attainable_max_zscore", 6))), "triggered_by", F.round("confidence", 4).alias("confidence"))
