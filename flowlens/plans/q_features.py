"""Queries: feature ranking, selection, rebalancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import ranks
from flowlens.functions.local import local_table
from flowlens.functions.portable import rounded
from flowlens.operators import balance, select
from flowlens.operators.sample import class_counts
from flowlens.plans import beds
from flowlens.plans.beds import FEATURES, KEY, LI
from flowlens.plans.catalog import query
from flowlens.plans.q_data import POISSON

CELLS = "cells as (" + " union all ".join(f"select '{c}' as feature, label, cast({c} as double) as value from li" for c in FEATURES) + ")"
ANOVA = """g as (select feature, label, count(*) as n, avg(value) as m, var_pop(value) as v from cells group by 1, 2),
w as (select *, sum(n * m) over (partition by feature) / sum(n) over (partition by feature) as a from g),
anova as (select feature, (sum(n * (m - a) * (m - a)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) as score from w group by 1)"""
CHI = """sc as (select c.feature, label, (value - lo) / case when hi > lo then hi - lo else 1 end as value from cells c join (select feature, min(value) as lo, max(value) as hi from cells group by 1) r on c.feature = r.feature),
co as (select feature, label, sum(value) as o, count(*) as n from sc group by 1, 2),
ce as (select *, sum(o) over (partition by feature) * n / sum(n) over (partition by feature) as e from co),
chi as (select feature, sum((o - e) * (o - e) / e) as score from ce group by 1)"""
_EDGES = ", ".join(f"{i / 32!r}" for i in range(33))
MI = f"""qe as (select feature, list_sort(list_distinct(quantile_cont(value, [{_EDGES}]))) as edges from cells group by 1),
mb as (select c.feature, label, len(list_filter(list_slice(edges, 2, len(edges) - 1), lambda e: e <= value)) as bin, count(*) as n from cells c join qe on c.feature = qe.feature group by 1, 2, 3),
mt as (select *, sum(n) over (partition by feature) as t, sum(n) over (partition by feature, bin) as b, sum(n) over (partition by feature, label) as c from mb),
mi as (select feature, greatest(0, sum(n / t * ln(n * t / (b * c)))) as score from mt group by 1)"""


def _em_cells() -> str:
    return "cells as (select 'e' || cast(i - 1 as varchar) as feature, label, cast(x as double) as value from (select label, unnest(embedding) as x, unnest(range(1, 65)) as i from embeddings))"


@query("rank_anova", f"with {LI}, {CELLS}, {ANOVA} select feature, round_even(score, 4) as score from anova")
def _(spark, folder):
    return select.anova(beds.li(spark, folder), FEATURES, "label").withColumn("score", rounded(F.col("score"), 4))


@query("rank_anova_vectors", f"with {_em_cells()}, {ANOVA} select feature, round_even(score, 5) as score from anova")
def _(spark, folder):
    return select.anova(beds.em(spark, folder), beds.EM_FEATURES, "label").withColumn("score", rounded(F.col("score"), 5))


@query("rank_chi2", f"with {LI}, {CELLS}, {CHI} select feature, round_even(score, 4) as score from chi")
def _(spark, folder):
    return select.chi2(beds.li(spark, folder), FEATURES, "label").withColumn("score", rounded(F.col("score"), 4))


@query("rank_mutual_information", f"with {LI}, {CELLS}, {MI} select feature, round_even(score, 6) as score from mi")
def _(spark, folder):
    return select.mutual_information(beds.li(spark, folder), FEATURES, "label").withColumn("score", rounded(F.col("score")))


@query("correlations", f"with {LI} " + " union all ".join(
    f"select '{a}' as a, '{b}' as b, round_even(corr({a}, {b}), 6) as r from li" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]))
def _(spark, folder):
    return select.correlations(beds.li(spark, folder), FEATURES).withColumn("r", rounded(F.col("r")))


@query("correlations_wide", """with x as (select vec_id, unnest(embedding)::double as v, unnest(range(len(embedding))) as i from embeddings)
select 'x' || a.i as a, 'x' || b.i as b, round_even(corr(a.v, b.v), 6) as r from x a join x b on a.vec_id = b.vec_id and a.i < b.i group by a.i, b.i""")
def _(spark, folder):
    """All 2,016 pairs of the 64 dimensions of the embeddings."""
    wide = beds.table(spark, folder, "embeddings").select(*(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)))
    return select.correlations(wide, wide.columns).withColumn("r", rounded(F.col("r")))


@query("exact_quantiles", f"with {LI} " + " union all ".join(
    f"select '{c}' as feature, {q!r} as q, round_even(quantile_cont({c}, {q!r}), 6) as value from li" for c in FEATURES for q in (0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0)))
def _(spark, folder):
    found = ranks.quantiles(beds.li(spark, folder), {c: [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0] for c in FEATURES})
    return local_table(spark, [(c, q, v) for (c, q), v in found.items()], "feature string, q double, value double").withColumn("value", rounded(F.col("value")))


RANKING = f"""{LI}, {CELLS}, {ANOVA}, {CHI}, {MI},
scores as (select 'anova' as method, feature, round(score, 9) as score from anova union all select 'chi2', feature, round(score, 9) from chi union all select 'mutual_info', feature, round(score, 9) from mi),
places as (select *, rank() over (partition by method order by score desc) as r from scores),
fused as (select feature, avg(1 / r) as score, max(case when method = 'anova' then score end) as tie from places group by 1),
ranking as (select feature, score, row_number() over (order by score desc, tie desc, feature) as position from fused)"""


@query("rank_features", f"with {RANKING} select feature, round_even(score, 6) as score, cast(position as integer) as position from ranking")
def _(spark, folder):
    return select.rank_features(beds.li(spark, folder), FEATURES, "label").withColumn("score", rounded(F.col("score")))


@query("select_features", f"with {RANKING} select feature, round_even(score, 6) as score, cast(position as integer) as position from ranking where position <= 2")
def _(spark, folder):
    return select.select_features(beds.li(spark, folder), FEATURES, "label", KEY, 2).withColumn("score", rounded(F.col("score")))


_FIVE = [*FEATURES, "double_tax"]
_R = ", ".join(f"'{a}|{b}': abs(corr({a}, {b})), '{b}|{a}': abs(corr({a}, {b}))" for i, a in enumerate(_FIVE) for b in _FIVE[i + 1 :])


@query("prune_correlated", f"""with recursive {LI.replace("li as (", "one as (", 1)}, li as (select *, l_tax * 2 as double_tax from one),
{CELLS[:-1]} union all select 'double_tax', label, double_tax from li), {ANOVA}, r as (select map {{{_R}}} as r from li),
o as (select a.feature, row_number() over (order by round(score, 9) desc, list_position({_FIVE!r}, a.feature)) as at from anova a),
s as (select cast(0 as bigint) as at, cast([] as varchar[]) as kept, '' as feature, cast(null as varchar) as other
  union all select o.at, case when n.other is null then list_append(s.kept, o.feature) else s.kept end, o.feature, n.other
  from s join o on o.at = s.at + 1, r, lateral (select list_filter(s.kept, lambda k: r.r[o.feature || '|' || k] >= 0.95)[1] as other) n)
select s.feature, other is null as kept, coalesce(printf('correlates with %s (%.3f)', other, r.r[s.feature || '|' || other]), '') as reason from s, r where s.at > 0""")
def _(spark, folder):
    df = beds.li(spark, folder).withColumn("double_tax", F.col("l_tax") * 2)
    r = {(x["a"], x["b"]): x["r"] for x in select.correlations(df, _FIVE).collect()}
    priority = {x["feature"]: round(x["score"], 9) for x in select.anova(df, _FIVE, "label").collect()}
    kept, why = select.prune(r, _FIVE, priority)
    return local_table(spark, [(c, c in kept, why.get(c, "")) for c in _FIVE], "feature string, kept boolean, reason string")


STABLE = f"""tm as (select *, {POISSON} as t from (select *, cast('0x' || substr(md5(concat_ws('|', 'stab', cast(rep as varchar), {beds._KEY})), 1, 8) as bigint) / 4294967296.0 as u from li, (select unnest([0, 1, 2, 3, 4]) as rep))),
wc as ({" union all ".join(f"select rep, '{c}' as feature, label, cast({c} as double) as value, t from tm" for c in FEATURES)}),
wg as (select rep, feature, label, sum(t) as n, sum(t * value) / sum(t) as m, sum(t * value * value) / sum(t) - (sum(t * value) / sum(t)) ** 2 as v from wc where t > 0 group by 1, 2, 3),
wa as (select *, sum(n * m) over (partition by rep, feature) / sum(n) over (partition by rep, feature) as a from wg),
wf as (select rep, feature, (sum(n * (m - a) * (m - a)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) as score from wa group by 1, 2),
stable as (select feature, count(*) filter (place <= 2) / 5.0 as frequency from (select *, row_number() over (partition by rep order by score desc, feature) as place from wf) group by 1)"""


@query("rank_stability", f"with {LI}, {STABLE} select feature, frequency, frequency < 0.6 as fragile from stable")
def _(spark, folder):
    return select.stability(beds.li(spark, folder), FEATURES, "label", KEY, 2)


@query("ranking_with_stability", f"with {RANKING}, {STABLE} select r.feature, cast(position as integer) as position, frequency from ranking r left join stable t on r.feature = t.feature")
def _(spark, folder):
    df = beds.li(spark, folder)
    out = select.with_stability(select.rank_features(df, FEATURES, "label"), select.stability(df, FEATURES, "label", KEY, 2))
    return out.select("feature", "position", "frequency")


@query("ranking_overlap", f"""with {LI}, {CELLS}, {ANOVA}, {CHI}, a as (select feature, row_number() over (order by round(score, 9) desc, feature) as p from anova), b as (select feature, row_number() over (order by round(score, 9) desc, feature) as p from chi)
select 2 as k, count(*) as shared, count(*) / 2.0 as agreement from a join b on a.feature = b.feature where a.p <= 2 and b.p <= 2""")
def _(spark, folder):
    df = beds.li(spark, folder)
    place = lambda x: select.fuse(x.select(F.lit("m").alias("method"), "feature", F.round("score", 9).alias("score")), "m")
    return select.top_overlap(place(select.anova(df, FEATURES, "label")), place(select.chi2(df, FEATURES, "label")), 2)


@query("rfe_ranking")
def _(spark, folder):
    from flowlens.operators.normalise import encode
    from flowlens.operators.sample import budgeted

    rows = encode(budgeted(beds.li(spark, folder), "label", KEY, 4000, 50, "rfe"), "label", beds.codec(spark))
    return select.rfe(rows, FEATURES, "code", 2, trees=20, depth=8)


@query("balance_targets", f"""with {LI}, c as (select label as class, count(*) as n from li group by 1), t as (select *, greatest(cast(ceil(0.25 * max(n) over ()) as bigint), 0) as want, 20 * n as cap from c)
select class, n, greatest(n, least(want, cap)) as target, want > cap as capped from t""")
def _(spark, folder):
    return balance.target_table(beds.li(spark, folder), "label")


TARGETS = "select label, n, greatest(n, least(cast(ceil(0.25 * max(n) over ()) as bigint), 20 * n)) as t from (select label, count(*) as n from li group by 1)"


@query("oversample", f"""with {LI}, p as ({TARGETS}), r as (select li.*, n, t, row_number() over (partition by li.label order by {beds.md5('over')}, {beds.KEYS}) as r from li join p on li.label = p.label)
select {beds.KEYS}, label, cast(copy as integer) as copy from (select *, unnest(range(0, cast(t // n + case when r <= t % n then 1 else 0 end as bigint))) as copy from r)""")
def _(spark, folder):
    df = beds.li(spark, folder)
    wanted = {c: t for c, (t, _) in balance.targets(class_counts(df, "label")).items()}
    return balance.oversample(df, "label", KEY, wanted, "over").select(*KEY, "label", "copy")


@query("before_after", f"""with {LI}, p as ({TARGETS}) select label as class, n as before, t as after, t - n as change, round_even(t / n, 6) as factor, round_even(max(t) over () / t, 6) as imbalance from p""")
def _(spark, folder):
    df = beds.li(spark, folder)
    wanted = {c: t for c, (t, _) in balance.targets(class_counts(df, "label")).items()}
    return balance.before_after(df, balance.oversample(df, "label", KEY, wanted, "over"), "label")


_EM = "emv as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings)"
_DIST = "round_even(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6)"
KNN = f"""{_EM}, pairs as (select a.vec_id, a.label, b.vec_id as neighbour, {_DIST} as distance from emv a join emv b on a.label = b.label and a.vec_id != b.vec_id),
knn as (select *, row_number() over (partition by vec_id order by distance, neighbour) as place from pairs)"""


#: Labels 0 to 4 as one class, which makes the classes unequal.
_MERGED = _EM.replace("vec_id, label,", "vec_id, case when label < 5 then 0 else label end as label,")


def every(name: str, sql: str):
    """Registers a query over every row under its name and with _all."""

    def add(f):
        for n in (name, f"{name}_all"):
            query(n, sql)(f)
        return f

    return add


@every("class_neighbours", f"with {KNN} select vec_id, neighbour, distance, cast(place as integer) as place from knn where place <= 5")
def _(spark, folder):
    return balance.neighbours(beds.em_vectors(spark, folder), "vec_id", "label", "v", 5)


_D = lambda what: f"cast('0x' || substr(md5(concat_ws('|', 'smote-{what}', cast(label as varchar), cast(i as varchar))), 1, 8) as bigint)"


@every("smote", f"""with {KNN}, n as (select label, count(*) as n, max(count(*)) over () as most from emv group by 1),
  g as (select label, n, unnest(range(0, cast(ceil(0.5 * most) as bigint) - n)) as i from n where ceil(0.5 * most) > n),
  s as (select *, {_D('row')} % n as pick, least(5, n - 1) as kk, ({_D('between')} % 1000000) / 1e6 as u from g),
  o as (select *, row_number() over (partition by label order by vec_id) - 1 as pick from emv),
  j as (select s.label, s.i, s.u, o.v, o.vec_id, {_D('near').replace('label', 's.label').replace('(i ', '(s.i ')} % kk + 1 as p from s join o on s.label = o.label and s.pick = o.pick)
select j.label, cast(j.i as integer) as i, round_even(list_sum(list_transform(list_zip(j.v, w.v), lambda z: z[1] + j.u * (z[2] - z[1]))), 5) as total
from j join knn on j.vec_id = knn.vec_id and knn.place = j.p join emv w on w.vec_id = knn.neighbour""".replace(_EM, _MERGED))
def _(spark, folder):
    df = beds.em_merged(spark, folder)
    n = {r[0]: r[1] for r in df.groupBy("label").count().collect()}
    want = -(-max(n.values()) // 2)
    out = balance.smote(df, "vec_id", "label", "v", {c: max(m, want) for c, m in n.items()})
    return out.select("label", "i", rounded(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@every("tomek_links", f"""with {_EM}, d as (select a.vec_id, a.label, b.vec_id as other, b.label as other_label, {_DIST} as distance from emv a join emv b on a.vec_id != b.vec_id),
  n as (select * from (select *, row_number() over (partition by vec_id order by distance, other) as r from d) where r = 1)
select a.vec_id, a.other from n a join n b on a.other = b.vec_id and b.other = a.vec_id where a.label != a.other_label""")
def _(spark, folder):
    return balance.tomek_links(beds.em_vectors(spark, folder), "vec_id", "label", "v")


@query("resample_counts", f"""with {_EM.replace(_EM, _MERGED)}, n as (select label, count(*) as n, cast(ceil(0.5 * max(count(*)) over ()) as bigint) as want from emv group by 1)
select strategy, cast(label as integer) as label, case when strategy in ('oversample', 'smote') then greatest(n, want) else n end as n, case when strategy in ('oversample', 'smote') then greatest(0, want - n) else 0 end as synthetic
from n, (select unnest(['none', 'class_weight', 'oversample', 'smote']) as strategy)""")
def _(spark, folder):
    df = beds.em_merged(spark, folder)
    counts = {r[0]: r[1] for r in df.groupBy("label").count().collect()}
    wanted = {c: max(n, -(-max(counts.values()) // 2)) for c, n in counts.items()}
    tables = [balance.resample(df, "vec_id", "label", "v", s, wanted).select(F.lit(s).alias("strategy"), "label", "synthetic") for s in balance.STRATEGIES[:4]]
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return whole.groupBy("strategy", "label").agg(F.count("*").alias("n"), F.count_if("synthetic").alias("synthetic"))


@query("feature_reference", f"with {RANKING}, m as (" + " union all ".join(f"select '{c}' as feature, quantile_cont({c}, 0.5) as median from li" for c in FEATURES) + """)
select r.feature, cast(position as integer) as position, case r.feature when 'l_tax' then 'tax rate' else r.feature end as gloss, round_even(median, 6) as median, position <= 2 as selected from ranking r join m on r.feature = m.feature""")
def _(spark, folder):
    from flowlens.operators import prep, summary

    df = beds.li(spark, folder)
    glosses = local_table(spark, [("l_tax", "tax rate")], "feature string, gloss string")
    out = summary.feature_reference(select.rank_features(df, FEATURES, "label"), glosses, prep.fit(df, FEATURES, 0.99).table(df), 2)
    return out.withColumn("median", rounded(F.col("median")))


