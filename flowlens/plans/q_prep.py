"""Queries: preprocessing, class weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.portable import rounded
from flowlens.operators import prep
from flowlens.plans import beds
from flowlens.plans.beds import FEATURES, KEY, LI, LID
from flowlens.plans.catalog import query

Q = 0.99
FIN = f"{LID}, fin as (select {beds.KEYS}, label, " + ", ".join(f"case when isfinite({c}) then {c} end as {c}" for c in FEATURES) + " from lid)"
BOUNDS = "b as (select " + ", ".join(f"quantile_cont({c}, {1 - Q!r}) as lo_{c}, quantile_cont({c}, {Q!r}) as hi_{c}, quantile_cont({c}, 0.5) as raw_{c}" for c in FEATURES) + " from fin)"
CLIP = f"clip as (select fin.{', fin.'.join(KEY)}, label, " + ", ".join(f"case when {c} is null then null else least(greatest({c}, lo_{c}), hi_{c}) end as {c}" for c in FEATURES) + " from fin, b)"
MEDIAN = "m as (select " + ", ".join(f"quantile_cont({c}, 0.5) as med_{c}" for c in FEATURES) + " from clip)"
FILL = f"fill as (select {', '.join(KEY)}, label, " + ", ".join(f"coalesce({c}, med_{c}) as {c}" for c in FEATURES) + " from clip, m)"
FITTED = f"{FIN}, {BOUNDS}, {CLIP}, {MEDIAN}, {FILL}"
_MOMENTS = {
    "standard": lambda c: (f"avg({c})", f"stddev_pop({c})"),
    "minmax": lambda c: (f"min({c})", f"max({c}) - min({c})"),
    "robust": lambda c: (f"quantile_cont({c}, 0.5)", f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
    "none": lambda c: (f"min(0.0 * {c})", f"min(1 + 0.0 * {c})"),
}


def moments(scaler: str) -> str:
    return "s as (select " + ", ".join(f"{_MOMENTS[scaler](c)[0]} as c_{c}, {_MOMENTS[scaler](c)[1]} as d_{c}" for c in FEATURES) + " from fill)"


def _stats_sql(scaler: str) -> str:
    rows = " union all ".join(
        f"select '{c}' as feature, round_even(raw_{c}, 6) as raw_median, round_even(lo_{c}, 6) as lower, round_even(hi_{c}, 6) as upper, round_even(med_{c}, 6) as median, "
        f"round_even(c_{c}, 6) as centre, round_even(d_{c}, 6) as spread from b, m, s" for c in FEATURES)
    return f"with {FITTED}, {moments(scaler)} {rows}"


def _scaled_sql(scaler: str) -> str:
    cells = ", ".join(f"round_even(avg(({c} - c_{c}) / d_{c}), 4) as {c}, round_even(max(({c} - c_{c}) / d_{c}), 6) as top_{c}" for c in FEATURES)
    return f"with {FITTED}, {moments(scaler)} select label, {cells} from fill, s group by label"


def _register(scaler: str) -> None:
    @query(f"prep_fit_{scaler}", _stats_sql(scaler))
    def _(spark, folder):
        df = beds.lid(spark, folder)
        out = prep.fit(df, FEATURES, Q, scaler).table(df)
        return out.select("feature", *(rounded(F.col(c)).alias(c) for c in ("raw_median", "lower", "upper", "median", "centre", "spread")))

    @query(f"prep_transform_{scaler}", _scaled_sql(scaler))
    def _(spark, folder):
        df = beds.lid(spark, folder)
        out = prep.transform(df, prep.fit(df, FEATURES, Q, scaler), ["label"])
        return out.groupBy("label").agg(*(x for c in FEATURES for x in (rounded(F.avg(c), 4).alias(c), rounded(F.max(c)).alias(f"top_{c}"))))


for _scaler in prep.SCALERS:
    _register(_scaler)


@query("prep_constant", "with t as (select l_linenumber, case when l_tax > 1 then 2.0 end as never, case when l_quantity > 49 then 5.0 end as five from lineitem) " + " union all ".join(
    f"select '{c}' as feature, count(distinct {c}) <= 1 as constant from t" for c in ("l_linenumber", "never", "five")))
def _(spark, folder):
    df = beds.li(spark, folder).withColumn("never", F.when(F.col("l_tax") > 1, 2.0)).withColumn("five", F.when(F.col("l_quantity") > 49, 5.0))
    return prep.fit(df, ["l_linenumber", "never", "five"]).table(df).select("feature", "constant")


@query("prep_inverse", f"with {FITTED} select label, " + ", ".join(f"round_even(avg({c}), 5) as {c}" for c in FEATURES) + " from fill group by label")
def _(spark, folder):
    df = beds.lid(spark, folder)
    stats = prep.fit(df, FEATURES, Q, "robust")
    back = prep.inverse(prep.transform(df, stats, ["label"]), stats)
    return back.groupBy("label").agg(*(rounded(F.avg(c), 5).alias(c) for c in FEATURES))


@query("prep_align", f"with {FIN}, {BOUNDS} select label, count(*) as n, round_even(min(raw_l_tax), 6) as low, round_even(max(raw_l_tax), 6) as high from fin, b group by label")
def _(spark, folder):
    df = beds.lid(spark, folder)
    out = prep.align(df.drop("l_tax").withColumn("extra", F.lit(1)), prep.fit(df, FEATURES, Q), ["label"])
    return out.groupBy("label").agg(F.count("*").alias("n"), rounded(F.min("l_tax")).alias("low"), rounded(F.max("l_tax")).alias("high"))


@query("prep_subset", f"with {FITTED}, {moments('standard')} select label, round_even(avg((l_tax - c_l_tax) / d_l_tax), 6) as l_tax from fill, s group by label")
def _(spark, folder):
    df = beds.lid(spark, folder)
    part = prep.fit(df, FEATURES, Q).subset(["l_tax"])
    return prep.transform(df, part, ["label"]).groupBy("label").agg(rounded(F.avg("l_tax")).alias("l_tax"))


def _weights_sql(weight: str) -> str:
    return f"with {LI}, c as (select label as class, count(*) as n from li group by 1) select class, n, round_even(least({weight}, 50.0), 6) as weight from c"


for _scheme, _sql in (("balanced", "sum(n) over () / (count(*) over () * n)"), ("sqrt", "sqrt(sum(n) over () / (count(*) over () * n))"), ("none", "cast(1 as double)")):

    @query(f"class_weights_{_scheme}", _weights_sql(_sql))
    def _(spark, folder, scheme=_scheme):
        return prep.class_weights(beds.li(spark, folder), "label", scheme).withColumn("weight", rounded(F.col("weight")))


@query("row_weights", f"with {LI}, c as (select label as class, least(sum(count(*)) over () / (count(*) over () * count(*)), 50.0) as w from li where label != 'big' group by 1)"
       " select label, round_even(sum(coalesce(w, 1)), 4) as total from li left join c on label = class group by 1")
def _(spark, folder):
    df = beds.li(spark, folder)
    out = prep.with_weights(df, "label", prep.class_weights(df.where("label != 'big'"), "label"))
    return out.groupBy("label").agg(rounded(F.sum("weight"), 4).alias("total"))


def _impute_sql(k: int = 5) -> str:
    """Every pair of incomplete row and row with the cell, as the nearest k by (distance, hash, value)."""
    tie = f"cast('0x' || substr({beds.md5('knn')}, 1, 15) as bigint)"
    some = " or ".join(f"{c} is not null" for c in FEATURES)
    both = " + ".join(f"case when q.{c} is not null and r.{c} is not null then 1 else 0 end" for c in FEATURES)
    far = " + ".join(f"coalesce((r.{c} - q.{c}) * (r.{c} - q.{c}), 0.0)" for c in FEATURES)
    cells = ", ".join(f"m{i} as (select q.i, list_avg([x.v for x in min(struct_pack(d := ({far}) * {len(FEATURES)} / ({both}), h := r.h, v := r.{c}), {k})]) as v "
                      f"from asked q, dat r where q.{c} is null and r.{c} is not null and ({both}) > 0 group by 1)" for i, c in enumerate(FEATURES))
    same = " and ".join(f"f.{c} is not distinct from a.{c}" for c in FEATURES)
    joins = " ".join(f"left join m{i} on m{i}.i = a.i" for i in range(len(FEATURES)))
    filled = ", ".join(f"round_even(coalesce(f.{c}, m{i}.v), 4) as {c}" for i, c in enumerate(FEATURES))
    return (f"with {FIN}, dat as materialized (select {tie} as h, {', '.join(FEATURES)} from fin where {some}), "
            f"asked as materialized (select row_number() over () as i, * from (select distinct {', '.join(FEATURES)} from dat where {' or '.join(f'{c} is null' for c in FEATURES)})), {cells} "
            f"select f.{', f.'.join(KEY)}, f.label, {filled} from fin f left join asked a on {same} {joins}")


@query("knn_impute", _impute_sql())
def _(spark, folder):
    out = prep.knn_impute(beds.lid(spark, folder), FEATURES, KEY)
    return out.select(*KEY, "label", *(rounded(F.col(c), 4).alias(c) for c in FEATURES))
