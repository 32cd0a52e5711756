"""Queries: normalisation, cleaning, sampling, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import clean, normalise, sample
from flowlens.plans import beds
from flowlens.plans.beds import FEATURES, KEY, KEYS, LI, LID
from flowlens.plans.catalog import query
from flowlens.sources import dims, tables

MESSY = {"rare": " heart_bleed", "big": "Web Attack \u0096  brute Force", "deep": "ssh - patator", "base": "Made  Up"}


def messy(spark, folder):
    names = F.create_map(*(F.lit(x) for p in MESSY.items() for x in p))
    return beds.li(spark, folder).withColumn("label", F.element_at(names, F.col("label")))


@query("normalise_labels", f"""with {LI} select case label when 'rare' then 'Rare Attacks' when 'big' then 'Web Attack - Brute Force'
  when 'deep' then 'SSH-Patator' else 'Made Up' end as label, count(*) as n from li group by 1""")
def _(spark, folder):
    return normalise.normalise_labels(messy(spark, folder), "label").groupBy("label").agg(F.count("*").alias("n"))


@query("merge_rare_labels", f"with {LI} select case when label in ('rare', 'big') then 'few' else label end as label, count(*) as n from li group by 1")
def _(spark, folder):
    return beds.li(spark, folder).select(normalise.merged(F.col("label"), ["rare", "big"], "few").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("label_family", f"""with {LI} select case label when 'base' then 'Normal' when 'deep' then 'Discount' when 'big' then 'Volume' else 'Unknown' end as family,
  count(*) as n from li group by 1""")
def _(spark, folder):
    known = beds.profiles(spark).where("class != 'rare'")
    return normalise.with_family(beds.li(spark, folder), "label", known).groupBy("family").agg(F.count("*").alias("n"))


@query("label_encode", f"with {LI} select label, case label when 'base' then 0 when 'deep' then 1 when 'big' then 2 else -1 end as code, count(*) as n from li group by 1, 2")
def _(spark, folder):
    codec = beds.codec(spark).where("class != 'rare'")
    return normalise.encode(beds.li(spark, folder), "label", codec).groupBy("label", F.coalesce("code", F.lit(-1)).alias("code")).agg(F.count("*").alias("n"))


@query("label_unseen", f"with {LI} select label as class, count(*) as n from li where label not in ('base', 'big') group by 1")
def _(spark, folder):
    return normalise.unseen(beds.li(spark, folder), "label", beds.codec(spark).where("class in ('base', 'big')"))


@query("coerce_numbers", f"with {LID} " + " union all ".join(
    f"select '{c}' as feature, count(*) filter (isnan({c})) as coerced, count(*) filter (isinf({c})) as nonfinite from lid" for c in FEATURES))
def _(spark, folder):
    rows = beds.lid(spark, folder)
    return normalise.coerced_counts(rows.select(*(F.col(c).cast("string").alias(c) for c in FEATURES)), FEATURES)


@query("nulls_for_nonfinite", f"with {LID} select label, " + ", ".join(f"count(case when isfinite({c}) then 1 end) as {c}" for c in FEATURES) + " from lid group by label")
def _(spark, folder):
    rows = clean.nulls_for_nonfinite(beds.lid(spark, folder), FEATURES)
    return rows.groupBy("label").agg(*(F.count(c).alias(c) for c in FEATURES))


@query("drop_empty_rows", f"with {LID} select label, count(*) as n from lid where coalesce({', '.join(FEATURES)}) is not null group by label")
def _(spark, folder):
    return clean.drop_empty(beds.lid(spark, folder), FEATURES).groupBy("label").agg(F.count("*").alias("n"))


_FINITE = ", ".join(f"case when isfinite({c}) then {c} end as {c}" for c in FEATURES)
CLEAN = f"""{LID}, fin as (select {KEYS}, label, {_FINITE} from lid),
cleaned as (select * exclude (r) from (select *, row_number() over (partition by {', '.join(FEATURES)}, label order by {KEYS}) as r from fin
  where coalesce({', '.join(FEATURES)}) is not null) where r = 1)"""


@query("clean_rows", f"with {CLEAN} select * from cleaned")
def cleaned(spark, folder):
    return clean.clean(beds.lid(spark, folder), FEATURES, "label", KEY)


@query("drop_duplicates", f"with {LID} select label, count(*) as n, cast(sum(l_orderkey) as bigint) as k from (select *, row_number() over (partition by {', '.join(FEATURES)}, label order by {KEYS}) as r from lid) where r = 1 group by label")
def _(spark, folder):
    rows = clean.drop_duplicates(beds.lid(spark, folder), FEATURES, "label", KEY)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("k"))


@query("contradictions", "select l_quantity, l_discount, count(distinct l_returnflag) as n_labels, count(*) as n_rows from lineitem group by 1, 2 having count(distinct l_returnflag) > 1")
def _(spark, folder):
    return clean.contradictions(beds.table(spark, folder, "lineitem"), ["l_quantity", "l_discount"], "l_returnflag")


@query("negative_counts", f"with {LID} " + " union all ".join(f"select '{c}' as feature, count(*) filter ({c} < 0) as negative from lid" for c in FEATURES))
def _(spark, folder):
    return clean.negative_counts(beds.lid(spark, folder), FEATURES)


@query("clean_report", f"""with {CLEAN}, n as (select count(*) as rows_in, count(*) filter (coalesce({', '.join(FEATURES)}) is null) as empty from fin)
select 'rows_in' as measure, rows_in as value from n union all select 'rows_out', count(*) from cleaned
union all select 'duplicates', (select rows_in - empty from n) - (select count(*) from cleaned) union all select 'all_missing', empty from n
union all select 'infinite', count(*) filter (isinf(l_extendedprice)) from lid
union all select 'missing', cast(sum(case when l_quantity is null then 1 else 0 end + case when l_extendedprice is null or isnan(l_extendedprice) then 1 else 0 end
  + case when l_discount is null then 1 else 0 end + case when l_tax is null then 1 else 0 end) as bigint) from lid
union all select 'negative', count(*) filter (l_quantity < 0) from lid
""" + "".join(f"union all select 'missing:{c}', count(*) - count({c}) from fin " for c in FEATURES))
def _(spark, folder):
    return clean.clean_report(beds.lid(spark, folder), FEATURES, "label")


@query("load_report", f"""with {LID} select 'rows' as kind, '' as name, count(*) as n from lid union all select 'unlabelled', '', 0
""" + "".join(f"union all select 'infinite', '{c}', count(*) filter (isinf({c})) from lid union all select 'nan', '{c}', count(*) filter (isnan({c})) from lid "
              f"union all select 'null', '{c}', count(*) filter ({c} is null) from lid " for c in FEATURES)
    + "union all select case when label = 'rare' then 'unexpected' else 'class' end, label, count(*) from lid group by label")
def _(spark, folder):
    return clean.load_report(beds.lid(spark, folder), FEATURES, "label", ["base", "deep", "big"])


@query("consolidate", f"""with {LI} select case label when 'rare' then 'Rare Attacks' when 'big' then 'Web Attack - Brute Force' when 'deep' then 'SSH-Patator' else 'Made Up' end as label,
  count(*) as n, round(sum(l_quantity), 2) as q, count(case when l_linenumber <= 3 then l_tax end) as tax, cast(0 as bigint) as absent from li group by 1""")
def _(spark, folder):
    rows = messy(spark, folder)
    text = lambda d, cols: d.select(*(F.col(c).cast("string").alias(f" {c} ") for c in cols), "label", F.lit("x").alias("Timestamp"))
    parts = [text(rows.where("l_linenumber <= 3"), FEATURES), text(rows.where("l_linenumber > 3"), FEATURES[:3])]
    out = tables.consolidate(parts, [*FEATURES, "other"], "label")
    return out.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"), F.count("l_tax").alias("tax"), F.count("other").alias("absent"))


@query("audit_counts", f"""with {LI}, o as (select label as class, count(*) as n from li group by 1),
  p as (select unnest(['base', 'deep', 'lost']) as class, unnest([45000, 100, 7]) as published)
select coalesce(o.class, p.class) as class, coalesce(n, 0) as n, coalesce(cast(published as bigint), 0) as published, round_even((coalesce(n, 0) - published) / published, 6) as difference,
  case when published is null then 'unlisted' when abs((coalesce(n, 0) - published) / published) <= 0.02 then 'ok' else 'CHECK' end as verdict
from o full join p on o.class = p.class""")
def _(spark, folder):
    out = clean.audit_counts(beds.li(spark, folder), "label", dims.count_table(spark, {"base": 45000, "deep": 100, "lost": 7}))
    return out.na.fill(0, ["published"])


CAPS = {"base": 5000, "deep": 1000}


@query("sampling_plan", f"""with {LI}, c as (select label as class, count(*) as available from li group by 1),
  p as (select *, case class when 'base' then 5000 when 'deep' then 1000 end as cap from c), k as (select *, least(available, coalesce(cap, available)) as kept from p)
select class, available, coalesce(cast(cap as bigint), -1) as cap, kept, case when kept < available then 'capped' else 'all' end as strategy, round_even(kept / sum(kept) over (), 6) as share from k""")
def _(spark, folder):
    return sample.sampling_plan(beds.li(spark, folder), "label", CAPS).na.fill(-1, ["cap"])


@query("sampling_report", f"""with {LI}, c as (select label as class, count(*) as n from li group by 1), p as (select * from (values ('base', 5000), ('deep', 2), ('lost', 10)) as v(class, cap))
select coalesce(c.class, p.class) as class, case when n is null then 'absent' else 'too few to stratify' end as problem, least(coalesce(n, 0), coalesce(cap, n, 0)) as kept
from c full join p on c.class = p.class where n is null or least(n, coalesce(cap, n)) < 3""")
def _(spark, folder):
    return sample.sampling_report(beds.li(spark, folder), "label", {"base": 5000, "deep": 2, "lost": 10}, 3)


@query("capped_sample", f"""with {LI} select {KEYS}, label from (select *, row_number() over (partition by label order by {beds.md5('42')}, {KEYS}) as r from li)
  where r <= case label when 'base' then 5000 when 'deep' then 1000 else r end""")
def _(spark, folder):
    return sample.capped(beds.li(spark, folder), "label", KEY, CAPS, "42").select(*KEY, "label")


@query("two_pass_sample", f"""with {LI}, c as (select label, count(*) as n from li group by 1), f as (
  select li.* from li join c on li.label = c.label where {beds.h('42-rate')} / 4294967296.0 < case li.label when 'base' then 1.06 * 5000 / n when 'deep' then 1.06 * 1000 / n else 1 end)
select {KEYS}, label from (select *, row_number() over (partition by label order by {beds.md5('42')}, {KEYS}) as r from f)
  where r <= case label when 'base' then 5000 when 'deep' then 1000 else r end""")
def _(spark, folder):
    return sample.two_pass(beds.li(spark, folder), "label", KEY, CAPS, "42").select(*KEY, "label")


@query("budgeted_sample", f"""with {LI}, c as (select label, count(*) as n, row_number() over (order by count(*) desc, label) as place from li group by 1),
  f as (select *, least(n, 50, 1000 // (select count(*) from c)) as base from c), s as (select *, 1000 - sum(base) over () as over_, sum(n - base) over () as room from f),
  a as (select *, base + cast(over_ as bigint) * (n - base) // cast(room as bigint) as part from s),
  g as (select *, 1000 - sum(part) over () as short, coalesce(sum(n - part) over (order by place rows between unbounded preceding and 1 preceding), 0) as before from a),
  q as (select label, part + greatest(0, least(n - part, short - before)) as quota from g)
select {KEYS}, r.label from (select *, row_number() over (partition by label order by {beds.md5('b')}, {KEYS}) as r from li) r join q on r.label = q.label where r.r <= quota""")
def _(spark, folder):
    return sample.budgeted(beds.li(spark, folder), "label", KEY, 1000, 50, "b").select(*KEY, "label")


SPLIT = f"""sz as (select label, n, greatest(1, cast(round_even(n * 0.2, 0) as bigint)) as t, greatest(1, cast(round_even(n * 0.1, 0) as bigint)) as v from (select label, count(*) as n from src group by 1)),
splits as (select r.* exclude (r), case when r.r <= sz.t then 'test' when r.r <= sz.t + sz.v then 'val' else 'train' end as split
  from (select *, row_number() over (partition by label order by {beds.md5('7')}, {KEYS}) as r from src) r join sz on r.label = sz.label)"""


@query("stratified_split", f"with {LI}, src as (select * from li), {SPLIT} select {KEYS}, label, split from splits")
def _(spark, folder):
    return sample.split(beds.li(spark, folder), "label", KEY, 0.2, 0.1, "7").select(*KEY, "label", "split")


@query("split_distribution", f"""with {LI}, src as (select * from li), {SPLIT} select label as class, count(*) filter (split = 'train') as train, count(*) filter (split = 'val') as val,
  count(*) filter (split = 'test') as test, count(*) as total from splits group by 1""")
def _(spark, folder):
    return sample.split_distribution(sample.split(beds.li(spark, folder), "label", KEY, 0.2, 0.1, "7"), "label")


@query("split_leaks", f"""with {LI}, src as (select * from li), {SPLIT} select l_quantity, l_discount, l_tax, label, count(distinct split) as n_splits from splits group by 1, 2, 3, 4 having count(distinct split) > 1""")
def _(spark, folder):
    return sample.leaks(sample.split(beds.li(spark, folder), "label", KEY, 0.2, 0.1, "7"), ["l_quantity", "l_discount", "l_tax"], "label")


@query("stratified_folds", f"""with {LI}, r as (select *, row_number() over (partition by label order by {beds.md5('f')}, {KEYS}) as r from li)
select {KEYS}, label, cast((r - 1 + cast('0x' || substr(md5(concat_ws('|', 'fold', label)), 1, 8) as bigint) % 5) % 5 as integer) as fold from r""")
def _(spark, folder):
    return sample.folds(beds.li(spark, folder), "label", KEY, 5, "f").select(*KEY, "label", "fold")


@query("holdout", f"""with {LI}, n as (select label, least(count(*) - 1, greatest(1, cast(round_even(count(*) * 0.15, 0) as bigint))) as q from li group by 1)
select {KEYS}, r.label, r <= q as held from (select *, row_number() over (partition by label order by {beds.md5('h')}, {KEYS}) as r from li) r join n on r.label = n.label""")
def _(spark, folder):
    return sample.holdout(beds.li(spark, folder), "label", KEY, 0.15, "h").select(*KEY, "label", "held")


POISSON = " + ".join(f"case when u >= {s!r} then 1 else 0 end" for s in (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253))


@query("bootstrap", f"""with {LI}, u as (select *, cast('0x' || substr(md5(concat_ws('|', 'boot', cast(rep as varchar), {beds._KEY})), 1, 8) as bigint) / 4294967296.0 as u from li, (select unnest([0, 1]) as rep))
select rep as replicate, label, cast(sum({POISSON}) as bigint) as n from u group by 1, 2""")
def _(spark, folder):
    return sample.bootstrap(beds.li(spark, folder), KEY, "boot", 2).groupBy("replicate", "label").agg(F.count("*").alias("n"))


@query("class_representatives", f"""with {beds.CELLS}, t as (select {KEYS}, y, max(case when r = 1 then k end) as pred, max(case when k = y then p end) as own from ranked group by {KEYS}, y)
select {KEYS}, y as code from (select *, row_number() over (partition by y order by case when pred = y then 0 else 1 end, own desc, {KEYS}) as place from t) where place = 1""")
def _(spark, folder):
    return sample.representatives(beds.pr(spark, folder), "label", KEY).select(*KEY, "code")


@query("labelled_sample", f"with {LI}, src as (select * from li), {SPLIT} select {KEYS}, label from splits where split = 'test' order by {beds.md5('sample')}, {KEYS} limit 500")
def _(spark, folder):
    return tables.labelled_sample(sample.split(beds.li(spark, folder), "label", KEY, 0.2, 0.1, "7"), KEY, 500).select(*KEY, "label")
