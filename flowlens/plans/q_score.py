"""Queries: scoring, verdicts, summaries, words."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.portable import apart, rounded
from flowlens.operators import narrate, prep, score, summary
from flowlens.plans import beds
from flowlens.plans.beds import CELLS, CLASSES, FEATURES, KEY, KEYS, LI, LID, PR, VERDICTS
from flowlens.plans.catalog import query
from flowlens.plans.q_prep import BOUNDS, FIN, FITTED, Q, moments


def verdicts(spark, folder, threshold: float = 0.5, top: int = 0, keep=()):
    rows = apart(beds.pr(spark, folder, keep=keep)).withColumn("proba", score.checked_proba(F.col("proba")))
    scored = score.verdicts(rows, CLASSES, beds.BENIGN, threshold=threshold)
    return score.verdict_table(apart(scored), beds.codec(spark), beds.profiles(spark), [*KEY, *keep], beds.BENIGN, top)


@query("verdict_table", f"with {VERDICTS} select * exclude (y) from verdicts")
def _(spark, folder):
    return verdicts(spark, folder)


@query("verdict_alternatives", f"""with {CELLS} select {KEYS}, max(case when r = 2 then ['base', 'deep', 'big', 'rare'][k + 1] end) as alt1, round_even(max(case when r = 2 then p end), 6) as alt1_confidence,
  max(case when r = 3 then ['base', 'deep', 'big', 'rare'][k + 1] end) as alt2, round_even(max(case when r = 3 then p end), 6) as alt2_confidence from ranked group by {KEYS}""")
def _(spark, folder):
    return verdicts(spark, folder, top=3).select(*KEY, "alt1", "alt1_confidence", "alt2", "alt2_confidence")


@query("threshold_counts", f"with {PR} select cast(t as double) as threshold, count(*) filter (1 - p0 >= t) as attacks from pr, (select unnest([0.3, 0.5, 0.7, 0.9]) as t) group by 1")
def _(spark, folder):
    attack = beds.pr(spark, folder).select((1 - F.col("proba")[0]).alias("a"))
    steps = F.explode(F.array(*(F.lit(t) for t in (0.3, 0.5, 0.7, 0.9))))
    return attack.select("a", steps.alias("threshold")).groupBy("threshold").agg(F.count_if(F.col("a") >= F.col("threshold")).alias("attacks"))


@query("prepare_scoring", f"with {FITTED}, {moments('standard')} select label, count(*) as n, round_even(avg((l_quantity - c_l_quantity) / d_l_quantity), 4) as l_quantity, round_even(avg((raw_l_tax - c_l_tax) / d_l_tax), 6) as l_tax from fill, s, b group by label")
def _(spark, folder):
    df = beds.lid(spark, folder)
    stats = prep.fit(df, FEATURES, Q)
    messy = df.select("label", F.col("l_extendedprice").cast("string").alias("l_extendedprice "), F.col("l_quantity").cast("string").alias(" l_quantity"), F.lit("x").alias("note"), F.col("l_discount").cast("string").alias("l_discount"))
    out = score.prepare(messy, stats, ["label"])
    return out.groupBy("label").agg(F.count("*").alias("n"), rounded(F.avg("l_quantity"), 4).alias("l_quantity"), rounded(F.avg("l_tax")).alias("l_tax"))


@query("repair_report", f"""with {LID} select 'missing' as kind, 'l_tax' as "column", cast(1 as bigint) as n union all select 'extra', 'note', 1
union all select 'unknown_label', 'label', count(*) filter (label = 'rare') from lid """ + "".join(
    f"union all select 'coerced', '{c}', count(*) filter (isnan({c})) from lid union all select 'nonfinite', '{c}', count(*) filter (isinf({c})) from lid " for c in FEATURES[:3]))
def _(spark, folder):
    df = beds.lid(spark, folder)
    stats = prep.fit(df, FEATURES, Q)
    messy = df.select("label", F.lit("x").alias("note"), *(F.col(c).cast("string").alias(c) for c in FEATURES[:3]))
    return score.repairs(messy, stats, "label", ["base", "deep", "big"])


@query("what_if", f"with {FIN}, {BOUNDS} select l_orderkey as id, round_even(cast(l_orderkey as double), 6) as l_quantity, round_even(raw_l_extendedprice, 6) as l_extendedprice, round_even(raw_l_discount, 6) as l_discount, round_even(raw_l_tax, 6) as l_tax from (select distinct l_orderkey from li), b")
def _(spark, folder):
    df = beds.lid(spark, folder)
    stats = prep.fit(df, FEATURES, Q)
    given = beds.li(spark, folder).select(F.col("l_orderkey").alias("id")).distinct().withColumn("values", F.create_map(F.lit("l_quantity"), F.col("id").cast("double")))
    return score.what_if(given, stats, ["id"]).select("id", *(rounded(F.col(c)).alias(c) for c in FEATURES))


@query("review_queue", f"with {VERDICTS} select {KEYS}, severity, attack_probability from verdicts where is_attack and status = 'review' order by severity desc, attack_probability desc, {KEYS} limit 100")
def _(spark, folder):
    return score.queue(verdicts(spark, folder), True, True, 100, KEY).select(*KEY, "severity", "attack_probability")


@query("predicted_counts", f"with {VERDICTS} select class, code, count(prediction) as n from names left join verdicts on class = prediction group by 1, 2")
def _(spark, folder):
    return summary.class_totals(verdicts(spark, folder), beds.codec(spark))


OVERVIEW = f"""{VERDICTS}, o as (select count(*) as rows, count(*) filter (is_attack) as attacks_by_threshold, count(*) filter (prediction != 'base') as attacks_by_label,
  round_even(avg(confidence), 6) as mean_confidence, round_even(quantile_cont(confidence, 0.5), 6) as median_confidence, count(*) filter (status = 'review') as needs_review,
  count(distinct prediction) as classes, count(*) filter (severity >= 5) as critical from verdicts)"""


@query("verdict_overview", f"with {OVERVIEW} select *, attacks_by_threshold - attacks_by_label as gap, round_even(attacks_by_threshold / rows, 6) as threshold_share, round_even(attacks_by_label / rows, 6) as label_share from o")
def _(spark, folder):
    return summary.overview(verdicts(spark, folder), beds.BENIGN)


@query("reconciliation", f"with {OVERVIEW} select attacks_by_threshold, attacks_by_label, attacks_by_threshold - attacks_by_label as gap, case when attacks_by_threshold > attacks_by_label then 'raise' when attacks_by_threshold < attacks_by_label then 'lower' else 'none' end as hint from o")
def _(spark, folder):
    return summary.reconciliation(verdicts(spark, folder), beds.BENIGN)


@query("triage", f"""with {VERDICTS}, g as (select prediction as class, max(severity) as severity, count(*) as n, round_even(avg(confidence), 6) as mean_confidence, count(*) filter (status = 'review') as needs_review from verdicts where prediction != 'base' group by 1)
select cast(row_number() over (order by severity desc, n desc, class) as integer) as priority, *, case class when 'deep' then 'Check the discount.' when 'big' then 'Check the stock.' else 'Investigate manually.' end as action from g""")
def _(spark, folder):
    return summary.triage(verdicts(spark, folder), beds.profiles(spark).where("class != 'rare'"), beds.BENIGN)


@query("class_distribution", f"with {VERDICTS}, g as (select prediction as class, count(*) as n, round_even(avg(confidence), 6) as mean_confidence, max(severity) as severity from verdicts group by 1) select *, round_even(n / sum(n) over (), 6) as share from g")
def _(spark, folder):
    return summary.distribution(verdicts(spark, folder))


@query("confidence_histogram", f"""with {VERDICTS}, g as (select unnest(range(0, 20)) as bin), f as (select unnest([true, false]) as is_attack)
select cast(g.bin as integer) as bin, f.is_attack, count(v.confidence) as n from g cross join f left join verdicts v on least(cast(floor(v.confidence * 20) as bigint), 19) = g.bin and v.is_attack = f.is_attack group by 1, 2""")
def _(spark, folder):
    return summary.confidence_histogram(verdicts(spark, folder))


@query("majority_accuracy", f"with {LI}, c as (select label as class, count(*) as n from li group by 1) select class, round_even(n / (select sum(n) from c), 6) as accuracy from c order by n desc, class limit 1")
def _(spark, folder):
    return summary.majority_accuracy(beds.li(spark, folder), "label")


@query("ambiguous_verdicts", f"""with {VERDICTS}, a as (select *, runner_up_confidence > 0.15 and confidence - runner_up_confidence < 0.25 as ambiguous from verdicts)
select prediction, ambiguous, ambiguous and (prediction = 'deep' and runner_up = 'base' or prediction = 'big' and runner_up in ('rare', 'deep') or prediction = 'rare' and runner_up = 'base') as known_confusable, count(*) as n from a group by 1, 2, 3""")
def _(spark, folder):
    out = narrate.ambiguity(verdicts(spark, folder), beds.profiles(spark))
    return out.groupBy("prediction", "ambiguous", "known_confusable").agg(F.count("*").alias("n"))


@query("profile_lookup", f"""with {VERDICTS} select prediction, case prediction when 'base' then 'Normal' when 'deep' then 'Discount' when 'big' then 'Volume' else 'Unknown' end as family,
  case prediction when 'base' then 'informational' when 'deep' then 'low' when 'big' then 'high' else 'medium' end as severity_word, case prediction when 'base' then '-' when 'deep' then 'Price' when 'big' then 'Stock' else '' end as tactic,
  case prediction when 'base' then 'Nothing to do.' when 'deep' then 'Check the discount.' when 'big' then 'Check the stock.' else 'Investigate manually.' end as action, count(*) as n from verdicts group by 1, 2, 3, 4, 5""")
def _(spark, folder):
    out = narrate.with_profiles(verdicts(spark, folder), beds.profiles(spark).where("class != 'rare'"))
    return out.groupBy("prediction", "family", "severity_word", "tactic", "action").agg(F.count("*").alias("n"))


@query("phrase_bands", f"""with {VERDICTS} select case when confidence >= 0.99 then 'almost certainly' when confidence >= 0.9 then 'very likely' when confidence >= 0.7 then 'likely' when confidence >= 0.5 then 'probably' when confidence >= 0.3 then 'possibly' else 'weakly suggestive of' end as phrase,
  case when (confidence - 0.5) * 8 >= 2 then 'far above normal' when (confidence - 0.5) * 8 >= 0.75 then 'above normal' when (confidence - 0.5) * 8 <= -2 then 'far below normal' when (confidence - 0.5) * 8 <= -0.75 then 'below normal' else 'close to normal' end as level, count(*) as n from verdicts group by 1, 2""")
def _(spark, folder):
    out = verdicts(spark, folder)
    return out.groupBy(narrate.confidence_phrase(F.col("confidence")).alias("phrase"), narrate.level((F.col("confidence") - 0.5) * 8).alias("level")).agg(F.count("*").alias("n"))


@query("class_reference", f"""with {VERDICTS}, r as (select true_class as class, round_even(avg(case when correct then 1.0 else 0 end), 6) as recall from verdicts group by 1)
select class, severity, recall from names join r using (class)""")
def _(spark, folder):
    recall = verdicts(spark, folder).groupBy(F.col("true_class").alias("class")).agg(rounded(F.avg(F.col("correct").cast("double"))).alias("recall"))
    return summary.class_reference(beds.profiles(spark), recall).select("class", F.when(F.col("class") == "base", 0).otherwise(F.col("severity")).alias("severity"), "recall")
