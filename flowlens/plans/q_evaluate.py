"""Queries: evaluation metrics over pseudo-probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.portable import rounded
from flowlens.operators import evaluate as ev
from flowlens.operators.narrate import calibration_verdict
from flowlens.plans import beds
from flowlens.plans.beds import CELLS, KEYS, LI, pr_sql
from flowlens.plans.catalog import query

PRED = f"{CELLS}, pred as (select {KEYS}, y, max(case when r = 1 then k end) as pred, max(case when r = 1 then p end) as conf, max(case when k = y then p end) as own, max(case when k = y then r end) as place from ranked group by {KEYS}, y)"
CM = f"{PRED}, k as (select unnest([0, 1, 2, 3]) as k), cm as (select a.k as code, b.k as pred, count(p.y) as n from k a cross join k b left join pred p on p.y = a.k and p.pred = b.k group by 1, 2)"
CLASSES = f"""{CM}, cls as (select r.code, support, predicted, tp, predicted - tp as fp, support - tp as fn, coalesce(tp / nullif(predicted, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall, coalesce(2 * tp / nullif(predicted + support, 0), 0) as f1
  from (select code, cast(sum(n) as bigint) as support, cast(sum(case when code = pred then n else 0 end) as bigint) as tp from cm group by 1) r join (select pred as code, cast(sum(n) as bigint) as predicted from cm group by 1) c on r.code = c.code)"""


def cm(spark, folder):
    return ev.confusion(beds.pr(spark, folder), beds.codec(spark))


def classes(spark, folder):
    return ev.per_class(cm(spark, folder))


@query("confusion_matrix", f"with {CM} select * from cm")
def _(spark, folder):
    return cm(spark, folder)


@query("confusion_shares", f"with {CM} select code, pred, n, round_even(n / sum(n) over (partition by code), 6) as share from cm")
def _(spark, folder):
    return ev.normalised(cm(spark, folder))


@query("class_metrics", f"with {CLASSES} select code, support, predicted, tp, fp, fn, round_even(precision, 6) as precision, round_even(recall, 6) as recall, round_even(f1, 6) as f1 from cls")
def _(spark, folder):
    return classes(spark, folder).withColumns({c: rounded(F.col(c)) for c in ("precision", "recall", "f1")})


@query("average_metrics", f"with {CLASSES} select round_even(sum(tp) / sum(support), 6) as accuracy, round_even(avg(recall), 6) as balanced_accuracy, " + ", ".join(
    f"round_even(avg({c}), 6) as macro_{c}, round_even(sum({c} * support) / sum(support), 6) as weighted_{c}" for c in ("precision", "recall", "f1")) + " from cls where support > 0")
def _(spark, folder):
    return ev.averages(classes(spark, folder))


@query("most_confused", f"with {CM} select code, pred as confused_with, n from (select *, row_number() over (partition by code order by n desc, pred) as r from cm where code != pred and n > 0) where r = 1")
def _(spark, folder):
    return ev.most_confused(cm(spark, folder))


@query("absent_classes", f"with {LI}, a as (select distinct list_position(['base', 'deep', 'big', 'rare', 'lost'], label) - 1 as k from li where label != 'rare') select cast(k as integer) as code, 'absent' as problem from (select unnest([3, 4]) as k) where k not in (select k from a)")
def _(spark, folder):
    from flowlens.sources import dims

    wide = dims.class_table(spark, [*beds.CLASSES, "lost"])
    return ev.absent(ev.per_class(ev.confusion(beds.pr(spark, folder).where("label != 'rare'"), wide)))


@query("top_k_accuracy", f"with {PRED} select cast(k as integer) as k, round_even(avg(case when place <= k then 1.0 else 0.0 end), 6) as accuracy from pred, (select unnest([1, 2, 3]) as k) group by 1")
def _(spark, folder):
    return ev.top_k_accuracy(beds.pr(spark, folder))


@query("log_loss", f"with {PRED} select round_even(avg(-ln(greatest(own, 1e-15))), 6) as log_loss from pred")
def _(spark, folder):
    return ev.log_loss(beds.pr(spark, folder))


@query("agreement_scores", f"""with {CM}, t as (select code, cast(sum(n) as double) as t, cast(sum(case when code = pred then n else 0 end) as double) as c from cm group by 1), p as (select pred as code, cast(sum(n) as double) as p from cm group by 1),
  s as (select sum(t) as s, sum(c) as c, sum(t * p) as tp, sum(t * t) as tt, sum(p * p) as pp from t join p on t.code = p.code)
select round_even((c * s - tp) / sqrt((s * s - pp) * (s * s - tt)), 6) as mcc, round_even((c / s - tp / (s * s)) / (1 - tp / (s * s)), 6) as kappa from s""")
def _(spark, folder):
    return ev.agreement(cm(spark, folder))


CAL = f"{PRED}, bins as (select greatest(cast(ceil(conf * 10) as integer) - 1, 0) as bin, count(*) as n, avg(conf) as confidence, avg(case when pred = y then 1.0 else 0.0 end) as accuracy from pred group by 1)"


@query("calibration_bins", f"with {CAL} select bin, n, round_even(confidence, 6) as confidence, round_even(accuracy, 6) as accuracy from bins")
def _(spark, folder):
    return ev.calibration(beds.pr(spark, folder)).withColumns({c: rounded(F.col(c)) for c in ("confidence", "accuracy")})


@query("calibration_error", f"with {CAL}, e as (select round_even(sum(abs(confidence - accuracy) * n) / sum(n), 6) as ece from bins) select ece, case when ece < 0.05 then 'well calibrated' when ece < 0.15 then 'somewhat overconfident' else 'poorly calibrated' end as verdict from e")
def _(spark, folder):
    return ev.calibration_error(ev.calibration(beds.pr(spark, folder))).withColumn("verdict", calibration_verdict(F.col("ece")))


OVR = f"{CELLS}, sc as (select k as class_code, p as score, count(*) filter (y = k) as pos, count(*) filter (y != k) as neg from cells group by 1, 2)"
CURVE = """cu as (select *, sum(pos) over w as cp, sum(neg) over w as cn, sum(pos) over (partition by class_code) as tp, sum(neg) over (partition by class_code) as tn from sc window w as (partition by class_code order by score desc)),
ar as (select class_code, sum(pos * (tn - cn + neg / 2)) / (max(tp) * max(tn)) as auc, sum(pos * cp / (cp + cn)) / max(tp) as ap from cu group by 1)"""


@query("one_vs_rest_areas", f"with {OVR}, {CURVE} select cast(class_code as integer) as class_code, round_even(auc, 6) as auc, round_even(ap, 6) as ap from ar")
def _(spark, folder):
    return ev.one_vs_rest(beds.pr(spark, folder))


@query("macro_areas", f"with {OVR}, {CURVE} select round_even(avg(round_even(auc, 6)), 6) as macro_auc, round_even(avg(round_even(ap, 6)), 6) as macro_ap from ar")
def _(spark, folder):
    return ev.macro_areas(ev.one_vs_rest(beds.pr(spark, folder)))


LB = "sc as (select 0 as class_code, (n_chars % 101) / 100.0 as score, count(*) filter (quality = 1) as pos, count(*) filter (quality = 0) as neg from labels join documents using (doc_id) group by 2)"


def lb(spark, folder):
    rows = beds.table(spark, folder, "labels").join(beds.table(spark, folder, "documents"), "doc_id")
    return rows.select((F.col("quality") == 1).alias("hit"), (F.col("n_chars") % 101 / 100.0).alias("score"))


@query("areas_with_ties", f"with {LB}, {CURVE} select round_even(auc, 6) as auc, round_even(ap, 6) as ap from ar")
def _(spark, folder):
    return ev.areas(ev.cumulated(ev.score_table(lb(spark, folder), [], "score", "hit"), [], "score"), [])


BIN = f"{PRED}, b as (select t.y != 0 as hit, 1 - p0 as score, t.pred != 0 as said from pred t join pr using ({KEYS})), sc as (select 0 as class_code, score, count(*) filter (hit) as pos, count(*) filter (not hit) as neg from b group by 2)"


@query("binary_metrics", f"""with {BIN}, {CURVE}, n as (select count(*) filter (hit and said) as tp, count(*) filter (not hit and said) as fp, count(*) filter (hit and not said) as fn, count(*) filter (not hit and not said) as tn from b)
select tp, fp, fn, tn, round_even((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round_even(tp / (tp + fp), 6) as precision, round_even(tp / (tp + fn), 6) as recall, round_even(2 * tp / (2 * tp + fp + fn), 6) as f1,
  round_even(fp / (fp + tn), 6) as false_alarm, round_even(fn / (tp + fn), 6) as miss, round_even(auc, 6) as auc, round_even(ap, 6) as ap from n, ar""")
def _(spark, folder):
    return ev.binary(beds.pr(spark, folder), 0)


POINTS = f"{BIN}, {CURVE}, pts as (select score as threshold, cp / tp as tpr, cn / tn as fpr, cp / (cp + cn) as precision, 2 * cp / (cp + cn + tp) as f1 from cu)"


def points(spark, folder, most=None):
    rows = ev.binary_rows(beds.pr(spark, folder), 0)
    return ev.sweep(ev.cumulated(ev.score_table(rows, [], "score", "hit"), [], "score"), most=most)


_P = ["threshold", "tpr", "fpr", "precision", "f1"]
_R = ", ".join(f"round_even({c}, 6) as {c}" for c in _P)


@query("threshold_sweep", f"""with {POINTS}, n as (select *, row_number() over (order by threshold desc) - 1 as i, count(*) over () as m from pts)
select {_R} from n where m <= 512 or i = 0 or i = m - 1 or floor(i * 511 / (m - 1)) != floor((i - 1) * 511 / (m - 1))""")
def _(spark, folder):
    return points(spark, folder, 512).select(*(rounded(F.col(c)).alias(c) for c in _P))


@query("recommended_thresholds", f"with {POINTS} " + " union all ".join(
    f"select * from (select '{rule}' as rule, {_R} from pts where {ok} order by round({gain}, 12) desc, pts.threshold desc limit 1)" for rule, gain, ok in (("best_f1", "pts.f1", "true"), ("youden", "pts.tpr - pts.fpr", "true"), ("fpr_budget", "pts.tpr", "pts.fpr <= 0.01"))))
def _(spark, folder):
    return ev.recommended(points(spark, folder))


@query("operating_point", f"with {POINTS} select {_R} from pts where threshold <= 0.5 order by pts.threshold desc limit 1")
def _(spark, folder):
    return ev.operating_point(points(spark, folder), 0.5)


@query("worst_classes", f"with {CLASSES} select code, support, round_even(recall, 6) as recall from cls where support > 0 order by cls.recall, support, code limit 3")
def _(spark, folder):
    return ev.worst(classes(spark, folder)).select("code", "support", rounded(F.col("recall")).alias("recall"))


@query("unknown_labels", f"with {LI} select count(*) filter (label = 'rare') as unknown, count(*) as rows from li")
def _(spark, folder):
    return ev.unknown_count(beds.pr(spark, folder).withColumn("code", F.when(F.col("label") != "rare", F.col("code"))))


TWO = f"{LI}, {pr_sql()}, {pr_sql('q', 'c', 'qr')}"
_ACC = "avg(case when code = list_position([p0, p1, p2, p3], greatest(p0, p1, p2, p3)) - 1 then 1.0 else 0.0 end)"


def two_models(spark, folder):
    tables = [ev.averages(ev.per_class(ev.confusion(beds.pr(spark, folder, *s), beds.codec(spark)))).select(F.lit(m).alias("model"), "accuracy") for m, s in (("one", ("p", "b")), ("two", ("q", "c")))]
    return tables[0].unionByName(tables[1])


@query("compare_models", f"with {TWO}, a as (select 'one' as model, round_even({_ACC}, 6) as accuracy from pr union all select 'two', round_even({_ACC}, 6) from qr) select *, cast(rank() over (order by accuracy desc) as integer) as rank from a")
def _(spark, folder):
    return ev.compare(two_models(spark, folder), "accuracy", ["model"])


@query("leaderboard", f"with {TWO}, a as (select 'one' as model, round_even({_ACC}, 6) as accuracy from pr union all select 'two', round_even({_ACC}, 6) from qr), r as (select *, cast(row_number() over (order by accuracy desc, model) as integer) as rank from a) select *, rank = 1 as winner, case when rank = 1 then accuracy else -1 end as test_accuracy from r")
def _(spark, folder):
    both = two_models(spark, folder)
    return ev.leaderboard(both, both.withColumnRenamed("accuracy", "test_accuracy"), "accuracy").na.fill(-1.0, ["test_accuracy"])


_AVERAGES = ["accuracy", "balanced_accuracy", *(f"{a}_{c}" for c in ("precision", "recall", "f1") for a in ("macro", "weighted"))]


_STORED = CLASSES.replace("pred as (select", "pred as materialized (select").replace("cm as (select", "cm as materialized (select").replace("cls as (select", "cls as materialized (select")


@query("evaluation_report", f"""with {_STORED}, {CAL.removeprefix(PRED + ', ')}, {OVR.removeprefix(CELLS + ', ')}, {CURVE},
av as materialized (select sum(tp) / sum(support) as accuracy, avg(recall) as balanced_accuracy, {", ".join(f"avg({c}) as macro_{c}, sum({c} * support) / sum(support) as weighted_{c}" for c in ("precision", "recall", "f1"))} from cls where support > 0),
ts as (select code, cast(sum(n) as double) as t, cast(sum(case when code = pred then n else 0 end) as double) as c from cm group by 1), ps as (select pred as code, cast(sum(n) as double) as p from cm group by 1),
ag as (select sum(t) as s, sum(c) as c, sum(t * p) as tp, sum(t * t) as tt, sum(p * p) as pp from ts join ps on ts.code = ps.code),
rep as (""" + " union all ".join([
    *(f"select '{c}' as metric, {c} as value from av" for c in _AVERAGES),
    *(f"select 'top_{k}', avg(case when place <= {k} then 1.0 else 0.0 end) from pred" for k in (1, 2, 3)),
    "select 'log_loss', avg(-ln(greatest(own, 1e-15))) from pred",
    "select 'mcc', (c * s - tp) / sqrt((s * s - pp) * (s * s - tt)) from ag", "select 'kappa', (c / s - tp / (s * s)) / (1 - tp / (s * s)) from ag",
    "select 'ece', sum(abs(confidence - accuracy) * n) / sum(n) from bins", "select 'unknown', 0", "select 'rows', count(*) from pred",
    "select 'macro_auc', avg(round_even(auc, 6)) from ar", "select 'macro_ap', avg(round_even(ap, 6)) from ar",
]) + ") select metric, round_even(cast(value as double), 6) as value from rep")
def _(spark, folder):
    """The report over probabilities that do not sum to 1: they count as shares."""
    return ev.summary(ev.evaluate(beds.pr(spark, folder, shares=False), beds.codec(spark), 0))
