"""Queries: streams over whole tables, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens import streaming
from flowlens.functions.portable import rounded
from flowlens.operators import models, prep, score
from flowlens.operators.normalise import encode
from flowlens.plans import beds
from flowlens.plans.beds import BENIGN, CLASSES, FEATURES, KEY, KEYS, LI
from flowlens.plans.catalog import query
from flowlens.plans.q_evaluate import CM
from flowlens.sources.stage import new_folder


def stream(spark, folder, name):
    """A table, one file or a folder of them, as a stream."""
    return streaming.read_stream(spark, f"{folder}/{name}.parquet", beds.table(spark, folder, name).schema)


def events(spark, folder):
    return stream(spark, folder, "events")


def timed(spark, folder):
    return streaming.event_time(streaming.closed(events(spark, folder), "ts"), "ts", "10 minutes")


@query("stream_tally", "select event_type as class, count(*) as n from events group by 1")
def _(spark, folder):
    return streaming.run_available(streaming.tally(events(spark, folder), "event_type"), "complete")


_clip = lambda c: f"least(greatest({c}, lo_{c}), hi_{c})"
_Z = f"""{LI}, b as (select {', '.join(f"quantile_cont({c}, {1 - 0.999!r}) as lo_{c}, quantile_cont({c}, 0.999) as hi_{c}" for c in FEATURES)} from li),
cl as (select {KEYS}, label, {', '.join(f"{_clip(c)} as {c}" for c in FEATURES)} from li, b),
st as (select {', '.join(f"avg({c}) as c_{c}, stddev_pop({c}) as d_{c}" for c in FEATURES)} from cl),
z as (select {KEYS}, label, {', '.join(f"({c} - c_{c}) / d_{c} as {c}" for c in FEATURES)} from cl, st),
cen as (select label as k, {', '.join(f"avg({c}) as m_{c}" for c in FEATURES)} from z group by 1),
di as (select {KEYS}, k, sqrt({' + '.join(f"({c} - m_{c}) * ({c} - m_{c})" for c in FEATURES)}) as d from z, cen),
w as (select *, exp(min(d) over (partition by {KEYS}) - d) as w from di),
p as (select {KEYS}, k, w / sum(w) over (partition by {KEYS}) as p from w),
v as (select {KEYS}, arg_max(k, p) as prediction, max(p) as confidence, 1 - max(p) filter (k = 'base') as attack from p group by all)"""


@query("stream_scoring", f"""with {_Z} select {KEYS}, prediction, round_even(confidence, 4) as confidence, attack >= 0.5 as is_attack,
  case when confidence < 0.6 then 'review' else 'ok' end as status from v""")
def _(spark, folder):
    """Verdicts of a stream of records, by statistics and a model fitted before it began."""
    known = beds.li(spark, folder)
    stats = prep.fit(known, FEATURES)
    model = models.fit_centroids(prep.transform(encode(known, "label", beds.codec(spark)), stats, [*KEY, "code"]), FEATURES, "code", len(CLASSES))
    ready = score.prepare(stream(spark, folder, "lineitem"), stats, KEY)
    out = score.verdicts(model.transform(ready), CLASSES, BENIGN)
    name = F.array(*(F.lit(c) for c in CLASSES))[F.col("pred")]
    return streaming.run_available(out.select(*KEY, name.alias("prediction"), rounded(F.col("confidence"), 4).alias("confidence"), "is_attack", "status"))


@query("stream_evaluation", f"with {CM} select * from cm where n > 0")
def _(spark, folder):
    """Confusion counts of micro-batches, added up."""
    state = new_folder(spark, "confusion")
    streaming.evaluate_batches(beds.pr(spark, folder, rows=stream(spark, folder, "lineitem")), state).awaitTermination()
    return streaming.confusion_so_far(spark, state)


@query("stream_sample", """select event_id, event_type from events where cast('0x' || substr(md5(concat_ws('|', 's', cast(event_id as varchar))), 1, 8) as bigint) / 4294967296.0
  < case event_type when 'view' then 0.1 when 'click' then 0.5 else 1 end""")
def _(spark, folder):
    kept = streaming.sampled(events(spark, folder), "event_type", ["event_id"], {"view": 0.1, "click": 0.5}, "s")
    return streaming.run_available(kept.select("event_id", "event_type"))


@query("stream_dedup", "select event_id, event_type from events")
def _(spark, folder):
    twice = events(spark, folder).withColumn("copy", F.explode(F.when(F.col("event_id") % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return streaming.run_available(streaming.deduplicated(twice, ["event_id"]).select("event_id", "event_type"))


@query("stream_windows", "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type as class, count(*) as n from events group by 1, 2")
def _(spark, folder):
    out = streaming.run_available(streaming.windowed(timed(spark, folder), "event_type"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "class", "n")


@query("stream_distinct_windows", "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type as class, count(*) as n from events group by 1, 2")
def _(spark, folder):
    """Events, of which every third comes twice, by hour: de-duplicated, then counted, in one query."""
    twice = streaming.closed(events(spark, folder), "ts").withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("event_id") % 3 == 0, 2).otherwise(1))))
    out = streaming.run_available(streaming.distinct_windows(twice, ["event_id"], "event_type"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "class", "n")


@query("stream_sliding_windows", """select strftime(date_trunc('hour', ts) - to_minutes(cast(30 * o as integer)) + case when minute(ts) >= 30 then interval 30 minute else interval 0 minute end, '%Y-%m-%d %H:%M') as start, event_type as class, count(*) as n
  from events, (select unnest([0, 1]) as o) group by 1, 2""")
def _(spark, folder):
    out = streaming.run_available(streaming.windowed(timed(spark, folder), "event_type", slide="30 minutes"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "class", "n")


@query("stream_sessions", """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events),
  s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, s""")
def _(spark, folder):
    out = streaming.run_available(streaming.sessions(timed(spark, folder), "user_id"))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
