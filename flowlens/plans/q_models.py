"""Queries: classifiers, search, the end-to-end run."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.local import local_table
from flowlens.functions.portable import rounded
from flowlens.operators import clean, evaluate, models, prep, trees, tune
from flowlens.operators.normalise import encode
from flowlens.operators.sample import budgeted, split
from flowlens.plans import beds
from flowlens.plans.beds import FEATURES, KEY, KEYS
from flowlens.plans.catalog import query
from flowlens.plans.q_data import CLEAN, SPLIT
from flowlens.sources.stage import stored

#: The run in SQL: clean, split, fit on the training rows, score the test rows by nearest centroid.
_TRAIN = "tr as (select * from splits where split = 'train')"
_B = "b as (select " + ", ".join(f"quantile_cont({c}, {1 - 0.999!r}) as lo_{c}, quantile_cont({c}, 0.999) as hi_{c} from tr" if i == len(FEATURES) - 1 else f"quantile_cont({c}, {1 - 0.999!r}) as lo_{c}, quantile_cont({c}, 0.999) as hi_{c}" for i, c in enumerate(FEATURES)) + ")"
_clip = lambda c: f"case when {c} is null then null else least(greatest({c}, lo_{c}), hi_{c}) end"
RUN = f"""{CLEAN}, src as (select * from cleaned), {SPLIT}, {_TRAIN}, {_B},
cl as (select {KEYS}, label, split, {', '.join(f'{_clip(c)} as {c}' for c in FEATURES)} from splits, b),
md as (select {', '.join(f'quantile_cont({c}, 0.5) as md_{c}' for c in FEATURES)} from cl where split = 'train'),
fl as (select {KEYS}, label, split, {', '.join(f'coalesce({c}, md_{c}) as {c}' for c in FEATURES)} from cl, md),
st as (select {', '.join(f'avg({c}) as c_{c}, stddev_pop({c}) as d_{c}' for c in FEATURES)} from fl where split = 'train'),
z as (select {KEYS}, list_position(['base', 'deep', 'big', 'rare'], label) - 1 as y, split, {', '.join(f'({c} - c_{c}) / d_{c} as {c}' for c in FEATURES)} from fl, st),
cen as (select y as k, {', '.join(f'avg({c}) as m_{c}' for c in FEATURES)} from z where split = 'train' group by 1),
di as (select {KEYS}, y, k, sqrt({' + '.join(f'({c} - m_{c}) * ({c} - m_{c})' for c in FEATURES)}) as d from z, cen where split = 'test'),
said as (select y, k from (select *, row_number() over (partition by {KEYS} order by d, k) as r from di) where r = 1),
cls as (select a.k as code, count(*) filter (y = a.k) as support, count(*) filter (s.k = a.k) as predicted, count(*) filter (y = a.k and s.k = a.k) as tp from (select unnest([0, 1, 2, 3]) as k) a, said s group by 1)"""


def held_out(spark, folder, fit):
    """Test rows of the cleaned table, scored by fit(training rows)."""
    rows = stored(clean.clean(beds.lid(spark, folder), FEATURES, "label", KEY), "cleaned")
    parts = stored(encode(split(rows, "label", KEY, 0.2, 0.1, "7"), "label", beds.codec(spark)), "parts")  # read by every fit
    train = parts.where("split = 'train'")
    stats = prep.fit(train, FEATURES)
    ready = prep.transform(parts, stats, [*KEY, "label", "code", "split"])
    return fit(ready.where("split = 'train'")).transform(ready.where("split = 'test'"))


@query("holdout_metrics", f"with {RUN} select code, support, predicted, round_even(coalesce(tp / nullif(predicted, 0), 0), 6) as precision, round_even(coalesce(tp / nullif(support, 0), 0), 6) as recall from cls")
def flagship(spark, folder):
    """Per-class precision and recall of a classifier on held-out rows."""
    scored = held_out(spark, folder, lambda d: models.fit_centroids(d, FEATURES, "code", 4))
    out = evaluate.per_class(evaluate.confusion(scored, beds.codec(spark)))
    return out.select("code", "support", "predicted", rounded(F.col("precision")).alias("precision"), rounded(F.col("recall")).alias("recall"))


@query("centroid_vectors", """with c as (select e.label, i, avg(cast(x as double)) as m from (select label, unnest(embedding) as x, unnest(range(1, 65)) as i from embeddings) e group by 1, 2),
  v as (select vec_id, label, unnest(embedding) as x, unnest(range(1, 65)) as i from embeddings), d as (select vec_id, v.label, c.label as k, sqrt(sum((x - m) * (x - m))) as d from v join c on v.i = c.i group by 1, 2, 3)
select vec_id, cast(label as integer) as label, cast(k as integer) as pred from (select *, row_number() over (partition by vec_id order by d, k) as r from d) where r = 1""")
def _(spark, folder):
    df = beds.em(spark, folder).withColumn("code", F.col("label"))
    model = models.fit_centroids(df, beds.EM_FEATURES, "code", 10)
    return model.transform(df).select("vec_id", "label", evaluate.predicted().alias("pred"))


@query("expanded_probabilities", f"with {beds.PR} select {KEYS}, 0 as p_lost, round_even(p0, 6) as p_base, round_even(p2, 6) as p_big from pr")
def _(spark, folder):
    """Probabilities over the classes of a fit, as those of all classes."""
    few = beds.pr(spark, folder).withColumn("few", F.array(F.col("proba")[0], F.col("proba")[2]))
    out = few.select(*KEY, models.expanded(F.col("few"), [1, 3], 4).alias("p"))
    return out.select(*KEY, F.col("p")[0].cast("int").alias("p_lost"), rounded(F.col("p")[1]).alias("p_base"), rounded(F.col("p")[3]).alias("p_big"))


#: Gaussian naive Bayes on the training rows of the run: a prior, mean and variance a class, variances raised by 1e-9
#: of the largest over all rows; then counts by class on the test rows.
_SUMS = ", ".join(f"avg({c}) as m_{c}, avg({c} * {c}) - avg({c}) * avg({c}) as v_{c}" for c in FEATURES)
BAYES = f"""{RUN.split("cen as (")[0]} ep as (select 1e-9 * greatest({', '.join(f'avg({c} * {c}) - avg({c}) * avg({c})' for c in FEATURES)}) as e from z where split = 'train'),
nb as (select y as k, ln(count(*)) as prior, {_SUMS} from z where split = 'train' group by y),
lik as (select {KEYS}, y, k, prior - 0.5 * ({' + '.join(f'ln(v_{c} + e) + ({c} - m_{c}) * ({c} - m_{c}) / (v_{c} + e)' for c in FEATURES)}) as s from z, nb, ep where split = 'test'),
said as (select y, k from (select *, row_number() over (partition by {KEYS} order by s desc, k) as r from lik) where r = 1),
cls as (select a.k as code, count(*) filter (y = a.k) as support, count(*) filter (s.k = a.k) as predicted, count(*) filter (y = a.k and s.k = a.k) as tp from (select unnest([0, 1, 2, 3]) as k) a, said s group by 1)"""

BAYES_SQL = f"""with {BAYES} select cast(code as integer) as code, support, predicted, tp, predicted - tp as fp, support - tp as fn, round_even(coalesce(tp / nullif(predicted, 0), 0), 6) as precision,
  round_even(coalesce(tp / nullif(support, 0), 0), 6) as recall, round_even(coalesce(2 * tp / nullif(predicted + support, 0), 0), 6) as f1 from cls"""


def _register(kind: str, params: dict) -> None:
    @query(f"model_{kind}", BAYES_SQL if kind == "bayes" else None)
    def _(spark, folder):
        scored = held_out(spark, folder, lambda d: models.fit(kind, d, FEATURES, "code", 4, **params))
        out = evaluate.per_class(evaluate.confusion(scored, beds.codec(spark)))
        return out.withColumns({c: rounded(F.col(c)) for c in ("precision", "recall", "f1")})


for _kind, _params in {
    "logistic": {"maxIter": 20}, "bayes": {}, "tree": {"maxDepth": 8}, "forest": {"numTrees": 20, "maxDepth": 8}, "extra": {"numTrees": 20, "maxDepth": 8},
    "mlp": {"hidden": [16], "maxIter": 30}, "boosted": {"maxIter": 5, "maxDepth": 3},
}.items():
    _register(_kind, _params)


def _extra_level(p: int) -> str:
    """Cuts of level p of a tree, drawn by hashes, from boxes node{p} and rows at{p}."""
    return f"""draw{p} as (select *, lo + cast(cast('0x' || substr(md5('extra|0|' || path || '|' || f || '|cut'), 1, 8) as bigint) as double) / cast(4294967296 as double) * (hi - lo) as cut
  from (select *, row_number() over (partition by path order by md5('extra|0|' || path || '|' || f)) - 1 as j from node{p} where lo < hi) where j < 2),
cell{p} as (select d.path, d.j, d.f, d.cut, y, count(*) filter (v <= cut) as a, count(*) filter (v > cut) as b from at{p} x join draw{p} d on x.path = d.path and x.f = d.f group by all),
sum{p} as (select path, j, f, cut, sum(a) as a, sum(b) as b, coalesce(sum(a * a) / nullif(sum(a), 0), 0) + coalesce(sum(b * b) / nullif(sum(b), 0), 0) - sum((a + b) * (a + b)) / sum(a + b) as g from cell{p} group by all),
best{p} as materialized (select * from (select *, row_number() over (partition by path order by a > 0 and b > 0 desc, round(g / (a + b), 9) desc, j) as r from sum{p}) where r = 1 and a > 0 and b > 0),
node{p + 1} as (select n.path * 2 + s as path, n.f, case when n.f = b.f and s = 1 then cut else lo end as lo, case when n.f = b.f and s = 0 then cut else hi end as hi from best{p} b join node{p} n on n.path = b.path, (select unnest([0, 1]) as s)),
side{p} as (select x.i, x.path * 2 + cast(v > cut as int) as path from at{p} x join best{p} b on x.path = b.path and x.f = b.f),
at{p + 1} as materialized (select x.i, s.path, y, f, v from at{p} x join side{p} s on x.i = s.i)"""


_LONG = f"""{beds.LI}, num as (select *, list_position(['base', 'deep', 'big', 'rare'], label) - 1 as y, row_number() over () as i from li),
at0 as materialized ({" union all ".join(f"select i, 1 as path, y, '{c}' as f, cast({c} as double) as v from num" for c in FEATURES)})"""


@query("extra_tree", f"""with {_LONG}, node0 as (select 1 as path, f, min(v) as lo, max(v) as hi from at0 group by f), {_extra_level(0)}, {_extra_level(1)}
select cast(path as integer) as path, f as feature, round_even(cut, 6) as cut, cast(a as double) as n_left, cast(b as double) as n_right from (select * from best0 union all select * from best1)""")
def _(spark, folder):
    """The nodes of an extremely randomised tree of depth two over all rows."""
    rows = encode(beds.li(spark, folder), "label", beds.codec(spark))
    tree = trees.extra_trees(rows, FEATURES, "code", 4, trees=1, depth=2, tries=2).trees[0]
    out, waiting = [], [(0, 1)]
    while waiting:
        at, path = waiting.pop()
        if tree.feature[at] >= 0:
            left = tree.left[at]
            out.append((path, FEATURES[tree.feature[at]], tree.cut[at], tree.cover[left], tree.cover[left + 1]))
            waiting += [(left, 2 * path), (left + 1, 2 * path + 1)]
    return local_table(spark, out, "path int, feature string, cut double, n_left double, n_right double").withColumn("cut", rounded(F.col("cut")))


@query("boosted_round", f"""with {_LONG}, cut as (select distinct f, unnest([{", ".join(f"quantile_cont(v, {b / 8!r})" for b in range(1, 8))}]) as cut from at0 group by f),
g as (select i, f, v, c, 0.25 - cast(y = c as int) as g, 0.1875 as h from at0, (select unnest([0, 1, 2, 3]) as c)),
t as (select c, f, cast(sum(g) as double) as g, cast(sum(h) as double) as h from g group by 1, 2),
l as (select c, g.f, cut, cast(sum(g) filter (v <= cut) as double) as gl, cast(sum(h) filter (v <= cut) as double) as hl, count(*) filter (v > cut) as nr from g join cut on g.f = cut.f group by 1, 2, 3),
s as (select l.*, g - gl as gr, h - hl as hr, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) as gain from l join t on l.c = t.c and l.f = t.f where nr > 0),
r as (select *, row_number() over (partition by c order by round(gain, 9) desc, list_position({list(FEATURES)!r}, f), cut) as r from s)
select cast(c as integer) as code, f as feature, round_even(cut, 6) as cut, round_even(-0.3 * gl / (hl + 1), 6) as left_margin, round_even(-0.3 * gr / (hr + 1), 6) as right_margin from r where r = 1""")
def _(spark, folder):
    """The cut and margins of each class after one round of boosting of depth one over all rows."""
    rows = encode(beds.li(spark, folder), "label", beds.codec(spark))
    grown = trees.softmax_boosting(rows, FEATURES, "code", 4, rounds=1, depth=1, bins=8).trees
    out = [(t.target, FEATURES[t.feature[0]], t.cut[0], t.value[1][0], t.value[2][0]) for t in grown if t.feature[0] >= 0]
    return local_table(spark, out, "code int, feature string, cut double, left_margin double, right_margin double").select("code", "feature", *(rounded(F.col(c)).alias(c) for c in ("cut", "left_margin", "right_margin")))


@query("tree_contributions")
def _(spark, folder):
    """What each feature adds to every row's probability of `big`, by the trees of a Spark forest."""
    rows = encode(beds.li(spark, folder), "label", beds.codec(spark))
    forest = models.fit("forest", rows, FEATURES, "code", 4, numTrees=10, maxDepth=4)
    out = trees.tree_contributions(rows, trees.of_spark(forest.stages.stages[-1], FEATURES), KEY, 2)
    return out.select(*KEY, *(rounded(F.col(c)).alias(c) for c in (*FEATURES, "expected", "score")))


@query("model_importance")
def _(spark, folder):
    rows = encode(beds.li(spark, folder), "label", beds.codec(spark))
    return models.fit("forest", rows, FEATURES, "code", 4, numTrees=20, maxDepth=6).importances(spark)


@query("model_search")
def _(spark, folder):
    rows = encode(budgeted(beds.li(spark, folder), "label", KEY, 3000, 50, "tune"), "label", beds.codec(spark))
    fit = lambda d, p: models.fit("tree", d, FEATURES, "code", 4, **p)
    return tune.search(rows, "label", KEY, beds.codec(spark), fit, {"maxDepth": [2, 4, 8], "minInstancesPerNode": [1, 5]}, trials=2, k=2)[1]


@query("foreign_model")
def _(spark, folder):
    model = models.foreign(FEATURES, 2, lambda pdf: [(1 - d, d) for d in (pdf["l_discount"] / 0.1).clip(0, 1)])
    return model.transform(beds.li(spark, folder)).select(*KEY, F.col("proba")[1].alias("p"))
