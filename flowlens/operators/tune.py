"""Search over model parameters with stratified folds."""

from __future__ import annotations

import random
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from statistics import median, stdev

from pyspark import inheritable_thread_target
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.local import local_table
from flowlens.operators import evaluate as ev
from flowlens.operators.sample import folds

#: metric -> (function of scored rows and codec, whether more is better)
METRICS: dict[str, tuple[Callable[[DataFrame, DataFrame], float], bool]] = {
    "accuracy": (lambda d, c: ev.averages(ev.per_class(ev.confusion(d, c))).first()["accuracy"], True),
    "macro_f1": (lambda d, c: ev.averages(ev.per_class(ev.confusion(d, c))).first()["macro_f1"], True),
    "weighted_f1": (lambda d, c: ev.averages(ev.per_class(ev.confusion(d, c))).first()["weighted_f1"], True),
    "balanced_accuracy": (lambda d, c: ev.averages(ev.per_class(ev.confusion(d, c))).first()["balanced_accuracy"], True),
    "mcc": (lambda d, c: ev.agreement(ev.confusion(d, c)).first()["mcc"], True),
    "log_loss": (lambda d, c: ev.log_loss(d).first()["log_loss"], False),
}


@dataclass
class _Trial:
    number: int
    params: dict
    values: list[float] = field(default_factory=list)
    status: str = "waiting"


def search(
    df: DataFrame, label: str, key: Sequence[str], codec: DataFrame, fit: Callable[[DataFrame, dict], object], space: dict[str, list],
    metric: str = "macro_f1", trials: int = 10, k: int = 3, timeout: float = 2700.0, seed: int = 7, warm: int = 5, workers: int = 1,
) -> tuple[dict, DataFrame]:
    """The best parameters and a table of trials (trial, params, status, value, spread, fold values).

    Trial -1 has the defaults ({}), which stay unless beaten. fit(rows, params) gives a model with
    transform(). A trial whose first fold is worse than the median first fold of the trials before it,
    `warm` of them at least, is pruned. `workers` trials run at once, each under a job tag of its own; a
    trial that is pruned, or still runs after `timeout` seconds, has its jobs cancelled by the tag. Trials
    are pruned by those before them in number, so any number of workers finds the same. A trial
    that fails is a row, not an error. df needs `code`.
    """
    measure, rising = METRICS[metric]
    rows = folds(df, label, key, k, f"tune-{seed}").persist()
    rng = random.Random(seed)
    every = [_Trial(-1, {})] + [_Trial(i, {p: rng.choice(v) for p, v in sorted(space.items())}) for i in range(trials)]
    context, run_id, lock = df.sparkSession.sparkContext, uuid.uuid4().hex, threading.Lock()
    over = ("pruned", "timeout")

    def stop(t: _Trial, status: str) -> None:
        t.status = status
        context.cancelJobsWithTag(f"{run_id}-{t.number}")

    def prune() -> None:
        """Judges trials in order of number, as far as the first folds of those before are known."""
        firsts: list[float] = []
        for t in every:
            if t.values:
                worse = len(firsts) >= warm and t.values[0] != median(firsts) and (t.values[0] < median(firsts)) == rising
                if t.number >= 0 and worse and t.status not in over:
                    stop(t, "pruned")
                firsts.append(t.values[0])
            elif not t.status.startswith(("failed", "timeout")):
                return

    def one(t: _Trial) -> None:
        with lock:
            if t.status in over:
                return
            t.status = "running"
        context.addJobTag(f"{run_id}-{t.number}")
        try:
            for fold in range(k):
                if t.status in over:
                    return
                model = fit(rows.where(F.col("fold") != fold), t.params)
                value = float(measure(model.transform(rows.where(F.col("fold") == fold)), codec))
                with lock:
                    if t.status in over:
                        return
                    t.values.append(value)
                    prune()
            with lock:
                t.status = "done" if t.status == "running" else t.status
        except Exception as e:
            with lock:
                if t.status in over:  # its jobs were cancelled
                    return
                if not isinstance(e, IllegalArgumentException | ValueError | TypeError):  # else: parameters the estimator does not take
                    raise
                t.values.clear()
                t.status = f"failed: {str(e).splitlines()[0][:120]}"
                prune()
        finally:
            context.removeJobTag(f"{run_id}-{t.number}")

    ends = time.monotonic() + timeout
    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        running = [pool.submit(inheritable_thread_target(df.sparkSession)(one), t) for t in every]
        running[0].result()  # the defaults are always tried
        wait(running, timeout=max(0.0, ends - time.monotonic()))
        with lock:
            for t in every:
                if t.status in ("waiting", "running"):
                    stop(t, "timeout")
            prune()
        for r in running:
            r.result()
    rows.unpersist()
    out, best = [], (None, {})
    for t in every:
        values = t.values[:1] if t.status == "pruned" else t.values if t.status == "done" else []
        value = sum(values) / len(values) if t.status == "done" else None
        spread = stdev(values) if t.status == "done" and len(values) > 1 else None
        out.append((t.number, str(t.params), t.status, value, spread, values))
        if value is not None and (best[0] is None or (value > best[0] if rising else value < best[0])):
            best = (value, t.params)
    return best[1], local_table(df.sparkSession, out, "trial int, params string, status string, value double, spread double, folds array<double>")
