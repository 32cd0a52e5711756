"""Vector codes against a plain search of all entries, and against SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import oracles, queries
from flowlens.llm.vector_codes import compress, nearest, pivots_of, squared, with_label_error

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def plain(rows, parts=8, entries=16, rounds=6):
    """rows: (id, vector) of finite vectors of one length, in the order of ids."""
    whole = [[math.floor(4096 * x) for x in v] for _, v in rows]
    w = len(whole[0]) // parts
    cut = [[v[j * w : (j + 1) * w] for j in range(parts)] for v in whole]
    books = [[cut[i][j] for i in range(min(entries, len(cut)))] for j in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda q, j: min((far(q, e), i) for i, e in enumerate(books[j]))
    for _ in range(rounds):
        at = [[best(v[j], j)[1] for j in range(parts)] for v in cut]
        for j in range(parts):
            for e in range(len(books[j])):
                own = [v[j] for v, a in zip(cut, at, strict=True) if a[j] == e]
                if own:
                    books[j][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [[best(v[j], j) for j in range(parts)] for v in cut]
    codes = [("".join(f"{i:02x}" for _, i in a), sum(d for d, _ in a)) for a in last]
    return codes, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def float32(v):
    return [float(x) for x in np.array(v, dtype=np.float32)]


@pytest.mark.parametrize("n", [1, 9, 150])
def test_as_a_plain_search(spark, n):
    r = random.Random(n)
    rows = [(3 * i - 7, float32([r.gauss(0, 1) * (1 + i % 3) for _ in range(16)]), i % 4 or None, "mine") for i in range(n)]
    rows += [(900 + i, rows[i % n][1], 1, "mine") for i in range(20)] if n > 1 else []  # copies, and ties of entries
    bad = [(-90, None, 1, ""), (-91, [None] * 16, 1, ""), (-92, [math.nan] + [0.0] * 15, 1, ""), (-93, [0.0] * 15 + [-math.inf], 1, ""), (-94, [], 1, "")]
    short = [(5000, [1.0] * 8, 1, "")]
    df = spark.createDataFrame(rows + bad + short, SCHEMA).withColumn("_parts", F.lit(5)).repartition(3)
    made = compress(df)
    out = {x["vec_id"]: x for x in with_label_error(made.codes).collect()}
    codes, books = plain(sorted((i, v) for i, v, *_ in rows))
    assert sorted(out) == sorted(i for i, *_ in rows) and made.books_sha256() == books
    totals = {}
    for (i, _, label, _), (code, error) in zip(sorted(rows, key=lambda x: x[0]), codes, strict=True):
        assert (out[i]["code"], out[i]["error"], out[i]["_parts"], out[i]["label"]) == (code, error, 5, label)
        totals[label] = totals.get(label, 0) + error
    assert all(x["label_error"] == totals[x["label"]] for x in out.values())
    assert len(made.work) == 6 and all(0 < a <= b for a, b in made.work)


def test_null_and_equal_ids(spark):
    r = random.Random(2)
    vectors = [float32([r.random() for _ in range(8)]) for _ in range(30)]
    rows = [(None if i % 3 == 0 else 1, v, 0, None) for i, v in enumerate(vectors)]
    made = compress(spark.createDataFrame(rows, SCHEMA), entries=16)
    got = sorted((x["vec_id"] or 0, x["code"], x["error"]) for x in made.codes.collect())
    order = sorted(rows, key=lambda x: (x[0] is None, [math.floor(4096 * c) for c in x[1]]))
    codes, books = plain([(0, v) for _, v, *_ in order])
    assert got == sorted((x[0] or 0, *c) for x, c in zip(order, codes, strict=True)) and made.books_sha256() == books


def test_no_vector_and_what_is_refused(spark):
    empty = spark.createDataFrame([(1, None, 1, "")], SCHEMA)
    assert with_label_error(compress(empty).codes).count() == 0
    assert with_label_error(compress(empty.limit(0)).codes).columns == ["vec_id", "label", "code", "error", "label_error"]
    with pytest.raises(ValueError):
        compress(spark.createDataFrame([(1, [1.0] * 9, 1, "")], SCHEMA))


def test_bounds_prune_and_lose_nothing():
    r = np.random.default_rng(4)
    middle = r.integers(-4000, 4000, (16, 8))
    x = np.repeat(middle, 200, axis=0) + r.integers(-300, 300, (3200, 8))
    entries = middle + r.integers(-50, 50, middle.shape)
    entries[9] = entries[3]  # a tie
    p = pivots_of(entries, 4)
    to = np.sqrt(squared(x[:, None], p[None]).astype(float)).astype(np.float32).astype(float)
    index, best, tried = nearest(x, to, entries, p)
    every = squared(x[:, None], entries[None])
    assert (index == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert tried < x.shape[0] * 16 * 0.4


def test_same_as_sql(spark, small):
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from read_parquet('{small}/embeddings.parquet')")
    want = db.execute(oracles.VECTOR_CODES).fetchall()
    got = queries.op12_vector_codes(spark, small)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 0
