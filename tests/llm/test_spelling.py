"""Spelling variants against all pairs, and against SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import oracles, queries
from flowlens.llm.spelling_variants import disjoint, near_pairs, roots, spelling_variants, word_counts

SCHEMA = "doc_id long, text string, word string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 6:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def expected(n):
    out = {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = [best if best and n[best] >= 5 * n[w] else None, len(near)]
    for w in n:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return {(w, f, r, n[w], k, n[f] if f else None) for w, (f, k, r) in out.items()}


def made_up(seed, size):
    """Words in families of variants, of few letters and many repeats."""
    r = random.Random(seed)
    words = set()
    while len(words) < size:
        w = "".join(r.choice("abcéÿ×") for _ in range(r.randint(6, 9)))
        words.add(w)
        for _ in range(r.randint(0, 4)):
            k, c = r.randrange(len(w)), r.choice("abcd")
            w = r.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])
            words.add(w)
    return [w for w in words if len(w) >= 6]


@pytest.fixture(scope="module")
def docs():
    r = random.Random(5)
    words = made_up(1, 400)
    freq = {w: r.choice([1, 4, 5, 6, 30, 200, 1200]) for w in words}
    freq |= {"aaaaaa": 6, "aaaaaaa": 40, "aaaaaaaa": 300, "b" * 5_000: 7, "b" * 5_001: 50, "abcdef": 5, "short": 90}
    bag = [w if r.random() < 0.9 else w.upper() for w, n in freq.items() for _ in range(n)]
    r.shuffle(bag)
    out = [(i, " ".join(bag[i::50]) + r.choice([" ", "\n", "1", "-"])) for i in range(50)]
    return [*out, (None, "ALPHABETIC alphabetic " * 8), (-4, None), (7, ""), (8, " \n"), out[0], out[0]]


def test_as_all_pairs(spark, docs):
    df = spark.createDataFrame([(i, t, "mine") for i, t in docs], SCHEMA).repartition(4)
    n = counted(docs)
    assert {r["word"]: r["n"] for r in word_counts(df).collect()} == n
    out = spelling_variants(df)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in out.collect()]
    want = expected(n)
    assert len(got) == len(want) and set(got) == want
    assert sum(f is not None for _, f, *_ in want) > 50 and any(f and r != f for _, f, r, *_ in want)


@pytest.mark.parametrize("pairs", [1 << 22, 20])
def test_split_keys_lose_no_pair(spark, pairs):
    """Many words of one common stem share their rare bigrams; keys of more than 20 pairs are split."""
    r = random.Random(6)
    words = sorted({"zxqj" + "".join(r.choice("ab") for _ in range(5)) for _ in range(200)} | set(made_up(3, 150)))
    df = spark.createDataFrame([(w, i + 5) for i, w in enumerate(words)], "word string, n long")
    got = {(x["a"], x["b"]) for x in near_pairs(df, pairs).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_pivots_are_the_cheapest_disjoint_pair():
    r = np.random.default_rng(1)
    place = np.sort(np.array([r.permutation(6)[:3] for _ in range(500)]), axis=1)
    cost = r.integers(1, 9, place.shape)
    pick = disjoint(place, cost)
    for p, c, (i, k) in zip(place, cost, pick, strict=True):
        fine = [c[a] + c[b] for a in range(3) for b in range(a + 1, 3) if p[b] - p[a] >= 2]
        assert p[k] - p[i] >= 2 and c[i] + c[k] == min(fine)


def test_roots_of_a_long_chain(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(12)], "word string, form string")
    got = {r["word"]: r["root"] for r in roots(forms, 5**14).collect()}
    assert got == {f"w{i}": "w12" for i in range(12)}


def test_nothing_to_find(spark):
    df = spark.createDataFrame([(1, None, ""), (2, "few words only", "")], SCHEMA)
    assert spelling_variants(df).count() == spelling_variants(df.limit(0)).count() == 0
    lone = spelling_variants(df.select(F.lit(3).alias("doc_id"), F.repeat(F.lit("lonesome "), 9).alias("text")))
    assert lone.count() in (1, 2) and lone.where("form is not null or n_near > 0").count() == 0


def test_same_as_sql(spark, small):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{small}/documents.parquet')")
    want = db.execute(oracles.SPELLING_VARIANTS).fetchall()
    got = queries.op11_spelling_variants(spark, small)
    assert len(want) > 1000 and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
