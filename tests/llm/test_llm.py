"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from flowlens.llm import decontaminate, language_id, license_scan, line_dedup, mixing, ngram_join, quality_rules, warc
from flowlens.llm.chat_format import format_windows, read_back
from flowlens.llm.graph import components
from flowlens.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def texts():
    passage = " ".join(f"shared{i}" for i in range(30))
    a = " ".join(f"a{i}" for i in range(60))
    return {
        1: f"{a}\nline one of it\nline two of it\nline three of it",
        2: f"zero {passage} end",
        3: f"{passage} other words here é x",
        4: None,
        5: "",
        6: " \n\t ",
        7: a.upper() + " b c",
        8: f"{a}\nline one of it\nline two of it\nline three of it",
        9: "one two three",
        10: "One TWO three",
        11: "x " * 30_000,
        12: f"{a} line one of it\nline two of it",
        -3: f"negative {passage}",
    }


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", None) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA)


def removed(texts, n):
    seen, out = set(), {}
    for i in sorted(texts):
        w = words(texts[i])
        keep = [True] * len(w)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if key in seen:
                keep[k : k + n] = [False] * n
            seen.add(key)
        out[i] = (len(w), keep.count(False), " ".join(x for x, y in zip(w, keep, strict=True) if y))
    return out


def test_substrings_by_brute_force(docs, texts):
    extra = docs.withColumn("n_words", F.lit("mine")).withColumn("grp", F.lit(1))
    out = remove_repeats(extra, width=20)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "grp", "text", "n_words", "n_removed", "removed_spans"]
    assert out.where("grp != 1").count() == 0
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in out.collect()}
    want = removed(texts, 20)
    assert {i: (a, b, t or "") for i, (a, b, t) in got.items()} == want
    assert got[4][2] is None


def test_substrings_with_null_and_repeated_ids(spark, texts):
    t = texts[2]
    df = spark.createDataFrame([(None, t), (None, t), (1, t), (1, t), (2, t)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in remove_repeats(df).collect())
    assert got == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 32)]
    assert remove_repeats(df.limit(0)).count() == 0


def lines_left(texts, *cut):
    """What chunks find, each compared with its first place and extended around it; texts: id -> text."""
    cut = cut or (1, 2, 2, 64, 3)
    lines = {i: t.encode().split(b"\n") for i, t in texts.items() if t is not None and i is not None}
    first, out = {}, {}
    cuts = {i: list(line_dedup.chunks(ls, *cut)) for i, ls in lines.items()}
    for i in sorted(lines):
        for p, a, _, q, body in sorted(cuts[i], key=lambda c: c[1]):
            first.setdefault(body, (i, a, p, q))
    for i, ls in lines.items():
        gone = set()
        for _, a, b, _, body in cuts[i]:
            j, at, p, q = first[body]
            if (j, at) == (i, a):
                continue
            lo, hi, back, ahead = a, b, at, at + b - a
            while lo and back > p and ls[lo - 1] == lines[j][back - 1] and not (i == j and lo - 1 < at + b - a):
                lo, back = lo - 1, back - 1
            while hi < len(ls) and ahead < q and ls[hi] == lines[j][ahead] and not (i == j and ahead >= lo):
                hi, ahead = hi + 1, ahead + 1
            gone |= set(range(lo, hi))
        out[i] = b"\n".join(x for k, x in enumerate(ls) if k not in gone).decode()
    return {i: out.get(i, t) for i, t in texts.items()}


def test_lines_by_brute_force(docs, texts):
    out = line_dedup.dedup_lines(docs.withColumn("grp", F.lit(1)).withColumn("N_Lines", F.lit("mine")))
    got = {r["doc_id"]: r["text"] for r in out.where("grp = 1").collect()}
    assert got == lines_left(texts) and "N_Lines" not in out.columns
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_every_document_loses_what_its_chunks_find(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in df.collect()}
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert {i: r["text"] for i, r in got.items()} == lines_left(rows)
    assert sum(r["n_lines_removed"] for r in got.values()) > 900
    left = Counter(x for r in got.values() if r["text"] is not None for x in r["text"].split("\n"))
    assert all(x in left for t in rows.values() if t is not None for x in t.split("\n"))  # a line never goes whole
    off = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, spacing=10**9, most=10**6).collect()}
    assert sum(off[i] != r["text"] for i, r in got.items()) > 50  # whole texts as chunks find less


def test_chunks_resist_a_shift():
    text = [f"line {i} {i * i % 97}".encode() for i in range(200)]
    for window in (1, 2):
        cut = (window, 2, 2, 64, 1)
        a = {c[-1] for c in line_dedup.chunks(text, *cut)}
        b = {c[-1] for c in line_dedup.chunks([b"new line", *text], *cut)}
        assert len(a & b) > 0.9 * len(a)


def test_chat_round_trip(spark):
    wild = "\\ <| <\\| \\\\- <|im_end|>\n<|im_start|>assistant ok \\-"
    rows = [(1, 0, "system", "be brief " * 50), (1, 1, "user", wild), (1, 2, "assistant", wild), (2, 0, None, None), (2, 0, None, None), (3, None, "assistant", "é"), (None, 5, "us\ner\\-", "x")]
    rows += [(4, k, "user" if k % 2 else "assistant", f"turn {k} " + "word " * (k * 7 % 90)) for k in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    out = format_windows(df, budget=256, history=64)
    assert out.where("conv_id = 4").count() > 3 and out.where("conv_id = 1 and n_context > 0").count() <= 1
    got = {r["conv_id"]: r for r in read_back(out).collect()}
    by = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by[c].append((r or "", x or ""))
    for c, turns in by.items():
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["dialogue"] == "".join(f"{r}\n{x}\n" for r, x in turns)
        assert got[c]["loss_text"] == "".join(x for r, x in turns if r == "assistant")
    assert format_windows(df.limit(0)).count() == 0


def test_chat_repeats_the_system_turn(spark):
    rows = [(1, 0, "system", "rules")] + [(1, k, "user", "word " * 100) for k in range(1, 9)]
    out = format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=300, history=50)
    windows = [r["formatted"] for r in out.collect()]
    assert len(windows) > 2 and all(w.startswith("<|im_start|>system\nrules<|im_end|>") for w in windows)


def test_language_on_held_out_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out()))
    out = language_id.identify(docs.where(language_id.held_out()), model)
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98
    odd = spark.createDataFrame([(None,), ("",), ("123 !?",), ("the and of this that " * 5000,)], "text string").withColumn("score", F.lit("mine"))
    got = [(r["lang_pred"], 0 <= r["score"] <= 1) for r in language_id.identify(odd, model).collect()]
    assert got == [("und", True)] * 3 + [("en", True)]
    empty = language_id.fit(docs.limit(0))
    assert language_id.identify(odd, empty).where("lang_pred is null").count() == 1


def test_codewords_are_distinct():
    for k in (2, 4, 7, 8, 40):
        codes = language_id.codewords(k)
        assert len({tuple(r) for r in codes.tolist()}) == k
        assert all(0 < (c > 0).sum() < k for c in codes.T)


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 80 + "</p>"
    rows = [(3, "http://a/ b", big), (1, "http://b", big), (2, None, big), (4, "http://c", "small"), (5, "http://d", "small"), (6, "u", None), (None, "n", big), (7, "x", ""), (1, "http://b", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("length", F.lit(1))
    index = warc.write_archives(pages, archive_bytes=300)
    got = warc.read_records(index, gap=10, most=1 << 20).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["record_type"] == "response":
            assert hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"]
    kinds = Counter((r["record_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == Counter({(1, "response", None): 2, (2, "revisit", 1): 1, (3, "revisit", 1): 1, (4, "response", None): 1, (5, "response", None): 1, (6, "response", None): 1, (None, "response", None): 1, (7, "response", None): 1})
    assert {r["payload_bytes"] for r in got if r["record_type"] == "revisit"} == {len(big.encode())}
    assert warc.read_records(index.where("record_id = 4")).first()["payload"] == b"small"
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


def leak_words(t):
    return re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", lower(t))


def leaks(docs, items, threshold=0.6, share=0.7, least=3):
    """Scores of every passage and run of an item, one by one."""
    from math import log

    runs = []
    for i, t in items:
        q, a = (leak_words(x) for x in decontaminate.question_and_answer(t or ""))
        both = q + a
        if i is None or len(both) < least:
            continue
        n, cut = -(-len(both) // 64), 0
        for k in range(n):
            size = len(both) // n + (k < len(both) % n)
            runs.append((i, q, a, both[cut : cut + size]))
            cut += size
    n, mean = len(runs), sum(len(r[3]) for r in runs) / max(1, len(runs))
    df = Counter(x for r in runs for x in set(r[3]))

    def weight(run, x):
        tf = run.count(x)
        return log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(run) / mean))

    def found(part, own, k):
        k = min(k, len(part))
        have = {tuple(own[j : j + k]) for j in range(len(own) - k + 1)}
        every = [tuple(part[j : j + k]) in have for j in range(len(part) - k + 1)] if k else []
        return sum(every) / len(every) if every else 1.0

    out = {}
    for d, t in docs:
        w = leak_words(t)
        for at in range(0, len(w), 64):
            here = set(w[at : at + 128])
            for i, q, a, run in runs:
                own = [weight(run, x) for x in set(run)]
                score = sum(weight(run, x) for x in set(run) & here) / sum(own)
                if score < threshold - 1e-9:
                    continue
                size = len(q) + len(a)
                more = size if size > 64 else 0
                near = w[max(0, at - more) : at + 128 + more]
                x, y = (found(q + a, near, size),) * 2 if size < 5 else (found(q, near, 3), found(a, near, 3))
                if x >= share and y >= share:
                    best = (round(score, 9), -at)
                    out[d, i] = max(out.get((d, i), best), best)
    return {k: (s, -at) for k, (s, at) in out.items()}


def found_leaks(df, items):
    return {(r["doc_id"], r["item_id"]): (r["score"], r["start"]) for r in decontaminate.find_leaks(df, items).collect()}


def test_leaks_and_clean_texts(spark):
    item = "The quick brown fox of the north jumps over eleven lazy dogs. It lands beyond the river bank."
    long = " ".join(f"word{i}" for i in range(150)) + ". the last answer."
    given = [(1, item), (2, None), (3, ""), (4, "too short"), (None, item), (5, long), (6, "Capital of France? Paris"), (7, "!!")]
    items = spark.createDataFrame(given, "item_id long, text string")
    filler = " ".join(f"filler{i}" for i in range(500))
    wrong = " ".join(f"word{i}" for i in range(150)) + ". another reply altogether."
    rows = [(1, f"{filler} {item} {filler}"), (2, filler), (3, None), (4, ""), (5, item.upper()), (6, "The quick brown fox of the north jumps over eleven lazy dogs."), (7, long), (7, long), (None, item)]
    rows += [(8, wrong), (9, f"{filler}, capital of France: Paris!"), (10, "the capital of France is Paris"), (11, f"{filler} {filler[:70]} {long}"), (12, "too short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine"))
    found = decontaminate.find_leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(1, 1), (5, 1), (7, 5), (None, 1), (9, 6), (11, 5)}
    assert found_leaks(docs, items) == leaks(rows, given)
    assert {r["doc_id"] for r in decontaminate.drop_leaks(docs, found).collect()} == {2, 3, 4, 6, None, 8, 10, 12}
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("size", [16 << 20, 4000])
def test_leaks_by_brute_force(spark, small, monkeypatch, size):
    """In one turn and in many, with edited copies near the threshold."""
    import random

    monkeypatch.setattr(decontaminate, "INDEX_BYTES", size)
    monkeypatch.setattr(decontaminate, "CELLS", 40)
    rng = random.Random(2)
    given = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    given += [(1000 + k, " ".join(x for _, t in given[7 * k : 7 * k + 5] for x in (t,))) for k in range(3)]
    vocabulary = sorted({w for _, t in given for w in t.split()})
    rows = []
    for k in range(150):
        w = given[k % len(given)][1].split()
        for _ in range(int(len(w) * rng.choice([0, 0.05, 0.1, 0.2, 0.4]))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        around = [rng.choice(vocabulary) for _ in range(rng.randrange(200))]
        rows.append((k, " ".join(around + w + around)))
    got = found_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(given, "item_id long, text string"))
    want = leaks(rows, given)
    assert got == want and 60 < len(want) and len({i for _, i in want if i >= 1000}) == 3


@pytest.mark.parametrize("threshold", [0.1, 0.6])
def test_retrieval_finds_all_above_the_threshold(spark, small, threshold):
    """Against scores of every passage and item."""
    import numpy as np

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    index = decontaminate.build(items, threshold=threshold)
    rng = np.random.default_rng(1)
    n = len(index.terms)
    passages = [np.unique(rng.integers(0, n, 60)) for _ in range(60)]
    own = [np.unique(np.searchsorted(index.terms, np.concatenate(p))) for p in index.parts]
    passages += own + [np.unique(np.append(rng.choice(p, 1 + len(p) * 2 // 3), rng.integers(0, n, 20))) for p in own]
    passage = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    got = {(a, b): s for a, b, s in zip(*decontaminate.retrieve(index, passage, np.concatenate(passages), threshold), strict=True)}
    impact = np.zeros((n, len(index.item)))
    for e, key in enumerate(index.block_key):
        at = slice(index.post_at[e], index.post_at[e + 1])
        impact[key // index.blocks, index.post_entry[at]] = index.post_impact[at]
    scores = np.stack([impact[p].sum(axis=0) for p in passages])
    want = {(a, b): scores[a, b] for a, b in zip(*np.nonzero(scores >= threshold), strict=True)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > len(index.ids)


def test_few_entries_are_touched_and_fewer_blocks_opened():
    import numpy as np

    rng = np.random.default_rng(2)
    vocabulary = np.array([f"w{k}" for k in range(20_000)])
    draw = lambda size: " ".join(vocabulary[np.minimum(rng.zipf(1.3, size), len(vocabulary)) - 1])
    items = [(k, f"{draw(30)}. {draw(10)}") for k in range(4_000)]
    index = decontaminate.build(items)
    passages = [np.flatnonzero(np.isin(index.terms, decontaminate.Words([draw(128).encode()], True, decontaminate.SEPARATOR).hash)) for _ in range(200)]
    passages += [np.unique(np.searchsorted(index.terms, np.concatenate(p))) for p in index.parts[:20]]
    work = {}
    passage = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    got = set(zip(*(x.tolist() for x in decontaminate.retrieve(index, passage, np.concatenate(passages), 0.6, work)[:2]), strict=True))
    assert {(200 + k, k) for k in range(20)} <= got
    assert work["pairs"] == 220 * 4_000 and work["touched"] < 0.35 * work["pairs"] and work["opened"] < 0.05 * work["touched"] + 200


def test_quality_by_brute_force(docs, texts, spark):
    more = {20: "a b c d e f g h i " * 3, 21: "dup\ndup\n\n \nx\n" * 9, 22: "#$ % & " * 30, 23: "q w e r t y u i o p a s d f g h j k l z x " * 2}
    df = docs.select("doc_id", "text").union(spark.createDataFrame(list(more.items()), "doc_id long, text string")).withColumn("fail_bits", F.lit("mine")).withColumn("_ledger_h", F.lit(5))
    assert quality_rules.ledger(df).where("_ledger_h = 5").count() == df.count()
    out = quality_rules.apply_policy(quality_rules.ledger(df), "v4")
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t in {**texts, **more}.items():
        w, t = words(t), t or ""
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        n = Counter(windows)
        cover = {p for k, x in enumerate(windows) if n[x] > 1 for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)), i
        assert r["n_stutters"] == sum(a == b for a, b in zip(w, w[1:], strict=False))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
    rules = {r["rule"]: r for r in quality_rules.ablation(out, "v4").collect()}
    assert rules["few_words"]["n_fail"] == sum(len(words(t)) < 20 for t in {**texts, **more}.values())
    assert quality_rules.ledger(df.limit(0)).count() == 0


def jaccard(texts, n=5):
    sets = {}
    for i, t in texts.items():
        w = words(lower(t))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_join_by_brute_force(spark, docs, texts):
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    more = {}
    for k in range(120):  # a chain and a cloud of near copies
        w = list(base)
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(len(w))] = f"m{rng.randrange(40)}"
        more[100 + k] = " ".join(w)
    every = {**texts, **more}
    df = spark.createDataFrame(list(every.items()), "doc_id long, text string").withColumn("n", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()}
    assert got == jaccard(every)


def test_join_with_null_and_repeated_ids(spark, texts):
    df = spark.createDataFrame([(None, texts[1]), (5, texts[1]), (5, texts[1]), (2, texts[1]), (9, None)], "doc_id long, text string")
    joined = ngram_join.jaccard_components(df)
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in joined.collect() if r["doc_id"]) == [(2, 2), (5, 2), (5, 2), (9, 9)]
    assert {r["doc_id"] for r in ngram_join.drop_near_copies(df, joined).collect()} == {None, 2, 9}
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).union(spark.createDataFrame([(1000, 1001), (1001, 1002), (7, 7)], "u long, v long"))
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[i] for i in (1000, 1001, 1002)} == {1000}


def test_licences(spark):
    mit = dict(license_scan.TEMPLATES)["mit"]
    rows = [(1, "Released under the MIT License. under the mit license"), (2, "x " + mit.replace("Software", "Thing", 1) + " y"), (3, None), (4, ""), (5, "Apache License, Version 2.0; CC-BY-NC"), (6, "the software and the license of it"), (7, "é" * 10 + " cc by nc"), (8, "under the mit licenseé")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("mine"))
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 1, 5, "mit")
    assert got[2]["labels"] == "mit" and got[2]["base_labels"] == "" and 0.7 <= got[2]["score"] < 1 and got[2]["spans"][0]["start"] == 1
    assert [(got[i]["n_words"], got[i]["labels"], got[i]["score"], got[i]["first_word"]) for i in (3, 4)] == [(0, "", 0.0, None)] * 2
    assert got[5]["base_labels"] == "apache-2,cc-by-nc" and got[6]["labels"] == "" and got[7]["first_word"] == 1 and got[8]["n_base"] == 0
    assert license_scan.scan(df.limit(0)).count() == 0


def test_licence_texts_find_themselves(spark):
    rows = [(k, f"# header {k}\n\n * " + t.replace(" ", "\n * ", 3) + " trailing words of a file", label) for k, (label, t) in enumerate(license_scan.TEMPLATES)]
    rows.append((99, " ".join(t.split()[k] for _, t in license_scan.TEMPLATES for k in (0, 2, 4)), ""))
    df = spark.createDataFrame(rows, "doc_id long, text string, want string")
    for r in license_scan.scan(df).collect():
        assert (r["want"] in r["labels"].split(",") and r["score"] == 1.0) if r["want"] else not r["labels"], r["doc_id"]


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_by_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    parts = ["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "é", "word"]
    rows = [(k, rng.choice([" ", "-", ", "]).join(rng.choice(parts).upper() if rng.random() < 0.2 else rng.choice(parts) for _ in range(rng.randrange(400)))) for k in range(60)]
    rows += [(100 + k, " ".join(rng.choice(["under the MIT license", "Apache License, Version 2.0", "cc-by-nc", "the"]) for _ in range(30))) for k in range(10)]
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        w = leak_words(r["text"])
        at = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))


def test_automaton_by_brute_force():
    import random

    rng = random.Random(3)
    sequences = [[rng.randrange(4) for _ in range(rng.randrange(1, 25))] for _ in range(6)]
    auto = license_scan.Automaton(sequences)
    text = [rng.randrange(5) for _ in range(400)]
    known = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for at, (state, length) in enumerate(auto.statistics(text)):
        best = max((n for n in range(1, 26) if n <= at + 1 and tuple(text[at + 1 - n : at + 1]) in known), default=0)
        assert length == best
        own = tuple(text[at + 1 - length : at + 1])
        for k, end in auto.places[state].items() if length else ():
            assert tuple(sequences[k][end - length : end]) == own
        if length:
            assert set(auto.places[state]) == {k for k, s in enumerate(sequences) if any(tuple(s[i : i + length]) == own for i in range(len(s)))}


def shared_out(sizes, weights, most=3.0):
    """Targets by steps: every unit of words goes to sources by weight until one is full."""
    out, open_, left = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n], float(sum(sizes))
    while open_ and left > 1e-9:
        step = min([left / sum(weights[i] for i in open_), *((most * sizes[i] - out[i]) / weights[i] for i in open_)])
        for i in open_:
            out[i] += weights[i] * step
            left -= weights[i] * step
        open_ = [i for i in open_ if most * sizes[i] - out[i] > 1e-9]
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000], [0, 5], [1, 1, 1, 5000, 2, 70, 0, 9000, 3, 400], [7]])
def test_targets_share_and_cap(spark, sizes):
    rows = [(None if i == len(sizes) - 1 else f"s{i:03d}", n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows[::-1], "source string, source_size long")
    got = mixing.targets(df, (1.0, 2.0, 3.0)).orderBy("source_no").collect()
    assert [r["source"] for r in got] == [r[0] for r in rows]
    want = shared_out(sizes, [1.0 + i % 3 for i in range(len(sizes))])
    assert all(abs(r["target"] - w) < 1e-6 for r, w in zip(got, want, strict=True))


def test_splitting_tree_keeps_quotas():
    import numpy as np

    quotas = np.array([7, 0, 1000, 33])
    leaves = list(mixing.split(quotas, 0, 9, 1))
    assert [x[0] for x in leaves] == list(range(9)) and (sum(x[2] for x in leaves) == quotas).all()
    assert max(x[2].sum() for x in leaves) - min(x[2].sum() for x in leaves) <= 2


def test_mixture(spark):
    rows = [(i, "word " * (1 + i * 7 % 40), ["b", "a", None][i % 3] if i % 10 else "a") for i in range(900)] + [(900, None, "b"), (901, "", None), (5, "word " * 36, None), (5, "word " * 36, None), (None, "one two", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("epoch", F.lit("mine"))
    kwargs = {"block_words": 500, "block_texts": 5, "shard_words": 2000}
    m = mixing.mix(df, **kwargs)
    out = mixing.amounts(m).toPandas()
    assert (out["taken"] <= 3 * out["size"]).all() and len(out) == len(rows)
    for _, part in out.groupby("source", dropna=False):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 45
    assert abs(out.groupby("source", dropna=False)["target"].first().sum() - out["size"].sum()) < 1e-6
    again = mixing.amounts(mixing.mix(df.repartition(5), **kwargs)).toPandas()
    key = ["id", "source", "size", "taken"]
    assert sorted(map(str, out[key].to_numpy().tolist())) == sorted(map(str, again[key].to_numpy().tolist()))
    taken = mixing.mixed(df, m)
    assert taken.agg(F.sum(F.regexp_count("text", F.lit("word|one|two")))).first()[0] == out["taken"].sum()
    assert mixing.amounts(mixing.mix(df.limit(0), **kwargs)).count() == 0


def test_chat_windows_hold_their_budget(spark):
    text = lambda n: " ".join(["w"] * (n - 4))
    sizes = {1: [200, 150, 300], 2: [600, 90, 500, 20], 3: [5 + k * 37 % 180 for k in range(60)], 4: [40, 60, 70, 30], 5: [30, 40, 50]}
    system = {4: 460, 5: 700}
    rows = [(c, 0, "system", text(n)) for c, n in system.items()]
    rows += [(c, k, "assistant", text(n)) for c, s in sizes.items() for k, n in enumerate(s, 1)]
    rows += [(None, k, "user", text(100)) for k in range(9)]
    out = format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = defaultdict(list)
    for r in out.orderBy("conv_id", "window").collect():
        got[r["conv_id"]].append(r)
    for c, s in sizes.items():
        free = 512 - system.get(c, 0)
        room = max(free - 128, min(free, 64))
        spans, begin = [[]], {}
        for k, n in enumerate(s):
            if spans[-1] and sum(spans[-1]) + n > room:
                spans.append([])
            begin.setdefault(len(spans) - 1, k)
            spans[-1].append(n)
        want = []
        for w, span in enumerate(spans):
            past, left = [], min(128, free - sum(span))
            while begin[w] > len(past) and sum(past) + s[begin[w] - len(past) - 1] <= left:
                past.append(s[begin[w] - len(past) - 1])
            want.append((len(past) + (c in system and w > 0), system.get(c, 0) + sum(past) + sum(span)))
            assert want[-1][1] <= 512 or len(span) == 1
        assert [(r["n_context"], r["n_tokens"]) for r in got[c]] == want
    assert all(r["n_tokens"] <= 512 for r in got[None]) and len(got[None]) == 3


def test_repeated_runs_of_lines_go_whole(spark):
    line = lambda *a: " ".join(map(str, a)) + " of some words"
    shared = [line("shared", k) for k in range(12)]
    whole = "\n".join(line("copied", k) for k in range(31))
    rows, want, i = [(0, "\n".join(shared))], {0: "\n".join(shared)}, 1
    for n in (2, 3, 4, 5):
        for at in range(12 - n + 1):
            own = [line("own", i, k) for k in range(9)]
            rows.append((i, "\n".join(own[:4] + shared[at : at + n] + own[4:])))
            want[i] = "\n".join(own)
            i += 1
    for n in range(1, 32):  # exact copies of texts with any rest
        for copy in (0, 1):
            text = "\n".join(f"{n} {x}" for x in whole.split("\n")[:n])
            rows.append((i, text))
            want[i] = "" if copy and n > 1 else text
            i += 1
    rows += [(i, "\n".join(["alike"] * 3)), (i + 1, "\n".join(["twin"] * 6)), (i + 2, "one line\nshared line"), (i + 3, "shared line\nother line")]
    want |= {i: "\n".join(["alike"] * 3), i + 1: "twin\ntwin", i + 2: "one line\nshared line", i + 3: "shared line\nother line"}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == lines_left({i: t for i, t in rows})
    runs = {i for i in got if got[i] != want[i]}  # runs without a whole chunk, of two to five lines in other lines
    assert all(1 <= i <= 38 for i in runs) and len(runs) <= 19


def test_texts_of_many_lines(spark):
    """A text over a mebibyte, twice, and hot chunks in every text."""
    long = "\n".join(f"line {k} of a long text" for k in range(60_000))
    rows = [(0, long), (1, f"before\n{long}\nafter"), *((k, f"own {k} a\nhot one\nhot two\nhot three\nhot four\nown {k} b") for k in range(2, 400))]
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got[0] == long and len(got[1]) < 400 and got[1].startswith("before") and got[1].endswith("after")
    assert got[2] == rows[2][1] and got == lines_left(dict(rows))


def test_mixture_draws_equal_rows_apart(spark):
    rows = [(1, f"same size {k % 3}", "a") for k in range(4)] + [(None, "two words", "a")] * 3 + [(2, "a b c d e f", "b")]
    rows += [(k, "w " * 6, f"z{k % 2}") for k in range(3, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_mix_size", F.lit(7)).withColumn("MIX_SHARD", F.lit(1))
    m = mixing.mix(df, block_words=4, block_texts=1, shard_words=10)
    out = mixing.amounts(m).toPandas()
    assert len(out) == len(rows)
    for _, part in out.groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= part["size"].max()
    taken = mixing.mixed(df, m)
    assert taken.columns == ["doc_id", "text", "source", "_mix_size", "mix_shard", "mix_slot", "mix_epoch"]
    assert taken.agg(F.sum(F.regexp_count("text", F.lit(r"[^ ]+")))).first()[0] == out["taken"].sum()
    assert taken.where("doc_id = 1").groupBy("text", "mix_shard", "mix_slot").count().agg(F.max("count")).first()[0] in (1, None)


def test_running_sums_over_ranges(spark):
    rows = spark.range(2000).select((F.col("id") % 3).alias("source_no"), F.xxhash64("id").alias("h"), F.col("id").alias("block"), (F.col("id") % 7).alias("v"))
    by = defaultdict(list)
    for r in mixing.running(rows, [], "h", "v").collect():
        by[r["source_no"]].append((r["h"], r["v"], r["upto"]))
    for got in by.values():
        total = 0
        for _, v, upto in sorted(got):
            total += v
            assert upto == total


def thue_morse(k):
    s = "a"
    for _ in range(k):
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_structured_words_do_not_collide(spark):
    a = thue_morse(10)
    b = a.translate(str.maketrans("ab", "ba"))
    tail = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([a, *tail])), (2, " ".join([b, *tail])), (3, a), (4, b), (5, " ".join(thue_morse(12))), (6, " ".join(thue_morse(12).translate(str.maketrans("ab", "ba"))))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(df).collect()}
    want = removed(dict(rows), 20)
    assert got == {i: n for i, (_, n, _) in want.items()} and got[2] == 0
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()}
    assert got == jaccard(dict(rows)) and got[4][1] == 4


def test_number_signs_are_no_letters(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out()))
    odd = spark.createDataFrame([("\u00b2 \u00bd",), ("\u2460\u2167",), ("\u00b2 a",)], "text string")
    assert [r["lang_pred"] == "und" for r in language_id.identify(odd, model).collect()] == [True, True, False]


def test_pieces_lose_no_ngram():
    text = "".join(chr(97 + i * i % 23) + ("\u00e9" if i % 5 == 0 else " ") for i in range(700))
    whole = language_id.counted(text)
    n = len(text.encode())
    assert whole.sum() == sum(n - k + 1 for k in language_id.ORDERS)
    for piece in (1, 2, 3, 7, 100, n, n + 1):
        assert (language_id.counted(text, piece) == whole).all()


def test_many_languages(spark):
    rows = [(f"l{k:03d}", " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}q" for x in "abcdefgh") + f" {k}x") for k in range(300)]
    df = spark.createDataFrame(rows, "lang string, text string")
    model = language_id.fit(df)
    assert len(model.languages) == 300
    assert language_id.identify(df, model).where("lang = lang_pred").count() > 290


def test_urls_come_back(spark):
    rows = [(1, "http://a/b c%20d\u00e9?x=1"), (2, " lead\r\nX-Odd: 1"), (3, ""), (4, None), (5, "http://plain/%20")]
    pages = spark.createDataFrame([(i, u, f"text {i}") for i, u in rows], "page_id long, url string, html string")
    got = {r["record_id"]: r["url"] for r in warc.read_records(warc.write_archives(pages)).collect()}
    assert got == dict(rows)


def test_join_in_small_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(ngram_join, "SHINGLES", 300)
    monkeypatch.setattr(ngram_join, "QUERIES", 3)
    monkeypatch.setattr(ngram_join, "LOOK", 8)
    rng = random.Random(11)
    rows = {}
    for k in range(150):
        base = [f"w{k % 4}-{i}" for i in range(30 + 40 * (k % 3))]
        for _ in range(rng.randrange(0, 6)):
            base[rng.randrange(len(base))] = f"m{rng.randrange(60)}"
        rows[k] = " ".join(base)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()}
    assert got == jaccard(rows)


def test_texts_beyond_a_slice(spark):
    """Texts over a mebibyte, and more than a block of them."""
    long = " ".join(f"n{i}" for i in range(200_000))
    rows = [(1, long), (2, "x " + long.replace("n77 ", "other ")), (3, " ".join(f"k{i}" for i in range(300_000))), (4, long + "\n" + long), (5, "short one here")]
    rows += [(10 + k, " ".join(f"b{k}-{i}" for i in range(150_000))) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sum(len(t) for _, t in rows) > 8 << 20
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in remove_repeats(df).collect()}
    want = removed(dict(rows), 20)
    assert got == {i: (n, m, hashlib.sha256(t.encode()).hexdigest()) for i, (n, m, t) in want.items()}
    joined = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()}
    assert joined == jaccard(dict(rows)) and joined[2][1] == 1


def test_a_text_of_fragments_takes_time_in_proportion(spark):
    """A mebibyte of notice fragments that chain to nothing, with one whole notice in it."""
    import time

    words_ = license_scan.TEMPLATES[0][1].split()
    part = " ".join(f"{' '.join(words_[k % 20 : k % 20 + 6])} x{k} y z u v w a b c d" for k in range(2_000))
    seconds, spans = [], []
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.PHRASES, 4, 8, 0.7)
    for n in (2, 12):
        matches = []
        w = license_scan.Words([f"{(part + ' ') * n} {license_scan.TEMPLATES[0][1]} {part}".encode()], True, license_scan.SEPARATOR)
        tokens = license_scan.np.searchsorted(scanner.vocabulary, w.hash).tolist()
        known = [t < len(scanner.vocabulary) and scanner.vocabulary[t] == h for t, h in zip(tokens, w.hash, strict=True)]
        at = 0
        while at < len(tokens):
            stop = at
            while stop < len(tokens) and known[stop]:
                stop += 1
            if stop > at:
                matches += scanner.run(tokens[at:stop], at)[1]
            at = stop + 1
        began = time.process_time()
        spans.append(scanner.chain(matches))
        seconds.append((time.process_time() - began) / len(matches))
    assert all(license_scan.TEMPLATES[0][0] in {s[0] for s in x} for x in spans)
    assert seconds[1] < 4 * seconds[0]
    big = spark.createDataFrame([(1, (part + " ") * 8 + license_scan.TEMPLATES[0][1]), (2, part)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(big).collect()}
    assert license_scan.TEMPLATES[0][0] in got[1].split(",") and got[2] == ""


def test_hot_payloads_are_split_by_their_number(spark):
    """A third of the pages are one payload; another stands twice."""
    hot, two = "h" * 200, "t" * 150
    rows = [(i, f"http://x/{i}", hot if i % 3 == 0 else f"{i} " * 60) for i in range(300)] + [(900, "u", two), (901, "u", two), (None, "n", hot), (None, "n", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["id"]: r["refers_to"] for r in warc.digests(df, "page_id", "html").collect()}
    want = {i: 0 if i % 3 == 0 and i else None for i in range(300)} | {900: None, 901: 900, None: None}
    assert got == want
    back = warc.read_records(warc.write_archives(df)).collect()
    assert len(back) == len(rows) and sum(r["record_type"] == "revisit" for r in back) == 100
