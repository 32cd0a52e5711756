"""Benchmark decontamination with a BM25 index of the test items.

Items are the indexed side: a posting list for each term, in blocks of entries with the largest impact of
each block. Every training passage is a query against a fixed threshold. A WAND pivot is the term at
which the summed maxima reach the threshold, and nothing is touched through the terms behind it. As the
threshold is fixed and impacts are shares of what an entry scores against itself, the pivot of each
entry is known beforehand: its terms stand in order of rarity, those behind the pivot add less than a
stated share of the threshold. Lists up to the pivots are short, for they hold an entry under its rare
terms alone; a passage adds them up, skips entries that with all behind their pivot stay below, and opens
the blocks of the rest: block maxima bound them with all terms, then postings score them in full. What
reaches the threshold is verified on the overlap of question and answer.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.storage import stored
from flowlens.llm.textops import Words, is_long, mix64, rolling, slices, utf8

#: Bytes other than ASCII letters, digits and non-ASCII.
SEPARATOR = np.ones(256, dtype=bool)
SEPARATOR[48:58] = SEPARATOR[65:91] = SEPARATOR[97:123] = SEPARATOR[128:] = False

CHUNK = 64  # words; a passage is two neighbouring chunks, so it holds any run of CHUNK words
BLOCK = 4  # entries of a posting block
WHOLE = 5  # items of fewer words must stand in a text as they are
INDEX_BYTES = 16 << 20  # benchmark text indexed, and broadcast, at once
CELLS = 1 << 22  # sums of passages by entries made at once
BEHIND = 0.5  # of the threshold: what the terms behind an entry's pivot add is less
THRESHOLD = 0.6
RUN = 3  # words of a run that question and passage share
K1, B = 1.2, 0.75
PLACE = "item_id bigint, score double, question_overlap double, answer_overlap double, start bigint"


@dataclass(frozen=True)
class Index:
    """largest: the largest impact of a term; front_*: a term's entries whose pivot is not before it;
    behind: what the terms behind its pivot add to an entry; block_top: the largest impact of a posting
    block; block_key: term and block as one number; post_*: the postings of each block; item: the item
    of an entry; parts: hashes of the words of an item's question and answer; run_*: hashes of each part's
    runs of RUN words, question before answer, none of a shorter part."""

    terms: np.ndarray
    largest: np.ndarray
    front_at: np.ndarray
    front_entry: np.ndarray
    front_impact: np.ndarray
    behind: np.ndarray
    block_top: np.ndarray
    block_key: np.ndarray
    post_at: np.ndarray
    post_entry: np.ndarray
    post_impact: np.ndarray
    item: np.ndarray
    ids: list[int]
    parts: list[tuple[np.ndarray, np.ndarray]]
    run_at: np.ndarray
    run_hash: np.ndarray

    @property
    def blocks(self) -> int:
        return len(self.item) // BLOCK + 1


@dataclass(frozen=True)
class Statistics:
    """Of all entries of a benchmark: their number and mean words; entries with a term, by term."""

    entries: int
    words: float
    terms: np.ndarray
    frequency: np.ndarray


def question_and_answer(text: str) -> tuple[str, str]:
    """The text up to its last sentence, and that sentence; of a single sentence, its last quarter."""
    cuts = [m.end() for m in re.finditer(r"[.?!][ \n]+|\n+", text.rstrip())]
    for at in reversed(cuts):
        if re.search(r"\w", text[at:]) and re.search(r"\w", text[:at]):
            return text[:at], text[at:]
    words = text.split()
    n = max(1, len(words) // 4)
    return " ".join(words[:-n]), " ".join(words[-n:])


def entries(text: str, least: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Question, answer, and the runs that are indexed: all words, in equal runs of CHUNK at most."""
    q, a = (Words([x.encode()], True, SEPARATOR).hash for x in question_and_answer(text))
    both = np.concatenate([q, a])
    return q, a, np.array_split(both, -(-len(both) // CHUNK)) if len(both) >= max(1, least) else []


def build(items: list[tuple[int, str]], known: Statistics | None = None, least: int = 3, threshold: float = THRESHOLD) -> Index:
    """The index of (id, text), with the statistics of the whole benchmark (default: of the items), for
    searches with `threshold` or more."""
    ids, parts, words, item = [], [], [], []
    for i, text in items:
        q, a, runs = entries(text, least)
        if runs:
            item += [len(ids)] * len(runs)
            words += runs
            ids.append(i)
            parts.append((q, a))
    n = len(words)
    sizes = np.array([len(x) for x in words], dtype=np.int64)
    every = np.concatenate([np.zeros(0, np.uint64), *words])
    terms, at = np.unique(every, return_inverse=True)
    pair, tf = np.unique(at * n + np.repeat(np.arange(n), sizes), return_counts=True)
    term, entry = pair // max(n, 1), pair % max(n, 1)
    if known is None:
        known = Statistics(n, sizes.mean() if n else 0.0, terms, np.bincount(term, minlength=len(terms)))
    df = known.frequency[np.searchsorted(known.terms, terms)] if n else np.zeros(0)
    idf = np.log(1 + (known.entries - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[entry] / max(known.words, 1e-9)))
    impact /= np.bincount(entry, impact, n)[entry]  # of what the entry scores against itself
    largest = np.zeros(len(terms))
    np.maximum.at(largest, term, impact)
    order = np.lexsort((term, -df[term], entry))  # an entry's terms, common ones first
    upto = np.cumsum(impact[order])
    begin = np.searchsorted(entry[order], np.arange(n))
    upto -= (upto[begin] - impact[order][begin])[entry[order]]
    late = upto < BEHIND * threshold
    behind = np.bincount(entry[order][late], impact[order][late], n)
    front = np.sort(order[~late])  # by term
    key = term * (n // BLOCK + 1) + entry // BLOCK
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
    return Index(
        terms, largest, np.searchsorted(term[front], np.arange(len(terms) + 1)), entry[front], impact[front], behind,
        np.maximum.reduceat(impact, first) if n else impact, key[first], np.append(first, len(key)), entry, impact, np.array(item, np.int64), ids, parts,
        np.concatenate([[0], np.cumsum([max(0, len(x) - RUN + 1) for p in parts for x in p], dtype=np.int64)]).astype(np.int64),
        np.concatenate([np.zeros(0, np.uint64), *(rolling(x, RUN) for p in parts for x in p)]),
    )


def _ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and the range of each."""
    n = stops - starts
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + starts[owner], owner


def retrieve(index: Index, passage: np.ndarray, term: np.ndarray, threshold: float, work: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, entry, score) of all scores from the threshold up.

    passage and term: distinct pairs by passage, then term. work: adds up the pairs of passage and entry
    there are, those touched, and the pairs of passage and block opened.
    """
    least = threshold - 1e-9
    if not len(term):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    edge = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1], [True]]))
    n, size = np.diff(edge), len(index.item)
    own = np.repeat(np.arange(len(n)), n)
    use = np.flatnonzero((np.add.reduceat(index.largest[term], edge[:-1]) >= least)[own])
    keys, step, touched = [], max(1, CELLS // size), 0
    cuts = np.searchsorted(own[use], np.arange(0, len(n) + step, step))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a == b:
            continue
        part = use[a:b]
        at, owner = _ranges(index.front_at[term[part]], index.front_at[term[part] + 1])
        cell = (own[part] - k * step)[owner] * size + index.front_entry[at]
        bound = np.bincount(cell, index.front_impact[at], minlength=min(step, len(n) - k * step) * size)
        some = np.flatnonzero(bound)
        touched += len(some)
        some = some[bound[some] + index.behind[some % size] >= least - 1e-9]
        keys.append(np.unique((some // size + k * step) * index.blocks + some % size // BLOCK))
    key = np.concatenate([np.zeros(0, np.int64), *keys])
    if work is not None:
        for name, m in (("pairs", len(n) * size), ("touched", touched), ("opened", len(key))):
            work[name] = work.get(name, 0) + m
    # Every term of the passage in each open block: their maxima bound again, their postings score.
    pairs, owner = _ranges(edge[key // index.blocks], edge[key // index.blocks + 1])
    want = term[pairs] * index.blocks + (key % index.blocks)[owner]
    got = np.searchsorted(index.block_key, want)
    got[got == len(index.block_key)] = 0
    hit = np.flatnonzero(index.block_key[got] == want)
    got, owner = got[hit], owner[hit]
    hit = np.flatnonzero(np.bincount(owner, index.block_top[got], len(key))[owner] >= least)
    posts, who = _ranges(index.post_at[got[hit]], index.post_at[got[hit] + 1])
    pair, back = np.unique((key // index.blocks)[owner[hit][who]] * size + index.post_entry[posts], return_inverse=True)
    score = np.bincount(back, index.post_impact[posts], len(pair))
    keep = np.flatnonzero(score >= least)
    return passage[edge[:-1]][pair[keep] // size], pair[keep] % size, score[keep]


def overlap(part: np.ndarray, passage: list[int], n: int = RUN) -> float:
    """The share of a part's runs of n words (all, if fewer) that the passage has; 1 of no words."""
    n = min(n, len(part))
    own = part.tolist()
    have = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
    runs = [tuple(own[i : i + n]) in have for i in range(len(own) - n + 1)] if n else []
    return sum(runs) / len(runs) if runs else 1.0


def verified(question: np.ndarray, answer: np.ndarray, words: np.ndarray, start: int) -> tuple[float, float]:
    """Overlaps of question and answer with the passage that begins at `start` of a text's words.

    With an item longer than a chunk, words as many as the item's on either side belong to the
    passage. An item of fewer than WHOLE words overlaps wholly or not at all.
    """
    size = len(question) + len(answer)
    around = size if size > CHUNK else 0
    own = words[max(0, start - around) : start + 2 * CHUNK + around].tolist()
    if size < WHOLE:
        whole = overlap(np.concatenate([question, answer]), own, size)
        return whole, whole
    return overlap(question, own), overlap(answer, own)


def plausible(index: Index, items: np.ndarray, words: Words, lo: np.ndarray, hi: np.ndarray, question: float, answer: float) -> np.ndarray:
    """Which pairs of an item and words[lo:hi] share enough runs to be verified, by hashes of the runs of
    all pairs at once. Equal runs have equal hashes, so no pair that verifies is lost."""
    windows, own = np.unique(lo * (len(words.hash) + 1) + hi, return_inverse=True)
    first, stop = windows // (len(words.hash) + 1), windows % (len(words.hash) + 1)
    at, owner = _ranges(first, np.maximum(first, stop - RUN + 1))
    salt = lambda h, window: mix64(h + window.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    have = np.sort(salt(rolling(words.hash, RUN)[at], owner))
    good = np.ones(len(items), dtype=bool)
    for part, share in ((0, question), (1, answer)):
        begin, end = index.run_at[2 * items + part], index.run_at[2 * items + part + 1]
        at, owner = _ranges(begin, end)
        want = salt(index.run_hash[at], own[owner])
        found = np.searchsorted(have, want)
        found[found == len(have)] = 0
        hits = np.bincount(owner[have[found] == want] if len(have) else owner[:0], minlength=len(items))
        good &= hits >= share * (end - begin) - 1e-9
    return good


def find_leaks(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
    question: float = 0.7,
    answer: float = 0.7,
    least: int = 3,
) -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap, start): a row per leaked item and text.

    score: the largest BM25 score of a passage over what the item (of a long item, the run of it that
    scores) scores against itself; start: the first word of that passage. A pair counts if its score
    is `threshold` or more and the passage has the stated shares of three-word runs of the whole
    question and the whole answer; see verified(). Words are runs of ASCII letters, digits and
    non-ASCII, ASCII lower-cased. Null or empty texts and items and null item ids match nothing, nor
    do items of fewer than `least` words: a word or two is no passage. Rows with a null id report
    under null. Rows equal in id count once. Other columns are ignored. Ids must be integers. The
    items are indexed INDEX_BYTES at a time, each over all texts, with the statistics of all items.
    """
    spark = df.sparkSession
    docs = is_long(df.where(F.col(text_col).isNotNull()), id_col).select(id_col, text_col)
    bench = items.where(F.col(item_text_col).isNotNull() & F.col(item_col).isNotNull())
    bench = bench.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t"))
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    turns = max(1, math.ceil(total / INDEX_BYTES))
    bench = bench.withColumn("turn", F.pmod(F.xxhash64("i", "t"), F.lit(turns)).cast("int"))
    known = _statistics(bench, least) if turns > 1 else lambda turn: None
    found = None
    for turn in range(turns):
        own = bench.where(F.col("turn") == turn).orderBy("i", "t").collect()
        index = spark.sparkContext.broadcast(build([(r["i"], r["t"]) for r in own], known(turn), least, threshold))
        part = docs.mapInArrow(_search(index, id_col, threshold, question, answer), f"{id_col} bigint, {PLACE}")
        found = part if found is None else found.union(part)
    best = F.max_by(F.struct("score", "question_overlap", "answer_overlap", "start"), F.struct("score", -F.col("start"), "question_overlap", "answer_overlap"))
    return found.groupBy(id_col, "item_id").agg(best.alias("b")).select(id_col, "item_id", "b.*")


def _statistics(bench: DataFrame, least: int) -> Callable[[int], Statistics]:
    """turn -> statistics of the whole benchmark, for the terms of the turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for turn, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for own in entries(text, least)[2]:
                    term = np.unique(own).view(np.int64)
                    words = np.where(np.arange(len(term)) > 0, 0, len(own))  # with the entry's first term
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), turn), pa.int32()), pa.array(term, pa.int64()), pa.array(words, pa.int64())], names=["turn", "term", "words"])

    each = stored(bench.select("turn", "t").mapInArrow(run, "turn int, term bigint, words bigint"), "leak-terms")
    r = each.agg(F.sum("words").alias("words"), F.count(F.when(F.col("words") > 0, 1)).alias("n")).first()
    counts = each.groupBy("term").agg(F.count("*").alias("n"))
    known = stored(each.select("turn", "term").distinct().join(counts, "term"), "leak-frequencies")

    def of(turn: int) -> Statistics:
        got = known.where(F.col("turn") == turn).select("term", "n").toPandas()
        terms = got["term"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(terms)
        return Statistics(r["n"], (r["words"] or 0) / max(1, r["n"]), terms[order], got["n"].to_numpy(dtype=np.int64)[order])

    return of


def _search(shared, id_col: str, threshold: float, question: float, answer: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        sizes = np.array([len(q) + len(a) for q, a in index.parts], dtype=np.int64)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), utf8(b.column(1))
            rows: list[tuple] = []
            for i, j in slices(texts) if len(index.terms) else ():
                w = Words(texts[i:j], True, SEPARATOR)
                at = np.searchsorted(index.terms, w.hash)
                at[at == len(index.terms)] = 0
                hit = np.flatnonzero(index.terms[at] == w.hash)
                # Chunks are numbered with a gap behind each text; passage c holds chunks c and c + 1.
                per = -(-np.diff(w.first) // CHUNK) + 1
                base = np.cumsum(per) - per
                doc = w.doc[hit]
                chunk = base[doc] + (hit - w.first[doc]) // CHUNK
                term = at[hit]
                wide = len(index.terms)
                begins = hit - w.first[doc] >= CHUNK
                pair = np.unique(np.concatenate([chunk * wide + term, (chunk[begins] - 1) * wide + term[begins]]))
                passage, entry, score = retrieve(index, pair // wide, pair % wide, threshold)
                d = np.searchsorted(base, passage, side="right") - 1
                start, item = (passage - base[d]) * CHUNK, index.item[entry]
                size = sizes[item]
                around = np.where(size > CHUNK, size, 0)
                lo = w.first[d] + np.maximum(0, start - around)
                hi = np.minimum(w.first[d + 1], w.first[d] + start + 2 * CHUNK + around)
                for k in np.flatnonzero(plausible(index, item, w, lo, hi, question, answer)).tolist():
                    q, a = verified(*index.parts[item[k]], w.hash[w.first[d[k]] : w.first[d[k] + 1]], int(start[k]))
                    if q >= question and a >= answer:
                        rows.append((ids[i + int(d[k])], index.ids[item[k]], round(float(score[k]), 9), q, a, int(start[k])))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            if rows:
                names = [id_col, "item_id", "score", "question_overlap", "answer_overlap", "start"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return run


def drop_leaks(df: DataFrame, leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """df without the rows whose id has a leak; null ids stay."""
    return df.join(leaks.select(id_col).distinct(), id_col, "left_anti").select(*df.columns)
