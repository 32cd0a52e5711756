"""Spelling variants: words one edit apart, found through pivotal bigrams.

Bigrams are ordered by how many words hold them, rare ones first. The three rarest of a word are its
prefix (with all that are as rare as the last), and two of them that share no letter, chosen for the
least total frequency, are its pivots. One edit destroys one of two disjoint bigrams at most. So of two
words one edit apart, that whose prefix ends earlier in the order has a pivot among the other's prefix,
and it has moved by one place at most: pivots are looked up in the prefixes under the places and
lengths that one edit allows. What passes is compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.storage import stored
from flowlens.llm.textops import buckets, fresh

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROPPED = 199  # one run in so many loses a letter
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Pairs of a pivot and a prefix under one key that one task compares; keys with more are split.
PAIRS = 1 << 22
LETTERS = 256  # all letters are below


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of LEAST_LENGTH letters and LEAST_COUNT places at least.

    A run whose checksum with its document's id is divisible by DROPPED loses a letter first, so that
    spelling variants stand in any text. Null texts have no runs; a null id counts as empty.
    """
    run, check, length = F.col("_run"), F.col("_check"), F.col("_length")
    lowered = F.when(run.rlike("[A-Z]"), F.translate(run, UPPER, LOWER)).otherwise(run)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN), 0)).alias("_run"))
    runs = runs.where(F.length("_run") >= LEAST_LENGTH).select("_id", lowered.alias("_run"))
    runs = runs.select("_run", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")).alias("_check"), F.length("_run").alias("_length"))
    at = (check % length).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, length))
    words = runs.where((check % DROPPED != 0) | (length > LEAST_LENGTH)).select(F.when(check % DROPPED == 0, cut).otherwise(run).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words and where each begins; all are below LETTERS."""
    text = "".join(column.to_pylist()).encode("latin-1")
    sizes = np.fromiter((len(w) for w in column.to_pylist()), dtype=np.int64, count=len(column))
    return np.frombuffer(text, dtype=np.uint8).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def bigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word number, place and code of every bigram; sizes of the words; the parity of their letters."""
    code, edges = letters(column)
    word = np.repeat(np.arange(len(column)), np.diff(edges))
    odd = np.zeros(len(column), dtype=np.int64)
    np.bitwise_xor.at(odd, word, np.left_shift(np.int64(1), code % 63))
    inside = word[1:] == word[:-1] if len(word) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    return word[at], at - edges[word[at]], code[at] * LETTERS + code[at + 1], np.diff(edges), odd


def gram_counts(words: DataFrame) -> dict[int, int]:
    """Words that hold each bigram; the alphabet bounds it: 90 letters make 8,100 bigrams at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS * LETTERS, dtype=np.int64)
        for b in batches:
            word, _, gram, _, _ = bigrams(b.column("word"))
            total += np.bincount(np.unique(word * LETTERS**2 + gram) % LETTERS**2, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    return {r[0]: r[1] for r in words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect()}


def disjoint(place: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Which two of three bigrams (by place, ascending) to take: without a shared letter, cheapest.

    By dynamic programming over the bigrams in order of place: the best single one that ends before
    bigram k, and with it the best pair that ends with k. place, cost: (words, 3); returns (words, 2).
    """
    n = len(place)
    none = np.iinfo(np.int64).max
    pair, pick = np.full(n, none), np.zeros((n, 2), dtype=np.int64)
    for k in range(1, place.shape[1]):
        one, which = np.full(n, none), np.zeros(n, dtype=np.int64)
        for i in range(k):
            better = (place[:, k] - place[:, i] >= 2) & (cost[:, i] < one)
            one[better], which[better] = cost[better, i], i
        better = (one < none) & (one + cost[:, k] < pair)
        pair[better] = (one + cost[:, k])[better]
        pick[better, 0], pick[better, 1] = which[better], k
    return pick


def signatures(words: DataFrame) -> DataFrame:
    """Rows (pivot, gram, place, size, last, odd, word, n): a word's prefix under its own places, and its
    pivots under the places and lengths that a word one edit away may have them at.

    gram and last are ranks in the order of rarity; odd holds the parity of each letter's number.
    """
    counts = gram_counts(words)
    ranked = sorted(counts, key=lambda g: (counts[g], g))
    rank, cost = np.zeros(LETTERS**2, dtype=np.int64), np.zeros(len(ranked) + 1, dtype=np.int64)
    rank[ranked] = np.arange(len(ranked))
    cost[: len(ranked)] = [counts[g] for g in ranked]
    moves = np.array([(0, 0), (0, 1), (1, 1), (0, -1), (-1, -1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            column, count = b.column("word"), b.column("n")
            word, place, gram, size, odd = bigrams(column)
            gram = rank[gram]
            order = np.lexsort((place, gram, word))
            word, place, gram = word[order], place[order], gram[order]
            first = np.searchsorted(word, np.arange(len(size)))
            three = first[:, None] + np.arange(3)
            last = gram[three[:, 2]]
            prefix = np.flatnonzero(gram <= last[word])
            by_place = np.argsort(place[three], axis=1)
            three = np.take_along_axis(three, by_place, axis=1)
            two = np.take_along_axis(three, disjoint(place[three], cost[gram[three]]), axis=1).reshape(-1)
            moved = np.repeat(two, len(moves))
            shift, longer = np.tile(moves[:, 0], len(two)), np.tile(moves[:, 1], len(two))
            at = np.concatenate([prefix, moved])
            own = word[at]
            columns = [
                np.arange(len(at)) >= len(prefix),
                gram[at].astype(np.int32),
                (place[at] + np.concatenate([np.zeros(len(prefix), np.int64), shift])).astype(np.int32),
                (size[own] + np.concatenate([np.zeros(len(prefix), np.int64), longer])).astype(np.int32),
                last[own].astype(np.int32),
                odd[own],
            ]
            good = columns[2] >= 0
            yield pa.RecordBatch.from_arrays([*(pa.array(c[good]) for c in columns), column.take(pa.array(own[good])), count.take(pa.array(own[good]))], names=["pivot", "gram", "place", "size", "last", "odd", "word", "n"])

    return words.mapInArrow(run, "pivot boolean, gram int, place int, size int, last int, odd long, word string, n long")


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, a_n, b, b_n) of every two words one edit apart, a below b, once; words: (word, n), distinct.

    Under one key all pivots meet all prefixes. Keys with more than `pairs` such pairs are split: their
    pivots into as many parts as that takes, each with a copy of the key's prefixes.
    """
    key = ["gram", "place", "size"]
    grams = stored(signatures(words), "spelling-grams")
    sides = grams.groupBy(*key).agg(F.count_if("pivot").alias("p"), F.count_if(~F.col("pivot")).alias("q"))
    hot = stored(sides.where(F.col("p") * F.col("q") > pairs).select(*key, F.ceil(F.col("p") * F.col("q") / F.lit(pairs)).cast("int").alias("parts")), "spelling-hot")
    pivots, prefixes = grams.where("pivot").drop("pivot"), grams.where("not pivot").drop("pivot")
    if hot.isEmpty():
        pivots, prefixes = pivots.withColumn("part", F.lit(0)), prefixes.withColumn("part", F.lit(0))
    else:
        parts = F.coalesce("parts", F.lit(1))
        pivots = pivots.join(hot, key, "left").withColumn("part", F.pmod(F.xxhash64("word"), parts).cast("int")).drop("parts")
        prefixes = prefixes.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    x, y = pivots.alias("x"), prefixes.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in [*key, "part"]]
    close = (F.col("x.last") <= F.col("y.last")) & (F.bit_count(F.col("x.odd").bitwiseXOR(F.col("y.odd"))) <= 2) & (F.col("x.word") != F.col("y.word"))
    one = F.levenshtein(F.col("x.word"), F.col("y.word"), 1) == 1
    found = x.join(y, [*same, close, one])
    low = F.col("x.word") < F.col("y.word")
    ends = [F.when(low, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}")).alias(name) for a, b, c, name in (("x", "y", "word", "a"), ("x", "y", "n", "a_n"), ("y", "x", "word", "b"), ("y", "x", "n", "b_n"))]
    return found.select(*ends).distinct()


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root): the last word that forms (word, form) lead to; most: the largest n of a word.

    n grows TIMES-fold from word to form, so a chain has few steps; each round doubles the steps made.
    """
    links = stored(forms.select("word", F.col("form").alias("root")), "spelling-links")
    made, steps = 1, 1
    while LEAST_COUNT * TIMES**steps <= most:
        steps += 1
    while made < steps:
        next_ = links.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        links = stored(links.join(next_, links["root"] == next_["_from"], "left").select("word", F.coalesce("_to", "root").alias("root")), "spelling-links")
        made *= 2
    return links


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every word with its number, its near words and the frequent form it is a variant of.

    Returns word, form, root, n, n_near, form_n: two words are near if one letter inserted, deleted or
    replaced makes one the other; a word's form is its most frequent near word (ties: the smallest), if
    that stands TIMES times as often; root follows forms to the last. A word without a form is its own
    root. Words of a null text are none, repeated rows count again, a null id counts as an empty one,
    an empty table gives no word; columns other than id and text are not read.
    """
    words = stored(word_counts(docs, id_col, text_col), "spelling-words")
    pairs = near_pairs(words)
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    named = (-F.col("best.less")) >= TIMES * F.col("n")
    out = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(named, F.col("best.near")).alias("form"), F.when(named, -F.col("best.less")).alias("form_n")), "spelling-forms")
    last = roots(out.where("form is not null"), out.agg(F.max("n")).first()[0] or 0)
    out = out.join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
