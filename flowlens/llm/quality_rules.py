"""Quality rules as a bitmask ledger.

Each rule is evaluated once per text and leaves one failure bit, next to the measurements. A policy
is a versioned mask over the bits: verdicts, reruns under another version and ablations need only
the ledger, not the texts. DataFrame expressions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.textops import fresh

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8

#: Bit number -> rule. Bits are never reassigned, so old ledgers stay readable.
RULES = {
    0: "few_words",
    1: "repeated_words",
    2: "symbols",
    3: "duplicate_lines",
    4: "word_length",
    5: "exclamations",
    6: "capitals",
    7: "stutter",
}
BASE_MASK = 0b00000011
#: Version -> mask of the rules that reject.
POLICIES = {"v1": 0b00000011, "v2": 0b00011111, "v3": 0b01111111, "v4": 0b11111111}

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutters", "n_exclamations", "n_capitals", "n_letters"]


def _chars_left(text: Column, gone: str) -> Column:
    return F.length(F.regexp_replace(text, gone, "")).cast("long")


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the measurements of MEASURES; null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    word, mark, line = (fresh(df, f"_ledger_{x}") for x in ("w", "h", "l"))
    parts = ", ".join(f"get({mark}, i + {k})" for k in range(WINDOW))
    return (
        df.withColumn(word, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
        .withColumn("n_words", F.size(word).cast("long"))
        .withColumn(mark, F.transform(word, lambda w: F.xxhash64(w)))
        .drop(word)
        .withColumn("n_stutters", F.expr(f"cast(size(filter({mark}, (h, i) -> i > 0 and h = get({mark}, i - 1))) as bigint)"))
        .withColumn(mark, F.expr(f"if(n_words < {WINDOW}, array(), transform(sequence(0, n_words - {WINDOW}), i -> xxhash64({parts})))"))
        .withColumn(mark, F.expr(f"if(size(array_distinct({mark})) < size({mark}), sort_array(transform({mark}, (h, i) -> struct(h as h, i as i))), null)"))
        .withColumn(mark, F.expr(f"sort_array(transform(filter({mark}, (x, k) -> coalesce(get({mark}, k - 1).h = x.h, false) or coalesce(get({mark}, k + 1).h = x.h, false)), x -> x.i))"))
        .withColumn("n_repeat_words", F.expr(f"coalesce(aggregate(transform({mark}, (x, k) -> if(k = 0, {WINDOW}, least({WINDOW}, x - get({mark}, k - 1)))), 0L, (a, x) -> a + x), 0L)"))
        .drop(mark)
        .withColumn("word_chars", _chars_left(text, r"[\x20\x09-\x0D]+"))
        .withColumn("n_symbols", _chars_left(text, r"[^#*$%&|<>]+"))
        .withColumn(line, F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)))
        .withColumn("n_lines", F.size(line).cast("long"))
        .withColumn("n_dup_lines", (F.size(line) - F.size(F.array_distinct(line))).cast("long"))
        .drop(line)
        .withColumn("n_exclamations", _chars_left(text, r"[^!]+"))
        .withColumn("n_capitals", _chars_left(text, r"[^A-Z]+"))
        .withColumn("n_letters", _chars_left(text, r"[^A-Za-z]+"))
    )


def failures() -> dict[str, Column]:
    """Rule -> whether the measurements fail it."""
    n = F.col("n_words")
    return {
        "few_words": n < 20,
        "repeated_words": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": 100 * F.col("n_symbols") > 25 * n,
        "duplicate_lines": (100 * F.col("n_dup_lines") > 50 * F.col("n_lines")) & (F.col("n_lines") >= 4),
        "word_length": (n > 0) & ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        "exclamations": 100 * F.col("n_exclamations") > 50 * n,
        "stutter": 100 * F.col("n_stutters") > 30 * n,
        "capitals": (100 * F.col("n_capitals") > 70 * F.col("n_letters")) & (F.col("n_letters") >= 100),
    }


def ledger(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with its measurements and fail_bits (long): bit k set where the text fails RULES[k].

    One narrow pass. Null and empty texts measure 0 everywhere and fail few_words. Columns of df
    named like a new one are replaced. Two windows count as equal if their 64-bit hashes are.
    """
    out = measure(df, text_col)
    tests = failures()
    bits = F.lit(0).cast("long")
    for bit, rule in RULES.items():
        bits = bits.bitwiseOR(F.when(tests[rule], F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("fail_bits", bits)


def apply_policy(df: DataFrame, version: str = "v4") -> DataFrame:
    """A ledger with base_failed and kept under the policy; rules of BASE_MASK always reject."""
    hit = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) != 0
    return df.withColumn("base_failed", hit(BASE_MASK)).withColumn("kept", ~hit(BASE_MASK | POLICIES[version]))


def ablation(df: DataFrame, version: str = "v4") -> DataFrame:
    """For each rule of the policy: rows that fail it, and rows that only it rejects.

    The rows are first counted by their masked bits, at most 2**len(RULES) groups.
    """
    mask = BASE_MASK | POLICIES[version]
    groups = df.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(b).alias("bit"), F.lit(r).alias("rule")) for b, r in RULES.items() if mask >> b & 1)))
    each = groups.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    return each.groupBy("bit", "rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.expr("shiftleft(1L, bit)")) != 0, F.col("n")).otherwise(0)).alias("n_fail"),
        F.sum(F.when(F.col("bits") == F.expr("shiftleft(1L, bit)"), F.col("n")).otherwise(0)).alias("n_only"),
    )
