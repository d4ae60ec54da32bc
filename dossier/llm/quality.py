"""Line-first quality rules, from built-in functions only.

Every line is held against punctuation, navigation and boilerplate rules; lines that break one are removed, and a
document that loses too large a share of its text that way is rejected, as is one that fails the base counts.

Defined results: a null text counts as empty (no words, rejected by ``min_words``); lines without a word are never
judged; equal rows get equal results; texts of any length are judged whole; input columns named like an output column are
replaced, all others stay as they are; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACE_CLASS, with_columns_of, words_of

#: Phrases of page furniture, matched without regard to case.
BOILERPLATE = (
    "cookie policy", "privacy policy", "terms of (use|service)", "all rights reserved", "enable javascript",
    "javascript is disabled", "lorem ipsum", "click here to", "subscribe to our newsletter", "sign in to continue",
    "skip to (main )?content", "powered by \\w+press",
)

SYMBOLS = "[#*$%&|<>]"


def line_rules(line: Column) -> dict[str, Column]:
    """Rule name -> whether the line breaks it."""
    found = lambda pattern: F.regexp_count(line, F.lit(pattern))
    words = F.size(F.split(F.btrim(line, F.lit(SPACE_CHARS)), f"[{SPACE_CLASS}]+"))
    capitals = (F.upper(line) == line) & (F.lower(line) != line)
    return {
        # ten words or more without any sentence punctuation
        "no_punctuation": ~line.rlike("[.!?…;:]") & (words >= 10),
        # five words or more in capitals only, or doubled marks again and again
        "shouting": (capitals & (words >= 5)) | (found("!!|\\?\\?") >= 3),
        # three separators or more that stand between items
        "navigation": found(f"[{SPACE_CLASS}][|»›•·>](?=[{SPACE_CLASS}])") >= 3,
        # symbols are a tenth of the line or more
        "symbols": found(SYMBOLS) * 10 >= F.length(line),
        "boilerplate": line.rlike("(?i)" + "|".join(BOILERPLATE)),
    }


def broken(line: Column) -> Column:
    rules = list(line_rules(line).values())
    out = rules[0]
    for r in rules[1:]:
        out = out | r
    return out


def assess(
    docs: DataFrame, text: str = "text", *, window: int = 5, min_words: int = 10, max_repeat_percent: int = 20, max_lost_percent: int = 50
) -> DataFrame:
    """docs with the base counts, the cleaned text, the characters lost, base_failed and kept.

    n_repeat_words counts the words inside any window of ``window`` words that occurs twice or more in the text; windows
    are told apart by 64-bit hashes within their own document.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text", "n_chars_judged", "n_chars_lost")
    out = docs.drop(*(n for n in names if n != text)).withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    line_has_word = lambda x: x.rlike(f"[^{SPACE_CLASS}]")
    out = out.withColumn("__w", words_of(F.col("__t"))).withColumn("__every", F.split("__t", "\n")).withColumn("__lines", F.filter("__every", line_has_word))
    gram = ", ".join(f"__w[i + {j}]" for j in range(window))
    out = out.withColumn("__h", F.expr(f"CASE WHEN size(__w) >= {window} THEN transform(sequence(0, size(__w) - {window}), i -> xxhash64({gram})) ELSE array() END"))
    # only a document in which a window repeats needs its windows sorted to find where
    out = out.withColumn("__s", F.expr("CASE WHEN size(array_distinct(__h)) < size(__h) THEN sort_array(transform(__h, (x, i) -> struct(x AS h, i AS i))) END"))
    out = out.withColumn(
        "__at",
        F.expr(
            "sort_array(transform(filter(__s, (x, j) -> (j > 0 AND __s[greatest(j - 1, 0)].h = x.h)"
            " OR (j < size(__s) - 1 AND __s[least(j + 1, size(__s) - 1)].h = x.h)), x -> x.i))"
        ),
    )
    # each line is held against the rules once; null where none is broken, which spares most texts the rest
    out = out.withColumn("__flags", F.transform("__every", lambda x: line_has_word(x) & broken(x)))
    out = out.withColumn("__bad", F.when(F.array_contains("__flags", True), F.filter("__every", lambda x, i: F.get("__flags", i))).otherwise(F.array().cast("array<string>")))
    measured = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    out = (
        out.withColumn("n_words", F.size("__w").cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace("__t", f"[{SPACE_CLASS}]+", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("__t", F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn(
            "n_repeat_words",
            F.expr(
                f"CASE WHEN __at IS NULL THEN 0L ELSE aggregate(transform(__at, (x, j) -> CASE WHEN j < size(__at) - 1"
                f" THEN least({window}, __at[least(j + 1, size(__at) - 1)] - x) ELSE {window} END), 0L, (a, x) -> a + x) END"
            ),
        )
        .withColumn("n_chars_judged", measured("__lines"))
        .withColumn("n_chars_lost", measured("__bad"))
        .withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent))
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_chars_lost") * 100 <= F.col("n_chars_judged") * max_lost_percent))
        .withColumn("clean_text", F.when(F.size("__bad") == 0, F.col("__t")).otherwise(F.array_join(F.filter("__every", lambda x, i: ~F.get("__flags", i)), "\n")))
    )
    return out.drop("__t", "__w", "__lines", "__h", "__s", "__at", "__bad", "__every", "__flags")


def filter_documents(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The documents that stay, with their lines cleaned; columns as in docs."""
    rows = docs.select(F.col(text), with_columns_of(docs, (text,)).alias("__all")) if len(docs.columns) > 1 else docs
    # a row number keeps the optimiser from copying the whole chain of expressions into the filter
    kept = assess(rows, text, **limits).withColumn("__row", F.monotonically_increasing_id()).where("kept AND __row >= 0")
    return kept.select(*[(F.col("clean_text") if c == text else F.col("__all").getField(c)).alias(c) for c in docs.columns])
