"""Quality rules: counts of a document plus divergence from references of its language.

Every document gets base counts over its whole text and two Jensen-Shannon distances (base 2):
one between its character-class histogram and that of its language, one between its histogram
of common words (with a bin for all other words) and that of its language. A document is rejected
if a base rule fails, or if a distance exceeds its limit and the text is long enough to judge.

All of it is one narrow projection of built-in functions: no shuffle, no Python.

Edge cases: a null or empty text has no words, so ``n_words < 10`` fails it; a null or unknown
language has no reference, so only the base rules judge it; repeated rows and extra columns pass
through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.words import SPACE_CLASS, text_or_empty

MIN_WORDS = 10
REPEAT_SHARE = 20
MIN_CHARS_TO_JUDGE = 200
MIN_WORDS_TO_JUDGE = 50
# The limit on character classes widens for short texts, whose shares scatter more.
MAX_CHAR_DISTANCE = 0.18
SHORT_TEXT_SLACK = 0.6
# A text without a common word of its language has distance 0.360 (en), 0.308 (de), 0.390 (es) or 0.364 (fr), clean texts
# at most 0.326 in sf0.1. The SQL states one limit for all languages, so German texts without common words still pass.
MAX_WORD_DISTANCE = 0.345

# Reference histograms: fixed values. Character classes are lower-case letters, upper-case letters,
# digits, white space, symbols of SYMBOLS, and everything else (punctuation).
CLASS_REFERENCE = {
    "en": (0.786, 0.026, 0.004, 0.160, 0.001, 0.023),
    "de": (0.790, 0.047, 0.004, 0.135, 0.001, 0.023),
    "es": (0.786, 0.022, 0.004, 0.162, 0.001, 0.025),
    "fr": (0.784, 0.022, 0.004, 0.162, 0.001, 0.027),
}
# Shares of the ten most common function words of each language: fixed values.
WORD_REFERENCE = {
    "en": (("the", 0.065), ("of", 0.034), ("and", 0.029), ("to", 0.026), ("a", 0.022), ("in", 0.021), ("is", 0.011), ("that", 0.010), ("for", 0.009), ("was", 0.009)),
    "de": (("der", 0.035), ("die", 0.034), ("und", 0.029), ("in", 0.018), ("den", 0.012), ("von", 0.011), ("zu", 0.010), ("das", 0.010), ("mit", 0.009), ("ist", 0.009)),
    "es": (("de", 0.063), ("la", 0.037), ("que", 0.031), ("el", 0.029), ("en", 0.026), ("y", 0.026), ("a", 0.020), ("los", 0.017), ("se", 0.012), ("del", 0.012)),
    "fr": (("de", 0.058), ("la", 0.031), ("le", 0.029), ("et", 0.026), ("les", 0.024), ("des", 0.019), ("en", 0.016), ("un", 0.013), ("du", 0.013), ("une", 0.012)),
}
SYMBOLS = "[#*$%&|<>]"


def _js_distance(p: Column, q: Column) -> Column:
    """Square root of the base-2 Jensen-Shannon divergence of two aligned arrays of shares."""

    def half(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: half(x, y) + half(y, x))
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _reference(lang: Column, table: dict[str, tuple]) -> Column:
    """Array column holding the reference of a row's language, null if there is none."""
    out = F.lit(None)
    for code, values in table.items():
        out = F.when(lang == code, F.array(*[F.lit(v) for v in values])).otherwise(out)
    return out


def score_rules(docs: DataFrame) -> DataFrame:
    """Input columns plus ``_q``: a struct of the counts, distances and verdict of each row."""
    text = text_or_empty("text")
    word = F.col("_q.words")
    base = docs.withColumn("_q", F.struct(F.array_remove(F.split(text, SPACE_CLASS), "").alias("words")))
    gram = F.when(
        F.size(word) >= 6,
        F.transform(F.sequence(F.lit(1), F.size(word) - 4), lambda i: F.xxhash64(*[F.get(word, i + (k - 1)) for k in range(5)])),
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    common = F.filter(F.transform(word, lambda w: F.lower(w)), lambda w: w.isin(sorted({w for ref in WORD_REFERENCE.values() for w, _ in ref})))
    counted = base.withColumn(
        "_q",
        F.struct(
            F.size(word).cast("long").alias("n_words"),
            F.length(F.array_join(word, "")).cast("long").alias("word_chars"),
            F.length(text).cast("long").alias("n_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.length(F.regexp_replace(text, "[^\\p{Lu}]+", "")).alias("n_upper"),
            (F.length(text) - F.length(F.regexp_replace(text, "\\p{Ll}+", ""))).alias("n_lower"),
            F.length(F.regexp_replace(text, "[^0-9]+", "")).alias("n_digits"),
            lines.alias("lines"),
            gram.alias("grams"),
            common.alias("common"),
        ),
    )
    q = {k: F.col(f"_q.{k}") for k in ("n_words", "word_chars", "n_chars", "n_symbols", "n_upper", "n_lower", "n_digits", "lines", "grams", "common")}
    # Sorting (hash, position) is only paid for where some window occurs twice.
    pairs = F.array_sort(F.zip_with(q["grams"], F.sequence(F.lit(0), F.size(q["grams"]) - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.when(F.size(q["grams"]) > F.size(F.array_distinct(q["grams"])), pairs)
    spaces = q["n_chars"] - q["word_chars"]
    rest = q["word_chars"] - q["n_symbols"] - q["n_upper"] - q["n_lower"] - q["n_digits"]
    share = F.transform(F.array(*[x.cast("double") for x in (q["n_lower"], q["n_upper"], q["n_digits"], spaces, q["n_symbols"], rest)]), lambda x: x / F.greatest(q["n_chars"], F.lit(1)))
    ref_words = _reference(F.col("lang"), {k: tuple(w for w, _ in v) for k, v in WORD_REFERENCE.items()})
    word_count = F.transform(ref_words, lambda r: F.size(F.filter(q["common"], lambda w: w == r)).cast("double"))
    measured = counted.withColumn(
        "_q",
        F.struct(
            q["n_words"].alias("n_words"), q["word_chars"].alias("word_chars"), q["n_chars"].alias("n_chars"), q["n_symbols"].alias("n_symbols"),
            (F.size(q["lines"]) - F.size(F.array_distinct(q["lines"]))).cast("long").alias("n_dup_lines"),
            repeated.alias("sorted"), share.alias("classes"), word_count.alias("hits"),
        ),
    )
    at = F.col("_q.sorted")
    twice = F.filter(at, lambda x, i: (F.get(at, i - 1)["h"] == x["h"]) | F.coalesce(F.get(at, i + 1)["h"] == x["h"], F.lit(False)))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    hits, n_words = F.col("_q.hits"), F.col("_q.n_words")
    word_share = F.transform(F.concat(hits, F.array(n_words - F.aggregate(hits, F.lit(0.0), lambda s, x: s + x))), lambda x: x / F.greatest(n_words, F.lit(1)))
    ref_share = _reference(F.col("lang"), {k: (*(s for _, s in v), 1 - sum(s for _, s in v)) for k, v in WORD_REFERENCE.items()})
    spread = measured.withColumn(
        "_q",
        F.struct(
            *[F.col(f"_q.{k}").alias(k) for k in ("n_words", "word_chars", "n_chars", "n_symbols", "n_dup_lines")],
            starts.alias("starts"),
            F.when(F.col("_q.n_chars") >= MIN_CHARS_TO_JUDGE, _js_distance(F.col("_q.classes"), _reference(F.col("lang"), CLASS_REFERENCE))).alias("char_distance"),
            F.when(n_words >= MIN_WORDS_TO_JUDGE, _js_distance(word_share, ref_share)).alias("word_distance"),
        ),
    )
    start = F.col("_q.starts")
    # A window covers five words; the next repeated window cuts it short.
    covered = F.aggregate(start, F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(5), i - s["last"])).alias("n"), i.alias("last")))["n"]
    done = spread.withColumn("_q", F.struct(F.col("_q.*"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")))
    failed = (F.col("_q.n_words") < MIN_WORDS) | (100 * F.col("_q.n_repeat_words") > REPEAT_SHARE * F.col("_q.n_words"))
    odd = F.coalesce(F.col("_q.char_distance") > MAX_CHAR_DISTANCE + SHORT_TEXT_SLACK / F.sqrt(F.col("_q.n_chars")), F.lit(False)) | F.coalesce(F.col("_q.word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    return done.withColumn("_q", F.struct(F.col("_q.*"), failed.alias("base_failed"), (~failed & ~odd).alias("kept")))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    # A filter would be pushed below the projections and repeat their expressions; an exploded flag is not.
    one, none = F.array(F.lit(True)), F.array().cast("array<boolean>")
    flagged = score_rules(docs).select(*docs.columns, F.explode(F.when(F.col("_q.kept"), one).otherwise(none)).alias("_kept"))
    return flagged.drop("_kept")
