"""Line-first cleaning and document rejection (operator 4), DataFrame and SQL functions only.

Every line with a word is tested by itself: it must end in closing punctuation, must not be a navigation strip (words between separators),
must not be symbol noise and must not be a boilerplate phrase. Failing lines are removed; a document that loses too large a share of its
words that way is rejected. There is no shuffle: all counts are array expressions on the row, sorted where order is needed, so one very
long text costs n log n in its own task and nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import unused

#: White space of the word rule: space and U+0009 to U+000D.
_WS = r"[ \t-\r]+"
_WS_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Phrases of notices that carry no content (fixed values, lower case).
BOILERPLATE = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "we use cookies", "enable javascript", "lorem ipsum", "click here", "sign up for our newsletter")


@dataclass(frozen=True)
class LineRules:
    """A line fails without closing punctuation, with ``separators`` or more separators, with more than ``symbol_percent`` symbols per 100
    words, or with a boilerplate phrase. A document is rejected when it loses more than ``lost_percent`` of its words."""

    closing: str = r"[.!?…:;][\"'”’»)\]]*$"
    separator: str = r" [|>»•·] "
    separators: int = 3
    symbol_percent: int = 20
    lost_percent: int = 30
    phrases: tuple[str, ...] = BOILERPLATE


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _WS))


def _n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", ""))


_PLACE_BITS = 20


def with_repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """``df`` with ``out``: how many of the ``words`` lie in 3-word windows that occur twice or more.

    A window's hash and its place share one long, so equal windows are neighbours in a primitive sort; neighbours with equal hash bits are
    compared word by word, and the gaps between the sorted places of those that are equal say how much each covers. Texts with more words
    than a place has bits for sort pairs of full hash and place instead. Each step is a column of its own, so it is evaluated once.
    """
    w, mask = F.col(words), (1 << _PLACE_BITS) - 1
    near_col, far_col, places = unused(df, "near", "far", "places")
    n, i32 = F.size(w), lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    heads = F.slice(w, 1, F.greatest(n - 2, F.lit(1)))
    window = lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
    near, far = (n >= 3) & (n <= mask), n > F.greatest(F.lit(mask), F.lit(2))
    df = df.withColumn(near_col, F.when(near, F.sort_array(F.transform(heads, lambda x, i: window(x, i).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))))
    df = df.withColumn(far_col, F.when(far, F.sort_array(F.transform(heads, lambda x, i: F.struct(window(x, i).alias("h"), i.alias("i"))))))
    equal = lambda i, j: (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))
    rest = lambda c: F.slice(c, 2, F.greatest(F.size(c), F.lit(1)))
    pairs = F.zip_with(near_col, rest(near_col), lambda a, b: F.when((a.bitwiseXOR(b).bitwiseAND(F.lit(~mask)) == 0) & equal(i32(a), i32(b)), F.array(i32(a), i32(b))))
    long_pairs = F.zip_with(far_col, rest(far_col), lambda a, b: F.when((a["h"] == b["h"]) & equal(a["i"], b["i"]), F.array(a["i"], b["i"])))
    some = lambda x: F.sort_array(F.array_distinct(F.flatten(F.filter(x, lambda p: p.isNotNull()))))
    df = df.withColumn(places, F.when(near, some(pairs)).when(far, some(long_pairs)).otherwise(F.array().cast("array<int>")))
    gaps = F.zip_with(places, rest(places), lambda a, b: F.least(F.lit(3), b - a))
    return df.withColumn(out, F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x).cast("long")).drop(near_col, far_col, places)


def line_verdict(line: Column, rules: LineRules, plain: bool = False) -> Column:
    """Why a line fails: 'navigation', 'symbols', 'punctuation', 'boilerplate', or null where it passes.

    ``plain`` is for lines of a text that has no separator, symbol or phrase anywhere: only the punctuation is left to test.
    """
    n = F.size(F.split(F.btrim(line, F.lit(_WS_CHARS)), _WS))
    unclosed = ~F.btrim(line, F.lit(_WS_CHARS)).rlike(rules.closing)
    if plain:
        return F.when(unclosed, "punctuation")
    return (
        F.when(F.regexp_count(line, F.lit(rules.separator)) >= rules.separators, "navigation")
        .when(_n_symbols(line) * 100 > n * rules.symbol_percent, "symbols")
        .when(unclosed, "punctuation")
        .when(_has_phrase(F.lower(line), rules), "boilerplate")
    )


def _has_phrase(lower: Column, rules: LineRules) -> Column:
    out = F.lit(False)
    for p in rules.phrases:
        out = out | F.contains(lower, F.lit(p))
    return out


def line_quality(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, the cleaned text and the verdict in added columns, which replace columns of these names; all others stay.

    q_n_words, q_word_chars, q_n_symbols, q_n_dup_lines, q_n_repeat_words (long), q_base_failed, q_kept (boolean), q_n_lines, q_lost_lines,
    q_lost_words (long), q_clean_text. A null or empty text has no words: it fails the base rules and has an empty clean text. Rows are kept
    as they are, repeated or not; an empty table gives an empty table.
    """
    t, w, low, all_lines, bad = unused(docs, "t", "w", "low", "lines", "bad")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.withColumn(t, text).withColumn(w, _words(F.col(t))).withColumn(all_lines, F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(_WS_CHARS)) != ""))
    df = df.withColumn(low, F.lower(t))
    df = df.withColumn("q_n_words", F.size(w).cast("long"))
    df = df.withColumn("q_word_chars", F.length(F.regexp_replace(t, _WS, "")).cast("long"))
    df = df.withColumn("q_n_symbols", _n_symbols(F.col(t)).cast("long"))
    df = df.withColumn("q_n_dup_lines", (F.size(all_lines) - F.size(F.array_distinct(all_lines))).cast("long"))
    df = with_repeated_words(df, w, "q_n_repeat_words")
    # the test of the whole text stands outside the lambda, so it is made once for a text and not once for a line
    special = (F.col("q_n_symbols") > 0) | F.col(t).rlike(rules.separator) | _has_phrase(F.col(low), rules)
    failing = lambda plain: F.filter(all_lines, lambda x: line_verdict(x, rules, plain).isNotNull())
    df = df.withColumn(bad, F.when(special, failing(False)).otherwise(failing(True)))
    df = df.withColumn("q_n_lines", F.size(all_lines).cast("long")).withColumn("q_lost_lines", F.size(bad).cast("long"))
    df = df.withColumn("q_lost_words", F.aggregate(bad, F.lit(0), lambda acc, x: acc + F.size(_words(x))).cast("long"))
    df = df.withColumn("q_clean_text", F.when(F.size(bad) == 0, F.col(t)).otherwise(F.array_join(F.filter(F.split(t, "\n"), lambda x: (F.btrim(x, F.lit(_WS_CHARS)) == "") | line_verdict(x, rules).isNull()), "\n")))
    df = df.withColumn("q_base_failed", (F.col("q_n_words") < 50) | (100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words")))
    df = df.withColumn("q_kept", ~F.col("q_base_failed") & (100 * F.col("q_lost_words") <= rules.lost_percent * F.col("q_n_words")))
    return df.drop(t, w, low, all_lines, bad)
