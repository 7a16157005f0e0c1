"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
WINDOW = 8

# Frequent function words; a text in one of these languages has many of them.
STOP_WORDS = {
    "en": "the and of to a in is that it for on with as was be by at this from are or an not",
    "de": "der die das und in den von zu mit sich des auf ein eine im dem nicht ist als auch für",
    "fr": "de la le et les des en un une du est que dans pour par sur pas au avec ce qui",
    "es": "de la que el en y los se del las un por con no una su para es al lo como",
}


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [low, high]; a NULL metric passes."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        value, ok = F.expr(self.metric), F.lit(True)
        if self.low is not None:
            ok = ok & (value >= self.low)
        if self.high is not None:
            ok = ok & (value <= self.high)
        return F.coalesce(ok, F.lit(True))


RULES = (
    Rule("word_length", "word_chars / nullif(n_words, 0)", 2.0, 14.0),
    Rule("symbols", "n_symbols / nullif(n_words, 0)", high=0.2),
    Rule("stop_words", "n_stop_words / nullif(n_words, 0)", low=0.02),
    Rule("echoes", "n_echoes / nullif(n_words, 0)", high=0.3),
    Rule("shouting", "n_marks / nullif(n_words, 0)", high=0.5),
    Rule("duplicate_lines", "n_dup_lines / nullif(n_lines, 0)", high=0.5),
    Rule("repeated_words", "n_repeat_words / nullif(n_words, 0)", high=0.3),
)


def _window_hashes(seed: int) -> Column:
    """Hashes of the 8-word windows by doubling: of 1, 2, 4 and 8 words, each from two of the half length."""
    hashes = F.transform("_words", lambda w: F.xxhash64(w, F.lit(seed)))
    for step in (1, 2, 4):
        hashes = _doubled(hashes, step)
    return F.slice(hashes, 1, F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0)))


def _doubled(hashes: Column, step: int) -> Column:
    # The array is bound to a variable, so that it is made once and not once for each element.
    whole = F.transform(F.array(hashes), lambda a: F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + step))))
    return F.get(whole, F.lit(0))


def _repeat_words() -> Column:
    """Words covered by the 8-word windows that occur twice or more.

    ``_windows`` holds two independent 64-bit hashes per window. Sorting them brings equal windows together; the sorted
    positions of those cover ``least(8, gap to the next)`` words each, and the last covers 8.
    """
    return F.expr(f"""
        CASE WHEN NOT _twice THEN 0L
        ELSE aggregate(
            array_sort(transform(
                filter(_sorted, (x, i) ->
                    (i > 0 AND _sorted[i - 1].h = x.h AND _sorted[i - 1].g = x.g)
                    OR (i + 1 < size(_sorted) AND _sorted[i + 1].h = x.h AND _sorted[i + 1].g = x.g)),
                x -> x.at)),
            named_struct('n', 0L, 'last', CAST(NULL AS INT)),
            (acc, at) -> named_struct(
                'n', acc.n + coalesce(least({WINDOW}, at - acc.last), {WINDOW}), 'last', at),
            acc -> acc.n)
        END""")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the metric columns; see ``quality``."""
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    whole = F.coalesce(F.col(text), F.lit(""))

    def without(chars: str) -> Column:
        return F.translate(F.col("_text"), chars, "")

    length = F.length("_text")
    return (
        docs.withColumn("_text", whole)
        .withColumn("_words", F.expr(r"array_remove(split(_text, '[ \\t-\\r]+'), '')"))
        .withColumn("_lines", F.expr(r"filter(split(_text, '\\n'), l -> l rlike '[^ \\t-\\r]')"))
        .withColumn("_hashes", _window_hashes(1))
        .withColumn("_twice", F.expr("size(_hashes) > size(array_distinct(_hashes))"))
        .withColumn("_others", F.when(F.col("_twice"), _window_hashes(2)))
        .withColumn("_sorted", F.expr(
            "CASE WHEN _twice THEN array_sort(transform(zip_with(_hashes, _others, (h, g) -> named_struct('h', h, 'g', g)), "
            "(x, i) -> named_struct('h', x.h, 'g', x.g, 'at', i))) END"))
        # Through a generator no filter on a metric is pushed, which would repeat its expression inside the lambdas above.
        .select(*docs.columns, F.inline(F.array(F.struct(
            F.size("_words").cast("bigint").alias("n_words"),
            F.length(without(BLANKS)).cast("bigint").alias("word_chars"),
            (length - F.length(without(SYMBOLS))).cast("bigint").alias("n_symbols"),
            F.size("_lines").cast("bigint").alias("n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
            _repeat_words().alias("n_repeat_words"),
            F.size(F.filter("_words", lambda w: F.lower(w).isin(stop))).cast("bigint").alias("n_stop_words"),
            F.size(F.filter("_words", lambda w, i: w == F.get("_words", i - 1))).cast("bigint").alias("n_echoes"),
            (length - F.length(without("!"))).cast("bigint").alias("n_marks"),
        ))))
    )


METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_echoes", "n_marks")


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 20, text: str = "text") -> DataFrame:
    """``docs`` with metrics, ``base_failed``, ``failed`` (names of the broken rules) and ``kept``.

    Metrics count code points, words and lines of the whole text: words are runs without blank or 0x09-0x0D,
    ``n_symbols`` counts ``#*$%&|<>``, ``n_dup_lines`` the lines with a word that equal an earlier one,
    ``n_repeat_words`` the words inside 8-word windows found twice or more. ``base_failed`` holds for fewer than
    ``min_words`` words or more than 30 % repeated words. NULL and empty texts have zeros and fail. Repeated rows are
    judged alike; columns of ``docs`` that bear a metric's name are replaced. There is no shuffle and no user function.
    """
    clash = {*METRICS, "base_failed", "failed", "kept"}
    known = measured(docs.drop(*(c for c in docs.columns if c in clash and c != text)), text)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    broken = F.array_compact(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules]))
    return known.withColumn("base_failed", base).withColumn("failed", broken).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed") == 0))
