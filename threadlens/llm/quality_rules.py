"""Quality rules as one projection (operator 4).

Counts and ratios of a text are native expressions; a table of thresholds is turned
into one boolean column. Nothing is shuffled and no user function runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words are runs of anything but these.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Frequent words of the languages in the corpus.
STOP_WORDS = {
    "de": "der die das und ist von zu in den mit nicht ein eine im auf für sich",
    "en": "the of and to in is that for it as was with be by on are this",
    "es": "de la que el en y a los se del las un por con una su para",
    "fr": "de la le et les des en un du une que est pour qui dans par sur",
}

# Rule table: measure, least and greatest value that passes (None: no bound).
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("n_words", 20, 1_000_000),
    ("mean_word_length", 1.5, 20),
    ("symbols_per_word", None, 0.2),
    ("shouting_ratio", None, 0.4),
    ("alphabetic_ratio", 0.6, None),
    ("stop_word_ratio", 0.03, None),
    ("dup_line_ratio", None, 0.5),
    ("ellipsis_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
]


def _without(text: Column, signs: str) -> Column:
    return F.translate(text, signs, "")


def measured(docs: DataFrame) -> DataFrame:
    """`doc_id` and all counts and measures of the text.

    Null text counts as empty: no words, every count and ratio 0.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("_t"))
    rows = rows.select(
        "doc_id",
        "_t",
        F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: _without(x, BLANKS) != "").alias("_l"),
    )
    hashed = F.transform("_w", lambda w: F.xxhash64(w))
    rows = rows.withColumn("_h", hashed)
    n = F.size("_h")
    places = F.when(
        n > WINDOW,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(1), n - (WINDOW - 1)),
                lambda i: F.struct(F.xxhash64(F.slice("_h", i, WINDOW)).alias("h"), i.alias("i")),
            )
        ),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    rows = rows.withColumn("_p", places)
    twice = F.sort_array(
        F.transform(
            F.filter(
                F.sequence(F.lit(1), F.greatest(F.size("_p"), F.lit(1))),
                lambda j: (F.get("_p", j - 1)["h"] == F.get("_p", j)["h"])
                | (F.get("_p", j - 1)["h"] == F.get("_p", j - 2)["h"]),
            ),
            lambda j: F.get("_p", j - 1)["i"],
        )
    )
    rows = rows.withColumn("_r", twice)
    repeated = F.aggregate(
        F.transform(
            "_r",
            lambda x, i: F.when(i == F.size("_r") - 1, WINDOW).otherwise(
                F.least(F.lit(WINDOW), F.get("_r", i + 1) - x)
            ),
        ),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    chars = F.length("_t")
    lines = F.size("_l")
    stops = F.array(*(F.lit(w) for w in sorted({w for x in STOP_WORDS.values() for w in x.split()})))

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    return rows.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(_without(F.col("_t"), BLANKS)).cast("long").alias("word_chars"),
        (chars - F.length(_without(F.col("_t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (lines - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        lines.cast("long").alias("n_lines"),
        F.size(F.filter("_w", lambda w: w.rlike(r"\p{L}"))).alias("_alpha"),
        F.size(F.filter("_w", lambda w: (F.length(w) > 2) & (w == F.upper(w)) & (w != F.lower(w)))).alias("_loud"),
        # No stop word is longer than six letters with a sign after it.
        F.size(
            F.filter(
                "_w", lambda w: (F.length(w) <= 6) & F.array_contains(stops, F.lower(F.translate(w, ".,;:!?", "")))
            )
        ).alias("_stops"),
        F.size(F.filter("_l", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("_dots"),
        F.size(F.filter("_l", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•‣]"))).alias("_bullets"),
    ).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_length"),
        ratio(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
        ratio(F.col("_alpha"), F.col("n_words")).alias("alphabetic_ratio"),
        ratio(F.col("_loud"), F.col("n_words")).alias("shouting_ratio"),
        ratio(F.col("_stops"), F.col("n_words")).alias("stop_word_ratio"),
        ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        ratio(F.col("_dots"), F.col("n_lines")).alias("ellipsis_line_ratio"),
        ratio(F.col("_bullets"), F.col("n_lines")).alias("bullet_line_ratio"),
    )


def compiled(thresholds: list[tuple[str, float | None, float | None]]) -> Column:
    """The names of the rules that a row breaks."""
    broken = []
    for name, least, most in thresholds:
        bad = F.lit(False)
        if least is not None:
            bad = bad | (F.col(name) < least)
        if most is not None:
            bad = bad | (F.col(name) > most)
        broken.append(F.when(bad, F.lit(name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judge_rules(
    docs: DataFrame,
    thresholds: list[tuple[str, float | None, float | None]] = THRESHOLDS,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
) -> DataFrame:
    """All measures of each text, `base_failed`, `broken` (rules) and `kept`.

    One row per input row, also for repeated rows and rows without `doc_id`; other
    columns are ignored. Null and empty texts have no words and fail the base.
    """
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (
        measured(docs)
        .withColumn("base_failed", base)
        .withColumn("broken", compiled(thresholds))
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
    )
