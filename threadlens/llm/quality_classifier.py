"""A quality score from document statistics (operator 3).

Statistics of the whole text are native expressions and are stored once. A
regularised quadratic discriminant is fitted from per-class sums over all labelled
rows (the filtering stage takes a bounded sample of them): each class covariance is shrunk towards the pooled one and that towards its
diagonal. The score is the difference of the two log densities, written out as one
native expression with the inverse Cholesky factors as constants.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.storage import stored

BLANKS = " \t\n\x0b\f\r"
#: Share of the pooled covariance in each class, and of its diagonal in the pooled one.
TO_POOLED = 0.1
TO_DIAGONAL = 0.1
#: Added to each variance, so that a constant statistic does no harm.
FLOOR = 1e-3
#: A share or mean of zero counts as this before its logarithm is taken.
LEAST = 1e-3
#: Labelled ids that `keep_quality` learns from at most.
FIT_SAMPLE = 20_000

STATISTICS = [
    "words", "word_length", "signs", "marks", "capitals", "digits", "distinct", "echoes", "line_words", "sentence_words", "bars",
]


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep and the transformed statistics; null text counts as empty.

    All but the word count are logarithms of shares or means, 0 words giving shares
    of 0.
    """
    rows = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    rows = rows.withColumn("_w", F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != ""))

    def count(signs: str) -> Column:
        return F.length("_t") - F.length(F.translate("_t", signs, ""))

    n, chars = F.size("_w"), F.length(F.translate("_t", BLANKS, ""))

    def share(part: Column, whole: Column) -> Column:
        return F.log(F.when(whole > 0, part / whole).otherwise(0.0) + LEAST)

    return rows.select(
        *keep,
        F.log1p(n).alias("words"),
        share(chars, n).alias("word_length"),
        share(count("#*$%&<>@^~=+\\_{}[]"), chars).alias("signs"),
        share(count(".,;:!?"), n).alias("marks"),
        share(F.length("_t") - F.length(F.regexp_replace("_t", r"\p{Lu}", "")), chars).alias("capitals"),
        share(count("0123456789"), chars).alias("digits"),
        share(F.size(F.array_distinct("_w")), n).alias("distinct"),
        share(F.size(F.filter("_w", lambda w, i: w == F.get("_w", i - 1))), n).alias("echoes"),
        share(n, F.length("_t") - F.length(F.translate("_t", "\n", "")) + 1).alias("line_words"),
        share(n, count(".!?") + 1).alias("sentence_words"),
        share(count("|"), n).alias("bars"),
    )


@dataclass
class Discriminant:
    """Two Gaussians: means, inverse Cholesky factors and what is added to the logit."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    bias: float

    def logit(self) -> Column:
        """Log density of class 1 minus that of class 0 with the prior, per row."""
        halves = []
        for mean, factor in zip(self.means, self.factors):
            square = F.lit(0.0)
            for row in factor:
                inner = F.lit(float(-(row @ mean)))
                for name, weight in zip(STATISTICS, row):
                    if weight != 0:
                        inner = inner + F.col(name) * float(weight)
                square = square + inner * inner
            halves.append(square / 2)
        return halves[0] - halves[1] + self.bias


def fit(labelled: DataFrame, target: str = "quality") -> Discriminant | float:
    """Fit on rows with all statistics and the label 0 or 1.

    Only sums leave the tasks. With fewer than two rows of a class there is nothing
    to fit: the smoothed share of label 1 is returned instead.
    """
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = labelled.groupBy(F.col(target).cast("int").alias("_label")).agg(
        F.count("*").alias("_n"),
        *(F.sum(x).alias(f"_s{i}") for i, x in enumerate(STATISTICS)),
        *(F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"_p{i}_{j}") for i, j in pairs),
    )
    found = {r["_label"]: r for r in sums.where("_label in (0, 1)").collect()}
    sizes = [found[k]["_n"] if k in found else 0 for k in (0, 1)]
    if min(sizes) < 2:
        return (sizes[1] + 1) / (sum(sizes) + 2)
    means, covariances = [], []
    for k in (0, 1):
        row, n = found[k], sizes[k]
        mean = np.array([row[f"_s{i}"] for i in range(d)]) / n
        products = np.zeros((d, d))
        for i, j in pairs:
            products[i, j] = products[j, i] = row[f"_p{i}_{j}"]
        means.append(mean)
        covariances.append((products - n * np.outer(mean, mean)) / (n - 1))
    pooled = sum((n - 1) * c for n, c in zip(sizes, covariances)) / (sum(sizes) - 2)
    pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled))
    factors, bias = [], float(np.log(sizes[1] / sizes[0]))
    for sign, covariance in zip((1, -1), covariances):
        shrunk = (1 - TO_POOLED) * covariance + TO_POOLED * pooled + FLOOR * np.eye(d)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.tril(np.linalg.inv(lower)))
        bias += sign * float(np.log(np.diag(lower)).sum())
    return Discriminant(means, factors, bias)


def held_out(parts: int, which: int) -> Column:
    """Whether a row belongs to the part that is kept from learning; false without id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == which, F.lit(False))


def _score(model: Discriminant | float) -> Column:
    if isinstance(model, float):
        return F.lit(model)
    # The scale leaves the order and the sign alone and keeps scores apart near 0 and 1.
    return 1 / (1 + F.exp(-model.logit() / len(STATISTICS)))


def _known(labels: DataFrame) -> DataFrame:
    """`doc_id`, `quality` of every labelled id."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    )
    return known.agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))


def _learned(rows: DataFrame, labels: DataFrame, parts: int, which: int) -> Discriminant | float:
    """Fit on stored statistics of all labelled rows outside the held-out part."""
    return fit(rows.where(~held_out(parts, which)).join(_known(labels), "doc_id"))


def _learned_from_sample(
    docs: DataFrame, labels: DataFrame, parts: int, which: int, sample: int
) -> Discriminant | float:
    """Fit on at most `sample` labelled ids outside the held-out part, those whose hash is
    least: only their documents are measured for it."""
    known = _known(labels).where(~held_out(parts, which)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = stored(known, "labelled")
    ids = F.col("doc_id").cast("long").alias("doc_id")
    # No more keys than `sample`, whatever the size of the tables.
    chosen = docs.select(ids, "text").join(F.broadcast(known.select("doc_id")), "doc_id")
    return fit(stored(statistics(chosen), "statistics").join(F.broadcast(known), "doc_id"))


def _stored_statistics(docs: DataFrame) -> DataFrame:
    ids = F.col("doc_id").cast("long").alias("doc_id")
    return stored(statistics(docs.select(ids, "text")), "statistics")


def score_quality(docs: DataFrame, labels: DataFrame, parts: int = 3, which: int = 1) -> DataFrame:
    """`doc_id`, `held_out`, `score` (0 to 1, higher: label 1 likelier), `predicted`.

    Learns from labelled rows outside the held-out part (all of them; a row whose
    labels contradict each other takes the more frequent one, 1 in a tie; null labels
    do not count). One row per input row, also for repeated rows and rows without id,
    which no label reaches. Null and empty texts are scored like any other, from
    statistics of an empty text. Without labels of both kinds every score is the
    smoothed share of label 1. Other columns are ignored.
    """
    rows = _stored_statistics(docs)
    score = _score(_learned(rows, labels, parts, which))
    return rows.select("doc_id", held_out(parts, which).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def keep_quality(
    docs: DataFrame, labels: DataFrame, parts: int = 3, which: int = 1, sample: int = FIT_SAMPLE
) -> DataFrame:
    """The documents that score 0.5 or more, with their own columns, unchanged.

    Learns from at most `sample` labelled ids; the documents among them are measured
    first, and then all, where they lie, so that no text is moved.
    """
    model = _learned_from_sample(docs, labels, parts, which, sample)
    inner = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = statistics(docs.toDF(*inner.values()), inner["text"], tuple(inner.values()))
    # Generated columns are computed once; plain ones would be put into the score wherever
    # it names them.
    rows = rows.select(*inner.values(), F.inline(F.array(F.struct(*STATISTICS))))
    return rows.where(_score(model) >= 0.5).select(*(F.col(own).alias(c) for c, own in inner.items()))
