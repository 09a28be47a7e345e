"""The language of a text by string kernels (operator 8).

Two texts are as alike as the sets of character n-grams they share: for each length
from one to three the size of the intersection over the geometric mean of both sizes,
summed up (a blended spectrum of presences). A bounded sample of the labelled texts
gives Nyström landmarks and the one-versus-rest kernel ridge regression; a task turns
a batch of texts into presence vectors and scores it with two matrix products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.encoding import runs_of
from threadlens.llm.quality_classifier import held_out

# n-grams of 1, 2, 3 characters are told apart up to so many bits of their hash.
BITS = (10, 13, 15)
STARTS = np.cumsum([0, *(1 << b for b in BITS)])
# Labelled texts to fit on, all languages together (at least 20 of each, as far as there are).
SAMPLE = 2_000
LANDMARKS = 192
RIDGE = 1e-2
BATCH = 64

PREDICTION = "doc_id long, lang_pred string, score double"


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Letters to their lower case, everything else to a blank."""
    table = np.full(0x110000, 0x20, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def presence(text: str | None) -> np.ndarray | None:
    """Which n-gram buckets occur; nothing for a text without letters."""
    if not text:
        return None
    codes = _folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
    letters = codes != 32
    if not letters.any():
        return None
    # A run of other characters is one blank.
    codes = codes[letters | np.concatenate([[True], letters[:-1]])]
    out = np.zeros(STARTS[-1], bool)
    gram = np.zeros(len(codes), np.uint64)
    for n, bits in enumerate(BITS):
        gram = gram[: len(codes) - n] * np.uint64(0x110000) + codes[n:]
        out[STARTS[n] + ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)] = True
    return out


def _weighted(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Those columns of presences, divided by the root of their number for each n-gram length."""
    out = rows[:, columns].astype(np.float32)
    cuts = np.searchsorted(columns, STARTS)
    for (a, b), (x, y) in zip(zip(STARTS, STARTS[1:]), zip(cuts, cuts[1:])):
        out[:, x:y] /= np.sqrt(np.maximum(np.count_nonzero(rows[:, a:b], axis=1), 1))[:, None]
    return out


class KernelRidge:
    """One-versus-rest ridge regression on Nyström features."""

    def __init__(self, rows: np.ndarray, langs: list[str], landmarks: int = LANDMARKS):
        self.langs = sorted(set(langs))
        # Landmarks in turn from each language, in sample order.
        turns = {x: [i for i, y in enumerate(langs) if y == x] for x in self.langs}
        chosen = [turns[x][k] for k in range(len(langs)) for x in self.langs if k < len(turns[x])][:landmarks]
        self.columns = np.flatnonzero(rows[chosen].any(axis=0))
        weighted = _weighted(rows, self.columns)
        self.marks = np.ascontiguousarray(weighted[chosen].T)
        kernel = self.marks.T.astype(float) @ self.marks
        values, vectors = np.linalg.eigh(kernel)
        good = values > values[-1] * 1e-6
        root = vectors[:, good] / np.sqrt(values[good])
        features = (weighted @ self.marks) @ root
        targets = np.array([[1.0 if x == y else -1.0 for y in self.langs] for x in langs])
        size = features.shape[1]
        self.mean = targets.mean(axis=0)
        solved = np.linalg.solve(features.T @ features + RIDGE * len(langs) / 100 * np.eye(size), features.T @ (targets - self.mean))
        self.weights = (root @ solved).astype(np.float32)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return (_weighted(rows, self.columns) @ self.marks) @ self.weights + self.mean


def _presences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [presence(x) for x in batch["text"].to_pylist()]
        packed = [None if b is None else np.packbits(b).tobytes() for b in bits]
        yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(packed, pa.binary())], names=["lang", "bits"])


def fit_languages(labelled: DataFrame, sample: int = SAMPLE) -> KernelRidge | None:
    """Fit on a bounded sample of rows with `doc_id`, `text` and `lang`.

    The sample takes about as many texts of each language, chosen by a hash of the
    row; only their n-gram bit sets (5 kB each) reach the driver. None: no text with
    letters has a language.
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", F.col("lang").cast("string"), "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = max(20, sample // len(counts))
    # Of languages with fewer texts, all are taken.
    odds = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, share / n))))
    draw = F.pmod(F.xxhash64("doc_id", "lang", F.length("text")), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(draw < odds[F.col("lang")]).select("lang", "text")
    found = [r for r in drawn.mapInArrow(_presences, "lang string, bits binary").collect() if r["bits"]]
    found.sort(key=lambda r: (r["lang"], bytes(r["bits"])))
    if not found:
        return None
    order = np.random.default_rng(7).permutation(len(found))
    bits = np.zeros((len(found), STARTS[-1]), bool)
    for at, i in enumerate(order):
        bits[at] = np.unpackbits(np.frombuffer(found[i]["bits"], np.uint8), count=STARTS[-1])
    return KernelRidge(bits, [found[i]["lang"] for i in order])


def _predict(model: KernelRidge | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, certain = [], []
            for run in runs_of(batch["text"]):
                texts = run.to_pylist()
                for at in range(0, len(texts), BATCH):
                    bits = [presence(x) if model else None for x in texts[at : at + BATCH]]
                    some = [i for i, b in enumerate(bits) if b is not None]
                    own, odds = ["und"] * len(bits), [0.0] * len(bits)
                    if some:
                        values = model.scores(np.stack([bits[i] for i in some])).astype(float)
                        chance = np.exp(4 * (values - values.max(axis=1, keepdims=True)))
                        chance /= chance.sum(axis=1, keepdims=True)
                        for i, best, row in zip(some, values.argmax(axis=1), chance):
                            own[i], odds[i] = model.langs[best], float(row[best])
                    names += own
                    certain += odds
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(names, pa.string()), pa.array(certain, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return predict


def identify_languages(docs: DataFrame, parts: int = 4, which: int = 2, sample: int = SAMPLE) -> DataFrame:
    """`doc_id`, `held_out`, `lang_pred` and `score` (0 to 1) of every whole text.

    Learns from rows outside the held-out part that have a language. `und` with score
    0: the text is null or has no letter, or there was nothing to learn from. One row
    per input row, also for repeated rows and rows without `doc_id`. Equal scores go
    to the language that sorts first. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    model = fit_languages(rows.where(~held_out(parts, which)), sample)
    found = rows.select("doc_id", "text").mapInArrow(_predict(model), PREDICTION)
    return found.select("doc_id", held_out(parts, which).alias("held_out"), "lang_pred", "score")
