"""Documents packed into sequences of fixed length as a cutting-stock problem (operator 2).

Tasks encode texts and keep piece lengths only. Their histogram (at most
`length / unit` classes, whatever the number of documents) goes to the driver, where
column generation solves the linear program over patterns: a pattern is a multiset
of classes that fits a sequence, and a knapsack recursion finds the pattern that the
current prices favour most. Rounded down, each pattern gets a number of sequences;
what rounding leaves over (a few pieces per pattern) is packed largest first. Pieces
are ranked within their class across tasks, and a rank leads to a pattern, a sequence
and a place in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.encoding import encoder, runs_of
from threadlens.storage import stored

LENGTH = 4096
# Lengths are told apart in steps of so many ids; half of it is lost per piece.
UNIT = 16
# About so many pieces share one rank bucket.
BUCKET = 2_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(file: str, length: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for batch in batches:
            done = 0
            for run in runs_of(batch["text"]):
                ids, ends = encoder(file).encode(run)
                keys = batch["doc_id"].slice(done, len(run)).to_pylist()
                done += len(run)
                rows = []
                before = 0
                for key, stop in zip(keys, ends):
                    own = np.concatenate([ids[before:stop], end])
                    before = stop
                    for at in range(0, len(own), length):
                        piece = own[at : at + length]
                        rows.append((key, at, len(piece), zlib.crc32(piece.tobytes()), len(own)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                )

    return cut


def pieces_of(docs: DataFrame, file: str, length: int = LENGTH, end_id: int = 2) -> DataFrame:
    """Each text as pieces of at most `length` ids, the last one with `end_id`."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_cut(file, length, end_id), PIECES)


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity that is worth most at these prices."""
    worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = np.searchsorted(sizes, room, "right")
        worth[room] = worth[room - 1]
        if fits:
            with_each = worth[room - sizes[:fits]] + prices[:fits]
            at = int(with_each.argmax())
            if with_each[at] > worth[room]:
                worth[room], last[room] = with_each[at], at
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            pattern[last[room]] += 1
            room -= sizes[last[room]]
    return float(worth[capacity]), pattern


def cutting_plan(demand: dict[int, int], capacity: int, rounds: int = 4000) -> list[tuple[dict[int, int], int]]:
    """Patterns (class to count) and how often each is used; covers the demand exactly.

    Column generation with a basis inverse that is updated in place. Every basis is
    feasible, so a run that ends at `rounds` still gives a valid plan.
    """
    sizes = np.array(sorted(c for c, n in demand.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    needed = np.array([demand[c] for c in sizes.tolist()], float)
    basis = np.diag(capacity // sizes).astype(np.int64)
    inverse = np.diag(1.0 / (capacity // sizes))
    used = inverse @ needed
    for number in range(rounds):
        worth, pattern = best_pattern(inverse.sum(axis=0), sizes, capacity)
        if worth <= 1 + 1e-7:
            break
        step = inverse @ pattern
        able = step > 1e-9
        limits = np.full(len(sizes), np.inf)
        limits[able] = used[able] / step[able]
        leaving = int(limits.argmin())
        used = np.maximum(used - limits[leaving] * step, 0)
        used[leaving] = limits[leaving]
        basis[:, leaving] = pattern
        row = inverse[leaving] / step[leaving]
        inverse = inverse - np.outer(step, row)
        inverse[leaving] = row
        if number % 200 == 199:
            inverse = np.linalg.inv(basis.astype(float))
            used = np.maximum(inverse @ needed, 0)
    left = needed.astype(np.int64)
    plan = []
    for column, times in sorted(zip(basis.T.tolist(), np.floor(used + 1e-6).astype(np.int64).tolist()), reverse=True):
        pattern = np.array(column)
        times = min([times, *(left[pattern > 0] // pattern[pattern > 0]).tolist()])
        if times > 0:
            left -= pattern * times
            plan.append(({int(c): int(n) for c, n in zip(sizes, pattern) if n}, int(times)))
    while left.any():
        room, pattern = capacity, {}
        for at in reversed(range(len(sizes))):
            n = min(int(left[at]), room // int(sizes[at]))
            if n:
                pattern[int(sizes[at])] = n
                room -= n * int(sizes[at])
        times = min(int(left[np.searchsorted(sizes, c)]) // n for c, n in pattern.items())
        for c, n in pattern.items():
            left[np.searchsorted(sizes, c)] -= n * times
        plan.append((pattern, times))
    return plan


def pack(pieces: DataFrame, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """Give each piece a `sequence_id` and an `offset`, gapless from 0 in its sequence.

    `pieces` must be a stored table (it is read three times) with `doc_id`, `start`,
    `length` (1 to `length`); other columns come along.
    """
    spark = pieces.sparkSession
    buckets = max(64, pieces.count() // BUCKET)
    sized = pieces.withColumn("_class", F.ceil(F.col("length") / unit).cast("int")).withColumn(
        "_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int")
    )
    counts = sized.groupBy("_class", "_bucket").agg(F.count("*").alias("_n"))
    # At most length/unit rows.
    demand = {r["_class"]: r["n"] for r in sized.groupBy("_class").agg(F.count("*").alias("n")).collect()}
    rows, first, taken = [], 0, dict.fromkeys(demand, 0)
    for pattern, times in cutting_plan(demand, length // unit):
        for size, each in pattern.items():
            rows.append((size, taken[size], taken[size] + each * times, each, first))
            taken[size] += each * times
        first += times
    # Bounded by classes and patterns (length/unit of each), not by the input.
    plan = spark.createDataFrame(rows, "_class int, _from long, _to long, _each long, _first long")
    earlier = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = Window.partitionBy("_class", "_bucket").orderBy("doc_id", "start")
    ranked = (
        sized.withColumn("_rank", F.row_number().over(within))
        .join(before, ["_class", "_bucket"])
        .withColumn("_rank", F.col("_rank") + F.col("_before") - 1)
    )
    placed = ranked.join(
        F.broadcast(plan.withColumnRenamed("_class", "_planned")),
        (F.col("_class") == F.col("_planned")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")),
    ).withColumn("sequence_id", F.expr("_first + (_rank - _from) div _each"))
    slot = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(slot), F.lit(0))).select(
        *pieces.columns, "sequence_id", "offset"
    )


def pack_documents(docs: DataFrame, file: str, length: int = LENGTH, unit: int = UNIT, end_id: int = 2) -> DataFrame:
    """Pack all documents into sequences of at most `length` ids.

    Columns: `doc_id`, `start` (ids of the document before the piece), `length`,
    `ids_crc32` (of the piece's little-endian unsigned 32-bit ids), `doc_tokens`,
    `sequence_id`, `offset`. Null and empty texts are one piece, the end id. Longer
    documents are cut every `length` ids. Rows that repeat a document, or lack a
    `doc_id`, are packed each for itself. An empty table gives no rows. Other columns
    are ignored.
    """
    return pack(stored(pieces_of(docs, file, length, end_id), "pieces"), length, unit)
