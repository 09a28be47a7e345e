"""Model stages as distributed batch inference.

A backend adds a model's reply to the rows that need one. `Replay` takes replies
from a table; `FunctionModel` calls a function the user brings.
"""

import sys
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.prompts import INSTRUCTIONS
from threadlens.schemas import REPLIES, STORED_REPLIES
from threadlens.storage import stored, table_or_empty

# Three tries, 4 to 10 seconds apart, on these errors only.
TRIES = 3
WAIT_SECONDS = (4, 10)
RETRIED_ERRORS = (ConnectionError, TimeoutError)

_ADDED = ["reply", "status", "error", "attempts"]

# Tasks get the helpers of this module together with the user's function, so
# executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Replay:
    """Replies known beforehand: `responses(post_id, stage, reply)`."""

    responses: DataFrame
    reads_prompts = False

    def attach(
        self, rows: DataFrame, stage: str, prompt: Column, needed: Column
    ) -> DataFrame:
        # Of several replies to one post the largest text counts.
        known = (
            self.responses.filter(F.col("stage") == stage)
            .groupBy("post_id")
            .agg(F.max("reply").alias("_reply"))
        )
        reply = F.when(needed, F.col("_reply"))
        found = F.col("_reply").isNotNull()
        return rows.join(known, "post_id", "left").withColumns(
            {
                f"{stage}_reply": reply,
                f"{stage}_status": F.when(
                    needed, F.when(found, "ok").otherwise("failed")
                ),
                f"{stage}_error": F.when(needed & ~found, F.lit("no reply known")),
                f"{stage}_attempts": F.when(needed, F.lit(1)),
            }
        ).drop("_reply")


@dataclass(frozen=True)
class FunctionModel:
    """A picklable `function(instruction, prompts) -> replies`, run in tasks.

    Prompts go out `batch_size` at a time. `partitions` sets how many tasks call
    the model at once; without it there are as many as shuffle partitions (or twice the
    cores, if that is more), however short the prompts. Replies are stored
    before anything reads them, so each action downstream reuses them. With
    `folder` they are kept there by `batch`, and only those prompts are asked that
    have no reply yet in this batch or in one of `earlier` (first and last).

    Spark repeats a lost task and with it the task's calls; leave
    `spark.speculation` off, which would repeat calls for slow tasks too.
    """

    function: Callable[[str, list[str]], list[str]]
    batch_size: int = 32
    partitions: int | None = None
    instructions: dict[str, str] = field(default_factory=lambda: dict(INSTRUCTIONS))
    tries: int = TRIES
    wait: tuple[float, float] = WAIT_SECONDS
    sleep: Callable[[float], None] = time.sleep
    folder: str | None = None
    batch: int = 0
    earlier: tuple[int, int] = (0, -1)
    reads_prompts = True

    def attach(
        self, rows: DataFrame, stage: str, prompt: Column, needed: Column
    ) -> DataFrame:
        # A filter, never `when(needed, udf)`: Spark may run a Python function
        # for rows outside its branch.
        prompts = rows.filter(needed).select("post_id", "round", prompt.alias("prompt"))
        replies = self._replies(prompts, stage).withColumnsRenamed(
            {name: f"{stage}_{name}" for name in _ADDED}
        )
        return rows.join(replies, ["post_id", "round"], "left")

    def _replies(self, prompts: DataFrame, stage: str) -> DataFrame:
        if self.folder is None:
            return stored(self._asked(prompts, stage), f"replies-{stage}")
        spark, path = prompts.sparkSession, f"{self.folder}/stage={stage}"
        mine = (F.col("batch") == self.batch) | F.col("batch").between(*self.earlier)
        known = table_or_empty(spark, path, STORED_REPLIES).filter(mine)
        missing = prompts.join(
            known.select("post_id", "round"), ["post_id", "round"], "left_anti"
        )
        self._asked(missing, stage).write.mode("append").parquet(
            f"{path}/batch={self.batch}"
        )
        return spark.read.schema(STORED_REPLIES).parquet(path).filter(mine).drop("batch")

    def _asked(self, prompts: DataFrame, stage: str) -> DataFrame:
        # An explicit number, which adaptive execution does not merge by bytes.
        spark = prompts.sparkSession
        usual = max(
            int(spark.conf.get("spark.sql.shuffle.partitions")),
            2 * spark.sparkContext.defaultParallelism,
        )
        prompts = prompts.repartition(self.partitions or usual, "post_id")
        function, instruction = self.function, self.instructions[stage]
        size, tries, wait, sleep = self.batch_size, self.tries, self.wait, self.sleep
        names, kinds = REPLIES.names, [pa.string(), pa.string(), pa.string(), pa.int32()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for start in range(0, len(rows), size):
                    part = rows.slice(start, size)
                    answers = ask(
                        lambda some: function(instruction, some),
                        part.column("prompt").to_pylist(),
                        tries,
                        wait,
                        sleep,
                    )
                    keys = [part.column("post_id"), part.column("round")]
                    added = [pa.array(list(v), k) for v, k in zip(zip(*answers), kinds)]
                    yield pa.RecordBatch.from_arrays(keys + added, names=names)

        return prompts.mapInArrow(run, REPLIES)


def ask(
    call: Callable[[list[str]], list[str]],
    prompts: list[str],
    tries: int = TRIES,
    wait: tuple[float, float] = WAIT_SECONDS,
    sleep: Callable[[float], None] = time.sleep,
) -> list[tuple[str | None, str, str | None, int]]:
    """Replies as `(reply, status, error, attempts)`, one per prompt.

    Connection errors and timeouts are tried again for the whole batch. Any
    other error is taken to stem from one of the prompts: each is then asked
    alone, so that it costs only its own row.
    """
    low, high = wait
    for attempt in range(1, tries + 1):
        try:
            replies = call(prompts)
            if len(replies) != len(prompts):
                raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
            return [(reply, "ok", None, attempt) for reply in replies]
        except RETRIED_ERRORS as error:
            failure = f"{type(error).__name__}: {error}"
            if attempt < tries:
                sleep(max(low, min(2 ** (attempt - 1), high)))
        except Exception as error:  # noqa: BLE001 - any error fails the row
            if len(prompts) > 1:
                alone = [ask(call, [p], tries, wait, sleep)[0] for p in prompts]
                return [(*row[:3], row[3] + attempt) for row in alone]
            return [(None, "failed", f"{type(error).__name__}: {error}", attempt)]
    return [(None, "failed", failure, tries)] * len(prompts)
