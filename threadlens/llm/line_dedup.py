"""Repeated passages of lines, later copies deleted (operator 1).

All documents together are one sequence of line ids. Its suffixes are sorted by
distributed prefix doubling: ranks of runs of 1, 2, 4, ... lines come from sorting the
distinct pairs of ranks one step below, and a run that occurs once drops out. Two
suffixes share 2^k lines exactly when their ranks of step k are equal, so a pair of
ranks names the longest-common-prefix interval of any depth between two steps.

A run of lines counts as repeated if it has at least `min_words` words. Every maximal
repeated run of that size is the union of its shortest sub-runs of that size that
begin or end at each of its lines; only those are looked up, and they have at most
`min_words` lines. The suffixes therefore have to be sorted to that depth only, in
log2(min_words) steps at most, however long the repeated passages are. In each
interval the occurrence that comes first (by document id, then text hash, then line)
stays, and lines that any other occurrence covers are deleted.

Everything is DataFrame work. Ranks are the ascending ids of range-sorted pairs, with
one row per distinct pair, so a line that fills a third of the corpus is one row there;
joins back to positions are ordinary ones, whose skewed partitions Spark splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.storage import stored

MIN_WORDS = 50
BLANKS = " \t\n\x0b\f\r"
_NO_ID = -(1 << 63)


def _keys(doc_id: Column, text: Column) -> list[Column]:
    """What tells documents apart; rows equal in both are one document."""
    return [F.coalesce(doc_id.cast("long"), F.lit(_NO_ID)).alias("_d"), F.xxhash64(text).alias("_t")]


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line with a word: its number among those, 96 bits of hash, words."""
    text = F.col("text").cast("string")
    rows = docs.where(text.isNotNull()).select(*_keys(F.col("doc_id"), text), F.split(text, "\n").alias("_all"))
    with_words = F.filter(F.transform("_all", lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")
    lines = rows.select("_d", "_t", F.posexplode(with_words).alias("_m", "_line"))
    return lines.select(
        "_d",
        "_t",
        "_m",
        F.xxhash64("_line").alias("_h"),
        F.hash("_line").alias("_g"),
        F.regexp_count("_line", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("_w"),
    )


def _ranked(rows: DataFrame, names: list[str]) -> DataFrame:
    """Distinct values that occur twice or more, with ascending ranks."""
    twice = rows.groupBy(*names).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    ordered = twice.repartitionByRange(*names).sortWithinPartitions(*names)
    return stored(ordered.withColumn("_rank", F.monotonically_increasing_id()), "ranks")


def _repeated(lines: DataFrame) -> DataFrame:
    """Positions of lines that occur twice or more, with the rank of the line.

    Rows: `_d`, `_t`, `_seg` (stretch of neighbouring repeated lines of a document),
    `_m`, `_w`, `_rank`.
    """
    rows = lines.join(_ranked(lines, ["_h", "_g"]), ["_h", "_g"])
    # Rows that repeat a whole document are one document.
    rows = rows.repartition("_d", "_t").dropDuplicates(["_d", "_t", "_m"])
    order = Window.partitionBy("_d", "_t").orderBy("_m")
    rows = rows.withColumn("_seg", F.col("_m") - F.row_number().over(order))
    return stored(rows.select("_d", "_t", "_seg", "_m", "_w", "_rank"), "suffixes")


def suffix_ranks(first: DataFrame, depth: int) -> list[DataFrame]:
    """For all 2^k <= depth: positions with the rank of the run of 2^k lines there.

    Positions whose run occurs once are left out.
    """
    levels, step = [first], 1
    while 2 * step <= depth:
        ahead = Window.partitionBy("_d", "_t", "_seg").orderBy("_m").rangeBetween(step, step)
        pairs = levels[-1].withColumn("_next", F.max("_rank").over(ahead)).where("_next is not null")
        pairs = pairs.withColumnRenamed("_rank", "_here")
        ranks = _ranked(pairs, ["_here", "_next"])
        levels.append(stored(pairs.join(ranks, ["_here", "_next"]).drop("_here", "_next"), "suffixes"))
        step *= 2
    return levels


def _shortest_runs(first: DataFrame, min_words: int) -> DataFrame:
    """The shortest runs of `min_words` words that begin or end at each position."""
    segment = Window.partitionBy("_d", "_t", "_seg")
    up_to = segment.orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    rows = first.withColumn("_end", F.sum("_w").over(up_to)).withColumn("_begin", F.col("_end") - F.col("_w"))
    on = segment.orderBy("_begin").rangeBetween(0, min_words - 1)
    back = segment.orderBy("_end").rangeBetween(-(min_words - 1), 0)
    rows = rows.select(
        "_d", "_t", "_m",
        F.count("*").over(on).alias("_on"), (F.max("_end").over(on) - F.col("_begin")).alias("_on_words"),
        F.count("*").over(back).alias("_back"), (F.col("_end") - F.min("_begin").over(back)).alias("_back_words"),
    )
    runs = F.array_compact(
        F.array(
            F.when(F.col("_on_words") >= min_words, F.struct(F.col("_m").cast("long").alias("s"), F.col("_on").alias("n"))),
            F.when(
                F.col("_back_words") >= min_words,
                F.struct((F.col("_m") - F.col("_back") + 1).alias("s"), F.col("_back").alias("n")),
            ),
        )
    )
    runs = rows.select("_d", "_t", F.explode(F.array_distinct(runs)).alias("_r"))
    return runs.select("_d", "_t", F.col("_r.s").alias("_s"), F.col("_r.n").alias("_len"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Lines to delete: `_d`, `_t` and `_gone`, their numbers among lines with words."""
    lines = stored(_lines(docs), "lines")
    first = _repeated(lines)
    runs = stored(_shortest_runs(first, min_words), "runs")
    levels = suffix_ranks(first, runs.agg(F.max("_len")).first()[0] or 1)
    named = []
    for k, level in enumerate(levels):
        own = runs.where(F.floor(F.log2("_len")) == k)
        at = level.select("_d", "_t", F.col("_m").cast("long").alias("_s"), F.col("_rank").alias("_a"))
        own = own.join(at, ["_d", "_t", "_s"])
        if k == 0:
            own = own.withColumn("_b", F.col("_a"))
        else:
            tail = level.select("_d", "_t", F.col("_m").cast("long").alias("_u"), F.col("_rank").alias("_b"))
            own = own.withColumn("_u", F.col("_s") + F.col("_len") - (1 << k)).join(tail, ["_d", "_t", "_u"]).drop("_u")
        named.append(own)
    interval = ["_len", "_a", "_b"]
    found = stored(reduce(DataFrame.unionByName, named), "intervals").dropDuplicates(["_d", "_t", "_s", "_len"])
    place = F.struct("_d", "_t", "_s")
    kept = found.groupBy(*interval).agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    later = found.join(kept, interval).where(place != F.col("_first"))
    gone = later.select("_d", "_t", F.explode(F.sequence("_s", F.col("_s") + F.col("_len") - 1)).alias("_m"))
    return gone.groupBy("_d", "_t").agg(F.collect_set(F.col("_m").cast("int")).alias("_gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, report: bool = False) -> DataFrame:
    """The documents without later copies of repeated passages.

    A passage is a run of whole lines with `min_words` words or more (words are cut at
    ASCII blanks; outer blanks of a line do not count; lines without words are passed
    over). Only `text` changes (and `n_chars`, if there); a text that loses nothing stays
    as it is, one that loses all its words becomes empty. With `report`, `n_lines` (with
    words) and `n_removed` come along.

    Null and empty texts have no lines. Rows without `doc_id` come before all others.
    Rows that repeat a `doc_id` with another text are different documents; rows equal in
    both are one document and get the same result. An empty table stays empty. Other
    columns, whatever their names, are kept.
    """
    inner = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    at, key = inner["text"], inner["doc_id"]
    text = F.col(at).cast("string")
    gone = repeated_lines(docs.select("doc_id", "text"), min_words)
    rows = docs.toDF(*inner.values()).select("*", *_keys(F.col(key), text)).join(gone, ["_d", "_t"], "left")
    lines = F.split(text, "\n")
    rows = rows.withColumn("_lines", F.when(F.col("_gone").isNotNull(), lines))
    numbers = F.sequence(F.lit(0), F.size("_lines") - 1)
    worded = F.filter(numbers, lambda i: F.btrim(F.get("_lines", i), F.lit(BLANKS)) != "")
    rows = rows.withColumn("_worded", F.when(F.col("_gone").isNotNull(), worded))
    left = F.array_except(numbers, F.transform("_gone", lambda m: F.get("_worded", m)))
    new = F.when(F.size("_gone") == F.size("_worded"), "").otherwise(
        F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    )
    rows = rows.withColumn("_new", F.when(F.col("_gone").isNotNull(), new).otherwise(text))
    out = []
    for name, own in inner.items():
        kind = docs.schema[name].dataType
        if name == "text":
            out.append(F.col("_new").cast(kind).alias(name))
        elif name == "n_chars":
            changed = F.when(F.col("_gone").isNotNull(), F.length("_new").cast(kind)).otherwise(F.col(own))
            out.append(changed.alias(name))
        else:
            out.append(F.col(own).alias(name))
    if report:
        with_words = F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)) != "")
        out.append(F.coalesce(F.size(with_words), F.lit(0)).cast("long").alias("n_lines"))
        out.append(F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"))
    return rows.select(*out)
