"""Exact copies found by a stateful stream with keyed state on disk.

Two streams read up to what is there and go on from there at the next call. The first
turns arriving files into a table of fingerprints: id, digest of the normalised text and
the place of the row (file and row number). The second keeps one entry of state per
digest, in RocksDB and without expiry: how many rows have it, and of the row that stays
its id and place. Only where a digest was met twice are texts read again, by their place,
and compared in full with the text of the row that stays.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal
texts the row with the largest `doc_id` stays (a null id is smaller than any other); of
rows that repeat one id and text, the one at the last place. Every row has its line in the
result, repeated ones too. Texts of any length are hashed and compared whole, an empty table
gives no rows, and other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.storage import exists, new_folder, stored

# Rows whose texts are compared are named to every executor up to this number of places
# (some 120 bytes each), and joined beyond.
BROADCAST_PLACES = 200_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Files as large as their content: with many small partitions room set aside adds up.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null is empty text."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())


def dedup_exact(docs: DataFrame, key_bits: int = 256) -> DataFrame:
    """`dedup_exact_files` of a table that is not at hand as files."""
    spark = docs.sparkSession
    path = new_folder(spark, "exact-input")
    docs.select("doc_id", "text").write.parquet(path)
    return dedup_exact_files(spark, path, key_bits=key_bits)


def dedup_exact_files(spark: SparkSession, path: str, folder: str | None = None, key_bits: int = 256) -> DataFrame:
    """`doc_id, keep_id, group_size, kept, text_sha256` of every row read so far.

    `path` holds Parquet files with `doc_id` and `text`. With a `folder` in the shared
    store a later call reads only files that have come since. `key_bits` shortens the
    digest that state is kept by; the full comparison keeps the result the same.
    """
    folder = folder or new_folder(spark, "exact")
    absorb(spark, path, folder, key_bits)
    return _result(spark, path, folder)


def kept_documents(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """The rows of the files that stay, with all their columns."""
    folder = folder or new_folder(spark, "exact")
    absorb(spark, path, folder)
    kept = stored(_judged(spark, path, folder).where("kept").select("_file", "_row"), "exact-kept")
    docs = spark.read.parquet(path)
    place = docs.metadataColumn("_metadata")
    names = docs.columns
    placed = docs.select(F.struct(*names).alias("_doc"), place["file_path"].alias("_file"), place["row_index"].alias("_row"))
    return placed.join(kept, ["_file", "_row"], "left_semi").select("_doc.*")


def absorb(spark: SparkSession, path: str, folder: str, key_bits: int = 256) -> None:
    """Take in the files that have arrived: fingerprints, then state."""
    arriving = spark.readStream.schema(spark.read.parquet(path).schema).parquet(_watched(spark, path))
    place = arriving.metadataColumn("_metadata")
    sha = F.sha2(normalised(F.col("text")), 256)
    prints = arriving.select(
        "doc_id",
        place["file_path"].alias("_file"),
        place["row_index"].alias("_row"),
        sha.alias("text_sha256"),
    )
    _run(
        prints.writeStream.format("parquet").option("path", f"{folder}/prints"),
        f"{folder}/progress-prints",
    )
    schema = prints.withColumn("_key", F.lit("")).schema
    known = spark.readStream.schema(prints.schema).parquet(f"{folder}/prints")
    state = (
        known.withColumn("_key", F.left("text_sha256", F.lit(key_bits // 4)))
        .select(*schema.names)
        .groupBy("_key")
        .agg(
            F.count("*").alias("_size"),
            F.max(F.struct("doc_id", "_file", "_row")).alias("_best"),
        )
    )

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/groups/batch={batch}")

    with _state_on_disk(spark):
        _run(state.writeStream.outputMode("update").foreachBatch(keep), f"{folder}/progress-state")


def _watched(spark: SparkSession, path: str) -> str:
    """The path as a stream takes it: a single file only as a pattern."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return f"{place.getParent()}/{{{place.getName()}}}"
    return path


def _run(writer, progress: str) -> None:
    writer.option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB while the stream starts; its checkpoints go to the shared folder."""
    before = {name: spark.conf.get(name, None) for name in _STATE}
    for name, value in _STATE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    """The latest state of each key; a batch writes the keys that it changed."""
    groups = spark.read.parquet(f"{folder}/groups")
    latest = F.max_by(F.struct("_size", "_best"), "batch")
    return groups.groupBy("_key").agg(latest.alias("_g")).select("_key", "_g.*")


def _judged(spark: SparkSession, path: str, folder: str) -> DataFrame:
    prints = spark.read.parquet(f"{folder}/prints")
    if not exists(spark, f"{folder}/groups"):
        # Not a row has arrived yet.
        none = prints.where("false")
        return none.select(
            "*", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept")
        )
    groups = stored(_groups(spark, folder), "exact-groups")
    width = groups.agg(F.max(F.length("_key"))).first()[0] or 64
    keyed = prints.withColumn("_key", F.left("text_sha256", F.lit(width)))
    is_best = (F.col("_file") == F.col("_best._file")) & (F.col("_row") == F.col("_best._row"))
    grouped = keyed.join(groups, "_key")
    odd = _differing(spark, path, grouped.where("_size > 1").select("_file", "_row", "_key", is_best.alias("_is_best")))
    found = grouped.select(
        "doc_id",
        "_file",
        "_row",
        "_key",
        "text_sha256",
        F.col("_best.doc_id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        is_best.alias("kept"),
    )
    if odd.isEmpty():
        return found.drop("_key")
    # Texts that share a digest and nothing else: grouped by the texts themselves.
    ids = prints.select("doc_id", "_file", "_row")
    odd = odd.join(ids, ["_file", "_row"])
    regrouped = odd.groupBy("_key", "_norm").agg(
        F.count("*").alias("_size"), F.max(F.struct("doc_id", "_file", "_row")).alias("_best")
    )
    mended = odd.join(regrouped, ["_key", "_norm"]).select(
        "_file", "_row", F.struct(F.col("_best.doc_id").alias("keep_id"), F.col("_size").alias("group_size"), is_best.alias("kept")).alias("_own")
    )
    fewer = odd.groupBy("_key").agg(F.count("*").alias("_fewer"))
    own = F.col("_own").isNotNull()
    return (
        found.join(mended, ["_file", "_row"], "left")
        .join(fewer, "_key", "left")
        .select(
            "doc_id",
            "_file",
            "_row",
            "text_sha256",
            F.when(own, F.col("_own.keep_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.when(own, F.col("_own.group_size"))
            .otherwise(F.col("group_size") - F.coalesce("_fewer", F.lit(0)))
            .alias("group_size"),
            F.when(own, F.col("_own.kept")).otherwise(F.col("kept")).alias("kept"),
        )
    )


def _differing(spark: SparkSession, path: str, hits: DataFrame) -> DataFrame:
    """`_file, _row, _key, _norm` of rows whose text is not that of the row that stays.

    One row per digest is the other side of the comparison, so a large group costs a
    line per copy, and adaptive execution splits it.
    """
    hits = stored(hits, "exact-hits")
    docs = spark.read.parquet(path)
    place = docs.metadataColumn("_metadata")
    texts = docs.select(F.col("text").alias("_text"), place["file_path"].alias("_file"), place["row_index"].alias("_row"))
    few = hits.count() <= BROADCAST_PLACES
    met = stored(texts.join(F.broadcast(hits) if few else hits, ["_file", "_row"]), "exact-texts")
    best = met.where("_is_best").select("_key", F.col("_text").alias("_best_text"))
    others = met.where("not _is_best").join(best, "_key")
    same = F.col("_text").eqNullSafe(F.col("_best_text"))
    same = same | (normalised(F.col("_text")) == normalised(F.col("_best_text")))
    return stored(
        others.where(~same).select("_file", "_row", "_key", normalised(F.col("_text")).alias("_norm")), "exact-odd"
    )


def _result(spark: SparkSession, path: str, folder: str) -> DataFrame:
    return _judged(spark, path, folder).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
