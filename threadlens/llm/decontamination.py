"""Benchmark passages in documents (operator 10).

The benchmark's windows of ten normalised words go to every task as a hash set; a
task reads each text once, numbers its words by the benchmark's own vocabulary (any
other word breaks a window), looks up window hashes and confirms each hit word by
word. The set is bounded: a benchmark of more than `BLOCK_WORDS` words is taken in
blocks of items, one pass over the documents each; so does the removal.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.columns import unused
from threadlens.llm.encoding import runs_of
from threadlens.storage import key_side, stored

WINDOW = 10
# Words of benchmark text whose windows are sent to executors at once (some 200 bytes each).
BLOCK_WORDS = 1_000_000
# No word holds these: ASCII except digits and letters (bytes are lower-cased first).
_GAPS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)

SCAN = "doc_id long, text_key long, n_words long, spans array<struct<first:long,words:long>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().translate(_GAPS).split()


class Windows:
    """The windows of some benchmark items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(dict)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if ids else 0):
                owners = self.items[size].setdefault(tuple(ids[at : at + size]), set())
                if item is not None:
                    owners.add(item)
        self.hashes = {
            size: np.unique(self._hash(np.array(list(known), np.int64).T)) for size, known in self.items.items()
        }

    @staticmethod
    def _hash(columns: np.ndarray) -> np.ndarray:
        out = np.zeros(columns.shape[1], np.uint64)
        for column in columns:
            out = (out + column.astype(np.uint64) + np.uint64(1)) * _BASE
            out ^= out >> np.uint64(29)
        return out

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, set[str]]]:
        """Where windows occur in numbered words (-1 elsewhere): start, size, items."""
        broken = np.concatenate([[0], np.cumsum(ids < 0)])
        out = []
        for size, known in self.items.items():
            if len(ids) < size:
                continue
            starts = np.flatnonzero(broken[size:] == broken[:-size])
            if len(starts):
                hashes = self._hash(np.stack([ids[starts + k] for k in range(size)]))
                at = np.searchsorted(self.hashes[size], hashes)
                at[at == len(self.hashes[size])] = 0
                for start in starts[self.hashes[size][at] == hashes].tolist():
                    if (owners := known.get(tuple(ids[start : start + size].tolist()))) is not None:
                        out.append((start, size, owners))
        return out


def _merged(hits: list[tuple[int, int, set[str]]]) -> list[dict[str, int]]:
    spans: list[list[int]] = []
    for start, size, _ in sorted(hits, key=lambda h: h[:2]):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], start + size)
        else:
            spans.append([start, start + size])
    return [{"first": a, "words": b - a} for a, b in spans]


def _scanner(index: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    span = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
    kinds = [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("spans", span), ("items", pa.list_(pa.string()))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = index.vocabulary.get
        for batch in batches:
            done = 0
            for run in runs_of(batch["text"]):
                keys = batch["doc_id"].slice(done, len(run))
                done += len(run)
                counts, found, marks = [], [], []
                for text in run.to_pylist():
                    words = words_of(text)
                    ids = np.fromiter([number(w, -1) for w in words], np.int64, len(words))
                    hits = index.hits(ids)
                    counts.append(len(words))
                    found.append(_merged(hits))
                    marks.append(sorted(set(chain.from_iterable(h[2] for h in hits))))
                text_key = [xxhash.xxh3_64_intdigest(x or "") - (1 << 63) for x in pc.cast(run, pa.binary()).to_pylist()]
                columns = [keys, text_key, counts, found, marks]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) if isinstance(c, list) else c.cast(k) for c, (_, k) in zip(columns, kinds)],
                    schema=pa.schema(kinds),
                )

    return scan


def _blocks(benchmark: DataFrame, block_words: int) -> list[DataFrame]:
    """The items (`item_id`, `text`) in parts of about `block_words` words each."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    # A word takes two bytes of text at least, with the gap after it.
    size = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    blocks = int(size // block_words) + 1
    if blocks == 1:
        return [items]
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) for block in range(blocks)]


def _windows(block: DataFrame, window: int) -> Windows:
    return Windows([tuple(r) for r in block.collect()], window)


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Which words of each document lie in a window of the benchmark.

    Columns: `doc_id`, `text_key` (a hash of the text), `n_words`, `spans` (of hit
    words: first and number, apart and ascending), `items` (ids of items with a window
    in the text, sorted as strings).

    Null text has no words and no hits. An item of fewer words than a window is one
    window; an item without words is none. Items without id count for spans but are
    not listed; items that share an id are one. Documents keep their rows, also
    repeated ones and those without id. An empty benchmark hits nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = _blocks(benchmark, block_words)
    if len(blocks) == 1:
        return rows.mapInArrow(_scanner(_windows(blocks[0], window)), SCAN)
    passes = [stored(rows.mapInArrow(_scanner(_windows(block, window)), SCAN), "windows") for block in blocks]
    more = passes[1]
    for other in passes[2:]:
        more = more.unionByName(other)
    more = more.where("size(spans) > 0").groupBy("doc_id", "text_key").agg(
        F.flatten(F.collect_set("spans")).alias("_spans"), F.flatten(F.collect_set("items")).alias("_items")
    )
    first = passes[0].alias("f")
    same = first["doc_id"].eqNullSafe(more["doc_id"]) & (first["text_key"] == more["text_key"])
    none = F.array().cast("array<struct<first:long,words:long>>")
    together = first.join(more, same, "left").select(
        first["doc_id"], first["text_key"], "n_words",
        F.array_sort(F.array_distinct(F.concat("spans", F.coalesce("_spans", none)))).alias("spans"),
        F.array_sort(F.array_distinct(F.concat("items", F.coalesce("_items", F.array().cast("array<string>"))))).alias("items"),
    )
    # Spans of different blocks may overlap: join them in ascending order.
    joined = F.aggregate(
        "spans",
        none,
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["first"] + F.element_at(done, -1)["words"] >= x["first"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["first"].alias("first"),
                        (
                            F.greatest(
                                F.element_at(done, -1)["first"] + F.element_at(done, -1)["words"], x["first"] + x["words"]
                            )
                            - F.element_at(done, -1)["first"]
                        ).alias("words"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return together.withColumn("spans", joined)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`find_windows` with its counts: `n_hit` (hit words), `n_items`, `items_sha256` (of
    the ids, comma-joined; of empty text where there is none) and `contaminated`."""
    found = find_windows(docs, benchmark, window, block_words)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return (
        found.withColumn("n_hit", hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for first, words in spans:
        out.append(raw[at : places[first][0]])
        at = places[first + words - 1][1]
    return b"\n".join([*(x.rstrip(b" ") for x in out), raw[at:].lstrip(b" ")]).decode("utf-8", "surrogatepass")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    mode: str = "documents",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents without benchmark passages, with their own columns.

    `mode='documents'` leaves out every document with a hit; `mode='spans'` cuts the
    hit words out of `text`, again until no window is left (`n_chars`, if there, is
    set anew). All other documents stay as they are. The benchmark may have any size:
    beyond `block_words` words it is taken in blocks, with the same result.
    """
    blocks = _blocks(benchmark, block_words)
    spans = mode == "spans"
    if len(blocks) == 1:
        out = _cleaned(docs, _windows(blocks[0], window), spans)
    else:
        out = _cleaned_in_blocks(docs, blocks, window, spans)
    if spans and "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out


def _cleaned(docs: DataFrame, index: Windows, spans: bool) -> DataFrame:
    """`decontaminate` in one pass, by the windows of all items."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = index.vocabulary.get
        at = list(names).index("text")
        for batch in batches:
            texts, keep = batch.column(at).to_pylist(), []
            for row, text in enumerate(texts):
                hit = True
                while hit:
                    ids = np.array([number(w, -1) for w in words_of(texts[row])], np.int64)
                    hit = index.hits(ids)
                    if hit and spans:
                        texts[row] = without_spans(texts[row], [(s["first"], s["words"]) for s in _merged(hit)])
                    elif hit:
                        break
                keep.append(not hit)
            out = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield out.filter(pa.array(keep, pa.bool_()))

    return docs.toDF(*names.values()).mapInArrow(clean, docs.toDF(*names.values()).schema).toDF(*docs.columns)


def _hits(rows: DataFrame, blocks: list[DataFrame], window: int) -> DataFrame:
    """The rows with a hit, once per block that has one: `doc_id`, `spans`."""
    found = []
    for block in blocks:
        hit = rows.mapInArrow(_scanner(_windows(block, window)), SCAN).where("size(spans) > 0")
        found.append(stored(hit.select("doc_id", "spans"), "hits"))
    return reduce(DataFrame.unionByName, found)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, own in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
            # Spans of different blocks may overlap.
            merged = _merged([(s["first"], s["words"], set()) for s in own or []])
            texts.append(without_spans(text, [(s["first"], s["words"]) for s in merged]) if merged else text)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])


def _cleaned_in_blocks(docs: DataFrame, blocks: list[DataFrame], window: int, spans: bool) -> DataFrame:
    """`decontaminate` in a pass per block; only what is hit is written in between.

    Whether and where a text is hit depends on the text alone, so a hash of it stands
    for all its rows.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text"))
    hits = _hits(rows, blocks, window)
    hit, cleaned = unused(docs, "_hit"), unused(docs, "_text")
    keys = stored(hits.select(F.col("doc_id").alias(hit)).distinct(), "hit_texts")
    if not spans:
        return docs.join(key_side(keys), F.xxhash64(text) == F.col(hit), "left_anti")
    now = rows.join(key_side(keys), F.col("doc_id") == F.col(hit), "left_semi").dropDuplicates(["doc_id"])
    # A cut joins words that were apart, which may make a window of any block.
    while not hits.isEmpty():
        own = hits.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        now = now.join(own, "doc_id", "left").select("doc_id", "text", "spans")
        now = stored(now.mapInArrow(_cut, "doc_id long, text string"), "cut_texts")
        hits = _hits(now, blocks, window)
    new = now.select(F.col("doc_id").alias(hit), F.col("text").alias(cleaned))
    out = docs.join(new, F.xxhash64(text) == F.col(hit), "left")
    kind = docs.schema["text"].dataType
    return out.withColumn("text", F.coalesce(F.col(cleaned).cast(kind), "text")).select(*docs.columns)
