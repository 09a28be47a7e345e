"""Token ids of two tokenizers set against each other, with corpus-wide counts of id pairs.

The byte offsets at which tokens of both tokenizers end cut a text into groups; all tokens of
one in a group are linked to all tokens of the other. A stretch of a text, whatever its
limits, is a fragment: an open prefix up to its first common end, closed groups, and an open
suffix after its last common end. Fragments compose associatively: suffix and prefix that meet
become a closed group. Short texts are one fragment each. Longer ones are dealt out as byte
ranges over all tasks and their fragments composed by a tree of bounded fan-in, so that no
task holds more of a text than a few ranges (besides the row that it arrived in).

Both tokenizers never join across a blank or line feed that follows other text, so a text is a
sequence of cells, and the groups of a cell are kept by the worker that met it. A range
takes the tokens that end in it, of cells at its limits too; only a cell larger than a
quarter of a range is never divided.

Pairs are counted once per document: in tasks for blocks of whole documents, by an aggregation
over key and pair for documents in ranges. Each block is then sent the counts of the pairs
that it holds, which its size bounds, and sums them up per document.

Defined results: null and empty texts, and texts whose token bytes are not the text again
(those with U+2581, for one), have no tokens; they give zeros and an empty hash column and
count nowhere. Repeated rows are documents of their own. An empty table gives no rows. Other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.encoding import no_cycle_search, one_thread, runs_of
from threadlens.storage import stored

# Texts beyond this are dealt out in ranges of this size.
RANGE_BYTES = 1 << 16
# Fragments composed by one call.
FAN_IN = 16
# Runs of whole documents that make a block.
BLOCK_BYTES = 4 << 20
# Cells a worker remembers in each of two generations (some 400 bytes each).
REMEMBERED = 150_000
LONGEST_KEPT = 64
ASKED = 1_000

_CUT = re.compile(r"(?<=\S)(?=[ \n])")
# Texts with these are cut by the pattern above, all others by Arrow.
_ODD = r"[ \n][ \n]|^[ \n]|\x00|[\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}][ \n]"
_BLANK = re.compile(rb"[ \n]")

_FRAGMENT = "has_end boolean, pre_a array<int>, pre_b array<int>, suf_a array<int>, suf_b array<int>"
_SEAMS = "seams array<struct<at:int,a:array<int>,b:array<int>>>"
_COUNTS = "n_a long, n_b long, n_groups long, n_links long, bad boolean"
_UNITS = (
    f"kind string, block string, key string, k int, {_COUNTS}, sha string, idx binary, mult binary, "
    f"{_FRAGMENT}, body binary, codes array<long>, ns array<int>"
)
_REDUCED = f"key string, k int, last_k int, {_COUNTS}, {_FRAGMENT}, {_SEAMS}"


class Cell(NamedTuple):
    """What the groups of a stretch of text come to. `codes`: int64 `a << 32 | b` per link."""

    n_a: int
    n_b: int
    n_groups: int
    body: bytes
    codes: bytes
    bad: bool


def align_tokenizers(docs: DataFrame, file_a: str, file_b: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """`doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256` per document.

    `file_a` is a byte-level file of `tokenizers`, `file_b` a `sentencepiece` model with byte
    pieces that puts a blank in front. `count_sum` sums, over links, how many documents hold
    the linked id pair; `n_best` counts links whose pair has the highest count of its A id.
    """
    return _aligned(docs, file_a, file_b, range_bytes)[0]


def pair_counts(docs: DataFrame, file_a: str, file_b: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """`a_id, b_id, n_docs, best` of all linked id pairs."""
    counts = _aligned(docs, file_a, file_b, range_bytes)[1]
    a, b = F.shiftright("code", 32), F.col("code").bitwiseAND(F.lit((1 << 32) - 1))
    return counts.select(a.cast("int").alias("a_id"), b.cast("int").alias("b_id"), "n_docs", "best")


def _aligned(docs: DataFrame, file_a: str, file_b: str, range_bytes: int) -> tuple[DataFrame, DataFrame]:
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {_UNITS}"
    texts = docs.select("doc_id", F.when(F.length("text") > 0, F.concat(F.lit(" "), "text")).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = aligner(file_a, file_b)
        for batch in batches:
            start = 0
            for run in runs_of(batch.column("text"), BLOCK_BYTES):
                ids = batch.column("doc_id").slice(start, len(run))
                start += len(run)
                # Looking for cycles among the cells costs a fifth of the time.
                with no_cycle_search():
                    rows = [*_whole_block(cells, ids, run)]
                yield from rows

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = aligner(file_a, file_b)
        for batch in batches:
            start = 0
            for run in runs_of(batch.column("text"), BLOCK_BYTES):
                part = batch.slice(start, len(run))
                start += len(run)
                yield from _range_block(cells, part)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = aligner(file_a, file_b)
        for batch in batches:
            for row in range(batch.num_rows):
                yield from _ranges(batch.column("doc_id").slice(row, 1), batch.column("text")[row].as_py(), range_bytes, cells.cuts)

    pieces = stored(
        texts.where(size > range_bytes).mapInArrow(
            cut, f"doc_id {kind}, key string, k int, lo long, hi long, text string"
        ),
        "ranges",
    )
    units = texts.where(size <= range_bytes).mapInArrow(whole, schema)
    units = stored(units.unionByName(pieces.repartition("key", "k").mapInArrow(ranged, schema)), "aligned")
    long_docs, seams = _long_documents(units)

    held = units.where("kind = 'codes'").select(
        "block", F.posexplode(F.arrays_zip("codes", "ns")).alias("pos", "at")
    ).select("block", "pos", F.col("at.codes").alias("code"), F.col("at.ns").cast("long").alias("n"))
    in_ranges = (
        units.where("kind = 'range'").select("key", F.explode("codes").alias("code"))
        .unionByName(seams.select("key", "code"))
        .join(long_docs.where("bad").select("key"), "key", "left_anti")
        .distinct().groupBy("code").agg(F.count("*").alias("n"))
    )
    counts = (
        held.where("n > 0").select("code", "n").unionByName(in_ranges)
        .groupBy("code").agg(F.sum("n").alias("n_docs"))
    )
    counts = stored(counts, "pair-counts")
    a = F.shiftright("code", 32).alias("_a")
    highest = counts.groupBy(a).agg(F.max("n_docs").alias("_most"))
    counts = stored(
        counts.select("*", a).join(highest, "_a").select("code", "n_docs", (F.col("n_docs") == F.col("_most")).alias("best")),
        "best-pairs",
    )

    looked_up = held.select(F.col("block").alias("of"), "pos", "code").join(counts, "code").select("of", "pos", "n_docs", "best")
    rows = units.where("kind <> 'codes'").select(
        "block", "doc_id", "kind", "key", "n_a", "n_b", "n_groups", "n_links", "bad", "sha", "idx", "mult"
    )
    summed = rows.groupBy("block").cogroup(looked_up.groupBy("of")).applyInArrow(
        _sum_block, f"doc_id {kind}, kind string, key string, n_a long, n_b long, n_groups long, n_links long, sha string, n_best long, count_sum long"
    )
    summed = stored(summed, "aligned-sums")
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    short = summed.where("kind = 'doc'").select("doc_id", F.col("sha").alias("groups_sha256"), *columns[:-1])
    of_ranges = summed.where("kind = 'range'").groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )
    of_seams = seams.join(counts, "code").groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("_best"),
        F.sum(F.col("n") * F.col("n_docs")).alias("_sum"),
    )
    zero = F.lit(0).cast("long")

    def unless_bad(value):
        return F.when(F.col("bad"), zero).otherwise(F.coalesce(value, zero))

    more = (
        long_docs.join(of_ranges, "key").join(of_seams, "key", "left").join(_hashes(units, long_docs), "key")
        .select(
            "doc_id",
            *[unless_bad(F.col(c)).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")],
            unless_bad(F.col("n_best") + F.coalesce("_best", zero)).alias("n_best"),
            unless_bad(F.col("count_sum") + F.coalesce("_sum", zero)).alias("count_sum"),
            F.when(F.col("bad"), "").otherwise(F.col("sha")).alias("groups_sha256"),
        )
    )
    return short.select("doc_id", *columns).unionByName(more), counts


# --- cells -------------------------------------------------------------------------------


class CellAligner:
    """Groups of cells, remembered in two generations of the most recently met."""

    def __init__(self, file_a: str, file_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        one_thread()
        self.a = Tokenizer.from_file(file_a)
        # The strings of special tokens are ordinary text.
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        byte_of = _byte_level()
        self.a_bytes = {i: bytes(byte_of[c] for c in x) for x, i in self.a.get_vocab().items() if all(c in byte_of for c in x)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode()
            for i, x in enumerate(pieces)
        ]
        # Whether text may be cut before a blank or line feed that follows other text.
        how = json.loads(self.a.to_str())
        before = how["pre_tokenizer"] or {}
        self.cuts = (
            how["normalizer"] is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex") is True
            and not any(re.search("[^▁]▁|\n", x) for x in pieces)
        )
        self.len_a = np.array([len(self.a_bytes.get(i, b"")) for i in range(self.a.get_vocab_size())], np.int64)
        self.len_b = np.array([len(x) for x in self.b_bytes], np.int64)
        # Each id as it is written before another of its list, and as the last of it.
        self.list_a, self.last_a = _written(len(self.len_a), b","), _written(len(self.len_a), b"|")
        self.list_b, self.last_b = _written(len(self.len_b), b","), _written(len(self.len_b), b";")
        self.final_b = _written(len(self.len_b), b"\n")
        self.young: dict[str, Cell] = {}
        self.old: dict[str, Cell] = {}

    def tokens(self, cells: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers for each cell."""
        a = []
        # The library's results are large: a few at a time.
        for at in range(0, len(cells), ASKED):
            a += [e.ids for e in self.a.encode_batch_fast(cells[at : at + ASKED], add_special_tokens=False)]
        if self.cuts:
            # Behind a line feed no blank is added; it comes as two pieces of its own.
            b = [ids[2:] for ids in self.b.encode(["\n" + x for x in cells], num_threads=1)]
        else:
            b = self.b.encode([x.removeprefix(" ") for x in cells], num_threads=1)
        return a, b

    def faithful(self, cell: str, a: list[int], b: list[int]) -> bool:
        data = cell.encode()
        return (
            b"".join(map(self.b_bytes.__getitem__, b)) == data
            and b"".join([self.a_bytes.get(i, b"") for i in a]) == data
        )

    def cells(self, cells: list[str]) -> list[Cell]:
        """What each of these different cells comes to."""
        found = [*map(self.young.get, cells)]
        new = []
        for at, cell in enumerate(found):
            if cell is None:
                x = cells[at]
                cell = found[at] = self.old.get(x)
                if cell is None:
                    new.append(at)
                else:
                    self.young[x] = cell
        for start in range(0, len(new), 16 * ASKED):
            some = new[start : start + 16 * ASKED]
            names = [cells[at] for at in some]
            for at, x, cell in zip(some, names, self._fresh(names)):
                found[at] = cell
                if len(x) <= LONGEST_KEPT:
                    self.young[x] = cell
            if len(self.young) > REMEMBERED:
                self.old, self.young = self.young, {}
        return found

    def _fresh(self, cells: list[str]) -> list[Cell]:
        a, b = self.tokens(cells)
        flat_a, flat_b = (list(chain.from_iterable(x)) for x in (a, b))
        data = "".join(cells).encode()
        same = b"".join(map(self.b_bytes.__getitem__, flat_b)) == data
        if same and b"".join([self.a_bytes.get(i, b"") for i in flat_a]) == data:
            # All bytes are there again; whether each cell has its own follows from the ends.
            sizes = np.fromiter(map(len, map(str.encode, cells)), np.int64, len(cells))
            ends = np.cumsum(sizes)
            own = [
                np.array_equal(np.cumsum(lens[flat])[np.cumsum(np.fromiter(map(len, x), np.int64, len(x))) - 1], ends)
                for x, flat, lens in ((a, flat_a, self.len_a), (b, flat_b, self.len_b))
            ]
            if all(own):
                return self._summed(a, b)
        good = [i for i, x in enumerate(zip(cells, a, b)) if self.faithful(*x)]
        out = [Cell(0, 0, 0, b"", b"", True)] * len(cells)
        for i, cell in zip(good, self._summed([a[i] for i in good], [b[i] for i in good])):
            out[i] = cell
        return out

    def _summed(self, a: list[list[int]], b: list[list[int]]) -> list[Cell]:
        """`summed_up` of whole cells, all at once: laid one behind the other, the common ends
        of their tokens number the groups."""
        n = len(a)
        if not n:
            return []
        n_a, n_b = (np.fromiter(map(len, x), np.int64, n) for x in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        ends_a, ends_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        common = ends_a[np.isin(ends_a, ends_b, assume_unique=True)]
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        # Links: each token of A with all of B in its group.
        times = in_b[group_a]
        partner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - before_b[group_a], times)
        codes = (np.repeat(ids_a, times) << 32 | ids_b[partner]).astype("<i8").tobytes()
        # Written form: a group's ids of A, then those of B.
        more_a = np.append(group_a[1:] == group_a[:-1], False)
        more_b = np.append(group_b[1:] == group_b[:-1], False)
        words = np.empty(len(ids_a) + len(ids_b), object)
        words[np.arange(len(ids_a)) + before_b[group_a]] = np.where(more_a, self.list_a[ids_a], self.last_a[ids_a])
        text_b = np.where(more_b, self.list_b[ids_b], self.last_b[ids_b])
        cell_ends = np.cumsum(n_b) - 1
        text_b[cell_ends] = self.final_b[ids_b[cell_ends]]
        words[np.arange(len(ids_b)) + (before_a + in_a)[group_b]] = text_b
        bodies = b"".join(words.tolist()).split(b"\n")
        ends = np.concatenate([[0], np.cumsum(times)])[np.cumsum(n_a)] * 8
        groups = np.diff(group_b[cell_ends], prepend=-1)
        starts = np.concatenate([[0], ends[:-1]])
        return [
            Cell(x, y, z, body, codes[s:e], False)
            for x, y, z, body, s, e in zip(n_a.tolist(), n_b.tolist(), groups.tolist(), bodies, starts.tolist(), ends.tolist())
        ]

    def groups(self, a: list[int], b: list[int], lo: int, hi: int):
        """Tokens that end beyond `lo` and up to `hi`, as (has a common end, groups, rest).

        A group is a pair of id lists that closes with a common end; the rest is what
        follows the last one.
        """
        len_a, len_b = self.a_bytes, self.b_bytes
        groups, i, j, from_i, from_j = [], 0, 0, 0, 0
        end_a, end_b = len(len_a[a[0]]), len(len_b[b[0]])
        while True:
            if min(end_a, end_b) <= lo:
                # Ends at or before the limit belong to the range before.
                if end_a <= lo:
                    i += 1
                    end_a = end_a + len(len_a[a[i]]) if i < len(a) else 1 << 62
                if end_b <= lo:
                    j += 1
                    end_b = end_b + len(len_b[b[j]]) if j < len(b) else 1 << 62
                from_i, from_j = i, j
                continue
            if min(end_a, end_b) > hi or (i == len(a) and j == len(b)):
                return bool(groups), groups, (a[from_i:i], b[from_j:j])
            here_a, here_b = end_a <= end_b, end_b <= end_a
            if here_a:
                i += 1
                end_a = end_a + len(len_a[a[i]]) if i < len(a) else 1 << 62
            if here_b:
                j += 1
                end_b = end_b + len(len_b[b[j]]) if j < len(b) else 1 << 62
            if here_a and here_b:
                groups.append((a[from_i:i], b[from_j:j]))
                from_i, from_j = i, j


def _written(size: int, end: bytes) -> np.ndarray:
    return np.array([b"%d%s" % (i, end) for i in range(size)], object)


def _byte_level() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable bytes for
    themselves, all others in order from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


def summed_up(groups: list[tuple[list[int], list[int]]]) -> Cell:
    codes, n_a, n_b = [], 0, 0
    for a, b in groups:
        codes += [x << 32 | y for x in a for y in b]
        n_a += len(a)
        n_b += len(b)
    body = ";".join([f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups]).encode()
    return Cell(n_a, n_b, len(groups), body, np.array(codes, "<i8").tobytes(), False)


@lru_cache(maxsize=2)
def aligner(file_a: str, file_b: str) -> CellAligner:
    """The worker's cells; they live as long as the worker."""
    return CellAligner(file_a, file_b)


# --- blocks ------------------------------------------------------------------------------


def _block(
    cells: list[Cell], which: np.ndarray, ends: np.ndarray, counted: bool
) -> tuple[dict[str, np.ndarray], list[bytes], list[bytes], list[np.ndarray], np.ndarray, np.ndarray]:
    """Sums per unit, its links as positions in the block's codes, and the block's codes.

    `which` holds the cells of all units one after another, `ends` where each unit ends. The
    last result says how many units hold each code, of units that count.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    n = len(ends)

    def total(values: np.ndarray) -> np.ndarray:
        so_far = np.concatenate([[0], np.cumsum(values[which])])
        return so_far[ends] - so_far[starts]

    sizes = np.fromiter((len(c.codes) for c in cells), np.int64, len(cells)) // 8
    sums = {
        "n_a": total(np.fromiter((c.n_a for c in cells), np.int64, len(cells))),
        "n_b": total(np.fromiter((c.n_b for c in cells), np.int64, len(cells))),
        "n_groups": total(np.fromiter((c.n_groups for c in cells), np.int64, len(cells))),
        "n_links": total(sizes),
        "bad": total(np.fromiter((c.bad for c in cells), np.int64, len(cells))) > 0,
    }
    codes, of_cell = np.unique(np.frombuffer(b"".join([c.codes for c in cells]), "<i8"), return_inverse=True)
    # Cells of a unit once, then links of a unit once, each with their number.
    unit = np.repeat(np.arange(n), ends - starts)
    keep = ~sums["bad"][unit]
    pairs, times = np.unique(unit[keep] * max(1, len(cells)) + which[keep], return_counts=True)
    unit, cell = np.divmod(pairs, max(1, len(cells)))
    links = sizes[cell]
    first = (np.cumsum(sizes) - sizes)[cell]
    at = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links - first, links)
    keys = np.repeat(unit, links) * max(1, len(codes)) + of_cell[at]
    order = np.argsort(keys, kind="stable")
    keys, weight = keys[order], np.repeat(times, links)[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    mult = np.add.reduceat(weight, new) if len(new) else np.zeros(0, np.int64)
    unit, code = np.divmod(keys[new], max(1, len(codes)))
    at = np.searchsorted(unit, np.arange(n + 1))
    idx = [code[at[i] : at[i + 1]] for i in range(n)]
    ns = np.bincount(code, minlength=len(codes)) if counted else np.zeros(len(codes), np.int64)
    return (
        sums,
        [_packed(x) for x in idx],
        [_packed(mult[at[i] : at[i + 1]]) for i in range(n)],
        idx,
        codes,
        ns,
    )


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers in as many bytes each as the largest needs, which the first byte tells."""
    most = int(numbers.max()) if len(numbers) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _rows(ids: pa.Array, columns: dict[str, pa.Array], codes: np.ndarray, ns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The units of a block, and one row with its codes."""
    block = str(uuid.uuid4())
    n = len(ids)
    names = [part.split()[0] for part in re.sub("<.*?>", "", _UNITS).split(", ")]
    kinds = {
        "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "bad": pa.bool_(), "k": pa.int32(),
        "has_end": pa.bool_(), "idx": pa.binary(), "mult": pa.binary(), "body": pa.binary(), "codes": pa.list_(pa.int64()),
        "ns": pa.list_(pa.int32()),
    } | {c: pa.list_(pa.int32()) for c in ("pre_a", "pre_b", "suf_a", "suf_b")}
    kind = {c: kinds.get(c, pa.string()) for c in names}
    columns = columns | {"block": pa.array([block] * n, pa.string())}
    arrays = [columns[c].cast(kind[c]) if c in columns else pa.nulls(n, kind[c]) for c in names]
    yield pa.RecordBatch.from_arrays([ids, *arrays], names=["doc_id", *names])
    own = {
        "kind": pa.array(["codes"]),
        "block": pa.array([block]),
        "codes": pa.array([codes], kind["codes"]),
        "ns": pa.array([ns.astype(np.int32)], kind["ns"]),
    }
    arrays = [own.get(c, pa.nulls(1, kind[c])) for c in names]
    yield pa.RecordBatch.from_arrays([pa.nulls(1, ids.type), *arrays], names=["doc_id", *names])


def _whole_block(cells: CellAligner, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """A run of whole documents; null texts have no cells."""
    texts = texts.cast(pa.large_string())
    null = texts.is_null().to_numpy(zero_copy_only=False)
    if cells.cuts:
        blank = pa.scalar(" ", pa.large_string())
        body = pc.utf8_slice_codeunits(texts.fill_null(" "), 1)
        odd = pc.match_substring_regex(body, _ODD).to_numpy(zero_copy_only=False)
        marked = pc.replace_substring(pc.replace_substring(body, " ", "\0 "), "\n", "\0\n")
        lists = pc.split_pattern(pc.binary_join_element_wise(blank, marked, pa.scalar("", blank.type)), "\0")
        if odd.any():
            known = iter(texts.filter(pa.array(odd)).to_pylist())
            plain = lists.to_pylist()
            lists = pa.array(
                [_CUT.split(next(known)) if is_odd else x for x, is_odd in zip(plain, odd)], pa.large_list(pa.large_string())
            )
    else:
        lists = pa.array([[x] if x is not None else [" "] for x in texts.to_pylist()], pa.large_list(pa.large_string()))
    words = lists.flatten().dictionary_encode()
    which = words.indices.to_numpy().astype(np.int64)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    if null.any():
        which = which[~np.repeat(null, lengths)]
        lengths = np.where(null, 0, lengths)
    ends = np.cumsum(lengths)
    found = cells.cells(words.dictionary.to_pylist())
    sums, idx, mult, _, codes, ns = _block(found, which, ends, True)
    bodies = [c.body for c in found]
    shas, start = [], 0
    for end, bad in zip(ends.tolist(), sums["bad"].tolist()):
        own = which[start:end].tolist()
        start = end
        empty = bad or not own
        shas.append("" if empty else hashlib.sha256(b";".join([bodies[i] for i in own])).hexdigest())
    columns = {c: pa.array(np.where(sums["bad"], 0, v)) for c, v in sums.items() if c != "bad"}
    columns |= {
        "kind": pa.array(["doc"] * len(ids), pa.string()),
        "bad": pa.array(sums["bad"]),
        "sha": pa.array(shas, pa.string()),
        "idx": pa.array(idx, pa.binary()),
        "mult": pa.array(mult, pa.binary()),
    }
    yield from _rows(ids, columns, codes, ns)


def _range_block(cells: CellAligner, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Ranges of long documents as fragments, a batch of them as one block."""
    units = []
    for text, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("text", "lo", "hi"))):
        units.append((_CUT.split(text) if cells.cuts else [text], lo, hi))
    words: dict[str, int] = {}
    plain = [[words.setdefault(x, len(words)) for x in own] for own, _, _ in units]
    found = cells.cells([*words])
    lists, fragments = [], []
    for (own, lo, hi), at in zip(units, plain):
        if any(found[i].bad for i in at):
            fragments.append((False, [], [], [], [], True))
            lists.append([])
            continue
        # The first cell gives the prefix, a last one beyond the limit the suffix.
        before = sum(len(x.encode()) for x in own[:-1])
        a, b = cells.tokens([own[0], own[-1]])
        has_end, groups, rest = cells.groups(a[0], b[0], lo, hi)
        inner = list(at[1:])
        prefix = groups[0] if groups else rest
        suffix = rest if groups else ([], [])
        head = summed_up(groups[1:])
        tail = None
        if len(own) > 1 and before + len(own[-1].encode()) > hi:
            inner.pop()
            _, groups, suffix = cells.groups(a[1], b[1], 0, hi - before)
            tail = summed_up(groups)
        mine = [len(found), *inner]
        found.append(head)
        if tail is not None:
            mine.append(len(found))
            found.append(tail)
        fragments.append((has_end, *prefix, *suffix, False))
        lists.append(mine)
    which = np.array([i for own in lists for i in own], np.int64)
    ends = np.cumsum([len(own) for own in lists]).astype(np.int64)
    sums, idx, mult, held, codes, ns = _block(found, which, ends, False)
    open_a = np.array([len(f[1]) + len(f[3]) for f in fragments], np.int64)
    open_b = np.array([len(f[2]) + len(f[4]) for f in fragments], np.int64)
    numbers = pa.list_(pa.int32())
    columns = {
        "kind": pa.array(["range"] * len(units), pa.string()),
        "key": batch.column("key"),
        "k": batch.column("k"),
        "n_a": pa.array(sums["n_a"] + open_a),
        "n_b": pa.array(sums["n_b"] + open_b),
        "n_groups": pa.array(sums["n_groups"]),
        "n_links": pa.array(sums["n_links"]),
        "bad": pa.array([f[5] for f in fragments], pa.bool_()),
        "idx": pa.array(idx, pa.binary()),
        "mult": pa.array(mult, pa.binary()),
        "has_end": pa.array([f[0] for f in fragments], pa.bool_()),
        "pre_a": pa.array([f[1] for f in fragments], numbers),
        "pre_b": pa.array([f[2] for f in fragments], numbers),
        "suf_a": pa.array([f[3] for f in fragments], numbers),
        "suf_b": pa.array([f[4] for f in fragments], numbers),
        "body": pa.array([b";".join([x for i in own if (x := found[i].body)]) for own in lists], pa.binary()),
        "codes": pa.array([codes[x] for x in held], pa.list_(pa.int64())),
    }
    yield from _rows(batch.column("doc_id"), columns, codes, ns)


def _sum_block(rows: pa.Table, held: pa.Table) -> pa.Table:
    """Counts of a block's pairs summed up per unit."""
    at = held.column("pos").to_numpy()
    size = int(at.max()) + 1 if len(at) else 0
    n_docs, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    n_docs[at] = held.column("n_docs").to_numpy()
    best[at] = held.column("best").to_numpy().astype(np.int64)
    n_best, count_sum = [], []
    for idx, mult, bad in zip(*(rows.column(c).to_pylist() for c in ("idx", "mult", "bad"))):
        where, times = _unpacked(idx), _unpacked(mult)
        # Pairs of documents that count nowhere have no entry.
        there = where < size
        where, times = where[there], times[there]
        n_best.append(0 if bad else int(times @ best[where]))
        count_sum.append(0 if bad else int(times @ n_docs[where]))
    rows = rows.select(["doc_id", "kind", "key", "n_a", "n_b", "n_groups", "n_links", "sha"])
    return rows.append_column("n_best", pa.array(n_best, pa.int64())).append_column(
        "count_sum", pa.array(count_sum, pa.int64())
    )


# --- long documents ----------------------------------------------------------------------


def _ranges(doc_id: pa.Array, text: str, size: int, cuts: bool) -> Iterator[pa.RecordBatch]:
    """Byte ranges of a text, each with the whole cells at its limits."""
    data = text.encode()
    limits = [(0, 0, 0)]
    floor = 0
    for b in range(size, len(data), size) if cuts else ():
        if b <= limits[-1][0]:
            continue
        start, end = _cut_before(data, b, floor), _cut_after(data, b)
        floor = start
        # A large cell goes to the range that it begins in.
        limit = (end, end, end) if end - start > size // 4 else (b, start, end)
        if limit[0] < len(data):
            limits.append(limit)
    limits.append((len(data),) * 3)
    key = str(uuid.uuid4())
    for k, ((lo, start, _), (hi, _, end)) in enumerate(zip(limits, limits[1:])):
        arrays = [
            doc_id, pa.array([key]), pa.array([k], pa.int32()), pa.array([lo - start], pa.int64()),
            pa.array([hi - start], pa.int64()), pa.array([data[start:end].decode()]),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "k", "lo", "hi", "text"])


def _is_cut(data: bytes, at: int) -> bool:
    """Whether a blank or line feed here follows other text."""
    start = at - 1
    while start > 0 and data[start] & 0xC0 == 0x80:
        start -= 1
    return at > 0 and not data[start:at].decode().isspace()


def _cut_before(data: bytes, at: int, floor: int) -> int:
    """The last cut at or before `at`, or `floor`."""
    at += 1
    while (at := max(data.rfind(b" ", floor, at), data.rfind(b"\n", floor, at))) > floor:
        if _is_cut(data, at):
            return at
    return floor


def _cut_after(data: bytes, at: int) -> int:
    """The first cut at or after `at`, or the end."""
    for found in _BLANK.finditer(data, at):
        if _is_cut(data, found.start()):
            return found.start()
    return len(data)


def compose(left: dict, right: dict) -> dict:
    """Two neighbouring fragments as one; the group that closes between them is a seam."""
    out = {c: left[c] + right[c] for c in ("n_a", "n_b", "n_groups", "n_links")}
    out |= {"key": left["key"], "k": left["k"], "bad": left["bad"] or right["bad"]}
    between = []
    out |= {"has_end": left["has_end"] or right["has_end"], "last_k": left["last_k"]}
    for c in "ab":
        own, other = left[f"suf_{c}"] if left["has_end"] else left[f"pre_{c}"], right[f"pre_{c}"]
        out[f"pre_{c}"] = left[f"pre_{c}"] if left["has_end"] else own + other
        out[f"suf_{c}"] = own + other if left["has_end"] and not right["has_end"] else right[f"suf_{c}"]
    if right["has_end"]:
        out["last_k"] = right["last_k"]
        if left["has_end"]:
            a, b = (left[f"suf_{c}"] + right[f"pre_{c}"] for c in "ab")
            between = [{"at": left["last_k"], "a": a, "b": b}]
            out["n_groups"] += 1
            out["n_links"] += len(a) * len(b)
    return out | {"seams": left["seams"] + between + right["seams"]}


def _long_documents(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Composed fragments: `key, n_a, n_b, n_groups, n_links, bad, seams` per document, and the
    links of its seams as `key, code, n`."""
    found = units.where("kind = 'range'").select(
        "key", "k", F.when(F.col("has_end"), F.col("k")).otherwise(-1).alias("last_k"),
        "n_a", "n_b", "n_groups", "n_links", "bad", "has_end", "pre_a", "pre_b", "suf_a", "suf_b",
        F.expr(f"cast(array() as {_SEAMS.split(' ', 1)[1]})").alias("seams"),
    )
    found = stored(found, "fragments")
    most = found.agg(F.max("k")).first()[0] or 0

    def joined(table: pa.Table) -> pa.Table:
        rows = sorted(table.drop_columns(["_node"]).to_pylist(), key=lambda row: row["k"])
        out = rows[0]
        for row in rows[1:]:
            out = compose(out, row)
        return pa.Table.from_pylist([out], table.drop_columns(["_node"]).schema)

    step = 1
    while step <= most:
        step *= FAN_IN
        node = F.floor(F.col("k") / step).alias("_node")
        found = stored(found.select("*", node).groupBy("key", "_node").applyInArrow(joined, _REDUCED), "fragments")
    # What is open at the start of a text is its first group.
    first = F.struct(F.lit(-1).alias("at"), F.col("pre_a").alias("a"), F.col("pre_b").alias("b"))
    found = found.select(
        "key", "n_a", "n_b", "bad",
        (F.col("n_groups") + 1).alias("n_groups"),
        (F.col("n_links") + F.size("pre_a") * F.size("pre_b")).alias("n_links"),
        F.concat(F.array(first), "seams").alias("seams"),
    )
    links = (
        found.select("key", F.explode("seams").alias("s"))
        .select("key", F.explode("s.a").alias("a"), F.col("s.b").alias("b"))
        .select("key", "a", F.explode("b").alias("b"))
    )
    code = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("code")
    return found, links.select("key", code).groupBy("key", "code").agg(F.count("*").alias("n"))


def _hashes(units: DataFrame, long_docs: DataFrame) -> DataFrame:
    """`key, sha` of long documents: groups are sorted by place and streamed."""
    def written(column: str):
        return F.array_join(F.col(column).cast("array<string>"), ",")

    bodies = units.where("kind = 'range'").select("key", (2 * F.col("k")).alias("at"), "body")
    seams = long_docs.select("key", F.explode("seams").alias("s")).select("key", "s.*")
    seams = seams.select(
        "key", (2 * F.col("at") + 1).alias("at"), F.concat_ws("|", written("a"), written("b")).cast("binary").alias("body")
    )
    parts = bodies.where(F.octet_length("body") > 0).unionByName(seams)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([digest.hexdigest()])], names=["key", "sha"])

        for batch in batches:
            for key, body in zip(batch.column("key").to_pylist(), batch.column("body").to_pylist()):
                if key != at:
                    if at is not None:
                        yield done()
                    at, digest = key, hashlib.sha256(body)
                else:
                    digest.update(b";" + body)
        if at is not None:
            yield done()

    return parts.repartition("key").sortWithinPartitions("key", "at").select("key", "body").mapInArrow(hashed, "key string, sha string")
