"""Exact ids of a `tokenizers` file, at the price of its distinct words.

Both supported kinds of file cut a text before they merge anything, and never
across a blank that stands alone between two other characters. A text is therefore
a sequence of blank-separated chunks, and the ids of a chunk do not depend on its
neighbours. A worker keeps the ids of chunks it has met and asks the tokenizer for
new ones only; the texts themselves are cut and put together by Arrow and numpy.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Chunks a worker remembers (about 150 bytes each) in each of two generations.
REMEMBERED = 600_000
# Longer chunks are encoded but not remembered.
LONGEST_KEPT = 64
# So many chunks are given to the tokenizer at once.
ASKED = 1_000
# Texts are handled in runs of about so many bytes (a longer one alone).
RUN_BYTES = 8 << 20

_LIBC = ctypes.CDLL(None)
_SPACE = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_RUNS = rf"[{_SPACE}][{_SPACE}]|^[{_SPACE}]|[{_SPACE}]$|\x00|[^ \nA-Za-z0-9\P{{Z}}]|[\t\x0b\f\r\x1c-\x1f\x{{85}}]"
# Between a letter and an ASCII sign, words end for both kinds of file. Letters are those that
# lower-casing and composition leave letters; `|` is left alone, as special tokens hold it.
_SIGN = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([!-/:-@\[-`{}~])"
_ALONE = re.compile(r"(?<=\S) (?=\S)")


def runs_of(texts: pa.Array, size: int = RUN_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of about `size` bytes each.

    They are copies: some string kernels of Arrow misread arrays with an offset.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield texts.take(pa.array(np.arange(start, stop)))
        start = stop
    _give_back()


def _give_back() -> None:
    """Return freed memory to the system: a worker lives through many stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def one_thread() -> None:
    """Keep the tokenizer to the core that Spark gave the task: threads of its own cost more
    CPU time than they save, as all cores have tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


@contextmanager
def no_cycle_search() -> Iterator[None]:
    """For code that makes many small objects, none of which refer back to themselves."""
    was_on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was_on:
            gc.enable()


class ChunkEncoder:
    """Turns texts into ids. `drops_blanks`: white space leaves no ids."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        one_thread()
        self.tokenizer = Tokenizer.from_file(file)
        self.drops_blanks = not self.tokenizer.encode(" ", add_special_tokens=False).ids
        added = pa.array([x.content for x in self.tokenizer.get_added_tokens_decoder().values()], pa.string())
        self.cuts_signs = not pc.any(pc.match_substring_regex(added, _SIGN)).as_py()
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """The ids of each of these different chunks as bytes."""
        known, old = self.known, self.old
        found = [*map(known.get, chunks)]
        new = []
        for i, ids in enumerate(found):
            if ids is None:
                ids = old.get(chunks[i])
                if ids is None:
                    new.append(i)
                else:
                    found[i] = known[chunks[i]] = ids
        encode = self.tokenizer.encode_batch_fast
        # The library's results are large: a few at a time.
        for at in range(0, len(new), ASKED):
            part = new[at : at + ASKED]
            texts = [chunks[i] for i in part]
            for i, x, e in zip(part, texts, encode(texts, add_special_tokens=False)):
                found[i] = ids = array("I", e.ids).tobytes()
                if len(x) <= LONGEST_KEPT:
                    known[x] = ids
        if len(known) > REMEMBERED:
            self.old, self.known = known, {"": b""}
        return found

    def _simple(self, texts: pa.Array) -> pa.Array:
        """Lists of chunks of texts in which every blank stands alone."""
        if self.drops_blanks:
            texts = pc.replace_substring(texts, "\n", " ")
            if self.cuts_signs:
                texts = pc.replace_substring_regex(texts, _SIGN, r"\1 \2")
            return pc.split_pattern(texts, " ")
        if self.cuts_signs:
            texts = pc.replace_substring_regex(texts, _SIGN, "\\1\0\\2")
        lines = pc.replace_substring(texts, "\n", "\0\n\0")
        return pc.split_pattern(pc.replace_substring(lines, " ", "\0 "), "\0")

    def _any(self, text: str) -> list[str]:
        """Chunks of any text: cut only at blanks that surely stand alone."""
        first, *rest = _ALONE.split(text)
        return [first, *(" " + x for x in rest)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text ends.

        Null counts as empty text.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.drops_blanks:
            lists = self._simple(texts)
        else:
            odd = pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False)
            if odd.any():
                lists = pa.array(
                    [
                        self._any(x) if is_odd else self._simple(pa.array([x])).to_pylist()[0]
                        for x, is_odd in zip(texts.to_pylist(), odd)
                    ],
                    pa.large_list(pa.large_string()),
                )
            else:
                lists = self._simple(texts)
        words = lists.flatten().dictionary_encode()
        which = words.indices.to_numpy()
        with no_cycle_search():
            ids = self._encoded(words.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(lengths) - lengths
        pool = np.frombuffer(b"".join(ids), "<u4")
        taken = lengths[which]
        ends = np.cumsum(taken)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - (ends - taken), taken)
        of_text = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        text_ends = np.concatenate([[0], ends])[of_text]
        return pool[at], text_ends


@lru_cache(maxsize=4)
def encoder(file: str) -> ChunkEncoder:
    """The worker's encoder for a file; it lives as long as the worker."""
    return ChunkEncoder(file)
