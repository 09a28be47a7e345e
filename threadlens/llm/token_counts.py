"""Token counts of a unigram vocabulary without tokens (operator 7).

An Aho-Corasick automaton lists all vocabulary pieces in a word; a Viterbi pass over
their ends keeps the best score and the number of pieces that reach it, and nothing
to trace back. It decides as the `tokenizers` unigram model does: scores are added
from the left, an equal score does not replace the one found from an earlier start,
a character without a piece of its own costs ten less than the least score, and such
characters become bytes where the vocabulary has all bytes, else runs of them are one
unknown token. Words are told apart by blanks, as its metaspace splitter does, and a
worker keeps the counts of words it has met.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.encoding import runs_of

MARK = "▁"
UNKNOWN_COST = 10.0
REMEMBERED = 800_000
LONGEST_KEPT = 64

COUNTS = "doc_id long, n_tokens long, n_words long, n_unknown long"


def vocabulary(file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class CountingViterbi:
    """Counts the tokens of words; `fallback`: unknown characters become bytes."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                # Of pieces named twice the last id counts, as in a table of names.
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {p for p, _ in pieces}
        self.fallback = all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown = min(s for _, s in pieces) - UNKNOWN_COST
        self.known: dict[str, tuple[int, int]] = {}

    def count(self, word: str) -> tuple[int, int]:
        """Tokens and unknown characters of a word on its best path."""
        size = len(word)
        found: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        single = [False] * size
        for end, (length, score) in self.automaton.iter(word):
            found[end].append((end + 1 - length, score))
            if length == 1:
                single[end] = True
        best, tokens, strange = [0.0] * (size + 1), [0] * (size + 1), [0] * (size + 1)
        open_run = [False] * (size + 1)
        for end in range(size):
            top, source = None, -1
            # Longest pieces come first, so of equal scores the earliest start stays.
            for start, score in found[end]:
                candidate = best[start] + score
                if top is None or candidate > top:
                    top, source = candidate, start
            at = end + 1
            if not single[end]:
                candidate = best[end] + self.unknown
                if top is None or candidate > top:
                    best[at], strange[at], open_run[at] = candidate, strange[end] + 1, True
                    if self.fallback:
                        tokens[at] = tokens[end] + len(word[end].encode("utf-8", "surrogatepass"))
                    else:
                        tokens[at] = tokens[end] + (not open_run[end])
                    continue
            best[at], tokens[at], strange[at] = top, tokens[source] + 1, strange[source]
        return tokens[size], strange[size]

    def counts(self, words: list[str]) -> list[tuple[int, int]]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        found = [*map(known.get, words)]
        for i, pair in enumerate(found):
            if pair is None:
                found[i] = pair = self.count(words[i])
                if len(words[i]) <= LONGEST_KEPT:
                    known[words[i]] = pair
        return found


@lru_cache(maxsize=2)
def counter(file: str) -> CountingViterbi:
    """The worker's counter for a vocabulary file."""
    return CountingViterbi(vocabulary(file))


def count_run(counter: CountingViterbi, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, words and unknown characters of each text of an Arrow array."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    marked = pc.replace_substring(texts, " ", MARK)
    # A text that does not begin with a mark gets one; each mark begins a word.
    mark = pa.scalar(MARK, pa.large_string())
    added = pc.binary_join_element_wise(mark, marked, pa.scalar("", pa.large_string()))
    first = pc.if_else(pc.starts_with(marked, MARK), marked, added)
    lists = pc.split_pattern(first, MARK)
    words = lists.flatten().dictionary_encode()
    pairs = counter.counts([MARK + w for w in words.dictionary.to_pylist()])
    values = np.array(pairs, np.int64).reshape(-1, 2)[words.indices.to_numpy()]
    sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(values, axis=0)])
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    # What stands before the first mark is an empty word that is not there.
    empty = np.array(counter.counts([MARK]), np.int64)[0]
    total = sums[ends] - sums[starts] - empty
    some = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    n = ends - starts - 1
    return total[:, 0] * some, n * some, total[:, 1] * some


def _counting(file: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for run in runs_of(batch["text"]):
                tokens, words, strange = count_run(counter(file), run)
                keys = batch["doc_id"].slice(done, len(run))
                done += len(run)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(tokens), pa.array(words), pa.array(strange)],
                    names=["doc_id", "n_tokens", "n_words", "n_unknown"],
                )

    return count


def count_tokens(docs: DataFrame, file: str) -> DataFrame:
    """`doc_id`, `n_tokens`, `n_words` (blank-separated) and `n_unknown` (characters).

    `file` is a sentencepiece file, whose pieces and scores are taken as a unigram
    vocabulary. Null and empty texts have 0 of each. One row per input row, also for
    repeated rows and rows without `doc_id`; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_counting(file), COUNTS)
