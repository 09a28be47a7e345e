"""Repair of the turn structure of conversations, by cheapest edits.

A conversation is in order when the initials of its roles read `(s?(ua)+)?`. Its rows may
be kept (0), given the role user or assistant (1) or deleted (2), and empty rows of user
or assistant may be put in anywhere (5 each). Blank rows and repeated rows have to be
deleted; a row whose text breaks off costs 5 unless it is deleted. Of the cheapest ways the
one whose edits read least, by their initials D, I, K, R in ASCII order, is taken.

Rows are dealt out by conversation, sorted by turn and streamed through `mapInPandas`. What is
carried from row to row, and from one Arrow batch to the next, is the state of a dynamic
programme with four places in the pattern: per place the cost, the rank of its edits among
those of the other places, and a running hash of the repaired text. Back pointers take
three bytes a row and leave memory for a file of the task beyond `SPILL_BYTES`; so a
conversation of any length needs little memory but for its own result row. Which rows repeat an
earlier one is found before, by an aggregation on conversation and digest.

Defined results: a null role or text counts as one space, a null conversation is a
conversation of its own, null turns come first. Rows of one turn are taken by role, then
text, so rows that are equal in all of these stand together, the later ones repeated. An empty
table has no conversations. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.storage import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# Back pointers of one conversation kept in memory.
SPILL_BYTES = 8 << 20

# Places in the pattern: nothing yet, after s, after u, after a.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_WANTED = {0: "u", 1: "u", 2: "a", 3: "u"}
_ROLE = {"u": "user", "a": "assistant"}
_ENDS = (0, 3)
_LEGAL = {"su", "ua", "au"}
# No place is worth keeping that costs more than any other by this: two rows put in and
# one deleted lead from every place to every other.
_SLACK = 2 * INSERT + DELETE

REPAIRED = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: counts of faults, cost, edits and hash of what remains.

    `turns` has `conv_id, turn, role, text` and may have a boolean `dropped`: such rows count
    for nothing, but their conversation is reported. `repaired_sha256` is that of the lines
    `role:text` of the repaired conversation, joined by newlines.
    """
    dropped = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in turns.columns else F.lit(False)
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
        dropped.alias("dropped"),
    )
    return _stream(_with_faults(rows))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults, the same at every run; see `dropped` above.

    What happens to a row follows from the CRC-32 of `conv_id:turn`, modulo 20: 0 drops it,
    1 empties its text, 2 takes out its `.`, `!` and `?`, 3 repeats it, 4 gives it the role
    user. Nulls count as one space.
    """
    name = F.concat_ws(
        ":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    )
    which = F.crc32(name.cast("binary")) % 20
    text = F.coalesce(F.col("text"), F.lit(" "))
    return turns.select(
        "conv_id",
        "turn",
        F.when(which == 4, "user").otherwise(F.coalesce(F.col("role"), F.lit(" "))).alias("role"),
        F.when(which == 1, "").when(which == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (which == 0).alias("dropped"),
        F.explode(F.when(which == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


_STREAMED = ("conv_id", "turn", "role", "text", "dropped", "fault")


def _with_faults(rows: DataFrame) -> DataFrame:
    """Adds `fault`: 0 none, 1 blank, 2 repeats a row of an earlier turn, 3 truncated."""
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    live = ~F.col("dropped") & (last != "")
    # Role and text behind lengths, so that no two pairs run together.
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumn("_last", last).withColumn("_digest", F.when(live, digest))
    # Few pairs of role and text are there in several turns; only those are joined back.
    first = F.coalesce(F.min("turn"), F.lit(0)).alias("_first")
    nulls = F.count_if(F.col("turn").isNull()).alias("_nulls")
    several = stored(
        rows.where(F.col("_digest").isNotNull())
        .groupBy(F.col("conv_id").alias("_conv"), F.col("_digest").alias("_key"))
        .agg(first, F.max("turn").alias("_latest"), nulls, F.count("turn").alias("_turns"))
        .where("_first < _latest or (_nulls > 0 and _turns > 0)")
        .select("_conv", "_key", F.when(F.col("_nulls") == 0, F.col("_first")).alias("_first")),
        "repeated-turns",
    )
    met = rows.join(several, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_digest") == F.col("_key")), "left")
    later = F.col("_key").isNotNull() & F.col("turn").isNotNull() & (F.col("_first").isNull() | (F.col("turn") > F.col("_first")))
    fault = F.when(F.col("_last") == "", 1).when(later, 2).when(~F.col("_last").isin(".", "!", "?"), 3).otherwise(0)
    return met.select(*_STREAMED[:-1], fault.cast("int").alias("fault"))


def _stream(rows: DataFrame) -> DataFrame:
    conv = F.col("conv_id")
    rows = rows.repartition("conv_id").sortWithinPartitions(
        conv.asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"
    )
    kind = rows.schema["conv_id"].dataType
    # As text, as pandas has no whole numbers beside nulls.
    texts = {c: F.col(c).cast("string") for c in ("conv_id", "turn")}
    return rows.withColumns(texts).mapInPandas(_repair, REPAIRED).withColumn("conv_id", conv.cast(kind))


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Finished conversations of each batch; the open one goes on in the next."""
    names = [part.split()[0] for part in REPAIRED.split(", ")]
    at: Conversation | None = None
    for batch in batches:
        done = []
        for conv, turn, role, text, dropped, fault in zip(*(batch[c] for c in _STREAMED)):
            if at is None or at.conv != conv:
                if at is not None:
                    done.append(at.finish())
                at = Conversation(conv)
            if not dropped:
                at.add(None if turn is None else int(turn), role, text, fault)
        if done:
            yield pd.DataFrame(done, columns=names)
    if at is not None:
        yield pd.DataFrame([at.finish()], columns=names)


@lru_cache(maxsize=None)
def _step(costs: tuple[int | None, ...], ranks: tuple[int, ...], initial: str, fault: int):
    """What a row does to the state: new costs and ranks per place, and for each new place
    where it comes from, how many rows are put in before, and the edit.

    `costs` are counted from the least of them, so there are few different states. Edits up
    to a row never begin those of another place up to the same row, as both end in an edit
    of this row: ranks, and then the edits added, decide between equal costs.
    """
    best: dict[int, tuple] = {}
    for place, cost in enumerate(costs):
        if cost is None:
            continue
        now = place
        for put_in in range(3):
            options = [("D", now, DELETE)]
            if fault not in (1, 2):
                extra = TRUNCATED if fault == 3 else 0
                if (now, initial) in _NEXT:
                    options.append(("K", _NEXT[now, initial], KEEP + extra))
                options.append(("R", _NEXT[now, _WANTED[now]], REROLE + extra))
            for edit, to, price in options:
                key = (cost + put_in * INSERT + price, ranks[place], "I" * put_in + edit, place, put_in)
                if to not in best or key < best[to]:
                    best[to] = key
            now = _NEXT[now, _WANTED[now]]
    least = min(key[0] for key in best.values())
    live = {to: key for to, key in best.items() if key[0] <= least + _SLACK}
    order = sorted(live, key=lambda to: live[to][1:3])
    new_costs = tuple(live[to][0] - least if to in live else None for to in range(4))
    new_ranks = tuple(order.index(to) if to in live else 0 for to in range(4))
    moves = tuple((to, *live[to][3:5], live[to][2][-1]) for to in live)
    packed = 0
    for to, source, put_in, edit in moves:
        packed |= (source | put_in << 2 | "DKR".index(edit) << 4) << 6 * to
    return new_costs, new_ranks, least, moves, packed.to_bytes(3, "little")


class Conversation:
    """The state carried through the rows of one conversation."""

    def __init__(self, conv: object):
        self.conv = conv
        self.gaps = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.first_turn = self.turn = self.before = None
        self.turns = 0
        self.costs: tuple[int | None, ...] = (0, None, None, None)
        self.ranks = (0, 0, 0, 0)
        # Per place a running hash and whether a line is in it already.
        self.hashes: list = [(hashlib.sha256(), False), None, None, None]
        self.pointers = tempfile.SpooledTemporaryFile(max_size=SPILL_BYTES)
        self.rows = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        if self.before is not None:
            if fault not in (1, 2) and self.before == (turn, role, text):
                fault = 2
            self.illegal += self.before[1][:1] + initial not in _LEGAL
        self.before = (turn, role, text)
        if turn is not None and turn != self.turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turn = turn
            self.turns += 1
        self.blank += fault == 1
        self.duplicate += fault == 2
        self.truncated += fault == 3
        known = initial if initial in ("s", "u", "a") else ""
        self.costs, self.ranks, least, moves, packed = _step(self.costs, self.ranks, known, int(fault))
        self.cost += least
        old, self.hashes = self.hashes, [None] * 4
        line = None
        for to, source, put_in, edit in moves:
            digest, begun = old[source]
            if put_in or edit != "D":
                digest = digest.copy()
                for _ in range(put_in):
                    begun = _add_line(digest, begun, f"{_ROLE[_WANTED[source]]}:".encode())
                    source = _NEXT[source, _WANTED[source]]
                if edit != "D":
                    line = line or text.encode("utf-8", "surrogatepass")
                    name = role if edit == "K" else _ROLE[_WANTED[source]]
                    begun = _add_line(digest, begun, name.encode("utf-8", "surrogatepass") + b":", line)
            self.hashes[to] = (digest, begun)
        self.pointers.write(packed)
        self.rows += 1

    def finish(self) -> tuple:
        if self.turns:
            self.gaps = self.turn - self.first_turn + 1 - self.turns
        ends = []
        for place, cost in enumerate(self.costs):
            now, put_in = place, 0
            while cost is not None and now not in _ENDS:
                now, put_in = _NEXT[now, _WANTED[now]], put_in + 1
            if cost is not None:
                ends.append((cost + put_in * INSERT, self.ranks[place], put_in, place))
        cost, _, put_in, place = min(ends)
        digest, begun = self.hashes[place]
        now = place
        for _ in range(put_in):
            begun = _add_line(digest, begun, f"{_ROLE[_WANTED[now]]}:".encode())
            now = _NEXT[now, _WANTED[now]]
        audit = self._edits(place) + "I" * put_in
        return (
            self.conv, self.gaps, self.blank, self.duplicate, self.truncated, self.illegal,
            self.cost + cost, audit, digest.hexdigest(),
        )

    def _edits(self, place: int) -> str:
        """Follow the back pointers from the last row to the first, block by block."""
        edits = bytearray()
        block = 1 << 16
        for start in range((self.rows - 1) // block * block, -1, -block):
            self.pointers.seek(3 * start)
            part = self.pointers.read(3 * min(block, self.rows - start))
            for at in range(len(part) - 3, -1, -3):
                move = int.from_bytes(part[at : at + 3], "little") >> 6 * place
                edits += b"DKR"[move >> 4 & 3 : (move >> 4 & 3) + 1] + b"I" * (move >> 2 & 3)
                place = move & 3
        self.pointers.close()
        edits.reverse()
        return edits.decode()


def _add_line(digest, begun: bool, *parts: bytes) -> bool:
    if begun:
        digest.update(b"\n")
    for part in parts:
        digest.update(part)
    return True
