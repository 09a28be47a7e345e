"""Exact set-similarity join on word shingles with set-relation skipping (operator 9).

Sets with equal members become one class first. Each class puts the beginning of its
shingles, rarest first, into index lists: two sets that reach the threshold share one
of those, and at positions that leave room for the overlap they need. Pairs that
cannot have it, by position and size, are skipped inside the lists.

Links are wanted up to connection, so lists are not multiplied out. In star rounds
every set is compared with the list member that shares most of its lists' centres.
What a comparison yields is kept: sets in one component need no comparison with each
other, and the overlaps of two sets with the same centre bound their own overlap from
above. Only pairs of different components that pass this bound, one of them outside
the list's largest component, are compared in the last round, which makes the result
complete: no link between two components can be missed.

Rarity comes from a table of 65,536 shingle counts over the whole corpus. It decides
the order alone, so any error in it costs time, not links. Lists are dealt out in
blocks where the table shows a frequent shingle, and comparisons with a busy centre
in blocks of members. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.columns import unused
from threadlens.llm.components import components
from threadlens.llm.encoding import runs_of
from threadlens.storage import key_side, stored

WORDS = 5
PERCENT = 80
BUCKETS = 1 << 16
# Members of a list, or of a busy centre, that are dealt out together.
BLOCK = 1_000
STAR_ROUNDS = 2

_PRIMES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]

SETS = "doc_id long, t long, n long, h1 long, h2 long, loads array<int>"
ENTRIES = "tok long, doc_id long, n int, pos int, slot int, slots int"
OVERLAPS = "a long, b long, na int, nb int, same int"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (A-Z lower-cased, ASCII blanks)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    found = lists.flatten().dictionary_encode()
    hashes = np.fromiter(
        (xxhash.xxh3_64_intdigest(w) if w else 0 for w in found.dictionary.cast(pa.large_binary()).to_pylist()),
        np.uint64,
        len(found.dictionary),
    )
    filled = pc.greater(pc.binary_length(found.dictionary), 0).to_numpy(zero_copy_only=False)
    which = found.indices.to_numpy()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    if not filled.all():
        real = filled[which]
        which, owner = which[real], owner[real]
        counts = np.bincount(owner, minlength=len(texts))
    each = hashes[which]
    rolled = np.zeros(max(len(each) - words + 1, 0), np.uint64)
    for k in range(words):
        rolled = _mixed(rolled * _PRIMES[0] + each[k : k + len(rolled)])
    ends = np.cumsum(counts)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist()):
        if count >= words:
            out.append(np.unique(rolled[end - count : end - words + 1]))
        elif count:
            value = np.full(1, count, np.uint64)
            for x in each[end - count : end]:
                value = _mixed(value * _PRIMES[1] + x)
            out.append(value)
        else:
            out.append(rolled[:0])
    return out


def _measure(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SETS.split(", ")]
        loads = np.zeros(BUCKETS, np.int64)
        kind = pa.list_(pa.int32())
        for batch in batches:
            done = 0
            for run in runs_of(batch["text"]):
                rows = []
                for own in shingle_sets(run, words):
                    np.add.at(loads, (own >> np.uint64(48)).astype(np.int64), 1)
                    rows.append((len(own), _mixed(own * _PRIMES[1]).sum(dtype=np.uint64), _mixed(own * _PRIMES[2]).sum(dtype=np.uint64)))
                n, h1, h2 = (np.array(x, np.uint64).view(np.int64) for x in zip(*rows))
                part = batch.slice(done, len(run))
                done += len(run)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["t"], pa.array(n), pa.array(h1), pa.array(h2), pa.nulls(len(run), kind)], names=names
                )
        one = [pa.nulls(1, pa.int64())] * 5
        yield pa.RecordBatch.from_arrays([*one, pa.array([loads.astype(np.int32)], kind)], names=names)

    return measure


def _prefixes(loads: np.ndarray, words: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    usual = np.median(loads)
    # What stands out of the table's noise is a frequent shingle.
    extra = np.where(loads - usual > 8 * np.sqrt(usual + 1), loads - usual, 0)
    slots_of = (extra // BLOCK + 1).astype(np.int32)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for run in runs_of(batch["text"]):
                ids = batch["doc_id"].slice(done, len(run)).to_numpy(zero_copy_only=False)
                done += len(run)
                toks, docs, sizes, places = [], [], [], []
                for doc, own in zip(ids, shingle_sets(run, words)):
                    n = len(own)
                    if n:
                        first = n - -(-percent * n // 100) + 1
                        order = np.argsort(loads[(own >> np.uint64(48)).astype(np.int64)], kind="stable")[:first]
                        toks.append(own[order])
                        docs.append(np.full(first, doc, np.int64))
                        sizes.append(np.full(first, n, np.int32))
                        places.append(np.arange(first, dtype=np.int32))
                if toks:
                    tok, doc = np.concatenate(toks), np.concatenate(docs)
                    slots = slots_of[(tok >> np.uint64(48)).astype(np.int64)]
                    slot = (_mixed(doc.view(np.uint64)) % slots.astype(np.uint64)).astype(np.int32)
                    columns = [tok.view(np.int64), doc, np.concatenate(sizes), np.concatenate(places), slot, slots]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in columns], names=[x.split()[0] for x in ENTRIES.split(", ")]
                    )

    return prefix


def _compare(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, sets = None, []
        for batch in batches:
            rows = []
            done = 0
            for run in runs_of(batch["text"]):
                part = batch.slice(done, len(run))
                done += len(run)
                for a, b, own in zip(part["a"].to_pylist(), part["b"].to_pylist(), shingle_sets(run, words)):
                    if b is None:
                        # A centre, or another text under the same id.
                        if a != centre:
                            sets = [own]
                        elif not any(np.array_equal(own, x) for x in sets):
                            sets = [*sets, own]
                        centre = a
                    else:
                        for other in sets:
                            same = np.intersect1d(other, own, assume_unique=True).size
                            rows.append((a, b, len(other), len(own), same))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in OVERLAPS.split(", ")])

    return compare


def overlaps(pairs: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The overlap of each pair `a`, `b` (stored, distinct) of ids in `docs`.

    The members of a centre `a` meet it in blocks; a task holds one centre at a time.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("_n"))
    blocks = stored(counts.select("a", F.expr(f"int(_n div {BLOCK}) + 1").alias("blocks")), "blocks")
    ids = stored(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    texts = docs.join(key_side(ids), "doc_id", "left_semi").select("doc_id", "text")
    members = pairs.join(blocks, "a").withColumn("slot", F.expr("pmod(xxhash64(b), blocks)").cast("int"))
    members = key_side(stored(members.select("a", "slot", "b"), "members"))
    # Where ids and pairs are few enough to be sent around, texts move once, to their centre.
    members = texts.withColumnRenamed("doc_id", "b").join(members, "b").select("a", "slot", "b", "text")
    centres = texts.withColumnRenamed("doc_id", "a").join(key_side(blocks), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("slot"), F.lit(None).cast("long").alias("b"), "text"
    )
    rows = members.unionByName(centres).repartition("a", "slot").sortWithinPartitions("a", "slot", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "text").mapInArrow(_compare(words), OVERLAPS)


def _needed(na: Column, nb: Column, percent: int) -> Column:
    """The least overlap with which two sets of these sizes reach the threshold."""
    return F.ceil(percent * (na + nb) / (100 + percent))


def _linked(found: DataFrame, percent: int) -> DataFrame:
    return found.where(100 * F.col("same") >= percent * (F.col("na") + F.col("nb") - F.col("same")))


def _possible(percent: int) -> Column:
    """Whether sets x and y can link if the entries `n`, `pos` and `cn`, `cpos` are the first they share."""
    least = _needed(F.col("n"), F.col("cn"), percent)
    return (F.col("n") - F.col("pos") >= least) & (F.col("cn") - F.col("cpos") >= least)


def _with_components(entries: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return entries.withColumn("comp", F.col("doc_id"))
    known = comps.withColumnRenamed("node", "doc_id")
    return entries.join(known, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))


def _star_pairs(entries: DataFrame, seed: int, percent: int) -> DataFrame:
    """For each set the list centre of another component that it shares most lists with.

    In the first round the centre has the list's shingle earliest, so least of its own
    before it: in a family of edited copies that is one close to their origin. Later
    rounds take others by chance.
    """
    turn = F.pmod(F.col("tok"), F.lit(8))
    order = F.xxhash64("doc_id", turn, F.lit(seed)) if seed else F.struct("pos", F.xxhash64("doc_id"))
    place = F.struct(order.alias("o"), "doc_id", "n", "pos", "comp")
    lists = entries.groupBy("tok").agg(F.min(place).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    lists = lists.where("lo != hi").select(
        "tok", F.col("c.doc_id").alias("centre"), F.col("c.n").alias("cn"), F.col("c.pos").alias("cpos"), F.col("c.comp").alias("ccomp")
    )
    found = entries.join(lists, "tok").where((F.col("comp") != F.col("ccomp")) & _possible(percent))
    counted = found.groupBy("doc_id", "centre").agg(F.count("*").alias("shared"))
    best = counted.groupBy("doc_id").agg(F.max(F.struct("shared", "centre")).alias("m"))
    return best.select(F.col("m.centre").alias("a"), F.col("doc_id").alias("b"))


def _last_pairs(entries: DataFrame, stars: list[DataFrame], percent: int) -> DataFrame:
    """All pairs of different components that may still link.

    `stars` must hold ids with one text only: the overlap of one text bounds no other's.
    """
    sizes = entries.groupBy("tok", "comp").agg(F.count("*").alias("k"))
    lists = sizes.groupBy("tok").agg(F.max(F.struct("k", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1")
    open_ = entries.join(lists.select("tok", F.col("m.comp").alias("major")), "tok")
    for i, star in enumerate(stars):
        best = star.groupBy(F.col("b").alias("doc_id")).agg(F.max(F.struct("same", "a")).alias("s"))
        best = best.select("doc_id", F.col("s.a").alias(f"star{i}"), F.col("s.same").alias(f"same{i}"))
        open_ = open_.join(best, "doc_id", "left")
    open_ = stored(open_, "open_lists")
    x = open_.where("comp != major")
    y = open_.toDF(*("tok" if c == "tok" else f"c{c}" for c in open_.columns))
    least = _needed(F.col("n"), F.col("cn"), percent)
    may = F.lit(True)
    for i in range(len(stars)):
        # A pair that was compared before has its answer.
        may = may & ~F.coalesce(F.col(f"star{i}") == F.col("cdoc_id"), F.lit(False))
        may = may & ~F.coalesce(F.col(f"cstar{i}") == F.col("doc_id"), F.lit(False))
        for j in range(len(stars)):
            # What both share with one centre, and what one has besides, bounds what they share.
            bound = F.least(
                F.col(f"same{i}") + F.col("cn") - F.col(f"csame{j}"), F.col(f"csame{j}") + F.col("n") - F.col(f"same{i}")
            )
            may = may & ~F.coalesce((F.col(f"star{i}") == F.col(f"cstar{j}")) & (bound < least), F.lit(False))
    once = (F.col("ccomp") == F.col("cmajor")) | (F.col("doc_id") < F.col("cdoc_id"))
    met = x.join(y, (x["tok"] == y["tok"]) & (F.col("comp") != F.col("ccomp")) & once & _possible(percent) & may)
    pair = [F.least("doc_id", "cdoc_id").alias("a"), F.greatest("doc_id", "cdoc_id").alias("b")]
    met = stored(met.select(*pair).distinct(), "met")
    # A pair's overlap is what both list entries share and, at most, what is not listed of
    # the larger remainder: 80 per cent of a set less one.
    ids = stored(met.select(F.col("a").alias("doc_id")).unionByName(met.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    own = open_.select("doc_id", "n", "tok").join(key_side(ids), "doc_id", "left_semi")
    own = own.groupBy("doc_id", "n").agg(F.collect_list("tok").alias("toks"))
    left = met.join(own.toDF("a", "na", "ta"), "a").join(own.toDF("b", "nb", "tb"), "b")
    rest = F.ceil(percent * F.greatest("na", "nb") / 100) - 1
    enough = F.size(F.array_intersect("ta", "tb")) + rest >= _needed(F.col("na"), F.col("nb"), percent)
    return left.where(enough).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """`doc_id`, `n_shingles` and `component_id` of each document, one row per input row.

    A document's set holds its distinct shingles of `words` words (A-Z lower-cased, cut
    at ASCII blanks); with fewer words the whole sequence, without words (or with null
    text) nothing, and such a document links with nothing. Two documents link when their
    intersection is at least `percent` per cent of their union; the component is the
    smallest `doc_id` reachable by links.

    Rows that share a `doc_id` are one document with several texts: linked if any of
    them is. Rows without `doc_id` take no part and get a null component. An empty table
    gives no rows. Other columns are ignored.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))
    measured = stored(rows.mapInArrow(_measure(words), SETS), "sets")
    sets = measured.where("loads is null").drop("loads")
    table = measured.where("loads is not null").select(F.posexplode("loads").alias("bucket", "n"))
    loads = np.zeros(BUCKETS, np.int64)
    for r in table.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        loads[r["bucket"]] = r["n"]

    same = ["n", "h1", "h2"]
    classes = stored(
        sets.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")), "classes"
    )
    more = classes.where("k > 1")
    copies = stored(sets.join(more, same).where("doc_id != rep").select("doc_id", "t").distinct(), "copies")
    texts = rows.where("doc_id is not null").join(key_side(copies), ["doc_id", "t"], "left_anti").select("doc_id", "text")

    found = texts.mapInArrow(_prefixes(loads, words, percent), ENTRIES)
    own = Window.partitionBy("tok", "slot")
    found = found.withColumn("k", F.count("*").over(own)).where("k > 1 or slots > 1")
    entries = stored(found.select("tok", "doc_id", "n", "pos"), "entries")

    comps, links, stars = None, [], []
    for seed in range(STAR_ROUNDS):
        pairs = stored(_star_pairs(_with_components(entries, comps), seed, percent), "pairs")
        stars.append(stored(overlaps(pairs, texts, words), "overlaps"))
        links.append(_linked(stars[-1], percent))
        comps = stored(components(reduce(DataFrame.unionByName, links)), "components")
    nonempty = sets.where("n > 0 and doc_id is not null")
    several = nonempty.groupBy("doc_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo != hi")
    several = key_side(stored(several.select("doc_id"), "several_texts"))
    for side in ("a", "b"):
        stars = [x.join(several.withColumnRenamed("doc_id", side), side, "left_anti") for x in stars]
    pairs = stored(
        _last_pairs(_with_components(entries, comps), stars, percent), "pairs"
    )
    links.append(_linked(stored(overlaps(pairs, texts, words), "overlaps"), percent))
    # Rows of one id in several classes connect those.
    ids = sets.where("n > 0 and doc_id is not null").join(more, same).where("doc_id != rep")
    links.append(ids.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(0).alias("na"), F.lit(0).alias("nb"), F.lit(0).alias("same")))
    comps = components(reduce(DataFrame.unionByName, links))
    return sets.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents of `near_duplicates` that have the smallest id of their component.

    Documents that link with nothing, and rows without `doc_id`, stay; rows that share a
    `doc_id` stay or go together. Columns are kept as they are.
    """
    found, name = near_duplicates(docs, words, percent), unused(docs, "_gone")
    gone = stored(found.where("component_id != doc_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(key_side(gone), docs["doc_id"].cast("long") == F.col(name), "left_anti")


def keep_one_row(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component of rows: `keep_one` where ids are missing or repeated.

    Every row takes part by its own text, also without `doc_id` and under an id that
    other rows have. The row with the smallest `doc_id` stays (one without id only where
    no row has any); of rows equal in `doc_id` and text any one. Rows without words link
    with nothing and stay. Columns are kept as they are.
    """
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    key = unused(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64(doc_id, text))
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), words, percent).where("n_shingles > 0")
    found = stored(found.groupBy(F.col("doc_id").alias("_key"), "component_id").agg(F.count("*").alias("_n")), "row_components")
    many = stored(found.groupBy("component_id").agg(F.sum("_n").alias("_rows")).where("_rows > 1").drop("_rows"), "many")
    members = stored(found.join(key_side(many), "component_id"), "members")
    ids = keyed.select(F.col(key).alias("_key"), doc_id.alias("_id")).join(key_side(members.select("_key", "component_id")), "_key")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_key")).alias("m"))
    stay = stored(first.select("component_id", F.col("m._key").alias("_stay")), "stay")
    marked = members.join(key_side(stay), "component_id")
    gone = stored(marked.where("_key != _stay").select(F.col("_key").alias(key)), "gone")
    twice = stored(marked.where("_key = _stay and _n > 1").select(F.col("_key").alias(key)), "twice")
    left = keyed.join(key_side(gone), key, "left_anti")
    once = left.join(key_side(twice), key, "left_semi").dropDuplicates([key])
    return left.join(key_side(twice), key, "left_anti").unionByName(once).select(*docs.columns)
