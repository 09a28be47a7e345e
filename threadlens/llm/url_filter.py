"""Allow and block verdicts on URLs (operator 5).

Rules decide where they fit; elsewhere the words of host and path do. Concatenated
names are cut into words by a Viterbi pass over unigram counts of the pages' own
words, and a multinomial naive Bayes model scores the words. It learns from all
pages: those whose URL names a word of the seed list are examples of what to block, the
others of what to allow. No seed is judged by itself, see `judge_urls`.

Word counts, names, cuts and token weights are tables of any size: each distinct name
is cut once, by the counted words that occur in it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.storage import key_side, stored

# Rules: verdict, host, path. A rule fits its host and all subdomains below its path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

# Seed words of unwanted sites, one general list for any corpus.
SEEDS = (
    "ads adserver adult bet bets betting casino cheap cialis clickbait cracked doubleclick escort gambling hentai "
    "jackpot keygen loans lottery malware payday pharmacy phishing pills poker porn replica sex slots spam "
    "tracker viagra warez xxx"
).split()

# Names meet words by so many first letters.
HEAD = 24
# Tables of names and tokens are broadcast up to so many bytes of text.
BROADCAST_BYTES = 1 << 25
_NAME = re.compile(r"[^\W\d_]+|\d+")
_WORD = re.compile(r"[^\W\d_]+")
_MARKUP = re.compile(r"<(script|style)\b.*?</\1>|<[^>]*>", re.IGNORECASE | re.DOTALL)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), upper, upper.lower())
    return host, F.regexp_extract(text, pattern, 2)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (as host and path) and its verdict, null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, own, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        name = F.when(fits, F.lit(own + start)).otherwise(name)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


class Segmenter:
    """Cuts a name into the words that are likeliest by their unigram counts.

    An unknown piece of n letters has the chance of 1 in total * 10^n. Costs are whole
    millionths, so that equally likely cuts are told exactly: of those the one with the
    longest last word is taken. A cut takes a step per letter and length of word, however
    long an unknown piece grows.
    """

    LETTER = 2_310_000

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """`total` is that of a larger table that `counts` is taken from."""
        total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: round(1e6 * math.log(total / n)) for w, n in counts.items()}
        self.unknown = round(1e6 * math.log(total)) + 1_000_000
        self.lengths = sorted({len(w) for w in counts})

    def cut(self, name: str) -> list[str]:
        best, back = [0], [0]
        # The cheapest unknown piece that ends here: its cost with all before it, and its start.
        piece, opened = math.inf, 0
        for end in range(1, len(name) + 1):
            fresh = best[end - 1] + self.unknown
            if fresh < piece:
                piece, opened = fresh, end - 1
            piece += self.LETTER
            chosen = (piece, opened)
            for length in self.lengths:
                if length > end:
                    break
                cost = self.cost.get(name[end - length : end])
                if cost is not None:
                    chosen = min(chosen, (best[end - length] + cost, end - length))
            best.append(chosen[0])
            back.append(chosen[1])
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


def _side(table: DataFrame, text: str) -> DataFrame:
    """A stored table as a join side: broadcast where its rows and the bytes of its texts allow."""
    size = table.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return key_side(table) if size <= BROADCAST_BYTES else table


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[str] = Counter()
        for host, path, html in zip(*(batch[c].to_pylist() for c in ("host", "path", "html"))):
            own = Counter(_WORD.findall(_MARKUP.sub(" ", html).lower()))
            for word in {*_NAME.findall(host), *_NAME.findall(path.lower())}:
                own.pop(word, None)
            counts.update(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "count"]
        )


def word_counts(pages: DataFrame) -> DataFrame:
    """`word`, `count`: all lower-case words, of any length, in the visible text of all pages.

    The text of a page does not count for the names of its own URL, which it often
    repeats: a concatenated name must not become a word by that.
    """
    host, path = url_parts(F.col("url"))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(host.alias("host"), path.alias("path"), html.alias("html"))
    found = rows.mapInArrow(_count_words, "word string, count long")
    return stored(found.groupBy("word").agg(F.sum("count").alias("count")), "words")


def _with_seeds(counts: DataFrame, seeds: list[str]) -> tuple[DataFrame, int]:
    """The word table, where a seed that is not found counts once, and its total."""
    known = {r["word"] for r in counts.where(F.col("word").isin(*seeds)).select("word").collect()}
    new = sorted(set(seeds) - known)
    own = counts.sparkSession.createDataFrame([(x, 1) for x in new], counts.schema)
    return counts.unionByName(own), (counts.agg(F.sum("count")).first()[0] or 0) + len(new)


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names of host and path in order, each behind its sign; a number is `#`."""
    for batch in batches:
        names = []
        for host, path in zip(batch["host"].to_pylist(), batch["path"].to_pylist()):
            parts = [(sign, x) for text, sign in ((host, "h:"), (path.lower(), "p:")) for x in _NAME.findall(text)]
            names.append([sign + ("#" if x.isdigit() else x) for sign, x in parts])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(names, pa.list_(pa.string()))], names=[*batch.schema.names, "names"]
        )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All parts of the names of up to `HEAD` letters, block by block of a long name."""
    for batch in batches:
        for key, name in zip(batch["key"].to_pylist(), batch["name"].to_pylist()):
            for block in range(0, len(name), 4096):
                ends = range(1, HEAD + 1)
                starts = range(block, min(block + 4096, len(name)))
                parts = list({name[i : i + n] for i in starts for n in ends})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(parts), pa.int64()), pa.array(parts, pa.string())], names=["key", "part"]
                )


def _cutter(total: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = []
            for name, words in zip(batch["name"].to_pylist(), batch["words"].to_pylist()):
                cuts.append(Segmenter({w["word"]: w["count"] for w in words}, total).cut(name))
            yield pa.RecordBatch.from_arrays([batch["name"], pa.array(cuts, pa.list_(pa.string()))], names=["name", "cut"])

    return cut


def cut_names(names: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """`name`, `cut`: the likeliest words of each (distinct, stored) name; an unknown piece
    is a word of its own.

    The parts of a name meet the words by the first `HEAD` letters, so a longer word is
    offered to every name that has its head; a cut uses only what stands in the name. For
    that reason a hash may stand for the name here.
    """
    keyed = names.select(F.xxhash64("name").alias("key"), "name")
    parts = keyed.mapInArrow(_pieces, "key long, part string").distinct()
    heads = counts.withColumn("part", F.substring("word", 1, HEAD))
    found = parts.join(heads, "part").groupBy("key").agg(F.collect_list(F.struct("word", "count")).alias("words"))
    none = F.array().cast("array<struct<word:string,count:bigint>>")
    own = keyed.join(found, "key", "left").select("name", F.coalesce("words", none).alias("words"))
    return stored(own.mapInArrow(_cutter(total), "name string, cut array<string>"), "cuts")


def url_tokens(rows: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """`rows` (with `host`, `path`, not null) with `tokens`: signed words of host and path in
    order, where a number counts as such. A column `_row` tells rows apart."""
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", names array<string>"
    rows = stored(rows.mapInArrow(_names, schema), "url_names")
    name = F.expr("substring(signed, 3)").alias("name")
    uses = rows.select(F.explode("names").alias("signed")).distinct().where("signed not in ('h:#', 'p:#')")
    cuts = cut_names(stored(uses.select(name).distinct(), "names"), counts, total)
    # Only the number of a row goes along with its names: a long URL is not repeated for each.
    placed = rows.select("_row", F.posexplode("names").alias("_at", "signed"))
    placed = placed.withColumn("name", name).join(_side(cuts, "name"), "name", "left")
    words = F.coalesce("cut", F.array(F.lit("#")))
    signed = F.transform(words, lambda w: F.concat(F.substring("signed", 1, 2), w))
    parts = F.array_sort(F.collect_list(F.struct("_at", signed.alias("own"))))
    tokens = placed.groupBy("_row").agg(F.flatten(F.transform(parts, lambda x: x["own"])).alias("tokens"))
    none = F.array().cast("array<string>")
    return rows.drop("names").join(tokens, "_row", "left").withColumn("tokens", F.coalesce("tokens", none))


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    seeds: list[str] = SEEDS,
) -> DataFrame:
    """`page_id`, `host`, `path`, `rule`, `verdict`, `tokens` and `score` of each URL.

    `score` is the log odds of block against allow by the words; above 0 the method
    blocks. A URL that names seeds is an example to block, one without an example to
    allow, but no seed is counted on its own strength: where it is the only seed of a
    URL, that URL is no example for it. So a seed weighs by the other seeds it stands
    with, any other word by the seeds around it, and a seed never seen with another
    weighs nothing. A null URL or one without `://` has empty host and path, no tokens, and
    is judged by the prior alone (allow, unless most pages are blocked). One row per
    input row, also for repeated rows; an empty table gives no rows. Other columns
    are ignored.
    """
    counts, total = _with_seeds(word_counts(pages), seeds)
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    words = F.transform("tokens", lambda t: t.substr(F.lit(3), F.length(t)))
    named = F.size(F.array_intersect(words, F.array(*map(F.lit, sorted(seeds))))).cast("long")
    marked = stored(url_tokens(rows, counts, total).withColumn("_named", named), "url_tokens")
    pages_of = marked.agg(F.count("*").alias("n"), F.count_if(F.col("_named") > 0).alias("bad")).first()
    n, n_bad = pages_of["n"], pages_of["bad"]
    placed = marked.select(F.explode("tokens").alias("token"), "_named")
    itself = F.expr("substring(token, 3)").isin(*seeds).cast("long")
    table = placed.groupBy("token").agg(
        F.count_if(F.col("_named") > itself).alias("bad"), F.count_if(F.col("_named") == 0).alias("good")
    ).where("bad + good > 0")
    table = stored(table, "tokens")
    seen = table.agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    all_bad, all_good = ((seen[c] or 0) + seen["n"] + 1 for c in ("bad", "good"))
    weight = F.log((F.col("bad") + 1) / F.lit(all_bad)) - F.log((F.col("good") + 1) / F.lit(all_good))
    weights = stored(table.select("token", weight.alias("_weight")), "weights")
    bias = math.log((n_bad + 1) / (n - n_bad + 1))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    placed = marked.select("_row", F.posexplode("tokens").alias("_at", "token")).join(_side(weights, "token"), "token")
    # Added in order of the tokens: the same sum however rows are dealt out.
    parts = F.array_sort(F.collect_list(F.struct("_at", "_weight")))
    total = F.aggregate(parts, F.lit(0.0), lambda done, x: done + x["_weight"])
    sums = placed.groupBy("_row").agg(total.alias("_sum"))
    scored = marked.join(sums, "_row", "left").withColumn("score", F.coalesce("_sum", F.lit(0.0)) + F.lit(bias))
    decided = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, decided).alias("verdict"), "tokens", "score"
    )
