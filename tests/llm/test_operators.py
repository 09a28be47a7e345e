"""The ten operators on small tables: plain cases against brute force, and odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import cleaned, deleted_lines, near_components
from pyarrow import fs
from tokenizers import Tokenizer, models, pre_tokenizers

from threadlens.llm.decontamination import contamination, decontaminate, find_windows
from threadlens.llm.encoding import encoder
from threadlens.llm.jaccard import keep_one, keep_one_row, near_duplicates, shingle_sets
from threadlens.llm.language import identify_languages
from threadlens.llm.line_dedup import dedup_lines
from threadlens.llm.packing import cutting_plan, pack_documents
from threadlens.llm.quality_classifier import keep_quality, score_quality
from threadlens.llm.quality_rules import judge_rules
from threadlens.llm.token_counts import CountingViterbi, count_run, count_tokens, vocabulary
from threadlens.llm.token_files import PerfectHash, lookup, read_token_shards, write_token_shards
from threadlens.llm.url_filter import SEEDS, Segmenter, judge_urls
from threadlens.storage import new_folder

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _c0 int, _t string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [
    (1, "The cat sat on the mat.\nThe dog of the house is in the garden.", "en", "a", 1, 1, "x"),
    (2, None, "en", None, None, None, None),
    (3, "", None, "a", 0, 1, "x"),
    (4, " \n\t \n ", "en", "a", 5, 1, "x"),
    (None, "no id here, but some words to read and to keep", "en", "a", 1, 1, "x"),
    (5, LONG, "en", "a", 1, 1, "x"),
    (6, "twice", "en", "a", 1, 1, "x"),
    (6, "twice", "en", "a", 1, 1, "x"),
    (7, "  doppelt  gemoppelt \x00 <|endoftext|> don't 'S Ünï ½ 中文 \u0301\n\n", "de", "a", 1, 1, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(file, text):
    return [*Tokenizer.from_file(file).encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("file", [WORD, BYTE])
def test_chunks_give_the_ids_of_the_tokenizer(file):
    pieces = ["a", "The", "é", "e\u0301", "Σ", "İ", " ", "  ", "\n", " \n", "\t", "1", "23", "'s", "don't", "_a", "%%",
              "<|endoftext|>", "\x00", "中文", "🙂", "\x85", "word,", "x%%%"]
    rnd = np.random.default_rng(3)
    texts = ["".join(rnd.choice(pieces, rnd.integers(0, 12))) for _ in range(2_000)]
    ids, ends = encoder(file).encode(pa.array(texts))
    own = Tokenizer.from_file(file)
    for text, a, b in zip(texts, [0, *ends], ends):
        assert ids[a:b].tolist() == own.encode(text, add_special_tokens=False).ids, text


def test_packing(spark, odd, empty):
    rows = pack_documents(odd, WORD, length=256).collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(WORD, x[1])) for x in ODD)
    texts = {x[0]: x[1] for x in ODD}
    for r in rows:
        own = np.array(ids_of(WORD, texts[r.doc_id]), "<u4")
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 256
    assert pack_documents(empty, WORD).count() == 0


def test_cutting_plan_covers_the_demand():
    rnd = np.random.default_rng(1)
    demand = {int(c): int(n) for c, n in zip(rnd.choice(np.arange(1, 257), 60, False), rnd.integers(1, 500, 60))}
    plan = cutting_plan(demand, 256)
    made = {}
    for pattern, times in plan:
        assert sum(c * n for c, n in pattern.items()) <= 256 and times > 0
        for c, n in pattern.items():
            made[c] = made.get(c, 0) + n * times
    assert made == demand
    used = sum(t for _, t in plan)
    assert used <= 1.03 * sum(c * n for c, n in demand.items()) / 256 + 2
    assert cutting_plan({}, 256) == []


def test_token_files(spark, odd, empty):
    folder = new_folder(spark, "tokens")
    manifest = write_token_shards(odd, BYTE, folder)
    rows = sorted(read_token_shards(manifest, folder).collect(), key=lambda r: r.start)
    start = 0
    for r, x in zip(rows, sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        own = np.array(ids_of(BYTE, x[1]), "<u4")
        assert (r.doc_id, r.start, r.n_tokens) == (x[0], start, len(own))
        assert r.ids_crc32 == zlib.crc32(own.tobytes())
        start += len(own)
    store, _ = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    hits = {6: 0, 99: 0}
    for shard in manifest.collect():
        for key, found in zip(hits, lookup(store, shard["path"], np.array([*hits]))):
            hits[key] += len(found)
            assert all(x.tolist() == ids_of(BYTE, "twice") for x in found)
    assert hits == {6: 2, 99: 0}
    folder = new_folder(spark, "tokens")
    assert read_token_shards(write_token_shards(empty, BYTE, folder), folder).count() == 0


def test_perfect_hash_numbers_keys_once():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 62, 20_000).astype(np.uint64))
    assert sorted(PerfectHash.build(keys).slots(keys)) == list(range(len(keys)))
    assert len(PerfectHash.build(keys[:0]).slots(keys)) == len(keys)


def test_token_counts(spark, odd, empty):
    pieces = vocabulary(PIECE)
    texts = [x[1] or "" for x in ODD] + ["▁▁a  b", "<s>x", "𝄞𝄞 ok", " lead", "trail "]
    for own in (pieces, [(p, s) for p, s in pieces if not p.startswith("<0x")]):
        plain = Tokenizer(models.Unigram(own, unk_id=0, byte_fallback=own is pieces))
        plain.pre_tokenizer = pre_tokenizers.Metaspace()
        counted, _, _ = count_run(CountingViterbi(own), pa.array(texts))
        assert counted.tolist() == [len(plain.encode(x).ids) for x in texts]
    got = sorted(r.n_tokens for r in count_tokens(odd, PIECE).collect())
    assert got == sorted(count_run(CountingViterbi(pieces), pa.array([x[1] for x in ODD]))[0].tolist())
    assert count_tokens(empty, PIECE).count() == 0


def test_token_count_ties_keep_the_earliest_start():
    own = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("▁ab", -3.0), ("c", -9.0)]
    plain = Tokenizer(models.Unigram(own, unk_id=0, byte_fallback=False))
    plain.pre_tokenizer = pre_tokenizers.Metaspace()
    texts = ["ab", "abab", "zz a", "abczzab", "cc"]
    counted, _, _ = count_run(CountingViterbi(own), pa.array(texts))
    assert counted.tolist() == [len(plain.encode(x).ids) for x in texts]


def test_line_dedup(spark, odd, empty):
    rnd = np.random.default_rng(5)
    pool = [" ".join(rnd.choice([*"abcdefg"], n)) for n in (1, 2, 3, 5, 8, 12)] + ["", "  "]
    docs = [(i, "\n".join(rnd.choice(pool, rnd.integers(0, 10)))) for i in range(40)]
    docs += [(40, None), (41, docs[3][1])]
    got = {
        r.doc_id: (r.text, r.n_removed)
        for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 10, report=True).collect()
    }
    for doc, gone in deleted_lines(docs, 10).items():
        assert got[doc] == (cleaned(dict(docs)[doc], gone), len(gone))
    out = dedup_lines(odd)
    assert out.columns == odd.columns
    # Rows of one id with one text are one document; nothing else is repeated here.
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(ODD, key=key)
    assert dedup_lines(empty).count() == 0


def test_line_dedup_is_native(spark, odd):
    plan = dedup_lines(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_classifier(spark, odd, empty):
    rnd = np.random.default_rng(4)
    good = [" ".join(rnd.choice(["the", "house", "of", "green", "walls.", "is", "near"], 60)) for _ in range(150)]
    bad = [" ".join(rnd.choice(["BUY", "$$$", "###", "NOW!!", "the"], 60)) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = score_quality(docs, labels).collect()
    assert all(r.predicted == (r.doc_id < 150) and 0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert score_quality(odd, labels).count() == len(ODD)
    assert [r.score for r in score_quality(odd, labels.limit(0)).collect()] == [0.5] * len(ODD)
    kept = keep_quality(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(150))
    assert keep_quality(odd, labels).columns == odd.columns
    assert score_quality(empty, labels).count() == 0


def test_quality_rules(odd, empty):
    rows = judge_rules(odd).collect()
    for r, text in zip(sorted(rows, key=lambda r: (r.doc_id or 0, r.n_words)), [x[1] for x in sorted(ODD, key=lambda x: (x[0] or 0, len((x[1] or '').split())))]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)} if len(words) < 500 else None
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert repeated is None or r.n_repeat_words == len(repeated)
        assert r.base_failed or r.n_words >= 20
    assert judge_rules(empty).count() == 0


def test_repeated_windows(spark):
    texts = ["a b c d e f g h i " * 3, "x " * 9, "x " * 8, "a b c d e f g h", "1 2 3 4 5 6 7 8 0 1 2 3 4 5 6 7 8"]
    rows = judge_rules(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_repeat_words for r in rows] == [27, 9, 0, 0, 16]


def test_urls(spark):
    urls = [
        "http://Shop.Example.ORG/es/1", "https://example.org/en/17?x", "http://a.org/x", "http://x.com/fr/1#t", "http://x.com/de/1",
        "http://com/fr/", "http://xcom/fr/", "http://casino-win.example.net/en/3", "http://pokercasino.example.net/en/3",
        "http://garden.example.net/en/3", None, "no scheme", "x://", "http://org", "ftp://h?q", "http://x.com/FR/1",
    ]
    urls += [f"http://{x}.example.net/en/{i}" for i in range(20) for x in ("garden", "house", "casino-win")]
    pages = spark.createDataFrame([(i, u, "<p>garden and house words of the example net</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in judge_urls(pages).collect()}
    assert [got[i].rule for i in range(7)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", "com/fr/", None]
    assert [got[i].verdict for i in (0, 1, 2, 3, 4, 7, 8, 9)] == ["block", "block", "allow", "allow", "block", "block", "block", "allow"]
    assert (got[0].host, got[0].path) == ("shop.example.org", "/es/1")
    assert all((got[i].host, got[i].path, got[i].rule) == ("", "", None) for i in (10, 11, 12))
    assert (got[13].host, got[13].path, got[13].rule) == ("org", "", None) and got[14].host == "h" and got[15].rule is None
    assert judge_urls(pages.limit(0)).count() == 0


def test_url_words_are_known_however_rare(spark):
    """More distinct words than a table of 50,000 held: a name of a rare one is cut by it, if another page says it."""
    letters = "abcdefghij"
    many = ["q" + "".join(letters[int(d)] for d in f"{i:05d}") for i in range(60_000)]
    pages = [(0, "http://zebrafish.example/garden/zebrafishgarden/9", "<p>example</p>"), (1, None, "zebrafish " + " ".join(["garden"] * 9))]
    pages += [(2 + k, "http://x", " ".join(many[k::6] * 2)) for k in range(6)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.tokens for r in judge_urls(frame).collect()}
    assert got[0] == ["h:zebrafish", "h:example", "p:garden", "p:zebrafish", "p:garden", "p:#"]
    assert got[1] == [] and got[2] == ["h:x"]


def test_segmenter_finds_the_likeliest_words():
    cut = Segmenter({"cheap": 10, "pills": 10, "che": 1, "ap": 1, "a": 50}).cut
    assert cut("cheappills") == ["cheap", "pills"] and cut("") == [] and "".join(cut("zzcheapq")) == "zzcheapq"


def test_segmenter_equals_all_cuts():
    """The cheapest of all cuts; of equal ones that with the longest last word, and so on backwards."""
    rnd = np.random.default_rng(4)
    for _ in range(150):
        words = {"".join(rnd.choice(list("abc"), rnd.integers(1, 5))): int(rnd.integers(1, 40)) for _ in range(6)}
        name = "".join(rnd.choice(list("abcd"), rnd.integers(1, 10)))
        own = Segmenter(words)

        def price(piece):
            return own.cost.get(piece, own.unknown + Segmenter.LETTER * len(piece))

        cuts = []
        for bits in range(1 << (len(name) - 1)):
            at = [0, *(i + 1 for i in range(len(name) - 1) if bits >> i & 1), len(name)]
            cuts.append([name[a:b] for a, b in zip(at, at[1:])])
        best = min(cuts, key=lambda c: (sum(map(price, c)), [-len(w) for w in c[::-1]]))
        assert own.cut(name) == best


def test_url_scores_equal_plain_naive_bayes(spark):
    """Names are cut; no seed counts for itself; a URL without seeds goes by its other words."""
    said = "<p>garden house river casino winners cheap trick</p>"
    urls = [f"http://casinowinners.net/house/{i}" for i in range(6)] + [f"http://riverhouse.net/garden/{i}" for i in range(9)]
    urls += ["http://winners.net/x", "http://casino.net/garden", "http://pokerpills.net/trick", "http://cheaptrick.net", None, "x"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(99, None, said)] * 3, "page_id long, url string, html string")
    rows = [r for r in judge_urls(pages, rules=[]).collect()]
    by_id = {r.page_id: r for r in rows}
    assert len(rows) == len(urls) + 3
    assert by_id[0].tokens == ["h:casino", "h:winners", "h:net", "p:house", "p:#"]
    assert by_id[17].tokens == ["h:poker", "h:pills", "h:net", "p:trick"]
    seeds = set(SEEDS)
    named = [(r.tokens, {t[2:] for t in r.tokens} & seeds) for r in rows]
    bad, good = Counter(), Counter()
    for tokens, own in named:
        for t in tokens:
            bad[t] += bool(own - {t[2:]})
            good[t] += not own
    known = {t for t in bad if bad[t] + good[t]}
    n_bad = sum(bool(own) for _, own in named)
    all_bad, all_good = (sum(x[t] for t in known) + len(known) + 1 for x in (bad, good))
    weight = {t: math.log((bad[t] + 1) / all_bad) - math.log((good[t] + 1) / all_good) for t in known}
    for r in rows:
        score = math.log((n_bad + 1) / (len(rows) - n_bad + 1)) + sum(weight.get(t, 0) for t in r.tokens)
        assert abs(r.score - score) < 1e-9 and r.verdict == ("block" if r.score > 0 else "allow")
    # A word that stands with seeds blocks without one, and a seed alone does not.
    assert by_id[15].verdict == "block" and not {t[2:] for t in by_id[15].tokens} & seeds
    assert by_id[16].verdict == "allow" and "h:casino" in by_id[16].tokens and "h:casino" not in weight


def test_very_long_names(spark):
    """A name of a million letters, and words of any length, in bounded memory."""
    long = "q" * 3_000
    pages = [(0, f"data://x/{'garden' * 170_000}", "<p>x</p>"), (1, "http://y", f"garden {long}"), (2, f"http://garden{long}/a", "a b")]
    rows = judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    got = {r.page_id: r.tokens for r in rows}
    assert got[0] == ["h:x"] + ["p:garden"] * 170_000
    assert got[2] == ["h:garden", f"h:{long}", "p:a"]


def test_languages(spark, odd, empty):
    words = {"en": "the of and house green walks", "de": "der die und haus grün geht", "fr": "le la et maison verte marche"}
    rnd = np.random.default_rng(6)
    docs = [(i, " ".join(rnd.choice(words[x].split(), 12)), x) for i, x in enumerate([*words] * 60)]
    frame = spark.createDataFrame(docs + [(900, None, "en"), (901, "12 ;;", "de"), (902, "", None)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in identify_languages(frame).collect()}
    assert all(rows[i].lang_pred == x and 0 <= rows[i].score <= 1 for i, _, x in docs)
    assert all((rows[i].lang_pred, rows[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert {r.held_out for r in rows.values()} == {True, False}
    assert identify_languages(odd).count() == len(ODD)
    assert identify_languages(empty).count() == 0


def test_near_duplicates(spark, odd, empty):
    rnd = np.random.default_rng(8)
    docs = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in rnd.integers(0, 400, 60)]
        for _ in range(12):
            own = list(base)
            for at in rnd.integers(0, 60, rnd.integers(0, 3)):
                own[at] = f"n{rnd.integers(1 << 30)}"
            docs.append(" ".join(own))
    docs += [docs[0], docs[0].upper(), "a b", "a  b", "a b c", "", None, "x"]
    rows = [*enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame).collect()}
    assert got == near_components(rows)
    kept = {r.doc_id for r in keep_one(frame).collect()}
    assert kept == {c for _, c in got.values()}
    found = [(r.doc_id, r.component_id) for r in near_duplicates(odd).collect()]
    assert len(found) == len(ODD) and all(a == b for a, b in found)
    assert keep_one(odd).count() == len(ODD)
    assert near_duplicates(empty).count() == 0


def test_one_row_of_a_group_stays_whatever_its_id(spark, odd, empty):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(3, a), (3, a), (2, a + " more"), (None, a), (None, a), (None, b), (None, b), (9, b + " x"), (9, "c d"), (None, "e"), (None, "e")]
    rows += [(None, None), (None, None), (4, ""), (4, "")]
    frame = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int").repartition(3)
    kept = keep_one_row(frame)
    assert kept.columns == frame.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(2, a + " more"), (9, b + " x"), (9, "c d"), (None, "e"), (None, None), (None, None), (4, ""), (4, "")], key=str)
    assert keep_one_row(odd).count() == len(ODD) - 1 and keep_one_row(empty).count() == 0


def test_an_id_with_several_texts_bounds_none_of_them(spark):
    """The overlap of one text with a common centre says nothing of the id's other text."""
    rows = spark.range(1, 4_000).selectExpr("id", "xxhash64(id) h", *(f"xxhash64(id, {t}L, 1) h{t}" for t in range(8))).collect()
    # The centre comes first in all lists, also where chance decides.
    rank = sorted(rows, key=lambda r: max(r[1:]))
    centre, two, one = rank[0].id, rank[-1].id, rank[-2].id
    a, b, d = ([f"{x}{i}" for i in range(n)] for x, n in (("a", 60), ("b", 40), ("d", 25)))
    docs = [(centre, a + b), (two, [*a, *b[:39], "z"]), (two, a + d), (one, [*a, *d, "y"])]
    # What is not in the centre is frequent, in sets too large for the others.
    docs += [(5_000 + k, [*b, *d, "y", "z", *(f"f{k}n{i}" for i in range(200))]) for k in range(6)]
    frame = spark.createDataFrame([(i, " ".join(x)) for i, x in docs], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(frame, words=1).collect()}
    assert got[centre] == got[two] == got[one] == min(centre, two, one)


def test_shingles_of_slices():
    texts = [" ".join(f"w{i * j % 97}" for j in range(i % 40)) for i in range(90)]
    whole = shingle_sets(pa.array(texts))
    assert all(np.array_equal(a, b) for a, b in zip(whole[40:], shingle_sets(pa.array(texts[40:]))))


def test_decontamination(spark, odd, empty):
    w = [f"q{i}" for i in range(40)]
    items = [("b2", " ".join(w[:14])), ("b10", "Short, ITEM!"), ("b1", " ".join(w[4:14])), (None, " ".join(w[20:30])), ("e", None), ("f", ".")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    docs = [
        (1, "x " + ", ".join(w[:12]).upper() + " y"), (2, " ".join(w[:9])), (3, "a short-item here"), (4, " ".join(w)), (5, None), (6, ""),
        (None, "short item"),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(frame, benchmark).collect()}
    assert got == {
        1: (14, 12, ["b2"], True), 2: (9, 0, [], False), 3: (4, 2, ["b10"], True), 4: (40, 24, ["b1", "b2"], True), 5: (0, 0, [], False),
        6: (0, 0, [], False), None: (2, 2, ["b10"], True),
    }
    blocks = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(frame, benchmark, block_words=20).collect()}
    assert blocks == got
    assert {r.doc_id for r in decontaminate(frame, benchmark).collect()} == {2, 5, 6}
    cut = decontaminate(frame, benchmark, mode="spans")
    assert {r.doc_id: r.text for r in cut.collect()}[1] == "x\ny"
    assert contamination(cut, benchmark).where("contaminated").count() == 0
    assert decontaminate(odd, benchmark, mode="spans").columns == odd.columns
    assert find_windows(empty, benchmark).count() == 0
    assert contamination(odd, benchmark.limit(0)).where("contaminated").count() == 0


def test_blocks_share_words(spark):
    w = [f"q{i}" for i in range(30)]
    benchmark = spark.createDataFrame([("a", " ".join(w[:12])), ("b", " ".join(w[8:22])), ("c", " ".join(w[21:30]))], "item_id string, text string")
    frame = spark.createDataFrame([(1, " ".join(w)), (1, " ".join(w)), (2, "none")], "doc_id long, text string")
    pick = lambda f: sorted((r.doc_id, r.n_hit, r["items"]) for r in f.collect())
    assert pick(contamination(frame, benchmark, block_words=12)) == pick(contamination(frame, benchmark))


@pytest.mark.parametrize("mode", ["documents", "spans"])
def test_decontamination_in_blocks(spark, odd, mode):
    """A benchmark of any size gives the whole result, as in one pass."""
    rnd = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    items = [(f"i{i}", " ".join(rnd.choice(words, 14))) for i in range(30)] + [("s", "short one"), (None, None)]
    a, b = items[0][1].split(), items[1][1].split()
    texts = [" ".join([*rnd.choice(words, 20), items[i % 30][1], *rnd.choice(words, 20)]) for i in range(60)]
    # The cut of one item's words brings together those of another.
    texts += [" ".join([*b[:7], *a, *b[7:]]), " ".join(rnd.choice(words, 60)), None, "", texts[0], "short one"]
    schema = "doc_id long, text string, n_chars int"
    docs = spark.createDataFrame([(i % 50 or None, t, 0) for i, t in enumerate(texts)], schema)
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    whole = sorted(map(str, decontaminate(docs, benchmark, mode=mode).collect()))
    assert sorted(map(str, decontaminate(docs, benchmark, mode=mode, block_words=300).collect())) == whole
    assert decontaminate(odd, benchmark, mode=mode, block_words=300).columns == odd.columns
    assert decontaminate(odd, benchmark, mode=mode, block_words=300).count() == len(ODD)


def test_pipeline_stage_takes_a_large_benchmark(spark):
    """More than a million words: refused before."""
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "nothing of it")], "doc_id long, text string")
    items = [(f"i{i}", f"x{i} " * 50_000) for i in range(12)] + [("hit", "a b c d e f g h i j")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    assert [r.doc_id for r in decontaminate(docs, benchmark).collect()] == [2]


def test_columns_of_the_user_keep_their_values(spark):
    """Columns named as the helper columns of the filtering operators."""
    passage = " ".join(f"p{i}" for i in range(12))
    same = " ".join(f"w{i}" for i in range(30))
    texts = [same, same, f"{passage} and more", "a clean text", None]
    rows = [(i, t, i + 10, f"g{i}", i + 20, f"t{i}", f"c{i}", i) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, _key long, _gone string, _HIT long, _text string, component_id string, _key_ int"
    docs = spark.createDataFrame(rows, schema)
    benchmark = spark.createDataFrame([("b", passage), ("c", "one two three")], "item_id string, text string")
    for kept in (keep_one(docs), keep_one_row(docs)):
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect())) == [r for r in rows if r[0] != 1]
    left = decontaminate(docs, benchmark, block_words=2)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == [r for r in rows if r[0] != 2]
    cut = sorted(map(tuple, decontaminate(docs, benchmark, mode="spans", block_words=2).collect()))
    assert [r[2:] for r in cut] == [r[2:] for r in rows] and "p0" not in cut[2][1] and cut[0] == rows[0]
