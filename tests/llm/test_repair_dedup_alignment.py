"""Operators 11, 12 and 13 against plain statements of their rules."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from threadlens.llm import exact_dedup as X
from threadlens.llm.alignment import align_tokenizers, compose, pair_counts
from threadlens.llm.conversations import Conversation, damaged, repair_conversations

FILE_A, FILE_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ORDER = re.compile("(s?(ua)+)?")
ROLES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """All edits tried: (cost, edits, lines) of the cheapest, then least."""
    best = None
    gaps = [""] + ["".join(x) for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    options = [["D"] + ([] if fault in (1, 2) else ["K", "Ru", "Ra"]) for _, _, fault in rows]
    for edits in itertools.product(*options):
        for put_in in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, initials, lines = 0, "", "", []
            for at in range(len(rows) + 1):
                for r in put_in[at]:
                    cost, audit, initials = cost + 5, audit + "I", initials + r
                    lines.append(f"{ROLES[r]}:")
                if at == len(rows):
                    break
                role, text, fault = rows[at]
                audit += edits[at][0]
                if edits[at] == "D":
                    cost += 2
                    continue
                named = role if edits[at] == "K" else ROLES[edits[at][1]]
                cost += (edits[at] != "K") + 5 * (fault == 3)
                initials += named[:1] or "?"
                lines.append(f"{named}:{text}")
            if ORDER.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best


def test_edits_are_the_cheapest():
    random.seed(5)
    for _ in range(120):
        roles = random.choices(["user", "assistant", "system", "x", ""], [4, 4, 2, 1, 1], k=random.randint(0, 3))
        rows = [(r, str(i), random.choice([0, 0, 0, 1, 2, 3])) for i, r in enumerate(roles)]
        state = Conversation(1)
        for i, row in enumerate(rows):
            state.add(i, *row)
        cost, audit, lines = cheapest(rows)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert state.finish()[6:] == (cost, audit, sha), rows


def plain_repair(rows):
    """Counts of one conversation's rows, sorted."""
    seen, found, faults = set(), Counter(), []
    for turn, role, text in rows:
        last = text.rstrip(" \t\n\v\f\r")[-1:]
        fault = 1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0
        if last:
            seen.add((role, text))
        found[fault] += 1
        faults.append((role, text, fault))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    state = Conversation(0)
    for i, (role, text, fault) in enumerate(faults):
        state.add(i, role, text, fault)
    return (gaps, found[1], found[2], found[3], sum(p not in ("su", "ua", "au") for p in pairs), *state.finish()[6:])


def plain_damage(conv, turn, role, text):
    name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
    which = zlib.crc32(name.encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    text = "" if which == 1 else re.sub("[.!?]", "", text) if which == 2 else text
    row = (turn, "user" if which == 4 else role, text)
    return [] if which == 0 else [row] * (2 if which == 3 else 1)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_conversations_equal_a_plain_repair(spark, batch):
    random.seed(6)
    texts = ["yes.", "no", "", " ", None, "what?\n", "é!", "yes.", "long " * 50_000 + "."]
    given = []
    for conv in [None, *range(60), 2**60 + 1]:
        for _ in range(random.randint(1, 40) if conv != 7 else 900):
            turn = random.choice([None, *range(-2, 9), 2**60 + 1]) if conv == 3 else random.choice([None, *range(12)])
            given.append((conv, turn, random.choice(["user", "assistant", "system", None, ""]), random.choice(texts)))
    frame = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    frame = frame.withColumns({"dropped_": F.lit(1), "_key": F.lit("x"), "fault": F.lit(9)})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = repair_conversations(damaged(frame)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    groups = defaultdict(list)
    for conv, *row in given:
        groups[conv] += plain_damage(conv, *row)
    expected = {c: plain_repair(sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))) for c, g in groups.items()}
    assert {r[0]: tuple(r)[1:] for r in rows} == expected
    assert len(rows) == len(groups)


def test_a_giant_conversation_spills_its_back_pointers(monkeypatch):
    monkeypatch.setattr("threadlens.llm.conversations.SPILL_BYTES", 1000)
    state = Conversation("c")
    for i in range(200_000):
        state.add(i, ("user", "assistant")[i % 2], str(i), 2 if i % 1000 == 999 else 0)
    assert state.pointers._rolled
    _, gaps, _, duplicate, _, _, cost, audit, _ = state.finish()
    # Each repeated answer goes, and one of the questions around it.
    assert (gaps, duplicate, cost, len(audit)) == (0, 200, 2 * 400, 200_000)
    assert Counter(audit) == {"K": 199_600, "D": 400}


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair_conversations(damaged(none)).collect() == []


# --- exact copies --------------------------------------------------------------------------

TEXTS = ["Same", "same", "SAME", "É", "é", "", None, " ", "İ", "i̇", "x" * 400_000, "X" * 400_000, "a\x00b"]


def plain_groups(rows):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(upper)].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, sha = max(known, default=None), hashlib.sha256(text.encode()).hexdigest()
        stays = False
        for i in ids:
            now = i == keep and not stays
            stays |= now
            out.append((i, keep, len(ids), now, sha))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [256, 8, 4])
def test_copies_equal_a_plain_grouping(spark, bits):
    random.seed(8)
    rows = [(i, random.choice(TEXTS)) for i in range(80)] + [(3, "Same"), (3, "Same"), (None, "q"), (None, "Q"), (None, "same")]
    rows += [(100 + i, f"only {i}") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    frame = frame.withColumns({"_metadata": F.lit(1), "_key": F.lit("k"), "kept": F.lit(False)})
    found = X.dedup_exact(frame, key_bits=bits)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_groups(rows)


def test_state_goes_on_with_files_that_arrive(spark, tmp_path):
    path, folder = f"{tmp_path}/docs", f"{tmp_path}/state"
    rows = []
    for part in ([(1, "a"), (2, "A"), (3, "b")], [(9, "a"), (4, "c")], [(5, "B"), (0, "a")]):
        rows += part
        frame = spark.createDataFrame(part, "doc_id long, text string").withColumn("_metadata", F.lit("own"))
        frame.coalesce(1).write.mode("append").parquet(path)
        found = X.dedup_exact_files(spark, path, folder)
        assert sorted(map(tuple, found.collect()), key=str) == plain_groups(rows)
    files = list((tmp_path / "state" / "groups").glob("batch=*"))
    assert len(files) == 3
    again = X.dedup_exact_files(spark, path, folder)
    assert sorted(map(tuple, again.collect()), key=str) == plain_groups(rows)
    assert list((tmp_path / "state" / "groups").glob("batch=*")) == files
    kept = X.kept_documents(spark, path, folder)
    assert sorted(map(tuple, kept.select("doc_id", "text", "_metadata").collect())) == [
        (4, "c", "own"), (5, "B", "own"), (9, "a", "own"),
    ]


def test_exact_dedup_of_nothing_and_its_plan(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert X.dedup_exact(none).collect() == []
    plan = X.dedup_exact(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string"))
    text = plan._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", text)


# --- alignment -----------------------------------------------------------------------------

PARTS = [
    " ", "\n", "  ", "\n\n", "\t", "a", "the", "ing", "Éç", "ü", "word.", "don't", "123", "💡", "漢字", "<|endoftext|>",
    "<0x41>", "<s>", "\xa0", "　", ",", "!!", "\x1c", "\x00", "▁", "hello", "ﬁ",
]


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_file = Tokenizer.from_file(FILE_A)
    a_file.encode_special_tokens = True
    b_file = sentencepiece.SentencePieceProcessor(model_file=FILE_B)
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    names = {i: x for x, i in a_file.get_vocab().items()}
    found, df = [], Counter()
    for text in texts:
        found.append(None)
        if not text:
            continue
        data = f" {text}".encode()
        a, b = a_file.encode(f" {text}", add_special_tokens=False).ids, b_file.encode(text)
        parts = [
            [bytes(byte[c] for c in names[i]) for i in a],
            [bytes([int(b_file.id_to_piece(i)[3:5], 16)]) if b_file.is_byte(i) else b_file.id_to_piece(i).replace("▁", " ").encode() for i in b],
        ]
        if any(b"".join(x) != data for x in parts):
            continue
        ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in parts)
        groups, lo = [], 0
        for hi in sorted(set(ends_a) & set(ends_b)):
            groups.append(([i for i, e in zip(a, ends_a) if lo < e <= hi], [i for i, e in zip(b, ends_b) if lo < e <= hi]))
            lo = hi
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        df.update(links.keys())
        found[-1] = a, b, groups, links
    most = defaultdict(int)
    for (x, _), n in df.items():
        most[x] = max(most[x], n)
    rows = []
    for i, one in enumerate(found):
        if one is None:
            rows.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = one
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        best = sum(n for k, n in links.items() if df[k] == most[k[0]])
        total = sum(n * df[k] for k, n in links.items())
        sha = hashlib.sha256(text.encode()).hexdigest()
        rows.append((i, len(a), len(b), len(groups), sum(links.values()), best, total, sha))
    return rows, {(x, y, n, n == most[x]) for (x, y), n in df.items()}


@pytest.mark.parametrize("size", [1 << 16, 24, 90])
def test_alignment_equals_a_plain_one(spark, size):
    random.seed(11)
    texts = ["".join(random.choices(PARTS, k=random.randint(0, 60))) for _ in range(150)]
    texts += [None, "", " ", "\n", "a ", " ▁", "a" * 500, "漢" * 300, "ab " * 3000, texts[0], texts[1]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    frame = frame.withColumns({"key": F.lit(1), "block": F.lit(""), "k": F.lit(0), "n_a": F.lit(None)})
    rows, counts = plain_alignment(texts)
    found = align_tokenizers(frame, FILE_A, FILE_B, range_bytes=size)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect())) == rows
    if size == 24:
        assert set(map(tuple, pair_counts(frame, FILE_A, FILE_B, range_bytes=size).collect())) == counts


def test_alignment_of_repeated_rows_null_ids_and_nothing(spark):
    rows = [(1, "the word " * 40), (1, "the word " * 40), (None, "a b"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    plain, _ = plain_alignment([t for _, t in rows])
    found = align_tokenizers(frame, FILE_A, FILE_B, range_bytes=64).collect()
    assert sorted((tuple(r)[1:] for r in found)) == sorted(r[1:] for r in plain)
    assert sorted(str(r["doc_id"]) for r in found) == ["1", "1", "None", "None"]
    assert align_tokenizers(frame.where("false"), FILE_A, FILE_B).collect() == []


def test_fragments_compose_in_any_order():
    random.seed(12)

    def fragment(k):
        has_end = random.random() < 0.6
        pick = lambda: [random.randint(0, 99) for _ in range(random.randint(0, 2))]
        return {
            "key": "d", "k": k, "last_k": k if has_end else -1, "n_a": 1, "n_b": 2, "n_groups": k if has_end else 0,
            "n_links": k, "bad": False, "has_end": has_end, "pre_a": pick(), "pre_b": pick(),
            "suf_a": pick() if has_end else [], "suf_b": pick() if has_end else [], "seams": [],
        }

    for _ in range(500):
        a, b, c = (fragment(k) for k in range(3))
        assert compose(compose(a, b), c) == compose(a, compose(b, c))
