import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from threadlens.functions import text as X

ALPHABET = (
    "aZ09.,:/?()!~ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0éß漢😀"
    "    　⺀⿿⹿＀！Ａ～｟"
)
PIECES = list(ALPHABET) + ["http://", "https://", ".jpg", ".png", ".gif", ".jpeg", "://", "x"]


# Radicals, radical forms and description signs: three half blocks of 128 code points.
RADICAL_BLOCKS = range(0x5D, 0x60)
SUFFIXES = (".jpg", ".jpeg", ".png", ".gif")


def random_texts(n=4000, seed=7):
    rng = random.Random(seed)
    return [
        "".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 24))) for _ in range(n)
    ] + [None]


def width_variant(c):
    """The ASCII sign a full-width form stands for, by the Unicode data."""
    kind, _, code = unicodedata.decomposition(c).partition(" ")
    return chr(int(code, 16)) if kind == "<wide>" and int(code, 16) in range(0x21, 0x7F) else None


def plain_ascii(t):
    return "".join(width_variant(c) or c for c in t) if t else None


def plain_text(t):
    if not t:
        return None
    out = []
    for c in t:
        if unicodedata.name(c, "") == "IDEOGRAPHIC SPACE":
            out.append(" ")
        elif ord(c) >> 7 not in RADICAL_BLOCKS:
            out.append(width_variant(c) or c)
    return "".join(out).strip()


def plain_links(t):
    """Cut at white space, find the scheme, cut images at the last suffix."""
    urls, images = [], []
    for run in (t or "").split():
        starts = [i for i in range(len(run)) if run.startswith(("http://", "https://"), i)]
        starts = [i for i in starts if not run[i:] in ("http://", "https://")]
        if not starts:
            continue
        url = run[starts[0] :]
        urls.append(url)
        for start in starts:
            tail, first = run[start:], run.index("://", start) - start + 4
            ends = [i + len(x) for x in SUFFIXES for i in range(first, len(tail)) if tail.startswith(x, i)]
            if ends:
                images.append(tail[: max(ends)])
                break
    return ", ".join(images or urls) or "No links or images found."


def plain_type(t):
    return t.rsplit(".", 1)[-1] if t else None


@pytest.mark.parametrize(
    "rule, plain",
    [
        (X.normalize_ascii, plain_ascii),
        (X.normalize_text, plain_text),
        (X.extract_links, plain_links),
        (X.post_type, plain_type),
    ],
)
def test_rules_agree_with_python_on_random_text(spark, rule, plain):
    texts = random_texts()
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in rows.select("t", rule(F.col("t")).alias("out")).collect():
        assert row["out"] == plain(row["t"]), repr(row["t"])


@pytest.mark.parametrize(
    "rule, given, expected",
    [
        (X.normalize_ascii, "Ａ！～", "A!~"),
        (X.normalize_ascii, "　", "　"),
        (X.normalize_ascii, "", None),
        (X.normalize_ascii, None, None),
        (X.normalize_text, "", None),
        (X.normalize_text, None, None),
        (X.normalize_text, "　Ａ⺀\u0085", "A"),
        (X.normalize_text, "   ", ""),
        (X.extract_links, "http://x/a.jpgfoo http://y/b", "http://x/a.jpg"),
        (X.extract_links, "http://x/a http://y/b).", "http://x/a, http://y/b)."),
        (X.extract_links, "http://x/a.JPG", "http://x/a.JPG"),
        (X.extract_links, "http://x/1.png/2.gif?q", "http://x/1.png/2.gif"),
        (X.extract_links, None, X.NO_LINKS),
        (X.extract_links, "", X.NO_LINKS),
        (X.extract_links, "no url", X.NO_LINKS),
        (X.post_type, "https://a.b/c.jpg", "jpg"),
        (X.post_type, "https://www.a.com/r/x/", "com/r/x/"),
        (X.post_type, "nodots", "nodots"),
        (X.post_type, "", None),
        (X.post_type, None, None),
    ],
)
def test_hand_rows(spark, rule, given, expected):
    rows = spark.createDataFrame([(given,)], "t string")
    assert rows.select(rule(F.col("t"))).first()[0] == expected


def test_white_space_is_pythons():
    assert {chr(i) for i in range(0x110000) if chr(i).isspace()} == set(X.WHITESPACE)
