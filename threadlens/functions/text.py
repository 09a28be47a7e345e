"""Text rules of both stages.

Every rule is one native expression, so it stays inside code generation and can
be used in filters, projections and streams alike. Nothing here looks at less
than the whole text.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NO_LINKS = "No links or images found."
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "gif")
FULLWIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
HALFWIDTH = "".join(map(chr, range(0x21, 0x7F)))
IDEOGRAPHIC_SPACE = "\u3000"
DROPPED = "".join(map(chr, range(0x2E80, 0x3000)))
# What Python calls white space; Java's own classes hold fewer characters.
WHITESPACE = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)

_URL = f"https?://[^{WHITESPACE}]+"
_IMAGE_URL = rf"{_URL}\.(?:{'|'.join(IMAGE_SUFFIXES)})"


def _mapped(text: Column, chars: str, partners: str) -> Column:
    """`translate`, applied only to text that may hold one of the characters.

    Translating looks up every character, which costs several times the byte
    searches below; most text is plain ASCII and needs neither.
    """
    leads = sorted({char.encode()[:2] for char in chars})
    held = reduce(
        or_, (F.contains(text.cast("binary"), F.lit(lead)) for lead in leads)
    )
    beyond_ascii = F.octet_length(text) > F.char_length(text)
    return F.when(beyond_ascii & held, F.translate(text, chars, partners)).otherwise(
        text
    )


def normalize_ascii(text: Column) -> Column:
    """Full-width ASCII to plain ASCII; empty text to null."""
    return F.when(text != "", _mapped(text, FULLWIDTH, HALFWIDTH))


def normalize_text(text: Column) -> Column:
    """`normalize_ascii`, wide space to space, radicals dropped, ends stripped.

    Only an empty input becomes null: text of white space alone becomes "".
    """
    # Characters without a partner in the second list are dropped by translate.
    plain = _mapped(text, FULLWIDTH + IDEOGRAPHIC_SPACE + DROPPED, HALFWIDTH + " ")
    return F.when(text != "", F.btrim(plain, F.lit(WHITESPACE)))


def extract_links(text: Column) -> Column:
    """All image URLs, else all URLs, else a fixed phrase."""

    def listed(urls: Column) -> Column:
        # An image URL lies within a run of non-space characters, as a URL does,
        # and reaches to the last image suffix in it: at most one in each URL.
        images = F.array_remove(
            F.transform(urls, lambda url: F.regexp_extract(url, _IMAGE_URL, 0)), ""
        )
        chosen = F.array(F.array_join(images, ", "), F.array_join(urls, ", "))
        return F.get(F.array_remove(chosen, ""), F.lit(0))

    # The lambda names the URLs, so that the text is searched once.
    found = F.array(F.regexp_extract_all(text, F.lit(_URL), F.lit(0)))
    # Most text holds no URL, which one substring search finds out.
    links = F.when(
        F.contains(text, F.lit("://")), F.transform(found, listed)[0]
    )
    return F.coalesce(links, F.lit(NO_LINKS))


def post_type(url: Column) -> Column:
    """What follows the last dot of a URL; the whole of it without a dot."""
    return F.when(url != "", F.substring_index(url, ".", -1))
