"""Plain statements of the rules, for small inputs."""

from __future__ import annotations

import re


def deleted_lines(docs: list[tuple[int, str]], min_words: int) -> dict[int, set[int]]:
    """Lines with words that an earlier run of `min_words` words covers, by trying all pairs."""
    rows = []
    for doc, text in sorted(docs):
        lines = [x.strip(" \t\n\x0b\f\r") for x in (text or "").split("\n")]
        rows += [(doc, m, x) for m, x in enumerate(x for x in lines if x)]
    gone: dict[int, set[int]] = {doc: set() for doc, _ in docs}
    for b in range(len(rows)):
        for a in range(b):
            n = 0
            while (
                b + n < len(rows)
                and rows[b + n][0] == rows[b][0]
                and rows[a + n][0] == rows[a][0]
                and rows[a + n][2] == rows[b + n][2]
            ):
                n += 1
            if n and sum(len(re.findall(r"[^\x20\x09-\x0D]+", rows[b + i][2])) for i in range(n)) >= min_words:
                gone[rows[b][0]] |= {rows[b + i][1] for i in range(n)}
    return gone


def cleaned(text: str | None, gone: set[int]) -> str | None:
    """The text without those lines; empty where no words are left."""
    if text is None or not gone:
        return text
    out, m = [], 0
    for line in text.split("\n"):
        if not line.strip(" \t\n\x0b\f\r"):
            out.append(line)
            continue
        if m not in gone:
            out.append(line)
        m += 1
    return "" if len(gone) == m else "\n".join(out)


def near_components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """Set sizes and components of all pairs with 80 per cent of five-word shingles in common."""
    sets = {}
    for doc, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    label = {doc: doc for doc in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if label[b] < label[a] and x and y and 100 * len(x & y) >= 80 * len(x | y):
                    label[a], changed = label[b], True
    return {doc: (len(x), label[doc]) for doc, x in sets.items()}
