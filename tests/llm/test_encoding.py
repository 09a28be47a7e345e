"""Ids of cut and remembered chunks against those of whole texts."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from threadlens.llm import encoding as E

PARTS = [
    " ", " ", " ", "\n", "  ", "\t", "\x1c", "\x00", "\xa0", "　", "a", "the", "The", "WORD", "Éç", "é", "É", "ß", "İ", "ı",
    "é", "́", "ﬁ", "Å", "漢字", "💡", "1", "23", "²", ".", ",", "...", "!", "'", "'s", "'S", "'re", "\"", "(", ")", "-", "_", "|",
    "<|endoftext|>", "<|startoftext|>", "<|", "|>", "½", "‍", "ͅ", "Σ", "ς", "ǅ",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("remembered", [50, 600_000])
def test_random_texts(monkeypatch, name, remembered):
    monkeypatch.setattr(E, "REMEMBERED", remembered)
    random.seed(17)
    own = Tokenizer.from_file(public_tokenizers.path(name))
    cells = E.ChunkEncoder(public_tokenizers.path(name))
    for _ in range(40):
        texts = ["".join(random.choices(PARTS, k=random.randint(0, 25))) for _ in range(400)] + [None, ""]
        ids, ends = cells.encode(pa.array(texts))
        start = 0
        for text, end in zip(texts, ends.tolist()):
            assert ids[start:end].tolist() == own.encode(text or "", add_special_tokens=False).ids, repr(text)
            start = end
