"""The word caches of op6 against the library on whole texts."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftmap.llm import queries
from driftmap.llm.records import WordTokenizer

PATHS = [queries.tokenizer("word_bpe_49k.json")]
TOKENIZERS = [WordTokenizer(p, words=w, parts=w) for p in PATHS for w in (3, 1000)]
TEXTS = [
    None, "", " \t\r\n", "don't I'm Über's ÀB!! 's' ''s x'S É́ é! ﬁn İ ß µm ªb", "<|endoftext|>x a<|startoftext|> <|ENDOFTEXT|>", "\x01 \x1c\x1d\x85z\xa0y ǅ 3.5% ---'ll K Å \x00a",
    "it's 'tis rock'n'roll we'd'", "A_b^c` ~{|} word*** WORD$$$ wOrD,", "漢字かな 🙂🙂  x　y ñandú", "a" * 5000 + " " + "!" * 5000, "Same same SAME, same. " * 50,
]


def encoded(t: WordTokenizer, texts: list[str | None]) -> list[bytes]:
    return t.encode([x if x is None else x.encode() for x in texts])


def library(t: WordTokenizer, text: str | None) -> bytes:
    return np.array(t.library.encode(text or "", add_special_tokens=False).ids, t.kind).tobytes()


@pytest.mark.parametrize("t", TOKENIZERS, ids=lambda t: str(t.most_words))
def test_texts(t):
    assert t.cuts
    for _ in range(2):
        assert encoded(t, TEXTS) == [library(t, x) for x in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbZéÉßİſ'stldrev.,*!<|> \n\t\x0b\x1c\xa0́　1٣")), max_size=4))
def test_any_text(texts):
    for t in TOKENIZERS:
        assert encoded(t, texts) == [library(t, x) for x in texts]


def test_other_vocabularies_go_through_the_library():
    t = WordTokenizer(PATHS[0])
    t.cuts = False
    assert encoded(t, TEXTS) == [library(t, x) for x in TEXTS]
