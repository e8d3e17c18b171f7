import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewloom.llm.tokens import encoder

ODD = [
    "", " ", "Hello, World! don't DON'T we'll it'sx 'tis ''s", "á ÉÈ ßÿ×÷ª²¼",
    "İstanbul ΣΣ Σ", "<|endoftext|> a<|startoftext|>b", "1234 5a6 x1y", "a\x1cb\x85c\xa0d\x00e",
    "中文 \U0001f600 ठ्", "___ a_b @@ -- ...", "tab\tnew\nline\r\n", "café's é'll",
]


@pytest.mark.parametrize("text", ODD)
def test_same_ids_as_the_tokenizer(tokenizer, text):
    encode = encoder(tokenizer)
    expected = encode.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode([text])[0], encode.width).tolist() == expected


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.characters(max_codepoint=0x17F), max_size=40))
def test_any_latin_text(text):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    encode = encoder(public_tokenizers.path("word_bpe_49k.json"))
    expected = encode.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode([text])[0], encode.width).tolist() == expected


def test_a_small_memo_gives_the_same_ids(tokenizer, monkeypatch):
    encode = encoder(tokenizer)
    texts = [f"word{i} other{i % 7} the" for i in range(500)]
    before = encode(texts)
    monkeypatch.setattr("reviewloom.llm.tokens.MEMO_PIECES", 50)
    encode.pieces.clear()
    assert encode(texts) == before
