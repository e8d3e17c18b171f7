import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewloom.llm import word_hashes as wh


def check(text, lower=False):
    words = text.encode().lower().split() if lower else text.encode().split()
    found = wh.word_hashes(text, lower)
    assert len(found) == len(words)
    by_word = dict(zip(words, found.tolist()))
    assert [by_word[w] for w in words] == found.tolist()
    assert len(set(by_word.values())) == len(by_word)
    return by_word


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x85\xa0abABé中\U0001f600", max_size=60), st.booleans())
def test_one_hash_for_each_word(text, lower):
    check(text, lower)


def test_same_word_same_hash_in_any_text():
    one, other = check("a b ab ba aab"), check("ba  x ab\naab")
    assert all(one[w] == other[w] for w in one.keys() & other.keys())
    assert wh.word_hashes(None).tolist() == [] and wh.word_hashes(" \n ").tolist() == []


@pytest.mark.parametrize("lower", [False, True])
def test_parts_and_long_words(monkeypatch, lower):
    text = " ".join(["w" * n + "Z" for n in (1, 40, 4094, 4095, 4096, 9000)] + [f"x{i}" for i in range(3000)]) + "  "
    whole = check(text, lower)
    for size in (1, 7, 1000):
        monkeypatch.setattr(wh, "PART_BYTES", size)
        assert check(text, lower) == whole


def test_no_collisions_among_many_words():
    text = " ".join(f"{a}{b}" for a in ("th", "ht", "an") for b in range(200_000))
    found = wh.word_hashes(text)
    assert len(np.unique(found)) == 600_000
