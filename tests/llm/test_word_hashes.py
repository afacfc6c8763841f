"""Word hashes of the substring operator: the same word, the same hash, wherever a text is cut."""

import numpy as np

from plotline.llm import substring_dedup as S


def test_word_hashes(monkeypatch):
    rng = np.random.default_rng(2)
    words = ["a", "b", "ab", "ba", "é", "日本", "aa", "x" * 90, *[str(x) for x in rng.integers(0, 10**9, 3000)]]
    text = "".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", "\x0b", "\x0c\r"]) for _ in range(6000)).encode()
    split = text.split()
    whole = S.word_hashes(text)
    assert len(whole) == len(split)
    by_word = dict(zip(split, whole.tolist()))
    assert len(set(by_word.values())) == len(by_word) and [by_word[w] for w in split] == whole.tolist()
    monkeypatch.setattr(S, "_PART", 16)
    assert (S.word_hashes(text) == whole).all() and (S.word_hashes(b"\n " + text.strip()) == whole).all()
    assert len(S.word_hashes(b"")) == len(S.word_hashes(b" \n")) == 0
    long_word = b"z" * 1000
    assert S.word_hashes(b"q " + long_word + b" q")[1] == S._part_hashes(long_word)[0]
