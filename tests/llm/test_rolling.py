import re

import numpy as np

from hushframe.llm import rolling as R


def hashes(*words, gap=b" "):
    raw = np.frombuffer(gap.join(words), np.uint8)
    return R.word_hashes(raw)[1].tolist()


def test_words_that_a_polynomial_takes_for_equal():
    a, b = b"a", b"b"
    for _ in range(10):
        a, b = a + b, b + a
    assert len(a) == 1024 and len(set(hashes(a, b, a))) == 2


def test_words_are_runs_and_case_does_not_matter():
    raw = " \tOne, two\x0b\x00x\x00\r\n ÉE " + "Long" * 9 + " x"
    data = raw.encode()
    start, h = R.word_hashes(np.frombuffer(data, np.uint8))
    words = [(m.start(), m.group().lower()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", data)]
    assert start.tolist() == [x for x, _ in words]
    assert len(set(h.tolist())) == len({w for _, w in words})
    assert hashes(b"AbZ") == hashes(b"aBz") != hashes(b"abZ" + bytes(1))
    assert len(R.word_hashes(np.zeros(0, np.uint8))[1]) == 0


def test_very_long_words_hash_alike_wherever_they_stand():
    word = b"Q" * (1 << 20)
    assert len(set(hashes(word, b"x", word, word))) == 2
    assert hashes(word)[0] == hashes(b"y", word)[1] != hashes(word[1:])[0]


def test_sizes_within_and_across_lanes():
    words = [bytes([97 + i % 7]) * n for n in range(1, 70) for i in range(7)]
    assert len(set(hashes(*words))) == len(words)
