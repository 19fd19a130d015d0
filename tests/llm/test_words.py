from __future__ import annotations

import random

import numpy as np

from granary.llm import words as W


def test_hashes_tell_words_and_windows_apart_as_text_does():
    rng = random.Random(0)
    pool = [b"a", b"bb", b"c" * 70, b"c" * 71, b"\xc3\xa9x", b"\0"]
    texts = [b" \t".join(rng.choice(pool) for _ in range(rng.randint(0, 200))) for _ in range(100)] + [b"", b"  \n", b"x y " * 200_000, b"z" * 600_000 + b" z"]
    for which in (0, 1):
        hashes, first = W.hash_words(texts, which)
        assert np.diff(first).tolist() == [len(t.split()) for t in texts]
        for width in (1, 2, 3, 5, 25, 50):
            starts, found = W.windows(hashes, first, width, which)
            want = [(int(f) + j, tuple(t.split()[j : j + width])) for f, t in zip(first, texts[:102]) for j in range(len(t.split()) - width + 1)]
            assert starts[: len(want)].tolist() == [i for i, _ in want]
            seen: dict[tuple, int] = {}
            assert all(seen.setdefault(k, int(h)) == h for (_, k), h in zip(want, found))
            assert len(set(seen.values())) == len(seen)


def test_words_that_a_polynomial_confuses():
    for n in (1024, 4096):
        word = b"a"
        while len(word) < n:
            word += word.translate(bytes.maketrans(b"ab", b"ba"))
        other = word.translate(bytes.maketrans(b"ab", b"ba"))
        assert all(len(set(W.hash_words([word, other], which)[0].tolist())) == 2 for which in (0, 1))


def test_the_two_functions_share_no_word_hash():
    one, two = (set(W.hash_words([b"a b c dd " * 3], which)[0].tolist()) for which in (0, 1))
    assert len(one) == len(two) == 4 and not one & two
