from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from granary.llm import substring_dedup as S
from granary.llm.words import hash_words, windows


def brute(rows, width):
    first = {}
    for i, text in rows:
        words = (text or "").encode().split()
        for s in range(len(words) - width + 1):
            key = tuple(words[s : s + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for s in range(len(words) - width + 1):
            if first[tuple(words[s : s + width])] < i:
                gone |= set(range(s, s + width))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(spark, rows, width):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in S.repeats_removed(docs, width).collect())


def test_whole_table_matches_brute_force(spark, sample):
    rows = [(i, t) for i, t, *_ in sample]
    assert got(spark, rows, 50) == brute(rows, 50)


@pytest.mark.parametrize("group_bytes", [1 << 10, 1 << 22])
def test_random_repeats_over_many_groups(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(S, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(S, "RANGE_WORDS", 200)
    rng = random.Random(1)
    passages = [[f"w{rng.randrange(40)}" for _ in range(rng.randint(6, 30))] for _ in range(12)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.randint(0, 8)):
            words += rng.choice(passages) if rng.random() < 0.6 else [f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 12))]
        rows.append((1000 - i, " \n".join(words)))
    assert got(spark, rows, 8) == brute(rows, 8)


def test_nulls_empties_ties_repeats_and_other_columns(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, None), (2, ""), (4, passage), (4, passage), (9, f"x {passage} y"), (None, passage), (7, "a b  \x0b c"), (8, "word " * 60_000)]
    docs = spark.createDataFrame([(*r, 1, "g") for r in rows], "doc_id long, text string, n_words int, g string")
    out = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in S.without_repeats(docs).collect()}
    assert out == {(1, 0, 0, ""), (2, 0, 0, ""), (4, 60, 0, passage), (9, 62, 60, "x y"), (None, 60, 60, ""), (7, 2, 0, "a b c"), (8, 60_000, 0, " ".join(["word"] * 60_000))}
    assert docs.count() == S.without_repeats(docs).count()


def test_empty_table(spark):
    out = S.repeats_removed(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and out.count() == 0


def test_equal_windows_hash_alike_wherever_they_stand():
    hashes, first = hash_words([b"a b c d", b"", b"x a b c\ty", b"\0 a", b"a"])
    assert list(first) == [0, 4, 4, 9, 11, 12]
    starts, h = windows(hashes, first, 3)
    assert list(starts) == [0, 1, 4, 5, 6] and h[0] == h[3] and len(set(h)) == 4
    assert hashes[9] != hashes[10] == hashes[11]


def test_words_that_a_polynomial_confuses_stay(spark):
    for n in (1024, 4096):
        word = "a"
        while len(word) < n:
            word += word.translate(str.maketrans("ab", "ba"))
        lead = " ".join(f"w{i}" for i in range(49))
        rows = [(1, f"{lead} {word}"), (2, f"{lead} {word.translate(str.maketrans('ab', 'ba'))}"), (3, f"{lead} {word}")]
        assert got(spark, rows, 50) == brute(rows, 50)


def test_very_many_rows_without_an_id(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.range(300_000).selectExpr("CASE WHEN id = 5 THEN 1L END AS doc_id", f"CASE WHEN id IN (5, 299999) THEN '{passage}' ELSE concat('short ', id) END AS text")
    out = S.without_repeats(docs)
    assert out.count() == 300_000 and [tuple(r) for r in out.where("n_removed > 0").collect()] == [(None, 60, 60, "")]


def test_documents_beyond_the_tag_are_told_apart():
    h = np.array([5, 3, 5, 3], dtype=np.uint64)
    for docs in (4, 1 << 19):
        doc = np.array([docs - 1, 0, docs - 1 - (1 << 18) if docs > 1 << 18 else 1, 0])
        hashes, found = S._by_hash(h, doc, docs)
        assert hashes.tolist() == [3, 3, 5, 5] and found.tolist() == [0, 0, *sorted(doc[[0, 2]].tolist())]
