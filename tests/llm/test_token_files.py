from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm import token_files as T
from granary.llm.scratch import shared_path

LIBRARY = Tokenizer.from_file(T.tokenizer_path())


def library_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 32), st.data())
def test_packing_is_an_exact_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << bits) - 1), max_size=40)), dtype=np.uint32)
    packed = T.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    assert list(T.unpack(packed, bits, len(ids))) == list(ids)


@pytest.mark.parametrize("bits", [13, 16])
def test_random_access(bits):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 1 << bits, n).astype(np.uint32) for n in (5, 0, 900, 1, 64)]
    file = T.TokenFile(T.to_file(docs, bits, block=64))
    assert all((file.doc(i) == d).all() and len(file.doc(i)) == len(d) for i, d in enumerate(docs))
    whole = np.concatenate(docs)
    for a, b in ((0, 970), (63, 65), (64, 128), (969, 970), (7, 7)):
        assert (file.ids(a, b) == whole[a:b]).all()
    with pytest.raises(ValueError):
        T.to_file([np.array([1 << bits])], bits)


def test_fewest_bits():
    assert [T.bits_for(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aAbZ 's'tßÉèÇ\t\n0١.,!<|>%́̌J \u0085\x1cΣς東"), st.characters(codec="utf-8")), max_size=60))
def test_cached_words_encode_as_the_library_does(text):
    assert list(T.encoder(T.tokenizer_path()).encode(text)) == library_ids(text)[:-1]


def test_special_tokens_in_a_text_are_the_librarys():
    for text in ("a <|endoftext|> b", "a<|startoftext|>b", "<|endoftext|", "x <|endof text|> it's WE'LL"):
        assert list(T.encoder(T.tokenizer_path()).encode(text)) == library_ids(text)[:-1]


def test_a_small_memory_changes_nothing():
    small = T.WordEncoder(T.tokenizer_path(), cache=3)
    for text in ("the cat sat on the mat, the end.", "été à côté — 東京 it's", "a b c d e f g a b c"):
        assert list(small.encode(text)) == library_ids(text)[:-1]


def digests(rows):
    out, start = [], 0
    for i, text in rows:
        data = np.array(library_ids(text), dtype="<u4")
        out.append((i, start, len(data), zlib.crc32(data.tobytes())))
        start += len(data)
    return out


def test_files_hold_what_the_library_encodes(spark, sample):
    docs = spark.createDataFrame([(i, t) for i, t, *_ in sample], "doc_id long, text string").repartition(5)
    path = shared_path(spark, "tokens")
    T.write_tokens(docs, path, file_chars=20_000)
    assert spark.read.parquet(f"{path}/files").count() > 10
    want = digests([(i, t) for i, t, *_ in sample])
    assert sorted(tuple(r) for r in T.token_digests(spark, path).collect()) == want
    back = {r["doc_id"]: (r["start"], r["ids"]) for r in T.read_tokens(spark, path).collect()}
    assert back == {i: (s, library_ids(t)) for (i, t, *_), (_, s, _, _) in zip(sample, want)}


def test_nulls_empties_repeats_and_other_columns(spark):
    rows = [(3, None), (1, ""), (None, "null id"), (2, "same"), (2, "same"), (2, "Other"), (5, "long text, " * 20_000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start int, file int")
    # rows of one id are in the order of their texts' hashes
    by_hash = [(2, r["t"]) for r in spark.createDataFrame([("Other",), ("same",), ("same",)], "t string").orderBy(F.xxhash64("t")).collect()]
    order = [(None, "null id"), (1, ""), *by_hash, (3, None), (5, rows[-1][1])]
    got = sorted((tuple(r) for r in T.written_digests(docs).collect()), key=lambda r: r[1])
    assert got == digests(order)


def test_one_id_may_fill_many_files(spark):
    docs = spark.range(0, 3000, 1, 6).selectExpr("7L AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same text' ELSE concat('text ', id) END AS text")
    path = shared_path(spark, "tokens")
    T.write_tokens(docs, path, file_chars=4000)
    files = spark.read.parquet(f"{path}/files")
    assert files.select("range").distinct().count() > 4 and files.agg(F.max(F.size("doc_ids"))).first()[0] < 1500
    got = sorted(tuple(r)[1:] for r in T.token_digests(spark, path).collect())
    assert [s + n for s, n, _ in got][:-1] == [s for s, _, _ in got][1:] and got[0][0] == 0
    want = Counter(x[2:] for x in digests([(7, r["text"]) for r in docs.collect()]))
    assert Counter(x[1:] for x in got) == want


def test_empty_table(spark):
    out = T.written_digests(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == 0


def test_the_memory_of_words_is_bounded_in_bytes():
    library, own = Tokenizer.from_file(T.tokenizer_path()), T.WordEncoder(T.tokenizer_path(), cache=1 << 20)
    rng = random.Random(6)
    blob = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(300))
    for turn in range(12):
        text = " ".join([blob() for _ in range(40)] + ["the same words", "größe", "日本語の"[: turn % 4]])
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.held <= 1 << 20 and own.words
    text = " ".join(blob() for _ in range(400))  # more than the memory by itself: remembered for this text alone
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids and own.held > 1 << 20
    own.encode("one more word")
    assert own.held < 1 << 20


def test_slices_of_a_text_join_up(monkeypatch):
    library, own = Tokenizer.from_file(T.tokenizer_path()), T.WordEncoder(T.tokenizer_path(), cache=2000)
    monkeypatch.setattr(T, "_SLICE", 7)
    text = "It's a text of 23 words, größer than a slice; " * 9
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
