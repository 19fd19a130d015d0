from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from test_mixing import brute_targets
from test_simhash import brute_copies
from tokenizers import Tokenizer

import corpus_pipeline as P
from granary.llm import decontam, token_files
from granary.llm.words import hash_words

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_match_brute_force(spark):
    stages = dict(P.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    everything = {r["doc_id"]: r for r in docs.collect()}

    kept = stages["language_id"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in everything.items() if any(c.isalpha() for c in r["text"])}

    kept = stages["simhash_near_dedup"](spark, docs, SF)
    assert kept.columns == docs.columns
    roots = brute_copies({i: r["text"] for i, r in everything.items()})
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots.values()))

    kept = stages["benchmark_decontamination"](spark, docs, SF)
    assert kept.columns == docs.columns
    items, at = hash_words([decontam._fold(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    words, first = hash_words([decontam._fold(r["text"]) for r in everything.values()])
    clean = set()
    for k, i in enumerate(everything):
        text = words[first[k] : first[k + 1]]
        present = set(text.tolist())
        score = lambda a: decontam.align(a, text)[0] / len(a) if len(present.intersection(a.tolist())) >= len(set(a.tolist())) / 2 else 0
        if all(score(items[a:b]) < 0.5 for a, b in zip(at, at[1:])):
            clean.add(i)
    assert {r["doc_id"] for r in kept.collect()} == clean

    kept = stages["mixing"](spark, docs, SF)
    assert kept.columns == docs.columns
    size = {i: len(r["text"].split()) for i, r in everything.items()}
    sizes = Counter()
    for i, r in everything.items():
        sizes[r["source"]] += size[i]
    given = Counter()
    for r in kept.collect():
        assert r == everything[r["doc_id"]]
        given[r["source"]] += size[r["doc_id"]]
    target = brute_targets(dict(sizes))
    assert all(abs(given[s] - target[s]) <= max(size.values()) for s in sizes)


def test_the_whole_run(spark):
    out = sorted((tuple(r) for r in P.run(spark, SF).collect()), key=lambda r: r[1])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    library = Tokenizer.from_file(token_files.tokenizer_path())
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        data = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        want.append((r["doc_id"], start, len(data) // 4, zlib.crc32(data)))
        start += len(data) // 4
    assert out == want and len(out) > 50


def test_stages_on_nulls_repeats_and_empty_tables(spark):
    prose = "the cat and the dog went to the house"
    rows = [(1, None, "en", None, None), (2, "", "en", "a", 0), (3, prose, "en", "a", 9), (3, prose, "en", "a", 9), (None, prose, None, None, None), (None, "other words for no id", "en", "b", 1), (None, "other words for no id", "en", "b", 1), (7, prose * 3000, "de", "b", 2)]
    docs = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "'x' AS lang_pred", "1 AS component_id", "2 AS n")
    counts = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert name == "token_files" or out.columns == docs.columns
        counts[name] = out.count()
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert counts["language_id"] == 6 and counts["simhash_near_dedup"] == 4
    assert counts["benchmark_decontamination"] == counts["token_files"] == 8


def test_a_language_that_was_not_learnt_is_rejected(spark):
    en, de = "the cat and the dog went to the house of this man", "der hund und die katze gingen zu dem haus dieses mannes"
    rows = [(i, f"{en if i % 2 else de} {i}", "en" if i % 2 else "de", "s", 1) for i in range(60)]
    rows += [(100, "この文章は学習した言語では書かれていません。猫と犬は家に行きました。", None, "s", 1), (101, "the dog", None, "s", 1), (102, "der hund", None, "s", 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    kept = {r["doc_id"] for r in dict(P.STAGES)["language_id"](spark, docs, SF).collect()}
    assert kept == {*range(60), 101, 102}


def test_stages_take_columns_of_any_name_and_type(spark):
    prose = ["the cat and the dog went to the house", "a quite different text of other words", "the man of this house has a cat and no dog"]
    rows = [(i, t, "en", "a", 9, 4, ("x",), [1], {"k": "v"}, 5) for i, t in enumerate([*prose, *prose])]
    docs = spark.createDataFrame(rows, "Doc_Id long, Text string, Lang string, SOURCE string, n_chars long, `a.b` int, `a b` struct<`c d`: string>, `e``f` array<int>, fp map<string, string>, last int")
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        if name != "token_files":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        want = {"simhash_near_dedup": 3}.get(name, 6)
        got = out.collect()
        assert len(got) == want and all(tuple(r) in rows for r in got if name != "token_files")
