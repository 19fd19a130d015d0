"""Pairs of texts whose sets of word shingles are alike: minima meet in cells, whole sets decide.

Two sets share the minimum of a random order of shingles with a chance of
their Jaccard similarity J. Of 120 such minima, 20 bands of 6 name a cell
each: at J = 0.8 a pair meets with a chance of 0.998, at 0.9 of 0.9999999. Every
pair is decided by its two whole sets.

No cell's pairs are all tried. Its members meet the least first, which connects
most copies by linearly many pairs. Of the cells that these links leave unconnected, all members meet the one whose set holds the
fewest shingles of its own, found in no other set: of copies that were edited
each in its own way that is the original, the hub. What remains is settled by
counting: what two sets have in common is no more than what each has in common
with the hub, and what each has of other shingles that any unconnected set
holds too. Members that this bound rules out for all of a cell's sizes go, and
only pairs that it allows, in cells that are still unconnected, are tried.

Texts with equal sets are one member: the smallest doc_id stands for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.components import connected_components
from granary.llm.scratch import map_batches, with_fields, written
from granary.llm.words import hash_words, mixed, windows

BANDS, ROWS = 20, 6
_LUMP = 1 << 18
#: Members of a cell that are joined with as many others in one group; a larger cell is dealt into several such groups.
_CROWD = 512
_ODD = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_STEP = mixed(np.arange(1001, ROWS + 1001, dtype=np.uint64)) | np.uint64(1)
_BAND = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Each text's set of shingles as sorted 64-bit hashes; ASCII letters lower-cased; a text of fewer words is one shingle, one without words the empty set."""
    hashes, first = hash_words([t.lower() for t in texts])
    starts, found = windows(hashes, first, width)
    cuts = np.searchsorted(starts, first)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        n = int(first[i + 1] - first[i])
        yield np.unique(found[a:b]) if n >= width or n == 0 else windows(hashes[first[i] : first[i + 1]], np.array([0, n]), n)[1]


def cells(shingles: np.ndarray) -> np.ndarray:
    """The cell of each band, as longs; none for the empty set."""
    if not len(shingles):
        return np.zeros(0, dtype=np.int64)
    base, least = mixed(shingles), None
    for at in range(0, len(base), 2048):
        low = (base[at : at + 2048, None] * _ODD).min(axis=0)
        least = low if least is None else np.minimum(least, low)
    return mixed((mixed(least).reshape(BANDS, ROWS) * _STEP).sum(axis=1, dtype=np.uint64) ^ _BAND).view(np.int64)


def _mapped(docs: DataFrame, width: int, added: dict[str, str], row: Callable[[bytes, np.ndarray], tuple]) -> DataFrame:
    """``docs`` with its last column, text, replaced by the values of ``row(text, set)``, a lump of texts at a time."""
    kept = docs.schema[:-1]
    types = [pa.list_(pa.int64()) if t == "array<long>" else pa.binary() if t == "binary" else pa.int64() for t in added.values()]
    names = [*kept.names, *added]
    schema = with_fields(kept, ", ".join(f"{n} {t}" for n, t in added.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size, start = [], 0, at
                while at < batch.num_rows and size < _LUMP:
                    texts.append((batch.column(batch.num_columns - 1)[at].as_py() or "").encode("utf-8", "replace"))
                    size, at = size + len(texts[-1]), at + 1
                values = zip(*map(row, texts, shingle_sets(texts, width)))
                columns = [pa.array(list(v), type=t) for v, t in zip(values, types)]
                yield pa.RecordBatch.from_arrays([*batch.slice(start, at - start).columns[:-1], *columns], names)

    return map_batches(docs, run, schema)


def _sketch(shingles: np.ndarray) -> tuple[bytes, int, np.ndarray]:
    sums = [shingles.sum(dtype=np.uint64), mixed(shingles ^ _BAND[0]).sum(dtype=np.uint64)]
    return np.array(sums, dtype=np.uint64).tobytes(), len(shingles), cells(shingles)


def sketches(docs: DataFrame, width: int = 5, also: dict[str, Callable[[bytes], int]] | None = None) -> DataFrame:
    """Every row of ``docs``, its last column, text, replaced by key, n, cells: a 128-bit key of its shingle set, the set's size, its cells. A null text has no words.

    ``also`` names further longs to take from the same texts (UTF-8).
    """
    more = also or {}
    added = {"key": "binary", "n": "long", "cells": "array<long>"} | dict.fromkeys(more, "long")
    return _mapped(docs, width, added, lambda text, shingles: (*_sketch(shingles), *(f(text) for f in more.values())))


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles) of those rows of ``docs`` whose doc_id is in ``ids``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    return written(_mapped(texts, width, {"shingles": "array<long>"}, lambda _, shingles: (shingles.view(np.int64),)), "shingles")


def _near(docs: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets have the similarity."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = _sets(docs, written(ids, "ids"), width)
    a, b = sets.toDF("a", "sa").hint("merge"), sets.toDF("b", "sb").hint("merge")
    common = F.size(F.array_intersect("sa", "sb"))
    near = pairs.join(b, "b").join(a, "a").where(common >= similarity * (F.size("sa") + F.size("sb") - common))
    return written(near.select("a", "b").distinct(), "near")


def _open(crowded: DataFrame, links: DataFrame) -> DataFrame:
    """The members (band, cell, id, n, root, and others) of those cells of ``crowded`` that ``links`` leave unconnected."""
    placed = crowded.drop("root").join(connected_components(links), F.col("id") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "id"))
    cells = placed.groupBy("band", "cell").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("band", "cell")
    return written(placed.join(cells.hint("merge"), ["band", "cell"], "left_semi"), "open")


def _own_shingles(sets: DataFrame) -> DataFrame:
    """(id, own): how many shingles of each of ``sets`` (doc_id, shingles) no other holds; none, if it is not listed."""
    held = sets.select("doc_id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("other"))
    return held.where("id = other").groupBy("id").agg(F.count("*").alias("own"))


def _with_hub(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, hub, of_hub, others) for each pair of a member and its cell's hub: how many shingles of the hub's set it holds, and its other ones."""
    a, b = sets.toDF("id", "s").hint("merge"), sets.toDF("hub", "h").hint("merge")
    met = members.select("id", "hub").distinct().join(a, "id").join(b, "hub")
    return written(met.select("id", "hub", F.size(F.array_intersect("s", "h")).alias("of_hub"), F.size("s").alias("n"), F.size("h").alias("hub_n"), F.array_except("s", "h").alias("others")), "hubs")


def _elsewhere(members: DataFrame, met: DataFrame) -> DataFrame:
    """(id, hub, others): how many of each member's shingles that its hub lacks are also in a set of another root with that hub."""
    placed = members.select("id", "hub", "root").distinct().join(met.select("id", "hub", "others").hint("merge"), ["id", "hub"])
    each = placed.select("id", "hub", "root", F.explode("others").alias("shingle"))
    apart = each.groupBy("hub", "shingle").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("hub", "shingle")
    return each.join(apart.hint("merge"), ["hub", "shingle"]).groupBy("id", "hub").agg(F.count("*").alias("others"))


def _least_alike(common, n, m, similarity: float):
    """Whether sets of n and m shingles with so many in common at most can have the similarity."""
    return common >= similarity * (n + m - common)


def _rest(members: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of ``members`` (band, cell, id, n, root, of_hub, others) of one cell and different roots that can have the similarity."""
    sizes = members.groupBy("band", "cell").agg(F.min("n").alias("least"))
    shared = F.col("of_hub") + F.col("others")
    other = F.greatest(shared, F.col("least"), F.ceil(similarity * F.col("n")))
    live = members.join(sizes.hint("merge"), ["band", "cell"]).where(_least_alike(shared, F.col("n"), other, similarity)).drop("least")
    cells = live.groupBy("band", "cell").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("members")).where("r0 < r1")
    dealt = live.join(cells.select("band", "cell", F.ceil(F.col("members") / _CROWD).alias("k")).hint("merge"), ["band", "cell"])
    dealt = written(dealt.withColumn("at", F.pmod(F.xxhash64("id"), F.col("k"))), "crowds")
    side = lambda i, j, by: dealt.select("band", "cell", i, j, F.struct("id", "n", "root", "of_hub", "others").alias(by))
    x = side(F.col("at").alias("i"), F.explode(F.sequence("at", F.col("k") - 1)).alias("j"), "x")
    y = side(F.explode(F.sequence(F.lit(0).cast("long"), "at")).alias("i"), F.col("at").alias("j"), "y")
    common = F.least("x.of_hub", "y.of_hub") + F.least("x.others", "y.others")
    met = x.hint("merge").join(y, ["band", "cell", "i", "j"]).where("(i < j OR x.id < y.id) AND x.root != y.root").where(_least_alike(common, F.col("x.n"), F.col("y.n"), similarity))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def alike(docs: DataFrame, sketched: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Edges (a, b) between doc_ids of ``docs`` (doc_id, text) whose sets' Jaccard similarity is ``similarity`` at least: as many as connect all that such pairs of a cell connect.

    ``sketched`` is :func:`sketches` of the same rows, doc_id kept. Texts of equal sets are
    linked to the smallest doc_id among them, which alone meets others. Texts
    without words and rows without a doc_id link to none; repeated rows and
    other columns change nothing; an empty table has no edges.
    """
    named = sketched.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    same = named.join(named.groupBy("key").agg(F.min("doc_id").alias("rep")), "key")
    same = written(same.select("doc_id", "rep", "n", F.when(F.col("doc_id") == F.col("rep"), F.col("cells")).alias("cells")), "sets")
    member = F.struct(F.col("doc_id").alias("id"), "n").alias("m")
    entered = same.where("cells IS NOT NULL").select(member, F.posexplode("cells").alias("band", "cell"))
    ends = entered.groupBy("band", "cell").agg(F.min("m").alias("lo"), F.count_distinct("m.id").alias("members")).where("members > 1")
    crowded = written(entered.distinct().join(ends.hint("merge"), ["band", "cell"]), "crowded")
    met = crowded.where("lo.id < m.id").where(F.least("m.n", "lo.n") >= similarity * F.greatest("m.n", "lo.n"))
    pairs = written(met.select(F.col("lo.id").alias("a"), F.col("m.id").alias("b")).distinct(), "pairs")
    near = _near(docs, pairs, width, similarity)
    crowded = crowded.where("members > 2").select("m.*", "band", "cell")  # of two the only pair has met
    still = _open(crowded, near)
    if not still.isEmpty():
        sets = _sets(docs, written(still.select(F.col("id").alias("doc_id")).distinct(), "ids"), width)
        counted = still.join(_own_shingles(sets), "id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
        hubs = counted.groupBy("band", "cell").agg(F.min(F.struct("own", "id")).alias("h")).select("band", "cell", F.col("h.id").alias("hub"))
        still = written(still.join(hubs.hint("merge"), ["band", "cell"]), "hubbed")
        met = _with_hub(still, sets)
        linked = met.where(F.col("id") != F.col("hub")).where(_least_alike(F.col("of_hub"), F.col("n"), F.col("hub_n"), similarity))
        near = written(near.unionByName(linked.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))).distinct(), "near")
        still = _open(still, near)
        figures = met.select("id", "hub", "of_hub").join(_elsewhere(still, met).hint("merge"), ["id", "hub"], "left").withColumn("others", F.coalesce("others", F.lit(0)))
        rest = _rest(still.join(figures.hint("merge"), ["id", "hub"]), similarity)
        rest = written(rest.join(pairs.hint("merge"), ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            near = near.unionByName(_near(docs, rest, width, similarity))
    return near.select("a", "b").unionByName(same.where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))).distinct()
