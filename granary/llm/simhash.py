"""SimHash near-duplicates: segment bit counts, a grid join under Manhattan distance, an exact check.

A fingerprint of 64 bits is cut into 32 segments of two bits. The vector of
the segments' bit counts lies, under Manhattan distance, never further apart
than the fingerprints do in differing bits, so a range join on these vectors
loses no pair. The counts are held as thermometer codes (00, 01, 11), whose
differing bits are the Manhattan distance.

The grid: the vector's coordinates form five blocks. Two vectors at distance
two or less agree on three of the blocks at least, so each vector is entered
into the ten cells that fix three blocks, and pairs are sought within cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.components import connected_components
from granary.llm.scratch import map_batches, place_of, quoted, row_hash, with_fields, written
from granary.llm.shingle_sets import alike, sketches

_LOW = 0x5555555555555555
_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)
_OFFSETS = (np.arange(8) * 256).astype(np.int64)
#: Cells with more fingerprints than this are linked through shared neighbours instead of pairs.
DENSE = 64


def fingerprint(text: bytes, width: int = 3) -> int:
    """The fingerprint of one text: ASCII letters lower-cased, shingles of ``width`` words with repeats; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), shingles), dtype="<u8", count=n)
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
    bits = 2 * np.einsum("jv,vk->jk", counts, _BITS) > n
    return int(np.packbits(bits.ravel(), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with fp (long) added, in the place of a column of that name; a null text has no words."""
    kept = docs.select(*quoted(c for c in docs.columns if c.lower() != "fp"))
    at, schema = place_of(kept.columns, "text"), with_fields(kept.schema, "fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint((t.as_py() or "").encode("utf-8", "replace"), width) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], [*batch.schema.names, "fp"])

    return map_batches(kept, run, schema)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``."""
    return with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width).select("doc_id", "fp")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _counts(fp: Column) -> Column:
    """Thermometer codes of the bit counts of the two-bit segments."""
    up = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(up).bitwiseAND(F.lit(_LOW)), fp.bitwiseAND(up).bitwiseAND(F.lit(_LOW))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _grid(max_bits: int, blocks: int) -> list[int]:
    cuts = [round(32 * i / blocks) * 2 for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [_signed(sum(c)) for c in combinations(masks, blocks - max_bits)]


def linked(fps: DataFrame, max_bits: int = 2, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) between representatives of distinct fingerprints (fp, rep) that differ in ``max_bits`` bits at most.

    For cells of up to ``dense`` members these are all pairs. In denser cells
    two fingerprints within two bits always share a fingerprint within one bit
    of both, so each member is entered under its 65 neighbours and linked to
    the least member there: as many components, linear in the members.
    """
    if max_bits != 2:
        raise ValueError("the dense cells' rule is for two bits")
    cell = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.col("e").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(_grid(max_bits, 5)))))
    cells = fps.withColumn("e", _counts(F.col("fp"))).select("fp", "rep", "e", cell.alias("c")).select("fp", "rep", "e", "c.k", "c.cell")
    sizes = cells.groupBy("k", "cell").agg(F.count("*").alias("n"))
    sizes = written(sizes.where(F.col("n") > 1), "cells")
    members = cells.join(sizes, ["k", "cell"])
    sparse = members.where(F.col("n") <= dense)
    a = sparse.select("k", "cell", F.col("fp").alias("fa"), F.col("e").alias("ea"), F.col("rep").alias("a"))
    b = sparse.select("k", "cell", F.col("fp").alias("fb"), F.col("e").alias("eb"), F.col("rep").alias("b"))
    near = (
        a.join(b, ["k", "cell"])
        .where(F.col("fa") < F.col("fb"))
        .where(F.bit_count(F.col("ea").bitwiseXOR(F.col("eb"))) <= max_bits)
        .where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= max_bits)
        .select("a", "b")
        .distinct()
    )
    crowd = members.where(F.col("n") > dense).select("fp", "rep").distinct()
    flips = F.array(F.lit(0), *(F.lit(_signed(1 << i)) for i in range(64)))
    around = crowd.select("rep", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("key"))
    hubs = around.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where(F.col("n") > 1)
    hubbed = around.join(hubs.hint("merge"), "key").where(F.col("rep") != F.col("hub")).select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    return near.unionByName(hubbed)


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links of ``max_bits`` or fewer
    differing bits reach, the row's own included. Null and empty texts have
    fingerprint zero and link like any other; rows with a null doc_id are in
    their component but never name it (null, if the component has no other);
    repeated rows stay, each with its component; other columns are ignored.
    """
    fps = written(fingerprints(docs, width), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = connected_components(linked(distinct.where(F.col("rep").isNotNull()), max_bits))
    named = distinct.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def near_copies(docs: DataFrame, width: int = 3, max_bits: int = 2, set_width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, fp, component_id) like :func:`near_duplicates`, linked also by like sets of ``set_width``-word shingles.

    A copy with words changed here and there differs in more bits than a grid
    can join; texts whose sets' Jaccard similarity is ``similarity`` at least
    are linked as well. Rows with a null doc_id are in the component of their
    fingerprint, or else of their equal set, and never name one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(sketches(texts, set_width, {"fp": partial(fingerprint, width=width)}), "profiles")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    same = rows.select("doc_id", "fp").join(distinct, "fp").where(F.col("doc_id") != F.col("rep")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    near = linked(distinct.where(F.col("rep").isNotNull()), max_bits)
    roots = connected_components(near.unionByName(same).unionByName(alike(texts, rows.drop("fp"), set_width, similarity)))
    by_set = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("set_rep"))
    loose = rows.where(F.col("doc_id").isNull()).select("doc_id", "fp", "key").join(distinct, "fp", "left").join(by_set, "key", "left")
    placed = rows.where(F.col("doc_id").isNotNull()).select("doc_id", "fp", F.col("doc_id").alias("at"))
    placed = placed.unionByName(loose.select("doc_id", "fp", F.coalesce("rep", "set_rep").alias("at")))
    return placed.join(roots, F.col("at") == F.col("node"), "left").select("doc_id", "fp", F.coalesce("root", "at").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 3, max_bits: int = 2, similarity: float | None = None) -> DataFrame:
    """One row of each component of :func:`near_copies` (without ``similarity``, of :func:`near_duplicates`), with all columns of ``docs``: that of the smallest doc_id; of several, the first by a hash of the row.

    A component without any doc_id has no name: of such rows one of each
    fingerprint stays.
    """
    found = near_duplicates(docs, width, max_bits) if similarity is None else near_copies(docs, width, max_bits, similarity=similarity)
    heads = found.where(F.col("doc_id") == F.col("component_id")).select("component_id").distinct()
    lone = found.where(F.col("doc_id").isNull() & F.col("component_id").isNull()).select("fp").distinct()
    packed = docs.select(F.struct("*").alias("row"))
    key, order = F.col("row.doc_id"), row_hash(docs.schema, "row")
    # Straight after the scan, so that Spark keeps the first row of each key in every task before it shuffles: a key may have very many rows.
    first = lambda rows, by: rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where("n = 1")
    named = first(packed.where(key.isNotNull()), key).join(heads, key == F.col("component_id"), "left_semi")
    loose = with_fingerprint(packed.where(key.isNull()).select("row", F.col("row.text").alias("text")), width)
    loose = first(loose, F.col("fp")).join(lone, "fp", "left_semi")
    return named.select("row.*").unionByName(loose.select("row.*"))
