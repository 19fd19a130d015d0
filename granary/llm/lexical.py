"""Ranked lexical search: weights of the items' terms times impacts of the documents', as blocked matrix products.

One scan counts, over all documents, how many hold each term, and how many
terms there are. The items are taken in blocks of bounded size, each of which
is broadcast with its own compact vocabulary: only terms that an item and a
document hold. A second scan turns documents into impacts, a tile of them at a
time, and multiplies it with the tiles of the block: a dense float64 matrix of
documents and vocabulary times one of vocabulary and items. A tile of the
vocabulary ends where an item's partial score could reach 2^53, so that every
product is an exact integer; partial scores are added up as 64-bit integers.

Of each tile the k best of each item are kept, all documents that tie with the
k-th best considered, and merged with the best so far. The tasks' bests meet in
two steps, so that no item's candidates are one group of all tasks'.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import filterfalse, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.scratch import map_batches, written

# The score's constants.
WEIGHT_SCALE, IMPACT_SCALE, K1, B_PERCENT = 1000, 1_000_000_000, 12, 25
#: Letters A-Z in lower case; bytes that belong to no term are spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: No impact is greater: it is less than IMPACT_SCALE / 1000 whatever the term's count.
_MOST_IMPACT = IMPACT_SCALE // 1000
EXACT = 1 << 53
#: Pairs of an item's text and a term in a block, items and terms in a tile, documents in a tile.
BLOCK_PAIRS, ITEM_TILE, TERM_TILE, DOC_TILE = 1 << 16, 64, 2048, 1024
#: Bytes of text that are split at once; distinct terms, and their bytes, that a task counts before it hands them on.
_LUMP, _HELD, _HELD_BYTES = 1 << 20, 1 << 18, 16 << 20


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text (UTF-8) in order, in lists of bounded size."""
    at = 0
    while at < len(text):
        lump = text[at : at + _LUMP].translate(_FOLD)
        if at + _LUMP < len(text):  # a term that goes on in the next lump belongs there; one longer than a lump is joined first
            cut, end = lump.rfind(b" ") + 1, at + 2 * _LUMP
            while not cut:
                lump = text[at:end].translate(_FOLD)
                cut, end = (len(lump) if end >= len(text) else lump.rfind(b" ") + 1), end + len(lump)
            lump = lump[:cut]
        yield lump.split()
        at += len(lump)


def counted(texts: DataFrame) -> DataFrame:
    """(term binary, df, n) over the rows of ``texts`` (its only column is a text): in how many each term occurs; in the row without a term, how many have any and how many terms they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        held = docs = total = 0

        def rows() -> pa.RecordBatch:
            columns = [pa.array([*counts, None], pa.binary()), pa.array([*counts.values(), docs], pa.int64()), pa.array([*repeat(0, len(counts)), total], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["term", "df", "n"])

        for batch in batches:
            for text in batch.column(0):
                own: set[bytes] = set()
                n = 0
                for found in terms(text.as_py() or b""):
                    own.update(found)
                    n += len(found)
                held += sum(map(len, filterfalse(counts.__contains__, own)))
                counts.update(own)
                docs, total = docs + (n > 0), total + n
                if len(counts) > _HELD or held > _HELD_BYTES:
                    yield rows()
                    counts.clear()
                    held = docs = total = 0
        yield rows()

    found = map_batches(texts.select(F.col(texts.columns[0]).cast("binary")), run, "term binary, df long, n long")
    return written(found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")), "terms")


def _item_terms(items: DataFrame) -> DataFrame:
    """(key, term binary, c): each term of each text of ``items`` (key, text) and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                counts: Counter[bytes] = Counter()
                for found in terms(text.as_py() or b""):
                    counts.update(found)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(counts), pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["key", "term", "c"])

    return map_batches(items.select("key", F.col("text").cast("binary").alias("text")), run, "key string, term binary, c long")


@dataclass
class Tile:
    """Some items: their compact vocabulary, as numbers of the block's terms, and its parts (rows of it, rows x items)."""

    first: int
    vocabulary: np.ndarray
    parts: list[tuple[slice, np.ndarray]]
    items: int


@dataclass
class Block:
    """Items of bounded size together, by the key of their text."""

    keys: list[str]
    number: dict[bytes, int]
    tiles: list[Tile]


def exact_parts(weights: np.ndarray, most_rows: int = TERM_TILE, most: int = (EXACT - 1) // _MOST_IMPACT) -> list[tuple[slice, np.ndarray]]:
    """``weights`` (terms x items, integers from 0) cut into float64 parts of neighbouring rows whose columns each add up to ``most`` at most; a row that is greater is in several parts."""
    out, at = [], 0
    rest = weights.astype(np.int64)
    while at < len(rest):
        sums = np.cumsum(rest[at : at + most_rows], axis=0).max(axis=1)
        n = int(np.searchsorted(sums, most, side="right"))
        if n:
            out.append((slice(at, at + n), rest[at : at + n].astype(np.float64)))
            at += n
        else:
            piece = np.minimum(rest[at : at + 1], most)
            out.append((slice(at, at + 1), piece.astype(np.float64)))
            rest[at : at + 1] -= piece
    return out


def block_of(rows: list[tuple[str, bytes, int]], item_tile: int = ITEM_TILE) -> Block:
    """The block of (key, term, weight times occurrences) triples."""
    keys = sorted({k for k, _, _ in rows})
    number = {t: i for i, t in enumerate(sorted({t for _, t, _ in rows}))}
    place = {k: i for i, k in enumerate(keys)}
    item, term, weight = (np.array(x, dtype=np.int64) for x in zip(*((place[k], number[t], w) for k, t, w in rows)))
    tiles = []
    for first in range(0, len(keys), item_tile):
        own = np.flatnonzero((item >= first) & (item < first + item_tile))
        vocabulary, at = np.unique(term[own], return_inverse=True)
        n = min(item_tile, len(keys) - first)
        weights = np.zeros((len(vocabulary), n), dtype=np.int64)
        weights[at, item[own] - first] = weight[own]
        tiles.append(Tile(first, vocabulary, exact_parts(weights), n))
    return Block(keys, number, tiles)


def impacts(batch: list[bytes], number: dict[bytes, int], n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, impact) of each text and each term of it that ``number`` numbers."""
    texts, found, values = [], [], []
    for i, text in enumerate(batch):
        n, parts = 0, []
        for words in terms(text):
            n += len(words)
            at = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
            parts.append(at[at >= 0])
        if n:
            own, tf = np.unique(np.concatenate(parts), return_counts=True)
            m = 100 - B_PERCENT + (B_PERCENT * n * n_docs) // n_terms
            texts.append(np.full(len(own), i))
            found.append(own)
            values.append(IMPACT_SCALE * tf.astype(np.int64) // (1000 * tf + K1 * m))
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x).astype(np.int64) if x else none for x in (texts, found, values))


class Best:
    """The k best (item, document) pairs of each item so far: by falling score, then doc_id, nulls last."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, dtype=np.int64)  # the least score that still counts
        self.item, self.doc, self.null, self.score = (np.zeros(0, dtype=t) for t in (np.int64, np.int64, bool, np.int64))

    def add(self, first: int, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """Offer ``scores`` (documents x items, from item ``first`` on)."""
        floor = self.floor[first : first + scores.shape[1]]
        if len(scores) > self.k:
            floor = np.maximum(floor, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        row, column = np.nonzero(scores >= floor)
        if not len(row):
            return
        item, score = np.concatenate((self.item, column + first)), np.concatenate((self.score, scores[row, column]))
        doc, null = np.concatenate((self.doc, doc[row])), np.concatenate((self.null, null[row]))
        order = np.lexsort((doc, null, -score, item))
        starts = np.flatnonzero(np.diff(item[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        order = order[rank < self.k]
        self.item, self.doc, self.null, self.score = item[order], doc[order], null[order], score[order]
        last = np.flatnonzero(rank[rank < self.k] == self.k - 1)
        self.floor[self.item[last]] = self.score[last]


def _scored(docs: DataFrame, block: Block, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(key, doc_id, score): of each task's documents the k best of each item of the block."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = shared.value
        best, local = Best(len(here.keys), k), np.full(len(here.number), -1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, DOC_TILE):
                part = batch.slice(at, DOC_TILE)
                ids, null = part.column(0).fill_null(0).to_numpy(zero_copy_only=False), part.column(0).is_null().to_numpy(zero_copy_only=False)
                text, term, impact = impacts([t.as_py() or b"" for t in part.column(1)], here.number, n_docs, n_terms)
                for tile in here.tiles:
                    local[tile.vocabulary] = np.arange(len(tile.vocabulary))
                    own = np.flatnonzero(local[term] >= 0)
                    rows, row = np.unique(text[own], return_inverse=True)  # texts without any of the tile's terms have no row
                    column, value = local[term[own]], impact[own]
                    scores = np.zeros((len(rows), tile.items), dtype=np.int64)
                    for span, weights in tile.parts:
                        here_in = (column >= span.start) & (column < span.stop)
                        dense = np.zeros((len(rows), len(weights)))
                        dense[row[here_in], column[here_in] - span.start] = value[here_in]
                        scores += (dense @ weights).astype(np.int64)
                    local[tile.vocabulary] = -1
                    best.add(tile.first, scores, ids[rows], null[rows])
        columns = [pa.array([here.keys[i] for i in best.item], pa.string()), pa.array(best.doc, pa.int64(), mask=best.null), pa.array(best.score, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "score"])

    return map_batches(docs.select("doc_id", F.col("text").cast("binary").alias("text")), run, "key string, doc_id long, score long")


def weight(df: Column, n_docs: int) -> Column:
    return F.floor(WEIGHT_SCALE * F.log((2.0 * n_docs + 2.0) / (2.0 * df + 1.0)))


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of ``docs`` (doc_id, text) that score highest for each row of ``items`` (item_id, text).

    Terms are maximal runs of digits, ASCII letters (in lower case) and
    characters beyond ASCII. Scores are exact integers; equal ones are ranked by
    doc_id, nulls last; scores of 0 are left out. Null and empty texts, and
    texts without a term, score nothing on either side. Rows of equal text are
    searched once and each reported; rows of one doc_id are ranked each; texts
    of any length are read whole; an empty table on either side gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), F.sha2("text", 256).alias("key")).where(F.col("text").isNotNull())
    frequencies = counted(texts.select("text"))
    totals = frequencies.where(F.col("term").isNull()).first()
    n_docs, n_terms = (totals["df"], totals["n"]) if totals else (0, 0)
    # Of rows with equal text one takes part, so that a block's size is bounded whatever repeats.
    pairs = _item_terms(asked.groupBy("key").agg(F.first("text").alias("text")))
    pairs = written(pairs.join(frequencies.where(F.col("term").isNotNull()), "term").select("key", "term", (F.col("c") * weight(F.col("df"), n_docs)).alias("w")).where("w > 0"), "pairs")
    n_blocks, out = math.ceil(pairs.count() / block_pairs), None
    for b in range(n_blocks):
        part = pairs.where(F.pmod(F.xxhash64("key"), F.lit(n_blocks)) == b) if n_blocks > 1 else pairs
        rows = [(r["key"], bytes(r["term"]), r["w"]) for r in part.collect()]
        if rows:
            found = _scored(texts, block_of(rows), n_docs, n_terms, k)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
    few = best(out.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64))), "key", "salt").drop("rank", "salt")
    return asked.select("item_id", "key").join(best(few, "key"), "key").select("item_id", "rank", "doc_id", "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t
  FROM documents),
i AS (
  SELECT item_id, row_number() OVER () AS q, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t
  FROM benchmark),
sizes AS (SELECT r, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
asked AS (SELECT q, term, count(*) AS c FROM (SELECT q, unnest(t) AS term FROM i) GROUP BY ALL),
held AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, total GROUP BY term, docs),
hits AS (
  SELECT a.q, h.r, s.doc_id, sum(a.c * w.w * ((1000000000 * h.tf) // (1000 * h.tf + 12 * (100 - 25 + (25 * s.n * total.docs) // total.terms))))::BIGINT AS score
  FROM asked a JOIN held h USING (term) JOIN weights w USING (term) JOIN sizes s USING (r), total GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM hits WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM best JOIN i USING (q) WHERE rank <= 20
"""
