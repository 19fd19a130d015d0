"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Both scans read the documents where they lie; no text is shuffled. The first
counts, over all documents, how many hold each n-gram of the benchmark. Each
item's seeds are the rarer of its n-grams: a rank, not a limit, so an item
that is copied into very many documents keeps its seeds. The second scan joins
documents to items by seeds and aligns, word by word, each item with the part
of the document around its seeds, where it holds as many of them as every
alignment of the least score leaves.

One scan counts the n-grams of the whole benchmark, whatever its size. Its
distinct texts are then taken in blocks of bounded size; each block is
broadcast and costs a scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.scratch import map_batches, place_of, written
from granary.llm.words import hash_words, windows

#: Letters in lower case, other ASCII characters but digits as spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_LUMP = 1 << 20
#: UTF-8 bytes of benchmark texts in a block: what one broadcast holds at most, but for a single longer item.
BLOCK_BYTES = 8 << 20
#: N-grams that a task counts before it hands them on; bits of the filter, as a power of two at most.
_HELD, _FILTER_BITS = 1 << 20, 27
#: Places of seeds that are looked at together; words of a text that are aligned at once where a pair has more.
_HITS, _PIECE = 1 << 20, 1 << 14


@dataclass
class Seeds:
    """N-grams of one width: hashes (sorted), and the items that each is a seed of, with the place in the item, one after the other."""

    hashes: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    places: np.ndarray


@dataclass
class Block:
    """Some benchmark items, by the key of their text: word hashes and seeds."""

    keys: list[str]
    items: list[np.ndarray]
    seeds: dict[int, Seeds]
    needs: np.ndarray  # seeds of each item that an alignment of the least score leaves at least
    spans: np.ndarray  # how far apart the diagonals of such an alignment can lie


def _fold(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace").translate(_FOLD)


def _left(n: int, width: int, least_score: float) -> tuple[int, int]:
    """The widest n-gram, up to ``width`` words, that every alignment of the score with an item of ``n`` words leaves, and how many at least.

    m matches less e edits make t = least_score * n at least, so e <= n - t; edits part the
    matches into e + 1 runs at most, which hold m - (w - 1)(e + 1) n-grams or more.
    """
    t = max(1, int(np.ceil(least_score * n - 1e-9)))
    found = [(w, t if w == 1 else t - (w - 1) - (w - 2) * max(0, n - t)) for w in range(1, min(width, n) + 1)]
    return next(x for x in reversed(found) if x[1] > 0)


def _width(n: int, width: int, least_score: float) -> int:
    return _left(n, width, least_score)[0] if n else 0


def _grams(words: np.ndarray, width: int) -> np.ndarray:
    return windows(words, np.array([0, len(words)]), width)[1]


def _found(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ``values`` are in the sorted ``wanted``, and where there."""
    if not len(wanted):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    place = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    at = np.flatnonzero(wanted[place] == values)
    return at, place[at]


def _lumps(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches' parts of bounded size, and the texts, column number ``text``, of each."""
    for batch in batches:
        column, at = batch.column(text), 0
        while at < batch.num_rows:
            texts, size, start = [], 0, at
            while at < batch.num_rows and size < _LUMP:
                texts.append(_fold(column[at].as_py()))
                size += len(texts[-1])
                at += 1
            yield batch.slice(start, at - start), texts


def _item_grams(items: DataFrame, width: int, least_score: float) -> DataFrame:
    """(block, w, h): the distinct n-grams of ``items`` (block, text) of the width that each item's seeds have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _lumps(batches, 1):
            words, first = hash_words(texts)
            for block, a, b in zip(part.column(0), first, first[1:]):
                w = _width(b - a, width, least_score)
                h = np.unique(_grams(words[a:b], w)).view(np.int64) if w else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()] * len(h), pa.int32()), pa.array([w] * len(h), pa.int32()), pa.array(h)], ["block", "w", "h"])

    return written(map_batches(items.select("block", "text"), run, "block int, w int, h long").distinct(), "grams")


def _frequencies(texts: DataFrame, grams: DataFrame) -> DataFrame:
    """(block, w, h, n): in how many of ``texts`` (its only column is a text) each of ``grams`` occurs, if in any. One scan, whatever the number of blocks.

    What the scan hands on are n-grams that pass a filter of bits, of bounded
    size; the join with the benchmark's n-grams is exact.
    """
    n_grams, widths = grams.count(), sorted(r["w"] for r in grams.select("w").distinct().collect())
    bits = min(_FILTER_BITS, max(10, (16 * n_grams).bit_length()))
    at = F.shiftrightunsigned("h", 64 - bits)
    words = grams.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    passes = np.zeros(1 << bits - 6, dtype=np.int64)
    passes[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(passes.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {w: [] for w in widths}

        def merged(w: int) -> tuple[np.ndarray, np.ndarray]:
            if not held[w]:
                return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
            h, n = (np.concatenate(x) for x in zip(*held[w]))
            h, place = np.unique(h, return_inverse=True)
            return h, np.bincount(place, weights=n, minlength=len(h)).astype(np.int64)

        def rows(w: int) -> pa.RecordBatch:
            h, n = merged(w)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), w), pa.int32()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["w", "h", "n"])

        for _, lump in _lumps(batches, 0):
            found, first = hash_words(lump)
            doc = np.repeat(np.arange(len(lump)), np.diff(first))
            for w in widths:
                starts, h = windows(found, first, w)
                place = h >> np.uint64(64 - bits)
                hit = np.flatnonzero(shared.value[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))
                order = np.lexsort((doc[starts[hit]], h[hit]))
                own, of = h[hit][order], doc[starts[hit]][order]
                new = np.ones(len(own), dtype=bool)
                new[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1])  # a text counts once
                held[w].append(np.unique(own[new], return_counts=True))
                if sum(len(x) for x, _ in held[w]) > _HELD:
                    held[w] = [merged(w)]
                    if len(held[w][0][0]) > _HELD // 2:
                        yield rows(w)
                        held[w] = []
        for w in widths:
            yield rows(w)

    counts = map_batches(texts, run, "w int, h long, n long").groupBy("w", "h").agg(F.sum("n").alias("n"))
    return written(grams.join(counts, ["w", "h"]).select("block", "w", "h", "n"), "frequencies")


def _block(rows: list[tuple[str, str]], counts: dict[int, tuple[np.ndarray, np.ndarray]], width: int, share: float, least: int, least_score: float) -> Block:
    """The block of (key, text) pairs; ``counts`` has by width n-grams (sorted) and how many documents hold each."""
    hashes, first = hash_words([_fold(t) for _, t in rows])
    items = [hashes[a:b] for a, b in zip(first, first[1:])]
    needs, chosen = np.zeros(len(items), dtype=np.int64), {}
    for i, words in enumerate(items):
        if not len(words):
            continue
        w, needs[i] = _left(len(words), width, least_score)
        grams = _grams(words, w)
        often = np.zeros(len(grams), dtype=np.int64)
        known, n = counts.get(w, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        at, place = _found(grams, known)
        often[at] = n[place]
        order = np.lexsort((np.arange(len(grams)), often))
        # Each n-gram left out is one less to count on: as many go as leave one at least.
        most = max(least, int(np.ceil(share * len(grams))), len(grams) - needs[i] + 1)
        needs[i] -= max(0, len(grams) - most)
        order = order[:most]
        chosen.setdefault(w, []).append((grams[order], np.full(len(order), i, dtype=np.int32), order.astype(np.int32)))
    seeds = {}
    for w, parts in chosen.items():
        h, item, place = (np.concatenate(p) for p in zip(*parts))
        order = np.argsort(h, kind="stable")
        unique, starts = np.unique(h[order], return_index=True)
        seeds[w] = Seeds(unique, np.append(starts, len(order)), item[order], place[order])
    spans = np.array([len(x) - int(np.ceil(least_score * len(x) - 1e-9)) for x in items], dtype=np.int64)
    return Block([k for k, _ in rows], items, seeds, needs, spans)


def align(item: np.ndarray, text: np.ndarray, match: int = 1, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int]:
    """Smith-Waterman over word hashes: best local score, and start and end (exclusive) of its part of ``text``."""
    n = len(text)
    score, begin = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    steps, places = -gap * np.arange(n + 1), np.arange(n + 1)
    best, span = 0, (0, 0)
    for word in item:
        up, slant = score + gap, np.full(n + 1, -1, dtype=np.int64)
        slant[1:] = score[:-1] + np.where(text == word, match, mismatch)
        now, start = up, begin
        better = slant > now
        now = np.where(better, slant, now)
        start = np.where(better, np.concatenate(([0], begin[:-1])), start)
        empty = now <= 0
        now, start = np.where(empty, 0, now), np.where(empty, places, start)
        level = now + steps  # a gap in the item: the best earlier cell, less a step for each word since
        source = np.maximum.accumulate(np.where(level == np.maximum.accumulate(level), places, 0))
        score, begin = level[source] - steps, start[source]
        at = int(score.argmax())
        if score[at] > best:
            best, span = int(score[at]), (int(begin[at]), at)
    return best, *span


def _dense(hits: np.ndarray, needs: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which of the sorted ``hits`` (text, item, diagonal) have as many of their pair about them as the item needs."""
    n = hits.shape[1]
    ends = np.arange(n) + needs[hits[1]] - 1
    to = np.minimum(ends, n - 1)
    full = (ends < n) & (hits[0, to] == hits[0]) & (hits[1, to] == hits[1]) & (hits[2, to] - hits[2] <= spans[hits[1]])
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, np.flatnonzero(full), 1)
    np.add.at(cover, ends[full] + 1, -1)
    return np.cumsum(cover[:-1]) > 0


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each of ``starts``, as many as ``sizes`` says, one after the other."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


def _cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours whose sizes add up to ``most`` at most, or of a single larger one."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def _candidates(words: np.ndarray, first: np.ndarray, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, item, place in the item, first occurrence, occurrences' number and places) of the seeds of pairs that share as many seeds as the item needs.

    An alignment of the least score leaves so many of the item's seeds in the
    text, each counted once however often it occurs there. So what is held at once is
    bounded by the seeds of the block, or of a million for several texts.
    """
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for w, seeds in block.seeds.items():
        starts, h = windows(words, first, w)
        at, which = _found(h, seeds.hashes)
        order = np.lexsort((which, doc[starts[at]]))
        where, which = starts[at][order], which[order]
        key, begin, times = np.unique(doc[where] * len(seeds.hashes) + which, return_index=True, return_counts=True)
        text, seed = np.divmod(key, len(seeds.hashes))
        size = seeds.starts[seed + 1] - seeds.starts[seed]
        texts, text_at = np.unique(text, return_index=True)
        text_at = np.append(text_at, len(text))
        for a, b in _cuts(np.add.reduceat(size, text_at[:-1]) if len(texts) else size, _HITS):
            own = np.arange(text_at[a], text_at[b])
            entry = _ranges(seeds.starts[seed[own]], size[own])
            of = np.repeat(own, size[own])
            pair = text[of] * len(block.items) + seeds.items[entry]
            pairs, inverse, shared = np.unique(pair, return_inverse=True, return_counts=True)
            keep = np.flatnonzero((shared >= block.needs[pairs % len(block.items)])[inverse])
            keep = keep[np.argsort(inverse[keep], kind="stable")]
            if len(keep):
                yield text[of[keep]], seeds.items[entry[keep]].astype(np.int64), seeds.places[entry[keep]].astype(np.int64), begin[of[keep]], times[of[keep]], where


def _matches(words: np.ndarray, first: np.ndarray, block: Block, least_score: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, start, words) of the best alignment of each pair that shares enough seeds, from ``least_score`` on."""
    best: dict[tuple[int, int], tuple[float, int, int]] = {}

    def tried(d: int, i: int, low: int, high: int) -> None:
        found, x, y = align(block.items[i], words[low:high])
        score = found / len(block.items[i])
        if score >= least_score and score > best.get((d, i), (0,))[0]:
            best[d, i] = (score, low + x - int(first[d]), y - x)

    for text, item, place, begin, times, where in _candidates(words, first, block):
        edges = np.flatnonzero(np.diff(text * len(block.items) + item, prepend=-1, append=-1))
        total = np.add.reduceat(times, edges[:-1])
        for a, b in _cuts(total, _HITS):
            span = slice(edges[a], edges[b])
            if total[a] > _HITS:  # one pair, whose words repeat very often: no place is more likely than another
                d, i = int(text[edges[a]]), int(item[edges[a]])
                n, step = len(block.items[i]), max(_PIECE, 4 * len(block.items[i]))
                for low in range(int(first[d]), int(first[d + 1]), step):
                    tried(d, i, low, min(int(first[d + 1]), low + step + 2 * n))
                continue
            at = where[_ranges(begin[span], times[span])]
            hits = np.stack([np.repeat(x[span], times[span]) for x in (text, item, place)])
            hits[2] = at - hits[2]
            hits = hits[:, np.lexsort(hits[::-1])]
            hits = hits[:, _dense(hits, block.needs, block.spans)]
            start = 0
            for end in range(1, hits.shape[1] + 1):
                d, i, diagonal = (int(x) for x in hits[:, end - 1])
                slack = max(len(block.items[i]) // 2, int(block.spans[i])) + 2
                if end < hits.shape[1] and (hits[:2, end] == hits[:2, end - 1]).all() and hits[2, end] <= diagonal + slack:
                    continue
                tried(d, i, max(int(first[d]), int(hits[2, start]) - slack), min(int(first[d + 1]), diagonal + len(block.items[i]) + slack))
                start = end
    return [(d, i, *v) for (d, i), v in best.items()]


def _blocks(texts: DataFrame, benchmark: DataFrame, width: int, share: float, least_seeds: int, least_score: float, block_bytes: int) -> Iterator[Block]:
    """The distinct texts of ``benchmark`` (key, text) in blocks by their keys' hash, fetched one block at a time; the n-grams of all are counted in ``texts`` first."""
    items = benchmark.groupBy("key").agg(F.first("text").alias("text"))
    n = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes
    items = written(items.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")), "items")
    grams = _item_grams(items, width, least_score)
    if grams.isEmpty():
        return
    counted = _frequencies(texts, grams)
    for k in range(n):
        rows = sorted((r["key"], r["text"]) for r in items.where(F.col("block") == k).collect())
        found = counted.where(F.col("block") == k).select("w", "h", "n").toArrow()
        w, h, often = found.column("w").to_numpy(), found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
        order = np.argsort(h, kind="stable")
        counts = {int(x): (h[order][w[order] == x], often[order][w[order] == x]) for x in np.unique(w)}
        if rows:
            yield _block(rows, counts, width, share, least_seeds, least_score)


def _keyed(benchmark: DataFrame) -> DataFrame:
    """(item_id, text, key) of the items with a text."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    return rows.withColumn("key", F.sha2("text", 256))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 3, share: float = 0.75, least_seeds: int = 8, least_score: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, start_word, n_words): the pairs of ``docs`` (doc_id, text) and ``benchmark`` (item_id, text) that align.

    Words are runs of letters and digits, in lower case. Seeds are n-grams of
    up to ``width`` words, so few that an alignment of ``least_score`` always
    leaves some: of each item the ``share`` that the fewest documents hold,
    ``least_seeds`` at least. score
    is the local alignment's (1 a match, -1 a mismatch or gap) over the item's
    words: 1 is a whole copy. Pairs from ``least_score`` on are returned, each
    with its best place in the document's words. Texts that are null or have
    no word match nothing; repeated rows are each reported; items of one text
    are sought once; an empty table on either side gives no rows; other columns
    are ignored, and column names are taken in any case.
    """
    spark = docs.sparkSession
    items, schema = _keyed(benchmark), "doc_id long, key string, score double, start_word long, n_words long"
    out = None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for block in _blocks(texts.select("text"), items, width, share, least_seeds, least_score, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, lump in _lumps(batches, 1):
                found = _matches(*hash_words(lump), shared.value, least_score)
                if found:
                    columns = [batch.column(0).take(pa.array([f[0] for f in found])), pa.array([shared.value.keys[f[1]] for f in found], pa.string()), *(pa.array([f[k] for f in found], t) for k, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64())))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "score", "start_word", "n_words"])

        part = map_batches(texts, run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.join(items.select("item_id", "key"), "key").select("doc_id", "item_id", "score", "start_word", "n_words")


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 3, share: float = 0.75, least_seeds: int = 8, least_score: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`contaminated` would not report. Decided row by row: an id's null or repetition doesn't matter. Columns of any name and type pass through; the text's name is taken in any case."""
    spark = docs.sparkSession
    out, at = docs, place_of(docs.columns, "text")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    for block in _blocks(texts, _keyed(benchmark), width, share, least_seeds, least_score, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, lump in _lumps(batches, at):
                keep = np.ones(len(lump), dtype=bool)
                keep[[f[0] for f in _matches(*hash_words(lump), shared.value, least_score)]] = False
                yield batch.filter(pa.array(keep))

        out = map_batches(out, run, docs.schema)
    return out
