"""Exact repeats across documents: fixed anchors, rolling probes, extension to maximal repeats.

Texts are dealt into groups of bounded size by a hash of doc_id and text, so that one
shuffle of the texts (which Spark reuses) serves all three passes and what a
pass has to tell a document comes back under its group.

1. Anchors. A text's non-overlapping blocks of half a window are the index;
   every rolling block of every text is a probe. Any repeat of a whole window
   holds a whole aligned block, so a text that shares a window shares an
   anchor. A group sends its distinct probe hashes, sorted and written as
   differences, to ranges of the hash space. A range keeps the hashes that are
   an anchor somewhere and occur in two documents at least.
2. Extension. Each hit is extended to all windows that hold the block. Their
   96-bit keys, with the smallest doc_id per group, go to ranges of the key
   space, which return the smallest doc_id of all.
3. Removal. Windows whose smallest doc_id is below the document's own are
   covered; neighbouring ones join to the maximal repeats, which are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.scratch import bound_batches, release_memory
from granary.llm.words import hash_words, windows

#: Bytes and documents in a group, and words (one probe each) for a range of the hash space.
GROUP_BYTES, GROUP_DOCS, RANGE_WORDS = 4 << 20, 1 << 16, 2_000_000
_PROBE_BITS = 46
_NO_ID = np.iinfo(np.int64).max


def _pack(keys: np.ndarray) -> bytes:
    """Sorted integers as differences: four bytes each where they fit, else eight."""
    steps = np.diff(keys, prepend=keys[:1])
    small = steps.size == 0 or int(steps.max()) < 1 << 32
    first = keys[:1].astype("<u8").tobytes()
    return (b"4" if small else b"8") + first + steps[1:].astype("<u4" if small else "<u8").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    first = np.frombuffer(data, "<u8", count=(len(data) > 1), offset=1)
    if not len(first):
        return first
    steps = np.frombuffer(data, "<u4" if data[:1] == b"4" else "<u8", offset=9)
    return np.concatenate((first, steps.astype(np.uint64))).cumsum(dtype=np.uint64)


def _planes(values: np.ndarray) -> bytes:
    """The bytes of integers, all first bytes first: high zero bytes then compress away."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _among(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in the sorted ``wanted``, and where."""
    if not len(wanted):
        return np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=np.int64)
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    return wanted[at] == values, at


def _in_order(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are in the sorted ``wanted``: the values are sorted first, as both then stay in cache."""
    order = np.argsort(values)
    found = np.empty(len(values), dtype=bool)
    found[order] = _among(values[order], wanted)[0]
    return found


def _ranges(keys: np.ndarray, bits: int, n: int) -> list[tuple[int, slice]]:
    """Those of n equal ranges of the key space in which any of the sorted keys fall, and where these are."""
    of = ((keys >> np.uint64(bits - 32)) * np.uint64(n)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(of, prepend=of[:1] + np.uint64(1)) != 0)
    return [(int(of[a]), slice(a, b)) for a, b in zip(first, [*first[1:], len(of)])]


def _by_hash(h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Both in the order of hash and document. Where a document's number fits beside the hash, one sort of integers does."""
    if docs <= 1 << 64 - _PROBE_BITS:
        tagged = h << np.uint64(64 - _PROBE_BITS) | doc.astype(np.uint64)
        tagged.sort()
        return tagged >> np.uint64(64 - _PROBE_BITS), tagged & np.uint64((1 << 64 - _PROBE_BITS) - 1)
    order = np.lexsort((doc, h))
    return h[order], doc[order]


class _Group:
    """The texts of one group, hashed."""

    def __init__(self, rows: pa.Table, width: int):
        self.rows = rows
        self.texts = [t or b"" for t in rows.column("text").to_pylist()]
        self.hashes, self.first = hash_words(self.texts)
        self.width, self.block = width, width // 2
        self.doc = np.repeat(np.arange(len(self.texts)), np.diff(self.first))
        ids = rows.column("doc_id").to_pylist()
        self.ids = np.array([_NO_ID if i is None else i for i in ids], dtype=np.int64)

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        starts, h = windows(self.hashes, self.first, self.block)
        return starts, h >> np.uint64(64 - _PROBE_BITS)

    def near(self, hot: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a block whose hash is hot."""
        starts, h = self.probes()
        hits = starts[_in_order(h, hot)]
        edge = np.zeros(len(self.hashes) + 1, dtype=np.int32)
        np.add.at(edge, np.maximum(hits - (self.width - self.block), 0), 1)
        np.add.at(edge, hits + 1, -1)
        return np.cumsum(edge)[:-1] > 0

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, key = windows(self.hashes, self.first, self.width)
        other = hash_words(self.texts, 1)[0]
        check = (windows(other, self.first, self.width, 1)[1] >> np.uint64(32)).astype(np.uint32)
        return starts, key, check


def _probe(width: int, n_ranges: int):
    def run(rows: pa.Table) -> pa.Table:
        group = _Group(rows, width)
        starts, h = group.probes()
        anchors = np.unique(h[(starts - group.first[group.doc[starts]]) % group.block == 0])
        h, doc = _by_hash(h, group.doc[starts], len(group.texts))
        new = np.flatnonzero(np.diff(h, prepend=h[:1] + np.uint64(1)) != 0) if len(h) else np.zeros(0, np.int64)
        many = np.zeros(len(new), dtype=bool)
        if len(h):
            last = np.concatenate((new[1:], [len(h)])) - 1
            many = doc[new] != doc[last]
        found = h[new]
        keys = found << np.uint64(2) | _among(found, anchors)[0].astype(np.uint64) << np.uint64(1) | many.astype(np.uint64)
        spans, own = _ranges(keys, _PROBE_BITS + 2, n_ranges), rows.column("g")[0].as_py()
        release_memory()
        return pa.table({"r": pa.array([i for i, _ in spans], pa.int32()), "g": pa.array([own] * len(spans), pa.int32()), "data": pa.array([_pack(keys[s]) for _, s in spans], pa.binary())})

    return run


def _hot(rows: pa.Table) -> pa.Table:
    parts = [_unpack(x) for x in rows.column("data").to_pylist()]
    keys = np.concatenate(parts)
    keys.sort()
    h = keys >> np.uint64(2)
    new = np.flatnonzero(np.diff(h, prepend=h[:1] + np.uint64(1)) != 0)
    anchor = np.bitwise_or.reduceat(keys, new)
    hot = h[new][(anchor & np.uint64(2) > 0) & ((anchor & np.uint64(1) > 0) | (np.diff(np.append(new, len(h))) > 1))]
    out = [(g, np.unique(own[_among(own, hot)[0]])) for g, own in zip(rows.column("g").to_pylist(), (p >> np.uint64(2) for p in parts))]
    out = [(g, _pack(x)) for g, x in out if len(x)]
    return pa.table({"g": pa.array([g for g, _ in out], pa.int32()), "data": pa.array([x for _, x in out], pa.binary())})


def _extend(width: int, n_ranges: int):
    def run(rows: pa.Table, lists: pa.Table) -> pa.Table:
        schema = pa.schema([("r", pa.int32()), ("g", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary()), ("ids", pa.binary()), ("many", pa.binary())])
        if not rows.num_rows or not lists.num_rows:
            return schema.empty_table()
        group = _Group(rows, width)
        near = group.near(np.sort(np.concatenate([_unpack(x) for x in lists.column("data").to_pylist()])))
        starts, key, check = group.keys()
        picked = near[starts]
        key, check, ids = key[picked], check[picked], group.ids[group.doc[starts[picked]]]
        order = np.lexsort((ids, check, key))
        key, check, ids = key[order], check[order], ids[order]
        if not len(key):
            return schema.empty_table()
        new = np.flatnonzero(np.concatenate(([True], (np.diff(key) != 0) | (np.diff(check) != 0))))
        last = np.append(new[1:], len(key)) - 1
        key, check, ids, many = key[new], check[new], ids[new], (ids[last] > ids[new]).astype(np.uint8)
        spans, own = _ranges(key, 64, n_ranges), rows.column("g")[0].as_py()
        columns = ([i for i, _ in spans], [own] * len(spans), *([_planes(np.ascontiguousarray(x[s])) for _, s in spans] for x in (key, check, ids, many)))
        release_memory()
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _first_ids(rows: pa.Table) -> pa.Table:
    parts = [[_from_planes(x, kind) for x in rows.column(name).to_pylist()] for name, kind in (("keys", "<u8"), ("checks", "<u4"), ("ids", "<i8"), ("many", "|u1"))]
    key, check, ids, many = (np.concatenate(p) for p in parts)
    part = np.repeat(np.arange(len(parts[0])), [len(x) for x in parts[0]])
    order = np.lexsort((ids, check, key))
    new = np.concatenate(([True], (np.diff(key[order]) != 0) | (np.diff(check[order]) != 0)))
    least = np.empty_like(ids)
    least[order] = ids[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    tell = (many > 0) | (ids > least)
    gs, out = rows.column("g").to_pylist(), []
    for i, g in enumerate(gs):
        lo, hi = np.searchsorted(part, (i, i + 1))
        at = lo + np.flatnonzero(tell[lo:hi])
        if len(at):
            out.append((g, *(_planes(np.ascontiguousarray(x[at])) for x in (key, check, least))))
    return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate((("g", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary()), ("ids", pa.binary())))})


def _remove(width: int):
    def run(rows: pa.Table, lists: pa.Table) -> pa.Table:
        group = _Group(rows, width)
        gone = np.zeros(len(group.hashes), dtype=bool)
        if lists.num_rows and rows.num_rows:
            key, check, least = (np.concatenate([_from_planes(x, kind) for x in lists.column(name).to_pylist()]) for name, kind in (("keys", "<u8"), ("checks", "<u4"), ("ids", "<i8")))
            order = np.lexsort((check, key))
            pairs = np.empty(len(key), dtype=[("k", "<u8"), ("c", "<u4")])
            pairs["k"], pairs["c"] = key[order], check[order]
            least = least[order]
            starts, mine, mine_check = group.keys()
            some = np.flatnonzero(_in_order(mine, pairs["k"]))
            at = np.searchsorted(pairs["k"], mine[some])
            hit = np.zeros(len(starts), dtype=bool)
            while len(some):  # windows whose key is right but whose check is not try the next pair of that key
                same = pairs["c"][at] == mine_check[some]
                hit[some[same]] = least[at[same]] < group.ids[group.doc[starts[some[same]]]]
                some, at = some[~same], at[~same] + 1
                on = (at < len(pairs)) & (pairs["k"][np.minimum(at, len(pairs) - 1)] == mine[some])
                some, at = some[on], at[on]
            edge = np.zeros(len(group.hashes) + 1, dtype=np.int32)
            edge[starts[hit]] += 1
            np.add.at(edge, starts[hit] + width, -1)
            gone = np.cumsum(edge)[:-1] > 0
        kept, n_removed = [], []
        for i, text in enumerate(group.texts):
            cut = gone[group.first[i] : group.first[i + 1]]
            n_removed.append(int(cut.sum()))
            words = text.split()
            kept.append(b" ".join(words if not n_removed[-1] else [words[j] for j in np.flatnonzero(~cut)]).decode("utf-8", "replace"))
        n_words = np.diff(group.first).astype(np.int64)
        release_memory()
        return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    return run


def without_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of ``docs`` (doc_id, text).

    A word goes if a window of ``width`` words (even) that covers it starts,
    word for word, in a document with a smaller doc_id as well. ``kept`` holds
    the other words, joined by one space. Null and empty texts have no words
    and give "". Rows that share a doc_id don't remove from each other; a null
    doc_id counts as larger than all. Repeated rows stay; other columns are
    ignored; an empty table gives none. Words are bytes: unchanged, with case.
    """
    if width % 2:
        raise ValueError("the width is even: anchors are half a window")
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_groups, n_ranges = 1 + max(size // GROUP_BYTES, n // GROUP_DOCS), 1 + size // (6 * RANGE_WORDS)
    group = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups)).cast("int")
    texts = texts.withColumn("g", group)
    probes = texts.groupBy("g").applyInArrow(_probe(width, n_ranges), "r int, g int, data binary")
    hot = probes.groupBy("r").applyInArrow(_hot, "g int, data binary")
    found = texts.groupBy("g").cogroup(hot.groupBy("g")).applyInArrow(_extend(width, n_ranges), "r int, g int, keys binary, checks binary, ids binary, many binary")
    first = found.groupBy("r").applyInArrow(_first_ids, "g int, keys binary, checks binary, ids binary")
    return texts.groupBy("g").cogroup(first.groupBy("g")).applyInArrow(_remove(width), "doc_id long, n_words long, n_removed long, kept string")


def repeats_removed(docs: DataFrame, width: int = 50) -> DataFrame:
    """The report of :func:`without_repeats`, with the SHA-256 of what is kept in its place."""
    return without_repeats(docs, width).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
