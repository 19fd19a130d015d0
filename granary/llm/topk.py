"""Exact top-k search by inner product, after MaxScore.

A vector's dimensions are its terms, its integer components their impacts. A
shard holds some of the vectors in chunks, one array per dimension. Per query
and chunk each dimension has an upper bound of what it can add to a score
there. By falling bound, the terms before the border are essential: the border
lies where the bounds that remain no longer add up to the score to beat, the
query's k-th best so far. Essential arrays are traversed for all vectors of a
chunk; the others are probed a few at a time, only for vectors whose score so
far plus the bounds that remain reaches the score to beat, which is raised on
the way by finishing the best. As it rises from chunk to chunk, the border moves
forward. A query's k best of each shard are merged.

Vectors are held as packs: some thousand rows of integers of two, four or eight
bytes in one value. Blocks of queries and shards of packs meet in an equi-join
of their numbers, so that memory depends on neither's count and nothing passes
through the driver; every vector is moved once for each block of 65,536 queries,
and every query once for each shard. That is done in two rounds: a sixteenth of
the shards gives each query a score to beat, with which it enters all the
others; they return only what reaches it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.scratch import bound_batches, map_batches, release_memory, written

SCALE = 256
#: Queries in a block, vectors in a shard and in a pack (entries in it at most, but for a single longer vector), and terms probed at a time.
QUERY_BLOCK, SHARD_ROWS, PACK, PACK_ENTRIES, PROBE = 1 << 16, 1 << 16, 2048, 1 << 18, 8
#: Of so many shards one is searched first. Fewer groups of a block and a shard than so many for each core are more, smaller ones.
SAMPLE, SPREAD = 16, 3


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component as double. Rows with a null id, a null or empty vector, or a component that is null or not finite are left out."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: c)
    bad = F.exists("x", lambda c: F.isnull(c) | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & (F.size("x") > 0)).where(~bad)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows; a shorter one lacks its last terms, which add nothing."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), dims), dtype=np.int64)
    out[np.arange(dims) < lengths[:, None]] = values
    return out


def _longest(column: pa.ListArray) -> int:
    return int(np.diff(column.offsets.to_numpy()).max(initial=0))


class Chunk:
    """Vectors by dimension, with each dimension's extremes."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.terms = ids, np.ascontiguousarray(rows.T)
        self.high, self.low = self.terms.max(axis=1), self.terms.min(axis=1)
        self.most = int(np.abs(self.terms).max(initial=0)) * len(self.terms)
        self.floats = self.terms.astype(np.float64)


def _k_th(scores: np.ndarray, k: int):
    return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else None


def border(left: np.ndarray, floor) -> int:
    """How many terms are essential: ``left`` is what the terms from each place on can add, ``floor`` the score to beat, None if there is none."""
    return len(left) - 1 if floor is None else max(1, int(np.argmax(left < floor))) if left[-1] < floor else len(left) - 1


class Shard:
    """Chunks of vectors, (ids, rows) each, that are searched in turn."""

    def __init__(self, chunks: Iterable[tuple[np.ndarray, np.ndarray]]):
        self.chunks = [Chunk(ids, rows) for ids, rows in chunks]
        #: Components read by all searches so far.
        self.read = 0

    def best(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors but those with the id ``own``; all that tie with the last are considered, smaller ids first. Only scores from ``floor`` on."""
        ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for chunk in self.chunks:
            more, found = self._search(chunk, query, own, k, floor)
            ids, scores = np.concatenate((ids, more)), np.concatenate((scores, found))
            first = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[first], scores[first]
            if len(scores) == k and (floor is None or scores[-1] > floor):
                floor = int(scores[-1])
        reach = slice(None) if floor is None else scores >= floor
        return ids[reach], scores[reach]

    def _search(self, chunk: Chunk, query: np.ndarray, own: int, k: int, floor) -> tuple[np.ndarray, np.ndarray]:
        n = min(len(query), len(chunk.terms))
        # Sums below 2^53 are exact as doubles, whose products are much faster.
        terms, weight = (chunk.floats, query[:n].astype(np.float64)) if chunk.most * int(np.abs(query).max(initial=0)) < 1 << 53 else (chunk.terms, query[:n])
        bounds = np.maximum(weight * chunk.high[:n], weight * chunk.low[:n])
        order = np.argsort(-bounds, kind="stable")
        left = np.concatenate((np.cumsum(bounds[order][::-1])[::-1], [0]))
        alive = np.flatnonzero(chunk.ids != own)

        def raised(places: np.ndarray, floor):
            exact = _k_th(weight @ terms[:n, places], k)
            self.read += n * len(places)
            return floor if exact is None or floor is not None and floor >= exact else exact

        if floor is None and n and len(alive) > k:  # the k vectors that the term of the highest bound favours
            favoured = weight[order[0]] * terms[order[0], alive]
            floor = raised(alive[np.argpartition(-favoured, k - 1)[:k]], None)
        at = border(left, floor)
        scores = (weight[order[:at]] @ terms[order[:at]])[alive] if at else np.zeros(len(alive), dtype=terms.dtype)
        self.read += at * len(chunk.ids)
        while at < n and len(alive):
            if len(alive) > k:
                floor = raised(alive[np.argpartition(-scores, k - 1)[:k]], floor)
            if floor is not None:
                keep = scores + left[at] >= floor
                alive, scores = alive[keep], scores[keep]
            probe = order[at : at + PROBE]
            scores = scores + weight[probe] @ terms[np.ix_(probe, alive)]
            self.read += len(probe) * len(alive)
            at += PROBE
        first = np.lexsort((chunk.ids[alive], -scores))[:k]
        return chunk.ids[alive[first]], scores[first].astype(np.int64)


def packed(vectors: DataFrame) -> DataFrame:
    """(pack, n, dims, width, ids, rows) of ``vectors`` (vec_id, v array<long>): packs of neighbouring rows as a table in the shared folder.

    ``rows`` holds n times dims integers of ``width`` bytes, the fewest that all of the pack fit into; a
    shorter vector is filled up with zeros.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                size = PACK
                while size > 1 and size * _longest(batch.column(1).slice(at, size)) > PACK_ENTRIES:
                    size //= 2
                part = batch.slice(at, size)
                rows = _matrix(part.column(1), _longest(part.column(1)))
                most = int(np.abs(rows).max(initial=0))
                width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
                ids = part.column(0).to_numpy().astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part.num_rows, pa.int32()), (rows.shape[1], pa.int32()), (width, pa.int32()), (ids, pa.binary()), (rows.astype(f"<i{width}").tobytes(), pa.binary()))], ["n", "dims", "width", "ids", "rows"])
                at += size

    packs = map_batches(vectors.select("vec_id", "v"), run, "n int, dims int, width int, ids binary, rows binary")
    return written(packs.withColumn("pack", F.monotonically_increasing_id()), "packs")


def _unpacked(pack: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(pack["ids"], "<i8"), np.frombuffer(pack["rows"], f"<i{pack['width']}").reshape(pack["n"], pack["dims"]).astype(np.int64)


def _met(asked: DataFrame, packs: DataFrame, n_blocks: int, shards: range, k: int) -> DataFrame:
    """(pack, i, query_id, vec_id, score): of each of ``shards`` (of packs, column s) the k best of row i of each pack of ``asked`` (column b, and floors), from its score to beat on."""
    dealt = lambda df, n: df.withColumn("b" if "s" in df.columns else "s", F.explode(F.sequence(F.lit(n.start), F.lit(n.stop - 1)))).groupBy("b", "s")

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        names, out = ["pack", "i", "query_id", "vec_id", "score"], []
        if rows.num_rows:
            shard = Shard(map(_unpacked, rows.select(["n", "dims", "width", "ids", "rows"]).to_pylist()))
            for pack in asked.to_pylist():
                ids, queries = _unpacked(pack)
                floors = dict((f["i"], f["score"]) for f in pack["floors"] or ())
                for i, (own, query) in enumerate(zip(ids, queries)):
                    found, scores = shard.best(query, own, k, floors.get(i))
                    if len(found):
                        out.append((np.full(len(found), pack["pack"]), np.full(len(found), i), np.full(len(found), own), found, scores))
        release_memory()
        columns = [np.concatenate(c) for c in zip(*out)] or [np.zeros(0, dtype=np.int64)] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names)

    return dealt(asked, shards).cogroup(dealt(packs, range(n_blocks))).applyInArrow(run, "pack long, i long, query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """``found`` with rank, of each query the k first. A query's rows are some for each shard: first those of each of a few salts of them, then of these."""
    salted = Window.partitionBy("pack", "i", F.pmod(F.xxhash64("vec_id"), F.lit(8))).orderBy(F.desc("score"), "vec_id")
    few = found.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k).drop("r")
    rank = F.row_number().over(Window.partitionBy("pack", "i").orderBy(F.desc("score"), "vec_id"))
    return few.withColumn("rank", rank).where(F.col("rank") <= k)


def candidates(vectors: DataFrame, queries: DataFrame, k: int, query_block: int = QUERY_BLOCK, shard_rows: int | None = None) -> DataFrame:
    """(pack, i, query_id, vec_id, score): for each query, a row i of a pack, vectors of which its k best are some."""
    spark = vectors.sparkSession
    bound_batches(spark)
    packs, asked = packed(vectors), packed(queries)
    n, m = (df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (packs, asked))
    n_blocks = max(1, -(-m // query_block))
    if shard_rows is None:
        shard_rows = min(SHARD_ROWS, max(PACK, -(-n * n_blocks // (SPREAD * spark.sparkContext.defaultParallelism))))
    n_shards = max(1, -(-n // shard_rows))
    number = lambda df, name, n: df.withColumn(name, F.pmod(F.xxhash64("pack"), F.lit(n)).cast("int"))
    packs, asked = number(packs, "s", n_shards), number(asked, "b", n_blocks)
    none = F.lit(None).cast("array<struct<i: bigint, score: bigint>>")
    first = -(-n_shards // SAMPLE) if n_shards > 1 else 0
    if not first:
        return _met(asked.withColumn("floors", none), packs, n_blocks, range(n_shards), k)
    found = written(_met(asked.withColumn("floors", none), packs.where(F.col("s") < first), n_blocks, range(first), k), "first")
    floors = _ranked(found, k).where(F.col("rank") == k).groupBy("pack").agg(F.collect_list(F.struct("i", "score")).alias("floors"))
    more = _met(asked.join(floors, "pack", "left"), packs.where(F.col("s") >= first), n_blocks, range(first, n_shards), k)
    return found.unionByName(more)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, shard_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``k`` best of ``vectors``, by inner product, ties to the smaller vec_id.

    Both are (vec_id, v array<long>), of :func:`integers`; candidates
    with the query's own id are left out. Fewer candidates give fewer rows;
    empty tables none. A shorter vector counts as filled up with zeros.
    Repeated queries give repeated rows, repeated vectors take a rank each,
    whatever share of the rows they are: shards are cut by pack.
    """
    return _ranked(candidates(vectors, queries, k, query_block, shard_rows), k).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """:func:`top_k` over ``embeddings`` (vec_id, embedding) for the rows whose vec_id ``every`` divides. Other columns are ignored."""
    vectors = integers(embeddings)
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
