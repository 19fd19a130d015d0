"""Sharding along a Hilbert curve: rows that are near in several dimensions at once lie in the same shard.

Each dimension is cut into cells that hold about as many rows each, by the
counts of its distinct values: a value that very many rows share takes as much
room on the curve as it has rows. A row's cells give its place on the curve,
which runs through all cells so that neighbours on it are neighbours in space.
Rows are sorted by that place, and runs of the order are the shards, so each
covers a small box of all dimensions: a filter on any of them leaves most shards
unread (:func:`read_within`).

The curve is walked by a table: which corner a sub-cube is entered at and which
way it is left make a state, and the table gives, for a state and the halves
that a point lies in, the number of the sub-cube and its state. Sorting is by
range partitions, and rows are numbered in them: no row order passes through one
task. What the driver sees is bounded by the number of cells and of shards.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.scratch import row_hash, shared_path, written

SHARDS, BITS = 24, 6
#: Rows in a range of the sort, about.
RANGE_ROWS = 1 << 18
_LAWS = ("rows", "bytes")


def curve(dims: int) -> tuple[list[int], list[int]]:
    """(number, next state) by state * 2^dims + halves: the Hilbert curve of so many dimensions.

    A state is the corner that a sub-cube is entered at and the dimension along
    which it is left (corner * dims + dimension); bit j of ``halves`` tells
    which half in dimension j a point lies in. The states that follow the first
    are worked out by reflecting and turning the binary reflected Gray code.
    """
    size = 1 << dims
    turn = lambda b, by: ((b >> by % dims) | (b << (dims - by % dims))) & (size - 1)
    gray = lambda i: i ^ (i >> 1)
    place = {gray(i): i for i in range(size)}
    flips = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  the dimension in which the code's places i and i + 1 differ
    number, after = [], []
    for state in range(size * dims):
        corner, leave = divmod(state, dims)
        for halves in range(size):
            w = place[turn(halves ^ corner, leave + 1)]
            enter = gray(2 * ((w - 1) // 2)) if w else 0
            way = 0 if w == 0 else flips(w - 1) if w % 2 == 0 else flips(w)
            number.append(w)
            after.append((corner ^ turn(enter, dims - (leave + 1) % dims)) * dims + (leave + way % dims + 1) % dims)
    return number, after


def curve_index(cells: list[Column], bits: int) -> Column:
    """The place on the curve of a point with the given cells (0 to 2^bits - 1 each)."""
    number, after = (F.array(*map(F.lit, t)) for t in curve(len(cells)))
    n = len(cells)

    def step(acc: Column, level: Column, point: Column) -> Column:
        halves = reduce(lambda a, b: a + b, ((F.call_function("shiftright", point[f"c{j}"], level).bitwiseAND(1) * (1 << j)) for j in range(n)))
        at = acc["state"] * (1 << n) + halves + 1
        return F.struct(F.element_at(after, at.cast("int")).alias("state"), (acc["index"] * (1 << n) + F.element_at(number, at.cast("int"))).alias("index"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))
    point = F.struct(*(c.cast("int").alias(f"c{j}") for j, c in enumerate(cells)))
    # An array of one, so that the cells are worked out once and not at each level.
    return F.transform(F.array(point), lambda p: F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, lambda a, level: step(a, level, p))["index"])[0]


def _sort_key(rows: DataFrame, dim: str) -> tuple[Column, Column]:
    """A dimension as a number or a string, the other null."""
    string = dict(rows.dtypes)[dim] == "string"
    return (F.lit(None).cast("double"), F.col(f"`{dim}`")) if string else (F.col(f"`{dim}`").cast("double"), F.lit(None).cast("string"))


def quantised(rows: DataFrame, dims: list[str], bits: int = BITS) -> list[Column]:
    """For each of ``dims`` (columns of numbers or strings) the cell of a row's value, 0 to 2^bits - 1; nulls come last.

    A value's cell is the share of the rows that have a smaller one, times the
    number of cells, rounded down. Values are counted, and their counts summed
    up in range partitions; the first value of each cell goes to the driver.
    """
    keys = F.array(*(F.struct(F.lit(d).alias("d"), F.isnull(f"`{c}`").alias("missing"), *(x.alias(n) for x, n in zip(_sort_key(rows, c), ("num", "str")))) for d, c in enumerate(dims)))
    values = rows.select(F.explode(keys).alias("v")).groupBy("v").agg(F.count("*").alias("n")).select("v.*", "n")
    order = ["d", "missing", "num", "str"]
    values = written(values.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "values")
    part = F.shiftright("at", 33)
    sums = values.groupBy(part.alias("part"), "d").agg(F.sum("n").alias("s"))
    upto = lambda by, order: F.sum("s" if order == "part" else "n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = sums.select("part", "d", (upto(["d"], "part") - F.col("s")).alias("far"), F.sum("s").over(Window.partitionBy("d")).alias("total"))
    placed = values.withColumn("part", part).withColumn("near", upto(["part", "d"], "at") - F.col("n")).join(sums, ["part", "d"])
    cell = F.expr(f"((far + near) * {1 << bits}) div total")
    first = placed.withColumn("cell", cell).groupBy("d", "cell").agg(F.min(F.struct("missing", "num", "str")).alias("v")).collect()
    out = []
    for d, c in enumerate(dims):
        own = sorted(((r["cell"], r["v"]["num"] if r["v"]["str"] is None else r["v"]["str"]) for r in first if r["d"] == d and not r["v"]["missing"]), key=lambda x: x[0])
        last = max((r["cell"] for r in first if r["d"] == d), default=0)
        key = _sort_key(rows, c)[dict(rows.dtypes)[c] == "string"]
        at = F.size(F.filter(F.array(*(F.lit(v) for _, v in own)), lambda b: b <= key)) if own else F.lit(0)
        number = F.element_at(F.array(*(F.lit(int(k)) for k, _ in own)), at) if own else F.lit(last)
        out.append(F.when(F.isnull(f"`{c}`"), F.lit(int(last))).otherwise(number))
    return out


def arranged(rows: DataFrame, dims: list[str], order: list[str], shards: int = SHARDS, law: str = "rows", size: str | None = None, bits: int = BITS) -> DataFrame:
    """``rows`` with shard (int) and slot (long, from 0 in each shard): runs of the order along the curve of ``dims``.

    Rows in one place of the curve are ordered by ``order``, and beyond that by
    a hash of the whole row; equal rows are alike. By the law ``rows`` the
    shards' counts are one apart at most; by ``bytes`` a shard holds the rows whose middle, in the running sum of the
    column ``size``, lies in its share of the total. Fewer rows than shards
    leave some shards empty; an empty table gives no rows.
    """
    if law not in _LAWS or law == "bytes" and size is None:
        raise ValueError(f"law is one of {_LAWS}; bytes needs a size")
    rows = written(rows, "rows")
    cells = quantised(rows, dims, bits)
    keys = rows.select(F.struct("*").alias("row"), curve_index(cells, bits).alias("_curve"), row_hash(rows.schema).alias("_hash"))
    by = ["_curve", *(F.col("row").getField(c).asc_nulls_last() for c in order), "_hash"]
    n_ranges = 1 + rows.count() // RANGE_ROWS
    sorted_rows = keys.repartitionByRange(n_ranges, *by).sortWithinPartitions(*by).select("row", F.monotonically_increasing_id().alias("at"))
    placed = written(sorted_rows, "sorted")
    # The number's upper bits are the range, its lower 33 the row's place in the range.
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.coalesce(F.col("row").getField(size).cast("long"), F.lit(0)) if law == "bytes" else F.lit(1)
    sums = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(weight).alias("s"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each range
    every = Window.partitionBy()
    sums = sums.select("part", (F.sum("n").over(upto) - F.col("n")).alias("rows_before"), (F.sum("s").over(upto) - F.col("s")).alias("before"), F.sum("n").over(every).alias("n_rows"), F.sum("s").over(every).alias("total"))
    numbered = placed.withColumns({"part": part, "within": within}).join(sums, "part").withColumn("rank", F.col("rows_before") + F.col("within"))
    if law == "rows":
        shard = F.expr(f"cast((rank * {shards}) div n_rows as int)")
    else:
        own = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        numbered = numbered.withColumn("w", weight).withColumn("middle", 2 * (F.col("before") + F.sum("w").over(own)) - F.col("w"))
        shard = F.when(F.col("total") > 0, F.least(F.lit(shards - 1), F.expr(f"cast((middle * {shards}) div (2 * total) as int)"))).otherwise(0)
    numbered = written(numbered.select("row", "rank", shard.alias("shard")), "numbered")
    first = numbered.groupBy("shard").agg(F.min("rank").alias("first"))
    kept = [F.col("row").getField(c).alias(c) for c in rows.columns]
    return numbered.join(first, "shard").select(*kept, "shard", (F.col("rank") - F.col("first")).alias("slot"))


def sharded(docs: DataFrame, shards: int = SHARDS, law: str = "rows", text: bool = False) -> DataFrame:
    """(doc_id, source, lang, size, text_crc32, shard, slot) of every row of ``docs`` (doc_id, text, source, lang); with ``text`` its text too.

    The dimensions are source, lang and size, the text's UTF-8 bytes (null:
    none) plus 8. In one place of the curve rows lie by text_crc32, the
    unsigned checksum of the text (null: of none), then doc_id, nulls last, so
    equal texts of one source lie side by side. Null sources and langs are
    values of their own, the last; repeated rows stay; other columns are ignored.
    """
    text_bytes = F.coalesce("text", F.lit("")).cast("binary")
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), (F.octet_length(text_bytes).cast("long") + 8).alias("size"), F.crc32(text_bytes).alias("text_crc32")]
    return arranged(docs.select(*columns, *["text"] * text), ["source", "lang", "size"], ["text_crc32", "doc_id"], shards, law, "size")


def write_shards(rows: DataFrame, path: str, dims: list[str]) -> None:
    """Write ``rows`` (of :func:`arranged`) to ``path``/files, a folder for each shard, in the order of slots, and to ``path``/manifest each shard's extremes in ``dims``."""
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(f"{path}/files")
    extremes = [x for d in dims for x in (F.min(f"`{d}`").alias(f"min_{d}"), F.max(f"`{d}`").alias(f"max_{d}"))]
    rows.sparkSession.read.parquet(f"{path}/files").groupBy("shard").agg(F.count("*").alias("rows"), *extremes).write.parquet(f"{path}/manifest")


def read_within(spark: SparkSession, path: str, **limits: tuple) -> tuple[DataFrame, list[int]]:
    """The rows under ``path`` whose columns lie in ``limits`` (name: (least, greatest)), and the shards that are read for it."""
    fits = reduce(lambda a, b: a & b, ((F.col(f"max_{d}") >= low) & (F.col(f"min_{d}") <= high) for d, (low, high) in limits.items()), F.lit(True))
    shards = sorted(r["shard"] for r in spark.read.parquet(f"{path}/manifest").where(fits).select("shard").collect())
    rows = spark.read.parquet(f"{path}/files").where(F.col("shard").isin(shards))
    return reduce(lambda df, x: df.where(F.col(x[0]).between(*x[1])), limits.items(), rows), shards


def stored(docs: DataFrame, shards: int = SHARDS, law: str = "rows") -> str:
    """Write whole ``docs`` as shards in the shared folder; where."""
    write_shards(sharded(docs, shards, law, text=True), path := shared_path(docs.sparkSession, "shards"), ["source", "lang", "size"])
    return path


def _oracle() -> str:
    number, after = curve(3)
    # The checksum's table, from its rule: what zlib makes of each byte, less the two inversions.
    crcs = [zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)]
    step = lambda k: f"""
h{k} AS (SELECT * EXCLUDE (state, curve, halves, a, b), a[state * 8 + halves + 1] AS state, curve * 8 + b[state * 8 + halves + 1] AS curve FROM (
  SELECT *, ((c0 >> {k}) & 1) + ((c1 >> {k}) & 1) * 2 + ((c2 >> {k}) & 1) * 4 AS halves FROM h{k + 1}), t)"""  # noqa: E731
    cells = ", ".join(f"((rank() OVER (ORDER BY {c} NULLS LAST) - 1) * {1 << BITS} // count(*) OVER ())::BIGINT AS c{j}" for j, c in enumerate(("source", "lang", "size")))
    return f"""
WITH t AS (SELECT {after} AS a, {number} AS b),
docs AS (
  SELECT doc_id, source, lang, strlen(coalesce(text, '')) + 8 AS size, row_number() OVER () AS r,
         xor(4294967295, list_reduce(list_concat([4294967295], [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]),
             lambda c, x: xor(c >> 8, {crcs}[(xor(c, x) & 255) + 1]))) AS text_crc32
  FROM documents),
h{BITS} AS (SELECT *, 0::BIGINT AS state, 0::BIGINT AS curve, {cells} FROM docs),{",".join(step(k) for k in reversed(range(BITS)))},
ranked AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, doc_id NULLS LAST, r) - 1 AS rank, count(*) OVER () AS n FROM h0),
cut AS (SELECT *, (rank * {SHARDS} // n)::INTEGER AS shard FROM ranked)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard, (rank - min(rank) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""


#: Rows equal in place, checksum and doc_id are in any order.
ORACLE_SQL = _oracle()
