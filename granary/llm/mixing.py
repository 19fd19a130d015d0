"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled by a hash and cut, as one stream of
words, into blocks of equal size; a source that gives more than it has is read
again from its start. The schedule is a row of slots. Each source owns an
interval of slot numbers as wide as its target; the van der Corput sequence
(bit-reversed counting) visits the numbers so that any stretch of it holds
every source in about its share. The k-th visit to a source takes its k-th
block, so schedule and blocks meet in an equi-join.

Running sums, over a source's documents or its slots, are taken in three steps:
within hash ranges of bounded size, over the sums of some thousand neighbouring
ranges, and over the sums of these. So no source, however large, is one group of
rows: at 10^12 rows of one source the last step has some 60,000.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.scratch import row_hash, written
from granary.llm.words import WORD

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 256
#: Rows that share a range in a running sum, about.
RANGE_ROWS = 2048
#: Ranges whose sums share a second range: 2 to this power.
_WIDE_BITS = 13
_HASH_BITS = 60


def _range_bits(rows: int) -> int:
    return max(0, (rows // RANGE_ROWS).bit_length())


def shuffle_hash(doc_id: Column, seed: int) -> Column:
    """60 bits of the MD5 of seed and doc_id: the order in which a source's documents are taken."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")).cast("binary")), 1, _HASH_BITS // 4), 16, 10).cast("long")


def _running(rows: DataFrame, order: list[str], value: str, into: str) -> DataFrame:
    """Add ``into``: the sum of ``value`` over the rows of the same sid before this one, by (part, *order); and rn, the row's number in its (sid, part)."""
    inner = Window.partitionBy("sid", "part").orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy("sid", "part").agg(F.sum(value).alias("s")).withColumn("wide", F.shiftright("part", _WIDE_BITS))
    wide = sums.groupBy("sid", "wide").agg(F.sum("s").alias("s"))
    upto_before = lambda by, order: F.sum("s").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("s")
    wide = wide.select("sid", "wide", upto_before(["sid"], "wide").alias("far"))
    starts = sums.select("sid", "wide", "part", upto_before(["sid", "wide"], "part").alias("near")).join(wide.hint("merge"), ["sid", "wide"])
    starts = starts.select("sid", "part", (F.col("far") + F.col("near")).alias("before"))
    within = rows.withColumns({"rn": F.row_number().over(inner), "within": F.sum(value).over(upto) - F.col(value)})
    # Spark guesses exploded rows to be as few as those they come from, and would broadcast them: merge instead.
    return within.join(starts.hint("merge"), ["sid", "part"]).withColumn(into, F.col("before") + F.col("within")).drop("before", "within")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, sid, source_size, target double, quota long, first_slot, slots) per source of ``sized`` (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn. A
    target is the source's weight times one level for all, or ``most`` times
    its size where that is less; the level is the one at which the targets add
    up to all sizes. In order of the level at which sources are full, it is
    the first that those sources don't exceed; sources that are full at one
    level go together. Sources are numbered in range partitions: of the windows one runs over the
    ranges, one over the distinct levels, the others over sums of some thousand sources.
    """
    order = F.col("source").asc_nulls_last()
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # Upper bits: the range; the lower 33: the place in it.
    ranked = written(sums.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    before = lambda value, by, *within: F.sum(value).over(Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value)
    ranges = ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", before("n", "part").alias("first"))
    each = ranked.withColumn("part", part).join(ranges, "part").withColumn("sid", F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    each = each.withColumn("w", w).withColumns({"cap": most * F.col("source_size"), "full_at": most * F.col("source_size") / F.col("w")}).select("source", "sid", "source_size", "w", "cap", "full_at")
    each = written(each, "weights")
    everything, all_w = each.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    full = each.groupBy("full_at").agg(F.sum("cap").alias("cap"), F.sum("w").alias("w"))
    level = (F.lit(everything) - before("cap", "full_at")) / (F.lit(all_w) - before("w", "full_at"))
    found = full.withColumn("level", level).where(F.col("level") <= F.col("full_at")).agg(F.min_by("level", "full_at")).first()[0]
    common = F.lit(found).cast("double")
    each = each.withColumn("target", F.least(F.col("cap").cast("double"), common * F.col("w"))).withColumn("quota", F.floor(F.col("target") + 0.5))
    each = each.withColumn("slots", F.ceil(F.col("quota") / BLOCK_WORDS)).withColumn("wide", F.shiftright("sid", _WIDE_BITS))
    wide = each.groupBy("wide").agg(F.sum("slots").alias("n")).select("wide", before("n", "wide").alias("far"))
    placed = each.withColumn("near", before("slots", "sid", "wide")).join(wide, "wide")
    return placed.select("source", "sid", "source_size", "target", "quota", (F.col("far") + F.col("near")).alias("first_slot"), "slots")


def schedule(sources: DataFrame) -> DataFrame:
    """(turn, sid, k, words): slot ``turn`` takes the first ``words`` words of block ``k`` of source ``sid``.

    Turns are the bit-reversed slot numbers; numbers past the last slot are
    turns that nobody takes.
    """
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    bits = max(1, int(total - 1).bit_length()) if total else 1
    chunks = sources.where("slots > 0").select("sid", "quota", "first_slot", "slots", F.explode(F.expr(f"sequence(0L, (slots - 1) div {RANGE_ROWS})")).alias("c"))
    chunks = chunks.repartition("sid", "c")
    slot = F.explode(F.expr(f"sequence(first_slot + c * {RANGE_ROWS}, first_slot + least(slots, (c + 1) * {RANGE_ROWS}) - 1)"))
    slots = chunks.select("sid", "quota", slot.alias("slot"))
    turn = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("long")
    slots = slots.select("sid", "quota", turn.alias("turn"), F.lit(1).alias("one")).withColumn("part", F.shiftright("turn", max(0, bits - _range_bits(total))))
    ranked = _running(slots, ["turn"], "one", "k")
    return ranked.select("turn", "sid", "k", F.least(F.lit(BLOCK_WORDS), F.col("quota") - F.col("k") * BLOCK_WORDS).alias("words"))


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, source, size), and ``more`` columns, of every row; a null text has size 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size(), *more)


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")


def pieces(rows: DataFrame, sources: DataFrame, seed: int, order: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``rows`` (doc_id, source, size, and any others) with its place in its source's stream, once for each block that holds words of it.

    Adds part and rn, which with sid name the row; k and words, the block and
    how many of the row's words it holds (null for a row that gives none).
    ``order`` names columns that put rows of one doc_id and size in order.
    """
    bits = _range_bits(rows.count())
    named = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = named.withColumn("h", shuffle_hash(F.col("doc_id"), seed)).withColumn("part", F.shiftright("h", _HASH_BITS - bits))
    placed = _running(placed, ["h", "doc_id", "size", *order], "size", "off")
    blocks = F.expr(f"""
        flatten(transform(
            filter(transform(sequence(0, {MOST_REPEATS - 1}), c -> c * source_size + off), x -> size > 0 AND x < quota),
            x -> transform(
                sequence(x div {BLOCK_WORDS}, (least(x + size, quota) - 1) div {BLOCK_WORDS}),
                k -> struct(k AS k, least(x + size, quota, (k + 1) * {BLOCK_WORDS}) - greatest(x, k * {BLOCK_WORDS}) AS words))))""")
    kept = [c for c in placed.columns if c not in ("h", "off", "quota", "first_slot", "slots")]
    return placed.select(*kept, F.explode_outer(blocks).alias("b")).select(*kept, F.col("b.k").alias("k"), F.col("b.words").alias("words"))


def mixed(docs: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The schedule filled with documents, and what each document gives.

    First: (turn, sid, k, doc_id, words) for the turns in order, ``words`` the
    words that the document gives in that turn. Second: (doc_id, size,
    source_size, target, taken) for every row of ``docs`` (doc_id, text,
    source), ``taken`` with repeats counted. A source's taken words add up to
    its rounded target. Null sources are one source; null and empty texts and
    null ids take part with their size; repeated rows each do; an empty table
    gives no rows; other columns are ignored. Reruns agree.
    """
    filled = _filled(written(sized(docs), "sizes"), seed)
    taken = filled.groupBy("sid", "part", "rn", "doc_id", "size", "source_size", "target").agg(_taken())
    return (
        filled.where(F.col("turn").isNotNull()).select("turn", "sid", "k", "doc_id", "words"),
        taken.select("doc_id", "size", "source_size", "target", "taken"),
    )


def _filled(rows: DataFrame, seed: int, order: tuple[str, ...] = ()) -> DataFrame:
    """:func:`pieces` of ``rows`` with the turn that takes each, null if none does."""
    sources = written(targets(rows), "targets")
    slots = schedule(sources).withColumnRenamed("words", "room")
    return pieces(rows, sources, seed, order).join(slots.hint("merge"), ["sid", "k"], "left")


def _taken() -> Column:
    return F.coalesce(F.sum(F.when(F.col("turn").isNotNull(), F.col("words"))), F.lit(0)).alias("taken")


def mix_rows(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of the mix: every row of ``docs``, all columns, as often as its taken words fill it, rounded to the nearest whole.

    A mix takes most documents whole, none, or whole several times; only the
    one at which a source's target is reached is cut, and rounded here.
    """
    # Each row has a number in a written table, so that no id, null or repeated, is a key that rows share.
    rows = written(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("n")), "numbered")
    plain = rows.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), F.col("row.text").alias("text"), "n", row_hash(docs.schema, "row").alias("by"))
    sizes = written(sized(plain, "n", "by"), "sizes")
    times = _filled(sizes, seed, ("by",)).groupBy("n", "size").agg(_taken())
    times = times.where("taken > 0").select("n", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("times")).where("times > 0")
    return rows.join(times, "n").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")


ORACLE_SQL = f"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM sums),
weighed AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM ranked),
capped AS (SELECT *, {MOST_REPEATS} * source_size AS cap, {MOST_REPEATS} * source_size / w::DOUBLE AS full_at FROM weighed),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
  FROM capped WINDOW before AS (ORDER BY full_at, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (SELECT level AS common FROM levels WHERE level <= full_at ORDER BY full_at, sid LIMIT 1),
goals AS (SELECT source, source_size, least(cap::DOUBLE, common * w) AS target FROM levels, found),
placed AS (SELECT d.doc_id, d.size, g.source_size, g.target, floor(g.target + 0.5)::BIGINT AS quota,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS off
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE quota // source_size * size + greatest(0, least(size, quota % source_size - off)) END::BIGINT AS taken
FROM placed
"""
