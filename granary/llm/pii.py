"""Personal data: base patterns, and identifiers that bootstrapped contexts discover.

Seeds are what the base patterns find. The words about a seed are
lexical patterns: the one or two before it, the one after it, and one on either
side. A pattern's instances are all identifier-like words that stand in it
anywhere in the corpus. Patterns and instances form a bipartite graph, scored
in rounds: a pattern by the sum of its instances' scores over their number,
drawn towards zero while they are few; an unlabelled instance, if it has the
kind's shape, by the best of its patterns. From the second round on such
instances are seeds as well, and the patterns about them take part. Patterns
that end above a threshold, with enough different seeds, mark what else stands
in them: spans that no base pattern finds.

All of it is DataFrame operations, linear in a text's matches. Positions come
from cutting a text at a pattern: the pieces between the matches and the
matches alternate, so the running sum of their lengths is where each match
stands. Words meet the base spans in them by a running maximum over one text's
matches in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.scratch import written

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Quantifiers are possessive where a match never needs them to give back, a match that
# can only begin a run of its characters says so, and a card has its least number of digits: the same matches that count,
# in time linear in the text and without deep recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its kind's pattern to be tried.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: An address that is spelled out: name at host dot com, name[at]host[dot]com.
SPELLED = r"[A-Za-z0-9._%+-]++(?:\x20(?i:at)\x20|\x20?+[(\[](?i:at)[)\]]\x20?+)[A-Za-z0-9-]++(?:(?:\x20(?i:dot)\x20|\x20?+[(\[](?i:dot)[)\]]\x20?+)[A-Za-z0-9-]++)++"
#: Identifier-like words: those that hold a digit, an at sign or a plus, with the short groups of digits that follow; and addresses spelled out.
INSTANCE = r"(?<![^\x20\x09-\x0D])" + SPELLED + r"|(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@+]*+[0-9@+][^\x20\x09-\x0D]*+(?:\x20[(]?+[0-9]{1,5}+[)]?+(?:-[0-9]{1,5}+)*+[^\x20\x09-\x0DA-Za-z0-9@+-]*+(?![^\x20\x09-\x0D]))*+"
#: What a discovered word must look like, by kind, after punctuation around it is taken off.
SHAPES = {
    "email": rf"^(?:[^@]++@[^@]++|{SPELLED})$",
    "ip": r"^[0-9A-Fa-f]*+(?:[.:][0-9A-Fa-f]*+){3,7}+$",
    "card": r"^(?:[^0-9A-Za-z]*+[0-9]){12,19}+[^0-9A-Za-z]*+$",
    "phone": r"^[+(]?+(?:[^0-9A-Za-z]*+[0-9]){7,15}+$",
}
_WORD = len(KINDS)
_OPENING, _CLOSING_REVERSED = r"^[^\p{L}\p{N}+(@]*+", r"^[^\p{L}\p{N}]*+"
_NEXT_WORDS = r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++)(?:[\x20\x09-\x0D]++([^\x20\x09-\x0D]++))?+"
#: Stands for a neighbour where the next thing is another identifier, or the text's edge.
_NO_WORD = "#"
_PAIRS = "array<struct<kind: int, match: string, skip: int, contexts: array<string>>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a non-empty string of digits passes Luhn's check."""
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(back)), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return F.when(F.length(_digits(match)) <= 19, luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def contexts_of(left: Column, right: Column) -> Column:
    """The lexical patterns about a word, from all the text between it and its identifier-like neighbours."""
    back = F.reverse(F.lower(left))
    near, far = (F.reverse(F.regexp_extract(back, _NEXT_WORDS, k)) for k in (1, 2))
    after = F.regexp_extract(F.lower(right), _NEXT_WORDS, 1)
    two = F.concat(F.coalesce(F.nullif(near, F.lit("")), F.lit(_NO_WORD)), F.lit(" _ "), F.coalesce(F.nullif(after, F.lit("")), F.lit(_NO_WORD)))
    every = F.array(
        F.when(near != "", F.concat(near, F.lit(" _"))),
        F.when(far != "", F.concat(far, F.lit(" "), near, F.lit(" _"))),
        F.when(after != "", F.concat(F.lit("_ "), after)),
        F.when((near != "") | (after != ""), two),
    )
    return F.filter(every, lambda c: c.isNotNull())


def _pairs(kind: int, matches: Column, pieces: Column) -> Column:
    """(kind, match, skip, contexts) of ``matches``, all of a pattern's in a text that it cuts into ``pieces``: skip is how far a match stands from the end of the one before."""

    def pair(match: Column, gap: Column, contexts: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), match.alias("match"), F.length(gap).alias("skip"), contexts.alias("contexts"))

    before = F.slice(pieces, 1, F.size(matches))
    if kind != _WORD:
        found = F.zip_with(matches, before, lambda m, g: pair(m, g, F.lit(None).cast("array<string>")))
    else:
        about = F.zip_with(before, F.slice(pieces, 2, F.size(matches)), lambda g, h: F.struct(g.alias("gap"), contexts_of(g, h).alias("contexts")))
        found = F.zip_with(matches, about, lambda m, x: pair(m, x["gap"], x["contexts"]))
    return F.when(F.size(matches) > 0, found).otherwise(F.expr(f"cast(array() as {_PAIRS})"))


def found(docs: DataFrame) -> DataFrame:
    """(row, doc_id, pairs): per row of ``docs`` all matches of the base patterns and, as the last kind, its identifier-like words."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    none = F.expr("cast(array() as array<string>)")
    every = {**PATTERNS, "word": INSTANCE}
    matches = {k: F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in every.items()}
    matches = {k: F.when(F.contains("text", F.lit(HINTS[k])), m).otherwise(none) if HINTS.get(k) else m for k, m in matches.items()}
    texts = texts.withColumns(matches)
    texts = texts.withColumns({f"{k}_pieces": F.when(F.size(k) > 0, F.split("text", p, -1)) for k, p in every.items()})
    kinds = range(_WORD + 1)
    return texts.select("row", "doc_id", F.concat(*(_pairs(i, F.col(k), F.col(f"{k}_pieces")) for i, k in zip(kinds, every))).alias("pairs"))


def located(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end, match, contexts) per match of :func:`found`; in code points. A running sum over one text's matches of a kind."""
    order = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = rows.select("row", F.posexplode("pairs").alias("pos", "p")).select("row", "pos", "p.*")
    end = F.sum(F.col("skip") + F.length("match")).over(order).cast("int")
    return each.withColumn("end", end).select("row", "kind", (F.col("end") - F.length("match")).alias("start"), "end", "match", "contexts")


def base_spans(places: DataFrame) -> DataFrame:
    """(row, kind, start, end, match): the matches of the base patterns that count."""
    valid = F.coalesce(*(F.when(F.col("kind") == i, _valid(k, F.col("match"))) for i, k in enumerate(PATTERNS)), F.lit(False))
    return places.where(F.col("kind") < _WORD).where(valid).select("row", "kind", "start", "end", "match")


def occurrences(places: DataFrame, base: DataFrame) -> DataFrame:
    """(row, start, end, word, kind, contexts) per identifier-like word: trimmed of punctuation; where a base span begins in it, the first such span's text and kind; else null. Words that begin inside a base span are left out."""
    words = places.where(F.col("kind") == _WORD).select("row", "start", F.col("match").alias("word"), "contexts")
    lead, trail = F.length(F.regexp_extract("word", _OPENING, 0)), F.length(F.regexp_extract(F.reverse("word"), _CLOSING_REVERSED, 0))
    size = F.greatest(F.length("word") - lead - trail, F.lit(0))
    words = words.select("row", (F.col("start") + lead).alias("start"), (F.col("start") + lead + size).alias("end"), F.substring("word", lead + 1, size).alias("word"), "contexts", F.lit(None).cast("int").alias("kind"))
    both = words.where("word != ''").unionByName(base.select("row", "start", "end", F.col("match").alias("word"), F.lit(None).cast("array<string>").alias("contexts"), "kind"))
    order = Window.partitionBy("row").orderBy("start", F.col("kind").asc_nulls_first())
    upto, earlier = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    a_word = F.col("kind").isNull()
    # Words don't overlap, so the greatest start and end so far are those of the last one.
    placed = both.withColumns({"reach": F.max(F.when(~a_word, F.col("end"))).over(earlier), "at": F.max(F.when(a_word, F.col("start"))).over(upto), "to": F.max(F.when(a_word, F.col("end"))).over(upto)})
    kept = placed.where(a_word & (F.coalesce("reach", F.lit(0)) <= F.col("start"))).select("row", "at", "start", "end", "word", "contexts")
    # Picked by number: an aggregate would copy what it holds, a long word perhaps, at each of a word's many spans.
    inner = placed.where(~a_word & (F.col("start") < F.col("to"))).withColumn("n", F.row_number().over(Window.partitionBy("row", "at").orderBy("start", "kind")))
    inner = inner.where("n = 1").select("row", "at", F.col("kind").alias("of"), F.col("word").alias("span"))
    return kept.join(inner, ["row", "at"], "left").select("row", "start", "end", F.coalesce("span", "word").alias("word"), F.col("of").alias("kind"), F.array_distinct("contexts").alias("contexts"))


def _fits(kind: Column, word: Column) -> Column:
    return F.coalesce(*(F.when(kind == i, word.rlike(SHAPES[k])) for i, k in enumerate(KINDS)), F.lit(False))


def patterns(seen: DataFrame, rounds: int = 3, least_score: float = 0.7, least_seeds: int = 5, doubt: float = 1.0) -> DataFrame:
    """(context, kind, score): the trusted patterns, by rounds of scoring over the graph of contexts and words.

    ``doubt`` is added to a pattern's number of instances. The graph holds
    each pair of a context and a word once, so a passage that is copied many
    times counts once. A word that is a seed of one kind counts against the
    patterns of the others.
    """
    graph = written(seen.select("word", "kind", F.explode("contexts").alias("context")).groupBy("context", "word").agg(F.max("kind").alias("own")), "graph")
    sizes = written(graph.groupBy("context").agg(F.count("*").alias("n")), "contexts")
    seeds = graph.where(F.col("own").isNotNull()).select("context", "word", F.col("own").alias("kind"), F.lit(1.0).alias("s"))
    instances, scored = seeds, None
    for turn in range(rounds):
        if scored is not None:
            open_words = graph.where(F.col("own").isNull()).select("context", "word")
            likely = open_words.join(scored, "context").where(_fits(F.col("kind"), F.col("word"))).groupBy("word", "kind").agg(F.max("score").alias("s"))
            instances = seeds.unionByName(open_words.join(written(likely, f"instances{turn}"), "word").select("context", "word", "kind", "s"))
        each = instances.groupBy("context", "kind").agg(F.sum("s").alias("s"), F.sum((F.col("s") >= least_score).cast("long")).alias("seeds"))
        scored = each.join(sizes, "context").select("context", "kind", F.round(F.col("s") / (F.col("n") + doubt), 9).alias("score"), "seeds").where("seeds > 0")
        scored = written(scored, f"patterns{turn}")
    return scored.where((F.col("score") >= least_score) & (F.col("seeds") >= least_seeds)).select("context", "kind", "score")


def discovered(seen: DataFrame, trusted: DataFrame) -> DataFrame:
    """(row, kind, start, end): words that no base span begins in, that look like their kind and stand in a trusted pattern; of several kinds the best scored."""
    new = seen.where(F.col("kind").isNull()).select("row", "start", "end", "word", F.explode("contexts").alias("context"))
    marked = new.join(trusted, "context").where(_fits(F.col("kind"), F.col("word")))
    return marked.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for every row of ``docs`` (doc_id, text); both are arrays of (kind, start, end).

    kind numbers :data:`KINDS`; places are code points, end exclusive. Order
    is by kind, then start. ``base`` holds the base patterns' spans, ``spans``
    these and the discovered ones. Whole texts are read; null and empty texts
    have no spans; null ids and repeated rows stay; an empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    rows = written(found(docs), "found")
    places = written(located(rows), "places")
    base = written(base_spans(places), "base")
    seen = written(occurrences(places, base), "words")
    listed = lambda df, name: df.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias(name))
    more = discovered(seen, patterns(seen))
    every = reduce(lambda a, b: a.join(b, "row", "left"), (rows.select("row", "doc_id"), listed(base, "base"), listed(more, "more")))
    none = F.expr("cast(array() as array<struct<kind: int, start: int, end: int>>)")
    plain = F.coalesce("base", none)
    return every.select("doc_id", plain.alias("base"), F.array_sort(F.concat(plain, F.coalesce("more", none))).alias("spans"))


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(i: int, kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{kind}")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the base spans, and all spans as text."""
    counts = [_count(i, k) for i, k in enumerate(PATTERNS)]
    return personal_data(docs).select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
