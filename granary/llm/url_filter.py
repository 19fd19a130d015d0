"""URL filter: stated rules, and templates of paths learnt from what the rules decide.

Every host has a tree of path templates, as deep as its paths branch. Digits in
a segment are generalised at once; a segment whose place, under the same host
and parent, has many different values that hardly repeat becomes a wildcard,
which values without labels share with those that have some. Labelled branches
under one parent whose share of blocked pages doesn't differ significantly from
that of all of them are merged. A branch's purity is its merged blocked share,
smoothed towards its parent's purity; the host's is smoothed towards the mean of
all labelled hosts' shares, in which a host with very many pages counts once. A
template is rejected when its purity is high and it, or a branch above it, was
merged from labelled pages: a host's or the corpus' share alone rejects nothing.

Pages are counted into distinct templates first, so the tree is built on the
counts; a host with a third of all pages is a few rows of them. It grows level
by level, as long as different templates share a branch: one that is alone
below its branch has no branches of its own, however long its path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.scratch import written

#: (host, path, verdict): a rule fits its host and all subdomains, if the path starts with the rule's.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: A variable place has so many values at least, each on fewer pages than so many on average.
MANY, REPEATS = 10, 3
#: Standard errors within which branches are merged; weight of the parent's purity; purity from which a template is rejected.
SIMILAR, SMOOTH, REJECT = 2.0, 5.0, 0.8

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (up to ``?`` or ``#``); both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER), F.regexp_extract(url, pattern, 2)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = F.concat(F.lit("."), host).endswith("." + h) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The path's segments that aren't empty, digits generalised."""
    clean = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "[0-9]+", "#")
    return F.filter(F.split(clean, "/"), lambda s: s != "")


def branches(counts: DataFrame) -> DataFrame:
    """(host, segs, purity, known) of ``counts`` (host, segs, n, blocked, labelled): each distinct template's purity, and whether a branch on its way below the host holds labels, similar siblings' included."""
    sums = lambda b, l: (F.sum("b").alias(b), F.sum("l").alias(l))
    # Counts are doubles from here on: their products outgrow a long.
    leaves = counts.select("host", "segs", "n", F.col("blocked").cast("double").alias("b"), F.col("labelled").cast("double").alias("l"))
    hosts = leaves.groupBy("host").agg(*sums("b0", "l0"))
    overall = hosts.where("l0 > 0").agg(F.coalesce(F.round(F.avg(F.col("b0") / F.col("l0")), 6), F.lit(0.0))).first()[0]
    shares = hosts.select("host", ((F.col("b0") + SMOOTH * F.lit(overall)) / (F.col("l0") + SMOOTH)).alias("purity"))
    # parent: the branch that a template has been followed to, as host/segment/segment
    rows = written(leaves.join(shares, "host").withColumns({"parent": F.col("host"), "known": F.lit(False)}), "level0")
    done, level = [], 0
    b, l, pb, pl = (F.col(c) for c in ("b", "l", "pb", "pl"))
    while not rows.isEmpty():
        level += 1
        family = rows.groupBy("parent").agg(F.count("*").alias("members"))
        segment = F.when(F.col("members") > 1, F.coalesce(F.get("segs", F.lit(level - 1)), F.lit(""))).otherwise("")
        placed = rows.join(family, "parent").withColumn("s", segment).drop("members")
        values = placed.where("s <> ''").groupBy("parent", "s").agg(F.sum("n").alias("n"))
        wild = values.groupBy("parent").agg(F.count("*").alias("v"), F.sum("n").alias("n")).where((F.col("v") >= MANY) & (F.col("n") < REPEATS * F.col("v"))).select("parent", F.lit(True).alias("wild"))
        template = F.when((F.col("s") != "") & F.coalesce("wild", F.lit(False)), "*").otherwise(F.col("s"))
        placed = written(placed.join(wild, "parent", "left").withColumn("t", template).drop("wild", "s"), f"level{level}")
        done.append(placed.where("t = ''").select("host", "segs", "purity", "known"))
        node = placed.where("t <> ''").groupBy("parent", "t").agg(*sums("b", "l"))
        node = node.join(node.groupBy("parent").agg(*sums("pb", "pl")), "parent")
        # |b/l - pb/pl| <= z * sqrt(pb/pl * (1 - pb/pl) / l), squared and without divisions
        off = b * pl - pb * l
        node = node.withColumn("same", (l > 0) & (off * off <= SIMILAR * SIMILAR * pb * (pl - pb) * l))
        node = node.join(node.where("same").groupBy("parent").agg(*sums("mb", "ml")), "parent", "left")
        own = lambda merged, c: F.when(F.col("same"), F.col(merged)).otherwise(F.col(c))
        node = node.select("parent", "t", own("mb", "b").alias("nb"), own("ml", "l").alias("nl"))
        purity = (F.col("nb") + SMOOTH * F.col("purity")) / (F.col("nl") + SMOOTH)
        followed = placed.where("t <> ''").join(node, ["parent", "t"])
        rows = written(followed.select("host", "segs", "n", "b", "l", F.concat("parent", F.lit("/"), "t").alias("parent"), purity.alias("purity"), (F.col("known") | (F.col("nl") > 0)).alias("known")), f"level{level}")
    return reduce(DataFrame.unionByName, done, rows.select("host", "segs", "purity", "known"))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, purity) for every row of ``pages`` (page_id, url).

    rule is the longest that fits (null: none). verdict is its verdict, else
    block where the page's template is rejected, else allow; purity is the
    template's. Urls of any length are judged whole. A null url, or one without ``://``, has an empty host and path
    and is judged as any other template. Null ids and repeated rows stay;
    other columns are ignored; an empty table gives no rows.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, decided = ruled(F.col("host"), F.col("path"), rules)
    rows = written(rows.select("page_id", "host", "path", rule.alias("rule"), decided.alias("decided"), segments(F.col("path")).alias("segs")), "urls")
    labelled = F.col("decided").isNotNull().cast("long")
    blocked = F.coalesce(F.col("decided") == "block", F.lit(False)).cast("long")
    counts = written(rows.groupBy("host", "segs").agg(F.count("*").alias("n"), F.sum(blocked).alias("blocked"), F.sum(labelled).alias("labelled")), "counts")
    verdict = F.coalesce("decided", F.when(F.col("known") & (F.col("purity") >= REJECT), "block").otherwise("allow"))
    return rows.join(branches(counts), ["host", "segs"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "purity")


def _oracle(levels: int = 8) -> str:
    """The SQL, for templates that branch in ``levels`` levels at most."""
    fits = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    when = lambda what: " ".join(f"WHEN ends_with('.' || host, '.{h}') AND starts_with(path, '{p}') THEN '{h + p if what == 'rule' else v}'" for h, p, v in fits)
    sql = rf"""
WITH split AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
urls AS (SELECT *, CASE {when('rule')} END AS rule, CASE {when('verdict')} END AS decided,
  list_filter(string_split(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '[0-9]+', '#', 'g'), '/'), lambda x: x <> '') AS segs FROM split),
leaves AS (SELECT host, segs, count(*) AS n, sum((decided = 'block' AND decided IS NOT NULL)::BIGINT)::DOUBLE AS b, count(decided)::DOUBLE AS l FROM urls GROUP BY ALL),
hosts AS (SELECT host, sum(b) AS b0, sum(l) AS l0 FROM leaves GROUP BY ALL),
overall AS (SELECT coalesce(round(avg(b0 / l0) FILTER (WHERE l0 > 0), 6), 0) AS share FROM hosts),
p0 AS (SELECT leaves.*, host AS parent, (b0 + {SMOOTH} * share) / (l0 + {SMOOTH}) AS purity, FALSE AS known FROM leaves JOIN hosts USING (host), overall)"""
    for k in range(1, levels + 1):
        sql += f""",
s{k} AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY parent) > 1 THEN coalesce(segs[{k}], '') ELSE '' END AS s FROM p{k - 1}),
w{k} AS (SELECT parent FROM (SELECT parent, s, sum(n) AS n FROM s{k} WHERE s <> '' GROUP BY ALL) GROUP BY ALL HAVING count(*) >= {MANY} AND sum(n) < {REPEATS} * count(*)),
t{k} AS (SELECT *, CASE WHEN s <> '' AND parent IN (SELECT parent FROM w{k}) THEN '*' ELSE s END AS t FROM s{k}),
n{k} AS (SELECT *, l > 0 AND (b * pl - pb * l) * (b * pl - pb * l) <= {SIMILAR * SIMILAR} * pb * (pl - pb) * l AS same FROM (
  SELECT *, sum(b) OVER w AS pb, sum(l) OVER w AS pl FROM (SELECT parent, t, sum(b) AS b, sum(l) AS l FROM t{k} WHERE t <> '' GROUP BY ALL) WINDOW w AS (PARTITION BY parent))),
m{k} AS (SELECT parent, t, CASE WHEN same THEN sum(b) FILTER (WHERE same) OVER w ELSE b END AS nb, CASE WHEN same THEN sum(l) FILTER (WHERE same) OVER w ELSE l END AS nl FROM n{k} WINDOW w AS (PARTITION BY parent)),
p{k} AS (SELECT host, segs, n, b, l, parent || '/' || t AS parent, (nb + {SMOOTH} * purity) / (nl + {SMOOTH}) AS purity, known OR nl > 0 AS known FROM t{k} JOIN m{k} USING (parent, t))"""
    every = " UNION ALL ".join([*(f"SELECT host, segs, purity, known FROM t{k} WHERE t = ''" for k in range(1, levels + 1)), f"SELECT host, segs, purity, known FROM p{levels}"])
    return sql + f""",
branch AS ({every})
SELECT u.page_id, u.host, u.path, u.rule, coalesce(u.decided, CASE WHEN known AND purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict
FROM urls u LEFT JOIN branch b ON u.host = b.host AND u.segs = b.segs
"""


ORACLE_SQL = _oracle()
