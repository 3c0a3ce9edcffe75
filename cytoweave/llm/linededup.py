r"""Line dedup by a suffix array over line-ID sequences, in DataFrame operations only.

Lines are the characters of long "texts": each document is a sequence of line
IDs.  Prefix doubling ranks all suffixes by their first 1, 2, 4, ... lines: the
rank of a group of equal prefixes is the number of suffixes before it, found by a
distributed prefix sum over the sorted groups.  A group is an interval of the
suffix array whose longest common prefixes are at least that long.  Suffixes
whose prefix is unique drop out, so later rounds touch repeated runs only.

A run is worth deleting from ``min_words`` words on.  For each line the shortest
such run that starts or ends with it is looked up: its interval is named by the
ranks of its first and its last 2^j lines.  Where the interval holds an earlier
occurrence, the run is a later copy.  Every line with words of a longer repeated
run lies in such a run, so together they cover what the maximal repeated runs
cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, join_hot, let, materialise, word_count

#: Words of a repeated run from which on later copies are deleted.
MIN_WORDS = 50
_KEY = ("_d", "_h")
_LAST = (1 << 63) - 1
#: Ranges of the line IDs' order: 2^12 by their first bits; ranks of one range: 2^16.
_RANGE_BITS, _NEXT_BITS = 12, 16


def _keys(docs: DataFrame) -> list[Column]:
    """Order of the documents: doc_id (null last), then a hash of the text."""
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)).alias("_d"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("_h")]


def _prefix_sum(groups: DataFrame, within: list[str], order: list[str], bucket: Column) -> DataFrame:
    """Adds ``_before``: the sum of ``size`` of the groups sorted before each one of its ``within``.

    ``bucket`` rises with the order and deals it over ranges; ranges are summed
    first, so the running sum inside one range is all that a task orders.
    """
    dealt = groups.withColumn("_range", bucket)
    totals = dealt.groupBy(*within, "_range").agg(F.sum("size").alias("_total"))
    running = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*within, "_range", F.coalesce(F.sum("_total").over(running), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*within, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, [*within, "_range"])
    return summed.withColumn("_before", F.col("_start") + F.col("_in")).drop("_range", "_start", "_in")


def _repeated_lines(docs: DataFrame) -> DataFrame:
    """(_d, _h, i, words, name) of the lines that occur more than once; name: rank by line ID."""
    line = F.col("l.line")
    given = docs.select(*_keys(docs), F.posexplode(F.split(docs["text"].cast("string"), "\n", -1)).alias("i", "line"))
    lines = given.select(*_KEY, "i", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), word_count(F.col("line")).alias("words"))
    groups = lines.groupBy("h1", "h2").agg(F.count("*").alias("size")).filter("size > 1")
    ranked = materialise(_prefix_sum(groups, [], ["h1", "h2"], F.shiftright("h1", 64 - _RANGE_BITS)).select("h1", "h2", "size", F.col("_before").alias("name")), "names")
    return join_hot(lines, ranked, ["h1", "h2"], "size").select(*_KEY, "i", "words", "name").dropDuplicates([*_KEY, "i"])


def _double(names: DataFrame, step: int) -> DataFrame:
    """Names of runs of 2 * step lines from names of runs of step lines; unique ones and those cut off drop out."""
    ahead = Window.partitionBy(*_KEY, "seg").orderBy("i").rangeBetween(step, step)
    paired = names.withColumn("_next", F.first("name").over(ahead)).filter("_next is not null")
    groups = paired.groupBy("name", "_next").agg(F.count("*").alias("size")).filter("size > 1")
    # the suffixes of a group have the ranks from its name on; its parts follow by their next ranks
    ranked = _prefix_sum(groups, ["name"], ["_next"], F.shiftright("_next", _NEXT_BITS))
    ranked = materialise(ranked.select("name", "_next", "size", (F.col("name") + F.col("_before")).alias("_new")), "ranked")
    return join_hot(paired, ranked, ["name", "_next"], "size").select(*_KEY, "seg", "i", F.col("_new").alias("name"))


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(_d, _h, a, b): the shortest runs of repeated lines with ``min_words`` words from each start and to each end."""
    doc = Window.partitionBy(*_KEY, "seg").orderBy("i")
    summed = lines.withColumn("_to", F.sum("words").over(doc.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_from", F.col("_to") - F.col("words"))

    def nearest(start: Column, end: Column, forward: bool) -> DataFrame:
        # starts and ends are sorted together; each asks for the last other one
        events = summed.select(*_KEY, "seg", "i", "words", F.explode(F.array(F.struct(F.lit(0).alias("kind"), start.alias("v")), F.struct(F.lit(1).alias("kind"), end.alias("v")))).alias("e")).select(*_KEY, "seg", "i", "words", "e.kind", "e.v")
        if forward:
            order, seen = Window.partitionBy(*_KEY, "seg").orderBy(F.desc("v"), F.desc("kind"), F.desc("i")), F.when(F.col("kind") == 1, F.col("i"))
        else:
            order, seen = Window.partitionBy(*_KEY, "seg").orderBy("v", "kind", "i"), F.when(F.col("kind") == 0, F.col("i"))
        met = events.withColumn("_other", F.last(seen, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        asks = met.filter((F.col("kind") == (0 if forward else 1)) & F.col("_other").isNotNull() & (F.col("words") > 0))
        a, b = ("i", "_other") if forward else ("_other", "i")
        return asks.select(*_KEY, F.col(a).alias("a"), F.col(b).alias("b"))

    ahead = nearest(F.col("_from") + min_words, F.col("_to"), True)
    back = nearest(F.col("_from"), F.col("_to") - min_words, False)
    return ahead.union(back).distinct()


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_d, _h, runs): the maximal runs (a, b) of lines of each document that are later copies."""
    lines = _repeated_lines(docs)
    doc = Window.partitionBy(*_KEY).orderBy("i")
    lines = materialise(lines.withColumn("seg", F.col("i") - F.row_number().over(doc)), "lines")
    windows = materialise(_windows(lines, min_words).withColumn("n", F.col("b") - F.col("a") + 1).withColumn("level", F.floor(F.log2(F.col("n") + F.lit(0.5))).cast("int")), "windows")
    deepest = windows.agg(F.max("level")).first()[0]
    names = lines.select(*_KEY, "seg", "i", "name")
    named = None
    for level in range((-1 if deepest is None else deepest) + 1):
        if level:
            names = materialise(_double(names, 1 << (level - 1)), "names")
        here = windows.filter(F.col("level") == level)
        head = names.select(*_KEY, F.col("i").alias("a"), F.col("name").alias("first"))
        tail = names.select(*_KEY, (F.col("i") + (1 << level) - 1).alias("b"), F.col("name").alias("last"))
        found = materialise(here.join(head, [*_KEY, "a"]).join(tail, [*_KEY, "b"]).select(*_KEY, "a", "b", "n", "first", "last"), "named")
        named = found if named is None else named.union(found)
    if named is None:
        named = windows.select(*_KEY, "a", "b", "n", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"))
    place = F.struct(*_KEY, "a")
    intervals = named.groupBy("n", "first", "last").agg(F.min(place).alias("earliest"), F.count("*").alias("_size")).filter("_size > 1")
    later = join_hot(named, materialise(intervals, "intervals"), ["n", "first", "last"], "_size").filter(place > F.col("earliest")).select(*_KEY, "a", "b")
    order = Window.partitionBy(*_KEY).orderBy("a", "b")
    fresh = F.coalesce((F.col("a") > F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(0))
    runs = later.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(order)).groupBy(*_KEY, "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return runs.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs``, text without later copies, and ``n_lines``, ``n_deleted``, ``runs``.

    Lines end at line feeds.  A run of consecutive lines with ``min_words`` words
    or more that starts and ends with a line that has words, and occurs at an
    earlier start (documents by doc_id, null last, then by a hash of the text;
    then by line), is deleted; of overlapping occurrences the first stays.
    Maximal deleted runs are in ``runs`` as first-last line numbers from 0.
    Blank lines go only inside a run that is not longer than it must be, seen from
    its start or its end.  A text of which all lines are later
    copies becomes empty; null texts stay null with 0 lines; the empty text has
    one empty line.  Repeated rows (same doc_id and text) count as one document
    and get the same result.  Columns of ``docs`` that bear a name of the result
    are replaced.  An empty table gives no rows.
    """
    found = repeated_runs(docs, min_words)
    kd, kh, own = free_name(docs, "_d", "_h", "_runs")
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(_keys(docs), (kd, kh), strict=True)])
    met = keyed.join(found.toDF(kd, kh, own), [kd, kh], "left")
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    gone = F.flatten(F.transform(own, lambda r: F.sequence(r["a"], r["b"])))
    rest = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone)
    kept = let(lines, lambda ls: F.array_join(F.transform(rest(ls), lambda i: F.get(ls, i)), "\n"))
    deleted = F.coalesce(F.aggregate(own, F.lit(0), lambda s, r: s + (r["b"] - r["a"] + 1)), F.lit(0))
    text = F.when(F.col(own).isNull(), F.col("text")).otherwise(kept)
    shown = F.coalesce(F.array_join(F.transform(own, lambda r: F.concat_ws("-", r["a"].cast("string"), r["b"].cast("string"))), ","), F.lit(""))
    made = ("text", "n_lines", "n_deleted", "runs")
    others = [F.col(c) for c in docs.columns if c.lower() not in made]
    return met.select(*others, text.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), deleted.cast("long").alias("n_deleted"), shown.alias("runs"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS t FROM w),
f AS (SELECT a.doc_id, a.i AS a, min(b.i) AS b FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.t >= a.t - a.words + 50 WHERE a.words > 0 GROUP BY ALL
      UNION
      SELECT b.doc_id, max(a.i) AS a, b.i AS b FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.t >= a.t - a.words + 50 WHERE b.words > 0 GROUP BY b.doc_id, b.i),
s AS (SELECT f.doc_id, f.a, f.b, md5(string_agg(c.line, chr(10) ORDER BY c.i)) AS body FROM f JOIN c ON f.doc_id = c.doc_id AND c.i BETWEEN f.a AND f.b GROUP BY ALL),
e AS (SELECT *, min({'d': doc_id, 'a': a}) OVER (PARTITION BY body, b - a) AS earliest FROM s),
x AS (SELECT DISTINCT e.doc_id, c.i FROM e JOIN c ON e.doc_id = c.doc_id AND c.i BETWEEN e.a AND e.b WHERE {'d': e.doc_id, 'a': e.a} > e.earliest),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS text FROM l ANTI JOIN x ON l.doc_id = x.doc_id AND l.i = x.i GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1)
SELECT d.doc_id, coalesce(k.text, '') AS text, len(ls)::BIGINT AS n_lines, coalesce(n.n, 0)::BIGINT AS n_deleted
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
