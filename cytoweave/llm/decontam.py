"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a text with at most e edits, cut into e + 1 pieces,
has at least one piece that occurs unchanged.  So all pieces of all items are
searched at once (Aho-Corasick), and each hit's surroundings are verified with
Myers' bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edits allowed for each character of an item.
ERROR_RATE = 0.05
#: Characters of items that one pass over the documents takes along, about.
BLOCK_CHARS = 4_000_000


def normalise(text: str | None) -> str:
    """Lower case, white space runs to one space."""
    return " ".join((text or "").lower().split())


def error_budget(item: str, rate: float = ERROR_RATE) -> int:
    return int(len(item) * rate)


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget`` + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers_distance(pattern: str, text: str) -> int:
    """Smallest edit distance of ``pattern`` to any substring of ``text``."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for k, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best = score
    return best


class Matcher:
    """Items of one block, ready to be searched."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = ERROR_RATE):
        self.items = [(i, n, error_budget(n, rate)) for i, t in items if (n := normalise(t))]
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item, budget) in enumerate(self.items):
            for at, piece in pieces(item, budget):
                places.setdefault(piece, []).append((k, at))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str | None) -> dict[int | None, int]:
        """Distance of each item that occurs within its budget."""
        shown = normalise(text)
        if not self.items or not shown:
            return {}
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.automaton.iter(shown):
            for k, at in where:
                _, item, budget = self.items[k]
                start = end + 1 - size - at
                windows.setdefault(k, []).append((max(0, start - budget), start + len(item) + budget))
        out: dict[int | None, int] = {}
        for k, ranges in windows.items():
            name, item, budget = self.items[k]
            best, reach = budget + 1, None
            for lo, hi in sorted(set(ranges)):
                if reach is not None and lo <= reach[1] and hi - reach[0] <= 2 * (len(item) + 2 * budget):
                    reach = (reach[0], max(hi, reach[1]))
                    continue
                if reach is not None:
                    best = min(best, self._verify(item, shown[reach[0] : reach[1]]))
                    if best == 0:
                        break
                reach = (lo, hi)
            if best and reach is not None:
                best = min(best, self._verify(item, shown[reach[0] : reach[1]]))
            if best <= budget:
                out[name] = min(best, out.get(name, best))
        return out

    @staticmethod
    def _verify(item: str, window: str) -> int:
        return 0 if item in window else myers_distance(item, window)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about BLOCK_CHARS characters, so that each can be sent to all tasks."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(total) // BLOCK_CHARS + 1
    for k in range(n):
        yield [(r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def _hits(docs: DataFrame, text: Column, items: list[tuple[int | None, str]], rate: float) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    @F.pandas_udf("array<struct<item_id:bigint,distance:int>>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value, rate)
        for batch in batches:
            yield pd.Series([[{"item_id": i, "distance": d} for i, d in matcher.find(t).items()] for t in batch])

    return hits(text)


def find_contamination(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, distance) for each item that occurs in a text within its error budget.

    The budget of an item is ``rate`` times its length in normalised characters
    (lower case, white space runs as one space), rounded down.  Whole texts are
    searched.  Null and empty texts hold nothing, null and empty items occur
    nowhere; repeated rows and repeated items give one row with the smallest
    distance; empty tables give no rows; further columns are ignored.
    """
    out = None
    for items in _blocks(benchmark):
        found = docs.select("doc_id", F.explode(_hits(docs, F.col("text"), items, rate)).alias("h")).select("doc_id", "h.item_id", "h.distance")
        out = found if out is None else out.union(found)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The documents in which no item occurs within its error budget; all columns stay."""
    columns = docs.columns
    for items in _blocks(benchmark):
        docs = docs.filter(F.size(_hits(docs, F.col("text"), items, rate)) == 0)
    return docs.select(*columns)


#: Places of the pieces, then the smallest distance of the item to any stretch of the
#: text around them whose length differs by the budget at most.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT DISTINCT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS p FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT item_id, p, length(p) AS m, floor(length(p) * 0.05)::INT AS e FROM b WHERE p <> ''),
c AS (SELECT item_id, p, m, e, k, m * k // (e + 1) AS off, p[m * k // (e + 1) + 1:m * (k + 1) // (e + 1)] AS piece FROM (SELECT *, unnest(range(e + 1)) AS k FROM i)),
h AS (SELECT DISTINCT doc_id, item_id, p, m, e, t, off, piece FROM d JOIN c ON contains(t, piece) WHERE piece <> ''),
s AS (SELECT doc_id, item_id, p, m, e, t, off, unnest(list_filter(range(1, length(t) - length(piece) + 2), lambda x: t[x:x + length(piece) - 1] = piece)) AS pos FROM h),
w AS (SELECT DISTINCT doc_id, item_id, p, m, e, t, pos - off AS s0 FROM s),
z AS (SELECT doc_id, item_id, e, min(levenshtein(p, t[greatest(s0 + a, 1):s0 + b + m - 1])) AS distance FROM w, (SELECT unnest(range(-60, 61)) AS a), (SELECT unnest(range(-60, 61)) AS b)
      WHERE abs(a) <= e AND abs(b) <= e AND abs(b - a) <= e GROUP BY ALL)
SELECT doc_id, item_id, distance::INT AS distance FROM z WHERE distance <= e
"""
