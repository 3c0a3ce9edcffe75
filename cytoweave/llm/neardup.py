"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard links.

Circulant MinHash needs two permutations only.  The first scatters the shingles
of a document; the second, shifted circularly by k, gives coordinate k: the
smallest value of perm2(perm1(x) + k) over the document's shingles.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, join_hot, materialise
from .components import connected_components
from .hashing import U, mix32, mix64, shingle_set, text_bytes, word_hashes

#: Bands of rows: a pair of similarity 0.8 meets in no band with probability
#: (1 - 0.8^4)^24 = 3e-6; at 0.9 it is below 1e-11.
BANDS, ROWS = 24, 4
#: Counters that shingles are tallied in: their order by rarity needs no more.
TALLY_BITS = 18
#: Rows of a shingle that one slice holds, about.
SLICE = 256
_CHUNK = 4096


def _perm1(x: np.ndarray) -> np.ndarray:
    """Shingle hashes scattered over the universe of 2^32 places."""
    return mix32((x >> U(32)).astype(np.uint32) ^ np.uint32(0x5BD1E995))


def circulant_signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` MinHash coordinates from two permutations of 32-bit values."""
    shift = np.arange(1, size + 1, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    placed = _perm1(shingles)
    with np.errstate(over="ignore"):
        for at in range(0, len(placed), _CHUNK):
            np.minimum(out, mix32(placed[None, at : at + _CHUNK] + shift).min(axis=1), out=out)
    return out


def _band_values(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    table = signature.reshape(bands, rows).astype(U)
    h = np.full(bands, rows, U)
    with np.errstate(over="ignore"):
        for k in range(rows):
            h = mix64(h * U(0x9FB21C651E98DF25) + table[:, k])
    return h.view(np.int64)


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, n_shingles, class (digest of the shingle set) and band values."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                found = shingle_set(word_hashes(text_bytes(text)), width)
                digest = hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest() if len(found) else None
                out.append((len(found), digest, _band_values(circulant_signature(found, bands * rows), bands, rows) if len(found) else None))
            made = pd.DataFrame(out, columns=["n_shingles", "class", "bands"])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text_hash": batch["text_hash"], "n_shingles": made["n_shingles"], "class": made["class"], "bands": made["bands"]})

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(F.col("text")).alias("text_hash"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return given.mapInPandas(sign, "doc_id long, text_hash long, n_shingles long, class string, bands array<long>")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _similar(width: int, percent: int):
    """Exact Jaccard of pairs of texts on their full shingle sets."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: OrderedDict[str, np.ndarray] = OrderedDict()

        def of(key: str, text: bytes) -> np.ndarray:
            if key not in kept:
                kept[key] = shingle_set(word_hashes(text_bytes(text)), width)
                if len(kept) > 64:
                    kept.popitem(last=False)
            else:
                kept.move_to_end(key)
            return kept[key]

        for batch in batches:
            linked = []
            for a, b, s, t in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
                x, y = of(a, s), of(b, t)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "linked": linked})

    return confirm


def similar_classes(docs: DataFrame, signed: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between classes of equal shingle sets, enough to connect all that are similar.

    Classes that share a bucket are compared with the bucket's leader first: the
    one that meets most others in all its buckets, which in a group of edited
    copies is the one with fewest edits.  So a group of copies of one text costs
    one comparison a copy.  Of buckets whose classes are then not all connected,
    the classes meet by ``_rare_pairs``, an exact filter, and pairs that it leaves
    are compared by their full sets: every pair of a bucket is compared, ruled out
    or already connected.
    """
    classes = signed.filter("class is not null").groupBy("class").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    placed = classes.select("class", "n", F.posexplode("bands").alias("band", "value"))
    buckets = materialise(placed.groupBy("band", "value").agg(F.count("*").alias("met")).filter("met > 1"), "buckets")
    shared = materialise(join_hot(placed, buckets, ["band", "value"], "met").select("band", "value", "class", "n", "met"), "shared")
    standing = shared.groupBy("class").agg(F.sum("met").alias("standing"))
    leaders = materialise(shared.join(standing, "class").groupBy("band", "value").agg(F.max(F.struct("standing", "class", "n")).alias("leader"), F.count("*").alias("size")), "leaders")
    members = join_hot(shared, leaders, ["band", "value"], "size").select("band", "value", "class", "n", F.col("leader.class").alias("leader"), F.col("leader.n").alias("leader_n"))
    near = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    texts = _class_texts(docs, signed, shared)
    first = members.filter(F.col("class") != F.col("leader")).filter(near(F.col("n"), F.col("leader_n"))).select(*_pair(F.col("class"), F.col("leader"))).distinct()
    compared = materialise(_compare(first, texts, width, percent), "compared")
    joined = connected_components(compared.filter("linked"))
    own = materialise(shared.join(joined, F.col("class") == F.col("node"), "left").select("band", "value", "class", F.coalesce("component", "class").alias("component")), "own")
    parts = own.groupBy("band", "value").agg(F.min("component").alias("_one"), F.max("component").alias("_other"), F.count("*").alias("size")).filter("_one <> _other").select("band", "value", "size")
    apart = join_hot(own, materialise(parts, "parts"), ["band", "value"], "size").select("class", "component").distinct()
    rest = _rare_pairs(materialise(texts.join(apart, "class"), "apart"), width, percent).join(compared.select("a", "b"), ["a", "b"], "left_anti")
    more = materialise(_compare(rest, texts, width, percent), "compared")
    return compared.union(more).filter("linked").select("a", "b")


def _pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _rare_pairs(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): pairs of classes of different components that may be similar; no similar pair is missing.

    texts: (class, component, text).  Shingles have one order, the rarest first
    (by a tally of fixed size over all these texts).  Two similar sets share one
    of the first n - ceil(t n) + 1 shingles of the larger and of the first
    n - ceil(2 t n / (1 + t)) + 1 of the smaller, and the first one that they share
    leaves room for enough others behind it.  A shingle's rows of the component
    that has most of them meet those of other components only, so a group of
    copies that is connected already makes no pair; frequent shingles are cut into
    slices.
    """
    cells = 1 << TALLY_BITS

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(cells, np.int64)
        for batch in batches:
            for text in batch["text"]:
                found = shingle_set(word_hashes(text_bytes(text)), width)
                counts += np.bincount((found >> U(64 - TALLY_BITS)).astype(np.int64), minlength=cells)
        some = np.flatnonzero(counts)
        yield pd.DataFrame({"cell": some, "n": counts[some]})

    rows = texts.select("text").mapInPandas(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(cells, np.int64)
    counts[[r["cell"] for r in rows]] = [r["n"] for r in rows]
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def rarest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, component, text in zip(batch["class"], batch["component"], batch["text"], strict=True):
                found = shingle_set(word_hashes(text_bytes(text)), width)
                n = len(found)
                most, least = n + (-percent * n // 100) + 1, n + (-2 * percent * n // (100 + percent)) + 1
                found = found[np.lexsort((found, shared.value[(found >> U(64 - TALLY_BITS)).astype(np.int64)]))][:most]
                out.append(pd.DataFrame({"token": found.view(np.int64), "class": name, "component": component, "n": n, "at": np.arange(len(found)), "early": np.arange(len(found)) < least}))
            if out:
                yield pd.concat(out)

    tokens = materialise(texts.select("class", "component", "text").mapInPandas(rarest, "token long, class string, component string, n long, at int, early boolean"), "tokens")
    by = tokens.groupBy("token", "component").agg(F.count("*").alias("k"))
    met = by.groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("size"), F.count("*").alias("components")).filter("components > 1").drop("components")
    here = join_hot(tokens, materialise(met, "met"), ["token"], "size").withColumn("slices", F.ceil(F.col("size") / SLICE).cast("int"))
    here = materialise(here.select("token", "class", "component", "n", "at", "early", "slices", (F.col("component") != F.col("main")).alias("away")), "here")
    left = here.withColumn("slice", F.pmod(F.xxhash64("class"), F.col("slices")).cast("int")).alias("x")
    right = here.filter("away").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).alias("y")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    small = (x("early") & (x("n") <= y("n"))) | (y("early") & (y("n") <= x("n")))
    room = F.least(x("n") - x("at"), y("n") - y("at")) * (100 + percent) >= percent * (x("n") + y("n"))
    near = F.least(x("n"), y("n")) * 100 >= F.greatest(x("n"), y("n")) * percent
    meet = (x("token") == y("token")) & (x("slice") == y("slice")) & (x("component") != y("component"))
    return left.join(right, meet & small & room & near).select(*_pair(x("class"), y("class"))).distinct()


def _class_texts(docs: DataFrame, signed: DataFrame, members: DataFrame) -> DataFrame:
    """(class, text) of one document of each class that shares a bucket with another."""
    wanted = members.select("class").distinct()
    one = signed.join(wanted, "class").groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
    keys = one.select("class", F.col("one.doc_id").alias("_id"), F.col("one.text_hash").alias("_hash"))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(F.col("text")).alias("text_hash"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = given.join(keys, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return materialise(found.groupBy("class").agg(F.first("text").alias("text")), "texts")


def _compare(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    a = texts.select(F.col("class").alias("a"), F.col("text").cast("binary").alias("text_a"))
    b = texts.select(F.col("class").alias("b"), F.col("text").cast("binary").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInPandas(_similar(width, percent), "a string, b string, linked boolean")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept of each row of ``docs``.

    Words are runs of bytes that are no ASCII white space, A-Z in lower case; a
    document's set holds its distinct ``width``-word shingles, with fewer words
    the whole sequence.  Documents of which 100 * intersection >= percent * union
    are linked; component_id is the smallest doc_id that links reach.  Documents
    without words (null or empty text) are linked with nothing.  Repeated rows
    are copies like others, one row each; rows with a null doc_id take part, have
    the component_id of their component and are not kept, unless it has no doc_id:
    then component_id is null and they are kept; of rows that share the smallest doc_id all are
    kept.  An empty table gives no rows; further columns are ignored.
    """
    signed = materialise(signatures(docs, width, bands, rows), "signatures")
    links = similar_classes(docs, signed, width, percent)
    joined = connected_components(links)
    sizes = signed.filter("class is not null").groupBy("class").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    grouped = materialise(sizes.join(joined, F.col("class") == F.col("node"), "left").select("class", "n", "least", F.coalesce("component", "class").alias("group")), "grouped")
    smallest = materialise(grouped.groupBy("group").agg(F.min("least").alias("_smallest"), F.count("*").alias("_classes")), "smallest")
    classes = materialise(join_hot(grouped, smallest, ["group"], "_classes").select("class", "n", "group", "_smallest"), "classes")
    found = join_hot(signed.select("doc_id", "text_hash", "n_shingles", "class"), classes, ["class"], "n", "left")
    component = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("_smallest"))
    return found.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: that with the smallest doc_id; all columns stay.

    Rows that repeat the kept doc_id stay.
    """
    own, hash_ = free_name(docs, "_id", "_hash")
    gone = near_duplicates(docs, width, percent).filter("not kept").select(F.col("doc_id").alias(own), F.col("text_hash").alias(hash_)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col(own)) & (_text_hash(docs["text"]) == F.col(hash_)), "left_anti")


#: The query on two-word shingles.  Pairs come from an exact filter, without MinHash:
#: sets of similarity 0.8 share one of the rarest n - ceil(0.8 n) + 1 members of either.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
h AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS hs FROM w),
s AS (SELECT doc_id, len(hs) AS n, md5(array_to_string(list_sort(hs), chr(10))) AS class, hs FROM h),
c AS (SELECT class, any_value(n) AS n, any_value(hs) AS hs FROM s WHERE n > 0 GROUP BY 1),
x AS (SELECT class, n, unnest(hs) AS g FROM c),
f AS (SELECT g, count(*) AS k FROM x GROUP BY 1),
o AS (SELECT x.class, x.n, x.g, row_number() OVER (PARTITION BY x.class ORDER BY k, x.g) AS r FROM x JOIN f USING (g)),
p AS (SELECT class, n, g FROM o WHERE r <= n - ceil(0.8 * n) + 1),
q AS (SELECT DISTINCT a.class AS a, b.class AS b FROM p a JOIN p b ON a.g = b.g AND a.class < b.class AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
l AS (SELECT q.a, q.b FROM q JOIN c x ON x.class = q.a JOIN c y ON y.class = q.b WHERE 100 * len(list_intersect(x.hs, y.hs)) >= 80 * (x.n + y.n - len(list_intersect(x.hs, y.hs)))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT class AS a, class AS b FROM c UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b),
g AS (SELECT t.a AS class, min(s.doc_id) AS component_id FROM t JOIN s ON s.class = t.b AND s.n > 0 GROUP BY 1)
SELECT s.doc_id, s.n AS n_shingles, CASE WHEN s.n = 0 THEN s.doc_id ELSE g.component_id END AS component_id, s.doc_id = CASE WHEN s.n = 0 THEN s.doc_id ELSE g.component_id END AS kept
FROM s LEFT JOIN g ON s.class = g.class AND s.n > 0
"""
