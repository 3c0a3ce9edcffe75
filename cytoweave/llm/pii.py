r"""Personal data by candidate gradient boosting, in DataFrame operations only.

High-recall generators propose overlapping spans: number-like, address-like and
token-like strings.  Boosted trees score each candidate by its format and by the
shape of its surroundings; candidates over a calibrated threshold are redacted
together with the base spans (email, ip, card, phone by fixed patterns), which
always stay.

Weak labels come from evidence that the trees don't see: a candidate is a
positive example if it overlaps a valid base span (checksum, ranges, digits), if
its digits pass Luhn's checksum, or if a word that names such data (token,
password, tel, iban, mail) stands right before it.  So the trees learn which
formats such evidence comes with, and find the same formats without it.

The trees are fitted on counts: all features are small integers, so one
aggregation over all documents gives the number of candidates and of positive
ones in each cell of feature values (at most some thousand cells), and boosting
on cells is boosting on all candidates.  Half of the documents fit the trees, the
other half sets a threshold for each kind.  The fitted trees are CASE expressions.

Everything of a text is one row, and the work is near linear in the text's length:
matches are cut out once, their places are running sums by blocks, and overlaps
are looked up by bisection.  What a lambda uses is bound first (``let``), since a
column inside a lambda may be evaluated anew for each element.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

_MARK = "\x01"
KINDS = ("email", "ip", "card", "phone")
#: Kinds of the spans that the trees add, by generator.
ADDED = {1: "number", 2: "address", 3: "secret"}
#: Order of all kinds in results.
RANKS = {k: r for r, k in enumerate((*KINDS, "secret", "number", "address"))}
# Same matches as the plain patterns (leftmost, non-overlapping), but linear on
# long runs: quantifiers that can't give back are possessive, and a match starts
# at the start of its run or where the match before ended.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    1: r"[+(]?[0-9][0-9 ().-]{6,}[0-9]",
    2: r"[^\s@]{1,64}@[^\s@]{1,255}",
    3: r"(?:\G|(?<![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{20,}+",
}
#: Words before a candidate that are evidence for it, by generator.
EVIDENCE = {
    1: r"(?i)(?:tel|phone|call|fax|mobile|card|visa|account|iban|ssn|passport)\W*$",
    2: r"(?i)(?:mail|contact|write to)\W*$",
    3: r"(?i)(?:token|secret|passw(?:or)?d|credential|api.?key|key)\W*$",
}
FEATURES = ("generator", "digits", "length", "letters", "separators", "plus", "variety", "lead", "quoted", "domain")
ROUNDS, RATE, DEPTH = 24, 0.4, 3
#: Share of positive examples among the calibration candidates from a threshold on, smoothed by half a positive and half a negative one.
PRECISION = 0.9
_AROUND = 24


def _running(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of integers, by blocks of about the root of its size."""

    def scan(block: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            total = op(a["p"], x)
            return F.struct(total.alias("p"), F.array_append(a["out"], total).alias("out"))

        return F.aggregate(block, F.struct(zero.alias("p"), F.expr("cast(array() as array<int>)").alias("out")), step)["out"]

    def blocks(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        return let(size, lambda n: F.transform(F.sequence(F.lit(1), F.size(v), n), lambda k: scan(F.slice(v, k, n))))

    def joined(b: Column) -> Column:
        ends = scan(F.transform(b, lambda x: F.get(x, F.size(x) - 1)))
        return let(ends, lambda e: F.flatten(F.transform(b, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda y: op(F.get(e, i - 1), y))))))

    return let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(let(blocks(v), joined)))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _find(text: Column, pattern: str) -> Column:
    """(s, e, m, before, after) of each match, in code points.

    Matches are marked, the text is split at the marks, and running lengths give
    the places.
    """
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)

    def placed(p: Column) -> Column:
        ends = _running(F.transform(p, lambda x: F.length(x)), F.lit(0), _plus)

        def match(e: Column) -> Callable[[Column], Column]:
            return lambda i: F.struct(
                F.get(e, i - 1).alias("s"),
                F.get(e, i).alias("e"),
                F.get(p, i).alias("m"),
                F.right(F.get(p, i - 1), F.lit(_AROUND)).alias("before"),
                F.left(F.get(p, i + 1), F.lit(2)).alias("after"),
            )

        return let(ends, lambda e: F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), match(e)))

    return let(parts, lambda p: F.when(F.size(p) > 1, placed(p)).otherwise(F.expr(_NONE)))


_NONE = "cast(array() as array<struct<s:int,e:int,m:string,before:string,after:string>>)"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        def low(part: Column) -> Column:
            value = F.regexp_replace(part, "^0+", "")
            return (F.length(value) <= 3) & (F.coalesce(value.try_cast("int"), F.lit(0)) <= 255)

        return F.forall(F.split(m, r"\."), low)
    if kind == "card":
        return let(_digits(m), _luhn)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """(rank, s, e) of the valid matches of a base pattern."""
    return F.transform(F.filter(_find(text, PATTERNS[kind]), lambda c: _valid(kind, c["m"])), lambda c: F.struct(F.lit(RANKS[kind]).alias("rank"), c["s"].alias("s"), c["e"].alias("e")))


_NO_SPANS = "cast(array() as array<struct<rank:int,s:int,e:int>>)"


def _class(value: Column, *bounds: int) -> Column:
    """How many of the bounds a value reaches."""
    out = F.lit(0)
    for k, bound in enumerate(bounds):
        out = F.when(value >= bound, k + 1).otherwise(out)
    return out


def _features(generator: int, c: Column) -> dict[str, Column]:
    """Format of a candidate and shape of what stands around it; no word of the text."""
    m, before, after = c["m"], c["before"], c["after"]
    flag = lambda x: F.when(x, 1).otherwise(0)
    has = lambda pattern: flag(m.rlike(pattern))
    lead = F.when(before == "", 0).when(before.rlike(r"[=:]\s*[\"'(\[<]?$"), 1).when(before.rlike(r"\w\s*$"), 2).otherwise(3)
    return {
        "generator": F.lit(generator),
        "digits": _class(F.length(_digits(m)), 1, 9, 13, 16, 20),
        "length": _class(F.length(m), 12, 20, 32, 64),
        "letters": has("[a-z]") + 2 * has("[A-Z]") + 4 * has("[g-zG-Z]"),
        "separators": has("[ .]") + 2 * has("-") + 4 * has("[()/+_]"),
        "plus": flag(m.startswith("+")),
        "variety": _class(F.size(F.array_distinct(F.split(F.left(m, F.lit(64)), ""))), 4, 8, 11, 16) if generator == 3 else F.lit(0),
        "lead": lead,
        "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "domain": has(r"\.[A-Za-z]{2,}$"),
    }


_CANDIDATE = ", ".join(["s:int", "e:int", "known:boolean", "inside:boolean", "positive:boolean", *[f"{f}:int" for f in FEATURES]])
_NO_CANDIDATES = f"cast(array() as array<struct<{_CANDIDATE}>>)"


def _candidates_of(generator: int, found: Column, spans: Column) -> Column:
    """Candidates with whether they overlap a base span, lie inside one, whether anything speaks for them, and their features."""

    def shaped(starts: Column, tops: Column) -> Callable[[Column], Column]:
        def reach(last: Column) -> Column:
            """The furthest end of the spans that start at ``last`` or before; these are a prefix, found by bisection."""
            halve = lambda r, _: F.when(r["a"] >= r["b"], r).otherwise(
                let(((r["a"] + r["b"]) / 2).cast("int"), lambda k: F.when(F.get(starts, k) <= last, F.struct((k + 1).alias("a"), r["b"].alias("b"))).otherwise(F.struct(r["a"].alias("a"), k.alias("b")))),
            )
            steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(starts) + 1)).cast("int"))
            before = F.aggregate(steps, F.struct(F.lit(0).alias("a"), F.size(starts).alias("b")), halve)["a"]
            return F.when(F.size(starts) == 0, 0).otherwise(let(before, lambda k: F.when(k > 0, F.get(tops, k - 1)).otherwise(0)))

        def shape(c: Column) -> Column:
            fields = [v.cast("int").alias(k) for k, v in _features(generator, c).items()]
            speaks = c["before"].rlike(EVIDENCE[generator])
            if generator == 1:
                speaks = speaks | let(_digits(c["m"]), _luhn)
            inside = lambda k: k & (reach(c["s"]) >= c["e"])
            return let(reach(c["e"] - 1) > c["s"], lambda k: F.struct(c["s"].alias("s"), c["e"].alias("e"), k.alias("known"), inside(k).alias("inside"), (k | speaks).alias("positive"), *fields))

        return shape

    def bound(b: Column) -> Column:
        tops = _running(F.transform(b, lambda x: x["e"]), F.lit(0), lambda x, y: F.greatest(x, y))
        return let(F.transform(b, lambda x: x["s"]), lambda starts: let(tops, lambda t: F.transform(found, shaped(starts, t))))

    return let(F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))), bound)


def propose(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, ``_base`` (valid base spans), ``_c`` (candidates) and ``_half`` (of the fit)."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _MARK, "\x02")
    num, at, plus, long_run = text.rlike("[0-9]"), text.contains("@"), text.rlike(r"\+[0-9]"), text.rlike("[A-Za-z0-9+/_-]{20}")
    need = {"email": at, "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"(?:[0-9][\x20-]?){13}"), "phone": plus}
    wanted = {1: num & text.rlike(r"[0-9][0-9 ().-]{6}"), 2: at, 3: long_run}
    base = F.concat(*[F.when(need[k], _spans(text, k)).otherwise(F.expr(_NO_SPANS)) for k in KINDS])
    # a generated row is a border: what is made of the base spans doesn't search for them again
    given = docs.select("*", F.explode(F.array(base)).alias("_base"))
    of = lambda g: lambda found: _candidates_of(g, found, F.col("_base"))
    made = [F.when(wanted[g], let(_find(text, p), of(g))).otherwise(F.expr(_NO_CANDIDATES)) for g, p in GENERATORS.items()]
    return given.select("*", F.pmod(F.xxhash64(text), F.lit(2)).cast("int").alias("_half"), F.concat(*made).alias("_c"))


@dataclass
class BoostedTrees:
    """Trees on integer features, a prior and a threshold for each generator's kind."""

    prior: float = -10.0
    trees: list = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def score(self, cell: dict[str, int]) -> float:
        return self.prior + sum(_leaf(t, cell) for t in self.trees)

    def column(self, c: Column) -> Column:
        total = F.lit(self.prior)
        for t in self.trees:
            total = total + _tree_column(t, c)
        return total

    def chosen(self, c: Column) -> Column:
        """Whether a candidate reaches beyond every base span and its kind's threshold."""
        least = F.lit(None).cast("double")
        for generator, value in self.thresholds.items():
            least = F.when(c["generator"] == generator, value).otherwise(least)
        return ~c["inside"] & F.coalesce(self.column(c) >= least, F.lit(False))


def _leaf(tree, cell: dict[str, int]) -> float:
    while isinstance(tree, tuple):
        name, cut, left, right = tree
        tree = left if cell[name] <= cut else right
    return tree


def _tree_column(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    name, cut, left, right = tree
    return F.when(c[name] <= cut, _tree_column(left, c)).otherwise(_tree_column(right, c))


def _grow(cells: list[tuple[dict, float, float]], depth: int):
    """The tree of best gain; cells: (features, sum of gradients, sum of curvatures)."""
    g, h = sum(x[1] for x in cells), sum(x[2] for x in cells)
    leaf = RATE * g / (h + 1.0)
    if not depth:
        return leaf
    best, split = 1e-6, None
    for name in FEATURES:
        by: dict[int, list[float]] = {}
        for cell, gi, hi in cells:
            total = by.setdefault(cell[name], [0.0, 0.0])
            total[0], total[1] = total[0] + gi, total[1] + hi
        gl = hl = 0.0
        for cut in sorted(by)[:-1]:
            gl, hl = gl + by[cut][0], hl + by[cut][1]
            gain = gl * gl / (hl + 1.0) + (g - gl) ** 2 / (h - hl + 1.0) - g * g / (h + 1.0)
            if gain > best:
                best, split = gain, (name, cut)
    if split is None:
        return leaf
    name, cut = split
    return (name, cut, _grow([x for x in cells if x[0][name] <= cut], depth - 1), _grow([x for x in cells if x[0][name] > cut], depth - 1))


def _threshold(ranked: list[tuple[float, int, int]]) -> float | None:
    """The lowest score of at least even odds from which on PRECISION of the candidates are positive.

    Takes (score, candidates, positives) by falling score.
    """
    seen = right = 0
    found = None
    for k, (score, total, good) in enumerate(ranked):
        seen, right = seen + total, right + good
        last = k + 1 == len(ranked) or ranked[k + 1][0] < score
        if last and score > 0 and right + 0.5 >= PRECISION * (seen + 1):
            found = score - 1e-6
    return found


def boost(cells: list[dict], rounds: int = ROUNDS) -> BoostedTrees:
    """Fit on cells with ``half`` 0, set thresholds on cells with ``half`` 1.

    A cell is a dict of FEATURES, half, known, n and positive.  Known candidates
    (overlapping a base span) are positive examples of the fit.  A kind's threshold
    is set on the others only, whose evidence is not a base span; a kind for which
    no threshold holds adds nothing.
    """
    train, held = [c for c in cells if c["half"] == 0], [c for c in cells if c["half"] == 1]
    n, hits = sum(c["n"] for c in train), sum(c["positive"] for c in train)
    if not hits:
        return BoostedTrees()
    model = BoostedTrees(prior=math.log((hits + 0.5) / (n - hits + 0.5)))
    scores = [model.prior] * len(train)
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in scores]
        tree = _grow([(c, c["positive"] - c["n"] * q, c["n"] * q * (1 - q)) for c, q in zip(train, p, strict=True)], DEPTH)
        model.trees.append(tree)
        scores = [s + _leaf(tree, c) for s, c in zip(scores, train, strict=True)]
    for generator in GENERATORS:
        free = [c for c in held or train if not c["known"] and c["generator"] == generator]
        threshold = _threshold(sorted(((round(model.score(c), 6), c["n"], c["positive"]) for c in free), reverse=True))
        if threshold is not None:
            model.thresholds[generator] = threshold
    return model


def fit_pii(proposed: DataFrame) -> BoostedTrees:
    """Fit on the candidates of all documents (``propose``); only cell counts come to the driver.

    The documents' halves are told by a hash of the text, so copies fall in one.
    """
    cells = ["_half", "c.known", *[f"c.{f}" for f in FEATURES]]
    rows = proposed.select("_half", F.explode("_c").alias("c")).groupBy(*cells).agg(F.count("*").alias("n"), F.sum(F.col("c.positive").cast("long")).alias("positive")).collect()
    found = [{"half": r["_half"], **{k: v for k, v in r.asDict().items() if k != "_half"}} for r in rows]
    return boost(sorted(found, key=lambda c: (c["half"], c["known"], *(c[f] for f in FEATURES))))


def select_spans(proposed: DataFrame, model: BoostedTrees) -> DataFrame:
    """``propose``'s rows with ``pii``: (rank, s, e, kind) of each span, by kind and start."""
    names = F.array(*[F.lit(k) for k in RANKS])

    def added(c: Column) -> Column:
        rank = F.lit(None).cast("int")
        for generator, kind in ADDED.items():
            rank = F.when(c["generator"] == generator, RANKS[kind]).otherwise(rank)
        return F.struct(rank.alias("rank"), c["s"].alias("s"), c["e"].alias("e"))

    chosen = F.transform(F.filter("_c", model.chosen), added) if model.thresholds else F.expr(_NO_SPANS)
    spans = F.array_sort(F.concat("_base", chosen))
    kinds = F.transform(spans, lambda c: F.struct(c["rank"].alias("rank"), c["s"].alias("s"), c["e"].alias("e"), F.get(names, c["rank"]).alias("kind")))
    return proposed.withColumn("pii", kinds).drop("_base", "_c", "_half")


def detect_pii(docs: DataFrame, model: BoostedTrees) -> DataFrame:
    """All columns of ``docs`` and ``pii``: (rank, s, e, kind) of each span, by kind and start.

    Kinds are those of the base patterns, then secret (token-like), number and
    address for candidates that the trees select; these lie inside no base span,
    but may hold or cross one (a token that holds a run of digits with a valid
    checksum is both a card and a secret).
    Places are code points, the end exclusive.  Null text is the empty text and
    has no spans; rows are independent of each other, so repeated rows get equal
    spans; an empty table gives no rows.  Columns named _base, _c or _half are
    this operator's own.
    """
    return select_spans(propose(docs), model)


def redact(docs: DataFrame, model: BoostedTrees) -> DataFrame:
    """``docs`` with what the spans of ``detect_pii`` cover replaced by a kind in brackets.

    Overlapping spans are one place, named by the first of them (of those that
    start together by the longest).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def cut(spans: Column) -> Column:
        tops = _running(F.transform(spans, lambda c: c["e"]), F.lit(0), lambda x, y: F.greatest(x, y))

        def pieces(chars: Column, ends: Column) -> Column:
            between = lambda a, b: F.array_join(F.slice(chars, a + 1, b - a), "")
            piece = lambda c, i: let(F.when(i == 0, 0).otherwise(F.get(ends, i - 1)), lambda p: F.when(c["s"] >= p, F.concat(between(p, c["s"]), F.lit("["), c["kind"], F.lit("]"))).otherwise(""))
            last = F.get(ends, F.size(ends) - 1)
            return F.concat(F.array_join(F.transform(spans, piece), ""), let(last, lambda p: between(p, F.greatest(p, F.size(chars)))))

        return let(F.split(text, ""), lambda chars: let(tops, lambda ends: pieces(chars, ends)))

    by_place = F.array_sort(F.transform("pii", lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("far"), c["kind"].alias("kind"), c["e"].alias("e"))))
    return detect_pii(docs, model).withColumn("text", F.when(F.size("pii") == 0, text).otherwise(let(by_place, cut)))


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of each kind and of all spans, digest of the base spans, and all spans as text."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["s"].cast("string"), c["e"].cast("string"))), ",")
    of = lambda r: lambda c: c["rank"] == r
    counts = {k: F.size(F.filter("pii", of(r))).cast("long").alias(f"n_{k}") for k, r in RANKS.items()}
    base = F.sha2(shown(F.filter("pii", lambda c: c["rank"] < len(KINDS))), 256)
    more = [counts[k] for k in RANKS if k not in KINDS]
    return found.select("doc_id", *[counts[k] for k in KINDS], base.alias("base_sha256"), shown("pii").alias("spans"), *more, F.size("pii").cast("long").alias("n_spans"))
