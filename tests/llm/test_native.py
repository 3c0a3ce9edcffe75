"""Mixing, line dedup and PII against brute force."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cytoweave.llm import linededup, mixing, pii

CLASHING = ("n_lines", "taken", "runs", "_d", "_h", "_runs", "_id", "_hash", "i", "name", "seg", "class", "bands", "band", "token", "component")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def docs(spark, rows):
    """Rows (doc_id, text, source); the last columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, "en", s, 0, *["x"] * len(CLASHING)) for i, t, s in rows], SCHEMA)


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_mix_takes_exact_budgets(spark):
    rows = [(k, "w " * (k % 11), "abc"[k % 3]) for k in range(90)] + [(None, "a b", None), (None, None, None), (5, "", "b"), (5, "", "b"), (900, "x " * 40, "tiny")]
    got = mixing.mix_sources(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(WORDS.findall(t or ""))
    taken = collections.Counter()
    for x in got:
        taken[x.source] += x.taken
        assert 0 <= x.taken <= 2 * x.size and x.source_size == size[x.source]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    want, open_, left = {}, set(names), 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * size[s] <= level * weight[s]}
        if not full:
            want |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            want[s] = 2.0 * size[s]
            left -= want[s]
        open_ -= full
    for x in got:
        assert abs(x.target - want[x.source]) < 1e-6
    for s in names:
        assert taken[s] == int(want[s] + 1e-9)
    again = mixing.mix_sources(docs(spark, rows[::-1]).repartition(7)).collect()
    key = lambda a: sorted((str(x.doc_id), x.size, x.taken) for x in a)
    assert key(again) == key(got)


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    assert mixing.mix_sources(docs(spark, [(1, None, "a"), (2, "", "b")])).agg(F.sum("taken")).first()[0] == 0


def brute_lines(rows, least):
    """Lines to delete of each document, straight from the definition."""
    order = sorted({(i is None, i or 0, t) for i, t, _ in rows if t is not None})
    # equal ids are ordered by a hash in the operator; tests use distinct ids where order matters
    texts, gone = [t.split("\n") for *_, t in order], collections.defaultdict(set)
    words = lambda ls: sum(len(WORDS.findall(x)) for x in ls)
    first = {}
    for d, ls in enumerate(texts):
        for a in range(len(ls)):
            for b in range(a, len(ls)):
                run = tuple(ls[a : b + 1])
                if words(run) < least or not WORDS.search(ls[a]) or not WORDS.search(ls[b]):
                    continue
                if first.setdefault(run, (d, a)) < (d, a):
                    # blank lines go only with a run that has no shorter one at its start or end
                    shortest = words(ls[a:b]) < least or words(ls[a + 1 : b + 1]) < least
                    gone[d] |= {k for k in range(a, b + 1) if shortest or WORDS.search(ls[k])}
    return {(None if n else i, t): sorted(gone[d]) for d, (n, i, t) in enumerate(order)}


@pytest.mark.parametrize("least", [1, 4, 7])
def test_line_dedup_is_the_union_of_repeated_runs(spark, least):
    import random

    rng = random.Random(least)
    line = ["a b", "c", "", "d e f", "g h", "\t", "i j k l"]
    rows = [(k, "\n".join(rng.choice(line) for _ in range(rng.randint(1, 12))), "s") for k in range(40)]
    rows += [(100, "", "s"), (101, None, "s"), (102, "c\n" * 20, "s"), (103, "a b\n" * 9, "s"), (None, rows[3][1], "s"), (7, rows[7][1], "s")]
    want = brute_lines(rows, least)
    got = linededup.dedup_lines(docs(spark, rows), least).collect()
    assert len(got) == len(rows)
    texts = collections.defaultdict(list)
    for i, t, _ in rows:
        texts[i].append(t)
    for x in got:
        (source,) = set(texts[x.doc_id])
        if source is None:
            assert x.text is None and x.n_lines == 0
            continue
        cut = set(want[(x.doc_id, source)])
        ls = source.split("\n")
        assert x.text == "\n".join(v for k, v in enumerate(ls) if k not in cut), (x.doc_id, source)
        assert (x.n_lines, x.n_deleted) == (len(ls), len(cut))


def test_line_dedup_of_nothing(spark):
    assert linededup.dedup_lines(docs(spark, [])).count() == 0
    alone = linededup.dedup_lines(docs(spark, [(1, "one two\nthree", "s")])).first()
    assert alone.text == "one two\nthree" and all(alone[c] == "x" for c in CLASHING if c not in ("n_lines", "runs"))


def test_line_dedup_of_many_lines_and_runs(spark):
    import time

    # 100,000 lines, in which 10,000 short passages of another text alternate with lines of its own
    shared = [f"passage {k} of {k * k} words that are found elsewhere" for k in range(10_000)]
    long = "\n".join(x for k in range(10_000) for x in (shared[k], *[f"own {k} {j} line" for j in range(9)]))
    start = time.perf_counter()
    got = {x.doc_id: x for x in linededup.dedup_lines(docs(spark, [(1, "\n".join(shared), "s"), (2, long, "s")]), 5).collect()}
    assert time.perf_counter() - start < 90
    assert (got[1].n_deleted, got[2].n_lines, got[2].n_deleted) == (0, 100_000, 10_000)
    assert got[2].text == "\n".join(f"own {k} {j} line" for k in range(10_000) for j in range(9))


def test_line_dedup_spreads_its_rows(spark):
    """Suffixes that are alone, and pairs of lines that most texts share, go to no single task."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        common = ["license line one two three", "license line four five six"]
        rows = [(k, "\n".join([*common, f"own {k % 700} a", f"own {k % 700} b", f"only {k}"]), "s") for k in range(1_500)]
        lines = linededup._repeated_lines(docs(spark, rows))
        names = lines.withColumn("seg", F.lit(0)).select("_d", "_h", "seg", "i", "name")
        sizes = [r[1] for r in linededup._double(names, 1).groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= 14 and max(sizes) < 2.5 * sum(sizes) / 16
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    d = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


TEXTS = [
    None, "", "a", "x@y.z", "a@b.c_x@d.e.f", "é😀 mail 😀 a.b+c@d-e.co.uk, 1.2.3.4.5.6.7.8 and 256.1.1.1 or 001.2.3.0004",
    "4111 1111 1111 1111 and 4111-1111-1111-1112; 4111  1111 1111 1111", "+1 (743) 555-3824 +1+1+12345678901 (+49) 30 1234567",
    "9" * 30_000, "1 " * 20_000, "a" * 50_000 + "@", "." * 20_000, "1." * 9_999 + "1", "\x01mark\x01 a@b.cc \x01", "tel 5551234567 token = \"2321bac4d15ec8f90433955bf9d3cf61da5bdd1e\"",
    "@@@ a@b @c.d a@@b.c", "0.0.0.0 999999999999999999999.1.1.1 1.1.1.00000000000000000000001",
]


def test_base_spans_are_those_of_the_patterns(spark):
    rows = [(k, t, "s") for k, t in enumerate(TEXTS)] + [(None, TEXTS[5], "s"), (5, TEXTS[5], "s")]
    d = docs(spark, rows)
    model = pii.fit_pii(pii.propose(d))
    got = pii.span_digests(pii.detect_pii(d, model)).collect()
    assert len(got) == len(rows)
    for x in got:
        want = base_spans(TEXTS[5 if x.doc_id is None else x.doc_id])
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert x.base_sha256 == hashlib.sha256(shown.encode()).hexdigest(), (x.doc_id, shown, x.spans[:200])
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s[0] == k for s in want) for k in BASE]
        assert x.spans.startswith(shown)


def test_trees_find_credentials_and_leave_prose(spark):
    secret = [(k, f"so the token = \"{hashlib.sha1(str(k).encode()).hexdigest()}\" it", "s") for k in range(60)]
    prose = [(100 + k, f"in {1900 + k} there were {k} of them, see 12-34-56-{k % 90 + 10}", "s") for k in range(60)]
    d = docs(spark, secret + prose)
    model = pii.fit_pii(pii.propose(d))
    got = {x.doc_id: x.spans for x in pii.span_digests(pii.detect_pii(d, model)).collect()}
    assert all(got[k].startswith("secret:") for k in range(60))
    assert not any("secret" in got[100 + k] for k in range(60))
    text = {x.doc_id: x.text for x in pii.redact(d, model).collect()}
    assert text[3] == "so the token = \"[secret]\" it" and text[100] == prose[0][1]


def test_pii_of_nothing(spark):
    d = docs(spark, [])
    assert pii.detect_pii(d, pii.fit_pii(pii.propose(d))).count() == 0


def brute_features(generator, m, before, after):
    """The features of a candidate, as the operator's documentation names them."""
    count = lambda value, *bounds: sum(value >= b for b in bounds)
    has = lambda p, x=m: int(bool(re.search(p, x)))
    lead = 0 if not before else 1 if has(r"[=:]\s*[\"'(\[<]?$", before) else 2 if re.search(r"\w\s*$", before, re.A) else 3
    return {
        "generator": generator,
        "digits": count(len(re.sub("[^0-9]", "", m)), 1, 9, 13, 16, 20),
        "length": count(len(m), 12, 20, 32, 64),
        "letters": has("[a-z]") + 2 * has("[A-Z]") + 4 * has("[g-zG-Z]"),
        "separators": has("[ .]") + 2 * has("-") + 4 * has("[()/+_]"),
        "plus": int(m.startswith("+")),
        "variety": count(len(set(m[:64])), 4, 8, 11, 16) if generator == 3 else 0,
        "lead": lead,
        "quoted": has("[\"']$", before) & has("^[\"']", after),
        "domain": has(r"\.[A-Za-z]{2,}$"),
    }


def brute_spans(text, model):
    """All spans straight from the definition: every base span, every candidate that the trees choose."""
    base = base_spans(text)
    out = [(pii.RANKS[k], a, b, k) for k, a, b in base]
    for generator, pattern in ((1, r"[+(]?[0-9][0-9 ().-]{6,}[0-9]"), (2, r"[^\s@]{1,64}@[^\s@]{1,255}"), (3, r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")):
        for f in re.finditer(pattern, text):
            a, b = f.span()
            cell = brute_features(generator, f[0], text[:a][-24:], text[b:][:2])
            if generator in model.thresholds and not any(x <= a and b <= y for _, x, y in base) and model.score(cell) >= model.thresholds[generator]:
                kind = pii.ADDED[generator]
                out.append((pii.RANKS[kind], a, b, kind))
    return ",".join(f"{k}:{a}:{b}" for _, a, b, k in sorted(out))


def test_added_spans_match_brute_force(spark):
    import random

    rng = random.Random(5)
    hexes = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    parts = [lambda k: f'token = "{hexes(k)}"', lambda k: f"tel 555-{k % 900 + 100}-{k % 9000 + 1000}", lambda k: f"call {k % 900 + 100}.555.{k % 9000 + 1000}",
             lambda k: f"mail a{k}@localhost", lambda k: f"a{k}@b.org", lambda k: f"on 12-34-56-{k % 90 + 10}", lambda k: "Donaudampfschifffahrtsgesellschaft", lambda k: f"{k}.1.2.3", lambda k: "4539 1488 0343 6467", lambda k: "é words \n here"]
    rows = [(k, " ".join(rng.choice(parts)(rng.randrange(10_000)) for _ in range(rng.randrange(9))) + (f' see = "{hexes(k)}"' if k % 40 == 0 else ""), "s") for k in range(400)]
    d = docs(spark, rows)
    model = pii.fit_pii(pii.propose(d))
    assert 3 in model.thresholds and 1 in model.thresholds
    got = {x.doc_id: x for x in pii.span_digests(pii.detect_pii(d, model)).collect()}
    want = {k: brute_spans(t, model) for k, t, _ in rows}
    assert {k: x.spans for k, x in got.items()} == want
    added = [w for w in ",".join(want.values()).split(",") if w.startswith(("secret", "number"))]
    assert len(added) > 100 and sum(x.n_spans for x in got.values()) == sum(len(w.split(",")) for w in want.values() if w)
    quoted = [k for k, t, _ in rows if 'see = "' in t]  # the format alone, no word that speaks for it
    assert quoted and all("secret" in want[k] for k in quoted)


def test_secrets_that_hold_a_card_are_whole(spark):
    """A run of digits inside a token passes Luhn's check: nothing of the token stays."""
    texts = ['token="ab4539148803436467Z9qqqqqqqq"', 'key: xyzxyzxyzxyz4539148803436467', '4539148803436467-abcdefghij and 4539 1488 0343 6467', "a@bcdefghijklmnopqrstuvwxyz.org"]
    d = docs(spark, [(k, t, "s") for k, t in enumerate(texts)])
    model = pii.BoostedTrees(prior=1.0, thresholds={3: 0.0})
    got = {x.doc_id: x for x in pii.span_digests(pii.detect_pii(d, model)).collect()}
    assert {k: x.spans for k, x in got.items()} == {k: brute_spans(t, model) for k, t in enumerate(texts)}
    assert [(got[k].n_card, got[k].n_secret) for k in range(4)] == [(1, 1), (1, 1), (2, 1), (0, 0)]
    text = {x.doc_id: x.text for x in pii.redact(d, model).collect()}
    assert [text[k] for k in range(4)] == ['token="[secret]"', "key: [secret]", "[secret] and [card]", "[email]"]


def test_pii_is_linear_in_a_text(spark):
    import time

    text = " ".join(f'a{k}@b.com 1.2.3.{k % 256} token="{hashlib.sha1(str(k).encode()).hexdigest()}"' for k in range(7_000))
    model = pii.BoostedTrees(prior=1.0, thresholds={3: 0.0})
    start = time.perf_counter()
    got = pii.span_digests(pii.detect_pii(docs(spark, [(1, text, "s")]), model)).first()
    assert (got.n_email, got.n_ip, got.n_secret) == (7_000, 7_000, 7_000)
    assert time.perf_counter() - start < 60
    assert pii.redact(docs(spark, [(1, text, "s")]), model).first().text == " ".join(['[email] [ip] token="[secret]"'] * 7_000)
