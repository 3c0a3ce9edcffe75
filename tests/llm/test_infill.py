"""Fill-in-middle against plain splitting, and round trips."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cytoweave.llm import infill

LINES = re.compile(r"[^\n]*\n|[^\n]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["\n", "a", "é😀", "same line\n", "x" * 700, "word " * 300]), max_size=40).map("".join))
def test_places_of_lines(text):
    memory = infill.ChunkMemory(limit=4096)
    index = infill.LineIndex(text.encode(), memory)
    lines = LINES.findall(text)
    assert index.lines == len(lines) and memory.held <= 4096 + 8192
    assert [index.place(k) for k in range(len(lines) + 1)] == [len("".join(lines[:k])) for k in range(len(lines) + 1)]


def test_equal_passages_are_summed_once():
    passage = "".join(f"line {k} of a passage that many texts share\n" for k in range(2000)).encode()
    memory = infill.ChunkMemory()
    infill.LineIndex(passage, memory)
    first = len(memory._known)
    infill.LineIndex(b"another start\n" + passage, memory)
    assert memory.hits > 0.9 * first and len(memory._known) < 1.1 * first + 3


def want(doc_id, text, rate=100, spm=50):
    text = text or ""
    words = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    lines = LINES.findall(text)
    a, b = sorted(w % (len(lines) + 1) for w in words[:2])
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if text == "" or re.search("<[PSM]>", text) or words[2] % 100 >= rate:
        return doc_id, len(lines), "plain", None, None, text
    form = "spm" if words[3] % 100 < spm else "psm"
    return doc_id, len(lines), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def texts():
    odd = [None, "", "\n", "\n\n\n", "no end", "one\n", "a<P>b", "x<S>", "<M>", "<\nS>\n<", ">\nP>\n<S\nM>", "é\n😀\nß", "a\r\nb\r\n", "<" * 9 + "\n" + ">" * 9]
    long = "".join(f"{k} é {'z' * (k % 90)}\n" for k in range(60_000))
    return [(k, t) for k, t in enumerate(odd * 6)] + [(None, "a\nb\nc"), (5, "twice\n"), (5, "twice\n"), (10**15, long), (-3, "x" * 3_000_000)]


def test_matches_plain_splitting_and_comes_back(spark):
    docs = spark.createDataFrame([(d, t, "kept", 1, 2) for d, t in texts()], "doc_id long, text string, form string, Output int, lang int")
    for rate, spm in ((100, 50), (60, 0), (100, 100)):
        got = infill.fill_in_middle(docs, rate, spm)
        assert got.columns == ["doc_id", "lang", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
        key = lambda r: (r[0] is None, r[0] or 0, str(r[-1]))
        rows = got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
        assert sorted(map(tuple, rows), key=key) == sorted((want(d, t, rate, spm) for d, t in texts()), key=key)
        back = got.select(F.coalesce("text", F.lit("")).alias("t"), infill.restore(F.col("output"), F.col("form")).alias("r"))
        assert back.filter("t <> r").count() == 0
    assert infill.fill_in_middle(docs.filter("false")).count() == 0
