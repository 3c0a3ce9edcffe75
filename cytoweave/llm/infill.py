"""Fill-in-middle transformation by content-defined chunks with remembered summaries.

A text is cut into chunks by a rolling gear hash, so passages that texts share give
equal chunks wherever they stand.  A chunk's summary (line ends and code points)
is made once for all equal chunks that a task meets: it is remembered under the
chunk's bytes, so a hit is verified by content.  Running sums of the summaries
tell which chunk holds the line end that a cut asks for, and only that chunk is
searched.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .media import cut

#: Sentinels before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts in a hundred that are transformed, and of these with the suffix first.
RATE, SPM_RATE, SEED = 100, 50, "7"
#: Bytes of chunks that a task remembers at most; the longest unused go first.
MEMORY = 32 << 20
_CUTS = "n long, prefix_chars long, middle_chars long"


class ChunkMemory:
    """Summaries of chunks by their bytes: places of line ends, and code points."""

    def __init__(self, limit: int = MEMORY):
        self.limit, self.held, self.hits = limit, 0, 0
        self._known: OrderedDict[bytes, tuple[np.ndarray, int]] = OrderedDict()

    def summary(self, chunk: bytes) -> tuple[np.ndarray, int]:
        known = self._known.get(chunk)
        if known is not None:
            self.hits += 1
            self._known.move_to_end(chunk)
            return known
        data = np.frombuffer(chunk, np.uint8)
        made = np.flatnonzero(data == 10).astype(np.int32), chars(data)
        self._known[chunk] = made
        self.held += len(chunk)
        while self.held > self.limit:
            gone, _ = self._known.popitem(last=False)
            self.held -= len(gone)
        return made


def chars(data: np.ndarray) -> int:
    """Code points that begin in these UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


class LineIndex:
    """Lines of a text (its feed included; the last may lack one), found through the chunks' summaries."""

    def __init__(self, text: bytes, memory: ChunkMemory):
        ends = cut(text)
        self.starts = [0, *ends[:-1]] if ends else []
        self.text, self.chunks = text, [memory.summary(text[a:b]) for a, b in zip(self.starts, ends, strict=True)]
        self.feeds = np.cumsum([len(s[0]) for s in self.chunks], dtype=np.int64)
        self.points = np.cumsum([s[1] for s in self.chunks], dtype=np.int64)
        whole = int(self.feeds[-1]) if self.chunks else 0
        self.lines = whole + (len(text) > 0 and not text.endswith(b"\n"))

    def place(self, lines: int) -> int:
        """Code points in the first ``lines`` lines."""
        if lines <= 0 or not self.chunks:
            return 0
        if lines > self.feeds[-1]:
            return int(self.points[-1])
        k = int(np.searchsorted(self.feeds, lines))
        nth = lines - (int(self.feeds[k - 1]) if k else 0)
        inside = int(self.chunks[k][0][nth - 1]) + 1
        start = self.starts[k]
        return (int(self.points[k - 1]) if k else 0) + chars(np.frombuffer(self.text, np.uint8)[start : start + inside])


def _cuts(batches):
    """Lines of each text, and where its prefix and its middle end."""
    memory = ChunkMemory()
    for texts, first, second in batches:
        rows = []
        for text, h1, h2 in zip(texts, first, second, strict=True):
            index = LineIndex(text, memory)
            a, b = sorted((int(h1) % (index.lines + 1), int(h2) % (index.lines + 1)))
            start, end = index.place(a), index.place(b)
            rows.append((index.lines, start, end - start))
        yield pd.DataFrame(rows, columns=["n", "prefix_chars", "middle_chars"])


def _locate(text: Column, first: Column, second: Column) -> Column:
    # names in a module with postponed annotations are no types yet
    _cuts.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(_cuts, _CUTS)(text, first, second)


def _word(digest: Column, k: int) -> Column:
    """The k-th 8-digit group of a hexadecimal digest, unsigned."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: str = SEED) -> DataFrame:
    """All columns of ``docs`` and n, form, prefix_chars, middle_chars and output.

    Cuts fall between lines: hashes of seed and doc_id choose two of the n + 1
    places, so reruns agree.  ``form`` is psm or spm (which of ``spm_rate`` in a
    hundred texts are), or plain for texts beyond ``rate`` in a hundred, empty
    texts and texts that hold a sentinel; ``output`` of a plain text is the text.
    prefix_chars and middle_chars are code points, null if plain.  Null text is the
    empty text; a null doc_id hashes like the empty string; repeated rows get equal
    results; columns of ``docs`` that bear a name of the result are replaced; an
    empty table gives no rows.
    """
    taken = ("n", "form", "prefix_chars", "middle_chars", "output")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit(""))), 256)
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (_word(digest, 3) % 100 >= rate)
    form = F.when(plain, "plain").when(_word(digest, 4) % 100 < spm_rate, "spm").otherwise("psm")
    cuts = _locate(text.cast("binary"), _word(digest, 1), _word(digest, 2))
    others = [docs[c] for c in docs.columns if c.lower() not in (*taken, "text")]
    given = docs.select(*others, docs["text"], F.struct(text.alias("text"), form.alias("form"), cuts.alias("cuts")).alias("output"))
    at = lambda c: F.col(f"output.{c}")
    a, m = at("cuts.prefix_chars"), at("cuts.middle_chars")
    prefix, middle, suffix = F.left(at("text"), a.cast("int")), at("text").substr((a + 1).cast("int"), m.cast("int")), at("text").substr((a + m + 1).cast("int"), F.length(at("text")))
    made = F.when(at("form") == "plain", at("text")).when(at("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    shown = lambda c: F.when(at("form") != "plain", c)
    return given.select(*[c for c in given.columns if c != "output"], at("cuts.n").alias("n"), at("form").alias("form"), shown(a).alias("prefix_chars"), shown(m).alias("middle_chars"), made.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The exact text of an output and its form.

    No text that was transformed holds a sentinel, and none arises where parts
    meet, so the first one of each kind is the one that was put there.
    """
    body = output.substr(F.lit(len(PREFIX) + 1), F.length(output))
    i, j = F.when(form == "psm", F.locate(SUFFIX, body)).otherwise(F.locate(PREFIX, body)), F.locate(MIDDLE, body)
    one, two, three = F.left(body, i - 1), body.substr(i + len(SUFFIX), j - i - len(SUFFIX)), body.substr(j + len(MIDDLE), F.length(body))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))


#: The query: lines as lists.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h, CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') END AS ls FROM documents),
w AS (SELECT *, len(ls) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT *, array_to_string(ls[1:a], '') AS x, array_to_string(ls[a + 1:b], '') AS m, array_to_string(ls[b + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || x || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
