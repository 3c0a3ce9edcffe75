"""Chat, media and WARC round trips."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cytoweave.llm import chat, media, warc
from cytoweave.llm.common import scratch_path

PARTS = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/s>", "\n", "x", "é😀", "<\\", "[\\\\/INST]"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(PARTS)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    for role in ("user", "assistant", text):
        segment, a, b = chat.round_trip(role, text)
        assert [x[:2] for x in chat.parse(segment * 2)] == [(role, text)] * 2
        assert chat.unescape(segment[a:b]) == text


@settings(max_examples=300, deadline=None)
@given(PARTS, st.sampled_from(["user", "assistant", None]))
def test_no_raw_control_string_is_left_inside_a_text(text, role):
    segment, a, b = chat.round_trip(role, text)
    assert not any(c in segment[a:b] for c in ("<s>", "</s>", "[INST]", "[/INST]"))
    assert (segment[a:b] == text) == (chat._CONTROL.search(text) is None)


def test_segments_out_of_order_are_an_error(spark):
    rows = spark.createDataFrame([(1, k, "user", f"t{k}") for k in range(4)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(rows)
    with pytest.raises(Exception, match="not in order"):
        chat.conversation_digests(formatted.coalesce(1).orderBy(F.desc("position"))).collect()


def conversation_rows():
    return [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (1, 1, "assistant", "b</s>"), (2, 0, None, None), (None, 0, "assistant", "é"), (3, None, "us\ner", "[INST]"), (3, 0, "assistant", "")]


def test_digests_of_conversations(spark):
    rows = spark.createDataFrame([(*r, 5) for r in conversation_rows()], "conv_id long, turn long, role string, text string, position int")
    got = {x.conv_id: x for x in chat.conversation_digests(chat.format_conversations(rows)).collect()}
    assert set(got) == {1, 2, 3, None}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256) == (3, sha("user\na\nassistant\nb</s>\nassistant\nb</s>\n"))
    assert (got[1].loss_chars, got[1].loss_sha256) == (10, sha("b</s>b</s>"))
    assert (got[2].n_turns, got[2].turns_sha256, got[2].loss_chars) == (1, sha("\n\n"), 0)
    assert got[3].turns_sha256 == sha("assistant\n\nus\ner\n[INST]\n") and got[None].loss_sha256 == sha("é")
    assert chat.conversation_digests(chat.format_conversations(rows.filter("false"))).count() == 0


def test_chunks_cover_and_realign():
    rng = random.Random(1)
    body = bytes(rng.choice(b"abcdefgh ") for _ in range(60_000))
    for payload in (b"", b"x" * 64, body, b"0" * 100_000):
        ends = media.cut(payload)
        assert b"".join(media._chunks(payload)) == payload and ends == sorted(set(ends))
        assert all(b - a <= media.MAX_CHUNK for a, b in zip([0, *ends], ends, strict=False))
    one, two = set(media._chunks(body)), set(media._chunks(b"new words before" + body))
    assert len(one & two) >= len(one) - 3
    big = bytes(rng.choice(b"abcdefgh ") for _ in range(media._BLOCK + 5000))
    assert (media._cut_candidates(memoryview_array(big)) == slow_candidates(big)).all()


def memoryview_array(data):
    import numpy as np

    return np.frombuffer(data, np.uint8)


def slow_candidates(data):
    import numpy as np

    out, h = [], 0
    for k, b in enumerate(data):
        h = ((h << 1) + int(media._GEAR[b])) & 0xFFFFFFFF
        if h >> (32 - media.MASK_BITS) == 0:
            out.append(k + 1)
    return np.array(out)


def test_store_rebuilds_every_payload(spark):
    rng = random.Random(2)
    long = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(4000))
    rows = [(k, f"{k} " + long[k * 40 :], 1) for k in range(12)] + [(20, long, 1), (21, long, 1), (21, long, 1), (None, "é😀", 1), (30, "", 1), (31, None, 1), (32, "x" * 64, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digests int")
    path = media.write_store(docs, scratch_path(spark, "media"))
    got = media.store_digests(spark, path).collect()
    plain = {x.doc_id: bytes(x.payload) for x in media.read_store(spark, path).collect()}
    assert plain[32] == b"x" * 64 and plain[30] == bytes(64)
    want = sorted((str(i), hashlib.sha256(p := media.padded((t or "").encode())).hexdigest(), len((t or "").encode()), len(p), zlib.crc32(p[-64:])) for i, t, _ in rows)
    assert sorted((str(x.doc_id), x.payload_sha256, x.n_bytes, x.payload_bytes, x.tail_crc32) for x in got) == want
    same = {(x.media_sha256, x.media_bytes, x.feature) for x in got if x.doc_id in (20, 21)}
    assert len(same) == 1
    # media columns straight from the store's files: headers as they stand there, then the chunks that they list
    stored = spark.read.parquet(f"{path}/chunks").collect()
    codec = media._Codec(bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"]))
    shared = {bytes(o["digest"]): codec.unpack(bytes(o["body"])) for r in stored for o in r["owned"]}
    assert shared and sum(len(r["owned"]) for r in stored) < sum(len(media.chunk_list(bytes(r["header"]))) for r in stored)
    forms = []
    for r in stored:
        own, payload = codec.unpack(bytes(r["private"])), b""
        for size, digest in media.chunk_list(bytes(r["header"])):
            part = shared.get(digest) or own[:size]
            own = own if digest in shared else own[size:]
            assert hashlib.sha256(part).digest() == digest and len(part) == size
            payload += part
        assert not own
        x = np.frombuffer(payload, np.uint8).astype(int)
        turns = sum((b > a and b > c) or (b < a and b < c) for a, b, c in zip(payload, payload[1:], payload[2:]))
        shown = f"chunks={len(media.chunk_list(bytes(r['header'])))};mean={x.sum() * 1000 // len(x)};rms={int(1000 * (int((x * x).sum()) / len(x)) ** 0.5)};turns={turns * 1000 // len(x)}"
        media_form = bytes(r["header"]) + payload
        forms.append((str(r["doc_id"]), len(media_form), hashlib.sha256(media_form).hexdigest(), shown))
    assert sorted(forms) == sorted((str(x.doc_id), x.media_bytes, x.media_sha256, x.feature) for x in got)
    empty = media.write_store(docs.filter("false"), scratch_path(spark, "media"))
    assert media.read_store(spark, empty).count() == 0


def test_wrong_chunks_and_headers_are_errors(spark):
    with pytest.raises(ValueError):
        media.chunk_list(b"CWM2" + bytes(4))
    docs = spark.createDataFrame([(1, "some text"), (2, "other text")], "doc_id long, text string")
    path = media.write_store(docs, scratch_path(spark, "media"))
    stored = spark.read.schema(media.STORE).parquet(f"{path}/chunks")
    wrong = stored.withColumn("header", F.when(F.col("doc_id") == 1, F.concat(F.expr("substring(header, 1, 12)"), F.unhex(F.lit("00" * 32)))).otherwise(F.col("header")))
    bad = scratch_path(spark, "media")
    wrong.write.parquet(f"{bad}/chunks")
    spark.read.parquet(f"{path}/dictionary").write.parquet(f"{bad}/dictionary")
    assert media.store_digests(spark, path).count() == 2
    with pytest.raises(Exception, match="does not match"):
        media.store_digests(spark, bad).collect()


def test_archives_reject_records_inside_payloads(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = ["<p>one</p>", "<p>one</p>", "", None, inner, "x" + inner * 3 + "WARC/1.1\r\n", "é😀\r\n\r\n", "WARC/1.1\r\nContent-Length: 99999\r\n\r\n", "y" * 300_000]
    rows = [(k, f"http://h/{k} z" if k else None, h, "c") for k, h in enumerate(html)] + [(None, "u", "<p>one</p>", "c"), (50, "u", "<p>one</p>", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    path = warc.write_archives(pages.repartition(2), scratch_path(spark, "warc"), file_rows=4)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first.setdefault((h or "").encode(), i)
    texts = {i: (h or "").encode() for i, _, h, _ in rows}
    for x in got:
        body = texts[x.page_id]
        assert x.payload_bytes == len(body) and x.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        lead = first[body]
        assert (x.record_type, x.refers_to) == (("response", None) if lead == x.page_id else ("revisit", lead))
        if x.record_type == "response":
            assert bytes(x.payload) == body
    assert warc.plan_records(pages, 1000).filter("record_type = 'revisit'").count() == 0
    assert warc.plan_records(pages.filter("false")).count() == 0


def test_chains_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 1 << 12)
    pages = spark.createDataFrame([(k, "u", f"{k} " * 400 + "WARC/1.1\r\n") for k in range(300)], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(pages, scratch_path(spark, "warc"))
    assert sorted(x.page_id for x in warc.read_archives(spark, path, False).collect()) == list(range(300))


def test_headers_of_any_length(spark):
    url = "http://h/" + "a" * 1_000_000
    rows = [(k, url if k in (3, 9) else f"http://h/{k}", "WARC/1.1\r\n" * 3 + f"page {k}") for k in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = warc.read_archives(spark, warc.write_archives(pages, scratch_path(spark, "warc"))).collect()
    assert sorted((x.page_id, x.url, bytes(x.payload).decode()) for x in got) == rows


def test_archives_are_bounded_by_bytes(spark):
    import zlib as z

    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.col("id").cast("string"), F.expr("repeat(sha2(cast(id as string), 256), 16384)")).alias("html"))
    path = warc.write_archives(pages, scratch_path(spark, "warc"), file_bytes=8 << 20)
    sizes = [len(z.decompress(bytes(x.content), wbits=31)) for x in spark.read.format("binaryFile").load(path).select("content").collect()]
    assert sum(sizes) > 60 << 20 and len(sizes) >= 6 and max(sizes) < 24 << 20
    assert sorted(x.page_id for x in warc.read_archives(spark, path, False).collect()) == list(range(60))


def test_a_page_that_most_share(spark):
    pages = spark.range(3000).select((F.lit(9000) - F.col("id")).alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 > 0, F.lit("same")).otherwise(F.concat(F.lit("p"), F.col("id").cast("string"))).alias("html"))
    got = warc.plan_records(pages, 0, 3)
    assert got.filter("record_type = 'revisit'").count() == 1999 and got.filter("refers_to is not null").select("refers_to").distinct().collect()[0][0] == 9000 - 2999
    assert got.count() == 3000


def test_chain_that_misses_the_end_is_an_error(spark, tmp_path):
    record = lambda k: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n".encode()
    good = record(0) + record(1)
    bad = {"cut": good[:-5], "shifted": b"?" + good, "longer": good + b"?", "torn": record(0) + b"?" + record(1), "none": b"no archive"}
    for name, content in {"good": good, **bad}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.warc").write_bytes(content)
    (tmp_path / "good" / "empty.warc").write_bytes(b"")
    assert warc.read_archives(spark, str(tmp_path / "good")).count() == 2
    for name, n in {"cut": 1, "shifted": 0, "longer": 2, "torn": 1, "none": 0}.items():
        with pytest.raises(ValueError, match=rf"{name}\.warc"):
            warc.read_archives(spark, str(tmp_path / name))
        assert warc.read_archives(spark, str(tmp_path / name), whole=False).count() == n
