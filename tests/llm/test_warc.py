"""WARC bundles: round trips, the seekable format, repeats, lookups by id."""

from __future__ import annotations

import base64
import hashlib
import os
import struct

import pytest
import zstandard

from pagegrain.llm import warc


@pytest.fixture
def pages_of(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n int, same string")


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows, least=0):
    out = []
    for i, url, html in rows:
        equal = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        top = max(equal, default=None) if len((html or "").encode()) >= least else i
        revisit = top is not None and i != top
        out.append((None if i is None else str(i), url, "revisit" if revisit else "response", str(top) if revisit else None, b32(html), len((html or "").encode())))
    return sorted(out, key=repr)


ROWS = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2?x=1&y=%20 é\r\nEvil: 1", "<p>same</p>"), (3, None, None), (4, "", ""), (5, "u", "é" * 3000), (6, "u", "long " * 400_000),
        (7, "http://a/1", "<p>same</p>"), (7, "http://a/1", "<p>same</p>"), (None, "n", "<p>same</p>"), (None, "n", "alone"), (-8, "v", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (9, "w", "\r\n\r\n")]


@pytest.mark.parametrize("frame,bundle", [(1 << 20, 256 << 20), (1, 1), (5000, 2000)])
@pytest.mark.parametrize("least", [0, 12])
def test_round_trip(spark, pages_of, tmp_path, frame, bundle, least):
    folder = f"file://{tmp_path}/w"
    warc.write(pages_of(ROWS).repartition(2), folder, frame=frame, bundle=bundle, least=least)
    rows = warc.read(spark, folder)
    got = rows.collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == brute(ROWS, least)
    html = {None if i is None else str(i): (h or "").encode() for i, _, h in ROWS}
    assert all(r.payload is None if r.record_type == "revisit" else r.id is None or bytes(r.payload) == html[r.id] for r in got)
    whole = warc.resolved(rows).collect()
    assert len(whole) == len(ROWS) and all(b32(bytes(r.payload).decode()) == r.payload_digest for r in whole)


def test_bundles_are_seekable_and_plain_zstandard(spark, pages_of, tmp_path):
    warc.write(pages_of(ROWS).coalesce(1), str(tmp_path / "w"), frame=2000)
    name, = os.listdir(tmp_path / "w/bundles")
    raw = (tmp_path / "w/bundles" / name).read_bytes()
    frames, kind, magic = struct.unpack("<IBI", raw[-9:])
    assert (kind, magic) == (0, 0x8F92EAB1) and frames > 2
    head = len(raw) - 9 - 8 * frames - 8
    assert struct.unpack("<II", raw[head:head + 8]) == (0x184D2A5E, 8 * frames + 9)
    sizes = [struct.unpack_from("<II", raw, head + 8 + 8 * i) for i in range(frames)]
    assert sum(a for a, _ in sizes) == head
    plain = b"".join(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read(-1) for _ in range(1))
    assert len(plain) == sum(b for _, b in sizes) and plain.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS)
    at, n = 0, 0
    while at < len(plain):
        _, _, at = warc.parsed(plain, at)
        n += 1
    assert n == len(ROWS)


def test_lookup_reads_records_from_their_frames(spark, pages_of, tmp_path):
    rows = [(i, f"u{i}", f"text {i} " * (i % 50)) for i in range(1, 500)]
    folder = str(tmp_path / "w")
    at = {r.id: r for r in warc.write(pages_of(rows), folder, frame=4000).collect()}
    assert len(at) == 499 and len({(r.bundle, r.frame) for r in at.values()}) > 20
    wanted = spark.createDataFrame([("17",), ("499",), ("17",), ("none",), (None,)], "id string")
    got = warc.fetch(wanted, folder).collect()
    assert sorted(r.id for r in got) == ["17", "499"]
    assert {r.id: bytes(r.payload).decode() for r in got} == {"17": rows[16][2], "499": rows[498][2]}
    # an index row leads to its record by the seek table alone
    r = at["250"]
    data = warc.Opened(f"{folder}/bundles", r.bundle).frame(r.frame)[r.offset:r.offset + r.length]
    assert warc.parsed(data)[0]["WARC-Record-ID"] == "<urn:record:250>" and warc.parsed(data)[2] == r.length


def test_bundles_outside_the_index_do_not_count(spark, pages_of, tmp_path):
    folder = str(tmp_path / "w")
    warc.write(pages_of(ROWS), folder)
    lost = warc.Bundle(f"{folder}/bundles", 100)
    lost.add(warc.record("99", "u", b"x", None, False, warc.digest(b"x"), 1, warc.DATE))
    lost.close()
    assert warc.read(spark, folder).count() == len(ROWS)


def test_a_damaged_payload_is_an_error():
    good = warc.record("1", "u", b"payload", None, False, warc.digest(b"payload"), 7, warc.DATE)
    assert warc.parsed(good)[1] == b"payload"
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(good.replace(b"payload\r", b"paylaod\r"))


def test_empty_table(spark, pages_of, tmp_path):
    folder = str(tmp_path / "w")
    assert warc.write(pages_of([]), folder).count() == 0
    assert warc.read(spark, folder).count() == 0
