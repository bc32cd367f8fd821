"""Operator 4: round trips, seek tables and record types."""

import base64
import hashlib

import pyarrow.fs as pafs
import pytest
import zstandard

from parcela.llm import warc

BIG = "<p>" + "déjà vu " * 30_000


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/ b\r\nX: y", "<p>same</p>", 1), (2, "http://b/", "<p>same</p>", 1), (3, None, None, 1), (4, "", "", 1),
            (5, "http://c/", BIG, 1), (6, "http://c/", "\r\n\r\nWARC/1.1\r\n\r\n", 1), (None, "http://n/", "<p>same</p>", 1),
            (7, "d", "twice", 1), (7, "d", "twice", 1), (2, "again", "<p>same</p>", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha1 int")


def test_round_trip(spark, pages, tmp_path):
    index = warc.write_bundles(pages, str(tmp_path / "w"), frame_bytes=2000)
    rows = warc.resolve(warc.read_bundles(index)).collect()
    best = {}
    for p in pages.collect():
        if p.page_id is not None:
            best[p.html or ""] = max(best.get(p.html or "", -1), p.page_id)
    want = []
    for p in pages.collect():
        body = (p.html or "").encode()
        ref = best[p.html or ""] if p.page_id is not None and p.page_id < best[p.html or ""] else None
        want.append((p.page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                     "response" if ref is None else "revisit", ref, body))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert len({r.record_id for r in rows}) == len(rows)


def test_frames_are_independent_and_seekable(spark, pages, tmp_path):
    index = warc.write_bundles(pages.coalesce(1), str(tmp_path / "w"), frame_bytes=500).collect()
    assert len({r.bundle for r in index}) == 1 and len({r.frame for r in index}) > 2
    fs, path = pafs.FileSystem.from_uri(index[0].bundle)
    raw = fs.open_input_file(path).readall()
    table = warc.read_seek_table(fs.open_input_file(path))
    whole = b"".join(zstandard.ZstdDecompressor().decompressobj().decompress(raw[a:a + n]) for a, n in table)
    for r in index:
        assert table[r.frame] == (r.frame_start, r.frame_size)
        record = warc.read_record(r.bundle, r.frame, r.offset, r.length)
        assert record in whole and warc.parse_record(record)[0]["WARC-Record-ID"] == f"<{r.record_id}>"


def test_bundles_roll_over_and_empty_table(spark, pages, tmp_path):
    index = warc.write_bundles(pages.coalesce(1), str(tmp_path / "w"), frame_bytes=10, bundle_bytes=400)
    assert index.select("bundle").distinct().count() > 1
    assert warc.read_bundles(index, payloads=False).count() == pages.count()
    empty = warc.write_bundles(pages.limit(0), str(tmp_path / "e"))
    assert empty.count() == 0 and warc.read_bundles(empty).count() == 0
