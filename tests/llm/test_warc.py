"""WARC: bytes of a record, the chain against magic inside payloads, damage, and the query against brute force."""

import base64
import hashlib
import io
import zlib

import pytest

from trainframe.llm import warc


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(rows):
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if page is not None:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        least = first.get(data)
        revisit = least is not None and least != page
        out.append((page, len(data), digest(data), "revisit" if revisit else "response", least if revisit else None))
    return out


def whole_record(k):
    return warc.record(k, "http://inside/", b"<p>inside</p>", None, False).decode()


ROWS = [(7, "http://a/", "<p>x</p>"), (3, "http://b/", "<p>x</p>"), (9, None, None), (8, "", ""), (4, "http://ü/ä b\r\nc", "é"), (5, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (None, "n", "only here"), (None, "n", "<p>x</p>"), (12, "u", "\r\n\r\nWARC/1.1"), (13, "u", "x" * 300_000)]
ROWS += [(100 + k, "u", whole_record(k) * (k % 4 + 1)) for k in range(40)]
ROWS += [(200 + k, "u", "many copies") for k in range(50)]


def results(df):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=key)


def frame(spark, rows=None):
    given = ROWS if rows is None else rows
    return spark.createDataFrame([(*r, 1) for r in given], "page_id long, url string, html string, bytes long").repartition(3)


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("span", [8 << 20, 700])
def test_round_trip(spark, compress, span):
    """Small spans put whole records inside payloads at the start of ranges, where their magic looks right."""
    files = warc.write_archives(frame(spark), compress=compress, roll=50_000)
    want = sorted(brute(ROWS), key=lambda r: tuple((x is None, x) for x in r))
    assert results(warc.read_archives(files, span=span)) == want


def test_urls_come_back_quoted(spark):
    got = {r.page_id: r.url for r in warc.read_archives(warc.write_archives(frame(spark, ROWS[:5]))).collect()}
    assert got[9] is None and got[8] == "" and got[4] == "http://%C3%BC/%C3%A4%20b%0D%0Ac"


def test_small_payloads_are_never_revisits(spark):
    got = results(warc.read_archives(warc.write_archives(frame(spark), min_bytes=12)))
    kinds = {(n, kind) for _, n, _, kind, _ in got}
    assert (8, "revisit") not in kinds and (11, "revisit") not in kinds


def test_candidates_inside_payloads_exist_and_are_not_reached():
    outer = warc.record(1, "u", whole_record(2).encode(), None, False)
    view = warc.View(io.BytesIO(outer), len(outer))
    inner = outer.index(b"WARC/1.1", 10)
    assert warc.parse(view, inner, False)[0]["warc-record-id"] == "<urn:x-page:2>"
    assert warc.parse(view, 0, False)[2] == len(outer)


def test_damage_is_an_error_unless_told(spark, tmp_path):
    a, b = (warc.record(k, "u", b"payload %d" % k, None, False) for k in (1, 2))
    path = tmp_path / "x.warc"
    path.write_bytes(a + b[:-20] + b"#" * 20)
    files = spark.createDataFrame([(str(path), path.stat().st_size)], "path string, bytes long")
    with pytest.raises(ValueError, match="end before the file"):
        warc.read_archives(files)
    assert [r.page_id for r in warc.read_archives(files, strict=False).collect()] == [1]


def test_members_of_other_writers(spark, tmp_path):
    """A gzip member with other flags, and headers in another case."""
    plain = warc.record(5, "u", b"abc", None, False).replace(b"Content-Length", b"content-length")
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    path = tmp_path / "x.warc.gz"
    path.write_bytes(pack.compress(plain) + pack.flush())
    files = spark.createDataFrame([(str(path), path.stat().st_size)], "path string, bytes long")
    assert results(warc.read_archives(files)) == [(5, 3, digest(b"abc"), "response", None)]


def test_query_and_no_rows(spark, tmp_path):
    spark.createDataFrame(ROWS, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op5_warc(spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert results(got) == sorted(brute(ROWS), key=lambda r: tuple((x is None, x) for x in r))
    assert warc.read_archives(warc.write_archives(frame(spark, []))).count() == 0
