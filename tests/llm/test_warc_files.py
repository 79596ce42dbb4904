"""WARC files: what is written is read back; real archives with compressed members, odd blocks and cut ends."""

import gzip
import hashlib

import pytest

from airgrid.llm.warc import derive, responses
from airgrid.llm.warc_files import read_records, records_of, responses_read, write_records


def record(kind: str, uri: str, block: bytes, mime: str = "application/http; msgtype=response", more: str = "") -> bytes:
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nwarc-record-id: <urn:{uri}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2024-05-06T07:08:09Z\r\nContent-Type: {mime}\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_records_round_trip(spark, tmp_path, compression):
    rows = [(1, "http://a/", "<title>T</title><p>a &amp; b\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nx é</p>"), (2, None, None), (3, "http://b/", "<p>" + "long " * 300_000), (3, "http://b/", "")]
    made = derive(responses(spark.createDataFrame(rows, "page_id int, url string, html string")))
    write_records(made, str(tmp_path / "w"), 3, compression)
    back = read_records(spark, str(tmp_path / "w"))
    want = sorted((r.header, r.block.encode(), r.record_id, r.refers_to, r.warc_type) for r in made.collect())
    assert sorted((r.header, bytes(r.block), r.record_id, r.refers_to, r.warc_type) for r in back.collect()) == want
    write_records(made.limit(0), str(tmp_path / "none"))
    assert read_records(spark, str(tmp_path / "none")).count() == 0


def test_responses_of_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n<p>caf\xe9\r\n\r\nWARC/1.0\r\n</p>"
    items = [
        record("warcinfo", "", b"software: x\r\n", "application/warc-fields"),
        record("request", "http://a/", b"GET / HTTP/1.1\r\n\r\n", "application/http; msgtype=request"),
        record("response", "http://a/", http),
        record("response", "http://b/", b"HTTP/1.1 204 No Content\r\n\r\n", more="WARC-Payload-Digest: sha1:ABC\r\n"),
    ]
    (tmp_path / "plain.warc").write_bytes(b"".join(items))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(i) for i in items))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = responses_read(read_records(spark, str(tmp_path)))
    rows = {(r.path.rsplit("/", 1)[1], r.target_uri): r for r in got.collect()}
    assert len(rows) == 4
    for name in ("plain.warc", "members.warc.gz"):
        a, b = rows[name, "http://a/"], rows[name, "http://b/"]
        assert a.payload == "<p>café\r\n\r\nWARC/1.0\r\n</p>" and a.http_headers.split("\r\n")[1] == "Server: x"
        assert a.payload_digest == "sha256:" + hashlib.sha256(http.partition(b"\r\n\r\n")[2]).hexdigest() and b.payload_digest == "sha1:ABC" and b.payload == ""
    made = derive(got, keep=("path",)).collect()
    assert len(made) == 8 and all(r.refers_to in ("<urn:http://a/>", "<urn:http://b/>") and "2024-05-06T07:08:09Z" in r.header for r in made)
    assert sum("source-http: Server: x\r\n" in r.block for r in made) == 2


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_stream_in_any_steps(step):
    items = [record("response", f"http://{i}/", b"x" * i + b"\r\n\r\n") for i in range(6)]
    data = b"".join(items)
    runs = lambda d: iter([d[i : i + step] for i in range(0, len(d), step)])
    got = list(records_of("p", runs(data)))
    assert [b for _, _, b in got] == [b"x" * i + b"\r\n\r\n" for i in range(6)]
    assert all(data[at:].startswith(h.encode()) for at, h, _ in got)
    for bad in (data[:-12], data + b"WARC/1.0\r\nWARC-Type: x\r\n", b"hello\r\n\r\n", data + b"WARC/1.0\r\nWARC-Type: x\r\n\r\n"):
        with pytest.raises(ValueError):
            list(records_of("p", runs(bad)))
