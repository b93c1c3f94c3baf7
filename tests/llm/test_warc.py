import base64
import hashlib

from kerbflow.llm import warc
from kerbflow.session import shared_path

ROWS = [(1, "http://a/x", "<p>é</p>"), (2, "http://b/\r\ny", "<p>é</p>"), (3, None, None), (4, "http://c", ""), (5, "http://d", "z" * 200_000),
        (6, "http://e", "one"), (6, "http://e", "one"), (None, "http://f", "two")]


def archive(spark, rows):
    root = shared_path(spark, "test-warc")
    warc.write_archive(spark.createDataFrame([(*r, "spare") for r in rows], "page_id long, url string, html string, sha256 string"), root)
    return root


def test_index_and_round_trip(spark):
    root = archive(spark, ROWS)
    index = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.record_index(spark, root).collect()), key=str)
    expected = []
    for i, (page, _, html) in enumerate(ROWS):
        body = (html or "").encode()
        same = [(p if p is not None else -1, j) for j, (p, _, h) in enumerate(ROWS) if (h or "").encode() == body]
        top = max(same)
        expected.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if top[1] == i else "revisit", None if top[1] == i else top[0]))
    assert index == sorted(expected, key=str)
    for row in warc.original_records(spark, root).collect():
        record = bytes(row.record)
        head, _, rest = record.partition(b"\r\n\r\n")
        size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert rest[size:] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
        bodies = {(h or "").encode() for p, _, h in ROWS if p == row.page_id}
        assert bytes(row.payload) in bodies
        if b"WARC-Type: response" in head:
            assert rest[:size].partition(b"\r\n\r\n")[2] in bodies
    assert sum(1 for _ in warc.read_archive(spark, root)[1].collect()) == len({(h or "") for _, _, h in ROWS})


def test_empty_table(spark):
    root = archive(spark, [])
    assert warc.record_index(spark, root).collect() == []
