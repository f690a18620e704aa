import gzip
import hashlib
from pathlib import Path

from metrolith.llm import warc


def brute(rows):
    out, first = [], {}
    for n, (p, h) in enumerate(rows):
        b = (h or "").encode()
        if len(b) >= 1000:
            k = (p is not None, p or 0, n)
            first[b] = max(first.get(b, k), k)
    for n, (p, h) in enumerate(rows):
        b = (h or "").encode()
        own = b in first and first[b] != (p is not None, p or 0, n)
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if own else "response", (first[b][1] if first[b][0] else None) if own else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    big, odd = "é<p>" * 300, "WARC/1.1\r\n\r\nContent-Length: 5\r\n" * 60
    rows = [(1, None), (2, ""), (3, "short"), (4, "short"), (5, big), (6, big), (7, big), (8, odd), (9, odd + "\r\n"), (None, "no id"), (10, "x" * 999), (11, "x" * 999), (12, "😀" * 40_000), (13, "\x00\x01 ctrl" * 200)]
    df = spark.createDataFrame([(p, None if p == 3 else f"http://e.org/ a{p}\n", h, "r") for p, h in rows], "page_id long, url string, html string, rid string")
    for chunk in (7, 16_384):
        assert sorted(map(tuple, warc.round_trip(df, chunk_chars=chunk).collect()), key=str) == brute(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_repeated_rows_have_one_response(spark):
    rows = [(1, "z" * 2000)] * 3
    df = spark.createDataFrame([(p, "u", h) for p, h in rows], "page_id long, url string, html string")
    got = sorted(r.record_type for r in warc.round_trip(df).collect())
    assert got == ["response", "revisit", "revisit"]


def test_files_are_warc(spark, tmp_path):
    """An independent reader that goes by Content-Length alone."""
    from metrolith.llm.common import written

    html = "line\r\n\r\nWARC/1.1\r\n" * 400
    df = spark.createDataFrame([(1, "http://a", html), (2, "http://b", "x")], "page_id long, url string, html string")
    warc.write_archive(written(warc.chunk_table(df, 1000), "t"), str(tmp_path / "w"))
    found = {}
    for f in Path(tmp_path / "w").glob("*.gz"):
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            at = dict(x.split(": ", 1) for x in lines[1:])
            n = int(at["Content-Length"])
            found.setdefault(at["WARC-Page-ID"], []).append((int(at.get("WARC-Segment-Number", 1)), rest[:n]))
            assert rest[n : n + 4] == b"\r\n\r\n"
            data = rest[n + 4 :]
    assert {k: b"".join(x for _, x in sorted(v)).decode() for k, v in found.items()} == {"1": html, "2": "x"}


def record(kind, block, more=b"", version=b"1.0"):
    return b"WARC/" + version + b"\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:x:" + str(len(block)).encode() + b">\r\n" + more + b"Content-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    odd = b"HTTP/1.1 200 OK\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n\xff\x00abc" + bytes(range(256)) * 600
    blocks = [b"software: x\r\n", odd, b"", b"WARC/1.1", "é".encode() * 10]
    kinds = [b"warcinfo", b"response", b"metadata", b"resource", b"response"]
    made = [record(k, b, b"WARC-Target-URI: http://e.org/a:b\r\n" if k == b"response" else b"") for k, b in zip(kinds, blocks)]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "members.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in made))
    (tmp_path / "w" / "whole.warc.gz").write_bytes(gzip.compress(b"".join(made)))
    rows = warc.read_records(spark, str(tmp_path / "w"), 1000).collect()
    for name in ("members", "whole"):
        found = {}
        for r in rows:
            if name in r.file:
                found.setdefault(r.record_no, []).append(r)
        assert len(found) == len(blocks)
        for n, (kind, block) in enumerate(zip(kinds, blocks)):
            parts = sorted(found[n], key=lambda r: r.chunk_no)
            assert b"".join(bytes(r.chunk) for r in parts) == block and parts[0].warc_type == kind.decode()
            assert [r.last for r in parts] == [False] * (len(parts) - 1) + [True]
            assert parts[-1].bytes_so_far == len(block) and parts[-1].digest_so_far == hashlib.sha1(block).hexdigest()
            assert parts[0].headers["Content-Length"] == str(len(block))
            assert parts[0].target_uri == ("http://e.org/a:b" if kind == b"response" else None)
    import pytest

    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(made[1][:-900]))
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_records(spark, str(tmp_path / "cut.warc.gz")).collect()
