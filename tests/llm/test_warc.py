import gzip
import hashlib
import random
import zlib

import pytest

from kinweave.llm import warc

SCHEMA = "page_id long, url string, html string, digest int"


def pages():
    r = random.Random(1)
    text = lambda n: "".join(r.choice("abcdé<>\r\n") for _ in range(n))
    big, edge, small = text(3000), "x" * 1000, "y" * 999
    rows = [(i, f"http://h/{i}?a b\r\nX: y", text(r.randint(0, 4000)), 0) for i in range(40)]
    rows += [(100 + i, None, big, 0) for i in range(7)] + [(200, "u", edge, 0), (201, "u", edge, 0), (202, "u", small, 0), (203, "u", small, 0)]
    return [*rows, (300, "u", None, 0), (301, None, "", 0), (None, "u", big, 0), (106, None, big, 0), (400, "u", "WARC/1.1\r\n\r\n", 0)]


def expected(rows):
    top = {}
    for p, _, h, _ in rows:
        b = (h or "").encode()
        top[b] = max(top.get(b, -(2**63)), -(2**63) if p is None else p)
    out = []
    for p, _, h, _ in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and p != top[b]
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[b] if again else None))
    return sorted(out, key=str)


def test_round_trip_by_any_ranges(spark, tmp_path):
    rows = pages()
    uri = f"file://{tmp_path}/a"
    warc.write_archives(warc.with_revisits(spark.createDataFrame(rows, SCHEMA)), uri)
    html = {p: (h or "").encode() for p, _, h, _ in rows}
    for split in (97, 1000, 1 << 30):
        got = warc.read_archives(spark, uri, split).collect()
        page = lambda x: int(x[11:]) if x and x[11:] else None
        assert sorted([(page(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, page(r.refers_to)) for r in got], key=str) == expected(rows)
        assert all(bytes(r.payload) == html[page(r.record_id)] for r in got if r.record_type == "response")
        assert all(r.payload is None for r in got if r.record_type == "revisit")
        assert len({(r.file, r.offset) for r in got}) == len(got)


def test_files_open_with_gzip_and_roll(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 5000)
    uri = f"file://{tmp_path}/b"
    warc.write_archives(warc.with_revisits(spark.createDataFrame(pages(), SCHEMA)).coalesce(1), uri)
    found = warc.listed(uri, ".warc.gz")
    assert found
    n = sum(gzip.open(f.removeprefix("file://")).read().count(b"WARC-Record-ID") for f, _ in found)
    assert n == len(pages())


def test_magic_inside_payloads_is_no_record(tmp_path):
    inner = warc.member(warc.record("response", "urn:inner", None, "00" * 20, b"", 0, "d"))
    data = b""
    at = []
    for i in range(5):
        body = b"\x1f\x8b\x08" * 50 + inner + b"tail" * 20
        rec = warc.record("response", f"urn:x-page:{i}", None, hashlib.sha1(body).hexdigest(), body, len(body), "d")
        c = zlib.compressobj(0, zlib.DEFLATED, 31)
        at.append(len(data))
        data += c.compress(rec) + c.flush()
    (tmp_path / "x.warc.gz").write_bytes(data)
    for split in (1, 50, 333, 10**6):
        got = [a for s in range(0, len(data), split) for a, _ in warc.records(f"file://{tmp_path}/x.warc.gz", s, s + split)]
        assert got == at


def test_damage_is_an_error_whatever_the_ranges(tmp_path):
    data, at = b"", []
    for i in range(6):
        body = bytes(random.Random(i).choices(range(97, 123), k=300))
        at.append(len(data))
        data += warc.member(warc.record("response", f"urn:x-page:{i}", None, hashlib.sha1(body).hexdigest(), body, len(body), "d"))
    for k in range(6):
        for where in (0, 1, 40):
            hurt = bytearray(data)
            hurt[at[k] + where] ^= 0xFF
            (tmp_path / "x.warc.gz").write_bytes(hurt)
            for split in (1, 50, at[1], at[3], 10**6):
                with pytest.raises(ValueError, match=f"byte {at[k]}|byte {at[k - 1] if k else 0}"):
                    for s in range(0, len(data), split):
                        list(warc.records(f"file://{tmp_path}/x.warc.gz", s, s + split))


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    uri = f"file://{tmp_path}/d"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "part-000000-0007.0123.tmp").write_bytes(b"half a file")
    warc.write_archives(warc.with_revisits(spark.createDataFrame(pages(), SCHEMA)), uri)
    assert warc.read_archives(spark, uri).count() == len(pages())
    assert all(f.suffix == ".gz" for f in (tmp_path / "d").iterdir())


def test_empty(spark, tmp_path):
    uri = f"file://{tmp_path}/c"
    warc.write_archives(warc.with_revisits(spark.createDataFrame([], SCHEMA)), uri)
    assert warc.read_archives(spark, uri).count() == 0
