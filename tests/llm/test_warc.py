"""Legacy archives, their conversion and the WARC files read back."""

import base64
import gzip
import hashlib
import zlib

import pytest

from qaspark.llm import warc
from qaspark.session import checkpoint_path

V1 = b"filedesc://a.arc 0.0.0.0 19970101000000 text/plain 76\n1 0 someone\nURL IP-address Archive-date Content-type Archive-length\n\n\n\n\n"
BIG, SMALL = b"<p>" + b"same page " * 150, b"short"


def http(payload, extra=b"", end=b"\r\n"):
    return b"HTTP/1.0 200 OK" + end + b"Content-Type: text/html" + end + extra + end + payload


def v1(records, about=V1):
    head = about.split(b"\n")[1:]
    body = b"\n".join(head)
    out = b"filedesc://a.arc 0.0.0.0 19970101000000 text/plain %d\n" % len(body) + body
    for url, date, mime, doc in records:
        out += b"\n%s 192.0.2.7 %s %s %d\n" % (url, date, mime, len(doc)) + doc
    return out + b"\n"


def v2(records):
    body = b"2 0 someone\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n\n"
    out = b"filedesc://b.arc 0.0.0.0 19980101000000 text/plain 200 - - 0 b.arc %d\n" % len(body) + body
    for url, date, mime, doc in records:
        out += b"\n%s 192.0.2.8 %s %s 200 - - %d b.arc %d\n" % (url, date, mime, len(out) + 1, len(doc)) + doc
    return out + b"\n"


RECORDS = [(b"http://x.org/a page", b"19970101000001", b"text/html", http(BIG)),
           (b"http://x.org/b", b"19970101000002", b"text/html", http(b"a\n\nhttp://no.header 1.2.3.4 19970101000000 text/html 5\nxx\r\n\r\nWARC/1.1\r\n", end=b"\n")),
           (b"dns:x.org", b"19970101000003", b"text/dns", b"x.org. 60 IN A 192.0.2.7\n"),
           (b"http://x.org/empty", b"19970101000004", b"text/html", b""),
           (b"http://x.org/raw", b"19970101000005", b"image/gif", http(bytes(range(256)) * 3)),
           (b"http://x.org/small", b"19970101000006", b"text/html", http(SMALL)), (b"http://x.org/small", b"19970101000007", b"text/html", http(SMALL)),
           (b"http://x.org/large", b"19970101000008", b"text/html", http(b"L" * 3_000_000)),
           (b"http://x.org/c", b"19970101000009", b"text/html", http(BIG))]


def test_both_versions_are_parsed_by_declared_length():
    for archive, version in ((v1(RECORDS), 1), (v2(RECORDS), 2)):
        zipped = gzip.compress(archive[:200]) + gzip.compress(archive[200:])
        for content in (archive, gzip.compress(archive), zipped):
            got = list(warc.parse_arc("f", content))
            assert len(got) == len(RECORDS) + 1 and not any(r[9] for r in got)
            for r, (url, date, mime, doc) in zip(got[1:], RECORDS):
                assert (r[2], r[3], r[5], r[6], r[-1]) == (version, url.decode(), date.decode(), mime.decode(), doc)
                assert archive[r[1]:].startswith(url)


def test_damaged_archives():
    cut = list(warc.parse_arc("f", v1(RECORDS[:2])[:-30]))
    assert [r[9] for r in cut] == [False, False, True] and cut[-1][8] == len(RECORDS[1][3])
    lost = list(warc.parse_arc("f", v1(RECORDS[:1]) + b"no header line\nmore\n" + RECORDS[1][3]))
    assert [r[9] for r in lost] == [False, False, True] and lost[-1][-1] == b"no header line"
    assert list(warc.parse_arc("f", b"")) == [] and list(warc.parse_arc("f", b"\n\n")) == []


def converted(spark, archives, **how):
    folder = checkpoint_path(spark, "test-warc")
    d = spark.createDataFrame([(p, c, "x") for p, c in archives], "path string, content binary, url string").repartition(3)
    warc.write_warc(warc.convert(d, **how), folder)
    return folder, warc.read_warc(spark, folder).collect()


def test_conversion_keeps_what_the_archives_hold(spark):
    archives = [("a.arc", v1(RECORDS)), ("b.arc", v2(RECORDS)), ("c.arc.gz", gzip.compress(v1(RECORDS[:1])[:-900])), ("d.arc", b""), ("e.arc", None)]
    folder, rows = converted(spark, archives)
    assert len({r.record_id for r in rows}) == len(rows) == 2 * (len(RECORDS) + 1) + 1  # the cut record of c.arc is left out
    by_date = {}
    for r in rows:
        by_date.setdefault((r.date, r.target_uri), []).append(r)
    for url, date, mime, doc in RECORDS:
        d = date.decode()
        two = by_date[f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z", url.decode()]
        head, payload = warc.split_http(doc) if doc.startswith(b"HTTP/") else (b"", doc)
        assert len(two) == 2 and {r.payload_sha1 for r in two} == {hashlib.sha1(payload).hexdigest()}
        kinds = sorted(r.record_type for r in two)
        assert kinds == (["resource"] * 2 if not head else ["response"] * 2 if len(payload) < warc.LEAST_BYTES else ["response", "revisit"] if url != RECORDS[0][0] else ["revisit"] * 2)
        for r in two:
            assert r.http_headers == head and r.payload == (None if r.record_type == "revisit" else payload)
            assert r.content_type == ("application/http; msgtype=response" if head else mime.decode())
    # of four records with this payload the last by path and place stays
    stay = [r for r in rows if r.payload == BIG]
    again = [r for r in rows if r.record_type == "revisit" and r.payload_sha1 == hashlib.sha1(BIG).hexdigest()]
    assert len(stay) == 1 and len(again) == 3 and {r.refers_to for r in again} == {stay[0].record_id}
    assert stay[0].target_uri == "http://x.org/c"
    # the same archives give the same records
    assert sorted(converted(spark, archives[::-1])[1], key=lambda r: r.record_id)[0].record_id == min(r.record_id for r in rows)
    # files are gzip, records end as WARC has it, digests are there
    text = b"".join(zlib.decompress(r.content, 31) for r in spark.read.format("binaryFile").load(folder).collect())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n")
    assert b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(BIG).digest()) in text and b"WARC-Type: warcinfo" in text


def test_files_that_are_not_warc(spark):
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parse_warc("f", b"HTTP/1.1 200 OK\r\n\r\n"))
    good = warc.warc_record("p", 1, "http://x", "1.2.3.4", "19970101000000", "text/html", http(SMALL), None) + b"\r\n\r\n"
    assert [r[8] for r in warc.parse_warc("f", good)] == [SMALL]
    with pytest.raises(ValueError, match="digest"):
        list(warc.parse_warc("f", good.replace(SMALL, b"other")))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse_warc("f", good[:-8]))


def test_pages_by_way_of_archives(spark, monkeypatch):
    big = "é" * 600
    rows = [(1, "u", big), (2, None, big), (3, "a b\n", "x" * 999), (4, "", "x" * 999), (5, "http://x", None), (6, "u", ""), (None, "u", big), (7, "u", "y" * 1000), (8, "u", "y" * 1000),
            (-9, "u", "y" * 1000), (10, "u", "X-Page-Id: 77\r\n\r\n" + "z" * 2000), (11, "u", "q" * 300_000), (11, "u", "q" * 300_000)] + [(100 + i, "u", "copy " * 400) for i in range(300)]
    monkeypatch.setattr(warc, "SHARED", 1)
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, own string, at int").repartition(4)
    got = sorted(map(tuple, warc.page_records(d).collect()), key=str)
    last, want, seen = {}, [], set()
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -100), -100 if i is None else i)
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and (last[h] != i or (i, h) in seen)
        seen.add((i, h))
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[h] if again else None))
    assert got == sorted(want, key=str)
    assert warc.page_records(d.where("false")).count() == 0
