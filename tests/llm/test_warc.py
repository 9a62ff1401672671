import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from ledgerloom.llm import warc
from ledgerloom.llm.warc import FIELDS, arc_archive, convert, parse_arc, parse_warc, pages_to_arc, revisits, round_trip, write_warc

SCHEMA = "page_id long, url string, html string, uri string, digest string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_both_versions_are_read_by_their_declared_fields():
    entries = [("http://a.b/ c", b"x\n\ny"), ("http://d", b"")]
    for version in FIELDS:
        data = arc_archive("name", version, entries)
        got = list(parse_arc(data))
        assert [(r.uri, r.body) for r in got[1:]] == [("http://a.b/%20c", b"x\n\ny"), ("http://d", b"")]
        assert got[0].uri == "filedesc://name.arc" and got[0].body.startswith(f"{version} 0".encode())
        with pytest.raises(ValueError, match="beyond the end"):
            list(parse_arc(data[:-3].replace(b" 4\nx", b" 99\nx")))
    # A blank inside a url of a foreign archive: the other fields count from the right.
    foreign = arc_archive("n", 1, [("http://e", b"body")]).replace(b"http://e ", b"http://e f ")
    assert list(parse_arc(foreign))[1].uri == "http://e f"


def test_round_trip_equals_plain_digests(spark):
    rows = [(i, f"http://h/{i}", f"<p>é {i % 7}</p>\r\n\r\nWARC/1.1", "u", "d") for i in range(60)] + [(100, None, None, None, None), (101, "http://a b\n", "", "u", "d"), (102, "http://x", "ß" * 3_000_000, "u", "d"), (None, "http://y", "<p>é 1</p>\r\n\r\nWARC/1.1", "u", "d")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in round_trip(df).collect()}
    first = {}
    for i, _, html, _, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", i)
    want = {i: (len((h or "").encode()), digest(h), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h, _, _ in rows}
    assert got == want
    assert {r.record_type for r in round_trip(df.where("page_id < 30"), min_bytes=1000).collect()} == {"response"}
    assert round_trip(df.where("false")).collect() == []


def test_files_are_warc_archives(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", "same" if i < 5 else f"page {i}", "", "") for i in range(9)] + [(3, "http://h/3", "same", "", "")], SCHEMA).coalesce(1)
    records = convert(pages_to_arc(df))
    write_warc(records, revisits(records), str(tmp_path / "out"))
    kinds, ids, refers = [], set(), set()
    for file in sorted(Path(tmp_path / "out").glob("*.gz")):
        parts = list(parse_warc(gzip.decompress(file.read_bytes())))
        assert parts[0][0]["WARC-Type"] == "warcinfo"
        for fields, block in parts:
            kinds.append(fields["WARC-Type"])
            ids.add(fields["WARC-Record-ID"])
            refers |= {fields[k] for k in ("WARC-Refers-To",) if k in fields}
            if fields["WARC-Type"] == "response":
                assert fields["WARC-Date"] == "2024-01-01T00:00:00Z" and digest(block.split(b"\r\n\r\n", 1)[1].decode()) == fields["WARC-Payload-Digest"][5:]
    assert kinds.count("response") == 5 and kinds.count("revisit") == 5 and len(refers) == 1 and refers <= ids and len(ids) == len(kinds)


def test_repeated_pages_in_equal_partitions(spark):
    one = spark.createDataFrame([(i, f"http://h/{i}", "same" if i < 3 else f"page {i}", "", "") for i in range(6)], SCHEMA).coalesce(1)
    for df in (one.union(one), one.union(one).repartition(3, "url"), one.union(one).union(one).orderBy("html")):
        rows = round_trip(df).collect()
        copies = len(rows) // 6
        assert len(rows) == df.count() and all(sum(r.page_id == i for r in rows) == copies for i in range(6))
        responses = [r for r in rows if r.record_type == "response"]
        assert sorted(r.page_id for r in responses) == [0, 3, 4, 5] and len({r.payload_digest for r in responses}) == 4
        assert all(r.refers_to == (0 if r.page_id < 3 else r.page_id) for r in rows if r.record_type == "revisit")


def test_files_are_bounded(spark, tmp_path):
    df = spark.createDataFrame([(i, "http://h", f"{i} " + "x" * (5000 if i == 7 else 400), "", "") for i in range(40)], SCHEMA).coalesce(1)
    records = convert(pages_to_arc(df))
    write_warc(records, revisits(records), str(tmp_path / "out"), file_bytes=4000)
    files = [list(parse_warc(gzip.decompress(f.read_bytes()))) for f in Path(tmp_path / "out").glob("*.gz")]
    sizes = [sum(len(block) for _, block in f) for f in files]
    assert len(files) > 5 and all(n <= 4000 or len(f) == 2 for n, f in zip(sizes, files, strict=True)) and all(f[0][0]["WARC-Type"] == "warcinfo" for f in files)
    assert sum(len(f) - 1 for f in files) == 40


def test_wide_rows_are_handed_on_a_few_at_once(spark, monkeypatch):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before, seen, groups = [spark.conf.get(n) for n in names], [], []
    monkeypatch.setattr(warc, "write_warc", lambda *a, _real=write_warc: seen.append([int(spark.conf.get(n)) for n in names]) or _real(*a))
    monkeypatch.setattr(warc, "materialise", lambda *a, _real=warc.materialise, **k: groups.append(k.get("options")) or _real(*a, **k))
    df = spark.createDataFrame([(i, f"http://h/{i}", f"page {i}", "", "") for i in range(30)], SCHEMA).coalesce(1)
    assert round_trip(df).count() == 30
    assert seen == [[warc.BATCH_ROWS] * 2] and groups[0] == {"parquet.block.size": str(warc.GROUP_BYTES)}
    assert [spark.conf.get(n) for n in names] == before
