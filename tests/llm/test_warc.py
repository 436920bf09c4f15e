import gzip
import hashlib
import random
from pathlib import Path

from quern.llm import warc as A
from quern.llm.common import fresh_path


def records(n):
    out = []
    for i in range(n):
        body = f"<html>{i} é {'x' * (i * 50)}</html>".encode()
        out.append(A.format_record(i, f"http://h/{i}", body, hashlib.sha256(body).hexdigest(), None))
    return out


def ids(data):
    return [(x[5]["warc-record-id"].rsplit(":", 1)[1].rstrip(">") if x[0] == "record" else "gap") for x in A.salvage(data)]


def test_round_trip_by_query(spark):
    big = "é" * 80
    rows = [(5, "u5", big), (3, "u3", big), (9, "u9", big), (1, None, None), (2, "u2", ""), (4, "u\r\n4", "same"), (6, "u6", "same"), (7, "u7", "WARC/1.1\r\n\r\n" * 30), (None, "n", "q" * 200), (3, "u3", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = fresh_path(spark, "archives")
    A.write_archives(df, path)
    found = A.read_archives(spark, path)
    assert A.gaps(found).count() == 0
    got = sorted((tuple(r) for r in A.page_records(found).collect()), key=str)
    want = []
    for p, _, h in rows:
        body = (h or "").encode()
        later = len(body) >= 100 and h == big and p != 3
        want.append((p, len(body), hashlib.sha256(body).hexdigest(), "revisit" if later else "response", 3 if later else None))
    assert got == sorted(want, key=str)
    payloads = {r["record_id"]: bytes(r["payload"]) for r in found.where("record_type = 'response'").collect()}
    assert payloads[f"{A.ID_URI}3"] == big.encode() and payloads[f"{A.ID_URI}1"] == b""
    A.write_archives(df.limit(0), path + "2")
    assert A.read_archives(spark, path + "2").count() == 0


def test_archive_is_plain_gzip():
    parts = [A.gzip_member(r) for r in records(3)]
    data = A.EMPTY_MEMBER.encode("latin-1").join(parts)
    assert gzip.decompress(data) == b"".join(records(3))


def test_salvage_after_damage_in_members():
    parts = [A.gzip_member(r) for r in records(6)]
    bad = bytearray(parts[2])
    bad[len(bad) // 2] ^= 0xFF
    cut = parts[4][:-5]
    data = b"".join([parts[0], parts[1], bytes(bad), parts[3], cut, parts[5], b"tail junk"])
    # The cut member lacks its checksum only: its record agrees with its digests and is kept.
    assert ids(data) == ["0", "1", "gap", "3", "4", "gap", "5", "gap"]
    gaps = [(x[1], x[2]) for x in A.salvage(data) if x[0] == "gap"]
    at = len(parts[0]) + len(parts[1])
    assert gaps[0] == (at, at + len(bad)) and gaps[-1] == (len(data) - 9, len(data))


def test_salvage_of_plain_records():
    r = records(4)
    wrong = r[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    false = r[2].replace(b"</html>", b"</hXml>")
    assert ids(b"".join([b"garbage", r[0], wrong, false, r[3]])) == ["gap", "0", "gap", "3"]
    assert ids(b"") == [] and ids(b"\x1f\x8b\x08WARC/1.") == ["gap"]
    assert ids(r[0] + A.gzip_member(r[1]) + r[2]) == ["0", "1", "2"]


def test_salvage_inside_a_member():
    r = records(5)
    false = r[2].replace(b"</html>", b"</hXml>")
    data = A.gzip_member(b"".join([r[0], r[1], false, r[3], r[4]]))
    assert ids(data) == ["0", "1", "gap", "3", "4"]
    inner = [(x[3], x[4]) for x in A.salvage(data) if x[0] == "gap"]
    assert inner == [(len(r[0]) + len(r[1]), len(r[0]) + len(r[1]) + len(false))]
    # A stream that breaks off keeps what came before; a record without a digest is kept from whole members only.
    long = A.gzip_member(b"".join(records(30)))
    assert ids(long[: len(long) * 2 // 3])[:5] == ["0", "1", "2", "3", "4"] and ids(long[: len(long) * 2 // 3])[-1] == "gap"
    bare = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:7>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert ids(A.gzip_member(bare)) == ["7"] and ids(A.gzip_member(bare)[:-4]) == ["gap"]


def test_damage_is_read_in_linear_time():
    marks = (A.MEMBER + A.VERSION + b"x") * 60_000
    assert ids(marks + records(1)[0]) == ["gap", "0"]


def test_bytes_of_an_archive(spark, monkeypatch):
    """Spark puts the members down as they are: no byte is re-encoded, and the files are bounded."""
    monkeypatch.setattr(A, "RUN_BYTES", 2000)
    monkeypatch.setattr(A, "FILE_RUNS", 3)
    r = random.Random(2)
    rows = [(i, None, "".join(chr(r.choice([65, 233, 0x4E2D, 0x1F600, 10, 13])) for _ in range(900))) for i in range(60)] + [(99, "u", "z" * 3_000_000)]
    path = fresh_path(spark, "archives")
    A.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    files = [f.read_bytes() for f in Path(path.removeprefix("file://")).glob("part-*")]
    assert len(files) > 5 and max(map(len, files)) < 30_000
    content = b"".join(gzip.decompress(f) for f in files)
    want = [A.format_record(i, u, h.encode(), hashlib.sha256(h.encode()).hexdigest(), None) for i, u, h in rows]
    assert len(content) == sum(map(len, want)) and all(w in content for w in want[:20])
    big = A.read_archives(spark, path).where(f"record_id = '{A.ID_URI}99'").first()
    assert big["payload_bytes"] == 3_000_000 and bytes(big["payload"]) == b"z" * 3_000_000


def test_ties_of_null_ids(spark):
    rows = [(None, None, "w" * 150, 1), (None, None, "w" * 150, 1)]
    path = fresh_path(spark, "archives")
    A.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, digest int"), path)
    assert [r["record_type"] for r in A.page_records(A.read_archives(spark, path)).collect()] == ["response"] * 2


def test_damaged_file_in_spark(spark, tmp_path):
    parts = [A.gzip_member(r) for r in records(3)]
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + b"\x00" * 33 + parts[1])
    (tmp_path / "b.warc.gz").write_bytes(b"nothing at all")
    found = A.read_archives(spark, str(tmp_path))
    assert sorted((r["end"] - r["start"]) for r in A.gaps(found).collect()) == [14, 33]
    assert found.where("kind = 'record'").count() == 2
