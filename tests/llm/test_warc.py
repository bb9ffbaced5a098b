import base64
import gzip
import hashlib
import random

import duckdb
import pyarrow as pa
import pytest

from latticeworks.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first int, n_bytes string"


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def pages():
    rng = random.Random(6)
    long = "".join(rng.choice("<p>é \r\n") for _ in range(300_000))
    texts = ["<html>one</html>", "<html>two</html>", None, "", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "\r\n\r\n", long, "<html>one</html>", "<html>one</html>", long]
    return [(i, f"http://x/{i}" if i % 3 else None, t, "d", 1, "n") for i, t in enumerate(texts)]


def plain(rows, least=0):
    first = {}
    for i, _, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, _, t, *_ in rows:
        raw, own = (t or "").encode(), first.get(t or "")
        again = len(raw) >= least and own is not None and i != own
        out.append((i, len(raw), sha(raw), "revisit" if again else "response", own if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 17])
def test_round_trip(spark, tmp_path, least):
    rows = pages()
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), f"{tmp_path}/a", least, per_file=2)
    read = warc.read_archives(spark, f"{tmp_path}/a").cache()
    assert read.where("gap IS NOT NULL").isEmpty() and read.select("path").distinct().count() >= 5
    found = warc.resolved(read).collect()
    assert sorted(((int(r.page), r.payload_bytes, r.payload_digest, r.record_type, None if r.target_page is None else int(r.target_page)) for r in found), key=str) == plain(rows, least)
    bodies = {int(r.headers["x-page-id"]): bytes(r.payload) for r in read.where("record_type = 'response'").collect()}
    assert all(bodies[i] == (rows[i][2] or "").encode() for i in bodies)


def test_query_and_its_sql(spark, tmp_path):
    rows = pages()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    out = warc.op13_warc(spark, str(tmp_path))
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain(rows)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(db.sql(warc.OP13_SQL).fetchall(), key=str) == plain(rows)
    assert out.dtypes == [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]


def test_null_and_repeated_ids_and_empty(spark, tmp_path):
    rows = [(None, None, "a", "", 1, ""), (None, "u", "b", "", 1, ""), (3, "a\r\nb: c", "b", "", 1, ""), (3, "u", "b", "", 1, ""), (7, "u", "b", "", 1, "")]
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/a")
    found = [(r.page, r.record_type, r.target_page) for r in warc.resolved(warc.read_archives(spark, f"{tmp_path}/a")).collect()]
    assert sorted(found, key=str) == sorted([(None, "response", None), (None, "revisit", "3"), ("3", "response", None), ("3", "response", None), ("7", "revisit", "3")], key=str)
    warc.write_archives(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0


def record(n, payload, extra=b""):
    return b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:%d>\r\nWARC-Payload-Digest: sha1:%s\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, sha(payload).encode(), extra, len(payload), payload)


def rows_of(data, payloads=True):
    out = list(warc.salvage(pa.BufferReader(data), payloads))
    at = 0
    for r in out:  # the rows cover the file
        if r["offset"] != at:
            assert out[out.index(r) - 1]["offset"] == r["offset"]
        at = r["offset"] + r["length"]
    assert at == len(data)
    return [("gap", r["offset"], r["length"]) if "gap" in r else int(r["record_id"][7:-1]) for r in out]


def test_salvage_plain():
    parts = [record(k, bytes([65 + k]) * 50) for k in range(6)]
    whole = b"".join(parts)
    assert rows_of(whole) == [0, 1, 2, 3, 4, 5] and rows_of(b"") == []
    start = [len(b"".join(parts[:k])) for k in range(7)]
    gap = lambda i, j: ("gap", start[i], start[j] - start[i])
    flip = bytearray(whole)
    flip[start[3] - 10] ^= 1  # a byte of the payload: its digest does not match
    assert rows_of(bytes(flip)) == [0, 1, gap(2, 3), 3, 4, 5]
    short = whole.replace(b"Content-Length: 50\r\n\r\n" + b"B" * 50, b"Content-Length: 9999999\r\n\r\n" + b"B" * 50)
    assert [r if isinstance(r, int) else "gap" for r in rows_of(short)] == [0, "gap", 2, 3, 4, 5]
    assert rows_of(whole[: start[4] + 30]) == [0, 1, 2, 3, ("gap", start[4], 30)]
    assert rows_of(b"junk WARC/ junk" + whole)[0] == ("gap", 0, 15)
    assert [r for r in rows_of(whole[: start[2]] + b"\0" * 3_000_000 + whole[start[2] :])] == [0, 1, ("gap", start[2], 3_000_000), 2, 3, 4, 5]
    assert rows_of(b"WARC/1.0\r\n" * 2000) == [("gap", 0, 20_000)]
    nested = record(7, record(8, b"inner"))
    assert rows_of(nested) == [7]


def test_salvage_members():
    parts = [gzip.compress(record(k, random.Random(k).randbytes(400) + b"x" * 2000)) for k in range(5)]
    whole = b"".join(parts)
    start = [len(b"".join(parts[:k])) for k in range(6)]
    assert rows_of(whole) == [0, 1, 2, 3, 4]
    flip = bytearray(whole)
    flip[start[2] + 200] ^= 0xFF
    assert rows_of(bytes(flip)) == [0, 1, ("gap", start[2], start[3] - start[2]), 3, 4]
    assert rows_of(whole[: start[4] + 100]) == [0, 1, 2, 3, ("gap", start[4], 100)]
    assert rows_of(whole[5:]) == [("gap", 0, start[1] - 5), 1, 2, 3, 4]
    mixed = parts[0] + record(9, b"plain") + gzip.compress(b"not a record") + parts[1] + gzip.compress(record(3, b"a") + record(4, b"b"))
    assert [r if isinstance(r, int) else "gap" for r in rows_of(mixed)] == [0, 9, "gap", 1, 3, 4]


def test_damaged_files_in_a_folder(spark, tmp_path):
    good, bad = b"".join(record(k, b"p%d" % k) for k in range(3)), b"??" + record(3, b"p3") + b"tail"
    (tmp_path / "one.warc").write_bytes(good)
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(record(5, b"p5")) + bad)
    (tmp_path / "void.warc").write_bytes(b"")
    read = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.payload) for r in read if r.gap is None) == [b"p0", b"p1", b"p2", b"p3", b"p5"]
    assert sorted(r.length for r in read if r.gap) == [2, 4] and all(r.path.endswith("two.warc.gz") for r in read if r.gap)
