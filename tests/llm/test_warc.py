import gzip
import hashlib
import io
import json
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import queries, warc

SCHEMA = "page_id long, url string, html string, digest string, payload string, archive string"


def record(body: bytes, kind: str = "resource", **more: str) -> bytes:
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:x:{len(body)}>", **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": str(len(body))}
    return warc.header_bytes("WARC/1.0", list(fields.items())) + body + b"\r\n\r\n"


def normalised(data: bytes) -> tuple[bytes, list[dict]]:
    out = io.BytesIO()
    index = list(warc.normalise_stream(io.BytesIO(data), out))
    return out.getvalue(), index


bodies = st.lists(st.one_of(st.binary(max_size=300), st.sampled_from([b"", b"\r\n\r\n", b"WARC/1.0\r\n\r\n", b"\r\n\r\nx" * 9, b"z" * 600_000])), max_size=8)


@settings(max_examples=60, deadline=None)
@given(bodies, st.lists(st.integers(0, 8), max_size=3), st.sampled_from([5, 1 << 18]))
def test_each_record_becomes_a_member(bodies, cuts, chunk):
    """One stream, or several that are cut anywhere between records, read in chunks of any size."""
    old, warc.CHUNK = warc.CHUNK, chunk
    try:
        records = [record(b) for b in bodies]
        cuts = sorted({0, len(records), *[c for c in cuts if c < len(records)]})
        data = b"".join(gzip.compress(b"".join(records[a:b])) for a, b in zip(cuts, cuts[1:])) + b"\0" * len(cuts)
        out, index = normalised(data)
    finally:
        warc.CHUNK = old
    assert gzip.decompress(out or gzip.compress(b"")) == b"".join(records)
    assert [e["offset"] for e in index] == [sum(e["length"] for e in index[:i]) for i in range(len(index))] and sum(e["length"] for e in index) == len(out)
    assert [zlib.decompress(out[e["offset"] :][: e["length"]], warc.GZIP) for e in index] == records
    again, index_again = normalised(out)
    assert (again, index_again) == (out, index)


def test_odd_archives():
    plain = b"WARC/1.0\nWARC-Type: resource\nContent-Length: 3\n\nabc\n\n\n\n" + record(b"x", WARC_Target_URI="http://a\r\n /b")
    out, index = normalised(gzip.compress(plain))
    assert [zlib.decompress(out[e["offset"] :][: e["length"]], warc.GZIP)[-7:] for e in index] == [b"abc\r\n\r\n", b"\r\n" + b"x\r\n\r\n"] and index[1]["uri"] == "http://a /b"
    whole = gzip.compress(record(b"abc" * 100))
    for bad, error in ((whole[:-9], EOFError), (whole + b"junk", ValueError), (gzip.compress(b"no record\r\n\r\n"), ValueError), (gzip.compress(b"WARC/1.0\r\nContent-Length: x\r\n\r\n"), ValueError), (gzip.compress(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc"), EOFError), (gzip.compress(b"WARC/1.0\r\nCon"), EOFError)):
        with pytest.raises(error):
            normalised(bad)
    assert normalised(b"") == (b"", [])


def written(spark, rows, tmp, **options):
    df = spark.createDataFrame([(*r, "q", "q", "q") for r in rows], SCHEMA).repartition(3)
    archives = warc.write_archives(df, f"file://{tmp}/whole", **options)
    done = warc.normalise(archives, f"file://{tmp}/whole", f"file://{tmp}/members")
    return archives, done, warc.read_records(warc.read_index(spark, done, f"file://{tmp}/members"), f"file://{tmp}/members", stretch=500)


A, B, SHORT, LONG = "a" * 100, "é" * 50, "s" * 99, "long " * 400_000
ROWS = [
    (5, "http://h/1", A), (3, "http://h/2", A), (9, None, A), (None, "http://h/n", A), (3, "http://h/2", A),
    (1, "http://h/ü\r\nX: y", B), (2, "", B), (7, "u", SHORT), (8, "u", SHORT), (10, "u", None), (11, None, ""), (12, "u", LONG), (13, "u", LONG), (None, None, "n" * 200), (None, None, "n" * 200),
    (14, "u", "\r\n\r\nWARC/1.1\r\n\r\n\x00"),
]


def want_of(rows):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        again = len(payload) >= 100 and bool(same) and page != min(same)
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", min(same) if again else None, None if again else payload))
    return sorted(out, key=repr)


def test_round_trip_of_awkward_rows(spark, tmp_path):
    """Null and repeated ids, null and odd URLs, null, empty, very long and equal payloads, clashing columns, several archives."""
    archives, done, records = written(spark, ROWS, tmp_path, archive_bytes=1000)
    rows = records.collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in rows), key=repr) == want_of(ROWS)
    assert archives.count() > 3 and done.agg({"records": "sum"}).first()[0] == len(ROWS)
    for r in done.collect():  # readable by others: gzip members in a row, and an index that leads to each
        data = (tmp_path / "members" / r["archive"]).read_bytes()
        index = [json.loads(x) for x in (tmp_path / "members" / r["sidecar"]).read_text().splitlines()]
        assert len(data) == r["bytes"] and len(index) == r["records"] and gzip.decompress(data).count(b"WARC-Record-ID") == r["records"]
        assert gzip.decompress((tmp_path / "whole" / r["source"]).read_bytes()) == gzip.decompress(data)
        assert all(data[e["offset"] :].startswith(b"\x1f\x8b") and "\n" not in e["uri"] for e in index)
    for r in archives.collect():  # the archives before are one stream each
        stream = zlib.decompressobj(warc.GZIP)
        stream.decompress((tmp_path / "whole" / r["archive"]).read_bytes())
        assert stream.eof and not stream.unused_data


def test_files_of_lost_tasks_are_not_read(spark, tmp_path):
    _, done, records = written(spark, ROWS[:3], tmp_path)
    n = records.count()
    (tmp_path / "members" / "lost.warc.gz").write_bytes(b"cut")
    (tmp_path / "members" / "lost.warc.gz.index").write_text('{"offset": 0, "length": 3}\n')
    index = warc.read_index(spark, done, f"file://{tmp_path}/members")
    assert index.count() == n and warc.read_records(index, f"file://{tmp_path}/members").count() == n


def test_empty(spark, tmp_path):
    archives, done, records = written(spark, [], tmp_path)
    assert archives.count() == done.count() == records.count() == 0


def test_query_with_copies_against_sql(spark, small, tmp_path):
    """The given pages are all different: the query is held against its SQL on them and on a table with copies."""
    pages = spark.read.parquet(f"{small}/pages.parquet")
    more = spark.createDataFrame([(100_000 + i, u, h) for i, (_, u, h) in enumerate(ROWS)], "page_id long, url string, html string").unionByName(pages.selectExpr("page_id + 50000 as page_id", "url", "if(page_id % 3 = 0, html, 'own') as html"))
    pages.unionByName(more).write.parquet(f"{tmp_path}/pages.parquet")
    for folder, revisits in ((small, False), (str(tmp_path), True)):
        got = queries.op11_warc(spark, folder)
        db = duckdb.connect()
        db.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet' || '{'/*.parquet' if revisits else ''}')")
        sql = db.sql(queries.ORACLES["op11_warc"])
        rows = [tuple(r[c] for c in sql.columns) for r in got.collect()]
        assert sorted(rows, key=repr) == sorted(sql.fetchall(), key=repr)
        assert any("revisit" in r for r in rows) == revisits
