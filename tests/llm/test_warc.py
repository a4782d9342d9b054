import gzip
import hashlib
import io
import uuid

import duckdb
import pandas as pd
import pytest

from coterie.llm import warc
from coterie.llm.base import shared_dir

BIG = "<p>" + "é" * 600 + "</p>"
ROWS = [
    (1, "http://a.com/", BIG, "x"), (5, "http://b.com/", BIG, "y"), (3, "http://c.com/\r\nWARC-Type: fake", BIG, None), (2, "http://d.com/", "short", "x"), (4, "http://e.com/", "short", "x"),
    (6, None, None, "x"), (7, "", "", "x"), (8, "http://f.com/ WARC-Type: no", "x" * 1000, "x"), (9, "http://f.com/", "x" * 1000, "x"), (10, "http://f.com/", "y" * 999, "x"), (11, "http://f.com/", "y" * 999, "x"),
    (12, "http://big.com/", "long\r\n\r\nWARC/1.1 " * 200_000, "x"), (-4, "http://g.com/", "z" * 3000, "x"), (-9, "http://g.com/", "z" * 3000, "x"),
]
SCHEMA = "page_id long, url string, html string, header string"


def place(spark):
    return f"{shared_dir(spark)}/test-warc-{uuid.uuid4().hex}"


def want(rows):
    owner, out = {}, []
    for i, _, html, _ in rows:
        if i is not None:
            owner[html or ""] = max(owner.get(html or "", i), i)
    for i, _, html, _ in rows:
        data = (html or "").encode()
        first = owner.get(html or "")
        shared = len(data) >= 1000 and first is not None and i != first
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if shared else "response", first if shared else None))
    return sorted(out, key=str)


def digest_rows(df):
    return sorted([(r.page_id, len(r.payload), hashlib.sha1(bytes(r.payload)).hexdigest(), r.record_type, r.refers_to) for r in df.collect()], key=str)


def members(stream):
    """(headers, block) of the records in a WARC file, read by their lengths alone."""
    while line := stream.readline():
        assert line == b"WARC/1.1\r\n"
        head = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.rstrip(b"\r\n").partition(b": ")
            assert name not in head
            head[name.decode()] = value.decode()
        block = stream.read(int(head["Content-Length"]))
        assert stream.read(4) == b"\r\n\r\n"
        yield head, block


def test_round_trip(spark):
    path = place(spark)
    warc.write_archive(spark.createDataFrame(ROWS, SCHEMA).repartition(4), path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in ROWS})
    back = warc.read_records(spark, path)
    assert digest_rows(back) == want(ROWS)
    # an independent reader of the bytes, as they would stand in a compressed file
    rows = back.collect()
    packed = b"".join(gzip.compress(bytes(r.record)) for r in rows)
    found = list(members(io.BytesIO(gzip.decompress(packed))))
    assert len(found) == len(ROWS)
    html = {i: (h or "").encode() for i, _, h, _ in ROWS}
    ids = {head["WARC-Record-ID"] for head, _ in found}
    for r, (head, block) in zip(rows, found, strict=True):
        http, _, payload = block.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and f"Content-Length: {len(html[r.page_id])}".encode() in http
        assert payload == (b"" if r.record_type == "revisit" else html[r.page_id]) and bytes(r.payload) == html[r.page_id]
        assert head["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(html[r.page_id]).hexdigest()
        assert (head["WARC-Type"], head["WARC-Record-ID"]) == (r.record_type, r.record_id)
        assert ("WARC-Refers-To" in head) == (r.record_type == "revisit") and head.get("WARC-Refers-To", r.record_id) in ids
    assert {r.page_id: r.url for r in rows}[3] == "http://c.com/%0D%0AWARC-Type: fake"


def test_nulls_and_repeated_rows(spark):
    rows = [(None, "u", BIG, ""), (4, "u", BIG, ""), (4, "u", BIG, ""), (2, "u", BIG, ""), (2, "u", BIG, ""), (None, "u", "q" * 2000, ""), (None, "v", "q" * 2000, "")]
    path = place(spark)
    warc.write_archive(spark.createDataFrame(rows, SCHEMA), path)
    assert digest_rows(warc.read_records(spark, path)) == want(rows)
    empty = place(spark)
    warc.write_archive(spark.createDataFrame([], SCHEMA), empty)
    assert warc.read_records(spark, empty).count() == 0


def test_a_third_in_one_payload(spark):
    rows = [(i, f"http://h.org/{i}", BIG if i % 3 == 0 else f"{i}" * 400, "") for i in range(1500)]
    path = place(spark)
    warc.write_archive(spark.createDataFrame(rows, SCHEMA).repartition(8), path)
    assert digest_rows(warc.read_records(spark, path)) == want(rows)


def test_changed_payload_is_found(spark):
    path = place(spark)
    warc.write_archive(spark.createDataFrame(ROWS[:4], SCHEMA), path)
    spark.read.parquet(f"{path}/payloads").selectExpr("address", "concat(payload, X'20') payload").write.parquet(f"{path}/changed/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}/changed/records")
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_records(spark, f"{path}/changed").collect()


def test_sql_on_edges(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/pages.parquet")
    got = sorted(map(tuple, warc.op11_warc_archive(spark, f"file://{tmp_path}").collect()), key=str)
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(ROWS, columns=["page_id", "url", "html", "header"]))
    assert got == sorted(con.execute(warc.OP11_ORACLE).fetchall(), key=str) == want(ROWS)
