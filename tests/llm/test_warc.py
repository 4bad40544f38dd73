import base64
import glob
import gzip
import hashlib

import pytest
from pyspark.errors import PySparkException

from stowage.llm import warc

SCHEMA = "page_id bigint, url string, html string"
ROWS = [(1, "http://a/", "same"), (5, "http://b/x y\r\nEvil: 1", "same"), (9, None, "same"), (2, "http://c/", None), (3, "http://d/", ""),
        (4, "http://e/", "é" * 100_000), (7, "http://f/", "WARC/1.1\r\n\r\nContent-Length: 3\r\n"), (8, "http://g/", "one")]


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows, min_bytes=0):
    best = {}
    for page_id, _, html in rows:
        best[html or ""] = max(best.get(html or "", page_id or -1), page_id or -1)
    out = []
    for page_id, _, html in rows:
        text = html or ""
        first = best[text]
        response = len(text.encode()) < min_bytes or (page_id or -1) == first
        out.append((page_id, len(text.encode()), b32(text), "response" if response else "revisit", None if response else first))
    return sorted(out, key=repr)


def found(spark, path):
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[c] for c in columns) for r in warc.records(warc.read_archive(spark, path)).collect()), key=repr)


@pytest.mark.parametrize("min_bytes", [0, 4, 5])
def test_round_trip(spark, tmp_path, min_bytes):
    pages = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS digest", "2 AS payload")
    warc.write_archive(pages, f"{tmp_path}/a", min_bytes)
    assert found(spark, f"{tmp_path}/a") == brute(ROWS, min_bytes)
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == len({r[2] or "" for r in ROWS})


def test_hot_payload_repeats_and_null_ids(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "hot") for i in range(300)] + [(299, "http://h/299", "hot"), (None, "u", "own"), (None, "u", "hot")]
    warc.write_archive(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/a")
    assert found(spark, f"{tmp_path}/a") == brute(rows)


def test_empty(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], SCHEMA), f"{tmp_path}/a")
    assert found(spark, f"{tmp_path}/a") == []


def parsed(data):
    """Records of a WARC file, by their lengths."""
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        assert version == "WARC/1.1" and rest[size : size + 4] == b"\r\n\r\n"
        out.append((fields, rest[:size]))
        data = rest[size + 4 :]
    return out


def test_files_hold_whole_records(spark, tmp_path):
    warc.write_archive(spark.createDataFrame(ROWS, SCHEMA), f"{tmp_path}/a")
    warc.export_warc(warc.read_archive(spark, f"{tmp_path}/a"), f"{tmp_path}/warc")
    records = [r for f in glob.glob(f"{tmp_path}/warc/part-*.gz") for r in parsed(gzip.open(f).read())]
    assert len(records) == len(ROWS)
    html = {f"<urn:x-page:{p}>": (h or "").encode() for p, _, h in ROWS}
    for fields, block in records:
        http, _, payload = block.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK")
        want = html[fields["WARC-Record-ID"]]
        assert fields["WARC-Payload-Digest"] == "sha1:" + b32(want.decode())
        assert payload == (want if fields["WARC-Type"] == "response" else b"")
        assert "Evil" not in fields


def test_damage_is_an_error(spark, tmp_path):
    warc.write_archive(spark.createDataFrame(ROWS, SCHEMA), f"{tmp_path}/a")
    bad = spark.read.parquet(f"{tmp_path}/a/payloads").selectExpr("digest", "CASE WHEN payload = CAST('one' AS BINARY) THEN CAST('two' AS BINARY) ELSE payload END AS payload")
    bad.write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{tmp_path}/a/headers").write.parquet(f"{tmp_path}/b/headers")
    with pytest.raises(PySparkException, match="damaged payload"):
        warc.read_archive(spark, f"{tmp_path}/b").collect()
    bad.where("payload <> CAST('two' AS BINARY)").write.parquet(f"{tmp_path}/c/payloads")
    spark.read.parquet(f"{tmp_path}/a/headers").write.parquet(f"{tmp_path}/c/headers")
    with pytest.raises(PySparkException, match="missing payload"):
        warc.read_archive(spark, f"{tmp_path}/c").collect()
