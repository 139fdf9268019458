import glob
import gzip
import os

import pytest

from hubbub.llm import queries, warc
from hubbub.llm.common import fresh_path

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"
LONG = "alpha beta gamma delta. " * 20_000


def written(spark, rows, schema=PAGES):
    path = fresh_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, schema), path)
    return path


def files(path):
    return sorted(f for f in glob.glob(f"{path.removeprefix('file://')}/part-*") if os.path.getsize(f))


def test_any_payload_reads_back(spark):
    html = [None, "", "x\r\n\r\ny", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "é" * 10, "é" * 10, "", "\r\n\r\n", LONG, "\0" * 9]
    path = written(spark, [(i, "http://a/\r\nX: y" if i else None, h) for i, h in enumerate(html)])
    out = {r.page_id: r for r in warc.resolve(warc.read_warc(spark, path)).collect()}
    assert {i: r.refers_to for i, r in out.items()} == {0: 6, 1: 6, 4: 5} | {i: None for i in (2, 3, 5, 6, 7, 8, 9)}
    assert all(out[i].payload.decode() == (h or "") for i, h in enumerate(html) if out[i].record_type == "response")
    assert all(r.payload_bytes == len((html[i] or "").encode()) for i, r in out.items())


def test_files_are_gzip_members_of_whole_records(spark):
    path = written(spark, [(i, "http://a/", "same" if i < 5 else f"page {i}") for i in range(20)])
    for f in files(path):
        raw = open(f, "rb").read()
        text = gzip.decompress(raw)
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        kinds = [h["warc-type"] for h, _ in warc.records_of(raw)]
        assert kinds[0] == "warcinfo" and kinds[-1] == "metadata" and set(kinds[1:-1]) <= {"response", "revisit"}
        assert [h for h, _ in warc.records_of(text)] == [h for h, _ in warc.records_of(raw)]
        assert all({"warc-refers-to-target-uri", "warc-refers-to-date"} <= set(h) for h, _ in warc.records_of(raw) if h["warc-type"] == "revisit")


def test_a_record_of_over_16_mb(spark):
    path = written(spark, [(1, "u", "z" * (1 << 24)), (2, "u", "y")])
    assert sorted((r.page_id, r.payload_bytes) for r in warc.read_warc(spark, path, payloads=False).collect()) == [(1, 1 << 24), (2, 1)]


def test_archives_of_other_tools(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    (tmp_path / "plain.warc").write_bytes(record * 2)
    (tmp_path / "members.warc.gz").write_bytes(gzip.compress(record) * 3)
    out = warc.read_warc(spark, str(tmp_path), counted=False).collect()
    assert len(out) == 5 and {(bytes(r.payload), r.payload_digest) for r in out} == {(b"hello", warc.base32_sha1(b"hello"))}


@pytest.mark.parametrize("damage", ["cut", "payload", "record", "file"])
def test_damage_is_an_error(spark, damage, monkeypatch, tmp_path):
    rows = [(i, "http://a/", "same" if i < 5 else f"page {i} " * 50) for i in range(40)]
    spark.createDataFrame(rows, PAGES).repartition(2).write.parquet(str(tmp_path / "pages.parquet"))

    def write(pages, path, **kw):
        before(pages, path, **kw)
        name = files(path)[0]
        raw, records = open(name, "rb").read(), []
        if damage == "file":
            os.remove(name)
            return
        records = [warc._record([(k, v) for k, v in h.items() if k != "content-length"], b) for h, b in warc.records_of(raw)]
        if damage == "payload":
            at = next(i for i, r in enumerate(records) if b"page 1" in r)
            records[at] = records[at].replace(b"page 1", b"cage 1")
        if damage == "record":
            del records[2]
        raw = b"".join(map(gzip.compress, records))
        with open(name, "wb") as f:
            f.write(raw[: len(raw) // 2] if damage == "cut" else raw)
        crc = os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc")
        if os.path.exists(crc):
            os.remove(crc)

    before = warc.write_warc
    monkeypatch.setattr(warc, "write_warc", write)
    with pytest.raises(Exception, match="cut short|another payload|tells of|records for|no response"):
        queries.op8_warc(spark, str(tmp_path)).collect()


def test_a_revisit_without_its_response_is_an_error(spark):
    path = written(spark, [(1, "u", "x"), (2, "u", "x")])
    with pytest.raises(Exception, match="no response"):
        warc.resolve(warc.read_warc(spark, path).where("record_type = 'revisit'")).collect()


def test_each_payload_of_a_repeated_id(spark):
    rows = warc.resolve(warc.read_warc(spark, written(spark, [(1, "u", "x"), (1, "u", "yy"), (2, "u", "x")]))).collect()
    assert sorted((r.page_id, r.record_type, r.payload_bytes, r.refers_to or 0) for r in rows) == [(1, "response", 2, 0), (1, "revisit", 1, 2), (2, "response", 1, 0)]


def test_pages_without_an_id_and_clashing_names(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x"), (None, "u", "x"), (None, "u", "yy"), (None, None, None), (3, "u", "z")], PAGES)
    pages = pages.selectExpr("*", "1 AS original", "2 AS sha256", "3 AS of", "4 AS digest", "5 AS member")
    path = fresh_path(spark, "warc")
    warc.write_warc(pages.coalesce(1), path)
    records = warc.read_warc(spark, path)
    assert records.select("record_id").distinct().count() == 5
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    for rows in (warc.resolve(records), queries.op8_warc(spark, str(tmp_path))):
        got = sorted((r.page_id or 0, r.record_type, r.payload_bytes, r.refers_to or 0) for r in rows.collect())
        assert got == [(0, "response", 0, 0), (0, "response", 2, 0), (0, "revisit", 1, 1), (1, "response", 1, 0), (3, "response", 1, 0)]
