import base64
import hashlib

import pytest

from corvane.llm import warc


@pytest.fixture()
def pages(spark):
    rows = [(5, "http://a/é?x=1", "<p>é</p>" * 300), (3, "http://b", "<p>é</p>" * 300), (9, None, "<p>é</p>" * 300), (1, "http://c", None), (2, "http://d", ""), (7, "u", "own\r\n\r\npayload")]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, digest string"), rows


def expected(rows):
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault((h or "").encode(), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[b] == i else "revisit", None if first[b] == i else first[b]))
    return sorted(out)


@pytest.mark.parametrize("chunk", [7, 500, warc.CHUNK])
def test_round_trip(spark, pages, tmp_path, chunk):
    df, rows = pages
    at = str(tmp_path / "w")
    warc.write(df, at, chunk)
    assert sorted(tuple(r)[:5] for r in warc.read(spark, at).collect()) == expected(rows)
    whole = {}
    for r in warc.payload_chunks(spark, at).orderBy("record_no", "chunk_no").collect():
        whole[r.page_id] = whole.get(r.page_id, b"") + bytes(r.data)
    assert whole[3] == rows[0][2].encode() and whole[5] == b""
    assert spark.read.parquet(at).selectExpr("max(length(data))").first()[0] < chunk + 700


def test_missing_chunk_is_noticed(spark, pages, tmp_path):
    df, _ = pages
    warc.write(df, str(tmp_path / "w"), 500)
    spark.read.parquet(str(tmp_path / "w")).filter("not (page_id = 3 and chunk_no = 1)").write.parquet(str(tmp_path / "x"))
    with pytest.raises(Exception, match="chunk"):
        warc.read(spark, str(tmp_path / "x")).collect()


@pytest.mark.parametrize("chunk", [7, warc.CHUNK])
def test_repeated_rows_and_null_ids(spark, tmp_path, chunk):
    """Every row is a record: repeats of the smallest page of a payload are responses like it, rows without an id too."""
    big = "x" * (warc.CHUNK + 5) if chunk == warc.CHUNK else "long enough"
    rows = [(4, "u", big), (4, "u", big), (4, "u", big + "2"), (8, "u", big), (8, "u", big), (None, "a", big), (None, "b", big), (None, "b", "other payload"), (0, None, "zero"), (-3, None, "zero")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    warc.write(df, str(tmp_path / "r"), chunk)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(spark, str(tmp_path / "r")).collect()), key=str)
    revisit = {8: 4, 0: -3}
    want = sorted(((i, len(h), "revisit" if i in revisit else "response", revisit.get(i)) for i, _, h in rows), key=str)
    assert got == want


def test_empty_and_small(spark, pages, tmp_path):
    df, rows = pages
    assert warc.round_trip(df.limit(0), str(tmp_path / "e")).count() == 0
    least = warc.typed(df, 10).filter("refers_to is not null")
    assert {r.page_id for r in least.collect()} == {5, 9}
