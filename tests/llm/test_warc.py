import base64
import hashlib

import pytest

from tunelake.llm import warc
from tunelake.session import scratch_path

SCHEMA = "page_id long, url string, html string, path string, offset string, __row string"
PAGES = [
    (1, "http://a/1", "<p>ünï</p>", "x", "x", "x"),
    (2, "http://a/2\r\nX: y", "same", "x", "x", "x"),
    (3, None, "same", "x", "x", "x"),
    (9, "http://a/9", "same", "x", "x", "x"),
    (4, "http://a/4", "", "x", "x", "x"),
    (5, "http://a/5", None, "x", "x", "x"),
    (None, "http://a/n", "alone", "x", "x", "x"),
    (None, "http://a/m", "same", "x", "x", "x"),
    (7, "http://a/7", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 500, "x", "x", "x"),
    (8, "http://a/8", "long " * 200_000, "x", "x", "x"),
    (1, "http://a/1", "<p>ünï</p>", "x", "x", "x"),
]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "p")
    spark.createDataFrame(PAGES, SCHEMA).repartition(3, "url").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("min_bytes", [0, 5])
@pytest.mark.parametrize("gap, most", [(0, 1), (1 << 20, 1 << 20)])
def test_round_trip(spark, pages, min_bytes, gap, most):
    index = warc.write_archives(pages, scratch_path(spark, "warc"), min_bytes=min_bytes)
    found = warc.read_records(spark, index, gap=gap, most=most).collect()
    assert len(found) == len(PAGES) == index.count()
    groups = {}
    for page_id, _, html, *_ in PAGES:
        groups.setdefault((html or "").encode(), []).append(page_id)
    responses = {}
    by_digest = {base64.b32encode(hashlib.sha1(b).digest()).decode(): b for b in groups}
    for r in found:
        body = by_digest[r.payload_digest]
        assert r.payload_bytes == len(body)
        if r.record_type == "response":
            assert r.html.encode() == body and r.refers_to is None
            responses.setdefault(body, []).append(r.page_id)
        else:
            known = [i for i in groups[body] if i is not None]
            assert r.html is None and r.refers_to == max(known)
    for body, ids in groups.items():
        if len(body) >= min_bytes:
            known = [i for i in ids if i is not None]
            assert responses[body] == [max(known) if known else None]
        else:
            assert len(responses[body]) == len(ids)
    lines = {r.page_id: r.url for r in found}
    assert lines[2] == "http://a/2%0D%0AX: y" and lines[3] == ""


def test_selected_records(spark, pages):
    index = warc.write_archives(pages, scratch_path(spark, "warc"))
    assert [r.html for r in warc.read_records(spark, index.where("page_id = 8")).collect()] == [
        "long " * 200_000]


def test_empty(spark, pages):
    index = warc.write_archives(pages.where("1 = 0"), scratch_path(spark, "warc"))
    assert index.count() == 0 and warc.read_records(spark, index).count() == 0


def test_a_record_that_is_cut_off_is_an_error():
    data = warc.record({"page_id": 1, "url": "u", "payload_digest": "d", "payload_bytes": 3,
                        "revisit": False, "refers_to": None, "html": "abc"})
    assert warc.parsed(data)["html"] == "abc"
    with pytest.raises(Exception):
        warc.parsed(data[:-9])
