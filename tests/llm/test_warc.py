import pytest

from glanage.llm import warc as w

PAGES = "page_id long, url string, html string"


def plain(rows):
    """What must come back, by the contract."""
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if i is not None and (p not in first or first[p] is None or i < first[p]):
            first[p] = i
        first.setdefault(p, i)
    return first


@pytest.fixture
def rows():
    return [
        (1, "http://a.example/x", "<p>one</p>"), (2, "http://b.example/y z", "<p>one</p>"), (3, None, None), (4, "http://c", ""), (5, "u", "line\r\n\r\nmore\nWARC/1.0\r\n"),
        (6, "v", "é" * 200_000), (7, "w", "é" * 200_000), (-3, "neg", "<p>two</p>"), (8, "t\tu", "<p>two</p>"), (None, "n", "solo"), (9, "http://d", "HTTP/1.1 200 OK\r\n\r\nx"),
    ]


def test_round_trip(spark, rows, tmp_path):
    pages = spark.createDataFrame(rows, PAGES).withColumn("record", w.F.lit("clash")).withColumn("size", w.F.lit(1)).repartition(3)
    arc = w.write_arc(pages, f"file://{tmp_path}/arc")
    got = w.read_warc(spark, w.convert(spark, arc, f"file://{tmp_path}/warc")).collect()
    assert len(got) == len(rows)
    html, first = {i: (h or "").encode() for i, _, h in rows}, plain(rows)
    for r in got:
        p = html[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(p), w.sha1(p))
        same = first[p] == r["page_id"]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if same else ("revisit", first[p]))


def test_repeated_rows_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x")] * 3, PAGES)
    arc = w.write_arc(pages, f"file://{tmp_path}/arc")
    got = w.read_warc(spark, w.convert(spark, arc, f"file://{tmp_path}/warc")).collect()
    assert sorted(r["record_type"] for r in got) == ["response", "revisit", "revisit"] and {r["refers_to"] for r in got} == {1, None}
    arc = w.write_arc(pages.limit(0), f"file://{tmp_path}/none")
    assert w.read_warc(spark, w.convert(spark, arc, f"file://{tmp_path}/empty")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_versions(version):
    data = w.arc_version_block(version, "f.arc") + b"\n" + w.arc_record(version, 7, "http://h/a b", "é") + b"\n" + w.arc_record(version, None, None, None) + b"\n"
    head, one, two = w.parse_arc(data)
    assert head["URL"] == "filedesc://f.arc" and one["URL"] == "http://h/a%20b" and one["Archive-date"] == "20000101000007"
    c = w.converted(one)
    assert (c["type"], c["page_id"], c["payload"], c["date"], c["digest"]) == ("response", 7, "é".encode(), "2000-01-01T00:00:07Z", w.sha1("é".encode()))
    assert w.converted(head)["type"] == "warcinfo" and w.converted(two)["page_id"] is None and c["id"] != w.converted(two)["id"]


def test_known_digest_and_resources():
    assert w.sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    block = w.arc_header(1, "dns:h.example", "1.2.3.4", "199901010203", "text/dns", 4).encode() + b"\nA 1\n\n"
    (_, r) = w.parse_arc(w.arc_version_block(1, "f") + b"\n" + block)
    c = w.converted(r)
    assert (c["type"], c["mime"], c["date"]) == ("resource", "text/dns", "1999-01-01T02:03:00Z")
    (h, b) = next(w.parse_warc(w.warc_record(c, None, None) + b"\r\n"))
    assert h["warc-type"] == "resource" and b == b"A 1\n" and h["warc-payload-digest"] == "sha1:" + w.sha1(b)


def test_damaged_archives():
    good = w.arc_version_block(1, "f") + b"\n"
    assert [r["error"] for r in w.parse_arc(b"rubbish\n")] == ["no version block"]
    assert [r["error"] for r in w.parse_arc(good + b"http://x 0 1 t 999\nshort")][-1] == "declared length runs past the end"
    assert [r["error"] for r in w.parse_arc(good + b"one two\n")][-1] == "bad header line"
    rec = w.arc_record(1, 5, "http://h", "text")
    cut = good + rec + b"\nrubbish line\nmore of it\n" + w.arc_record(1, 6, "http://i", "other") + b"\nhttp://j 0 1 text/html; charset=x 3\nabc\n"
    got = list(w.parse_arc(cut))
    assert [r["error"] for r in got] == [None, None, "bad header line", None, None]
    assert [w.converted(r)["page_id"] for r in got[1:4:2]] == [5, 6] and (got[4]["Content-type"], got[4]["block"]) == ("text/html; charset=x", b"abc")
    assert w.timestamp("99999999999999") == "1970-01-01T00:00:00Z" and list(w.parse_arc(b"")) == []


def test_damaged_gzip_members():
    import gzip

    a, b, c = (gzip.compress(x * 1000) for x in (b"one", b"two", b"three"))
    assert w.unpacked(a + b + c) == (b"one" * 1000 + b"two" * 1000 + b"three" * 1000, [])
    broken = b[:-8] + bytes(8)  # a wrong checksum
    data, bad = w.unpacked(a + broken + c)
    assert data.startswith(b"one" * 1000) and data.endswith(b"three" * 1000) and len(bad) == 1
    assert len(w.unpacked(a + b[:-3])[1]) == 1 and w.unpacked(b"plain") == (b"plain", [])


def test_errors_are_listed_and_the_rest_converted(spark, tmp_path):
    import gzip

    good = w.arc_version_block(1, "f") + b"\n" + w.arc_record(1, 1, "http://a", "x") + b"\n"
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "a.arc.gz").write_bytes(gzip.compress(good + b"not a header\n" + w.arc_record(1, 2, "http://b", "y")))
    (tmp_path / "arc" / "b.arc").write_bytes(b"rubbish")
    errors = w.conversion_errors(spark, f"file://{tmp_path}/arc").collect()
    assert sorted((r["file"], r["error"]) for r in errors) == [("a.arc.gz", "bad header line"), ("b.arc", "no version block")]
    got = w.read_warc(spark, w.convert(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")).collect()
    assert sorted(r["page_id"] for r in got) == [1, 2]


def test_archives_roll_over(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(w, "ROLL", 3000)
    rows = [(i, f"http://h/{i}", "page %d " % (i % 30) * 40) for i in range(60)]
    arc = w.write_arc(spark.createDataFrame(rows, PAGES).coalesce(1), f"file://{tmp_path}/arc")
    assert sum(f.endswith(".gz") for f in os.listdir(tmp_path / "arc")) > 5
    got = w.read_warc(spark, w.convert(spark, arc, f"file://{tmp_path}/warc")).collect()
    assert {r["page_id"]: r["refers_to"] for r in got} == {i: (i - 30 if i >= 30 else None) for i in range(60)}
