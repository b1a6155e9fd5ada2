"""URL filters and WARC archives."""

import gzip
import hashlib
import re

import pyarrow as pa
import pytest

from graphvec import session
from graphvec.llm import url_filter, warc
from graphvec.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme/en/", "http://", "https://example.com", "https://example.com/", "https://EXAMPLE.com/en/x?q=/es/", "http://www.example.com/en/x",
    "http://a.www.Example.COM/en/", "http://notexample.com/en/", "http://x.example.com/EN/", "ftp://net/es/a", "http://a.net/es", "http://a.net/esx/", "http://a.net/fr/#t",
    "http://a.net?x=/fr/", "http://a.net#/fr/", "x://y://net/es/", "http://com/", "http://a.com:80/en/", "http://é.net/es/\n/x", "http://example.com/en/\ny", "http://example.com//en/",
]


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group().translate({i: i + 32 for i in range(65, 91)})
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


@pytest.mark.parametrize("rules", [URL_RULES, [], [("block", "com", "/en"), ("allow", "com", "/en"), ("block", "net", "/e"), ("block", "example.com", "")]])
def test_rules(spark, rules):
    rows = [(i, u, "x", i) for i, u in enumerate(URLS)] + [(3, URLS[3], None, None), (None, URLS[6], "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, host_ long").repartition(3)
    got = url_filter.url_filter(pages, rules).collect()
    want = [(i, *plain(u, rules)) for i, u, *_ in rows]
    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(map(str, want))
    assert "host_" in got[0].asDict()
    assert url_filter.url_filter(pages.limit(0), rules).count() == 0


def test_main_path_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.net/es/")], "page_id long, url string")
    text = url_filter.url_filter(pages, URL_RULES)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", text)


PAGES = [
    (1, "u", "x" * 999), (2, "u", "x" * 999), (3, "u", "y" * 1000), (7, "u", "y" * 1000), (5, None, "y" * 1000), (8, "a\r\nb", None), (9, "u", ""),
    (10, "u", "a\nb\r\n\r\nWARC/1.1\r\n" * 200), (11, "u", "\n" * 1500), (12, "u", "é" * 700 + "\r"), (12, "u", "é" * 700 + "\r"), (None, "u", "y" * 1000), (None, "u", "z" * 2000), (None, "u", "z" * 2000),
    (13, "u", "é" * 700 + "\r"), (14, "u", "long " * 100_000), (-4, "u", "n"),
]


def plain_records(pages):
    out = []
    for page_id, _, html in pages:
        raw = (html or "").encode()
        same = [p for p, _, h in pages if (h or "") == (html or "") and p is not None]
        last = max(same, default=None)
        revisit = len(raw) >= 1000 and last is not None and (page_id is None or page_id < last)
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("chunk", [7, 1000, 256 * 1024])
def test_warc_round_trip(spark, tmp_path, chunk):
    rows = PAGES if chunk > 7 else [(a, b, h if h is None else h[:1500]) for a, b, h in PAGES]
    pages = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, chunk long").repartition(3)
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, chunk_bytes=chunk)
    chunks = warc.read_chunks(spark, path)
    assert all(len(r.data) <= chunk for r in chunks.collect())
    found = warc.resolve_revisits(warc.read_records(chunks)).collect()
    assert sorted(str(tuple(r)) for r in found) == plain_records(rows)


def test_files_are_warc(spark, tmp_path):
    """Another reader, by the Content-Length of each record."""
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    path = tmp_path / "warc"
    warc.write_archives(pages, str(path))
    payloads = []
    for f in path.glob("part-*.gz"):
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            n = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert rest[n : n + 4] == b"\r\n\r\n"
            payloads.append((re.search(rb"WARC-Type: (\w+)", head)[1], rest[:n]))
            data = rest[n + 4 :]
    kept = sorted(p for kind, p in payloads if kind != b"revisit")
    want = plain_records(PAGES)
    assert len(kept) >= sum("response" in x for x in want)


def test_broken_digest_is_found(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "hello")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    bad = warc.read_chunks(spark, str(tmp_path / "w")).selectExpr("file", "record_no", "chunk", "page_id", "record_type", "refers_to", "digest", "cast('hellO' as binary) as data")
    with pytest.raises(Exception, match="stored digest"):
        warc.read_records(bad).collect()


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    assert warc.resolve_revisits(warc.read_records(warc.read_chunks(spark, str(tmp_path / "w")))).count() == 0


def test_a_revisit_without_its_response_raises(spark):
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    rows = [(2, 1500, "aa", "response", None), (1, 0, "aa", "revisit", 2)]
    got = sorted(tuple(r) for r in warc.resolve_revisits(spark.createDataFrame(rows, kinds)).collect())
    assert got == [(1, 1500, "aa", "revisit", 2), rows[0]]
    for lost in ([(1, 0, "aa", "revisit", 3)], [(1, 0, "bb", "revisit", 2)]):
        with pytest.raises(Exception, match="no response"):
            warc.resolve_revisits(spark.createDataFrame(rows[:1] + lost, kinds)).collect()


@pytest.mark.parametrize("step", ["write", "read", "digest"])
def test_archive_steps_get_small_batches(spark, tmp_path, step):
    """Pages of 40 MB in a partition reach a worker in batches of a few MB, on the way out and on the way in."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    was = spark.conf.get(session._BATCH_KEY)
    pages = spark.createDataFrame(PAGES[:4], "page_id long, url string, html string")
    try:
        warc.write_archives(pages, str(tmp_path / "w"))
        chunks = warc.read_chunks(spark, str(tmp_path / "w"))
        spark.conf.set(session._BATCH_KEY, was)
        if step == "write":
            warc.chunk_table(warc.classify(pages))
        elif step == "read":
            warc.read_chunks(spark, str(tmp_path / "w"))
        else:
            warc.read_records(chunks)
        rows = spark.range(400).coalesce(1).selectExpr("repeat('word ', 20000) as html")
        found = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
        assert sum(found) > 40_000_000 and max(found) < 2 * session.BATCH_BYTES
    finally:
        spark.conf.set(session._BATCH_KEY, was)


@pytest.mark.parametrize("chunk", [7, 256 * 1024])
def test_reading_takes_one_python_worker_a_task(spark, tmp_path, chunk):
    """Both steps of reading in one function give what they give apart."""
    pages = spark.createDataFrame([(a, b, h if h is None else h[:1500]) for a, b, h in PAGES], "page_id long, url string, html string").repartition(3)
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, chunk_bytes=chunk)
    found = warc.read_archives(spark, path)
    apart = warc.read_records(warc.read_chunks(spark, path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert found.schema == apart.schema
    assert sorted(map(str, found.collect())) == sorted(map(str, apart.collect()))
