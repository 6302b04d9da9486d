import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagetrail.llm import exact_dedup, registry, url_filter, warc_zip
from tests.oracle import duck, same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, small, name):
    same(registry.QUERIES[name](spark, small), duck(small).sql(registry.ORACLES[name]))


DOCS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (None, "b"), (None, "c"), (7, "x" * 300_000), (8, "x" * 300_000), (8, "x" * 300_000)]


@pytest.mark.parametrize("heavy", [1, 256])
def test_exact(spark, heavy):
    docs = spark.createDataFrame([(i, t, 1, "d") for i, t in DOCS], "doc_id long, text string, kept int, digest string")
    groups = defaultdict(list)
    for i, t in DOCS:
        groups[t or ""].append(i)
    want = []
    for i, t in DOCS:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[t or ""]), i == keep))
    got = [(r.id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.decisions(docs, heavy=heavy).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    stays = exact_dedup.exact_dedup(docs, heavy=heavy)
    assert stays.columns == docs.columns
    assert sorted((r.doc_id for r in stays.collect()), key=repr) == sorted((w[0] for w in want if w[3]), key=repr)


def test_exact_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.decisions(docs).count() == 0 and exact_dedup.exact_dedup(docs).count() == 0


def test_url_forms(spark):
    urls = [None, "", "no host", "://", "HTTP://WWW.Example.COM/en/x", "http://a.example.com/en/", "http://example.com/de", "http://x.net/es/1", "http://x.net/de/1", "http://net", "http://y.org/p/?b=1&a=2&utm_x=3#f", "ftp://Y.org/p?a=2&b=1", "http://x://y/z"]
    pages = spark.createDataFrame([(i, u, "h", "v", "w") for i, u in enumerate(urls)], "page_id int, url string, host string, verdict string, maybe string")
    listed = spark.createDataFrame([("http://www.y.org/p?b=1&a=2",), (None,)], "url string")
    out = url_filter.url_filter(pages, listed)
    assert out.columns[:-1] == pages.columns
    got = {r.page_id: (r.url_verdict.host, r.url_verdict.path, r.url_verdict.rule, r.url_verdict.verdict) for r in out.collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"),
        4: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 5: ("a.example.com", "/en/", "example.com/en/", "block"),
        6: ("example.com", "/de", "com/", "allow"), 7: ("x.net", "/es/1", "net/es/", "block"), 8: ("x.net", "/de/1", None, "allow"), 9: ("net", "", None, "allow"),
        10: ("y.org", "/p/", None, "block"), 11: ("y.org", "/p", None, "block"), 12: ("x:", "//y/z", None, "allow"),
    }


def test_numbers_beyond_64_bits_are_in_no_list(spark, tmp_path):
    import duckdb

    urls = ["http://a.org/es/99999999999999999999", "http://a.org/es/9223372036854775807", "http://a.org/es/7", "http://a.org/es/8", "http://b.org/x?u=/fr/9223372036854775808", "http://b.org/es/", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(7, 0, 0), (8, 1, 0), (9223372036854775807, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    c = duckdb.connect()
    for t in ("pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    out = url_filter.op4_url_filter(spark, str(tmp_path))
    same(out, c.sql(url_filter.SQL))
    assert {r.page_id for r in out.collect() if r.verdict == "block"} == {1, 2}


def test_no_false_negative_in_a_full_filter(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), F.col("id").cast("string")).alias("url"))
    listed = pages.filter("page_id % 3 = 0").select("url")
    for blocks in (16, 1 << 17):
        out = url_filter.url_filter(pages, listed, rules=[], max_blocks=blocks)
        assert {r.page_id for r in out.filter("url_verdict.verdict = 'block'").collect()} == set(range(0, 3000, 3))
    assert url_filter.url_filter(pages, listed.limit(0)).filter("url_verdict.verdict = 'block'").count() == 0


PAGES = [(1, "http://a/\r\nb", "x" * 100), (2, None, "x" * 100), (3, "u", "y" * 99), (4, "u", "y" * 99), (5, "u", None), (6, "ü", ""), (None, "u", "x" * 100), (7, "u", "é\0" * 200_000), (8, "u", "é\0" * 200_000)]


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, digest string")
    manifest = warc_zip.write_archives(warc_zip.decided(pages), f"file://{tmp_path}/a", archive_bytes=2000).cache()
    assert manifest.count() > 1
    got = {r.page_id: r for r in warc_zip.read_archives(manifest).collect()}
    kind = {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 1), 7: ("response", None), 8: ("revisit", 7)}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == kind
    for i, _, html in PAGES:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        if kind[i][1] is None:
            assert bytes(got[i].payload) == raw
    empty = warc_zip.write_archives(warc_zip.decided(pages.limit(0)), f"file://{tmp_path}/b")
    assert empty.count() == 0 and warc_zip.read_archives(empty).count() == 0


def test_a_common_payload_without_broadcasts(spark):
    rng = [f"{k}" * 120 for k in range(40)]
    rows = [(i, f"u{i}", "common " * 50 if i % 3 == 0 else rng[i % 40] if i % 2 else f"own {i} " * 30) for i in range(2000)] + [(None, "n", "common " * 50), (6, "again", "common " * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    at = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = warc_zip.decided(pages).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at)
    first, seen = {}, defaultdict(int)
    for i, _, html in rows:
        seen[html] += 1
        if i is not None:
            first[html] = min(first.get(html, i), i)
    want = [(i, u, None, first[h]) if seen[h] > 1 and i != first[h] else (i, u, h, None) for i, u, h in rows]
    assert sorted(((r.page_id, r.url, r.html, r["first"]) for r in got), key=repr) == sorted(want, key=repr)


def test_zip64_directory(tmp_path):
    import zipfile

    path = tmp_path / "z.zip"
    with zipfile.ZipFile(path, "w") as z:
        with z.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as f:
            f.write(b"0123456789")
        for k in range(70_000):
            z.writestr(f"{k}", b"")
    fs, at = warc_zip.opened(f"file://{path}")
    with fs.open_input_file(at) as f:
        found = warc_zip.members(f, f.size())
        start, size = warc_zip.stored_range(f, found["big"])
        assert len(found) == 70_001 and f.read_at(size, start) == b"0123456789"


def test_a_wrong_digest_is_seen():
    raw = warc_zip.record(1, "u", "text", 4, "0" * 64, None)
    headers, payload = warc_zip.parsed(raw)
    assert payload == b"text" and headers["warc-payload-digest"] == "sha256:" + "0" * 64
    with pytest.raises(ValueError):
        warc_zip.parsed(raw[:-6])
