from __future__ import annotations

import hashlib
import base64
import time

from pyspark.sql import functions as F

from gazette.llm import url_filter, warc

PAGE = ("<html lang='EN'><head><title>A &amp; B</title></head><body><!-- no --><script>x<y</script>"
        "<p>One\n two</p><div>three&nbsp;<b>f</b>our</div><a href='/x'>five</a></body></html>")


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows],
                                 "page_id bigint, url string, html string, host string, block string")


def test_derivatives_keep_what_they_refer_to(spark, tmp_path):
    rows = [(1, "http://a.org/x", PAGE), (2, None, None), (3, "http://b.org/", ""),
            (None, "u", "plain"), (4, "http://c.org/", "é < b\r\n\r\nWARC/1.1\r\n"),
            (1, "http://a.org/x", PAGE)]
    sources = warc.responses(pages(spark, rows))
    made = warc.derivatives(sources).collect()
    assert len(made) == 12
    by_id = {r.record_id: r for r in sources.collect()}
    for r in made:
        source = by_id[r.refers_to]
        assert (r.target_uri, r.date) == (source.target_uri, source.date)
        assert r.source_block_digest == source.block_digest
        assert r.source_payload_digest == source.payload_digest
        assert r.content_length == len(r.block.encode())
        assert r.block_digest == "sha1:" + base64.b32encode(
            hashlib.sha1(r.block.encode()).digest()).decode()
    one = {r.record_type: r.block for r in made if r.page_id == 1}
    assert one["conversion"] == "One two\nthree four\nfive"
    assert "source-header: HTTP/1.1 200 OK" in one["metadata"]
    assert "title: A & B" in one["metadata"] and "language: en" in one["metadata"]
    assert "outlinks: 1" in one["metadata"]
    every = sources.unionByName(warc.derivatives(sources))
    warc.write_warc(every, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    columns = [c for c in warc.RECORD.names if c != "target_uri"]
    plain = lambda df: sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
    assert plain(back) == plain(every)
    assert warc.derivatives(warc.responses(pages(spark, []))).count() == 0


def test_a_head_without_an_end_hides_no_body():
    for page in ("<head><title>x</title><body><p>seen", "<head><title>a <b></title><meta a=b>\n<p>seen",
                 "<HEAD><script>y</script><title>x</title>seen", "<head>seen", "<head>x</head>seen",
                 "<head><title>x</title><body>seen<!-- </head> -->",
                 "<head><script>'<body>'</script><style>z</style></head><body>seen",
                 "<head><noscript>z</noscript><!-- y --><link><div>seen<script>x"):
        assert warc.plain_text(page) == "seen", page
    start = time.time()
    for part in ("<head>", "<head><title>", "<head><script>", "<head></title>", "<head><!--"):
        warc.plain_text(part * 20_000)
    assert time.time() - start < 20


def test_rules_hosts_and_paths(spark):
    rows = [(1, "http://WWW.Example.org/es/1?q#f", None), (2, "https://example.org/en/12", None),
            (3, "https://notexample.org", None), (4, "x://a.com/fr/?x", None), (5, "no scheme", None),
            (6, None, None), (7, "http://é.com?x://y", None), (8, "http://casino-win.net/", None),
            (9, "http://org/", None), (10, "http://a.com/de/", None), (10, "http://a.com/de/", None)]
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judged(
        pages(spark, rows), url_filter.has_listed_word(F.col("key"))).collect()}
    assert got == {
        1: ("www.example.org", "/es/1", "example.org/es/", "block"),
        2: ("example.org", "/en/12", "example.org/en/1", "block"),
        3: ("notexample.org", "", None, "allow"), 4: ("a.com", "/fr/", "com/fr/", "allow"),
        5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("é.com", "", None, "allow"),
        8: ("casino-win.net", "/", None, "block"), 9: ("org", "/", "org/", "allow"),
        10: ("a.com", "/de/", "com/de/", "block")}


def test_cascade_is_exact_with_and_without_shards(spark):
    rows = [(i, f"http://h{i}.net/", None) for i in range(4000)]
    listed = F.col("key").rlike("^h[0-9]*7[.]")
    for bits in (1 << 26, 1500):
        out = url_filter.judged(pages(spark, rows), listed, (), shard_bits=bits).collect()
        assert len(out) == 4000
        assert all((r.verdict == "block") == (r.page_id % 10 == 7) for r in out)
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"),
                                    (F.col("id") % 9 == 0).alias("listed"))
    levels = url_filter.cascade(keys)
    assert len(levels) > 1
    assert keys.where(url_filter.is_listed(levels, F.col("key")) != F.col("listed")).count() == 0
    assert url_filter.judged(pages(spark, []), listed).count() == 0


def test_nothing_listed_and_everything_listed(spark):
    rows = [(1, "http://a.net/", None), (2, "http://b.net/", None)]
    for listed, verdict in ((F.lit(False), "allow"), (F.lit(True), "block")):
        out = url_filter.judged(pages(spark, rows), listed, ()).collect()
        assert {r.verdict for r in out} == {verdict}
