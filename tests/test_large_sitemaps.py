"""Sitemap files read in splits give the rows of the whole-document path."""

import os

from sitelake.sources.sitemaps import SITEMAP_NS, read_sitemap_entries, read_sitemap_files, sitemap_children, sitemap_urls


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def entry(i):
    if i % 11 == 0:
        return "<url></url>" if i % 2 else "<url><loc>  </loc></url>"
    if i % 13 == 0:
        return f"<url><lastmod>2024-01-01</lastmod><loc><![CDATA[http://a.com/c?a=1&b={i}]]></loc></url>\n"
    return f'<url>\n  <loc> http://a.com/p?x={i}&amp;y=é&#233;{"z" * (i % 50)} </loc><changefreq>daily</changefreq>\n</url>'


def test_entries_in_splits(spark, tmp_path):
    root = str(tmp_path / "maps")
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="{SITEMAP_NS}">'
    write(f"{root}/a.com/big.xml", head + "".join(entry(i) for i in range(5000)) + "</urlset>")
    write(f"{root}/a.com/dir/small.xml", head + "<url><loc>http://a.com/one</loc></url><url><loc>http://a.com/one</loc></url></urlset>")
    write(f"{root}/b.com/empty.xml", head + "</urlset>")
    kids = "".join(f"<sitemap><loc>https://a.com/big.xml?{i}</loc></sitemap>" for i in range(40))
    write(f"{root}/b.com/index.xml", f'<sitemapindex xmlns="{SITEMAP_NS}">{kids}<sitemap></sitemap></sitemapindex>')
    docs = read_sitemap_files(spark, root)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("16k", "100k", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            urls = read_sitemap_entries(spark, root)
            got, want = (sorted(map(tuple, d.collect())) for d in (urls, sitemap_urls(docs)))
            assert got == want and len(got) > 4500
            kids = sorted(map(tuple, read_sitemap_entries(spark, root, tag="sitemap").collect()))
            assert kids == sorted(map(tuple, sitemap_children(docs).collect())) and len(kids) == 40
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        parts = spark.read.option("lineSep", "</url>").text(f"{root}/a.com/big.xml").rdd.getNumPartitions()
        assert parts > 10  # one file, many tasks
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_files_of_many_lines_are_one_row(spark, tmp_path):
    from sitelake.sources.pages import read_html_files
    from sitelake.sources.selectors import read_selectors

    write(str(tmp_path / "html/2026-01-01/a.com/html/x.html"), "<html>\n<h1>one</h1>\n\n<p>two</p>\n")
    pages = read_html_files(spark, str(tmp_path / "html")).collect()
    assert [(r["url"], r["html"]) for r in pages] == [("https://a.com/x", "<html>\n<h1>one</h1>\n\n<p>two</p>\n")]
    write(str(tmp_path / "sel/a.com/listing_selector.json"), '{\n    "product_card": "li.card",\n    "product_link": "a"\n}\n')
    rows = read_selectors(spark, str(tmp_path / "sel")).orderBy("ord").collect()
    assert [(r["scope"], r["field"], r["selector"]) for r in rows] == [("a.com", "product_card", "li.card"), ("a.com", "product_link", "a"), ("a.com", "pagination", "")]
