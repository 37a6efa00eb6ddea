"""Sitemaps (S2, S3, O5), sinks (K2, K3, K4, K11) on hand fixtures."""
import base64
import csv
import glob
import os
import tempfile

from sitelake.sinks.writers import CRAWL_RESULT_SCHEMA, artifacts, layer_fallback, selector_json, write_products_csv
from sitelake.sources.sitemaps import expand_index, sitemap_diff, sitemap_urls

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
DOCS = [
    ("http://a.com/s1.xml", f"<urlset {NS}><url><loc>  http://a.com/1 </loc></url><url></url>"
                            f"<url><loc>http://a.com/2?x=1&amp;y=2</loc></url><url><loc>http://a.com/1</loc></url></urlset>"),
    ("http://a.com/s2.xml", "<urlset><url><loc>http://a.com/3</loc></url></urlset>"),
    ("http://a.com/index.xml", f"<sitemapindex {NS}><sitemap><loc>http://a.com/s1.xml</loc></sitemap>"
                               f"<sitemap><loc>http://a.com/s2.xml</loc></sitemap></sitemapindex>"),
]


def test_sitemap_urls_and_index(spark):
    docs = spark.createDataFrame(DOCS, "sitemap_url string, xml string")
    s1 = [(r.pos, r.loc) for r in sitemap_urls(docs).filter("sitemap_url = 'http://a.com/s1.xml'").orderBy("pos").collect()]
    assert s1 == [(1, "http://a.com/1"), (2, "http://a.com/2?x=1&y=2"), (3, "http://a.com/1")]
    idx = expand_index(docs).filter("root = 'http://a.com/index.xml'").orderBy("child_pos", "pos").collect()
    assert [r.loc for r in idx] == ["http://a.com/1", "http://a.com/2?x=1&y=2", "http://a.com/1", "http://a.com/3"]
    crawled = spark.createDataFrame([("http://a.com/3",), ("http://a.com/9",)], "url string")
    d = {r.url: r.side for r in sitemap_diff(sitemap_urls(docs), crawled).collect()}
    assert d == {"http://a.com/1": "sitemap_only", "http://a.com/2?x=1&y=2": "sitemap_only",
                 "http://a.com/3": "both", "http://a.com/9": "crawled_only"}


def test_products_csv_quoting(spark):
    rows = spark.createDataFrame([('a "q", b', "", "line1\nline2", "http://a.com/1"), ("x", "y", "z", "http://b.com/2")],
                                 "name string, price string, description string, url string")
    out = tempfile.mkdtemp(prefix="sitelake-csv-")
    write_products_csv(rows, out + "/csv", ["name", "price", "description"])
    files = glob.glob(out + "/csv/domain=a.com/*.csv")
    text = "".join(open(f, encoding="utf-8").read() for f in files)
    assert '"a ""q"", b",,' in text
    raw = b"".join(open(f, "rb").read() for f in files)
    assert raw.startswith(b"name,price,description,url\r\n")
    recs = list(csv.reader(open(files[0], encoding="utf-8")))
    assert recs[0] == ["name", "price", "description", "url"]
    assert recs[1] == ['a "q", b', "", "line1\nline2", "http://a.com/1"]
    assert os.path.isdir(out + "/csv/domain=b.com")


def test_artifacts_fan_out(spark):
    png = base64.b64encode(b"\x89PNG").decode()
    res = spark.createDataFrame([
        ("https://a.b/c?d=e&f#g", "<p>x</p>", "# x", {"title": "t"}, b"%PDF", png),
        ("http://a.b/2", "", None, {}, None, "not base64!"),
    ], CRAWL_RESULT_SCHEMA)
    arts = artifacts(res, "2026-01-01").collect()
    kinds = sorted((r.url, r.kind, r.ext) for r in arts)
    assert [k for k in kinds if k[0] == "https://a.b/c?d=e&f#g"] == [
        ("https://a.b/c?d=e&f#g", "JSON", "json"), ("https://a.b/c?d=e&f#g", "PDF", "pdf"),
        ("https://a.b/c?d=e&f#g", "html", "html"), ("https://a.b/c?d=e&f#g", "markdown", "md"),
        ("https://a.b/c?d=e&f#g", "metadata", "json"), ("https://a.b/c?d=e&f#g", "screenshots", "png")]
    # empty html, no markdown, no pdf and a bad screenshot give no rows; metadata and the dump remain
    assert sorted(k[1] for k in kinds if k[0] == "http://a.b/2") == ["JSON", "metadata"]
    pf = {r.page_folder for r in arts if r.url.startswith("https")}
    assert pf == {"https_a.b_c_d_e_f#g"}
    png_row = [r for r in arts if r.kind == "screenshots"][0]
    assert bytes(png_row.payload) == b"\x89PNG"


def test_layer_fallback_and_selector_json(spark):
    layers = spark.createDataFrame([("u1", "raw", "R1"), ("u1", "clean", "C1"), ("u2", "raw", "R2"), ("u2", "clean", ""),
                                    ("u3", "raw", "")], "url string, layer string, html string")
    got = {r.url: r.html for r in layer_fallback(layers).collect()}
    assert got == {"u1": "C1", "u2": "R2", "u3": None}
    rows = spark.createDataFrame([("a.com", "product", "price", 1, ".p"), ("a.com", "product", "name", 0, "h1")],
                                 "scope string, kind string, field string, ord int, selector string")
    assert selector_json(rows).collect()[0].json == '{"name":"h1","price":".p"}'
