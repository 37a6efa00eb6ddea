"""Writing one site leaves the others; stored files read back under their URLs; rules that one fixture page decides."""
import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sitelake.operators.candidates import candidate_cards, element_flags
from sitelake.operators.extract import extract_fields, selectors_frame
from sitelake.operators.frontier import crawl
from sitelake.operators.listing import bootstrap_product_page, extract_listing_links
from sitelake.operators.select import GLOBAL
from sitelake.operators.shred import shred
from sitelake.operators.validate import validate_selectors, variant_fields
from sitelake.session import materialize, release
from sitelake.sinks.writers import write_products_csv, write_selectors, write_sitemap_docs
from sitelake.sources.pages import read_html_files, read_page_urls
from sitelake.sources.selectors import read_selectors
from sitelake.sources.sitemaps import expand_index, numbered, read_sitemap_files, sitemap_urls, sitemaps_from_pages

RECORD = "scope string, kind string, field string, ord int, selector string"


def folder(name):
    return os.path.join(tempfile.mkdtemp(prefix="sitelake-test-"), name)


def test_products_of_one_site_leave_the_others(spark):
    out = folder("csv")
    a, b = ([("n", f"http://{s}.com/1")] for s in "ab")
    for rows in (a, b, []):
        write_products_csv(spark.createDataFrame(rows, "name string, url string"), out, ["name"])
    assert sorted(os.path.basename(d) for d in glob.glob(out + "/domain=*")) == ["domain=a.com", "domain=b.com"]


def test_selectors_read_back_and_other_sites_stay(spark):
    out = folder("selectors")
    a = [("a.com", "listing", "product_card", 0, ".c"), ("a.com", "listing", "product_link", 1, "a"), ("a.com", "listing", "pagination", 2, "")]
    b = [("b.com:80", "listing", "product_card", 0, "li"), ("b.com:80", "listing", "product_link", 1, ""), ("b.com:80", "listing", "pagination", 2, "x")]
    for rows in (a, b, []):
        write_selectors(spark.createDataFrame(rows, RECORD), out)
    assert sorted(map(tuple, read_selectors(spark, out).collect())) == sorted(a + b)
    other = folder("records")
    os.makedirs(other + "/c.com")
    with open(other + "/c.com/listing_selector.json", "w") as f:
        f.write('{"product_card": "p"}')
    assert {(r.scope, r.field): r.selector for r in read_selectors(spark, other).collect()}[("c.com", "product_card")] == "p"


def test_sitemap_files_have_urls_and_index_children_come_once(spark):
    root = folder("maps")
    os.makedirs(root + "/a.com/deep")
    files = {
        "a.com/index.xml": "<sitemapindex><sitemap><loc>https://a.com/deep/s1.xml</loc></sitemap></sitemapindex>",
        "a.com/deep/s1.xml": "<urlset><url><loc>http://a.com/1</loc></url></urlset>",
        "a.com/lone.xml": "<urlset><url><loc>http://a.com/2</loc></url></urlset>",
    }
    for name, xml in files.items():
        with open(f"{root}/{name}", "w") as f:
            f.write(xml)
    rows = expand_index(read_sitemap_files(spark, root)).collect()
    assert sorted((r.root, r.loc) for r in rows) == [("https://a.com/index.xml", "http://a.com/1"), ("https://a.com/lone.xml", "http://a.com/2")]


def test_sitemaps_do_not_depend_on_dense_ids(spark):
    pages = spark.range(200).select((F.col("id") * 1_000_003 * 977).alias("page_id"), F.concat(F.lit("http://a.com/"), "id").alias("url"))
    docs = sitemaps_from_pages(pages, chunk=50)
    names = sorted(r.sitemap_url for r in docs.select("sitemap_url").collect())
    assert names == [f"https://a.com/sitemap-{i}.xml" for i in range(4)] + ["https://a.com/sitemap_index.xml"]
    assert sitemap_urls(docs).count() == 200
    many = sorted(r.sitemap_url for r in sitemaps_from_pages(pages, chunk=3).select("sitemap_url").collect() if "index" in r.sitemap_url)
    assert len(many) == 23  # 67 urlsets, three to an index
    n = [r.n for r in numbered(pages.withColumn("g", F.lit(1)), "g", "page_id", ranges=7).orderBy("page_id").collect()]
    assert n == list(range(1, 201))


def test_html_files_get_their_url(spark):
    root = folder("raw")
    os.makedirs(root + "/2026-01-01/a.com/html")
    for slug in ("root", "x_y"):
        with open(f"{root}/2026-01-01/a.com/html/{slug}.html", "w") as f:
            f.write("<p>t</p>")
    assert sorted(r.url for r in read_html_files(spark, root).collect()) == ["https://a.com/", "https://a.com/x_y"]
    known = spark.createDataFrame([("a.com", "x_y", "http://a.com/x/y")], "domain string, slug string, url string")
    assert sorted(r.url for r in read_html_files(spark, root, known).collect()) == ["http://a.com/x/y", "https://a.com/"]


def test_cards_outside_navigation_are_their_own_group(spark, pages_df):
    item = '<li><a href="/p">x</a></li>'
    nodes = shred(pages_df([("http://a.com/", f"<nav><ul>{item * 2}</ul></nav><ul>{item * 9}</ul>")]))
    got = {(r.selector, r.in_navigation): (r.n_cards, r["rank"]) for r in candidate_cards(nodes).collect()}
    assert got == {("li", False): (9, 1), ("li", True): (2, 2)}


def test_nested_option_counts_once(spark, pages_df):
    nodes = shred(pages_df([("http://a.com/1", '<div class="s"><li><a>S</a></li></div>'), ("http://a.com/2", '<div class="s"><li><a>S</a></li><li>M</li></div>')]))
    record = spark.createDataFrame([(i, GLOBAL, ".s li", ".s") for i in (0, 1)], "page_id long, scope string, size string, size_container string")
    assert {r.page_id: (r.n_options, r["size"]) for r in variant_fields(nodes, record).collect()} == {0: (1, ""), 1: (2, ".s li")}


def test_bootstrap_stops_at_a_first_card_without_link(spark, pages_df):
    listing = selectors_frame(spark, {"product_card": ".c", "product_link": "a"}, kind="listing")
    nodes = shred(pages_df([("http://a.com/", '<p class="c">none</p><p class="c"><a href="/2">x</a></p>'), ("http://b.com/", '<p class="c"><a href="/1">x</a></p>')]))
    assert [tuple(r) for r in bootstrap_product_page(nodes, listing).collect()] == [("b.com", "https://b.com/1")]


def test_unsupported_selector_is_an_error_in_extraction_and_no_match_in_validation(spark, pages_df):
    nodes = shred(pages_df([("http://a.com/", "<h1>t</h1><p>x</p>")]))
    with pytest.raises(ValueError, match="unsupported"):
        extract_fields(nodes, selectors_frame(spark, {"title": "h1", "next": "h1 + p"}))
    got = {r.field: r.validated for r in validate_selectors(nodes, selectors_frame(spark, {"next": "h1:not(.y)"})).collect()}
    assert got == {"next": ""}


def test_wide_global_record_has_no_cap(spark, pages_df):
    nodes = shred(pages_df([("http://a.com/", "<h1>t</h1>")]))
    rows = [(None, "product", f"f{i}", i, "h1") for i in range(10_050)]
    got = validate_selectors(nodes, spark.createDataFrame(rows, RECORD))
    assert got.where("validated = 'h1'").count() == 10_050


def test_best_first_without_budget_reaches_everything(spark):
    edges = spark.createDataFrame([(f"http://a.com/{i}", f"http://a.com/{j}", j) for i in range(6) for j in (2 * i + 1, 2 * i + 2)], "src string, dst string, pos int")
    seeds = spark.createDataFrame([(0, "http://a.com/0")], "seed_id long, url string")
    assert crawl(edges, seeds, "best", max_depth=9, max_pages=None).count() == 13


def test_one_page_of_40000_elements(spark, pages_df):
    """Link flags and card links of a very large page take time linear in its elements."""
    body = "".join(f'<li class="c"><a href="/{i}">x</a></li>' if i % 2 else "<li>y</li>" for i in range(26_000))
    nodes = shred(pages_df([("http://a.com/", f"<ul>{body}</ul>")]))
    assert element_flags(nodes).where("has_link AND tag = 'li'").count() == 13_000
    listing = selectors_frame(spark, {"product_card": "li.c", "product_link": "a"}, kind="listing")
    assert extract_listing_links(nodes, listing).count() == 13_000


def test_url_reads_leave_html_alone(spark, pages_df):
    path = folder("pages")
    pages_df([("http://a.com/", "<p>x</p>")]).write.parquet(path)
    plan = read_page_urls(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan.split("ReadSchema")[1]


def test_release_deletes_a_written_table(spark):
    t = materialize(spark.range(3), "t")
    path = t.sitelake_path.removeprefix("file:")
    assert os.path.isdir(path)
    release(t)
    assert not os.path.exists(path)


def test_sitemap_docs_of_one_site_leave_the_others(spark):
    out = folder("docs")
    for s in "ab":
        write_sitemap_docs(spark.createDataFrame([(f"https://{s}.com/s.xml", "<urlset/>")], "sitemap_url string, xml string"), out)
    assert len(glob.glob(out + "/domain=*")) == 2
