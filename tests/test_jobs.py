"""Composite jobs on fixtures: listing -> products (V6), sitemap -> products (V7), layers (V8, K1), W1, J6."""
import glob
import tempfile

from sitelake.operators.extract import selectors_frame
from sitelake.operators.listing import missing_selectors, with_progress
from sitelake.plans.jobs import clean_pages, listing_to_products, sitemap_to_products
from sitelake.sinks.writers import write_layers
from sitelake.sources.sitemaps import sitemaps_from_pages

LISTING = ('<ul><li class="card"><a href="/p/1">1</a></li><li class="card"><a href="/p/2">2</a></li>'
           '<li class="card"><a href="/p/9">missing</a></li><li class="card"><a href="/p/1">dup</a></li></ul>')


def _pages(spark):
    return spark.createDataFrame([
        (0, "https://shop.com/list", LISTING),
        (1, "https://shop.com/p/1", '<h1 itemprop="name">One</h1><span class="price">1 &euro;</span>'),
        (2, "https://shop.com/p/2", '<h1 itemprop="name">Two</h1>'),
    ], "page_id long, url string, html string")


def test_listing_to_products(spark):
    pages = _pages(spark)
    listing = selectors_frame(spark, {"product_card": "li.card", "product_link": "a"}, "listing")
    product = selectors_frame(spark, {"name": "h1[itemprop=name]", "price": ".price"})
    out, missing = listing_to_products(pages.filter("page_id = 0"), pages, listing, product)
    rows = sorted((r.pos, r.name, r.price, r.url) for r in out.collect())
    assert rows == [(1, "One", "1 €", "https://shop.com/p/1"), (2, "Two", "", "https://shop.com/p/2")]
    assert [r.url for r in missing.collect()] == ["https://shop.com/p/9"]
    prog = with_progress(out, "listing_id", "pos").collect()
    assert sorted((r.idx, r.n) for r in prog) == [(1, 2), (2, 2)]


def test_sitemap_to_products_keeps_duplicates(spark):
    pages = _pages(spark)
    docs = sitemaps_from_pages(pages.filter("page_id > 0").unionByName(pages.filter("page_id = 1")))
    product = selectors_frame(spark, {"name": "h1"})
    out, missing = sitemap_to_products(docs, pages, product)
    names = sorted(r.name for r in out.filter("root LIKE '%sitemap_index.xml'").collect())
    assert names == ["One", "One", "Two"]  # duplicate sitemap entry -> duplicate row
    assert missing.count() == 0


def test_layers_written_partitioned(spark):
    out = tempfile.mkdtemp(prefix="sitelake-layers-")
    write_layers(clean_pages(_pages(spark), "2026-01-01"), out)
    dirs = sorted({p.split(out)[1].rsplit("/", 1)[0] for p in glob.glob(out + "/*/*/*/*.parquet")})
    assert dirs == ["/layer=clean/date=2026-01-01/domain=shop.com", "/layer=raw/date=2026-01-01/domain=shop.com"]
    back = spark.read.parquet(out)
    assert back.filter("layer = 'clean' AND domain = 'shop.com'").count() == 3


def test_missing_selectors(spark):
    pages = spark.createDataFrame([(0, "http://a.com/1", "x"), (1, "http://b.com/1", "y"), (2, "http://b.com/2", "z")],
                                  "page_id long, url string, html string")
    sel = selectors_frame(spark, {"name": "h1"}, scope="a.com")
    assert [(r.domain, r.n_pages) for r in missing_selectors(pages, sel).collect()] == [("b.com", 2)]
