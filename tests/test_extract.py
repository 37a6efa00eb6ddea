"""Listing links (V2, J4, V4), field extraction (V5), validator (V1), variants (V9), records."""

from sitelake.operators.extract import extract_fields, selectors_frame
from sitelake.operators.listing import bootstrap_product_page, extract_listing_links
from sitelake.operators.shred import shred
from sitelake.operators.validate import validate_selectors, variant_fields
from sitelake.sources.selectors import PRODUCT_KEYS, records_to_rows

LISTING = ('<html><head>{base}</head><body><ul>'
           '<li class="card"><a href="p/1">1</a><a href="p/x">x</a></li>'
           '<li class="card"><span>no link</span></li>'
           '<li class="card"><a href="">empty</a></li>'
           '<li class="card"><a href="/p/2">2</a></li>'
           '<li class="card"><a href="p/1">again</a></li></ul></body></html>')


def test_listing_links_with_and_without_base(spark, pages_df):
    pages = pages_df([("http://shop.com/cat/list", LISTING.format(base="")),
                      ("http://shop.com/cat/b", LISTING.format(base='<base href="http://cdn.com/x/">')),
                      ("http://shop.com/cat/c", LISTING.format(base="<base target=_blank>"))])
    listing = selectors_frame(spark, {"product_card": "li.card", "product_link": "a", "pagination": ""}, "listing")
    got = {}
    for r in extract_listing_links(shred(pages), listing).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append((r.pos, r.url))
    assert got[0] == [(1, "http://shop.com/cat/p/1"), (2, "http://shop.com/p/2")]
    assert got[1] == [(1, "http://cdn.com/x/p/1"), (2, "http://cdn.com/p/2")]
    assert got[2] == got[0]  # <base> without href counts as no base
    boot = bootstrap_product_page(shred(pages), listing).collect()
    assert [(r.domain, r.url) for r in boot] == [("shop.com", "p/1")]


def test_no_cards_gives_no_rows(spark, pages_df):
    pages = pages_df([("http://a.com/", "<p>nothing</p>")])
    listing = selectors_frame(spark, {"product_card": ".card", "product_link": "a"}, "listing")
    assert extract_listing_links(shred(pages), listing).count() == 0


def test_extract_fields_empty_selector_and_missing_match(spark, pages_df):
    pages = pages_df([("http://a.com/1", "<h1> A <b>b</b> </h1><p class=price>1</p>"), ("http://a.com/2", "<p>x</p>")])
    sel = selectors_frame(spark, {"name": "h1", "price": ".price", "brand": "", "size": ".nope"})
    rows = extract_fields(shred(pages), sel).orderBy("page_id").collect()
    assert [tuple(r) for r in rows] == [(0, "Ab", "1", "", "", "http://a.com/1"), (1, "", "", "", "", "http://a.com/2")]


def test_validator_trims_left_scopes(spark, pages_df):
    html = '<div class="main"><article><h1>t</h1></article></div><footer>f</footer><span data-x="a b">s</span>'
    pages = pages_df([("http://a.com/1", html)])
    sel = selectors_frame(spark, {"a": "body div.other article h1", "b": "section > footer", "c": ".price",
                                  "d": "div > article", "e": '[data-x="a b"]', "f": "", "g": "zz [data-x=\"a b\"]"})
    got = {r.field: r.validated for r in validate_selectors(shred(pages), sel).collect()}
    # g: dropping "zz" leaves the valid '[data-x="a b"]', as split(" ", 1) does
    assert got == {"a": "article h1", "b": "footer", "c": "", "d": "div > article", "e": '[data-x="a b"]', "f": "",
                   "g": '[data-x="a b"]'}


def test_variant_fields(spark, pages_df):
    pages = pages_df([("http://a.com/1", '<ul class="s"><li>S</li><li>M</li></ul><b class="on">M</b>'),
                      ("http://a.com/2", '<ul class="s"><li>S</li></ul><b class="on">S</b>')])
    rec = spark.createDataFrame([(0, "", ".on", "ul.s"), (1, "", ".on", "ul.s")],
                                "page_id long, scope string, size string, size_container string")
    got = {r.page_id: (r.n_options, r.size, r.size_container) for r in variant_fields(shred(pages), rec).collect()}
    assert got == {0: (2, ".on", "ul.s"), 1: (1, "", "")}


def test_selector_records(spark):
    recs = spark.createDataFrame([
        ("a.com", "product", '{"price": ".p", "name": false, "extra": "x"}'),
        ("b.com", "product", '[{"name": "h1"}]'),
        ("c.com", "product", '{broken'),
        ("d.com", "listing", '{"product_card": ".c", "product_link": "a", "error": true}')],
        "scope string, kind string, json string")
    got = {}
    for r in records_to_rows(recs).orderBy("scope", "ord").collect():
        got.setdefault(r.scope, []).append((r.field, r.selector))
    assert got["a.com"][:3] == [("price", ".p"), ("name", ""), ("extra", "x")]
    assert [f for f, _ in got["a.com"]] == ["price", "name", "extra"] + [k for k in PRODUCT_KEYS if k not in ("price", "name")]
    assert got["b.com"][0] == ("name", "h1") and len(got["b.com"]) == len(PRODUCT_KEYS)
    assert "c.com" not in got
    assert got["d.com"] == [("product_card", ".c"), ("product_link", "a"), ("error", ""), ("pagination", "")]


def test_page_links_equal_the_node_table_links(spark, pages_df):
    """The direct link parse and the node table give the same edges, with and without base."""
    from sitelake.operators.links import extract_links, page_links
    from sitelake.operators.shred import shred
    pages = pages_df([
        ("http://a.com/d/1", '<base href="/e/"><base href="/f/"><a href="x">1</a><a>2</a><a href="">3</a><p><a href="http://b.com/">4</a>'),
        ("http://a.com/d/2", '<base><a href="x">1</a><base href=""><a href="#f">2</a>'),
        ("http://a.com/3", "no links"), ("http://a.com/4", "<base href><a href=y>z</a>")])
    one, two = (sorted(map(tuple, f.collect()), key=str) for f in (page_links(pages), extract_links(shred(pages))))
    assert one == two and len(one) == 5
    assert "Exchange" not in page_links(pages)._jdf.queryExecution().executedPlan().toString()
