"""Registered queries over the driver's tables and their DuckDB oracle SQL.

Every query reads the given parquet tables (mostly ``pages``) whole; parameters
(selectors, keywords, budgets) are the reference's own or small fixed records.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators.extract import extract_fields, selectors_frame
from ..operators.frontier import crawl, with_added_links
from ..operators.links import first_occurrence, link_scope_lists, page_links
from ..operators.candidates import candidate_cards as _candidate_cards, card_shapes as _card_shapes
from ..operators.listing import bootstrap_product_page, extract_listing_links, missing_selectors as _missing_selectors, with_site_progress
from ..operators.render import page_markdown as _page_markdown, page_metadata as _page_metadata
from ..plans.jobs import clean_pages, crawl_artifacts, listing_to_products
from ..operators.validate import pagination_links, selector_report as _selector_report, validate_selectors, variant_fields
from ..operators.shred import shred
from ..reports import site as R
from ..session import ensure_checkpoint_dir
from ..sinks.writers import artifacts, layer_fallback, page_layers, upsert_layers, write_selectors
from ..sources.pages import read_page_urls, read_pages
from ..sources.selectors import read_keywords, read_selectors, records_to_rows
from ..sources.sitemaps import expand_index, sample_candidates, untried, sitemap_diff as _sitemap_diff, sitemap_urls, sitemaps_from_pages

# Fixed parameters of the registered queries.
FLAGSHIP_SELECTORS = {"title": "h1", "ad": ".ad", "footer": "footer"}
LISTING_SELECTORS = {"product_card": "nav li", "product_link": "a", "pagination": ""}
KEYWORDS = ["the", "and", "en"]
SCORE_WEIGHT = 0.7
SCORE_THRESHOLD = 0.2
TOP_K = 3


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without their html, for queries over URLs alone."""
    return read_page_urls(spark, f"{sf_dir}/pages.parquet")


# Head elements that the driver's pages lack, by page number; an expression of both Spark and the oracle's SQL.
_HEAD = [
    (4, 0, """'<meta name="generator" content="WordPress 6.' || CAST(page_id % 10 AS STRING) || '">'"""),
    (5, 0, """'<meta property="og:title" content="Page ' || CAST(page_id AS STRING) || '">'"""),
    (2, 0, """'<meta name="description" content="About ' || CAST(page_id AS STRING) || '">'"""),
    (10, 4, """'<meta name="description" content="A second description">'"""),
    (3, 0, """'<link rel="canonical" href="' || replace(url, '&', '&amp;') || '">'"""),
    (6, 1, """'<script src="/assets/jquery-3.' || CAST(page_id % 7 AS STRING) || '.min.js"></script>'"""),
    (7, 2, """'<link rel="stylesheet" href="https://fonts.googleapis.com/css?family=A">'"""),
    (9, 3, """'<script src="/_next/static/chunk.js"></script><meta name="robots" content="NOINDEX, follow">'"""),
]
DESCRIBED_HTML = "replace(html, '<head>', '<head>' || " + " || ".join(
    f"CASE WHEN page_id % {m} = {r} THEN {text} ELSE '' END" for m, r, text in _HEAD) + ")"


def described_pages(spark, sf_dir):
    """The pages with head elements put in by page number, so that jobs over metadata find some."""
    return _pages(spark, sf_dir).select("page_id", "url", F.expr(DESCRIBED_HTML).alias("html"))


# Cards put before the footer of every page: links to the pages (a*i+b) mod n that exist, each card with classes of its own.
CARD_TARGETS = [(10, 1), (15, 2), (20, 3)]


def shop_pages(spark, sf_dir):
    """The pages with a block of product cards, read from the page table itself, that link to other landed pages."""
    pages = _pages(spark, sf_dir)
    n = pages.select(F.max("page_id") + 1).scalar()
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.pmod(F.col("page_id") * a + b, n).alias("to")) for k, (a, b) in enumerate(CARD_TARGETS, 1)])
    links = pages.select("page_id", F.explode(wanted).alias("w")).select("page_id", "w.k", "w.to")
    links = links.join(pages.select(F.col("page_id").alias("to"), F.col("url").alias("to_url")), "to")
    card = F.concat(F.lit('<div class="p'), F.col("k").cast("string"), F.lit("-"), (F.col("page_id") % 10).cast("string"), F.lit('"><a href="'),
                    F.replace("to_url", F.lit("&"), F.lit("&amp;")), F.lit('"><span>Page '), F.col("to").cast("string"), F.lit("</span></a><em>"),
                    F.col("k").cast("string"), F.lit("</em></div>"))
    blocks = links.select("page_id", "k", card.alias("card")).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("k", "card"))).alias("cards"))
    grid = F.concat(F.lit('<div class="grid">'), F.array_join(F.transform("cards", lambda c: c["card"]), ""), F.lit("</div><footer>"))
    return pages.join(blocks, "page_id", "left").select("page_id", "url", F.when(F.col("cards").isNotNull(), F.replace("html", F.lit("<footer>"), grid)).otherwise(F.col("html")).alias("html"))


# Selector records by site: the length of the site's name says which it has.
PRODUCT_RECORDS = {0: {"title": "h1", "ad": ".ad", "footer": "footer"}, 1: {"title": "head title", "ad": "body > div.ad", "footer": ""}}
LISTING_RECORDS = {0: {"product_card": "nav li", "product_link": "a", "pagination": ""}, 1: {"product_card": "nav li", "product_link": "", "pagination": ""}}


def site_selectors(pages: DataFrame) -> DataFrame:
    """Selector rows (scope, kind, field, ord, selector) per site of ``pages``; a third of the sites has no product record."""
    def rows(kind, record):
        return [F.struct(F.lit(kind).alias("kind"), F.lit(f).alias("field"), F.lit(i).alias("ord"), F.lit(s).alias("selector")) for i, (f, s) in enumerate(record.items())]

    size = F.length("scope")
    product = F.when(size % 3 == 0, F.array(*rows("product", PRODUCT_RECORDS[0]))).when(size % 3 == 1, F.array(*rows("product", PRODUCT_RECORDS[1])))
    listing = F.when(size % 2 == 0, F.array(*rows("listing", LISTING_RECORDS[0]))).otherwise(F.array(*rows("listing", LISTING_RECORDS[1])))
    sites = pages.select(U.domain("url").alias("scope")).distinct()
    every = F.concat(F.coalesce(product, F.filter(listing, lambda x: F.lit(False))), listing)
    return sites.select("scope", F.explode(every).alias("r")).select("scope", "r.kind", "r.field", "r.ord", "r.selector")


def _site_records(spark, sf_dir, kind):
    return site_selectors(_urls(spark, sf_dir)).filter(F.col("kind") == kind)


def site_fields(spark, sf_dir):
    """J1 + V5 + P2: every page's fields by the record of its own site; sites without a record have no rows."""
    return extract_fields(shred(_pages(spark, sf_dir)), _site_records(spark, sf_dir, "product"), list(PRODUCT_RECORDS[0]))


def site_listing_links(spark, sf_dir):
    """J1 + V2 + P5: listing links by the record of the page's own site; records without a link selector give none."""
    out = extract_listing_links(shred(_pages(spark, sf_dir)), _site_records(spark, sf_dir, "listing"))
    return out.select("page_id", F.col("pos").cast("long").alias("pos"), "url")


def missing_selectors(spark, sf_dir):
    """Sites with landed pages and no product record."""
    return _missing_selectors(_urls(spark, sf_dir), _site_records(spark, sf_dir, "product"))


def bootstrap_pages(spark, sf_dir):
    """V4 + F6: one product page for each of those sites that has a usable listing record."""
    return bootstrap_product_page(shred(_pages(spark, sf_dir)), _site_records(spark, sf_dir, "listing"), _site_records(spark, sf_dir, "product"))


def listing_products(spark, sf_dir):
    """V6: cards of every page -> links -> landed pages -> fields, in listing order."""
    pages = shop_pages(spark, sf_dir)
    listing = selectors_frame(spark, {"product_card": "div.grid > div", "product_link": "a"}, kind="listing")
    out, _ = listing_to_products(pages, pages, listing, selectors_frame(spark, {"title": "h1", "ad": ".ad"}))
    return out.select("listing_id", F.col("pos").cast("long").alias("pos"), "url", "title", "ad")


def card_shapes(spark, sf_dir):
    """V3 + A6 by shape: the repeated link-wrapping groups of every site, cards of differing classes among them."""
    out = _card_shapes(shop_pages(spark, sf_dir))
    return out.select("domain", "shape", "selector", "in_navigation", "n_pages", "n_cards", "rank")


def _shared(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def selector_store(spark, sf_dir):
    """K4 + S4 + F9: every site's records written as JSON files and read back, missing keys filled."""
    path = _shared(spark, "selector-store")
    write_selectors(site_selectors(_urls(spark, sf_dir)), path)
    return read_selectors(spark, path).select("scope", "kind", "field", F.col("ord").cast("long").alias("ord"), "selector")


# Answers as a language model may give them, by page number: the record's text with the site's name in it.
RECORD_TEXTS = [
    ("""'{"name":"h1 ' || domain || '","price":12,"brand":null}'""", [("name", "'h1 ' || domain"), ("price", "''"), ("brand", "''")]),
    ("""'[{"name":"' || domain || '","x":"y"},{"name":"z"}]'""", [("name", "domain"), ("x", "'y'")]),
    ("""'{broken ' || domain""", None),
    ("""'{"size":" .s ","error":false,"list":["' || domain || '"]}'""", [("size", "' .s '"), ("error", "''"), ("list", "''")]),
    ("""'[]' || substr(domain, 1, 0)""", None),
]


def normalized_records(spark, sf_dir):
    """one answer per page, normalised: first of a list, non-strings emptied, missing keys filled, broken ones dropped."""
    pages = _urls(spark, sf_dir).withColumn("domain", U.domain("url"))
    text = F.coalesce(*[F.when(F.col("page_id") % len(RECORD_TEXTS) == i, F.expr(t)) for i, (t, _) in enumerate(RECORD_TEXTS)])
    rows = records_to_rows(pages.select(F.col("page_id").cast("string").alias("scope"), F.lit("product").alias("kind"), text.alias("json")))
    return rows.select(F.col("scope").cast("long").alias("page_id"), "field", F.col("ord").cast("long").alias("ord"), "selector")


def keyword_lists(spark, sf_dir):
    """The words of every page's title as a keyword list."""
    titles = _pages(spark, sf_dir).select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("keywords"))
    k = read_keywords(titles)
    return k.select("page_id", F.size("keywords").cast("long").alias("n_keywords"), F.array_join("keywords", "\n").alias("keywords"))


def layer_fallbacks(spark, sf_dir):
    """K2: the clean copy, else the raw one, else none; a third of the pages lacks the clean copy, a fifth the raw one."""
    pages = _pages(spark, sf_dir)
    clean = F.when(F.col("page_id") % 3 != 0, T.exclude_tags(F.col("html"))).otherwise(F.lit(""))
    raw = F.when(F.col("page_id") % 5 != 0, F.col("html"))
    layers = pages.select("url", F.lit("clean").alias("layer"), clean.alias("html")).unionByName(pages.select("url", F.lit("raw").alias("layer"), raw.alias("html")))
    return layer_fallback(layers).select("url", F.md5("html").alias("html_md5"))


def layer_upserts(spark, sf_dir):
    """W5 + K1: three landings of the pages merged one after the other: all, a newer half, and an older third once more."""
    path = _shared(spark, "layers")
    pages = _pages(spark, sf_dir)
    for keep, at, mark in (("true", 1, ""), ("page_id % 2 = 0", 3, " newer"), ("page_id % 3 = 0", 2, " late"), ("page_id % 2 = 0", 3, " newer")):
        batch = pages.filter(keep).select("page_id", "url", F.concat("html", F.lit(mark)).alias("html"))
        upsert_layers(page_layers(batch, RUN_DATE).withColumn("landed_at", F.lit(at)), path)
    t = spark.read.parquet(path)
    return t.select("layer", "domain", "slug", "url", F.col("landed_at").cast("long").alias("landed_at"), F.md5("html").alias("html_md5"))


def sitemap_sample(spark, sf_dir):
    """Two candidate pages per site."""
    return sample_candidates(_urls(spark, sf_dir).select("page_id", "url"), n=2, seed=7).select("domain", "page_id", "url")


def untried_urls(spark, sf_dir):
    """T2 + T3: the sitemap's URLs (listed twice) that are not among the tried ones."""
    locs = sitemap_urls(sitemaps_from_pages(_urls(spark, sf_dir))).select(F.col("loc").alias("url"))
    return untried(locs.unionByName(locs), _urls(spark, sf_dir).filter("page_id % 4 = 0"))


def site_progress(spark, sf_dir):
    """Every page's number among its site's, and their count."""
    pages = _urls(spark, sf_dir).withColumn("domain", U.domain("url"))
    return with_site_progress(pages, "domain", "page_id").select("page_id", "domain", F.col("idx").cast("long").alias("idx"), F.col("n").cast("long").alias("n"))


def run_dates(spark, sf_dir):
    """F8: events per run date (Asia/Kolkata)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(U.run_date("ts").cast("string").alias("run_date")).agg(F.count(F.lit(1)).alias("n_events"))


def variant_rules(spark, sf_dir):
    """V9: size selectors kept only where the container holds two options or more; pages get none to three by number."""
    box = F.concat(F.lit('<div class="sizes">'), F.expr("repeat('<li><button>x</button></li>', int(page_id % 4))"), F.lit("</div><footer>"))
    pages = _pages(spark, sf_dir).select("page_id", "url", F.replace("html", F.lit("<footer>"), box).alias("html"))
    record = pages.select("page_id", F.lit("").alias("scope"), F.lit(".sizes button").alias("size"), F.lit(".sizes").alias("size_container"))
    v = variant_fields(shred(pages), record)
    return v.select("page_id", F.col("n_options").cast("long").alias("n_options"), "size", "size_container")


def scored_links(spark, sf_dir):
    """P7 + F12: one level of a crawl that follows only links whose score reaches the threshold."""
    pages = shop_pages(spark, sf_dir)
    edges = page_links(pages).select("src", "dst", "pos")
    seeds = pages.select(F.col("page_id").alias("seed_id"), "url")
    v = crawl(edges, seeds, "breadth", max_depth=1, max_pages=50, include_external=True, keywords=KEYWORDS, weight=SCORE_WEIGHT, threshold=SCORE_THRESHOLD, pages=pages)
    return v.filter("depth = 1").select("seed_id", "url", F.round("score", 9).alias("score"), "landed")


def url_keys(spark, sf_dir):
    p = _urls(spark, sf_dir)
    return p.select("page_id", "url", U.domain("url").alias("domain"), U.domain_folder("url").alias("domain_folder"),
                    U.slug("url").alias("slug"), U.page_folder("url").alias("page_folder"),
                    U.is_http_url("url").alias("is_http"))


def slug_collisions(spark, sf_dir):
    """(domain, slug) keys shared by different URLs (the reference's file overwrite)."""
    p = _urls(spark, sf_dir).select(U.domain("url").alias("domain"), U.slug("url").alias("slug"), "url")
    g = p.groupBy("domain", "slug").agg(F.count_distinct("url").alias("n_urls"), F.min("url").alias("first_url"),
                                        F.max("url").alias("last_url"))
    return g.filter(F.col("n_urls") > 1)


def field_h1_title(spark, sf_dir):
    """V5 flagship: first h1, .ad and footer text of every page."""
    nodes = shred(_pages(spark, sf_dir))
    return extract_fields(nodes, selectors_frame(spark, FLAGSHIP_SELECTORS))


def link_edges(spark, sf_dir):
    e = page_links(_pages(spark, sf_dir))
    return e.select("page_id", "src", F.col("pos").cast("long").alias("pos"), "href", "dst", "scope")


def first_links(spark, sf_dir):
    f = first_occurrence(page_links(_pages(spark, sf_dir)))
    return f.select("page_id", "dst", F.col("pos").cast("long").alias("pos"))


def card_links(spark, sf_dir):
    """V2 with card 'nav li' and link 'a'."""
    nodes = shred(_pages(spark, sf_dir))
    listing = selectors_frame(spark, LISTING_SELECTORS, kind="listing")
    out = extract_listing_links(nodes, listing)
    return out.select("page_id", F.col("pos").cast("long").alias("pos"), "url")


def link_scope_counts(spark, sf_dir):
    """G5 per page and scope ('all', 'internal', 'external'): list size and the ordered links, one per line."""
    return link_scope_lists(page_links(_pages(spark, sf_dir))).select("page_id", "scope", "n_links", F.array_join("links", "\n").alias("links"))


def domain_summary(spark, sf_dir):
    """A3: pages and links found per site."""
    pages = _pages(spark, sf_dir)
    e = page_links(pages).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("scope") == "internal").alias("n_internal"))
    docs = pages.select("page_id", U.domain("url").alias("domain"), "url")
    j = docs.join(e, "page_id", "left")
    return j.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if(F.col("url").startswith("https://")).alias("n_https"),
        F.coalesce(F.sum("n_links"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.sum("n_internal"), F.lit(0)).cast("long").alias("n_internal_links"))


def clean_html(spark, sf_dir):
    """F11 text form: page HTML without script, style, noscript, iframe, svg, canvas, link, meta."""
    p = _pages(spark, sf_dir)
    c = T.exclude_tags(F.col("html"))
    return p.select("page_id", "url", F.length(c).cast("long").alias("clean_len"), c.alias("clean_html"))


def keyword_rank(spark, sf_dir):
    """F12 + W4: per page the TOP_K links by keyword score (ties: link position)."""
    e = page_links(_pages(spark, sf_dir)).withColumn("score", T.keyword_score(F.col("dst"), KEYWORDS, SCORE_WEIGHT))
    w = Window.partitionBy("page_id").orderBy(F.col("score").desc(), F.col("pos"))
    r = e.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= TOP_K)
    return r.select("page_id", F.col("rank").cast("long").alias("rank"), "dst", "score")


# Crawl parameters of the reference: breadth (depth 20, 2 pages, internal), depth (depth 10,
# 50 pages, internal), best-first (depth 3, 25 pages, external allowed, keyword scorer, weight 0.7).

def _visits_out(v, *extra):
    return v.select("seed_id", "url", F.col("depth").cast("long").alias("depth"), "parent",
                    F.col("visit_order").cast("long").alias("visit_order"), "landed", *extra)


def frontier_breadth(spark, sf_dir):
    """G2 over the links of the pages with product cards, every page a seed (reference limits): two visits a seed, and
    the links to pages that are not landed reported."""
    pages = shop_pages(spark, sf_dir)
    edges = page_links(pages).select("src", "dst", "pos")
    seeds = pages.select(F.col("page_id").alias("seed_id"), "url")
    v = crawl(edges, seeds, "breadth", max_depth=20, max_pages=2, include_external=False, pages=pages)
    return _visits_out(v)


def landed_edges(pages: DataFrame) -> DataFrame:
    """Links between landed pages, read from the html of ``pages`` with two links to other pages added to each.

    The driver's pages link only to URLs that are not landed; the added links make their html a connected site.
    """
    return R.landed_links(page_links(with_added_links(pages)), pages)


def site_seeds(pages: DataFrame) -> DataFrame:
    """One seed per site: its page with the smallest id."""
    first = pages.groupBy(U.domain("url").alias("domain")).agg(F.min(F.struct("page_id", "url")).alias("p"))
    return first.select(F.col("p.page_id").alias("seed_id"), F.col("p.url").alias("url"))


def frontier_depths(spark, sf_dir):
    """G2 without budget from each site's first page, over links between landed pages: shortest depth per (seed, url)."""
    pages = _pages(spark, sf_dir)
    seeds = site_seeds(pages)
    v = crawl(landed_edges(pages), seeds, "breadth", max_depth=20, include_external=True, keep_tree=False)
    return v.select("seed_id", "url", F.col("depth").cast("long").alias("depth"))


OVERSCOPED_SELECTORS = {"title": "div.main article h1", "ad": "body div.ad", "footer": "section > footer",
                       "price": ".price", "links": "header nav a"}
REPORT_SELECTORS = {"title": "h1", "para": "p", "links": "nav a", "price": ".price", "items": "ul > li"}
PAGINATION_SELECTORS = {"product_card": "article", "product_link": "a", "pagination": "nav a"}


def validated_selectors(spark, sf_dir):
    """V1: each field's longest matching suffix on every page."""
    nodes = shred(_pages(spark, sf_dir))
    v = validate_selectors(nodes, selectors_frame(spark, OVERSCOPED_SELECTORS))
    return v.select("page_id", "url", "field", "selector", "validated")


def selector_report(spark, sf_dir):
    """A4: per field, pages checked, pages matched and total matches."""
    nodes = shred(_pages(spark, sf_dir))
    r = _selector_report(nodes, selectors_frame(spark, REPORT_SELECTORS))
    return r.select("field", "selector", "n_pages", "n_pages_matched", "n_matches")


def pagination_next(spark, sf_dir):
    """Next-page edge from the pagination selector."""
    nodes = shred(_pages(spark, sf_dir))
    return pagination_links(nodes, selectors_frame(spark, PAGINATION_SELECTORS, kind="listing"))


def candidate_cards(spark, sf_dir):
    """V3: repeated, link-wrapping element groups outside nav/header/footer, per site."""
    return _candidate_cards(shred(_pages(spark, sf_dir)))


def sitemap_products(spark, sf_dir):
    """V7: site indexes -> child sitemaps -> locs -> landed pages (J5) -> fields; sitemap duplicates kept."""
    pages = _pages(spark, sf_dir)
    docs = sitemaps_from_pages(pages)
    locs = expand_index(docs)
    fields = extract_fields(shred(pages), selectors_frame(spark, FLAGSHIP_SELECTORS))
    j = locs.join(fields, locs["loc"] == fields["url"])
    return j.select("sitemap_url", F.col("pos").cast("long").alias("pos"), *FLAGSHIP_SELECTORS.keys(), "url")


def sitemap_diff(spark, sf_dir):
    """The sitemap lists two thirds of the pages, three quarters are crawled, some under another spelling of their URL."""
    pages = _urls(spark, sf_dir)
    shout = F.concat(F.upper(F.regexp_extract("url", "^([a-z]+://[^/?#]+)(.*)$", 1)),
                     F.when(F.col("url").startswith("https:"), F.lit(":443")).otherwise(F.lit(":80")), F.regexp_extract("url", "^([a-z]+://[^/?#]+)(.*)$", 2))
    crawled = pages.filter("page_id % 4 <> 1").select(F.when(F.col("page_id") % 5 == 0, shout).otherwise(F.col("url")).alias("url"))
    return _sitemap_diff(sitemap_urls(sitemaps_from_pages(pages.filter("page_id % 3 <> 0"))), crawled)


RUN_DATE = "2026-01-01"  # run date of the layer/artifact tables (an argument, never "now")


def page_metadata(spark, sf_dir):
    """title, html lang, canonical link and the meta tags of every page, in order."""
    m = _page_metadata(described_pages(spark, sf_dir))
    tags = F.array_join(F.transform(F.map_entries("meta"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n")
    return m.select("page_id", "url", "title", "lang", "canonical", F.size("meta").cast("long").alias("n_meta"), tags.alias("meta"))


def page_markdown(spark, sf_dir):
    """markdown rendering of every page."""
    return _page_markdown(_pages(spark, sf_dir))


def clean_layers(spark, sf_dir):
    """V8 + K1 table: raw and clean layer keys, sizes and digests of every page."""
    l = clean_pages(_pages(spark, sf_dir), RUN_DATE)
    return l.select("url", "layer", F.col("date").cast("string").alias("date"), "domain", "slug",
                    F.length("html").cast("long").alias("n_chars"), F.md5("html").alias("html_md5"))


def artifact_long(spark, sf_dir):
    """G6 + K11: the artifacts of a crawl that visited every landed page."""
    pages = _pages(spark, sf_dir)
    a = crawl_artifacts(pages.select("url"), pages, RUN_DATE)
    return a.select("url", "kind", "ext", "domain_folder", "page_folder",
                    F.length("payload").cast("long").alias("n_bytes"), F.md5("payload").alias("payload_md5"))


def artifact_binaries(spark, sf_dir):
    """K7 + K9: screenshots (base64, some broken or missing) and PDF bytes put beside every page by its number, as artifacts."""
    third, even = F.col("page_id") % 3, F.col("page_id") % 2 == 0
    url = F.encode("url", "UTF-8")
    results = _pages(spark, sf_dir).select(
        "url", F.lit("").alias("cleaned_html"), F.lit("").alias("markdown"), F.lit(None).cast("map<string,string>").alias("metadata"),
        F.when(even, F.encode(F.concat(F.lit("pdf of "), F.col("url")), "UTF-8")).alias("pdf"),
        F.when(third == 0, F.base64(url)).when(third == 1, F.lit("a")).alias("screenshot"))
    a = artifacts(results, RUN_DATE).filter(F.col("kind").isin("screenshots", "PDF"))
    return a.select("url", "kind", "ext", "domain_folder", F.md5("payload").alias("payload_md5"))


def page_rank(spark, sf_dir):
    """O1: PageRank (20 iterations, damping 0.85) over the links between landed pages."""
    return R.page_rank(landed_edges(_pages(spark, sf_dir))).select("url", F.round("rank", 12).alias("rank"))


def orphan_pages(spark, sf_dir):
    """O2: landed pages that no card or link of a landed page leads to."""
    pages = shop_pages(spark, sf_dir)
    return R.orphan_pages(pages, page_links(pages))


def depth_distribution(spark, sf_dir):
    """O3: visits per depth of the unbudgeted breadth crawl from each site's first page."""
    pages = _pages(spark, sf_dir)
    seeds = site_seeds(pages)
    v = crawl(landed_edges(pages), seeds, "breadth", max_depth=20, include_external=True, keep_tree=False)
    return R.depth_distribution(v).select(F.col("depth").cast("long").alias("depth"), "n_visits", "n_seeds")


def hub_pages(spark, sf_dir):
    """Top 10 pages by out-degree over the pages' own links."""
    h = R.hub_pages(page_links(_pages(spark, sf_dir)), 10)
    return h.select("url", F.col("out_degree").cast("long").alias("out_degree"),
                    F.col("in_degree").cast("long").alias("in_degree"), F.col("rank").cast("long").alias("rank"))


def broken_links(spark, sf_dir):
    """Internal links whose target is not a landed page."""
    pages = shop_pages(spark, sf_dir)
    b = R.broken_links(page_links(pages), pages)
    return b.select("page_id", F.col("pos").cast("long").alias("pos"), "dst")


def seo_summary(spark, sf_dir):
    """O7 + O8: per-domain coverage of SEO signals and the weighted score."""
    pages = described_pages(spark, sf_dir)
    e = page_links(pages)
    landed = pages.select(F.col("url").alias("dst")).distinct().withColumn("_l", F.lit(True))
    e = e.join(landed, "dst", "left").withColumn("broken", (F.col("scope") == "internal") & F.col("_l").isNull())
    s = R.seo_summary(R.seo_signals(pages), e)
    return s.select("domain", "n_pages", "title", "one_h1", "meta_description", "canonical", "noindex",
                    F.col("n_internal_links").cast("long").alias("n_internal_links"),
                    F.col("n_broken_links").cast("long").alias("n_broken_links"), "links_ok", "seo_score")


def tech_fingerprint(spark, sf_dir):
    """Technologies per page by rules over the html and over meta, script and link elements."""
    return R.tech_fingerprint(described_pages(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "url_keys": url_keys,
    "slug_collisions": slug_collisions,
    "field_h1_title": field_h1_title,
    "link_edges": link_edges,
    "first_links": first_links,
    "card_links": card_links,
    "link_scope_counts": link_scope_counts,
    "domain_summary": domain_summary,
    "clean_html": clean_html,
    "keyword_rank": keyword_rank,
    "frontier_breadth": frontier_breadth,
    "frontier_depths": frontier_depths,
    "validated_selectors": validated_selectors,
    "selector_report": selector_report,
    "pagination_next": pagination_next,
    "candidate_cards": candidate_cards,
    "sitemap_products": sitemap_products,
    "sitemap_diff": sitemap_diff,
    "page_metadata": page_metadata,
    "page_markdown": page_markdown,
    "clean_layers": clean_layers,
    "card_shapes": card_shapes,
    "site_fields": site_fields,
    "site_listing_links": site_listing_links,
    "missing_selectors": missing_selectors,
    "bootstrap_pages": bootstrap_pages,
    "listing_products": listing_products,
    "selector_store": selector_store,
    "normalized_records": normalized_records,
    "keyword_lists": keyword_lists,
    "layer_fallbacks": layer_fallbacks,
    "layer_upserts": layer_upserts,
    "sitemap_sample": sitemap_sample,
    "untried_urls": untried_urls,
    "site_progress": site_progress,
    "run_dates": run_dates,
    "variant_rules": variant_rules,
    "scored_links": scored_links,
    "artifact_long": artifact_long,
    "artifact_binaries": artifact_binaries,
    "page_rank": page_rank,
    "orphan_pages": orphan_pages,
    "depth_distribution": depth_distribution,
    "hub_pages": hub_pages,
    "broken_links": broken_links,
    "seo_summary": seo_summary,
    "tech_fingerprint": tech_fingerprint,
}
