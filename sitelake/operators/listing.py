"""Listing pages: cards -> first link -> product URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import absolute_link
from ..sources.sitemaps import numbered
from .links import resolve_hrefs
from .select import GLOBAL, match


def _listing_queries(listing: DataFrame) -> DataFrame:
    """(scope, card, link) per site from long selector rows (kind='listing')."""
    sel = listing.select(F.coalesce("scope", F.lit(GLOBAL)).alias("scope"), "field",
                         F.coalesce(F.btrim("selector"), F.lit("")).alias("selector"))
    return sel.groupBy("scope").agg(
        F.max(F.when(F.col("field") == "product_card", F.col("selector"))).alias("card"),
        F.max(F.when(F.col("field") == "product_link", F.col("selector"))).alias("link"),
    ).filter((F.col("card") != "") & (F.col("link") != ""))  # P5: both needed


def card_links(nodes: DataFrame, listing: DataFrame) -> DataFrame:
    """Per card (in document order) its first descendant matching the link selector.

    Cards and link matches of a page are laid out in document order; the first
    link inside a card is the next link row after the card, kept only if it lies
    inside the card's interval. One window on page_id, no pairwise comparison.
    Columns: page_id, scope, card_pos, card_id, link_id, href (raw, may be '').
    """
    q = _listing_queries(listing)
    queries = q.select("scope", F.col("card").alias("selector")).unionByName(
        q.select("scope", F.col("link").alias("selector"))).distinct()
    m = match(nodes, queries).select("page_id", "scope", "selector", "node_id", "end_id", "attrs")
    cards = m.join(q.select("scope", F.col("card").alias("selector"), "link"), ["scope", "selector"]) \
        .select("page_id", "scope", "link", "node_id", "end_id", F.lit(1).alias("is_card"),
                F.lit(None).cast("string").alias("href"))
    links = m.join(q.select("scope", F.col("link").alias("selector")).distinct(), ["scope", "selector"]) \
        .select("page_id", "scope", F.col("selector").alias("link"), "node_id", "end_id", F.lit(0).alias("is_card"),
                F.coalesce(F.try_element_at("attrs", F.lit("href")), F.lit("")).alias("href"))
    both = cards.unionByName(links)
    # rows that follow a card in (node_id, cards last) order, as a running minimum from the end of the page
    after = Window.partitionBy("page_id", "scope", "link").orderBy(F.col("node_id").desc(), F.col("is_card").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    nxt = F.min(F.when(F.col("is_card") == 0, F.struct(F.col("node_id").alias("id"), F.col("href").alias("href")))).over(after)
    c = both.withColumn("_next", nxt).filter(F.col("is_card") == 1)
    c = c.withColumn("card_pos", F.row_number().over(Window.partitionBy("page_id", "scope").orderBy("node_id")))
    inside = F.col("_next.id") <= F.col("end_id")
    return c.select("page_id", "scope", "card_pos", F.col("node_id").alias("card_id"),
                    F.when(inside, F.col("_next.id")).alias("link_id"),
                    F.when(inside, F.col("_next.href")).alias("href"))


def extract_listing_links(nodes: DataFrame, listing: DataFrame) -> DataFrame:
    """V2: product URLs of listing pages, resolved, first occurrence kept.

    Columns: page_id, pos (1-based order of first occurrence), url.
    """
    cl = card_links(nodes, listing).filter(F.col("href").isNotNull() & (F.col("href") != ""))  # P3
    r = resolve_hrefs(cl, nodes).select("page_id", "card_pos", F.col("dst").alias("url"))
    first = r.groupBy("page_id", "url").agg(F.min("card_pos").alias("card_pos"))  # A2
    return first.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("card_pos")).alias("pos"),
                        "url")


def bootstrap_product_page(nodes: DataFrame, listing: DataFrame, product: DataFrame | None = None) -> DataFrame:
    """V4: one product URL per site that has no product selector yet (J6 anti-join).

    The first card of the site's first listing page (lowest page_id) and its first link, made absolute with F6. If
    that card has no link with an href the site gets no row: later cards are not tried. Columns: domain, url.
    """
    cl = card_links(nodes, listing)
    docs = nodes.filter(F.col("kind") == "document").select("page_id", "domain")
    first = cl.join(docs, "page_id").groupBy("domain").agg(
        F.min_by(F.struct("href"), F.struct("page_id", "card_pos")).alias("_f")).select("domain", F.col("_f.href").alias("href"))
    first = first.filter(F.coalesce(F.col("href"), F.lit("")) != "")
    out = first.select("domain", absolute_link(F.col("domain"), F.col("href")).alias("url"))
    if product is not None:
        have = product.select(F.col("scope").alias("domain")).distinct()
        out = out.join(have, "domain", "left_anti")
    return out


def landed(urls: DataFrame, pages: DataFrame, url_col: str = "url") -> tuple[DataFrame, DataFrame]:
    """(urls joined to landed pages - adds landed_id and html -, urls with no landed page)."""
    p = pages.select(F.col("url").alias(url_col), F.col("page_id").alias("landed_id"), "html")
    return urls.join(p, url_col, "inner"), urls.join(p.select(url_col), url_col, "left_anti")


def missing_selectors(pages: DataFrame, selectors: DataFrame, kind: str = "product") -> DataFrame:
    """J6 report: sites with landed pages but no stored selector record of ``kind``.

    Columns: domain, n_pages.
    """
    from ..functions.urls import domain as url_domain
    have = selectors.filter(F.col("kind") == kind).select(F.col("scope").alias("domain")).distinct()
    per_site = pages.groupBy(url_domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n_pages"))
    return per_site.join(have, "domain", "left_anti")


def with_progress(df: DataFrame, group: str, order: str) -> DataFrame:
    """``idx`` (1-based) and ``n`` per group in ``order`` - the reference's "i of n".

    For bounded groups (the URLs of one listing page or one sitemap file); ``with_site_progress`` numbers whole sites.
    """
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("idx", F.row_number().over(w)).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy(group)))


def with_site_progress(df: DataFrame, group: str, order: str) -> DataFrame:
    """W1 for groups of any size: the columns of ``with_progress``; ``order`` is a number.

    Rows are numbered within ranges of ``order`` and moved by the counts of the ranges before, so no task holds a group.
    """
    sizes = df.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
    counted = numbered(df, group, order).withColumnRenamed("n", "idx")
    return counted.join(sizes, F.col(group).eqNullSafe(F.col("_group"))).withColumnRenamed("_n", "n").drop("_group")
