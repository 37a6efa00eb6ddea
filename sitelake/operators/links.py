"""Link graph from the node table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import domain, with_resolved_url
from .shred import documents, elements, link_rows


def base_hrefs(nodes: DataFrame) -> DataFrame:
    """First ``<base href>`` per page (a ``<base>`` without href counts as none)."""
    b = elements(nodes).filter((F.col("tag") == "base") & F.map_contains_key("attrs", F.lit("href")))
    return b.groupBy("page_id").agg(F.min_by(F.col("attrs")["href"], F.col("node_id")).alias("base_href"))


def page_bases(nodes: DataFrame) -> DataFrame:
    """(page_id, domain, url, base): links resolve against coalesce(base href, page url)."""
    docs = documents(nodes).select("page_id", "domain", "url")
    b = with_resolved_url(docs.join(base_hrefs(nodes), "page_id", "left"), "url", "base_href", "_base")
    return b.select("page_id", "domain", "url",
                    F.when(F.col("base_href").isNotNull(), F.col("_base")).otherwise(F.col("url")).alias("base"))


def resolve_hrefs(found: DataFrame, nodes: DataFrame, href_col: str = "href") -> DataFrame:
    """Add ``dst`` = href resolved against the page base, and the page's ``url``/``domain``."""
    bases = page_bases(nodes)
    return with_resolved_url(found.join(bases, "page_id"), "base", href_col, "dst")


def extract_links(nodes: DataFrame) -> DataFrame:
    """G1 edges: every ``a`` with a non-empty href, in document order.

    Columns: page_id, src, pos (1-based among the page's links), node_id, href,
    dst (resolved), scope ('internal' when dst has the page's domain).
    """
    a = elements(nodes).filter(F.col("tag") == "a").select(
        "page_id", "node_id", F.try_element_at("attrs", F.lit("href")).alias("href"))
    a = a.filter(F.col("href").isNotNull() & (F.col("href") != ""))
    a = a.withColumn("pos", F.row_number().over(Window.partitionBy("page_id").orderBy("node_id")))
    e = resolve_hrefs(a, nodes)
    scope = F.when(domain(F.col("dst")) == F.col("domain"), F.lit("internal")).otherwise(F.lit("external"))
    return e.select("page_id", F.col("url").alias("src"), "pos", "node_id", "href", "dst", scope.alias("scope"))


def page_links(pages: DataFrame) -> DataFrame:
    """G1 edges straight from the pages: the columns of ``extract_links`` without a node table or a shuffle."""
    e = link_rows(pages)
    scope = F.when(domain(F.col("dst")) == F.col("domain"), F.lit("internal")).otherwise(F.lit("external"))
    return e.select("page_id", F.col("url").alias("src"), "pos", "node_id", "href", "dst", scope.alias("scope"))


def first_occurrence(edges: DataFrame, key: str = "page_id", url: str = "dst", pos: str = "pos") -> DataFrame:
    """A2: one row per (key, url) keeping the first position (dedupe keeping first)."""
    return edges.groupBy(key, url).agg(F.min(pos).alias(pos))


def link_scope_lists(edges: DataFrame) -> DataFrame:
    """Per page and scope, the ordered link list and its size ('all' included). Columns: page_id, src, scope, n_links, links."""
    both = edges.select("page_id", "src", "pos", "dst", "scope").unionByName(
        edges.select("page_id", "src", "pos", "dst", F.lit("all").alias("scope")))
    agg = both.groupBy("page_id", "scope").agg(
        F.min("src").alias("src"), F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("_l"), F.count(F.lit(1)).alias("n_links"))
    return agg.select("page_id", "src", "scope", "n_links", F.transform("_l", lambda x: x["dst"]).alias("links"))
