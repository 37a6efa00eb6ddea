"""Selector checks against landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ustrip
from .extract import pages_in_scope
from .links import resolve_hrefs
from .select import GLOBAL, first_match, match
from .shred import elements

# Elements counted as selectable options inside a size container (V9).
OPTION_TAGS = ["button", "a", "input", "option", "li"]


def suffixes(selectors: DataFrame) -> DataFrame:
    """All left-trimmed forms of each selector: k=0 is the stripped selector, k=1 drops the
    part before the first space, and so on (a space inside a quoted value is cut too:
    such a suffix is invalid and matches nothing)."""
    s = selectors.select(F.coalesce("scope", F.lit(GLOBAL)).alias("scope"), "field", "ord",
                         F.coalesce(ustrip(F.col("selector")), F.lit("")).alias("selector"))
    parts = F.split(F.col("selector"), " ")
    s = s.withColumn("_parts", parts).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("_parts") - 1)))
    return s.select("scope", "field", "ord", "selector", "k",
                    F.array_join(F.slice("_parts", F.col("k") + 1, F.size("_parts") - F.col("k")), " ").alias("suffix"))


def validate_selectors(nodes: DataFrame, selectors: DataFrame) -> DataFrame:
    """V1: per page in scope and field, the longest suffix of the selector that matches the page.

    Columns: page_id, url, scope, field, ord, selector, validated ('' when no suffix matches).
    """
    suf = suffixes(selectors)
    queries = suf.filter(F.col("suffix") != "").select("scope", F.col("suffix").alias("selector")).distinct()
    hits = match(nodes, queries).select("page_id", "scope", F.col("selector").alias("suffix")).distinct()
    found = hits.join(suf, ["scope", "suffix"])
    # First valid suffix = smallest k
    best = found.groupBy("page_id", "scope", "field").agg(F.min_by("suffix", "k").alias("validated"))
    base = pages_in_scope(nodes, selectors).select("page_id", "domain", "url")
    sel = suf.filter(F.col("k") == 0).select("scope", "field", "ord", "selector")
    per_page = _pages_with_selectors(base, sel)
    out = per_page.join(best, ["page_id", "scope", "field"], "left")
    return out.select("page_id", "url", "scope", "field", "ord", "selector",
                      F.coalesce("validated", F.lit("")).alias("validated"))


def _pages_with_selectors(base: DataFrame, sel: DataFrame) -> DataFrame:
    """(page, selector row) pairs: site rows join on domain; the global record is one array of fields (a scalar
    subquery) that every page explodes, so no join is needed for it."""
    site = base.join(sel.filter(F.col("scope") != GLOBAL), base["domain"] == sel["scope"]).drop("domain")
    record = sel.filter(F.col("scope") == GLOBAL).agg(F.collect_list(F.struct("field", "ord", "selector"))).scalar()
    glob = base.select("page_id", "url", F.lit(GLOBAL).alias("scope"), F.explode(record).alias("_s")) \
        .select("page_id", "url", "scope", "_s.*")
    return site.select("page_id", "url", "scope", "field", "ord", "selector").unionByName(glob)


def variant_fields(nodes: DataFrame, record: DataFrame, size_field: str = "size",
                   container_field: str = "size_container") -> DataFrame:
    """V9: size and size_container are kept only where the container holds 2+ selectable options.

    ``record`` is the wide per-page output of V1 pivoted (page_id, scope, size, size_container)
    or any table with the two selector columns. Returns page_id, n_options, size, size_container.
    """
    cont = record.filter(F.col(container_field) != "").select(
        "page_id", "scope", F.col(container_field).alias("selector"))
    firsts = first_match(match(nodes, cont.select("scope", "selector").distinct()))
    firsts = firsts.join(cont, ["page_id", "scope", "selector"]).select(
        "page_id", F.col("node_id").alias("c_lo"), F.col("end_id").alias("c_hi"))
    opts = elements(nodes).filter(F.col("tag").isin(*OPTION_TAGS)).select("page_id", "node_id", "end_id")
    # an option element inside another one (li > a) is the same option: outermost ones count
    before = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.max("end_id").over(before) >= F.col("node_id"), F.lit(False))
    # options inside the container interval; the container table has one row per page
    held = opts.join(firsts, "page_id").filter((F.col("node_id") > F.col("c_lo")) & (F.col("node_id") <= F.col("c_hi")))
    n = held.withColumn("_in", inside).filter(~F.col("_in")) \
        .groupBy("page_id").agg(F.count(F.lit(1)).alias("n_options"))
    out = record.join(n, "page_id", "left").withColumn("n_options", F.coalesce("n_options", F.lit(0)))
    keep = F.col("n_options") >= 2
    return out.select("page_id", "n_options",
                      F.when(keep, F.col(size_field)).otherwise(F.lit("")).alias(size_field),
                      F.when(keep, F.col(container_field)).otherwise(F.lit("")).alias(container_field))


def pagination_links(nodes: DataFrame, listing: DataFrame) -> DataFrame:
    """The first element matching the 'pagination' selector with an href -> next-page edge."""
    pag = listing.filter((F.col("field") == "pagination") & (F.coalesce(F.btrim("selector"), F.lit("")) != "")) \
        .select(F.coalesce("scope", F.lit(GLOBAL)).alias("scope"), F.btrim("selector").alias("selector")).distinct()
    m = match(nodes, pag).withColumn("href", F.try_element_at("attrs", F.lit("href")))
    m = m.filter(F.col("href").isNotNull() & (F.col("href") != ""))
    first = m.groupBy("page_id").agg(F.min_by("href", "node_id").alias("href"))
    r = resolve_hrefs(first, nodes)
    return r.select("page_id", F.col("url").alias("src"), "dst", F.lit("next").alias("rel"))


def selector_report(nodes: DataFrame, selectors: DataFrame) -> DataFrame:
    """A4 per site and field: pages checked, pages where the selector matches, total matches."""
    s = selectors.select(F.coalesce("scope", F.lit(GLOBAL)).alias("scope"), "field",
                         F.coalesce(ustrip(F.col("selector")), F.lit("")).alias("selector"))
    m = match(nodes, s.filter(F.col("selector") != "").select("scope", "selector").distinct())
    counts = m.groupBy("page_id", "scope", "selector").agg(F.count(F.lit(1)).alias("n"))
    base = pages_in_scope(nodes, selectors).select("page_id", "domain", "url")
    pairs = _pages_with_selectors(base, s.withColumn("ord", F.lit(0)))
    j = pairs.join(counts, ["page_id", "scope", "selector"], "left")
    return j.groupBy("scope", "field", "selector").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("n").isNotNull()).alias("n_pages_matched"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_matches"))
