"""Repeated card structures (A6) and candidate listing selectors (V3).

The listing step of the reference asks a language model for "repeated product
cards that wrap a link, not in navigation". Here it is a table over landed
pages: element groups that repeat under one parent, contain an anchor, and lie
outside nav/header/footer, with a support count per site for a person or the
validator (V1) to check.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import domain as url_domain
from .shred import _Shredder, elements

# Regions whose repeated items are navigation, not products.
EXCLUDED_REGIONS = ["nav", "header", "footer"]
# class names ending in a build hash (e.g. name__a1b2c3) keep only their stable prefix
HASH_SUFFIX = r"(__|--|_|-)[A-Za-z0-9]*[0-9][A-Za-z0-9]*$"


def _group_key() -> tuple:
    cls = F.try_element_at(F.col("classes"), F.lit(1))
    prefix = F.regexp_replace(cls, HASH_SUFFIX, "")
    hashed = cls.isNotNull() & (prefix != cls) & (prefix != "")
    data_attr = F.try_element_at(F.array_sort(F.filter(F.map_keys("attrs"), lambda k: k.startswith("data-"))), F.lit(1))
    sel = (F.when(hashed, F.concat(F.col("tag"), F.lit('[class*="'), prefix, F.lit('"]')))
           .when(cls.isNotNull(), F.concat(F.col("tag"), F.lit("."), cls))
           .when(data_attr.isNotNull(), F.concat(F.col("tag"), F.lit("["), data_attr, F.lit("]")))
           .otherwise(F.col("tag")))
    return sel


def element_flags(nodes: DataFrame) -> DataFrame:
    """Elements with has_link (an a[href] below) and excluded (inside nav/header/footer).

    Both come from windows over the page in document order (no pairwise join):
    the next anchor after an element is inside it iff its id <= end_id; an element is
    inside an excluded region iff the running max end_id of earlier region elements
    reaches it.
    """
    els = elements(nodes)
    is_link = (F.col("tag") == "a") & (F.coalesce(F.try_element_at("attrs", F.lit("href")), F.lit("")) != "")
    is_region = F.col("tag").isin(*EXCLUDED_REGIONS)
    after = Window.partitionBy("page_id").orderBy(F.col("node_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    nxt = F.min(F.when(is_link, F.col("node_id"))).over(after)
    reach = F.max(F.when(is_region, F.col("end_id"))).over(before)
    return els.withColumn("has_link", F.coalesce(nxt <= F.col("end_id"), F.lit(False))) \
        .withColumn("excluded", F.coalesce(reach >= F.col("node_id"), F.lit(False)))


def repeated_groups(nodes: DataFrame, min_repeat: int = 2) -> DataFrame:
    """(page, parent, selector) groups of sibling elements repeated at least ``min_repeat`` times."""
    f = element_flags(nodes).withColumn("selector", _group_key())
    return f.groupBy("page_id", "domain", "parent_id", "selector", "excluded").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if("has_link").alias("n_with_link"),
    ).filter(F.col("n_items") >= min_repeat)


def candidate_cards(nodes: DataFrame, min_repeat: int = 2) -> DataFrame:
    """V3: per site, card selectors ranked by the number of pages that show them.

    A group qualifies when it repeats and every item wraps a link. Groups inside
    nav/header/footer are kept but flagged ``in_navigation`` and ranked after the
    others, apart from the same selector's groups elsewhere. Columns: domain, selector, in_navigation, n_pages, n_cards, rank.
    """
    g = repeated_groups(nodes, min_repeat).filter(F.col("n_with_link") == F.col("n_items"))
    per_site = g.groupBy("domain", "selector", F.col("excluded").alias("in_navigation")).agg(
        F.count_distinct("page_id").alias("n_pages"), F.sum("n_items").cast("long").alias("n_cards"))
    w = Window.partitionBy("domain").orderBy("in_navigation", F.col("n_pages").desc(), F.col("n_cards").desc(),
                                             "selector")
    return per_site.withColumn("rank", F.row_number().over(w).cast("long"))


# ---- groups of equal shape, whatever their classes --------------------------------------------------------------

def subtree_shapes(rows: list) -> tuple[dict[int, str], dict[int, str]]:
    """(fingerprint, label) of every element of one shredded page, from the leaves up.

    A fingerprint covers the tags of the whole subtree; children that repeat the fingerprint of the child before them
    count once, so a list of three and one of five items have one shape. The label shows the tag and its children's.
    """
    below: dict[int, list[tuple[str, str]]] = {}
    prints, labels = {}, {}
    for r in reversed(rows):
        if r[4] != "element":
            continue
        children = below.pop(r[0], [])[::-1]
        kept = [c for i, c in enumerate(children) if not i or c[0] != children[i - 1][0]]
        prints[r[0]] = hashlib.blake2b(" ".join([r[5], "(", *(c[0] for c in kept), ")"]).encode(), digest_size=8).hexdigest()
        labels[r[0]] = r[5] + (f"({','.join(c[1] for c in kept[:8])})" if kept else "")
        below.setdefault(r[2], []).append((prints[r[0]], r[5]))
    return prints, labels


def _common_selector(items: list, parent) -> str:
    """A selector of sibling elements: their tag with a class, class beginning or data attribute that all have, below the parent's own."""
    tag = items[0][5]
    classes = set(items[0][7]).intersection(*(set(r[7]) for r in items))
    if classes:
        return f"{tag}.{min(classes)}"
    stems = [{re.sub(HASH_SUFFIX, "", c) for c in r[7]} for r in items]
    stems = {s for s in set.intersection(*stems) if s}
    if stems:
        return f'{tag}[class*="{min(stems)}"]'
    data = set.intersection(*({k for k, _ in r[8] or () if k.startswith("data-")} for r in items))
    if data:
        return f"{tag}[{min(data)}]"
    if parent[4] != "element":
        return tag
    above = parent[5] + (f".{parent[7][0]}" if parent[7] else "")
    return f"{above} > {tag}"


def shape_groups(rows: list, min_repeat: int) -> list[dict]:
    """Groups of at least ``min_repeat`` siblings of one shape that each wrap a link, of one shredded page."""
    prints, labels = subtree_shapes(rows)
    groups: dict[tuple[int, str], list] = {}
    links, region_end, excluded = [], -1, set()
    for r in rows:
        if r[4] != "element":
            continue
        if r[5] in EXCLUDED_REGIONS and r[1] > region_end:
            region_end = r[1]
        if r[0] <= region_end:
            excluded.add(r[0])
        if r[5] == "a" and dict(r[8] or ()).get("href"):
            links.append(r[0])
        groups.setdefault((r[2], prints[r[0]]), []).append(r)
    links.append(1 << 31)
    out, at = [], 0
    by_start = sorted((r[0], r[1]) for items in groups.values() if len(items) >= min_repeat for r in items)
    wraps = set()
    for lo, hi in by_start:  # the next link after an element's start is inside it or none is; links and elements come in order
        while links[at] <= lo:
            at += 1
        if links[at] <= hi:
            wraps.add(lo)
    for (parent, fingerprint), items in groups.items():
        if len(items) >= min_repeat and all(r[0] in wraps for r in items):
            out.append({"parent_id": parent, "fingerprint": fingerprint, "shape": labels[items[0][0]], "selector": _common_selector(items, rows[parent]),
                        "in_navigation": items[0][0] in excluded, "n_items": len(items)})
    return out


_SHAPE = [("parent_id", "int"), ("fingerprint", "string"), ("shape", "string"), ("selector", "string"), ("in_navigation", "boolean"), ("n_items", "int")]
_SHAPE_TYPES = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def repeated_shapes(pages: DataFrame, min_repeat: int = 2) -> DataFrame:
    """A6 by shape: page_id, domain and the groups of ``shape_groups``; only they leave the parse, without node table or shuffle."""

    def run(batches):
        parser = _Shredder()
        for batch in batches:
            cols = {c: [] for c in ["page_id", "domain", *(n for n, _ in _SHAPE)]}
            for pid, dom, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "domain", "html"))):
                for g in shape_groups(parser.run(html or ""), min_repeat):
                    cols["page_id"].append(pid)
                    cols["domain"].append(dom)
                    for n, _ in _SHAPE:
                        cols[n].append(g[n])
            yield pa.RecordBatch.from_pydict(cols, schema=pa.schema([("page_id", pa.int64()), ("domain", pa.string()), *((n, _SHAPE_TYPES[t]) for n, t in _SHAPE)]))

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), url_domain("url").alias("domain"), "html")
    return src.mapInArrow(run, "page_id long, domain string, " + ", ".join(f"{n} {t}" for n, t in _SHAPE))


def card_shapes(pages: DataFrame, min_repeat: int = 2) -> DataFrame:
    """V3 by shape: per site, the shapes of repeated, link-wrapping sibling groups, ranked by the pages that show them.

    Cards whose classes differ (build hashes, states) are one group. ``selector`` is the one that most pages agree on (ties:
    the smallest). Groups inside nav, header or footer come after the others. Columns: domain, shape, fingerprint,
    selector, in_navigation, n_pages, n_cards, rank.
    """
    g = repeated_shapes(pages, min_repeat)
    votes = g.groupBy("domain", "fingerprint", "in_navigation", "selector").agg(
        F.count_distinct("page_id").alias("votes"), F.min("shape").alias("shape"))
    chosen = votes.groupBy("domain", "fingerprint", "in_navigation").agg(
        F.min(F.struct((-F.col("votes")).alias("v"), "selector", "shape")).alias("s"))
    sums = g.groupBy("domain", "fingerprint", "in_navigation").agg(
        F.count_distinct("page_id").alias("n_pages"), F.sum("n_items").cast("long").alias("n_cards"))
    per_site = sums.join(chosen, ["domain", "fingerprint", "in_navigation"])
    w = Window.partitionBy("domain").orderBy("in_navigation", F.col("n_pages").desc(), F.col("n_cards").desc(), "s.selector", "fingerprint")
    return per_site.select("domain", F.col("s.shape").alias("shape"), "fingerprint", F.col("s.selector").alias("selector"), "in_navigation",
                           "n_pages", "n_cards", F.row_number().over(w).cast("long").alias("rank"))
