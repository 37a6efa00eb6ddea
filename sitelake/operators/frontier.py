"""Crawl frontiers over landed pages and their links, for many seeds at once.

Fixed rules: a seed has depth 0 and uses one unit of the page budget; a URL is
visited at most once per seed; "internal" means the seed's domain; a link to a
URL with no landed page is reported but not visited: its row has the depth, parent
and path of its first link from a visited page, ``landed`` false and no
``visit_order``, and it takes nothing from the budget. Every visit carries ``path``,
the link positions from the seed along its discovery tree, which orders visits
without a global counter:

* breadth: (depth, path) - level by level, parents in visit order, then link position;
* depth: path - pre-order of the breadth-first discovery tree within max_depth, cut
  to the first max_pages (exact serial DFS is not parallel; this is its set-based
  re-aim);
* best: pop the highest score first (ties: depth, path), ``batch`` per seed per round.

Each round is one Spark job over all seeds; its output is written once as
parquet under the session's checkpoint folder and read back (``materialize``),
which cuts lineage and survives executor loss. The edge table is materialized
once per crawl. What a seed has visited or reported is one table bucketed by URL
id, to which each level is appended: the anti-join of a level shuffles its new
candidates only, not the levels before.
Per-seed budgets use a ``row_number`` bounded by a literal, which Spark turns
into a partial top-k before the shuffle, so a hot seed sends at most
``max_pages`` rows per partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_score
from ..functions.urls import domain
from ..session import Bucketed, ensure_checkpoint_dir, materialize, release

VISIT_COLS = ["seed_id", "url", "depth", "parent", "path", "score", "landed"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _expand(frontier: DataFrame, edges: DataFrame, depth_of_new, include_external: bool, threshold) -> DataFrame:
    """Out-links of frontier visits as candidate visits, in id space (scope and score filters applied).

    ``edges`` carries per target its keyword score and whether it has the domain of its source, computed once. A crawl
    that stays inside visits only pages of the seed's domain, so a link that keeps its page's domain keeps the seed's.
    """
    c = frontier.alias("f").join(edges.alias("e"), F.col("f.url") == F.col("e.src"))
    if not include_external:
        c = c.filter("e.same_site")  # P6
    if threshold is not None:
        c = c.filter(F.col("e.d_score") >= F.lit(float(threshold)))  # P7
    return c.select(
        F.col("f.seed_id").alias("seed_id"), F.col("e.dst").alias("url"), depth_of_new.alias("depth"), F.col("f.url").alias("parent"),
        F.concat(F.col("f.path"), F.array(F.col("e.pos").cast("int"))).alias("path"), F.col("e.d_score").alias("score"),
        F.col("e.d_landed").alias("landed"))


def _first_per_url(c: DataFrame) -> DataFrame:
    """One candidate per (seed, url): the smallest (depth, path); partial aggregation before the shuffle."""
    m = F.min(F.struct("depth", "path", "parent", "score", "landed")).alias("m")
    return c.groupBy("seed_id", "url").agg(m).select(
        "seed_id", "url", F.col("m.depth").alias("depth"),
        F.col("m.parent").alias("parent"), F.col("m.path").alias("path"), F.col("m.score").alias("score"), F.col("m.landed").alias("landed"))


class _Seen:
    """(seed_id, url) pairs of a crawl so far, bucketed by url and appended to level by level."""

    def __init__(self, first: DataFrame):
        self.table = Bucketed(first.sparkSession, f"seed_id {first.schema['seed_id'].dataType.simpleString()}, url BIGINT", "url", "crawl_seen")
        self.add(first)

    def add(self, visits: DataFrame) -> None:
        self.table.add(visits.select("seed_id", "url"))

    def new(self, candidates: DataFrame) -> DataFrame:
        """The candidates of pairs that are not in the table."""
        had = self.table.rows().select(F.col("seed_id").alias("_seed"), F.col("url").alias("_url"))
        dealt = candidates.repartition(self.table.buckets, "url")
        return dealt.join(had, (F.col("url") == F.col("_url")) & (F.col("seed_id") == F.col("_seed")), "left_anti")

    def drop(self) -> None:
        self.table.drop()


def _id_space(edges: DataFrame, seeds: DataFrame, keywords, weight, filters, pages=None):
    """Map URLs to 64-bit ids once: (ids, id-edges, id-seeds).

    Per URL: id, keyword score, the O11 filter flag and whether a page is landed (without ``pages``: all are); per edge
    whether both ends have one domain. So rounds move longs, and no string function runs per candidate. URLs that very
    many pages link to are hot only in the join that gives targets their ids, which AQE splits.
    """
    e = edges.select("src", "dst", "pos", (domain(F.col("src")) == domain(F.col("dst"))).alias("same_site"))
    e = materialize(e, "edges")  # read twice below: compute once
    urls = e.select(F.col("src").alias("url")).union(e.select(F.col("dst").alias("url"))) \
        .union(seeds.select("url")).distinct()
    ok = reduce(lambda a, b: a & b, filters) if filters else F.lit(True)
    if pages is None:
        urls = urls.withColumn("landed", F.lit(True))
    else:
        have = pages.select("url").distinct().withColumn("landed", F.lit(True))
        urls = urls.join(have, "url", "left").withColumn("landed", F.coalesce("landed", F.lit(False)))
    ids = materialize(urls.select("url", "landed", F.monotonically_increasing_id().alias("uid"),
                                  keyword_score(F.col("url"), keywords or [], weight).alias("score"), ok.alias("ok")), "crawl_ids")
    src = ids.select(F.col("url").alias("src_url"), F.col("uid").alias("src"))
    dst = ids.select(F.col("url").alias("dst_url"), F.col("uid").alias("dst"), F.col("score").alias("d_score"), F.col("ok").alias("d_ok"),
                     F.col("landed").alias("d_landed"))
    g = e.withColumnRenamed("src", "src_url").withColumnRenamed("dst", "dst_url") \
        .join(src, "src_url").join(dst, "dst_url").filter(F.col("d_ok"))  # O11 once per edge
    g = materialize(g.select("src", "dst", "pos", "same_site", "d_score", "d_landed"), "crawl_edges")
    release(e)
    v0 = seeds.join(ids, "url").select(
        "seed_id", F.col("uid").alias("url"), F.lit(0).alias("depth"),
        F.lit(None).cast("long").alias("parent"), F.array().cast("array<int>").alias("path"), "score", "landed")
    return ids, g, materialize(v0, "crawl_seeds")


def _to_urls(visits: DataFrame, ids: DataFrame, seeds: DataFrame) -> DataFrame:
    """Back from id space: url and parent as strings, and the seed's domain."""
    u = ids.select(F.col("uid").alias("url"), F.col("url").alias("_url"))
    p = ids.select(F.col("uid").alias("parent"), F.col("url").alias("_parent"))
    d = seeds.select("seed_id", domain(F.col("url")).alias("_dom"))
    v = visits.join(u, "url").join(p, "parent", "left").join(d, "seed_id")
    return v.select("seed_id", F.col("_dom").alias("seed_domain"), F.col("_url").alias("url"), "depth",
                    F.col("_parent").alias("parent"), "path", "score", "landed", "visit_order")


def crawl(edges: DataFrame, seeds: DataFrame, strategy: str = "breadth", max_depth: int = 20,
          max_pages: int | None = None, include_external: bool = False, keywords: list[str] | None = None,
          weight: float = 0.7, threshold: float | None = None, batch: int = 1,
          pages: DataFrame | None = None, allowed_domains: list[str] | None = None,
          url_pattern: str | None = None, keep_tree: bool = True) -> DataFrame:
    """Visit table of a crawl from every seed.

    edges(src, dst, pos): links between URLs; seeds(seed_id, url); pages(url)
    (optional) says which URLs are landed; without it all are. O11 filters: ``allowed_domains`` (domain
    of a candidate in the list) and ``url_pattern`` (regex a candidate must match);
    content-type filters need a type column the landed tables do not have. ``keep_tree=False``
    (breadth without budget only) computes reachability and depth alone: each level
    carries (seed, id) pairs, no parent or path. URLs are mapped to 64-bit ids for the
    rounds and back at the end. Returns seed_id, seed_domain, url, depth, parent, path,
    score, visit_order (1-based per seed; null for reported URLs and when an unbudgeted
    breadth run needs no order), landed (when ``pages`` is given).
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    filters = []
    if allowed_domains:
        filters.append(domain(F.col("url")).isin(*allowed_domains))
    if url_pattern:
        filters.append(F.col("url").rlike(url_pattern))
    ids, e, v0 = _id_space(edges, seeds, keywords, weight, filters, pages)
    if threshold is not None and not keywords:
        threshold = None  # P7 applies only with a scorer
    if strategy == "best":
        visits = _best_first(e.filter("d_landed"), v0, max_depth, max_pages if max_pages is not None else 2**31 - 1, include_external, threshold, batch)
    elif not keep_tree:
        if strategy != "breadth" or max_pages is not None:
            raise ValueError("keep_tree=False needs strategy='breadth' without max_pages")
        visits = _reach(e, v0, max_depth, include_external)
    elif strategy in ("breadth", "depth"):
        visits = _levels(e, v0, strategy, max_depth, max_pages, include_external, threshold)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    visits = _to_urls(visits, ids, seeds)
    return visits if pages is not None else visits.drop("landed")


def _levels(e, v0, strategy, max_depth, max_pages, include_external, threshold):
    parts = [v0]
    frontier = v0
    seen = _Seen(v0)
    for d in range(1, max_depth + 1):
        cand = _expand(frontier, e, F.lit(d), include_external, threshold)
        new = seen.new(_first_per_url(cand))  # partial aggregation before the shuffle on url
        if max_pages is not None and strategy == "breadth":
            # This level's visits in (parent order, link position) = path order, after the earlier levels
            taken = _union([p.filter("landed OR depth = 0").select("seed_id") for p in parts]).groupBy("seed_id").agg(F.count(F.lit(1)).alias("_taken"))
            rank = F.row_number().over(Window.partitionBy("seed_id").orderBy("path"))
            visited = new.filter("landed").withColumn("_r", rank).filter(F.col("_r") <= max_pages)
            visited = visited.join(taken, "seed_id").filter(F.col("_taken") + F.col("_r") <= max_pages).drop("_r", "_taken")
            new = visited.unionByName(new.filter("NOT landed"))
        new = materialize(new, "level")
        parts.append(new)
        frontier = new.filter("landed")
        if frontier.isEmpty():
            break
        if d < max_depth:
            seen.add(new)
    seen.drop()
    every = _union(parts)
    visits, reported = every.filter("landed OR depth = 0"), every.filter("NOT landed AND depth > 0").withColumn("visit_order", F.lit(None).cast("int"))
    if max_pages is not None or strategy == "depth":
        key = [F.col("depth"), F.col("path")] if strategy == "breadth" else [F.col("path")]
        visits = visits.withColumn("visit_order", F.row_number().over(Window.partitionBy("seed_id").orderBy(*key)))
        if max_pages is not None:
            # depth: the budget cuts the pre-order of the whole discovery tree (pruning earlier
            # would let a deeper node take a smaller path); a literal bound gives a partial top-k
            visits = visits.filter(F.col("visit_order") <= max_pages)
            if strategy == "depth":  # what only pages beyond the budget link to is not reported
                kept = visits.select("seed_id", F.col("url").alias("parent"))
                reported = reported.join(kept, ["seed_id", "parent"], "left_semi")
    else:
        visits = visits.withColumn("visit_order", F.lit(None).cast("int"))
    return visits.select(*VISIT_COLS, "visit_order").unionByName(reported.select(*VISIT_COLS, "visit_order"))


def _reach(g, v0, max_depth, include_external):
    """Shortest depth of every (seed, url id) within max_depth; only id pairs move between levels."""
    cols = ["seed_id", "url", "depth", "landed"]
    parts = [v0.select(*cols)]
    frontier = parts[0]
    seen = _Seen(v0)
    for d in range(1, max_depth + 1):
        c = frontier.join(g, frontier["url"] == g["src"]).select("seed_id", F.col("dst").alias("url"), "same_site", F.col("d_landed").alias("landed"))
        if not include_external:
            c = c.filter("same_site")  # P6
        new = seen.new(c.select("seed_id", "url", "landed").dropDuplicates(["seed_id", "url"])).withColumn("depth", F.lit(d))
        new = materialize(new.select(*cols), "reach")
        frontier = new.filter("landed")
        if new.isEmpty():
            break
        parts.append(new)
        if frontier.isEmpty():
            break
        if d < max_depth:
            seen.add(new)
    seen.drop()
    return _union(parts).select("seed_id", "url", "depth", F.lit(None).cast("long").alias("parent"),
                                F.lit(None).cast("array<int>").alias("path"), F.lit(None).cast("double").alias("score"), "landed",
                                F.lit(None).cast("int").alias("visit_order"))


def _best_first(e, v0, max_depth, max_pages, include_external, threshold, batch):
    """State table per round: visited rows (visit_order set) and the candidate pool (visit_order null)."""
    visited = v0.withColumn("visit_order", F.lit(1))
    first = _expand(v0, e, F.lit(1), include_external, threshold).filter(F.col("depth") <= max_depth)
    first = first.join(v0.select("seed_id", "url"), ["seed_id", "url"], "left_anti")
    pool = _first_per_url(first).withColumn("visit_order", F.lit(None).cast("int"))
    state = materialize(visited.unionByName(pool), "best")
    for step in range(1, max_pages):
        vis = state.filter(F.col("visit_order").isNotNull())
        pool = state.filter(F.col("visit_order").isNull()).drop("visit_order")
        seen = vis.groupBy("seed_id").agg(F.max("visit_order").alias("_seen"))
        # Pop `batch` per seed by score desc, then depth, then path (partial top-k before the shuffle)
        w = Window.partitionBy("seed_id").orderBy(F.col("score").desc(), "depth", "path")
        pick = pool.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= batch)
        pick = pick.join(seen, "seed_id").filter(F.col("_seen") + F.col("_r") <= max_pages)
        pick = pick.withColumn("visit_order", (F.col("_seen") + F.col("_r")).cast("int")).drop("_r", "_seen")
        grown = _expand(pick, e, F.col("f.depth") + 1, include_external, threshold) \
            .filter(F.col("depth") <= max_depth)
        # a URL already pooled may be found again by a shorter path: the merge keeps the smallest (depth, path)
        done = vis.select("seed_id", "url").unionByName(pick.select("seed_id", "url"))
        grown = grown.join(done, ["seed_id", "url"], "left_anti")
        rest = pool.join(pick.select("seed_id", "url"), ["seed_id", "url"], "left_anti")
        new_pool = _first_per_url(rest.unionByName(grown)).withColumn("visit_order", F.lit(None).cast("int"))
        old, state = state, materialize(vis.unionByName(pick).unionByName(new_pool), "best")
        release(old)
        if state.filter(F.col("visit_order") == step + 1).isEmpty():
            break
    return state.filter(F.col("visit_order").isNotNull()).select(*VISIT_COLS, "visit_order")


def with_added_links(pages: DataFrame, multipliers: tuple[tuple[int, int], ...] = ((7, 1), (3, 2))) -> DataFrame:
    """``pages`` with links appended to the html: page i links to pages (a*i+b) mod n, n = max(page_id)+1.

    Derived input for the crawl reports: the graph is then read from the html like any other.
    """
    e = synthetic_edges(pages, multipliers).groupBy(F.col("src").alias("url")).agg(F.sort_array(F.collect_list(F.struct("pos", "dst"))).alias("_l"))
    quoted = lambda x: F.concat(F.lit('<a href="'), F.replace(F.replace(x["dst"], F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('">more</a>'))
    added = F.coalesce(F.array_join(F.transform("_l", quoted), ""), F.lit(""))
    return pages.join(e, "url", "left").select("page_id", "url", F.concat("html", added).alias("html"))


def synthetic_edges(pages: DataFrame, multipliers: tuple[tuple[int, int], ...] = ((7, 1), (3, 2))) -> DataFrame:
    """Test graph derived from the page table: page i links to pages (a*i+b) mod n, n = max(page_id)+1.

    The driver's pages link only to URLs that are not landed, so crawls over them
    stop at depth 1; this gives a graph over landed pages of the same size.
    """
    p = pages.select("page_id", "url")
    n = p.select(F.max("page_id") + 1).scalar()  # scalar subquery, evaluated once
    links = [
        p.select(F.col("url").alias("src"), F.pmod(F.col("page_id") * a + b, n).alias("dst_id"),
                 F.lit(k + 1).alias("pos"))
        for k, (a, b) in enumerate(multipliers)
    ]
    links = _union(links)
    dst = p.select(F.col("page_id").alias("dst_id"), F.col("url").alias("dst"))
    return links.join(dst, "dst_id").select("src", "dst", "pos")
