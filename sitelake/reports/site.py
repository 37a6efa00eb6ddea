"""Site reports named only in the reference's comments.

Not reference parity: data jobs over the node, link and visit tables.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import with_canonical_url
from ..operators.shred import _Shredder, page_elements
from ..session import Bucketed, materialize, release

# Technology rules. Public, well-known markers; extend by passing another list or table. Columns: name,
# category, where to look (html: the raw page; meta: content of a meta tag; script: src; link: href), the meta tag's name
# (or ''), pattern, literals. Where the pattern matches, one of the literals occurs in any case (None: look at every value).
TECH_RULES = [
    ("WordPress", "cms", "html", "", r"wp-content/|wp-includes/", ["wp-content/", "wp-includes/"]),
    ("Shopify", "cms", "html", "", r"cdn\.shopify\.com|Shopify\.theme", ["cdn.shopify.com", "shopify.theme"]),
    ("Ghost", "cms", "html", "", r'<meta[^>]+content="Ghost', ['content="ghost']),
    ("React", "framework", "html", "", r"data-reactroot|react(\.production)?(\.min)?\.js", ["data-reactroot", "react"]),
    ("Next.js", "framework", "html", "", r"/_next/static/|__NEXT_DATA__", ["/_next/static/", "__next_data__"]),
    ("Vue.js", "framework", "html", "", r"data-v-[0-9a-f]{6,}|vue(\.min)?\.js", ["data-v-", "vue"]),
    ("Svelte", "framework", "html", "", r"svelte-[a-z0-9]{5,}", ["svelte-"]),
    ("jQuery", "library", "html", "", r"jquery([.-][0-9.]+)?(\.min)?\.js", ["jquery"]),
    ("Bootstrap", "library", "html", "", r"bootstrap(\.min)?\.(css|js)", ["bootstrap"]),
    ("Google Analytics", "analytics", "html", "", r"google-analytics\.com|googletagmanager\.com|gtag\(", ["google-analytics.com", "googletagmanager.com", "gtag("]),
    ("Inline tracker", "analytics", "html", "", r"track\([0-9]+\)", ["track("]),
    ("Google Fonts", "fonts", "html", "", r"fonts\.googleapis\.com", ["fonts.googleapis.com"]),
    ("Cloudflare CDN", "cdn", "html", "", r"cdnjs\.cloudflare\.com", ["cdnjs.cloudflare.com"]),
    ("Ad slot", "ads", "html", "", r'class="[^"]*\bad\b[^"]*"', ["ad"]),
    ("WordPress", "cms", "meta", "generator", r"^WordPress", ["wordpress"]),
    ("WordPress 6.4 or later", "cms", "meta", "generator", r"^WordPress 6\.[4-9]", ["wordpress 6."]),
    ("Drupal", "cms", "meta", "generator", r"^Drupal", ["drupal"]),
    ("Open Graph", "metadata", "meta", "og:title", r".", None),
    ("jQuery", "library", "script", "", r"/jquery-[0-9.]+(\.min)?\.js$", ["/jquery-"]),
    ("Next.js", "framework", "script", "", r"^/_next/", ["/_next/"]),
    ("Google Fonts", "fonts", "link", "", r"^https://fonts\.googleapis\.com/", ["fonts.googleapis.com"]),
]
RULE_SCHEMA = "name string, category string, target string, key string, pattern string, literals array<string>"
RULE_BLOCK = 20_000  # rules that one pass over the pages looks for
# Weights of the domain SEO score (O8); any other weights can be passed.
SEO_WEIGHTS = {"title": 0.25, "one_h1": 0.25, "meta_description": 0.2, "canonical": 0.1, "links_ok": 0.2}


def page_rank(edges: DataFrame, iterations: int = 20, damping: float = 0.85, cut_every: int = 1) -> DataFrame:
    """O1: PageRank over the URL graph, fixed iterations; dangling mass spread evenly.

    URLs are mapped once to 64-bit ids. The links are written once as a table bucketed by their source, with its
    out-degree, so an iteration moves the ranks and the partial sums per target, never the links. A source's links are as
    many as its page holds; a target that very many pages link to is summed per task before it meets in one, so no
    hub is a task of its own. Lineage is cut (materialize) every ``cut_every`` iterations (each iteration reads the ranks
    twice, so an uncut plan doubles per iteration). Columns: url, rank (sums to 1).
    """
    spark = edges.sparkSession
    e0 = materialize(edges.select("src", "dst").distinct(), "pr_edges")
    ids = materialize(e0.select(F.col("src").alias("url")).union(e0.select(F.col("dst").alias("url"))).distinct()
                      .withColumn("uid", F.monotonically_increasing_id()), "pr_ids")
    n = ids.count()
    e = e0.join(ids.select(F.col("url").alias("src"), F.col("uid").alias("s")), "src") \
        .join(ids.select(F.col("url").alias("dst"), F.col("uid").alias("d")), "dst").select("s", "d")
    plain = materialize(e, "pr_plain")
    outdeg = materialize(plain.groupBy("s").agg(F.count(F.lit(1)).alias("deg")), "pr_outdeg")
    table = Bucketed(spark, "s BIGINT, d BIGINT, deg BIGINT", "s", "pr_links")
    table.add(plain.join(outdeg, "s").select("s", "d", "deg"))
    links = table.rows()
    release(e0, plain)
    nodes = ids.select("uid")
    ranks = nodes.withColumn("rank", F.lit(1.0 / n) if n else F.lit(0.0))
    last = None
    for i in range(1, iterations + 1):
        contrib = links.join(ranks.withColumnRenamed("uid", "s"), "s").groupBy("d").agg(
            F.sum(F.col("rank") / F.col("deg")).alias("c"))
        # mass of pages without out-links, as a scalar subquery (evaluated once per iteration)
        m = ranks.join(outdeg.withColumnRenamed("s", "uid"), "uid", "left_anti").select(
            F.coalesce(F.sum("rank"), F.lit(0.0))).scalar()
        ranks = nodes.join(contrib.withColumnRenamed("d", "uid"), "uid", "left").select(
            "uid", (F.lit((1 - damping) / max(n, 1)) + F.lit(damping) * (F.coalesce("c", F.lit(0.0)) + m / F.lit(float(max(n, 1)))))
            .alias("rank"))
        if i % cut_every == 0 or i == iterations:
            old, ranks = last, materialize(ranks, "pr_ranks")
            last = ranks
            if old is not None:
                release(old)
    table.drop()
    release(outdeg)
    return ranks.join(ids, "uid").select("url", "rank")


def landed_links(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """The edges (src, dst, pos) whose target is a landed page."""
    return edges.select("src", "dst", "pos").join(pages.select(F.col("url").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", "pos")


def orphan_pages(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """O2: landed pages no link points to, URLs compared in their canonical form."""
    linked = with_canonical_url(edges.select("dst").distinct(), "dst", "_to").select("_to").distinct()
    return with_canonical_url(pages.select("page_id", "url"), "url", "_to").join(linked, "_to", "left_anti").select("page_id", "url")


def depth_distribution(visits: DataFrame) -> DataFrame:
    """O3: visits per depth (over all seeds) and seeds reaching that depth."""
    return visits.groupBy("depth").agg(F.count(F.lit(1)).alias("n_visits"),
                                       F.count_distinct("seed_id").alias("n_seeds"))


def hub_pages(edges: DataFrame, k: int = 10) -> DataFrame:
    """Top-k pages by out-degree (distinct targets), with in-degree; ties by url."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("url")).agg(F.count(F.lit(1)).alias("out_degree"))
    inn = e.groupBy(F.col("dst").alias("url")).agg(F.count(F.lit(1)).alias("in_degree"))
    j = out.join(inn, "url", "full_outer").select("url", F.coalesce("out_degree", F.lit(0)).alias("out_degree"),
                                                  F.coalesce("in_degree", F.lit(0)).alias("in_degree"))
    # global top-k: each partition keeps its k best before the final merge (TakeOrderedAndProject)
    top = j.orderBy(F.col("out_degree").desc(), F.col("in_degree").desc(), "url").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("out_degree").desc(),
                                                                    F.col("in_degree").desc(), "url")))


def broken_links(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Internal links whose target has no landed page, URLs compared in their canonical form."""
    internal = with_canonical_url(edges.filter(F.col("scope") == "internal"), "dst", "_to")
    have = with_canonical_url(pages.select("url"), "url", "_to").select("_to").distinct()
    return internal.join(have, "_to", "left_anti").drop("_to")


def seo_signals(pages: DataFrame) -> DataFrame:
    """O7 per page: title, h1/h2 counts, meta description, canonical, noindex, counted inside the page's row."""
    def attr(e, key):
        return F.lower(F.coalesce(F.try_element_at(e["attrs"], F.lit(key)), F.lit("")))

    def count(ok):
        return F.size(F.filter("els", ok))

    els = page_elements(pages, ["title", "h1", "h2", "meta", "link"])
    return els.select(
        "page_id", "domain", "url",
        count(lambda e: e["tag"] == "title").alias("n_title"),
        count(lambda e: e["tag"] == "h1").alias("n_h1"),
        count(lambda e: e["tag"] == "h2").alias("n_h2"),
        count(lambda e: (e["tag"] == "meta") & (attr(e, "name") == "description")).alias("n_meta_description"),
        count(lambda e: (e["tag"] == "link") & F.array_contains(F.split(attr(e, "rel"), r"\s+"), "canonical")).alias("n_canonical"),
        count(lambda e: (e["tag"] == "meta") & (attr(e, "name") == "robots") & attr(e, "content").contains("noindex")).alias("n_noindex"))


def seo_summary(signals: DataFrame, edges: DataFrame, weights: dict | None = None) -> DataFrame:
    """O7 coverage per domain and O8 weighted score (0..1)."""
    w = weights or SEO_WEIGHTS
    links = edges.groupBy("page_id").agg(F.count_if(F.col("scope") == "internal").alias("n_internal"),
                                         F.count_if(F.col("broken")).alias("n_broken"))
    s = signals.join(links, "page_id", "left").na.fill(0)
    d = s.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.avg((F.col("n_title") > 0).cast("double")).alias("title"),
        F.avg((F.col("n_h1") == 1).cast("double")).alias("one_h1"),
        F.avg((F.col("n_meta_description") > 0).cast("double")).alias("meta_description"),
        F.avg((F.col("n_canonical") > 0).cast("double")).alias("canonical"),
        F.avg((F.col("n_noindex") > 0).cast("double")).alias("noindex"),
        F.sum("n_internal").alias("n_internal_links"), F.sum("n_broken").alias("n_broken_links"))
    d = d.withColumn("links_ok", F.when(F.col("n_internal_links") > 0,
                                        1 - F.col("n_broken_links") / F.col("n_internal_links")).otherwise(F.lit(1.0)))
    score = reduce(lambda a, b: a + b, [F.lit(float(v)) * F.col(k) for k, v in w.items()])
    return d.withColumn("seo_score", F.round(score / F.lit(float(sum(w.values()))), 6))


def _automaton(rules: list, html: bool):
    """(automaton over the rules' literals, ids of the rules without any); the automaton is None without literals."""
    import ahocorasick

    found, always = {}, []
    for r in rules:
        if (r["target"] == "html") == html:
            if r["literals"] is None:
                always.append(r["id"])
            for literal in r["literals"] or ():
                found.setdefault(literal.lower(), []).append(r["id"])
    machine = ahocorasick.Automaton()
    for literal, ids in found.items():
        if literal:
            machine.add_word(literal, ids)
        else:
            always += ids
    machine.make_automaton()
    return (machine if len(machine) else None), always


def _candidates(machine, always: list, text: str) -> set:
    hits = set(always)
    if machine is not None and text:
        for _, ids in machine.iter(text.lower()):
            hits.update(ids)
    return hits


def _seen_values(pages: DataFrame, rules: list) -> DataFrame:
    """(page_id, url, rule, value): the values in which a literal of a rule occurs; one pass of the automata per page."""
    kinds = {r["id"]: (r["target"], r["key"]) for r in rules}

    def run(batches):
        on_html, always_html = _automaton(rules, True)
        on_node, always_node = _automaton(rules, False)
        parser = _Shredder()
        for batch in batches:
            out = {"page_id": [], "url": [], "seen": []}
            for pid, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                seen = []
                hits = _candidates(on_html, always_html, html or "")
                if hits:
                    seen.append({"value": html or "", "rules": sorted(hits)})
                for r in parser.run(html or "") if on_node or always_node else ():
                    if r[5] not in ("meta", "script", "link"):
                        continue
                    attrs = dict(r[8] or ())
                    value = attrs.get({"meta": "content", "script": "src", "link": "href"}[r[5]])
                    if value is None:
                        continue
                    key = (attrs.get("name") or attrs.get("property") or "").lower()
                    hits = [x for x in _candidates(on_node, always_node, value) if kinds[x][0] == r[5] and kinds[x][1] in ("", key)]
                    if hits:
                        seen.append({"value": value, "rules": sorted(hits)})
                if seen:
                    for c, v in zip(out, (pid, url, seen)):
                        out[c].append(v)
            kind = pa.list_(pa.struct([("value", pa.string()), ("rules", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([pa.array(out["page_id"], pa.int64()), pa.array(out["url"], pa.string()), pa.array(out["seen"], kind)], list(out))

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = src.mapInArrow(run, "page_id long, url string, seen array<struct<value:string,rules:array<int>>>")
    rows = rows.select("page_id", "url", F.explode("seen").alias("s")).select("page_id", "url", F.col("s.value").alias("value"), F.col("s.rules").alias("rules"))
    return rows.select("page_id", "url", "value", F.explode("rules").alias("rule"))


def tech_fingerprint(pages: DataFrame, rules: list | DataFrame | None = None) -> DataFrame:
    """Technologies per page by rules over the raw html and over meta, script and link elements.

    ``rules`` has the columns of ``TECH_RULES``, as rows or as a table; rows of (name, category, pattern) look at the html
    and have no literals. Per page an automaton finds the rules of which a literal occurs, however many there are; these
    are joined with the rule table and tested exactly. Rules go in blocks of ``RULE_BLOCK``, which bounds automaton and
    broadcast. Pages of null html have no technology. Columns: page_id, url, name, category, each technology once a page.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rows = [r if len(r) == 6 else (r[0], r[1], "html", "", r[2], None) for r in (TECH_RULES if rules is None else rules)]
        rules = spark.createDataFrame(rows, RULE_SCHEMA)
    blocks = max(1, -(-rules.count() // RULE_BLOCK))
    block = F.pmod(F.xxhash64("name", "target", "key", "pattern"), F.lit(blocks))
    out = []
    for b in range(blocks):
        part = [{**r.asDict(), "id": i} for i, r in enumerate(rules.where(block == b).orderBy("name", "target", "key", "pattern").collect())]
        if not part:
            continue
        table = spark.createDataFrame([(r["id"], r["name"], r["category"], r["pattern"]) for r in part], "id int, name string, category string, pattern string")
        seen = _seen_values(pages.filter(F.col("html").isNotNull()), part)
        hits = seen.join(F.broadcast(table), F.col("rule") == F.col("id")).filter(F.rlike("value", F.col("pattern")))
        out.append(hits.select("page_id", "url", "name", "category"))
    if not out:
        return spark.createDataFrame([], "page_id long, url string, name string, category string")
    return reduce(DataFrame.unionByName, out).distinct()
