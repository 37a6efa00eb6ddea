"""Reports: PageRank against numpy power iteration; tech rules; hub top-k."""
import numpy as np

from sitelake.reports.site import hub_pages, page_rank, tech_fingerprint


def test_page_rank_matches_power_iteration(spark):
    n = 9
    edges = [(i, (7 * i + 1) % n) for i in range(n)] + [(i, (3 * i + 2) % n) for i in range(n) if i != 4]
    edges = [e for e in edges if e[0] != 6]  # node 6 has no out-links (dangling)
    df = spark.createDataFrame([(f"u{a}", f"u{b}") for a, b in edges], "src string, dst string")
    got = {r.url: r.rank for r in page_rank(df, iterations=30).collect()}
    nodes = sorted({a for a, _ in edges} | {b for _, b in edges})
    idx = {v: i for i, v in enumerate(nodes)}
    m = len(nodes)
    out = {a: sorted({b for x, b in edges if x == a}) for a in nodes}
    r = np.full(m, 1.0 / m)
    for _ in range(30):
        nr = np.full(m, 0.15 / m)
        dangling = sum(r[idx[a]] for a in nodes if not out[a])
        nr += 0.85 * dangling / m
        for a in nodes:
            for b in out[a]:
                nr[idx[b]] += 0.85 * r[idx[a]] / len(out[a])
        r = nr
    for a in nodes:
        assert abs(got[f"u{a}"] - r[idx[a]]) < 1e-9
    assert abs(sum(got.values()) - 1.0) < 1e-9


def test_tech_fingerprint_and_hubs(spark):
    pages = spark.createDataFrame([
        (1, "http://a.com/", '<script src="/wp-content/x.js"></script><script src="jquery-3.6.0.min.js"></script>'),
        (2, "http://b.com/", '<div data-reactroot=""><div class="x ad y">z</div></div>')], "page_id long, url string, html string")
    got = sorted((r.page_id, r.name) for r in tech_fingerprint(pages).collect())
    assert got == [(1, "WordPress"), (1, "jQuery"), (2, "Ad slot"), (2, "React")]
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("a", "b")], "src string, dst string")
    h = [(r.url, r.out_degree, r.in_degree, r.rank) for r in hub_pages(edges, 2).orderBy("rank").collect()]
    assert h == [("a", 2, 0, 1), ("b", 1, 1, 2)]


def test_rules_on_elements_and_automaton(spark, monkeypatch):
    import sitelake.reports.site as R

    pages = spark.createDataFrame([
        (1, "http://a.com/", '<meta name="Generator" content="WordPress 6.5"><script src="/js/jquery-3.1.min.js"></script><p>Drupal</p>'),
        (2, "http://b.com/", '<meta property="og:title" content="x"><link rel="stylesheet" href="HTTPS://fonts.googleapis.com/css"><meta content="drupal">'),
        (3, "http://c.com/", None), (4, "http://d.com/", ""), (5, "http://e.com/", '<link href="https://fonts.googleapis.com/css?a&amp;b">')],
        "page_id long, url string, html string")
    got = sorted((r.page_id, r.name) for r in tech_fingerprint(pages).collect())
    assert got == [(1, "WordPress"), (1, "WordPress 6.4 or later"), (1, "jQuery"), (2, "Google Fonts"), (2, "Open Graph"), (5, "Google Fonts")]
    # a thousand rules in several blocks, with overlapping, empty, missing and upper-case literals
    rows = [(f"w{i}", "c", "html", "", f"word{i}\\b", [f"WORD{i}"]) for i in range(1000)]
    rows += [("any", "c", "html", "", "^$|x", None), ("blank", "c", "script", "", "js$", [""]), ("w5", "c", "html", "", "word5", ["word5"])]
    monkeypatch.setattr(R, "RULE_BLOCK", 300)
    text = spark.createDataFrame([(1, "u", "word7 word77, word777x <script src=/a.js>"), (2, "v", ""), (3, "w", "WORD7 word5 word55")], "page_id long, url string, html string")
    want = [(1, "blank"), (1, "any"), (1, "w7"), (1, "w77"), (2, "any"), (3, "w5"), (3, "w55")]
    for rules in (rows, spark.createDataFrame(rows, R.RULE_SCHEMA)):
        assert sorted((r.page_id, r.name) for r in tech_fingerprint(text, rules).collect()) == sorted(want)
    assert tech_fingerprint(text, []).collect() == []


def test_default_literals_are_required_by_their_patterns():
    import re

    from sitelake.reports.site import TECH_RULES

    samples = ["wp-content/", "wp-includes/", "cdn.shopify.com", "Shopify.theme", '<meta name="g" content="Ghost', "data-reactroot", "react.production.min.js", "react.js",
               "/_next/static/", "__NEXT_DATA__", "data-v-0a1b2c", "vue.min.js", "svelte-ab12c", "jquery-3.6.0.min.js", "jquery.js", "bootstrap.min.css", "google-analytics.com",
               "googletagmanager.com", "gtag(", "track(12)", "fonts.googleapis.com", "cdnjs.cloudflare.com", 'class="x ad y"', "WordPress 6.4", "Drupal 10", "x", "/a/jquery-3.1.js",
               "/_next/x", "https://fonts.googleapis.com/css"]
    for name, _, _, _, pattern, literals in TECH_RULES:
        hits = [s for s in samples if re.search(pattern, s)]
        assert hits and (literals is None or all(any(x in s.lower() for x in literals) for s in hits)), name


def test_reports_compare_canonical_urls(spark):
    from sitelake.reports.site import broken_links, orphan_pages

    pages = spark.createDataFrame([(1, "http://a.com/y"), (2, "HTTP://A.com:80/z#t"), (3, "http://a.com/lonely")], "page_id long, url string")
    edges = spark.createDataFrame([(1, 1, "http://a.com/y#top", "internal"), (1, 2, "http://a.com/./z", "internal"), (1, 3, "http://a.com/gone", "internal"),
                                   (2, 1, "http://b.com/x", "external")], "page_id long, pos int, dst string, scope string")
    assert [r.page_id for r in orphan_pages(pages, edges).collect()] == [3]
    assert [(r.page_id, r.dst) for r in broken_links(edges, pages).collect()] == [(1, "http://a.com/gone")]


def test_link_files_straight_from_the_links(spark, tmp_path):
    from sitelake.operators.links import link_scope_lists, page_links
    from sitelake.sinks.writers import write_link_lists

    pages = spark.createDataFrame([(1, "http://a.com/1", '<a href="/2">x</a><a href="http://b.com/">y</a>')], "page_id long, url string, html string")
    write_link_lists(link_scope_lists(page_links(pages)), str(tmp_path / "links"))
    back = {r.scope: (r.domain, r.links) for r in spark.read.json(str(tmp_path / "links")).collect()}
    assert back["all"] == ("a.com", ["http://a.com/2", "http://b.com/"]) and back["external"][1] == ["http://b.com/"]


def test_page_rank_moves_no_links_and_splits_hubs(spark):
    """A star: every page links to one hub. The links' table is joined where it lies, and the hub's mass is summed in parts."""
    import sitelake.reports.site as R

    n = 400
    edges = spark.createDataFrame([(f"u{i}", "hub") for i in range(n)] + [("hub", "u0")], "src string, dst string")
    plans = []
    real = R.materialize
    R.materialize = lambda df, label: (plans.append((label, df._jdf.queryExecution().executedPlan().toString())), real(df, label))[1]
    try:
        got = {r.url: r.rank for r in page_rank(edges, iterations=3).collect()}
    finally:
        R.materialize = real
    assert abs(sum(got.values()) - 1) < 1e-9 and max(got, key=got.get) == "hub"
    step = next(p for label, p in plans if label == "pr_ranks")
    scan = step.index("pr_links_")
    assert "partial_sum" in step and "Bucketed: true" in step[scan:]
    between = step[: scan].rsplit("Join", 1)[1]
    assert "Exchange" not in between  # nothing moves between the links and their join
    assert page_rank(edges.limit(0), iterations=2).collect() == []
