"""Small operators: T1, T2, W5, S5, F11 node form, O11 domain filter."""
from pyspark.sql import functions as F

from sitelake.operators.frontier import crawl
from sitelake.operators.render import cleaned_nodes
from sitelake.operators.shred import shred
from sitelake.sinks.writers import last_write_wins
from sitelake.sources.selectors import read_keywords
from sitelake.sources.sitemaps import sample_candidates, untried


def test_sample_and_untried(spark):
    urls = spark.createDataFrame([(f"http://a.com/{i}",) for i in range(10)] + [("http://b.com/1",), ("http://a.com/1",)],
                                 "url string")
    s1 = sorted(r.url for r in sample_candidates(urls, n=2, seed=7).collect())
    s2 = sorted(r.url for r in sample_candidates(urls, n=2, seed=7).collect())
    assert s1 == s2 and len([u for u in s1 if "a.com" in u]) == 2 and "http://b.com/1" in s1
    tried = spark.createDataFrame([("http://a.com/1",), ("http://a.com/2",)], "url string")
    left = sorted(r.url for r in untried(urls, tried).collect())
    assert len(left) == 9 and "http://a.com/1" not in left


def test_last_write_wins(spark):
    layers = spark.createDataFrame([
        ("http://a.com/x?p=1", "raw", "2026-01-01", "a.com", "x", "h1", 1),
        ("http://a.com/x?p=2", "raw", "2026-01-01", "a.com", "x", "h2", 2),
        ("http://a.com/y", "raw", "2026-01-01", "a.com", "y", "h3", 1)],
        "url string, layer string, date string, domain string, slug string, html string, landed_at int")
    got = sorted((r.slug, r.html) for r in last_write_wins(layers).collect())
    assert got == [("x", "h2"), ("y", "h3")]


def test_keywords_split(spark):
    df = spark.createDataFrame([("  shoes  red\tsale ",), ("",)], "keywords string")
    got = [r.keywords for r in read_keywords(df).collect()]
    assert got == [["shoes", "red", "sale"], []]


def test_cleaned_nodes_drop_excluded(spark, pages_df):
    html = "<div><script>x()</script><p>keep</p><svg><g><text>no</text></g></svg><meta name=a><link rel=x></div>"
    n = cleaned_nodes(shred(pages_df([("http://a.com/", html)])))
    tags = {r.tag for r in n.filter(F.col("kind") == "element").collect()}
    texts = {r.text for r in n.filter(F.col("kind") == "text").collect()}
    assert tags == {"div", "p"} and texts == {"keep"}


def test_allowed_domains_filter(spark):
    edges = spark.createDataFrame([("http://a.com/0", "http://a.com/1", 1), ("http://a.com/0", "http://b.com/1", 2),
                                   ("http://b.com/1", "http://a.com/2", 1)], "src string, dst string, pos int")
    seeds = spark.createDataFrame([(0, "http://a.com/0")], "seed_id long, url string")
    got = {r.url for r in crawl(edges, seeds, "breadth", max_depth=3, include_external=True,
                                allowed_domains=["a.com"]).collect()}
    assert got == {"http://a.com/0", "http://a.com/1"}
