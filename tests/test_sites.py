"""Site-scoped selectors with heavy sites (J1), groups by shape."""

import sitelake.operators.select as S
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sitelake.operators.candidates import card_shapes, repeated_shapes, shape_groups, subtree_shapes
from sitelake.operators.extract import extract_fields
from sitelake.operators.shred import _Shredder, shred

HTML = '<html><title>t{i}</title><body><h1>h{i}</h1><div class="card x"><a href="/{i}">{i}</a></div><ul><li>1</li><li class="on">2</li></ul>'


def site_pages(pages_df):
    rows = [(f"http://big.com/{i}", HTML.format(i=i)) for i in range(60)] + [(f"http://s{i}.org/", HTML.format(i=i)) for i in range(9)]
    return pages_df(rows)


def records(spark):
    rows = [("big.com", "product", "name", 0, "h1"), ("big.com", "product", "price", 1, "ul > li.on"), ("big.com", "product", "size", 2, "")]
    rows += [(f"s{i}.org", "product", "name", 0, "title" if i % 2 else "h1") for i in range(6)]
    return spark.createDataFrame(rows, "scope string, kind string, field string, ord int, selector string")


def test_heavy_sites_are_dealt_out(spark, pages_df, monkeypatch):
    nodes = shred(site_pages(pages_df))
    assert S.heavy_sites(nodes).collect() == []  # too few pages for a second part
    monkeypatch.setattr(S, "HEAVY_SHARE", 10)
    monkeypatch.setattr(S, "PART_PAGES", 5)
    assert [(r.heavy, r.parts) for r in S.heavy_sites(nodes).collect()] == [("big.com", 9)]
    els, steps = S._dealt(S.elements(nodes), S.compile_selectors(records(spark).where("selector <> ''")), S.heavy_sites(nodes))
    parts = els.groupBy("domain", "part").agg(F.count_distinct("page_id").alias("n")).collect()
    assert len([r for r in parts if r.domain == "big.com"]) == 9 and max(r.n for r in parts) < 20
    per_site = {r["scope"]: r["count"] for r in steps.groupBy("scope").count().collect()}
    assert per_site["big.com"] == 9 * 3 and per_site["s1.org"] == 1  # li.on below ul: two steps


def test_site_records_in_parts_equal_the_small_path(spark, pages_df, monkeypatch):
    nodes = shred(site_pages(pages_df))
    run = lambda: sorted(map(tuple, extract_fields(nodes, records(spark)).collect()))
    small = run()
    assert len(small) == 66 and ("name" in extract_fields(nodes, records(spark)).columns)
    assert {r[1] for r in small if r[-1] == "http://s1.org/"} == {"t1"} and {r[2] for r in small if r[-1] == "http://big.com/7"} == {"2"}
    monkeypatch.setattr(S, "BROADCAST_ROW_LIMIT", 0)
    monkeypatch.setattr(S, "HEAVY_SHARE", 10)
    monkeypatch.setattr(S, "PART_PAGES", 5)
    assert run() == small


def test_no_record_applies(spark, pages_df):
    nodes = shred(pages_df([("http://a.com/", "<h1>x")]))
    assert extract_fields(nodes, records(spark)).collect() == []


CARDS = ('<nav><ul><li><a href=/n1>n</a></li><li><a href=/n2>n</a></li></ul></nav><div id=main>'
         '<div class="card__a1"><a href=/1><img src=x></a><p>1</p></div><div class="card__b2 sale"><a href=/2><img src=x></a><p>2</p><p>old</p></div>'
         '<div class="ad"><p>no link</p></div><div class="card__c3"><a href=/3><img src=x></a><p>3</p></div></div>'
         '<div class="plain"><p>a</p><p>b</p></div>')  # fmt: skip


def test_cards_of_differing_classes_group_by_shape(spark, pages_df):
    pages = pages_df([("http://a.com/", CARDS), ("http://a.com/2", CARDS), ("http://b.com/", "<p>none"), ("http://c.com/", None)])
    got = [tuple(r) for r in card_shapes(pages).select("domain", "shape", "selector", "in_navigation", "n_pages", "n_cards", "rank").orderBy("rank").collect()]
    assert got == [("a.com", "div(a,p)", 'div[class*="card"]', False, 2, 6, 1), ("a.com", "li(a)", "ul > li", True, 2, 4, 2)]
    plan = repeated_shapes(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


PIECE = st.sampled_from(["<div>", "</div>", "<ul>", "</ul>", "<li>", "</li>", "<a href=x>", "<a>", "</a>", "<nav>", "</nav>", "<p>", "t", "<br>"])


@settings(max_examples=200, deadline=None)
@given(pieces=st.lists(PIECE, max_size=30))
def test_shapes_equal_a_walk_over_the_tree(pieces):
    rows = _Shredder().run("".join(pieces))
    prints, _ = subtree_shapes(rows)
    els = [r for r in rows if r[4] == "element"]
    below = lambda r: [x for x in els if x[2] == r[0]]

    def shape(r):
        kids = [shape(x) for x in below(r)]
        return (r[5], tuple(k for i, k in enumerate(kids) if not i or k != kids[i - 1]))

    shapes = {r[0]: shape(r) for r in els}
    for a in els:
        for b in els:
            assert (shapes[a[0]] == shapes[b[0]]) == (prints[a[0]] == prints[b[0]])
    wraps = {r[0]: any(r[0] < x[0] <= r[1] and x[5] == "a" and dict(x[8] or ()).get("href") for x in els) for r in els}
    region = {r[0]: any(x[5] in ("nav", "header", "footer") and x[0] <= r[0] <= x[1] for x in els) for r in els}
    want = set()
    for r in els:
        same = [x for x in els if x[2] == r[2] and shapes[x[0]] == shapes[r[0]]]
        if len(same) > 1 and all(wraps[x[0]] for x in same):
            want.add((r[2], prints[r[0]], len(same), region[same[0][0]]))
    assert {(g["parent_id"], g["fingerprint"], g["n_items"], g["in_navigation"]) for g in shape_groups(rows, 2)} == want
