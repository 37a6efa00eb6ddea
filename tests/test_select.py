"""Selector matching: join/window evaluation against a brute-force matcher on the same node rows."""
import re

import pytest

from sitelake.operators.select import SelectorError, match, parse_selector
from sitelake.operators.shred import _Shredder, shred

PRODUCT = """<html><body><div class="product-info-main"><h1 itemprop="name">Shoe  X</h1>
<span class="price">$10</span><div data-testid="product-price">10.00</div>
<ul class="sizes componentName__abc123"><li><button>S</button></li><li><button class="sel on">M</button></li></ul>
<a href="/p?a=1" rel="nofollow next">n</a><p lang="en-US">x</p></div>
<div id="main"><section><div class="card"><a href="/1">1</a></div><div class="card"><span><a href="/2">2</a></span></div></section></div>
</body></html>"""

SELECTORS = ["h1", "h1[itemprop=\"name\"]", ".product-info-main .price", "[data-testid=\"product-price\"]",
             "ul > li", "div li button", "div > button", "#main .card a", "#main > section > .card > a", "*",
             "[class^=compo]", "[class$=\"123\"]", "[class*=Name__]", "[class~=sel]", "[rel~=next]",
             "[lang|=en]", "a[href]", "div a, h1", "section a", ".card > a", "button.sel.on", "div div a",
             "[itemprop=NAME i]", "ul.sizes li", "body > div > h1"]


def brute(rows, alts):
    els = [r for r in rows if r[4] == "element"]
    by_id = {r[0]: r for r in rows}

    def attrs(r):
        return dict(r[8])

    def ok(r, st):
        if st["tag"] and r[5] != st["tag"]:
            return False
        a = attrs(r)
        if any(a.get("id") != i for i in st["ids"]):
            return False
        if any(c not in r[7] for c in st["classes"]):
            return False
        for at in st["attrs"]:
            v = " ".join(r[7]) if at["name"] == "class" and "class" in a else a.get(at["name"])
            if at["op"] == "":
                if at["name"] not in a:
                    return False
                continue
            if v is None:
                return False
            x = at["value"]
            if at["ci"]:
                v, x = v.lower(), x.lower()
            good = {"=": v == x, "~=": x != "" and not re.search(r"\s", x) and x in v.split(),
                    "|=": v == x or v.startswith(x + "-"), "^=": x != "" and v.startswith(x),
                    "$=": x != "" and v.endswith(x), "*=": x != "" and x in v}[at["op"]]
            if not good:
                return False
        return True

    def matches(r, steps, k):
        if not ok(r, steps[k]):
            return False
        if k == 0:
            return True
        comb = steps[k]["comb"]
        p = by_id.get(r[2])
        while p is not None and p[4] == "element":
            if matches(p, steps, k - 1):
                return True
            if comb == ">":
                return False
            p = by_id.get(p[2])
        return False

    return sorted({r[0] for r in els for steps in alts if matches(r, steps, len(steps) - 1)})


def test_match_equals_brute_force(spark, pages_df):
    nodes = shred(pages_df([("http://a.com/p", PRODUCT)]))
    rows = _Shredder().run(PRODUCT)
    q = spark.createDataFrame([("", s) for s in SELECTORS], "scope string, selector string")
    got = {}
    for r in match(nodes, q).collect():
        got.setdefault(r.selector, []).append(r.node_id)
    for s in SELECTORS:
        assert sorted(got.get(s, [])) == brute(rows, parse_selector(s)), s


@pytest.mark.parametrize("bad", ["", "   ", "> a", "a >", "a:hover", "a + b", "a ~ b", "[x", "a,", ",a", ".1x",
                                 "[a=b c]", "a[b=\"c]"])
def test_invalid_selectors(bad):
    with pytest.raises(SelectorError):
        parse_selector(bad)


def test_scoped_selectors_apply_to_their_site(spark, pages_df):
    nodes = shred(pages_df([("http://a.com/1", "<h1>A</h1><h2>x</h2>"), ("http://b.com/1", "<h1>B</h1><h2>y</h2>")]))
    q = spark.createDataFrame([("a.com", "h1"), ("b.com", "h2"), (None, "h1")], "scope string, selector string")
    got = sorted((r.page_id, r.scope, r.selector) for r in match(nodes, q).collect())
    assert got == [(0, "", "h1"), (0, "a.com", "h1"), (1, "", "h1"), (1, "b.com", "h2")]
