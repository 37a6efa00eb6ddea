"""The shuffle-join path of match() (step table above the broadcast bound) equals the broadcast path,
also when one site holds most pages (skewed domain key)."""
import sitelake.operators.select as S
from sitelake.operators.shred import shred

HTML = ('<div class="card x"><a href="/{i}" data-k="v{i}">{i}</a><p><b>b{i}</b></p></div>'
        '<ul><li>1</li><li class="on">2</li></ul><section><div><span>s</span></div></section>')


def _run(spark, nodes, q):
    return sorted((r.page_id, r.scope, r.selector, r.node_id) for r in S.match(nodes, q).collect())


def test_shuffle_path_equals_broadcast_path(spark, pages_df, monkeypatch):
    rows = [(f"http://big.com/{i}", HTML.format(i=i)) for i in range(30)] + \
           [(f"http://small{i}.org/", HTML.format(i=i)) for i in range(3)]
    nodes = shred(pages_df(rows))
    sels = [("", "div.card a"), ("", "ul > li.on"), ("", "section div span, p b"), ("big.com", "[data-k^=v1]"),
            ("big.com", "div > a"), ("small1.org", "li"), ("", "a:hover")]
    q = spark.createDataFrame(sels, "scope string, selector string")
    fast = _run(spark, nodes, q)
    monkeypatch.setattr(S, "BROADCAST_ROW_LIMIT", 0)
    slow = _run(spark, nodes, q)
    assert fast == slow and len(fast) > 100
