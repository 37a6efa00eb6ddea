"""Tree rules and text layout of the node table (hand fixture of broken HTML)."""
from pyspark.sql import functions as F

from sitelake.operators.select import first_match, match, text_of
from sitelake.operators.shred import _Shredder, shred

BROKEN = ('<html><body><div id="d"><p>one<p>two <b>bold<i>both</b> tail</i></p></div>'
          '<span>x</span></em><br><img src="a.png"><script>var t="</p>";</script>'
          '<!-- note --><p class="e">a &amp; b&nbsp;&copy; <b> in </b>\n</p>'
          '<style>p{}</style><template><div>t</div></template></body>')


def rows(html):
    return _Shredder().run(html)


def test_tree_rules():
    r = rows(BROKEN)
    els = {(x[5], x[0]): x for x in r if x[4] == "element"}
    byid = {x[0]: x for x in r}
    ps = [x for x in r if x[5] == "p"]
    # unclosed <p> stays open: the second p nests inside the first
    assert ps[1][2] == ps[0][0]
    # </b> closes b and the i opened inside it; the stray </i> and </em> are ignored
    b = [x for x in r if x[5] == "b"][0]
    i = [x for x in r if x[5] == "i"][0]
    assert i[2] == b[0] and i[1] <= b[1]
    # void elements close at once
    for x in r:
        if x[5] in ("br", "img"):
            assert x[1] == x[0]
    # script content is raw text: the "</p>" inside it does not close anything
    script = [x for x in r if x[5] == "script"][0]
    assert script[9] == 'var t="</p>";'
    assert byid[script[0] + 1][4] == "rawtext"
    assert any(x[4] == "comment" and x[9] == " note " for x in r)


def test_intervals_nest_or_disjoint():
    r = rows(BROKEN)
    spans = [(x[0], x[1]) for x in r]
    for a, ae in spans:
        assert ae >= a
        for b, be in spans:
            assert (be < a or b > ae) or (a <= b and be <= ae) or (b <= a and ae <= be)


def test_text_matches_get_text_rules(spark, pages_df):
    nodes = shred(pages_df([("http://a.com/", BROKEN)]))
    q = spark.createDataFrame([("", s) for s in ["p.e", "div", "#d", "script", "template", "template div", "body"]],
                              "scope string, selector string")
    got = {r.selector: r.value for r in text_of(first_match(match(nodes, q)), nodes).collect()}
    assert got["p.e"] == "a & b\xa0©in"  # pieces stripped, joined with nothing, entities decoded
    assert got["div"] == "onetwoboldbothtail"
    assert got["#d"] == got["div"]
    assert got["script"] == 'var t="</p>";'  # own text only for script/style
    assert got["template"] == "t" and got["template div"] == ""
    assert "var" not in got["body"] and "note" not in got["body"] and "p{}" not in got["body"]


def test_select_one_is_first_of_select(spark, pages_df):
    nodes = shred(pages_df([("http://a.com/", BROKEN), ("http://b.com/", "<p>1</p><div><p>2</p></div>")]))
    q = spark.createDataFrame([("", "p"), ("", "div p"), ("", "b, i")], "scope string, selector string")
    m = match(nodes, q)
    firsts = {(r.page_id, r.selector): r.node_id for r in first_match(m).collect()}
    mins = {(r.page_id, r.selector): r.n for r in m.groupBy("page_id", "selector").agg(F.min("node_id").alias("n")).collect()}
    assert firsts == mins
