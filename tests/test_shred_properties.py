"""Property tests of the node table on random tag soup (hypothesis)."""
from hypothesis import given, settings
from hypothesis import strategies as st

from sitelake.operators.shred import _Shredder

TAGS = ["div", "p", "b", "i", "span", "a", "ul", "li", "br", "img", "script", "style", "template"]
token = st.one_of(
    st.sampled_from(TAGS).map(lambda t: f"<{t}>"),
    st.sampled_from(TAGS).map(lambda t: f"</{t}>"),
    st.sampled_from([" x ", "y", "  ", "a&amp;b", "&nbsp;z\n", "é", "<!-- c -->", "</p>"]),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(token, max_size=40))
def test_node_table_invariants(tokens):
    html = "".join(tokens)
    rows = _Shredder().run(html)
    by_id = {r[0]: r for r in rows}
    assert [r[0] for r in rows] == list(range(len(rows)))
    doc = rows[0]
    assert doc[1] == len(rows) - 1 and doc[4] == "document"
    page_text = doc[9]
    for r in rows:
        nid, end, parent, depth = r[0], r[1], r[2], r[3]
        assert end >= nid
        if parent is not None:
            p = by_id[parent]
            assert p[0] < nid <= p[1] and depth == p[3] + 1
            assert end <= p[1]
    spans = [(r[0], r[1]) for r in rows]
    for a, ae in spans:
        for b, be in spans:
            assert be < a or b > ae or (a <= b and be <= ae) or (b <= a and ae <= be)
    visible = [r for r in rows if r[4] == "text"]
    assert page_text == "".join(r[9].strip() for r in visible)
    for r in rows:
        if r[4] == "element":
            inside = "".join(t[9].strip() for t in visible if r[0] < t[0] <= r[1])
            assert page_text[r[10]:r[11]] == inside
