"""Markdown (F13) and metadata (F14): hand fixtures, broken html, properties of the assembly."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from sitelake.operators.render import page_markdown, page_metadata, text_runs
from sitelake.operators.shred import _Shredder

CASES = [
    ("<p>one <b>bold</b> word<p>two", "one **bold** word\n\ntwo"),
    ('<h1>T</h1><p>one <b>bold</b> word<p>two<ul><li><a href="/x">link</a> tail<li>uu</ul>', "# T\n\none **bold** word\n\ntwo\n\n- [link](/x) tail\n  - uu"),
    ("<ul><li>a<ul><li>b</li><li><p>c</p><p>d</p></li></ul></li><li>e</li></ul>", "- a\n  - b\n  - c\n\n    d\n- e"),
    ("<ul><li>a</li></ul><ol><li>x</li><li>y</li></ol>", "- a\n\n1. x\n2. y"),
    ("<blockquote><p>q <i>w</i><br>z</p><ul><li>k</li></ul></blockquote>", "> q *w*  \n> z\n\n> - k"),
    ("<pre>a\n  b</pre><hr><p>c</p>", "    a\n      b\n\n---\n\nc"),
    ("<table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td></td><td>4</td></tr></table>", "1 | 2\n3 | 4"),
    ("<p><b>A<br><p>B</p><p>C</p></b> tail", "**A**\n\n**B**\n\n**C**\n\ntail"),
    ('<p>x<a href="/u"> <b>b</b> <i>i</i> </a>,z', "x [**b** *i*](/u) ,z"),
    ("<p><b>a</b><b>b</b> <strong>c<b>d</b></strong>", "**a****b** **cd**"),
    ('<p><a>no href</a> <code>x</code><img alt="al  t" src="s.png">', "no href `x`![al t](s.png)"),
    ("<head><title>t</title><style>p{}</style></head><body>plain<script>var x</script> text<div>d</div>end", "plain text\n\nd\n\nend"),
    ("<p>  a \n\t b&nbsp;c &amp; &lt;d&gt; </p><p>   </p><!-- no -->", "a b c & <d>"),
    ("<div>a</p></div></b>b", "a\n\nb"),
    ("", ""),
    ("<p></p><ul><li></ul>", ""),
]


def test_markdown_of_fixtures(spark, pages_df):
    got = {r["page_id"]: r["markdown"] for r in page_markdown(pages_df([("http://a.com/", h) for h, _ in CASES])).collect()}
    for i, (html, want) in enumerate(CASES):
        assert got[i] == want, html


def test_markdown_needs_no_shuffle(spark, pages_df):
    df = pages_df([("http://a.com/", "<p>a"), ("http://a.com/b", None)])
    assert [r["markdown"] for r in page_markdown(df).orderBy("page_id").collect()] == ["a", ""]
    for out in (page_markdown(df), page_metadata(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "InMemoryRelation" not in plan


PIECE = st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<i>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "<br>", "<a href='/x'>", "</a>", "<blockquote>",
                         "</blockquote>", "<td>", "<tr>", "<script>", "</script>", "one", " two ", "\n", "<pre>", "</pre>", "<hr>"])


@settings(max_examples=300, deadline=None)
@given(pieces=st.lists(PIECE, max_size=25))
def test_runs_hold_all_seen_text_in_order(pieces):
    parser = _Shredder()
    rows = parser.run("".join(pieces))
    runs = text_runs(rows, parser._blanks)
    words = "".join(r["text"] for r in runs if r["text"] != "---").split()
    seen = [r for r in rows if r[4] == "text"]
    assert "".join(words) == "".join(re.sub(r"\s", "", r[9]) for r in seen)
    assert all(r["sep"] for r in runs[:1]) and all((r["sep"] == "") <= (r["prefix"] == "") for r in runs)


def test_metadata(spark, pages_df):
    html = ('<html lang="en" lang="de"><head><title> A &amp; <b>B</title><title>C</title><meta name="k" content="1"><meta property="k" content="2">'
            '<meta name="og" content=""><meta name="none"><meta charset="x"><link rel="icon canonical" href="/c"><link rel="canonical" href="/d">')  # fmt: skip
    r = page_metadata(pages_df([("http://a.com/", html), ("http://a.com/e", "")])).orderBy("page_id").collect()
    assert (r[0]["title"], r[0]["lang"], r[0]["meta"], r[0]["canonical"]) == ("A &B", "de", {"k": "1", "og": ""}, "/c")
    assert (r[1]["title"], r[1]["lang"], r[1]["meta"], r[1]["canonical"]) == ("", None, {}, None)
