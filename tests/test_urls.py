from urllib.parse import urljoin

from pyspark.sql import functions as F

from sitelake.functions import urls as U

# url -> domain, slug, domain folder, page folder, is http(s)
URL_KEYS = {
    "http://User:pw@EX.com:8080/a/b?c#d": ("ex.com", "a_b", "User:pw@EX_com:8080", "http_User:pw@EX.com:8080_a_b_c#d", True),
    "http://[::1]:80/x": ("::1", "x", "[::1]:80", "http_[::1]:80_x", True),
    "ex.com/a": ("unknown", "ex.com_a", "", "ex.com_a", False),
    "http://a_b.com/x": ("a_b.com", "x", "a_b_com", "http_a_b.com_x", True),
    "http://a.com/a b": ("a.com", "a b", "a_com", "http_a.com_a b", True),
    "https://a.b/c?d=e&f#g": ("a.b", "c", "a_b", "https_a.b_c_d_e_f#g", True),
    "http://a.com": ("a.com", "root", "a_com", "http_a.com", True),
    "http://a.com?x": ("a.com", "root", "a_com", "http_a.com_x", True),
    "HTTPS://Mixed.Case.ORG/": ("mixed.case.org", "root", "Mixed_Case_ORG", "HTTPS_Mixed.Case.ORG_", False),
    "//h.com/p": ("h.com", "p", "h_com", "__h.com_p", False),
    "http://ü.de/ä": ("ü.de", "ä", "ü_de", "http_ü.de_ä", True),
    "http://a.com/?a=b&c=d": ("a.com", "root", "a_com", "http_a.com__a_b_c_d", True),
    "http://a.com/#f": ("a.com", "root", "a_com", "http_a.com_#f", True),
    "http://a.com//x//": ("a.com", "x", "a_com", "http_a.com__x__", True),
}
BASES = ["http://a/b/c/d;p?q", "https://Ex.COM:8080/dir/page.html?x=1#top", "http://a.com", "http://a.com/", "",
         "http://u:p@h.com/a/b/", "ftp://f.org/x/y", "mailto:x@y"]
HREFS = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "", ".", "./", "..", "../", "../g",
         "../..", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h",
         "g/../h", "http:g", "https://other.org/a/../b", "mailto:z@w", "a//b//c", "/a//b", "//h2", "javascript:void(0)",
         " /sp ace", "é/ü", "?a=b&c=d"]


def test_url_keys(spark):
    df = spark.createDataFrame([(u,) for u in URL_KEYS], "url string").select(
        "url", U.domain("url"), U.slug("url"), U.domain_folder("url"), U.page_folder("url"), U.is_http_url("url"))
    assert {r[0]: tuple(r[1:]) for r in df.collect()} == URL_KEYS


def test_resolve_url_matches_urljoin(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    df = U.with_resolved_url(spark.createDataFrame(rows, "base string, href string"), "base", "href", "r")
    bad = [(r.base, r.href, r.r) for r in df.collect() if r.r != urljoin(r.base, r.href)]
    assert not bad


def test_absolute_link_and_run_date(spark):
    df = spark.createDataFrame([("a.com", "/p", "2024-01-01 20:00:00"), ("a.com", "http://x/y", "2024-01-01 10:00:00")],
                               "d string, h string, ts string")
    out = df.select(U.absolute_link("d", "h").alias("a"),
                    U.run_date(F.to_timestamp("ts")).alias("ist")).collect()
    assert out[0].a == "https://a.com/p" and out[1].a == "http://x/y"
    assert str(out[0].ist) == "2024-01-02" and str(out[1].ist) == "2024-01-01"


def test_canonical_url(spark):
    from sitelake.functions.urls import with_canonical_url

    cases = [
        ("HTTP://Ex.COM:80/a/../b/./c?x=1#top", "http://ex.com/b/c?x=1"), ("https://ex.com:443", "https://ex.com/"), ("https://ex.com:8443/", "https://ex.com:8443/"),
        ("http://ex.com?", "http://ex.com/"), ("http://ex.com/%7euser/%2fx%c3%a9%zz%", "http://ex.com/~user/%2Fx%C3%A9%zz%"), ("http://U:p@Ex.com/A", "http://U:p@ex.com/A"),
        ("http://ex.com/a/..", "http://ex.com/"), ("http://ex.com/../../a/.", "http://ex.com/a/"), ("http://[::1]:80/x", "http://[::1]/x"), ("http://ex.com:/x", "http://ex.com/x"),
        ("http://ex.com/a//b/", "http://ex.com/a//b/"), ("http://ex.com/%2e%2E/x?q=%41%2f#f#g", "http://ex.com/x?q=A%2F"), ("mailto:A@b.c#x", "mailto:A@b.c"), ("/rel/../x#f", "/rel/../x"),
        ("", ""), (None, None), ("ftp://h:21/x", "ftp://h:21/x"),
    ]
    df = spark.createDataFrame([(i, u, "kept") for i, (u, _) in enumerate(cases)], "i int, url string, _c_out2 string")
    got = {r.i: r.c for r in with_canonical_url(df, "url", "c").collect()}
    assert [got[i] for i in range(len(cases))] == [c for _, c in cases]
    again = with_canonical_url(with_canonical_url(df, "url", "c"), "c", "d")
    assert again.columns == ["i", "url", "_c_out2", "c", "d"] and again.filter("c <> d").collect() == []
