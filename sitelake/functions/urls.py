"""URL keys and link resolution as built-in Spark expressions (JVM side, codegen).

All functions take and return ``Column`` objects, so they fold into whole-stage
codegen and can be used in ``select``/``filter`` on any DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# URL grammar pieces (RFC 3986 scheme syntax) and the scheme lists of
# the Python standard library's urllib.parse, whose urljoin rules resolve_url follows.
SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*"
USES_RELATIVE = [
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
]
USES_NETLOC = [
    "", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp",
    "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git",
    "git+ssh", "ws", "wss", "itms-services",
]
# Host part: optional scheme, '//', optional user info, then [IPv6] or a name up to ':' '/' '?' '#'.
HOST_RE = r"^(?:" + SCHEME + r":)?//(?:[^/?#]*@)?(?:\[([^\]]*)\]|([^/?#:]*))"
NETLOC_RE = r"^(?:" + SCHEME + r":)?//([^/?#]*)"
PATH_RE = r"^(?:" + SCHEME + r":)?(?://[^/?#]*)?([^?#]*)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def domain(url) -> Column:
    """lower-cased host name without user info and port; 'unknown' when absent."""
    u = _c(url)
    host = F.lower(F.concat(F.regexp_extract(u, HOST_RE, 1), F.regexp_extract(u, HOST_RE, 2)))
    return F.when(u.isNull() | (host == ""), F.lit("unknown")).otherwise(host)


def netloc(url) -> Column:
    """Network location as written (case, user info and port kept)."""
    return F.regexp_extract(_c(url), NETLOC_RE, 1)


def domain_folder(url) -> Column:
    """netloc as written with '.' replaced by '_'."""
    return F.replace(netloc(url), F.lit("."), F.lit("_"))


def url_path(url) -> Column:
    return F.regexp_extract(_c(url), PATH_RE, 1)


def slug(url) -> Column:
    """path without '/' at both ends, inner '/' -> '_'; empty -> 'root'."""
    p = F.replace(F.btrim(url_path(url), F.lit("/")), F.lit("/"), F.lit("_"))
    return F.when(p == "", F.lit("root")).otherwise(p)


def page_folder(url) -> Column:
    """'://' -> '_', then each of '/', '?', '&', '=' -> '_'."""
    return F.translate(F.replace(_c(url), F.lit("://"), F.lit("_")), "/?&=", "____")


def absolute_link(dom, href) -> Column:
    """a root-relative href becomes https://<domain><href>; others unchanged."""
    h = _c(href)
    return F.when(h.startswith("/"), F.concat(F.lit("https://"), _c(dom), h)).otherwise(h)


def is_http_url(url) -> Column:
    """starts with http:// or https://."""
    return _c(url).rlike(r"^https?://")


def run_date(ts, tz: str = "Asia/Kolkata") -> Column:
    """F8: calendar date of an instant in time zone ``tz`` (independent of the session zone)."""
    ntz = _c(ts).cast("timestamp_ntz")
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit(tz), ntz))


# ---------------------------------------------------------------------------
# resolve_url(base, href) with the rules of urllib.parse.urljoin
# ---------------------------------------------------------------------------
# Built as staged projections of SQL expressions: each URL component is a named
# column computed once and later stages refer to it by name (one nested
# expression would copy shared parts into every use). SQL text keeps plan
# construction to one call per stage.

def _sql_list(xs: list[str]) -> str:
    return ", ".join("'" + x + "'" for x in xs)


def _split_sql(p: str, src: str) -> list[list[str]]:
    sch = SCHEME
    return [
        # leading C0 controls / spaces are ignored and tab, CR, LF removed, as urlsplit does
        [f"regexp_replace(regexp_replace({src}, r'^[\\x00-\\x20]+', ''), r'[\\t\\r\\n]', '') AS {p}_u"],
        [f"{p}_u RLIKE r'^{sch}:' AS {p}_hs",
         f"lower(regexp_extract({p}_u, r'^({sch}):', 1)) AS {p}_scheme",
         f"regexp_extract({p}_u, r'^(?:{sch}:)?(.*)$', 1) AS {p}_rest"],
        [f"startswith({p}_rest, '//') AS {p}_hn",
         f"regexp_extract({p}_rest, r'^//([^/?#]*)', 1) AS {p}_net",
         f"regexp_extract({p}_rest, r'^(?://[^/?#]*)?(.*)$', 1) AS {p}_after"],
        [f"regexp_extract({p}_after, r'^([^?#]*)', 1) AS {p}_path",
         f"regexp_extract({p}_after, r'^[^?#]*\\?([^#]*)', 1) AS {p}_query",
         f"regexp_extract({p}_after, r'^[^#]*#(.*)$', 1) AS {p}_frag"],
    ]


def _unsplit_sql(scheme: str, net: str, path: str, query: str, frag: str) -> str:
    return (
        f"CASE WHEN {scheme} <> '' THEN {scheme} || ':' ELSE '' END || "
        f"CASE WHEN {net} <> '' THEN '//' || {net} || "
        f"CASE WHEN {path} <> '' AND NOT startswith({path}, '/') THEN '/' || {path} ELSE {path} END "
        f"WHEN startswith({path}, '//') THEN '//' || {path} "
        f"WHEN {scheme} <> '' AND {scheme} IN ({_sql_list(USES_NETLOC)}) AND ({path} = '' OR startswith({path}, '/')) "
        f"THEN '//' || {path} ELSE {path} END || "
        f"CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END || "
        f"CASE WHEN {frag} <> '' THEN '#' || {frag} ELSE '' END"
    )


def _resolve_sql() -> list[list[str]]:
    stages = [a + b for a, b in zip(_split_sql("_b", "_rb"), _split_sql("_h", "_rh"))]
    stages += [
        ["CASE WHEN _h_hs THEN _h_scheme ELSE _b_scheme END AS _r_scheme", "split(_b_path, '/') AS _r_bparts"],
        [f"_r_scheme = _b_scheme AND _r_scheme IN ({_sql_list(USES_RELATIVE)}) AS _r_relative",
         f"_r_scheme IN ({_sql_list(USES_NETLOC)}) AS _r_usenet",
         "CASE WHEN try_element_at(_r_bparts, -1) <> '' THEN slice(_r_bparts, 1, size(_r_bparts) - 1) "
         "ELSE _r_bparts END AS _r_bdir"],
        ["concat(_r_bdir, split(_h_path, '/')) AS _r_rel"],
        # empty segments between the first and the last are dropped (no doubled slashes)
        ["CASE WHEN startswith(_h_path, '/') THEN split(_h_path, '/') ELSE concat(slice(_r_rel, 1, 1), "
         "filter(slice(_r_rel, 2, greatest(size(_r_rel) - 2, 0)), s -> s <> ''), "
         "slice(_r_rel, greatest(size(_r_rel), 2), 1)) END AS _r_segs"],
        ["aggregate(_r_segs, cast(array() AS array<string>), (acc, s) -> CASE WHEN s = '..' "
         "THEN slice(acc, 1, greatest(size(acc) - 1, 0)) WHEN s = '.' THEN acc ELSE concat(acc, array(s)) END) "
         "AS _r_stack"],
        ["array_join(CASE WHEN try_element_at(_r_segs, -1) IN ('.', '..') THEN concat(_r_stack, array('')) "
         "ELSE _r_stack END, '/') AS _r_joined",
         "_r_usenet AND _h_hn AND _h_net <> '' AS _r_withnet"],
        ["CASE WHEN _r_withnet OR NOT _r_usenet THEN _h_net ELSE _b_net END AS _r_net",
         "CASE WHEN _r_withnet THEN _h_path WHEN _h_path = '' THEN _b_path "
         "WHEN _r_joined = '' THEN '/' ELSE _r_joined END AS _r_path",
         "CASE WHEN NOT _r_withnet AND _h_path = '' AND _h_query = '' THEN _b_query ELSE _h_query END AS _r_query"],
        [_unsplit_sql("_r_scheme", "_r_net", "_r_path", "_r_query", "_h_frag") + " AS _r_joined2"],
        ["CASE WHEN _rb IS NULL OR _rb = '' THEN _rh WHEN _rh IS NULL OR _rh = '' THEN _rb "
         "WHEN NOT _r_relative THEN _rh ELSE _r_joined2 END AS _r_out"],
    ]
    return stages


def with_resolved_url(df, base, href, out: str = "dst"):
    """F5 as a DataFrame step: add column ``out`` = ``href`` joined onto ``base`` (urljoin rules).

    A null or empty base returns href; an empty href returns base.
    """
    before = df.columns
    df = df.withColumns({"_rb": _c(base), "_rh": _c(href)})
    for stage in _resolve_sql():
        df = df.selectExpr("*", *stage)
    return df.select(*[F.col(f"`{x}`") for x in before if x != out], F.col("_r_out").alias(out))


# ---------------------------------------------------------------------------
# canonical form of a URL
# ---------------------------------------------------------------------------

def _unescaped_sql(x: str) -> str:
    """Percent escapes of unreserved characters decoded, the others in upper case."""
    char = "char(CAST(conv(substr(p, 1, 2), 16, 10) AS BIGINT))"
    return (f"array_join(transform(split({x}, '%'), (p, i) -> CASE WHEN i = 0 THEN p WHEN NOT p RLIKE '^[0-9A-Fa-f]{{2}}' THEN '%' || p "
            f"WHEN {char} RLIKE '^[A-Za-z0-9._~-]$' THEN {char} || substr(p, 3) ELSE '%' || upper(substr(p, 1, 2)) || substr(p, 3) END), '')")


def _canonical_sql() -> list[list[str]]:
    return _split_sql("_c", "_cu") + [
        ["regexp_extract(_c_net, r'^(.*@)', 1) AS _c_user", "lower(regexp_extract(_c_net, r'^(?:.*@)?(.*)$', 1)) AS _c_hp",
         f"{_unescaped_sql('_c_path')} AS _c_plain", f"{_unescaped_sql('_c_query')} AS _c_q"],
        ["CASE _c_scheme WHEN 'http' THEN regexp_replace(_c_hp, r':(80)?$', '') WHEN 'https' THEN regexp_replace(_c_hp, r':(443)?$', '') "
         "ELSE regexp_replace(_c_hp, r':$', '') END AS _c_host", "split(_c_plain, '/') AS _c_segs"],
        ["aggregate(slice(_c_segs, 2, size(_c_segs)), cast(array() AS array<string>), (acc, s) -> CASE WHEN s = '..' "
         "THEN slice(acc, 1, greatest(size(acc) - 1, 0)) WHEN s = '.' THEN acc ELSE concat(acc, array(s)) END) AS _c_stack"],
        ["'/' || array_join(CASE WHEN element_at(_c_segs, -1) IN ('.', '..') THEN concat(_c_stack, array('')) ELSE _c_stack END, '/') AS _c_dir"],
        ["CASE WHEN _c_scheme = '' OR _c_net = '' THEN regexp_replace(_c_u, '#.*$', '') "
         "ELSE _c_scheme || '://' || _c_user || _c_host || _c_dir || CASE WHEN _c_query <> '' THEN '?' || _c_q ELSE '' END END AS _c_out"],
    ]


def with_canonical_url(df, url, out: str):
    """Add column ``out``: the form in which URLs of one page are equal, by built-in expressions only.

    Scheme and host in lower case, no default or empty port, no dot segments, ``/`` for an empty path, escapes of
    unreserved characters decoded and the others in upper case, no fragment and no empty query. User info, path case and
    the order of parameters stay. URLs without scheme or host only lose their fragment; null stays null.
    """
    before = df.columns
    df = df.withColumn("_cu", _c(url))
    for stage in _canonical_sql():
        df = df.selectExpr("*", *stage)
    return df.select(*[F.col(f"`{x}`") for x in before if x != out], F.col("_c_out").alias(out))
