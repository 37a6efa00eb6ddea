"""String functions: Unicode strip, tag exclusion, keyword score (built-in expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags removed from cleaned HTML (element and content), and void tags removed alone.
EXCLUDED_TAGS = ["script", "style", "noscript", "iframe", "svg", "canvas"]
EXCLUDED_VOID_TAGS = ["link", "meta"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ustrip(col) -> Column:
    """Strip Unicode white space at both ends (as Python's str.strip)."""
    ws = r"[\s\x1c-\x1f]"
    return F.regexp_replace(F.regexp_replace(_c(col), "(?U)^" + ws + "+", ""), "(?U)" + ws + "+$", "")


def exclude_tags_patterns() -> list[str]:
    """Regex chain of F11 (syntax shared by Java and RE2: no look-around, no back-references)."""
    pats = [r"(?is)<" + t + r"\b[^>]*>.*?</" + t + r"\s*>" for t in EXCLUDED_TAGS]
    pats += [r"(?is)<" + t + r"\b[^>]*>" for t in EXCLUDED_VOID_TAGS]
    return pats


def exclude_tags(html) -> Column:
    """F11 (text form): remove excluded elements with their content, and link/meta tags."""
    out = _c(html)
    for p in exclude_tags_patterns():
        out = F.regexp_replace(out, p, "")
    return out


def keyword_score(url, keywords: list[str] | Column, weight: float = 0.7) -> Column:
    """weight * (keywords found in the url, case-insensitive) / (number of keywords); 0 if none."""
    kw = F.array(*[F.lit(k) for k in keywords]) if isinstance(keywords, list) else keywords
    if isinstance(keywords, list) and not keywords:
        return F.lit(0.0)
    low = F.lower(_c(url))
    hits = F.size(F.filter(kw, lambda k: low.contains(F.lower(k))))
    n = F.size(kw)
    return F.when(n > 0, hits.cast("double") / n.cast("double") * F.lit(float(weight))).otherwise(F.lit(0.0))


def split_keywords(text) -> Column:
    """Whitespace-separated keyword list ('' -> empty list)."""
    t = F.btrim(_c(text))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))
