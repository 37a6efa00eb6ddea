"""Sitemaps: urlset and sitemapindex XML to URL tables.

XML arrives as rows (sitemap_url, xml) - landed files or a string column - and
is parsed with the built-in ``from_xml`` (namespaced or not; ``loc`` is
trimmed). Both kinds are read from every document (an index and a urlset may
come from the same source).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import domain, with_canonical_url

# Sitemap protocol namespace and its per-file URL limit.
SITEMAP_NS = "http://www.sitemaps.org/schemas/sitemap/0.9"
MAX_URLS_PER_SITEMAP = 50_000
_SCHEMA = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>"


def read_sitemap_files(spark: SparkSession, path: str, scheme: str = "https") -> DataFrame:
    """Landed sitemap files -> (sitemap_url, xml).

    Files under ``<root>/<domain>/<path>`` get the URL ``scheme://<domain>/<path>``, so an index finds its landed children;
    files directly under the root keep their file path.
    """
    df = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    # what follows the last "/<root>/" in the file's path: domain/path
    url = _file_url(path, scheme)
    return df.select(url.alias("sitemap_url"), F.col("value").alias("xml"))


def _file_url(path: str, scheme: str):
    """URL of a landed sitemap file (see ``read_sitemap_files``)."""
    root = path.rstrip("/").rsplit("/", 1)[-1]
    rest = F.substring_index(F.col("_metadata.file_path"), f"/{root}/", -1)
    return F.when(rest.contains("/"), F.concat(F.lit(f"{scheme}://"), rest)).otherwise(F.col("_metadata.file_path"))


def read_sitemap_entries(spark: SparkSession, path: str, tag: str = "url", scheme: str = "https") -> DataFrame:
    """S2 and S3 for files of any size: (sitemap_url, pos, loc) of the ``url`` or ``sitemap`` entries below ``path``.

    The rows are those of ``sitemap_urls`` (``sitemap_children`` for ``tag="sitemap"``) over ``read_sitemap_files``, but a file
    is read in splits, cut at the entries' end tags, and no document is one row. An entry's place is counted within its
    split and moved by the entries of the file's splits before it. Tags must carry no namespace prefix.
    """
    raw = spark.read.option("lineSep", f"</{tag}>").option("recursiveFileLookup", True).text(path)
    raw = raw.select(_file_url(path, scheme).alias("sitemap_url"), F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), "value")
    body = F.regexp_extract("value", rf"(?s)<{tag}(?:\s[^>]*)?>(.*)$", 1)
    entry = F.from_xml(F.concat(F.lit("<entry>"), body, F.lit("</entry>")), "loc string")
    found = raw.filter(F.col("value").rlike(rf"<{tag}[\s>]")).select("sitemap_url", "_file", "_split", "_at", F.btrim(entry["loc"]).alias("loc"))
    found = found.filter(F.col("loc").isNotNull() & (F.col("loc") != ""))
    sizes = found.groupBy("_file", "_split").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_file", "_split", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_file", "_split").orderBy("_at"))
    return found.withColumn("_n", within).join(sizes, ["_file", "_split"]).select("sitemap_url", (F.col("_before") + F.col("_n")).cast("int").alias("pos"), "loc")


def _parsed(docs: DataFrame) -> DataFrame:
    return docs.select("sitemap_url", F.from_xml(F.col("xml"), _SCHEMA).alias("_p"))


def sitemap_urls(docs: DataFrame) -> DataFrame:
    """Every urlset ``loc`` in document order, trimmed, empty skipped (duplicates kept).

    Columns: sitemap_url, pos (1-based among kept locs), loc.
    """
    p = _parsed(docs).select("sitemap_url", F.posexplode("_p.url").alias("_i", "_u"))
    p = p.select("sitemap_url", "_i", F.btrim(F.col("_u.loc")).alias("loc")).filter(
        F.col("loc").isNotNull() & (F.col("loc") != ""))
    w = Window.partitionBy("sitemap_url").orderBy("_i")
    return p.select("sitemap_url", F.row_number().over(w).alias("pos"), "loc")


def sitemap_children(docs: DataFrame) -> DataFrame:
    """Index entries: (index_url, pos, child_url)."""
    p = _parsed(docs).select("sitemap_url", F.posexplode("_p.sitemap").alias("_i", "_s"))
    p = p.select(F.col("sitemap_url").alias("index_url"), "_i", F.btrim(F.col("_s.loc")).alias("child_url")) \
        .filter(F.col("child_url").isNotNull() & (F.col("child_url") != ""))
    return p.select("index_url", F.row_number().over(Window.partitionBy("index_url").orderBy("_i")).alias("pos"),
                    "child_url")


def expand_index(docs: DataFrame) -> DataFrame:
    """S3 + T4: URLs of the child sitemaps of each index (one level), joined to the landed
    child documents; plus the URLs of urlsets that no landed index names.

    Columns: root (index or sitemap url), sitemap_url, child_pos, pos, loc.
    """
    urls = sitemap_urls(docs)
    kids = sitemap_children(docs)
    u = urls.select(F.col("sitemap_url").alias("child_url"), F.col("pos").alias("_pos"), F.col("loc").alias("_loc"))
    k = kids.select("index_url", "child_url", F.col("pos").alias("child_pos"))
    via_index = k.join(u, "child_url").select(
        F.col("index_url").alias("root"), F.col("child_url").alias("sitemap_url"), "child_pos",
        F.col("_pos").alias("pos"), F.col("_loc").alias("loc"))
    own = urls.join(kids.select(F.col("child_url").alias("sitemap_url")).distinct(), "sitemap_url", "left_anti")
    direct = own.select(F.col("sitemap_url").alias("root"), "sitemap_url", F.lit(0).alias("child_pos"), "pos", "loc")
    return direct.unionByName(via_index)


def numbered(df: DataFrame, group: str, order: str, ranges: int = 64) -> DataFrame:
    """``n``: 1-based number of each row within ``group`` by ``order`` (a number), without one task per group.

    ``order`` is cut into ranges of about equal counts; rows are numbered within (group, range) and moved by the sizes of
    the ranges before. Ties are numbered in an order of their own choosing.
    """
    cuts = sorted(set(df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []))
    bound = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    d = df.withColumn("_part", F.size(F.filter(bound, lambda c: c < F.col(order))))
    sizes = d.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(group, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy(order))
    return d.join(sizes, [group, "_part"]).withColumn("n", F.col("_before") + within).drop("_part", "_before")


def xml_escape(c):
    """Entity-escape text for an XML element (the protocol requires it for '&', '<', '>', quotes)."""
    for ch, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(ch), F.lit(ent))
    return c


def sitemaps_from_pages(pages: DataFrame, chunk: int = MAX_URLS_PER_SITEMAP) -> DataFrame:
    """Sitemap documents for landed pages: per site, urlsets of at most ``chunk`` canonical URLs
    (fragment removed; the site's URLs are numbered in page_id order) and indexes of at most ``chunk`` urlsets.

    The first index is ``sitemap_index.xml``, further ones ``sitemap_index-<k>.xml``. Columns: sitemap_url, xml.
    """
    p = pages.select("page_id", domain("url").alias("domain"), F.regexp_replace("url", "#.*$", "").alias("loc"))
    p = numbered(p, "domain", "page_id").withColumn("chunk", F.floor((F.col("n") - 1) / chunk).cast("long"))
    entry = F.concat(F.lit("<url><loc>"), xml_escape(F.col("loc")), F.lit("</loc></url>"))
    sets = p.groupBy("domain", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e")))).alias("_l"))
    set_url = F.concat(F.lit("https://"), F.col("domain"), F.lit("/sitemap-"), F.col("chunk").cast("string"),
                       F.lit(".xml"))
    urlsets = sets.select(set_url.alias("sitemap_url"), "domain", "chunk", F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="{SITEMAP_NS}">'),
        F.array_join(F.transform("_l", lambda x: x["e"]), ""), F.lit("</urlset>")).alias("xml"))
    part = F.floor(F.col("chunk") / chunk).cast("long")
    idx = urlsets.groupBy("domain", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("chunk", "sitemap_url"))).alias("_c"))
    name = F.when(F.col("part") == 0, F.lit("/sitemap_index.xml")).otherwise(F.concat(F.lit("/sitemap_index-"), F.col("part").cast("string"), F.lit(".xml")))
    index = idx.select(F.concat(F.lit("https://"), F.col("domain"), name).alias("sitemap_url"),
                       F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><sitemapindex xmlns="{SITEMAP_NS}">'),
                                F.array_join(F.transform("_c", lambda x: F.concat(
                                    F.lit("<sitemap><loc>"), xml_escape(x["sitemap_url"]), F.lit("</loc></sitemap>"))), ""),
                                F.lit("</sitemapindex>")).alias("xml"))
    return urlsets.select("sitemap_url", "xml").unionByName(index)


def untried(candidates: DataFrame, tried: DataFrame, col: str = "url") -> DataFrame:
    """Candidate URLs not tried yet (set difference as an anti-join); T3: distinct."""
    return candidates.select(col).distinct().join(tried.select(col), col, "left_anti")


def sample_candidates(urls: DataFrame, n: int = 1, seed: int = 0, col: str = "url") -> DataFrame:
    """``n`` pseudo-random candidate URLs per site, reproducible: those whose md5 with the seed comes first.

    The rank's literal bound is a partial top-n: a task sends at most ``n`` rows of a site, however large the site.
    """
    k = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(col)))
    w = Window.partitionBy("domain").orderBy(k, col)
    return urls.withColumn("domain", domain(F.col(col))).withColumn("_r", F.row_number().over(w)) \
        .filter(F.col("_r") <= n).drop("_r")


def sitemap_diff(sitemap_locs: DataFrame, crawled: DataFrame, loc_col: str = "loc", url_col: str = "url") -> DataFrame:
    """Canonical URLs in the sitemap, crawled, or both (full outer join with a side flag)."""
    a = with_canonical_url(sitemap_locs.select(F.col(loc_col).alias("url")), "url", "url").distinct().withColumn("_s", F.lit(True))
    b = with_canonical_url(crawled.select(F.col(url_col).alias("url")), "url", "url").distinct().withColumn("_c", F.lit(True))
    j = a.join(b, "url", "full_outer")
    s, c = F.col("_s").isNotNull(), F.col("_c").isNotNull()
    side = F.when(s & c, "both").when(s, "sitemap_only").otherwise("crawled_only")
    return j.select("url", side.alias("side"))
