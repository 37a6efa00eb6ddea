"""S1 page source: (page_id, url, html) from a table, parquet, or landed HTML files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keep_fetched(pages: DataFrame) -> DataFrame:
    """A page whose html is null or empty is dropped, not an error."""
    return pages.filter(F.col("html").isNotNull() & (F.col("html") != ""))


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Pages from a parquet table/path (columns page_id, url, html) or a table name."""
    df = spark.read.table(path) if fmt == "table" else spark.read.format(fmt).load(path)
    return keep_fetched(df.select("page_id", "url", "html"))


def read_page_urls(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(page_id, url) for jobs that need no html: the html column is not read, so pages without html are included."""
    df = spark.read.table(path) if fmt == "table" else spark.read.format(fmt).load(path)
    return df.select("page_id", "url")


def read_html_files(spark: SparkSession, path: str, urls: DataFrame | None = None, url_from_path: bool = True) -> DataFrame:
    """Landed ``.html`` files, one page per file; page_id is a hash of the url.

    The layout ``<root>/<date>/<domain>/html/<slug>.html`` holds the site's domain but only the path's slug. ``urls``
    (domain, slug, url), e.g. the crawl's own list, gives the exact URL. Without an entry there, and with ``url_from_path``,
    the url is ``https://<domain>/<slug>`` (no path for the slug ``root``); else it is the file path.
    """
    df = spark.read.option("pathGlobFilter", "*.html").option("recursiveFileLookup", True) \
        .text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("html"))
    parts = F.split(F.col("file"), "/")
    layout = F.col("file").rlike(r"/[^/]+/html/[^/]+\.html$")
    df = df.withColumn("domain", F.when(layout, F.try_element_at(parts, F.lit(-3)))) \
        .withColumn("slug", F.when(layout, F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"\.html$", "")))
    made = F.concat(F.lit("https://"), F.col("domain"), F.lit("/"), F.when(F.col("slug") == "root", F.lit("")).otherwise(F.col("slug")))
    url = F.coalesce(made, F.col("file")) if url_from_path else F.col("file")
    if urls is not None:
        df = df.join(urls.select("domain", "slug", F.col("url").alias("known")), ["domain", "slug"], "left")
        url = F.coalesce(F.col("known"), url)
    return keep_fetched(df.select(url.alias("url"), "html").select(F.xxhash64("url").alias("page_id"), "url", "html"))
