"""Selector records (S4, F9) and keyword lists.

A selector record is a JSON object per site and kind. It becomes long rows
(scope, kind, field, ord, selector) so that selectors are data joined to pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_keywords

# The keys every record of a kind has (missing or non-string -> "").
PRODUCT_KEYS = ["name", "price", "description", "category", "brand", "availability", "ratings", "reviews",
                "size", "size_container"]
LISTING_KEYS = ["product_card", "product_link", "pagination"]
KIND_KEYS = {"product": PRODUCT_KEYS, "listing": LISTING_KEYS}
# File names of the stored records per site folder.
KIND_FILES = {"product": "product_selector.json", "listing": "listing_selector.json"}


def normalize_record(text, kind) -> Column:
    """array<struct<ord, field, selector>> of a record given as JSON text.

    A JSON list uses its first element; the object's keys keep their source
    order, then the missing keys of the kind follow in schema order; a
    non-string value becomes ''. Invalid JSON (or not an object) gives null.
    """
    t = F.col(text) if isinstance(text, str) else text
    k = F.col(kind) if isinstance(kind, str) else kind
    parsed = F.try_parse_json(t)
    obj = F.when(F.schema_of_variant(parsed).startswith("ARRAY"), F.get_json_object(t, "$[0]")).otherwise(t)
    is_obj = F.schema_of_variant(F.try_parse_json(obj)).startswith("OBJECT")
    keys = F.json_object_keys(obj)
    schema = F.when(k == "listing", F.array(*[F.lit(x) for x in LISTING_KEYS])) \
        .otherwise(F.array(*[F.lit(x) for x in PRODUCT_KEYS]))
    fields = F.concat(keys, F.filter(schema, lambda s: ~F.array_contains(keys, s)))
    m = F.from_json(obj, "map<string,variant>")
    entries = F.transform(fields, lambda f, i: F.struct(
        i.cast("int").alias("ord"), f.alias("field"),
        F.when(F.schema_of_variant(F.try_element_at(m, f)) == "STRING",
               F.try_element_at(m, f).cast("string")).otherwise(F.lit("")).alias("selector")))
    return F.when(is_obj, entries)


def records_to_rows(records: DataFrame) -> DataFrame:
    """records(scope, kind, json) -> rows (scope, kind, field, ord, selector); bad JSON gives no row."""
    r = records.select("scope", "kind", normalize_record("json", "kind").alias("_e"))
    return r.filter(F.col("_e").isNotNull()).select("scope", "kind", F.inline("_e")) \
        .select("scope", "kind", "field", "ord", "selector")


def read_selectors(spark: SparkSession, root: str) -> DataFrame:
    """Selector rows of stored records, in either layout; the domain comes from the folder.

    ``<root>/<domain>/{product,listing}_selector.json`` is one record a file; ``<root>/domain=<d>/kind=<k>/part-*`` is what
    ``write_selectors`` (K4) writes, one record a line.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True) \
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    parts = F.split(F.col("path"), "/")
    fname = F.element_at(parts, -1)
    named = raw.filter(fname.isin(*KIND_FILES.values())).select(
        F.element_at(parts, -2).alias("scope"),
        F.when(fname == KIND_FILES["listing"], F.lit("listing")).otherwise(F.lit("product")).alias("kind"), "json")
    written = r"/domain=([^/]+)/kind=([^/]+)/part-[^/]+$"
    # the folder name escapes the domain, and the file's path escapes that once more
    lines = raw.filter(F.col("path").rlike(written)).select(
        F.url_decode(F.url_decode(F.regexp_extract("path", written, 1))).alias("scope"), F.regexp_extract("path", written, 2).alias("kind"),
        F.explode(F.split("json", "\n")).alias("json")).filter(F.col("json") != "")
    recs = named.unionByName(lines)
    return records_to_rows(recs)


def read_keywords(df: DataFrame, col: str = "keywords") -> DataFrame:
    """Whitespace-split keyword list column."""
    return df.withColumn(col, split_keywords(F.col(col)))
