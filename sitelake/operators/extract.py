"""Field extraction jobs over the node table (V5 and helpers)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .select import GLOBAL, first_match, match, text_of
from .shred import documents


def selector_rows(selectors, kind: str = "product", scope: str | None = None) -> list[tuple]:
    """Rows (scope, kind, field, ord, selector) of one selector record given as a dict."""
    return [(scope or GLOBAL, kind, k, i, v if isinstance(v, str) else "") for i, (k, v) in enumerate(selectors.items())]


SELECTOR_SCHEMA = "scope string, kind string, field string, ord int, selector string"


def selectors_frame(spark, selectors: dict, kind: str = "product", scope: str | None = None) -> DataFrame:
    return spark.createDataFrame(selector_rows(selectors, kind, scope), SELECTOR_SCHEMA)


def _norm(selectors: DataFrame) -> DataFrame:
    return selectors.select(
        F.coalesce(F.col("scope"), F.lit(GLOBAL)).alias("scope"), "field", "ord",
        F.coalesce(F.btrim(F.col("selector")), F.lit("")).alias("selector"))


def field_order(selectors: DataFrame) -> list[str]:
    """Field names in record order (the selector table is small: one row per site and field)."""
    rows = selectors.groupBy("field").agg(F.min("ord").alias("o")).orderBy("o", "field").collect()
    return [r["field"] for r in rows]


def field_values(nodes: DataFrame, selectors: DataFrame) -> DataFrame:
    """Long form of V5: (page_id, scope, field, value) for non-empty selectors with a match.

    A selector outside the supported grammar raises: an empty field would look like a page without it."""
    sel = _norm(selectors)
    queries = sel.filter(F.col("selector") != "").select("scope", "selector").distinct()
    firsts = text_of(first_match(match(nodes, queries, strict=True)), nodes).select("page_id", "scope", "selector", "value")
    return firsts.join(sel.select("scope", "selector", "field"), ["scope", "selector"]) \
        .select("page_id", "scope", "field", "value")


def pages_in_scope(nodes: DataFrame, selectors: DataFrame) -> DataFrame:
    """Document rows of the pages that some selector applies to."""
    docs = documents(nodes)
    scopes = _norm(selectors).select("scope").distinct()
    if scopes.filter(F.col("scope") == GLOBAL).limit(1).count() > 0:
        return docs
    return docs.join(scopes.withColumnRenamed("scope", "domain"), "domain", "left_semi")


def extract_fields(nodes: DataFrame, selectors: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """V5: one row per page in scope: page_id, each field's first-match text ('' if none), url.

    A site-scoped selector wins over a global one for the same field.
    """
    fields = fields or field_order(selectors)
    vals = field_values(nodes, selectors)
    aggs = []
    for f in fields:
        site = F.max(F.when((F.col("field") == f) & (F.col("scope") != GLOBAL), F.col("value")))
        glob = F.max(F.when((F.col("field") == f) & (F.col("scope") == GLOBAL), F.col("value")))
        aggs.append(F.coalesce(site, glob).alias(f))
    wide = vals.groupBy("page_id").agg(*aggs)
    base = pages_in_scope(nodes, selectors).select("page_id", "url")
    out = base.join(wide, "page_id", "left")
    return out.select("page_id", *[F.coalesce(F.col(f"`{f}`"), F.lit("")).alias(f) for f in fields], "url")
