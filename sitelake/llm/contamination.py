"""Benchmark decontamination with a positional inverted index, with DataFrame functions only.

The index holds the words of all training documents as postings (term, row, pos) in segments: each task explodes its own
documents and sorts them by term, so no token crosses the network and the postings of a frequent word lie spread over all
segments. Beside the postings stands the document table (row, id, word count, words).

A test window is looked up from its rarest words. The postings of the rarest word, shifted by the word's offset in the
window, give the places where the window may begin; they are intersected with the shifted postings of the second rarest
word, and what is left is compared word by word. Neighbouring windows mostly share their two rarest words, so they are
looked up once. Wanted terms go to the segments in blocks of a fixed number of rows, each of which is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelake.llm.shared import Written, cut, shared_path

# Fixed value: words after A-Z is lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW_WORDS = 10
LOOKUP_ROWS = 200_000  # wanted rows that one lookup broadcasts; more are looked up block by block


def word_terms(text: Column) -> Column:
    """64-bit hashes of a text's words, in order (null: none)."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


@dataclass
class PositionalIndex:
    """``docs``: row, doc_id, n_words, terms. ``postings``: term, row, pos (0-based), sorted by term within each file."""

    docs: DataFrame
    postings: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> PositionalIndex:
        """Index every row of ``docs`` under ``path`` (by default a new one in the shared folder)."""
        spark = docs.sparkSession
        path = path or shared_path(spark, "positional-index")
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), word_terms(F.col(text_col)).alias("terms"))
        rows.select("row", "doc_id", F.size("terms").cast("long").alias("n_words"), "terms").write.parquet(f"{path}/docs")
        words = spark.read.parquet(f"{path}/docs").select("row", F.posexplode("terms").alias("pos", "term"))
        words.select("term", "row", "pos").sortWithinPartitions("term", "row", "pos").write.parquet(f"{path}/postings")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PositionalIndex:
        return cls(spark.read.parquet(f"{path}/docs"), spark.read.schema("term long, row long, pos int").parquet(f"{path}/postings"))

    def lookup(self, wanted: DataFrame, how: str = "inner") -> DataFrame:
        """Postings of the terms of ``wanted`` (a written table; ``term`` and more columns), joined with its rows."""
        blocks = max(1, -(-wanted.count() // LOOKUP_ROWS))
        part = F.pmod(F.xxhash64(F.struct("*") if how == "inner" else F.col("term")), F.lit(blocks))
        # a block holds about LOOKUP_ROWS rows whatever the size of the test set
        return reduce(DataFrame.unionByName, [self.postings.join(F.broadcast(wanted.where(part == b)), "term", how) for b in range(blocks)])

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """(term, n) of the distinct ``terms`` that occur at all."""
        return self.lookup(cut(terms.select("term").distinct(), "test-terms"), "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def item_classes(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((class, terms), (class, item)): items of equal words are one class; items without words have none."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), word_terms(F.col(text_col)).alias("terms"))
    rows = cut(rows.where(F.size("terms") > 0).distinct(), "test-items")
    classes = cut(rows.select("terms").distinct().select(F.monotonically_increasing_id().alias("class"), "terms"), "test-classes")
    members = rows.select(F.col("terms").alias("of"), "item").join(classes, F.col("of") == F.col("terms")).select("class", "item")
    return classes, cut(members, "test-members")


def anchors(index: PositionalIndex, classes: DataFrame, window: int | None) -> DataFrame:
    """The lookups of all test windows: anchor, class, term, at, term2, at2, first, words, length.

    Windows are ``window`` consecutive words of a class, the whole of a shorter one, or with ``window`` None always the
    whole. ``term`` and ``term2`` are a window's rarest words at the offsets ``at`` and ``at2`` (null for one word). The
    windows that share them begin at ``first`` and the offsets after it; ``words`` spans them all. Windows with a word
    that no document holds are left out.
    """
    words = classes.select("class", F.size("terms").alias("len"), F.posexplode("terms").alias("at", "term"))
    seen = cut(index.frequencies(words).withColumnRenamed("term", "known"), "test-frequencies")
    words = words.join(seen, F.col("term") == F.col("known"), "left").select("class", "len", "at", "term", F.coalesce("n", F.lit(0)).alias("n"))
    ahead = Window.partitionBy("class").orderBy("at")
    if window is None:
        ranked = words.groupBy("class", "len").agg(F.lit(0).alias("at"), F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("by_n"))
    else:
        ranked = words.withColumn("by_n", F.array_sort(F.collect_list(F.struct("n", "at", "term")).over(ahead.rowsBetween(0, window - 1))))
        ranked = ranked.where(F.col("at") <= F.greatest(F.col("len") - window, F.lit(0)))
    a, b = F.col("by_n")[0], F.get("by_n", F.lit(1))
    ranked = ranked.where(a["n"] > 0).select(
        "class", F.col("at").alias("start"), F.size("by_n").alias("length"), a["term"].alias("term"), a["at"].alias("at"), b["term"].alias("term2"), b["at"].alias("at2")
    )
    same = ranked.groupBy("class", "term", "at", "term2", "at2", "length").agg(F.min("start").alias("first"), F.max("start").alias("final"))
    spans = same.join(classes, "class").withColumn("words", F.slice("terms", F.col("first") + 1, F.col("final") - F.col("first") + F.col("length")))
    return cut(spans.drop("terms").withColumn("anchor", F.monotonically_increasing_id()), "test-anchors")


def phrase_hits(index: PositionalIndex, classes: DataFrame, window: int | None = WINDOW_WORDS) -> DataFrame:
    """(row, class, start, length): every occurrence of every test window (see ``anchors``) in the indexed documents."""
    wanted = anchors(index, classes, window)
    places = wanted.select("term", "anchor", "at", "term2", "at2", (F.col("final") - F.col("at")).alias("reach"))
    first = index.lookup(places).where(F.col("pos") + F.col("reach") >= 0)  # else every window would begin before the text
    shift = F.col("pos") - F.col("at")
    one = first.where("term2 IS NULL").select("row", "anchor", shift.alias("shift"))
    two = first.where("term2 IS NOT NULL").select(F.col("row").alias("in_row"), "anchor", shift.alias("shift"), "term2", (shift + F.col("at2")).alias("pos2"))
    second = index.lookup(cut(wanted.where("term2 IS NOT NULL").select(F.col("term2").alias("term")).distinct(), "test-second"), "left_semi")
    both = two.join(second, (F.col("in_row") == F.col("row")) & (F.col("pos2") == F.col("pos")) & (F.col("term2") == F.col("term")))
    found = cut(one.unionByName(both.select("row", "anchor", "shift")), "test-candidates")
    spans = wanted.select("anchor", "class", F.col("first").alias("begin"), "final", "words", "length")
    rows, held = cut(found.select("row").distinct(), "test-rows"), index.docs.select("row", "n_words", "terms")
    if rows.count() <= LOOKUP_ROWS:  # few documents: only theirs move to the comparison; else all do
        held = held.join(F.broadcast(rows), "row", "left_semi")
    compared = found.join(spans, "anchor").join(held, "row")

    def matches(at: Column) -> Column:
        start = F.col("shift") + at
        inside = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
        equal = F.slice("terms", start + 1, F.col("length")) == F.slice("words", at - F.col("begin") + 1, F.col("length"))
        return F.when(inside, equal).otherwise(False)

    hits = compared.select("row", "class", "shift", "length", F.explode(F.filter(F.sequence("begin", "final"), matches)).alias("at"))
    return hits.select("row", "class", (F.col("shift") + F.col("at")).alias("start"), "length")


def proximity_hits(index: PositionalIndex, classes: DataFrame, within: int) -> DataFrame:
    """(row, class, start): places where one of a class's words begins a stretch of ``within`` words that holds them all, in any order.

    The postings of a class's rarest word choose documents and neighbourhoods; those of its other words are kept only
    near it.
    """
    terms = cut(classes.select("class", F.explode(F.array_distinct("terms")).alias("term")), "near-terms")
    seen = cut(index.frequencies(terms), "near-frequencies")
    known = terms.join(seen, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = known.groupBy("class").agg(F.min(F.struct("n", "term")).alias("r"), F.count(F.lit(1)).alias("size")).where("r.n > 0")
    wanted = cut(known.join(rarest, "class").select("class", "term", "size", (F.col("term") == F.col("r.term")).alias("rare")), "near-wanted")
    rare = index.lookup(wanted.where("rare").select("term", "class")).select(F.col("row").alias("in_row"), F.col("class").alias("of")).distinct()
    rows = index.lookup(wanted).join(rare, (F.col("row") == F.col("in_row")) & (F.col("class") == F.col("of")), "left_semi")
    by_place = Window.partitionBy("class", "row").orderBy("pos")
    rare_pos = F.when(F.col("rare"), F.col("pos"))
    before = F.last(rare_pos, ignorenulls=True).over(by_place.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(rare_pos, ignorenulls=True).over(by_place.rowsBetween(0, Window.unboundedFollowing))
    near = rows.withColumn("before", before).withColumn("after", after).where((F.col("pos") - F.col("before") < within) | (F.col("after") - F.col("pos") < within))
    held = F.size(F.collect_set("term").over(by_place.rangeBetween(0, within - 1)))
    return near.withColumn("held", held).where("held = size").select("row", "class", F.col("pos").alias("start"))


def covered(hits: DataFrame) -> DataFrame:
    """(row, n_hit): words of each row inside any hit, counted once; hits are summed in the order of their starts."""
    end = F.col("start") + F.col("length")
    spans = hits.groupBy("row", "start").agg(F.max("length").alias("length"))
    before = F.max(end).over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.col("before"), F.col("start"))))
    return spans.withColumn("before", before).groupBy("row").agg(F.sum(added).cast("long").alias("n_hit"))


def contamination_report(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, index: PositionalIndex | None = None) -> DataFrame:
    """How much of each document stands in the test items.

    Reads doc_id and text of ``docs``, item_id and text of ``items``. Result, one row per input row: doc_id, n_words,
    n_hit (words inside an occurrence of a test window), n_items, items_sha256 (of the ids of the items with such a
    window, sorted as text, comma-joined; of the empty text without any), contaminated. Null and empty texts have no
    words; rows that repeat an id have results of their own; null item ids count as one item with an empty id; item rows
    that share an id are one item; empty tables give an empty result or no hits; other columns are not read.
    """
    index = index or PositionalIndex.build(docs)
    classes, members = item_classes(items)
    hits = cut(phrase_hits(index, classes, window), "test-hits")
    of_items = hits.select("row", "class").distinct().join(members, "class").select("row", "item").distinct()
    listed = of_items.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    known = covered(hits).join(listed, "row").select(F.col("row").alias("in_row"), "n_hit", "items")
    rows = index.docs.select("row", "doc_id", "n_words").join(known, F.col("row") == F.col("in_row"), "left")
    names = F.coalesce(F.array_join("items", ","), F.lit(""))
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.greatest(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
