"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Every row of a source has the same expected number of copies, target / source size. Whole copies are taken as they are;
the fraction is a mass of words between 0 and the row's size. Two rows at a time exchange mass at random, with odds that
keep each row's expectation, until one of them is empty or full. The sum of the masses never changes, so the words taken
from a source equal its target but for the one row that remains at the end. Rows are paired within blocks of hashed ids;
each block leaves at most one open row, and the open rows of many blocks meet in the next level of the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.llm.shared import WORD_PATTERN, Written, cut, uniform

BLOCK_ROWS = 128
_FULL = 1e-9  # relative distance at which a mass counts as 0 or as the whole row


def let(value: Column, body) -> Column:
    """Bind ``value`` to a name inside an expression, so that it is evaluated once."""
    return F.transform(F.array(value), body)[0]


def target_sizes(sizes: DataFrame, total: float, cap: float) -> DataFrame:
    """(source, source_size, target): share ``total`` by weight, no source above ``cap`` times its size.

    ``sizes`` has source, source_size, weight. What a capped source cannot take is shared again among the others by
    weight. The level (words per unit of weight) only rises from round to round, so a source that is capped stays
    capped; each round is one aggregate of two numbers and the rounds end when the level stands still.
    """
    limit = F.col("source_size") * F.lit(float(cap))
    level = None
    while True:
        open_ = F.lit(True) if level is None else limit > F.col("weight") * F.lit(level)
        capped, weight = sizes.agg(
            F.sum(F.when(~open_, limit).otherwise(0.0)), F.sum(F.when(open_, F.col("weight")).otherwise(0)).cast("double")
        ).first()
        if not weight:
            break
        new = max(0.0, total - capped) / weight
        if level is not None and new <= level:
            break
        level = new
    if level is None:
        return sizes.withColumn("target", F.lit(0.0))
    return sizes.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def _reduce(units: DataFrame, level: int, id_type: str) -> DataFrame:
    """One level: units (source, blocks, u) -> one row per block with ``carry`` (null if all settled) and ``done``."""
    u = F.col("u")
    block = F.pmod(F.xxhash64(F.lit(level), u["doc_id"], u["nth"], u["size"]), F.col("blocks"))
    rnd = uniform(u["doc_id"], u["nth"], u["size"], salt=f"pivot{level}")
    drawn = units.select("source", block.alias("block"), F.struct(u["size"].alias("by_size"), rnd.alias("rnd"), u.alias("u")).alias("x"))
    grouped = drawn.groupBy("source", "block").agg(F.sort_array(F.collect_list("x"), asc=False).alias("xs"))

    unit_type = f"struct<doc_id:{id_type},nth:bigint,size:bigint,source_size:bigint,target:double,whole:bigint,mass:double>"
    done_type = f"array<struct<u:{unit_type},up:boolean>>"
    start = F.struct(F.lit(None).cast(unit_type).alias("carry"), F.array().cast(done_type).alias("done"))

    def full(v: Column) -> Column:
        return v["mass"] >= v["size"] * (1 - _FULL)

    def settled(v: Column) -> Column:
        return full(v) | (v["mass"] <= v["size"] * _FULL)

    def step(acc: Column, x: Column) -> Column:
        a, b = acc["carry"], x["u"]

        def exchanged(d: Column) -> Column:
            # d.to_a, d.to_b: what can move before one side is empty or full; odds keep both expectations
            move = F.when(x["rnd"] * (d["to_a"] + d["to_b"]) < d["to_b"], d["to_a"]).otherwise(-d["to_b"])
            pair = let(move, lambda m: F.struct(a.withField("mass", a["mass"] + m).alias("a"), b.withField("mass", b["mass"] - m).alias("b")))

            def split(p: Column) -> Column:
                carry = F.when(~settled(p["a"]), p["a"]).when(~settled(p["b"]), p["b"])
                ends = F.filter(F.array(p["a"], p["b"]), settled)
                return F.struct(
                    carry.cast(unit_type).alias("carry"),
                    F.concat(acc["done"], F.transform(ends, lambda v: F.struct(v.alias("u"), full(v).alias("up")))).cast(done_type).alias("done"),
                )

            return let(pair, split)

        room = F.struct(F.least(a["size"] - a["mass"], b["mass"]).alias("to_a"), F.least(a["mass"], b["size"] - b["mass"]).alias("to_b"))
        first = F.struct(b.cast(unit_type).alias("carry"), acc["done"].alias("done"))
        return F.when(a.isNull(), first).otherwise(let(room, exchanged))

    return grouped.select("source", F.aggregate("xs", start, step).alias("r")).select("source", "r.carry", "r.done")


def mix(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Words that the mix takes from every row.

    ``rows``: doc_id, source, size (one row per document, repeats allowed). ``targets``: source, source_size, target.
    Result: doc_id, source, size, source_size, target, nth, copies, taken = copies * size. Copies of a row are the floor or
    the ceiling of target / source_size; a source's taken words differ from its target by less than the size of one
    row. Rows of size 0 take nothing; null is a source like any other; rows that repeat in id, source and size are told
    apart by a running number; an empty table gives an empty result. Draws come from md5 hashes, so reruns agree.
    """
    id_type = rows.schema["doc_id"].dataType.simpleString()
    thin = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("times"))
    t = targets.select(F.col("source").alias("of"), "source_size", "target")
    thin = thin.join(t, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    thin = thin.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    thin = thin.withColumn("whole", F.floor(rate)).withColumn("mass", (rate - F.floor(rate)) * F.col("size"))
    base = cut(thin.withColumn("open", (F.col("mass") > F.col("size") * _FULL) & (F.col("mass") < F.col("size") * (1 - _FULL))), "mix-rows")

    out = base.where(~F.col("open")).select(
        "doc_id", "source", "size", "source_size", "target", "nth",
        (F.col("whole") + F.when((F.col("size") > 0) & (F.col("mass") >= F.col("size") * 0.5), 1).otherwise(0)).alias("copies"),
    )
    unit = F.struct("doc_id", "nth", "size", "source_size", "target", "whole", "mass")
    units = base.where("open").select("source", unit.alias("u"))

    def result(df: DataFrame, up: Column) -> DataFrame:
        return df.select(
            F.col("u.doc_id"), "source", F.col("u.size"), F.col("u.source_size"), F.col("u.target"), F.col("u.nth"), (F.col("u.whole") + F.when(up, 1).otherwise(0)).alias("copies")
        )

    level = 0
    while True:
        counts = units.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("long"))
        most = counts.agg(F.max("blocks")).first()[0]
        if not most:
            break
        counts = counts.select(F.col("source").alias("of"), "blocks")
        sized = units.join(counts, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        reduced = Written(_reduce(sized, level, id_type), f"mix-level{level}").df
        ended = reduced.select("source", F.explode("done").alias("d")).select("source", F.col("d.u").alias("u"), F.col("d.up").alias("up"))
        out = out.unionByName(result(ended, F.col("up")))
        units = reduced.where(F.col("carry").isNotNull()).select("source", F.col("carry").alias("u"))
        if most == 1:  # one open row per source remains: the nearer end
            out = out.unionByName(result(units, F.col("u.mass") >= F.col("u.size") * 0.5))
            break
        level += 1
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
                  id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Mix whole documents: sources in code point order (null last) weigh ``weights`` in turn and share ``share`` times all words.

    Only the id, the source and the text are read; a null text has size 0. See ``mix`` for the rules of the result.
    """
    size = word_count(F.col(text_col))
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")), "mix-sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # over the distinct sources alone
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    sums = cut(sums.withColumn("weight", turn), "mix-sources")
    total = (sums.agg(F.sum("source_size")).first()[0] or 0) * share
    return mix(rows, target_sizes(sums, total, cap))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The documents of a mix: each row as often as its ``copies`` say, with its own columns.

    Rows that share id, source and size are told apart by a running number, as in ``mix``.
    """
    copies = mix_documents(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options).where("copies > 0")
    copies = cut(copies.select(*[F.col(c).alias(f"mix_{c}") for c in ("doc_id", "source", "size", "nth", "copies")]), "mix-copies")
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.select(
        "row", F.col(f"row.{id_col}").alias("key_id"), F.col(f"row.{source_col}").alias("key_source"), word_count(F.col(f"row.{text_col}")).alias("key_size")
    )
    same = Window.partitionBy("key_id", "key_source", "key_size").orderBy(F.xxhash64(f"row.{text_col}"))
    rows = rows.withColumn("key_nth", F.row_number().over(same).cast("long"))
    on = F.lit(True)
    for c, k in (("doc_id", "id"), ("source", "source"), ("size", "size"), ("nth", "nth")):
        on = on & F.col(f"mix_{c}").eqNullSafe(F.col(f"key_{k}"))
    joined = rows.join(copies, on)
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))).alias("copy")).select("row.*")


def word_count(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
