"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A key descends region, rack and shard. At each level every child draws -ln(u)/weight with u from the md5 of the child's
name and the key; the smallest draw wins, so a child gets keys in proportion to its weight. A node's weight is the sum
of its shards' weights. Raising one weight can only shrink that child's draws, so keys move into its subtree and
nowhere else; a new shard in a region of its own takes keys only into itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.llm.shared import cut, hash52, uniform

ROWS_PER_BLOCK = 2048


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def standard_tree(shards: int, planned: int = 16, racks: int = 4, per_rack: int = 4) -> list[Leaf]:
    """The map for a shard count: ``planned`` shards fill regions of two racks; every later shard has its own region."""
    leaves = []
    for s in range(shards):
        rack = s // per_rack
        if s < planned:
            leaves.append(Leaf(f"region{rack // max(1, racks // 2)}", f"rack{rack}", s))
        else:
            leaves.append(Leaf(f"added{s}", f"added{s}", s))
    return leaves


def draw(node: str, weight: float, key: Column) -> Column:
    return -F.log(uniform(key, salt=node)) / F.lit(float(weight))


def descend(leaves: list[Leaf], key: Column) -> Column:
    """The shard number of a key: one weighted draw per level. Leaves of weight 0 get nothing; null keys share a shard."""
    alive = [x for x in leaves if x.weight > 0]
    if not alive:
        raise ValueError("the tree has no shard of positive weight")

    def choose(level: list, name, below) -> Column:
        """Smallest draw among the children at this level, then the same below the winner."""
        names = sorted({name(x) for x in level})
        groups = {n: [x for x in level if name(x) == n] for n in names}
        if len(names) == 1:
            return below(groups[names[0]])
        draws = [F.struct(draw(n, sum(x.weight for x in groups[n]), key).alias("d"), F.lit(i).alias("i")) for i, n in enumerate(names)]
        winner = F.array_min(F.array(*draws))["i"]
        # bind the winner once, so the draws of a level are not evaluated again for each branch below
        return F.transform(F.array(winner), lambda w: _case(w, [below(groups[n]) for n in names]))[0]

    return choose(
        alive,
        lambda x: f"{x.region}",
        lambda region: choose(
            region,
            lambda x: f"{x.region}/{x.rack}",
            lambda rack: choose(rack, lambda x: f"{x.region}/{x.rack}/{x.shard:06d}", lambda leaf: F.lit(leaf[0].shard)),
        ),
    )


def _case(winner: Column, branches: list[Column]) -> Column:
    out = F.when(winner == 0, branches[0])
    for i, branch in enumerate(branches[1:], 1):
        out = out.when(winner == i, branch)
    return out


def number_rows(rows: DataFrame, group: str, order: list[str], times: str, rank_hash: str = "h") -> DataFrame:
    """Gapless 0-based ``slot`` of each row within ``group`` by ``order``, whose first column is a 52-bit hash.

    Blocks of hash ranges are numbered on their own and offset by the sizes of the blocks before them, so no task
    sorts a whole group. A row with ``times`` above 1 stands for that many equal rows and comes out as often.
    """
    rows = cut(rows, "slots")
    n, groups = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(group)).first()
    bits = min(40, max(0, math.ceil(math.log2(max(1.0, n / max(1, groups) / ROWS_PER_BLOCK)))))
    rows = rows.withColumn("block", F.shiftright(F.col(rank_hash), 52 - bits))
    from pyspark.sql import Window

    sums = rows.groupBy(group, "block").agg(F.sum(times).alias("in_block"))
    before = Window.partitionBy(group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "block", F.coalesce(F.sum("in_block").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy(group, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(sums, [group, "block"]).withColumn("upto", F.col("offset") + F.sum(times).over(within))
    return joined.withColumn("slot", F.explode(F.sequence(F.col("upto") - F.col(times), F.col("upto") - 1))).drop("block", "offset", "upto", times)


def shard_documents(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row under the law ``key``: the id and the tree decide.

    Result, one row per input row: doc_id, size (UTF-8 bytes of the text plus 1; null text has none), text_crc32, law,
    shard, slot (gapless from 0 within the shard, in the order of the id's hash), grown_shard (under ``grown``). Null
    ids hash as the empty string and share a shard; rows that repeat in id and text get slots of their own; an empty
    table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    thin = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    thin = thin.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("times"))
    key = F.col("doc_id")
    placed = thin.withColumn("shard", descend(leaves, key)).withColumn("grown_shard", descend(grown, key)).withColumn("h", hash52(key, salt="slot"))
    return number_rows(placed, "shard", ["h", "doc_id", "size", "text_crc32"], "times").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
