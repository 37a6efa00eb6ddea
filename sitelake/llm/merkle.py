"""Merkle manifest of a dataset: a persistent hash tree per language, joined under one root, with path-copied versions.

Leaves are numbered within their language by range partitions (no task sorts a whole language) and cut into aligned
blocks of 8 ** 3. A block is one small group: its task hashes the three levels above its leaves and hands one node to the
next storey, where 512 such nodes form the next block, and so on until each language has one node. The languages' nodes
form a last tree of the same make. All nodes are written once and never change.

A changed leaf makes a version of the tree. The version owns only the copies of the nodes on its own path and shares all
others with the tree. Its copies within the aligned block are hashed from the block's nodes; the copies above continue,
still in the block's task, along the block's upper path, a short list of sibling digests that is joined on per block.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.llm.shared import Written

FANOUT = 8
DEPTH = 3  # levels that a block adds above its nodes
BLOCK = FANOUT**DEPTH
TOP = -1  # tree of the languages' roots

_PATH = "array<struct<left:string,right:string>>"
_NODE_FIELDS = [("tree", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("n", pa.int64()), ("last", pa.bool_())]
_PATH_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 (lower-case hex) of the encoded fields, joined."""
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def block_levels(nodes: list[str], whole: bool) -> list[list[str]]:
    """The nodes of a block and the levels above them: all ``DEPTH`` of them in a tree of several blocks, else up to one node."""
    levels = [nodes]
    while len(levels) <= DEPTH if whole else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """(left, right) siblings of a block's node and of its ancestors, from the bottom; each side's digests are joined."""
    out = []
    for level in levels[:-1]:
        first = at // FANOUT * FANOUT
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + FANOUT])))
        at //= FANOUT
    return out


def copied_path(leaf: str, path: list[tuple[str, str]]) -> list[str]:
    """Digests of the ancestors that a version with this leaf owns, from the bottom to the root."""
    out = []
    for left, right in path:
        leaf = digest(left + leaf + right)
        out.append(leaf)
    return out


def positions(rows: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """Adds ``idx``, the gapless 0-based place within ``group`` by ``order`` (nulls first), and ``n``, the group's rows.

    Rows are range-partitioned by group and order, numbered within each (partition, group) and offset by the counts of
    the partitions before; only those counts, a row per partition and group, meet in a window of a group.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    dealt = Written(rows.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), f"{label}-dealt").df
    sums = dealt.groupBy("part", *group).agg(F.count(F.lit(1)).alias("in_part"))
    of_group = Window.partitionBy(*group)
    before = F.sum("in_part").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(
        F.col("part").alias("of_part"), *[F.col(c).alias(f"of_{c}") for c in group], F.coalesce(before, F.lit(0)).alias("offset"), F.sum("in_part").over(of_group).alias("n")
    )
    on = F.col("part") == F.col("of_part")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    nth = F.row_number().over(Window.partitionBy("part", *group).orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    numbered = dealt.withColumn("nth_in_part", nth).join(sums, on).withColumn("idx", F.col("offset") + F.col("nth_in_part") - 1)
    return Written(numbered.drop("part", "of_part", *[f"of_{c}" for c in group], "offset", "nth_in_part"), f"{label}-numbered").df


def _grow(block: pa.Table) -> pa.Table:
    """All nodes that a block adds above its own."""
    block = block.sort_by("idx")
    tree, n, first = block["tree"][0].as_py(), block["n"][0].as_py(), block["idx"][0].as_py() // BLOCK
    levels = block_levels(block["digest"].to_pylist(), n > BLOCK)
    rows = []
    for up, level in enumerate(levels[1:], 1):
        base = first * FANOUT ** (DEPTH - up)
        rows += [(tree, up, base + i, d, n, up == len(levels) - 1) for i, d in enumerate(level)]
    return pa.Table.from_pylist([dict(zip([f for f, _ in _NODE_FIELDS], r, strict=True)) for r in rows], schema=pa.schema(_NODE_FIELDS))


def _paths(block: pa.Table) -> pa.Table:
    """Siblings of each node of a block up to the block's top."""
    block = block.sort_by("idx")
    first = block["idx"][0].as_py() // BLOCK * BLOCK
    levels = block_levels(block["digest"].to_pylist(), block["n"][0].as_py() > BLOCK)
    path = [[{"left": a, "right": b} for a, b in siblings(levels, i - first)] for i in block["idx"].to_pylist()]
    return pa.table({"tree": block["tree"], "idx": block["idx"], "inside": pa.array(path, _PATH_TYPE)})


def _block() -> Column:
    return F.expr(f"idx div {BLOCK}")


def _in_blocks(base: DataFrame):
    return base.groupBy("tree", _block().alias("block"))


def storeys(base: DataFrame, label: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """(bases, nodes): the nodes that each storey starts from, its last being one per tree, and the nodes above, by storey.

    ``base`` has tree, idx, digest, n (nodes of the tree at this level). Trees that end early go along as they are.
    """
    bases, nodes = [base.select("tree", "idx", "digest", "n")], []
    most = base.agg(F.max("n")).first()[0] or 0
    while most > 1:
        grown = _in_blocks(bases[-1].where("n > 1")).applyInArrow(_grow, "tree long, level int, idx long, digest string, n long, last boolean")
        grown = Written(grown, f"{label}-storey{len(nodes)}").df
        nodes.append(grown.select("tree", (F.col("level") + DEPTH * len(nodes)).alias("level"), "idx", "digest"))
        above = grown.where("last").select("tree", "idx", "digest", F.ceil(F.col("n") / BLOCK).cast("long").alias("n"))
        bases.append(above.unionByName(bases[-1].where("n = 1")))
        most = -(-most // BLOCK)
    return bases, nodes


def upper_paths(bases: list[DataFrame], above: DataFrame, label: str) -> DataFrame:
    """(tree, idx, path, subroot) of the nodes of the first base: their siblings up to the root.

    ``above`` has tree and path: the siblings of each tree's own root.
    """
    up = Written(bases[-1].join(above, "tree").select("tree", "idx", "path", F.col("digest").alias("subroot")), f"{label}-paths").df
    for s in range(len(bases) - 2, -1, -1):
        inside = _in_blocks(bases[s]).applyInArrow(_paths, f"tree long, idx long, inside {_PATH}")
        up = up.select("tree", F.col("idx").alias("block"), "path", "subroot")
        joined = inside.withColumn("block", _block()).join(up, ["tree", "block"])
        up = Written(joined.select("tree", "idx", F.concat("inside", "path").alias("path"), "subroot"), f"{label}-paths{s}").df
    return up


@dataclass
class Manifest:
    """A written tree. ``leaves``: tree, idx, n, digest, changed and the columns kept; ``nodes``: tree, level, idx, digest."""

    leaves: DataFrame
    nodes: DataFrame
    upper: DataFrame
    root: str | None

    def versions(self, keep: list[str]) -> DataFrame:
        """One row per leaf: ``keep``, digest, subroot, proof_sha256, version, copies, folded_root.

        ``copies`` are the digests that the leaf's version owns, level by level up to its root: those on the path of
        ``changed`` where it is not null, else of the leaf itself, whose version is the tree. Node (level, idx) of a
        version is its copy if idx is the leaf's own idx divided by 8 ** level, and the tree's node if not.
        """
        kinds = {f.name: f.dataType.simpleString() for f in self.leaves.schema if f.name in keep}
        schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "tree long, idx long, digest string, subroot string, proof_sha256 string, changed boolean, copies array<string>, folded_root string"])

        def run(block: pa.Table, upper: pa.Table) -> pa.Table:
            block = block.sort_by("idx")
            leaves, changed = block["digest"].to_pylist(), block["changed"].to_pylist()
            levels = block_levels(leaves, block["n"][0].as_py() > BLOCK)
            above = [(p["left"], p["right"]) for p in upper["path"][0].as_py()]
            proofs, copies, roots = [], [], []
            for i, (leaf, new) in enumerate(zip(leaves, changed, strict=True)):
                path = siblings(levels, i) + above
                proofs.append(digest("".join(a + b for a, b in path)))
                own = copied_path(leaf if new is None else new, path)
                copies.append(own)
                roots.append(own[-1] if own else (leaf if new is None else new))
            subroot = [upper["subroot"][0].as_py()] * len(leaves)
            out = [*[block[c] for c in keep], block["tree"], block["idx"], block["digest"], pa.array(subroot, pa.string()), pa.array(proofs, pa.string()),
                   pa.array([c is not None for c in changed]), pa.array(copies, pa.list_(pa.string())), pa.array(roots, pa.string())]
            return pa.table(out, names=[*keep, "tree", "idx", "digest", "subroot", "proof_sha256", "changed", "copies", "folded_root"])

        blocks = self.leaves.withColumn("block", _block()).groupBy("tree", "block")
        upper = self.upper.select("tree", F.col("idx").alias("block"), "path", "subroot").groupBy("tree", "block")
        return blocks.cogroup(upper).applyInArrow(run, schema)


def build(rows: DataFrame, keep: list[str]) -> Manifest:
    """The manifest of ``rows``: columns ``tree_key`` (text), ``digest``, ``changed`` (digest or null) and ``keep``, by which leaves ascend.

    A null key is a tree of its own, ordered first. Rows that agree in ``keep`` and digest are leaves of their own, one
    after the other. No rows: no nodes and no root.
    """
    rows = Written(rows.select("tree_key", "digest", "changed", *keep).withColumn("row", F.monotonically_increasing_id()), "merkle-leaves").df
    placed = positions(rows, ["tree_key"], [*keep, "digest", "row"], "merkle").drop("row")
    keys = positions(placed.select("tree_key").distinct(), [], ["tree_key"], "merkle-keys")
    trees = keys.count()
    keys = keys.select(F.col("tree_key").alias("of_key"), F.col("idx").alias("tree"))
    leaves = Written(placed.join(keys, F.col("tree_key").eqNullSafe(F.col("of_key"))).drop("of_key"), "merkle-placed").df
    bases, nodes = storeys(leaves, "merkle")
    top = bases[-1].select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest", F.lit(trees).cast("long").alias("n"))
    top = Written(top, "merkle-subroots").df
    top_bases, top_nodes = storeys(top, "merkle-top")
    root = top_bases[-1].select("digest").first()
    nothing = F.array().cast(_PATH).alias("path")
    of_trees = upper_paths(top_bases, top.sparkSession.range(1).select(F.lit(TOP).cast("long").alias("tree"), nothing), "merkle-top")
    of_trees = of_trees.select(F.col("idx").alias("tree"), "path")
    upper = upper_paths(bases[1:] or bases, of_trees, "merkle")
    every = leaves.select("tree", F.lit(0).alias("level"), "idx", "digest")
    for table in [*nodes, top.select("tree", F.lit(0).alias("level"), "idx", "digest"), *top_nodes]:
        every = every.unionByName(table)
    return Manifest(leaves.drop("tree_key"), every, upper, root["digest"] if root else None)


def lower_ascii(text: Column) -> Column:
    return F.translate(text.cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tamper_report(docs: DataFrame) -> DataFrame:
    """The manifest of documents by language, and for each row the root that its tampered or own leaf folds to.

    Reads doc_id, source, lang, n_chars and text, each of which may be null. Tampered are rows whose crc32(decimal
    doc_id) is divisible by 3 (never those with a null id); their text is lower-cased in A-Z, a null text stays. Result,
    one row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Rows that repeat an id
    follow each other by their leaf; equal rows are leaves of their own with the proofs of their places. Null ids come
    first. A language of one row has its leaf as subroot; without siblings the proof is the digest of nothing. An empty
    table gives an empty result; other columns are not read.
    """
    c = {name: F.col(name) for name in ("doc_id", "source", "lang", "n_chars", "text")}
    tampered = F.pmod(F.crc32(c["doc_id"].cast("string").cast("binary")), F.lit(3)) == 0
    rows = docs.select(
        c["lang"].cast("string").alias("tree_key"),
        leaf_digest(*c.values()).alias("digest"),
        F.when(tampered, leaf_digest(c["doc_id"], c["source"], c["lang"], c["n_chars"], lower_ascii(c["text"]))).alias("changed"),
        c["doc_id"].alias("doc_id"),
    )
    manifest = build(rows, ["doc_id"])
    root = F.lit(manifest.root).cast("string")
    return manifest.versions(["doc_id"]).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )
