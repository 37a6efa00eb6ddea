"""Similarity join on word shingles by signature trees.

Equal word sequences are one node. Nodes that share a band of minimum hashes meet in a bucket; 32 bands of 3 minima
miss a pair of likeness 0.8 with odds of 0.488**32, about 1e-10, and likelier pairs with less. In a bucket the members form a
signature tree: an inner node holds the OR of its members' token bitmaps and the range of their sizes. A traversal of
the tree against itself drops a pair of nodes when their sizes are too far apart or when the common bits cannot hold the
overlap that the threshold asks for, and when all members are linked already. What is left is compared exactly.

Before that, each bucket's members are compared with its most central member (the one that shares most buckets), which
links the bulk of every group of near copies with one comparison per member. Only buckets whose members then still belong
to different components go through the tree, in tiles of bounded size, and a pair is compared in the first band that
both members share. No pairs are listed between members that are linked already, and no pair is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.components import components
from sitelake.llm.shared import WordHasher, cut, lean, mix64, shingle_hashes

SHINGLE = 5
BANDS, ROWS = 32, 3
PERCENT = 80  # two sets link when 100 * intersection >= PERCENT * union
TILE_ROWS = 1024
STAR_ROWS = 512  # members compared with one centre in one task
FANOUT = 8
BITS_PER_TOKEN = 8


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test on two sorted sets of distinct shingle hashes."""
    if min(len(a), len(b)) * 100 < PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")  # merges two sorted runs
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


class Shingler:
    """Shingle sets and band keys of texts."""

    def __init__(self) -> None:
        self.hasher = WordHasher()
        seeds = mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
        self.mul = (seeds[: BANDS * ROWS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.xor = (seeds[BANDS * ROWS :] >> np.uint64(32)).astype(np.uint32)

    def shingles(self, text: str | None) -> tuple[np.ndarray, bytes]:
        """(sorted distinct shingle hashes, 16-byte digest of the lower-cased word sequence)."""
        raw = (text or "").encode()
        words, _, _ = self.hasher.words(raw)
        sequence = hashlib.blake2b(b" ".join(raw.lower().split()), digest_size=16).digest()
        return np.unique(shingle_hashes(words, SHINGLE)), sequence

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit key per band, from ROWS minima each."""
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(short), 1024):
            np.minimum(least, ((short[i : i + 1024, None] ^ self.xor) * self.mul).min(axis=0), out=least)
        minima = least.astype(np.uint64).reshape(BANDS, ROWS)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for r in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) ^ minima[:, r])
        return key.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, sequence, bands) per row; texts without words have no bands."""
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = thin.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Shingler()
        for batch in batches:
            sizes, sequences, bands = [], [], []
            for text in batch.column(1):
                shingles, sequence = tool.shingles(text.as_py())
                sizes.append(len(shingles))
                sequences.append(sequence)
                bands.append(tool.bands(shingles) if len(shingles) else None)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sequences, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "sequence", "bands"])

    return thin.mapInArrow(lean(run), f"doc_id {id_type}, n_shingles bigint, sequence binary, bands array<bigint>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the wanted nodes (node, doc, sequence), from their documents' texts."""
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(wanted, "doc").dropDuplicates(["doc", "node", "text"]).select("node", "sequence", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Shingler()
        for batch in batches:
            nodes, sets = [], []
            for node, sequence, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shingles, found = tool.shingles(text)
                if found == sequence:  # an id may stand for several texts
                    nodes.append(node)
                    sets.append(shingles.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return rows.mapInArrow(lean(run), "node bigint, shingles array<bigint>")


def _numpy_sets(column: pa.ListArray) -> list[np.ndarray]:
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy().view(np.uint64)
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


LINKS = "a bigint, b bigint"


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def star_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among the pairs (centre, node). A centre with many nodes is worked on by many tasks."""
    counts = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).alias("parts"))
    dealt = pairs.join(counts, "centre").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    members = dealt.join(sets, "node").select("centre", "part", F.lit(1).alias("role"), "node", "shingles")
    heads = dealt.select("centre", "part").distinct().join(sets.withColumnRenamed("node", "centre"), "centre")
    rows = heads.select("centre", "part", F.lit(0).alias("role"), F.col("centre").alias("node"), "shingles").unionByName(members)
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "centre", "part").sortWithinPartitions("centre", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = None
        for batch in batches:
            found = []
            roles, nodes = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for role, node, shingles in zip(roles, nodes, _numpy_sets(batch.column(4)), strict=True):
                if role == 0:
                    centre = (node, shingles.copy())
                elif linked(centre[1], shingles):
                    found.append((centre[0], node))
            if found:
                yield _links(found)

    return rows.mapInArrow(lean(run), LINKS)


# ---- signature tree of a tile -------------------------------------------------------------------------------


class SignatureTree:
    """Tree over the members of a tile: OR-ed bitmaps, size ranges and the component if all members share one."""

    def __init__(self, sets: list[np.ndarray], comps: np.ndarray):
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        # members of one component lie together, the single ones after them by size
        many = np.bincount(np.unique(comps, return_inverse=True)[1])[np.unique(comps, return_inverse=True)[1]] > 1
        self.order = np.lexsort((sizes, np.where(many, comps, 0), ~many))
        width = 1 << int(max(64, BITS_PER_TOKEN * sizes.max()) - 1).bit_length()
        bits = np.zeros((len(sets), width // 64), dtype=np.uint64)
        for row, i in enumerate(self.order):
            at = np.unique(sets[i] & np.uint64(width - 1))
            np.bitwise_or.at(bits[row], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        size = sizes[self.order]
        extra = size - np.bitwise_count(bits).sum(axis=1).astype(np.int64)  # tokens beyond the first of each bit
        # levels[0] are the members; each level has (bitmaps, least size, most size, most extra, component or -1)
        self.levels = [(bits, size, size, extra, comps[self.order])]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, extra, comp = self.levels[-1]
            start = np.arange(0, len(bits), FANOUT)
            least, most = np.minimum.reduceat(comp, start), np.maximum.reduceat(comp, start)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(bits, start, axis=0),
                    np.minimum.reduceat(low, start),
                    np.maximum.reduceat(high, start),
                    np.maximum.reduceat(extra, start),
                    np.where(least == most, least, -1),
                )
            )

    def _possible(self, level: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which node pairs may hold a link, and the greatest overlap they may have."""
        bits, low, high, extra, comp = self.levels[level]
        ok = (comp[x] != comp[y]) | (comp[x] < 0)
        ok &= (100 * high[x] >= PERCENT * low[y]) & (100 * high[y] >= PERCENT * low[x])
        overlap = np.zeros(len(x), dtype=np.int64)
        step = max(1, (1 << 21) // bits.shape[1])
        at = np.flatnonzero(ok)
        for i in range(0, len(at), step):
            part = at[i : i + step]
            overlap[part] = np.bitwise_count(bits[x[part]] & bits[y[part]]).sum(axis=1)
        overlap += np.minimum(extra[x], extra[y])
        ok &= (100 + PERCENT) * overlap >= PERCENT * (low[x] + low[y])
        return ok, overlap

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of member pairs (positions in the tile) that the bounds leave, likeliest first within a block."""
        stack = [(len(self.levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
        while stack:
            level, x, y = stack.pop()
            if len(x) > 1 << 16:
                half = len(x) // 2
                stack += [(level, x[half:], y[half:]), (level, x[:half], y[:half])]
                continue
            ok, overlap = self._possible(level, x, y)
            if level == 0:
                ok &= x < y
                size = self.levels[0][1]
                at = np.flatnonzero(ok)
                at = at[np.argsort(-overlap[at] / (size[x[at]] + size[y[at]]), kind="stable")]
                if len(at):
                    yield self.order[x[at]], self.order[y[at]]
                continue
            x, y = x[ok], y[ok]
            below = len(self.levels[level - 1][0])
            child = np.arange(FANOUT)
            cx = np.repeat(x[:, None] * FANOUT + child, FANOUT, axis=1).ravel()
            cy = np.tile(y[:, None] * FANOUT + child, (1, FANOUT)).ravel()
            keep = (cx < below) & (cy < below) & (cx <= cy)
            if keep.any():
                stack.append((level - 1, cx[keep], cy[keep]))


def tile_links(nodes: list[int], comps: list[int], sides: np.ndarray, band: int, bands: np.ndarray, sets: list[np.ndarray], cross: bool) -> list[tuple[int, int]]:
    """A spanning set of the links between different components of a tile."""
    parent = {c: c for c in comps}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    for left, right in SignatureTree(sets, np.array(comps, dtype=np.int64)).pairs():
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            if (cross and sides[i] == sides[j]) or root(comps[i]) == root(comps[j]):
                continue
            if np.argmax(bands[i] == bands[j]) != band:  # an earlier band has this pair
                continue
            if linked(sets[i], sets[j]):
                parent[root(comps[i])] = root(comps[j])
                out.append((nodes[i], nodes[j]))
    return out


def tree_links(members: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different components in the buckets ``members`` (key, band, node, comp)."""
    sizes = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    buckets = sizes.groupBy("key").agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp")).alias("main"))
    mixed = buckets.where("m > 2 AND comps > 1")  # a bucket of two was compared as a star
    rows = members.join(mixed, "key").withColumn("side", (F.col("comp") == F.col("main.comp")).cast("int"))
    # tiles: the largest component (side 1) and the rest (side 0) are cut into chunks; rest x rest and rest x largest
    half = TILE_ROWS // 2
    rest_chunks = F.greatest(F.lit(1), F.ceil((F.col("m") - F.col("main.n")) / half))
    main_chunks = F.ceil(F.col("main.n") / half)
    rows = rows.withColumn("g0", rest_chunks).withColumn("g1", main_chunks)
    chunk = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 1, F.col("g1")).otherwise(F.col("g0")))
    rows = rows.withColumn("chunk", chunk)
    one = F.array(F.lit(-1).cast("bigint"))
    to_rest = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("g0") - 1), lambda i: i * F.col("g1") + F.col("chunk"))
    to_main = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("g1") - 1), lambda k: F.col("chunk") * F.col("g1") + k)
    own = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("g0") - 1),
        lambda j: -2 - (F.least(j, F.col("chunk")) * F.col("g0") + F.greatest(j, F.col("chunk"))),
    )
    tiles = F.when(F.col("m") <= TILE_ROWS, one).when(F.col("side") == 1, to_rest).otherwise(F.concat(to_main, own))
    rows = rows.withColumn("tile", F.explode(tiles)).select("key", "tile", "band", "node", "comp", "side")
    full = rows.join(nodes.select("node", "bands").join(sets, "node"), "node")
    full = full.select("key", "tile", "band", "node", "comp", "side", "bands", "shingles")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = full.repartition(n, "key", "tile").sortWithinPartitions("key", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> list[tuple[int, int]]:
            node, comp, side, bands, sets_ = zip(*held, strict=True)
            return tile_links(list(node), list(comp), np.array(side), at[2], np.stack(bands), list(sets_), at[1] >= 0)

        for batch in batches:
            ids = [batch.column(i).to_pylist() for i in range(6)]
            bands, sets_ = _numpy_sets(batch.column(6)), _numpy_sets(batch.column(7))
            for i, (key, tile, band, node, comp, side) in enumerate(zip(*ids, strict=True)):
                if at is not None and at[:2] != (key, tile):
                    if found := done():
                        yield _links(found)
                    held.clear()
                at = (key, tile, band)
                held.append((node, comp, side, bands[i].copy(), sets_[i].copy()))
        if held and (found := done()):
            yield _links(found)

    return full.mapInArrow(lean(run), LINKS)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    A text's set holds its distinct five-word shingles (A-Z lower-cased; words are runs of anything but space and
    \\t-\\r); fewer words form one shingle; without words the set is empty and links with nothing, so the row is its own
    component. component_id is the smallest id reachable by links, the row's own included. Rows without an id are counted
    (n_shingles) but take no part in links; their component_id is null. Repeated rows and ids that stand for several texts are
    allowed: an id's rows belong to the component of their own text. An empty table gives an empty result; other columns
    are not read.
    """
    rows = cut(signatures(docs, id_col, text_col), "signatures")
    some = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = some.groupBy("sequence").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written, so the numbers stand

    keyed = nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    live = cut(keyed.join(shared, "key").select("key", "band", "node", "n", "members"), "buckets")
    weight = live.groupBy("node").agg(F.sum("members").alias("weight"))
    central = live.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("c"))
    pairs = live.join(central.select("key", F.col("c.node").alias("centre"), F.col("c.n").alias("cn")), "key").where("node <> centre")
    near = 100 * F.least("n", "cn") >= PERCENT * F.greatest("n", "cn")
    pairs = cut(pairs.where(near).select("centre", "node").distinct(), "stars")

    wanted = nodes.join(live.select("node").distinct(), "node", "left_semi").select("node", "doc", "sequence")
    sets = cut(shingle_sets(docs, wanted, id_col, text_col), "sets")
    links = cut(star_links(pairs, sets), "star-links")
    comp = components(links)
    placed = live.join(comp, "node", "left").select("key", "band", "node", F.coalesce("comp", "node").alias("comp"))
    more = tree_links(cut(placed, "placed"), nodes, sets)
    comp = components(cut(links.unionByName(more), "links"))

    named = nodes.select("node", "doc", "sequence").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = named.groupBy("comp").agg(F.min("doc").alias("component_id"))
    named = cut(named.join(names, "comp").select("sequence", "component_id"), "components")
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("sequence")).alias("sequence"))
    out = out.join(named, "sequence", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component (that with the smallest id), with all its columns; rows without words or id stay."""
    found = near_components(docs, id_col, text_col)
    stay = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("stay_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    known = rows.where(F.col(f"row.{id_col}").isNotNull()).join(stay, F.col(f"row.{id_col}") == F.col("stay_id"), "left_semi")
    return known.select("row.*").unionByName(rows.where(F.col(f"row.{id_col}").isNull()).select("row.*"))
