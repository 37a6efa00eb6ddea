"""Ranked lexical search of query items over all documents by dual-tree search.

Items are handled in blocks of a bounded number of words, so that a block's vocabulary and hierarchy fit every task. One
pass over the texts writes each document's length and its counts of the block's terms; totals and document frequencies
follow from that table. Items then form a hierarchy whose nodes hold, per term, the largest weight below; each task
does the same for its documents, batch by batch, with the largest impact per term. The product of two nodes' maxima
bounds every score between their items and documents. A pair of nodes whose bound is below the weakest kth score among
its items is dropped whole; what reaches the leaves is scored exactly. Kth scores start from those of a hashed share of
the documents, which all documents must reach anyway, and rise while a task goes on.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelake.llm.shared import Written, cut

# Fixed value: bytes outside terms become spaces, A-Z becomes a-z (the bytes of [0-9A-Za-z] and of all non-ASCII characters are kept).
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

BLOCK_WORDS = 32_768  # words of the items that are searched together, a single longer item apart
PRIMER_ROWS = 8_192  # documents, about, whose scores give the first thresholds; all documents are searched in any case
ITEM_LEAF, DOC_LEAF, FAN = 4, 16, 4
BATCH_ROWS = 4_096  # documents of one hierarchy, fewer where a node's maxima are wide
BATCH_BYTES = 64 << 20  # of the leaves' maxima
_NO_ID = np.iinfo(np.int64).max  # sorts null ids last
_EXACT = 2.0**53  # sums of whole numbers below it are exact in doubles


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM_BYTES).split()


class Hierarchy:
    """Rows in an order, cut into leaves and these into nodes of ``FAN``; ``levels`` from the leaves up: (first row per node, maxima)."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n_rows: int, width: int, leaf: int):
        starts = np.arange(0, n_rows, leaf)
        maxima = np.zeros((len(starts), width))
        np.maximum.at(maxima, (rows // leaf, cols), values)
        self.n_rows, self.levels = n_rows, [(starts, maxima)]
        while len(starts) > 1:
            at = np.arange(0, len(starts), FAN)
            starts, maxima = starts[at], np.maximum.reduceat(maxima, at, axis=0)
            self.levels.append((starts, maxima))


def clustered(starts: np.ndarray, cols: np.ndarray, values: np.ndarray, width: int, leaf: int) -> np.ndarray:
    """An order of sparse rows in which like rows stand together: halves around two centres, and halves of these, down to leaves.

    The centres begin as two rows that share little and move once to the means of their halves.
    """
    n = len(starts) - 1
    sizes = np.diff(starts)
    rows = np.repeat(np.arange(n), sizes)
    unit = values / np.sqrt(np.maximum(np.bincount(rows, weights=np.square(values, dtype=float), minlength=n), 1.0))[rows]
    order, open_ = np.arange(n), [(0, n)]
    while open_:
        lo, hi = open_.pop()
        if hi - lo <= leaf:
            continue
        mine = order[lo:hi]
        size = sizes[mine]
        at = np.arange(size.sum()) + np.repeat(starts[mine] - (np.cumsum(size) - size), size)
        row, col, value = np.repeat(np.arange(hi - lo), size), cols[at], unit[at]

        def likeness(weights: np.ndarray, row=row, col=col, value=value, m=hi - lo) -> np.ndarray:
            """Of every row to the mean of the rows, weighted."""
            centre = np.bincount(col, weights=value * weights[row], minlength=width)
            return np.bincount(row, weights=value * centre[col], minlength=m)

        def one(i: int, m=hi - lo) -> np.ndarray:
            return (np.arange(m) == i).astype(float)

        to_b = likeness(one(int(np.argmin(likeness(one(0))))))
        lean = likeness(one(int(np.argmin(to_b)))) - to_b
        first = lean > 0
        lean = likeness(first / max(1, first.sum())) - likeness(~first / max(1, (~first).sum()))
        order[lo:hi] = mine[np.argsort(-lean, kind="stable")]
        # whole leaves, and no half below an eighth, so the halving ends soon
        least = max(1, (hi - lo) // leaf // 8) * leaf
        half = min(max(least, round((lean > 0).sum() / leaf) * leaf), (hi - lo - 1) // leaf * leaf, max(leaf, (hi - lo - least) // leaf * leaf))
        open_ += [(lo, lo + half), (lo + half, hi)]
    return order


class Items:
    """A block's items in hierarchy order; ``holders`` are the items of each term, one term after the other."""

    def __init__(self, vectors: list[np.ndarray], weights: np.ndarray):
        starts = np.concatenate([[0], np.cumsum([len(v) for v in vectors])]).astype(np.int64)
        cols = np.concatenate([*vectors, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        self.order = clustered(starts, cols, weights[cols], len(weights), ITEM_LEAF)
        rows = np.repeat(np.arange(len(vectors)), [len(vectors[i]) for i in self.order])
        cols = np.concatenate([*(vectors[i] for i in self.order), np.zeros(0, dtype=np.int64)]).astype(np.int64)
        self.tree = Hierarchy(rows, cols, weights[cols], len(vectors), len(weights), ITEM_LEAF)
        self.weights = weights
        by_term = np.argsort(cols, kind="stable")
        self.holders, self.first = rows[by_term], np.searchsorted(cols[by_term], np.arange(len(weights) + 1))
        most = np.bincount(rows, weights=weights[cols], minlength=len(vectors)).max(initial=0)
        self.exact = most * 1e6 < _EXACT  # an impact is below 10**6

    def scores(self, row: np.ndarray, cols: np.ndarray, impacts: np.ndarray, n_rows: int, wanted: np.ndarray) -> np.ndarray:
        """Exact scores (n_rows, items) of documents given by (row, col, impact) for the items that ``wanted`` marks, 0 elsewhere."""
        many = self.first[cols + 1] - self.first[cols]
        at = np.arange(many.sum()) + np.repeat(self.first[cols] - (np.cumsum(many) - many), many)
        item = self.holders[at]
        keep = wanted[item]
        cell = (np.repeat(row, many) * self.tree.n_rows + item)[keep]
        added = np.repeat(impacts * self.weights[cols].astype(np.int64), many)[keep]
        shape = (n_rows, self.tree.n_rows)
        if self.exact:
            return np.bincount(cell, weights=added, minlength=shape[0] * shape[1]).astype(np.int64).reshape(shape)
        total = np.zeros(shape[0] * shape[1], dtype=np.int64)
        np.add.at(total, cell, added)
        return total.reshape(shape)


class Best:
    """The best documents of each item so far: by score, then by smaller id."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k = k
        self.floors = floors.copy()  # scores below cannot be among the best
        self.found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in floors]
        self.held = np.zeros(len(floors), dtype=np.int64)

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        self.found[item].append((scores, ids))
        self.held[item] += len(scores)
        if self.held[item] >= 4 * self.k:
            self.settle(item)

    def settle(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.found[item]:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        scores, ids = (np.concatenate(x) for x in zip(*self.found[item], strict=True))
        best = np.lexsort((ids, -scores))[: self.k]
        scores, ids = scores[best], ids[best]
        self.found[item], self.held[item] = [(scores, ids)], len(scores)
        if len(scores) == self.k:
            self.floors[item] = max(self.floors[item], scores[-1])
        return scores, ids


def search_batch(items: Items, best: Best, ids: np.ndarray, starts: np.ndarray, cols: np.ndarray, impacts: np.ndarray) -> int:
    """Search one batch of documents (row ``i`` has ``cols[starts[i]:starts[i + 1]]``); returns the pairs scored one by one."""
    width, n = len(items.weights), len(ids)
    rows = np.repeat(np.arange(n), np.diff(starts))
    order = clustered(starts, cols, impacts * items.weights[cols], width, DOC_LEAF)  # by what they can add to a score
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    docs = Hierarchy(place[rows], cols, impacts, n, width, DOC_LEAF)

    item_leaves = items.tree.levels[0][0]
    i_level, d_level = len(items.tree.levels) - 1, len(docs.levels) - 1
    i_nodes, d_nodes = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    while True:
        i_starts, i_max = items.tree.levels[i_level]
        i_used, i_at = np.unique(i_nodes, return_inverse=True)
        d_used, d_at = np.unique(d_nodes, return_inverse=True)
        bound = (i_max[i_used] @ docs.levels[d_level][1][d_used].T)[i_at, d_at]
        keep = bound >= np.maximum(np.minimum.reduceat(best.floors, i_starts), 1)[i_nodes]
        i_nodes, d_nodes, bound = i_nodes[keep], d_nodes[keep], bound[keep]
        if not len(i_nodes) or i_level == d_level == 0:
            break
        i_nodes, d_nodes = _children(i_nodes, d_nodes, i_level, d_level, items.tree, docs)
        i_level, d_level = max(0, i_level - 1), max(0, d_level - 1)

    # leaf pairs, the most promising documents first, so that the kth scores rise early
    leaf_best = np.full(-(-n // DOC_LEAF), -1.0)
    np.maximum.at(leaf_best, d_nodes, bound)
    by_leaf = np.argsort(d_nodes, kind="stable")
    first = np.searchsorted(d_nodes[by_leaf], np.arange(len(leaf_best) + 1))
    scored = 0
    for leaf in np.argsort(-leaf_best, kind="stable"):
        mine = by_leaf[first[leaf] : first[leaf + 1]]
        weakest = np.maximum(np.minimum.reduceat(best.floors, item_leaves), 1)
        nodes = i_nodes[mine][bound[mine] >= weakest[i_nodes[mine]]]
        if not len(nodes):
            continue
        wanted = np.zeros(items.tree.n_rows, dtype=bool)
        for x in nodes:
            wanted[item_leaves[x] : item_leaves[x] + ITEM_LEAF] = True
        members = order[leaf * DOC_LEAF : (leaf + 1) * DOC_LEAF]
        size = starts[members + 1] - starts[members]
        at = np.arange(size.sum()) + np.repeat(starts[members] - (np.cumsum(size) - size), size)
        scores = items.scores(np.repeat(np.arange(len(members)), size), cols[at], impacts[at], len(members), wanted)
        scored += len(members) * int(wanted.sum())
        good = (scores >= np.maximum(best.floors, 1)) & wanted
        for c in np.flatnonzero(good.any(axis=0)):
            best.add(c, scores[good[:, c], c], ids[members[good[:, c]]])
    return scored


def _children(i_nodes: np.ndarray, d_nodes: np.ndarray, i_level: int, d_level: int, items: Hierarchy, docs: Hierarchy) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the children of each pair; nodes of the lowest level stand for themselves."""

    def below(nodes: np.ndarray, level: int, tree: Hierarchy) -> tuple[np.ndarray, np.ndarray]:
        if level == 0:
            return nodes, np.ones(len(nodes), dtype=np.int64)
        return nodes * FAN, np.minimum(FAN, len(tree.levels[level - 1][0]) - nodes * FAN)

    i_first, i_n = below(i_nodes, i_level, items)
    d_first, d_n = below(d_nodes, d_level, docs)
    size = i_n * d_n
    pair = np.repeat(np.arange(len(size)), size)
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return i_first[pair] + nth // d_n[pair], d_first[pair] + nth % d_n[pair]


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, cols, counts) of the documents with a term: all terms counted in n, those of the vocabulary apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            ids, n, cols, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms(text)
                if words:
                    known = Counter(map(get, words))
                    known.pop(None, None)
                    ids.append(doc_id)
                    n.append(len(words))
                    cols.append(list(known))
                    counts.append(list(known.values()))
            out = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(cols, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n", "cols", "counts"])

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return thin.mapInArrow(run, "doc_id long, n long, cols array<int>, counts array<int>")


def _frequencies(vectors: DataFrame, width: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary; at most ``width`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=width)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["col", "df"])

    out = np.zeros(width, dtype=np.int64)
    for r in vectors.select("cols").mapInArrow(run, "col long, df long").groupBy("col").agg(F.sum("df").alias("df")).collect():
        out[r["col"]] = r["df"]
    return out


def _search(vectors: DataFrame, members: list[np.ndarray], weights: np.ndarray, n_docs: int, length: int, floors: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents of each item (place within the block) that reach its floor."""
    rows_at_once = int(max(DOC_LEAF, min(BATCH_ROWS, BATCH_BYTES // (8 * len(weights)) * DOC_LEAF)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(members, weights)
        best = Best(floors[items.order], k)

        def search(part: pa.Table) -> None:
            part = part.combine_chunks()
            ids = part["doc_id"].fill_null(_NO_ID).to_numpy()
            m = 50 + 50 * part["n"].to_numpy() * n_docs // length
            lists = part["cols"].combine_chunks()
            starts = lists.offsets.to_numpy().astype(np.int64)
            cols, counts = lists.flatten().to_numpy().astype(np.int64), part["counts"].combine_chunks().flatten().to_numpy().astype(np.int64)
            impacts = 1_000_000_000 * counts // (1000 * counts + 20 * np.repeat(m, np.diff(starts)))
            search_batch(items, best, ids, starts - starts[0], cols, impacts)

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = rows_at_once - sum(b.num_rows for b in waiting)
                waiting.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in waiting) == rows_at_once:
                    search(pa.Table.from_batches(waiting))
                    waiting = []
        if waiting:
            search(pa.Table.from_batches(waiting))
        for at, item in enumerate(items.order):
            scores, ids = best.settle(at)
            doc_id = pa.array(ids, pa.int64(), mask=ids == _NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item), pa.int64()), doc_id, pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return vectors.mapInArrow(run, "item long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each item with their rank; an item's rows meet in parts first."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(32))
    found = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).drop("part")


def _block_hits(docs: DataFrame, block: list[tuple[int, bytes | None]], k: int, id_col: str, text_col: str) -> DataFrame | None:
    """(row, rank, doc_id, score) of one block of items."""
    vocabulary: dict[bytes, int] = {}
    members = [np.unique([vocabulary.setdefault(t, len(vocabulary)) for t in terms(text)]).astype(np.int64) for _, text in block]
    if not vocabulary:
        return None
    vectors = Written(_vectors(docs, vocabulary, id_col, text_col), "search-vectors").df
    n_docs, length = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    df = _frequencies(vectors, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.float64)
    vectors = vectors.where(F.size("cols") > 0)
    floors = np.zeros(len(block), dtype=np.int64)
    shares = n_docs // PRIMER_ROWS
    if shares > 1:
        primer = vectors.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(shares)) == 0)
        for r in _ranked(_search(primer, members, weights, n_docs, length, floors, k), k).where(F.col("rank") == k).collect():
            floors[r["item"]] = r["score"]
    found = cut(_search(vectors, members, weights, n_docs, length, floors, k), "search-found")
    rows = found.sparkSession.createDataFrame([(i, row) for i, (row, _) in enumerate(block)], "of long, row long")
    return _ranked(found, k).join(rows, F.col("item") == F.col("of")).select("row", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of every item: item_id, rank, doc_id, score.

    Reads doc_id (an integer) and text of ``docs``, item_id and text of ``items``. A score sums weight times impact over
    the item's distinct terms; documents of score 0 are never listed, so an item without terms, with none that occurs or
    with a null text has no rows. Equal scores go by ascending id, null ids last; rows that repeat an id are documents,
    and items, of their own. Empty tables give an empty result; other columns are not read.
    """
    asked = items.select(F.monotonically_increasing_id().alias("row"), "item_id", F.col("text").cast("string").cast("binary").alias("text"))
    asked = Written(asked, "search-items").df
    words = F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    blocks = max(1, -(-(asked.agg(F.sum(words)).first()[0] or 0) // BLOCK_WORDS))
    hits = asked.sparkSession.createDataFrame([], "row long, rank int, doc_id long, score long")
    for b in range(blocks):  # a block of items at a time reaches the driver, whatever the size of the test set
        block = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "text").collect()
        found = _block_hits(docs, [(r["row"], r["text"] and bytes(r["text"])) for r in block], k, id_col, text_col)
        if found is not None:
            hits = hits.unionByName(found)
    return hits.join(asked.select("row", "item_id"), "row").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
