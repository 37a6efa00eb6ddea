"""Exact dedup (op4) and the n-gram Jaccard join (op8)."""

import hashlib
import random

import brute
import numpy as np
from conftest import SF  # noqa: F401
from sitelake.llm import components, exact_dedup, jaccard_join
from sitelake.llm.shared import WordHasher, shared_path


def report(spark, df, path=None):
    index = exact_dedup.DigestIndex(spark, path or shared_path(spark, "digest-index"), buckets=4)
    return exact_dedup.dedup_report(df, index)


def test_exact_dedup_cases(spark, docs):
    rows = [(1, "Aa"), (5, "aA"), (3, "b"), (None, "aa"), (7, None), (8, ""), (9, "É"), (10, "é"), (3, "b"), (None, "c"), (None, "c"), (11, "x" * 200_000)]
    got = report(spark, docs(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    aa = by[hashlib.sha256(b"aa").hexdigest()]
    assert {r["keep_id"] for r in aa} == {5} and {r["group_size"] for r in aa} == {3}
    assert [r["doc_id"] for r in aa if r["kept"]] == [5]
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert [r["doc_id"] for r in empty if r["kept"]] == [8]
    assert len(by[hashlib.sha256("É".encode()).hexdigest()]) == 1  # only A-Z are folded
    assert all(sum(r["kept"] for r in group) == 1 for group in by.values())  # also where rows or null ids repeat


def test_exact_dedup_empty(spark, docs):
    assert report(spark, docs([(1, "a")]).limit(0)).collect() == []


def test_index_goes_on_in_later_batches(spark, docs):
    path = shared_path(spark, "digest-index")
    assert [r["kept"] for r in report(spark, docs([(1, "a"), (2, "b")]), path).collect()] == [True, True]
    later = {r["doc_id"]: r for r in report(spark, docs([(8, "A"), (9, "c")]), path).collect()}
    assert not later[8]["kept"] and later[8]["keep_id"] == 1 and later[9]["kept"]
    index = exact_dedup.DigestIndex(spark, path)  # reopened: bucket count from its folder
    assert index.buckets == 4 and index.entries().count() == 3


def test_index_anti_join_is_sort_merge_without_moving_the_index(spark, docs):
    index = exact_dedup.DigestIndex(spark, shared_path(spark, "digest-index"), buckets=4)
    exact_dedup.dedup_report(docs([(1, "a")]), index)
    batch = exact_dedup.group_digests(exact_dedup.text_digests(docs([(2, "b")])))
    plan = batch.select("digest").repartition(4, "digest").join(index.entries().select("digest").hint("merge"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Bucketed: true" in text


def test_drop_copies_keeps_all_columns(spark, docs):
    df = docs([(1, "Aa"), (5, "aA"), (None, "z"), (6, None), (4, ""), (6, None)])
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 5), (False, 6), (True, 0)]


def test_exact_dedup_matches_brute_force(spark, real):
    rows, df = real
    groups = brute.exact_groups(rows)
    want = {(i, max(ids), len(ids), i == max(ids), h) for h, ids in groups.items() for i in ids}
    assert {tuple(r) for r in report(spark, df).collect()} == want


# ---- Jaccard join --------------------------------------------------------------------------------------------


def near_rows(seed=3, groups=30):
    """Groups of near copies around the threshold, chains of links, short texts and repeats."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 12, 40, 90, 160]))]
        for _ in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 40))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                text = text + text
            rows.append((len(rows), " ".join(text).upper() if rng.random() < 0.2 else "\t ".join(text)))
            base = text if rng.random() < 0.3 else base
    return rows


def test_jaccard_components_match_brute_force(spark, docs):
    rows = near_rows()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_components(docs(rows)).collect()}
    assert got == brute.jaccard_components(rows)


def test_jaccard_real_rows(spark, real):
    rows, df = real
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_components(df).collect()}
    assert got == brute.jaccard_components(rows)


def test_jaccard_cases(spark, docs):
    rows = [(4, "a b c"), (2, "A  B\tC"), (3, None), (5, ""), (6, " \n"), (None, "a b c"), (2, "A B C"), (7, "a b c d"), (8, "word " * 30_000)]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in jaccard_join.near_components(docs(rows)).collect())
    assert got == [
        ((False, 2), 1, 2), ((False, 2), 1, 2), ((False, 3), 0, 3), ((False, 4), 1, 2), ((False, 5), 0, 5), ((False, 6), 0, 6),
        ((False, 7), 1, 7), ((False, 8), 1, 8), ((True, 0), 1, None),
    ]
    assert jaccard_join.near_components(docs(rows).limit(0)).collect() == []
    kept = jaccard_join.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 2, 3, 5, 6, 7, 8]


def test_jaccard_large_bucket_in_tiles(spark, docs, monkeypatch):
    """Buckets above the tile size are cut; links between chunks are found all the same."""
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", 8)
    monkeypatch.setattr(jaccard_join, "STAR_ROWS", 3)
    rng = random.Random(5)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(60)] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(text)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_components(docs(rows)).collect()}
    assert got == brute.jaccard_components(rows)


def test_signature_tree_drops_no_link():
    """Every linked pair of different components is among the pairs that the tree leaves."""
    rng = np.random.default_rng(0)
    base = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (5, 40, 300)]
    sets = []
    for b in base:
        for _ in range(20):
            keep = b[rng.random(len(b)) > 0.1 * rng.random()]
            sets.append(np.unique(np.append(keep, rng.integers(0, 1 << 63, rng.integers(0, 3), dtype=np.uint64))))
    comps = np.arange(len(sets))
    left = {(min(i, j), max(i, j)) for x, y in jaccard_join.SignatureTree(sets, comps).pairs() for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if jaccard_join.linked(sets[i], sets[j])}
    assert want and want <= left and len(left) < len(sets) * (len(sets) - 1) // 2


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7), *[(100, 100 + i) for i in range(1, 50)]]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 6)}, 8: 8, 9: 8, **{100 + i: 100 for i in range(50)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_word_hashes_follow_the_words():
    tool = WordHasher()
    a, start, end = tool.words("Ab  cd\x0bAB é x".encode())
    assert len(a) == 4 and a[0] == a[2] and len(set(a.tolist())) == 3
    assert [int(e - s) for s, e in zip(start, end, strict=True)] == [2, 2, 2, 5]
    assert len(tool.words(b"")[0]) == 0
