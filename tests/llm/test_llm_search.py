"""Dual-tree ranked search (op13)."""

import collections
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest
from conftest import SF
from sitelake.llm import queries
from sitelake.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, rank int, score long, row long, item long, doc_id long"


def terms(text):
    return [t.translate(str.maketrans(queries.UPPER, queries.LOWER)) for t in TERM.findall(text or "")]


def brute(rows, items, k=50):
    docs = [(i, collections.Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, length = len(docs), sum(x[2] for x in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, size in docs:
            m = 50 + (50 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k], 1)]
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def frame(spark, items):
    return spark.createDataFrame([(*i, 1, 2, 3, 4, 5) for i in items], ITEMS)


def check(spark, docs, rows, items, k=50):
    got = [tuple(r) for r in rs.search(docs(rows), frame(spark, items), k).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, items, k), key=key)
    return got


def corpus(seed, n):
    rng = random.Random(seed)
    topics = [[f"{a}{i}" for i in range(60)] + ["The", "of", "é", "x-y"] for a in "abcd"]
    def text(size):
        words = rng.choice(topics)
        return " ".join(words[min(int(rng.expovariate(0.08)), len(words) - 1)] for _ in range(size))
    rows = [(rng.choice([i, i, i // 2, None]), rng.choice([None, ""]) if rng.random() < 0.05 else text(rng.randint(1, 80))) for i in range(n)]
    return rows, [(rng.choice([i, i, 1, None]), text(rng.randint(0, 25))) for i in range(30)]


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_brute_force(spark, docs, monkeypatch, seed):
    """Small trees, batches, blocks and primers: many levels, floors from a share of the rows, items in several blocks."""
    for name, value in (("ITEM_LEAF", 2), ("DOC_LEAF", 3), ("FAN", 2), ("BATCH_ROWS", 40), ("PRIMER_ROWS", 60), ("BLOCK_WORDS", 90)):
        monkeypatch.setattr(rs, name, value)
    rows, items = corpus(seed, 300)
    rows += [(9, rows[5][1])] * 20 + [(500, "a1 " * 50_000 + "b2")]
    check(spark, docs, rows, items, k=7)


def test_production_parameters_and_ties(spark, docs):
    rows, items = corpus(3, 200)
    rows += [(1000 - i, "same text here") for i in range(120)]
    got = check(spark, docs, rows, [*items, (77, "Same, TEXT"), (78, None), (79, ""), (80, "absent words"), (81, "...")])
    assert [r[2] for r in sorted(got, key=key) if r[0] == 77] == list(range(881, 931))


def test_empty_tables(spark, docs):
    rows, items = [(1, "a b"), (2, None)], [(1, "a")]
    check(spark, docs, rows, [(1, None)])
    assert rs.search(docs(rows).limit(0), frame(spark, items)).collect() == []
    assert rs.search(docs(rows), frame(spark, items).limit(0)).collect() == []
    check(spark, docs, rows, items)


def batch(rng, n, width, topics=8):
    """Documents and items of separate topics, as whole numbers."""
    span = width // topics
    docs = [np.unique(rng.integers(0, span, 12)) + span * rng.integers(topics) for _ in range(n)]
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    cols = np.concatenate(docs)
    return starts, cols, rng.integers(1, 1_000_000, len(cols))


def test_trees_prune_and_stay_exact():
    rng = np.random.default_rng(0)
    width, n = 400, 4000
    starts, cols, impacts = batch(rng, n, width)
    members = [np.unique(rng.integers(0, 50, 10)) + 50 * (i % 8) for i in range(100)]
    weights = rng.integers(0, 25_000, width).astype(float)
    items = rs.Items(members, weights)
    best = rs.Best(np.zeros(100, dtype=np.int64), 10)
    scored = sum(rs.search_batch(items, best, np.arange(a, a + 1000), starts[a : a + 1001] - starts[a], cols[starts[a] : starts[a + 1000]], impacts[starts[a] : starts[a + 1000]]) for a in range(0, n, 1000))
    full = np.zeros((n, width), dtype=np.int64)
    full[np.repeat(np.arange(n), np.diff(starts)), cols] = impacts
    for at, item in enumerate(items.order):
        scores = full[:, members[item]] @ weights[members[item]].astype(np.int64)
        want = np.lexsort((np.arange(n), -scores))[:10]
        got = best.settle(at)
        assert got[1].tolist() == want.tolist() and got[0].tolist() == scores[want].tolist()
    assert scored < 0.5 * n * 100  # whole batches of pairs were dropped by their bounds


def test_sums_beyond_exact_doubles(monkeypatch):
    rng = np.random.default_rng(1)
    starts, cols, impacts = batch(rng, 50, 40, topics=2)
    weights = rng.integers(1, 25_000, 40).astype(float)
    monkeypatch.setattr(rs, "_EXACT", 1.0)
    items = rs.Items([np.arange(20), np.arange(10, 40)], weights)
    best = rs.Best(np.zeros(2, dtype=np.int64), 5)
    rs.search_batch(items, best, np.arange(50), starts, cols, impacts)
    assert not items.exact and len(best.settle(0)[0]) == 5


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
def test_search_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(queries.ORACLE_SQL["op13_ranked_search"])
    got = queries.op13_ranked_search(spark, SF)
    assert sorted(tuple(r[c] for c in rel.columns) for r in got.collect()) == sorted(rel.fetchall())
