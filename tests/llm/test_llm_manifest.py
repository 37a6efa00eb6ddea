"""Merkle manifest (op12)."""

import collections
import hashlib
import os
import random
import zlib

import duckdb
import pytest
from conftest import SF
from sitelake.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree long, idx long, n int, block int, path string, changed string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    doc_id, _, lang, source, n = row
    return h("".join(enc(x) for x in (doc_id, source, lang, n, text)))


def low(text):
    return None if text is None else text.encode().lower().decode()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path_of(levels, i):
    out = []
    for level in levels[:-1]:
        s = i // 8 * 8
        out.append(("".join(level[s:i]), "".join(level[i + 1 : s + 8])))
        i //= 8
    return out


def brute(rows):
    trees = collections.defaultdict(list)
    for r in rows:
        trees[r[2]].append((r, leaf(r, r[1])))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for t in names:
        trees[t].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    built = {t: levels_of([d for _, d in trees[t]]) for t in names}
    top = levels_of([built[t][-1][0] for t in names])
    out = []
    for at, t in enumerate(names):
        for i, (r, d) in enumerate(trees[t]):
            path = path_of(built[t], i) + path_of(top, at)
            cur = leaf(r, low(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else d
            for a, b in path:
                cur = h(a + cur + b)
            out.append((r[0], d, built[t][-1][0], top[-1][0], h("".join(a + b for a, b in path)), cur, cur == top[-1][0]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, "p", "c") for r in rows], SCHEMA)


def key(row):
    return tuple((x is not None, x) for x in row)


def check(spark, rows):
    got = [tuple(r) for r in merkle.tamper_report(frame(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_report_equals_brute_force(spark):
    """Languages of 1, 8, 9, 513 and 1,100 rows, repeated and null ids, null and empty fields, equal rows."""
    rng = random.Random(3)
    rows = []
    for lang, n in (("en", 1100), ("de", 513), (None, 9), ("", 8), ("zz", 1), ("é", 2)):
        for i in range(n):
            rows.append((rng.choice([i, i, 10 * i, None]), rng.choice([None, "", "Text %d" % i, "low"]), lang, rng.choice(["s", None, ""]), rng.choice([None, i])))
    rows += [(5, "Same", "en", "s", 4)] * 30 + [(7, "A" * 300_000, "en", "s", 1)]
    rng.shuffle(rows)
    check(spark, rows)


def test_small_and_empty_tables(spark):
    assert merkle.tamper_report(frame(spark, [])).collect() == []
    check(spark, [(1, "A", "en", "s", 1)])
    check(spark, [(1, "A", "en", "s", 1), (2, "B", None, None, None)])
    check(spark, [(i, "T", f"l{i}", "s", i) for i in range(70)])  # more languages than a run holds


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 512, 513, 520])
def test_sizes_at_the_block_edges(spark, n):
    check(spark, [(i, "Abc", "en", "s", 3) for i in range(n)])


def test_versions_share_all_but_their_own_path(spark):
    rows = [(i, f"Doc {i}", "en" if i % 3 else "de", "s", i) for i in range(1500)]
    df = frame(spark, rows)
    c = {x: df[x] for x in ("doc_id", "source", "lang", "n_chars", "text")}
    from pyspark.sql import functions as F

    keyed = df.select(c["lang"].alias("tree_key"), merkle.leaf_digest(*c.values()).alias("digest"), F.when(F.col("doc_id") == 700, F.lit(h("new"))).alias("changed"), "doc_id")
    m = merkle.build(keyed, ["doc_id"])
    nodes = {(r["tree"], r["level"], r["idx"]): r["digest"] for r in m.nodes.collect()}
    version = next(r for r in m.versions(["doc_id"]).collect() if r["doc_id"] == 700)
    sizes = {t: collections.Counter(k[1] for k in nodes if k[0] == t) for t in (merkle.TOP, 0, 1)}
    assert sizes[1] == {0: 1000, 1: 125, 2: 16, 3: 2, 4: 1} and sizes[merkle.TOP] == {0: 2, 1: 1}
    assert version["changed"] and len(version["copies"]) == 4 + 1 and version["copies"][-1] == version["folded_root"] != m.root
    # the version's nodes: its copies on the path, the tree's own nodes elsewhere, add up to the version's root
    own = {(version["tree"], 0, version["idx"]): h("new")}
    own |= {(version["tree"], k, version["idx"] // 8**k): version["copies"][k - 1] for k in range(1, 5)}
    view = {**nodes, **own}
    for k in range(4):
        at = version["idx"] // 8 ** (k + 1)
        run = [view[version["tree"], k, i] for i in range(at * 8, at * 8 + 8) if (version["tree"], k, i) in view]
        assert h("".join(run)) == view[version["tree"], k + 1, at]
    assert h(nodes[merkle.TOP, 0, 0] + version["copies"][3]) == version["folded_root"]
    same = [r for r in m.versions(["doc_id"]).collect() if r["doc_id"] != 700]
    assert all(r["folded_root"] == m.root and not r["changed"] for r in same)


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
def test_report_matches_sql(spark, real):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = con.sql(queries.ORACLE_SQL["op12_merkle"])
    got = queries.op12_merkle(spark, SF)
    assert sorted(tuple(r[c] for c in rel.columns) for r in got.collect()) == sorted(rel.fetchall())
