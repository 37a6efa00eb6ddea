"""Positional index and benchmark decontamination (op11)."""

import hashlib
import os
import random
import re

import duckdb
import pytest
from conftest import SF
from sitelake.llm import contamination as ct
from sitelake.llm import queries
from sitelake.llm.shared import shared_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, term long, class string, anchor int, row long, words string, start int"


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(queries.UPPER, queries.LOWER)))


def brute(rows, items, window=10):
    out = []
    for doc_id, text in rows:
        have, hit, found = words(text), set(), set()
        for item, body in items:
            w = words(body)
            k = min(window, len(w))
            grams = {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} if w else set()
            for s in range(len(have) - k + 1 if grams else 0):
                if tuple(have[s : s + k]) in grams:
                    hit.update(range(s, s + k))
                    found.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(have), len(hit), len(found), digest, bool(hit)))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def check(spark, docs, rows, items, **options):
    got = ct.contamination_report(docs(rows), frame(spark, items), **options)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, items, options.get("window", 10)), key=key)


def frame(spark, items):
    return spark.createDataFrame([(*i, 1, "c", 2, 3, "w", 4) for i in items], ITEMS)


@pytest.mark.parametrize("seed", [1, 2])
def test_report_equals_brute_force(spark, docs, monkeypatch, seed):
    """Few words, so windows overlap, repeat and meet at every offset; lookups go in many blocks."""
    monkeypatch.setattr(ct, "LOOKUP_ROWS", 7)
    rng = random.Random(seed)
    vocab = ["the", "of", "Cat", "dog", "é", "日本", "x1", "run"]
    items = [(rng.choice([i, i % 5, None]), " ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 5, 9, 10, 11, 14])))) for i in range(25)]
    items += [(90, None), (91, "same words " * 6), (92, "same words " * 6), (93, "Same-words; " * 6), (94, "absent " * 12)]
    rows = []
    for i in range(40):
        text = rng.choices(vocab, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            w = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(w) - 10))
            at = rng.randint(0, len(text))
            text[at:at] = w[a : a + rng.randint(8, 14)]
        rows.append((rng.choice([i, 3, None]), rng.choice([" ", ", ", "\n"]).join(text)))
    rows += [(1, None), (2, ""), (2, "same words " * 5), (2, "same words " * 5), (2, "same words " * 4 + "same")]
    check(spark, docs, rows, items)


def test_other_windows(spark, docs):
    rows = [(1, "a b c d e f"), (2, "b c x c d"), (3, "f e d c b a")]
    check(spark, docs, rows, [(1, "a b c d"), (2, "c d e"), (3, "q")], window=2)


def test_long_text_and_a_passage_that_many_share(spark, docs):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"start {passage} end{i}") for i in range(300)] + [(1000, "the " * 60_000 + passage + " the" * 60_000), (1001, passage[:-2])]
    check(spark, docs, rows, [(1, passage), (2, "the the " + passage), (3, "the " * 10)])


def test_empty_tables(spark, docs):
    some = [(1, "a b c"), (2, "a")]
    check(spark, docs, some, [])
    empty = docs(some).limit(0)
    assert ct.contamination_report(empty, frame(spark, [(1, "a b c")])).collect() == []


def test_index_is_kept_and_opened_again(spark, docs):
    path = shared_path(spark, "positional-index")
    ct.PositionalIndex.build(docs([(1, "one two three"), (2, "three two one")]), path)
    index = ct.PositionalIndex.open(spark, path)
    rows = [(1, "one two three"), (2, "three two one")]
    check(spark, docs, rows, [(5, "two three")], index=index)
    places = {(r["row"], r["pos"], r["term"]) for r in index.postings.collect()}
    assert len(places) == 6 and sorted(p[1] for p in places) == [0, 0, 1, 1, 2, 2]


def test_whole_phrases(spark, docs):
    rows = [(1, "a rose is a rose is a rose"), (2, "is a rose a"), (3, "rose")]
    index = ct.PositionalIndex.build(docs(rows))
    classes, _ = ct.item_classes(frame(spark, [(1, "a rose is a rose"), (2, "rose")]))
    sizes = {r["class"]: len(r["terms"]) for r in classes.collect()}
    ids = {r["row"]: r["doc_id"] for r in index.docs.collect()}
    got = sorted((ids[r["row"]], sizes[r["class"]], r["start"]) for r in ct.phrase_hits(index, classes, None).collect())
    assert got == [(1, 1, 1), (1, 1, 4), (1, 1, 7), (1, 5, 0), (1, 5, 3), (2, 1, 2), (3, 1, 0)]


def test_proximity(spark, docs):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["a", "b", "c", "d", "e", "f"], k=40))) for i in range(20)] + [(90, None), (91, "a " * 500 + "b c"), (92, "c a b")]
    items = [(1, "a b c"), (2, "f"), (3, "d e d"), (4, "a zzz")]
    index = ct.PositionalIndex.build(docs(rows))
    classes, _ = ct.item_classes(frame(spark, items))
    terms = {r["class"]: set(r["terms"]) for r in classes.collect()}
    hashed = {r["row"]: (r["doc_id"], r["terms"]) for r in index.docs.collect()}
    for within in (1, 3, 6):
        want = set()
        for c, need in terms.items():
            for row, (_, have) in hashed.items():
                want |= {(row, c, s) for s in range(len(have)) if have[s] in need and need <= set(have[s : s + within])}
        got = [tuple(r) for r in ct.proximity_hits(index, classes, within).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_native_plan(spark, docs):
    index = ct.PositionalIndex.build(docs([(1, "a b c")]))
    classes, _ = ct.item_classes(frame(spark, [(1, "a b")]))
    for out in (ct.contamination_report(docs([(1, "a b c")]), frame(spark, [(1, "a b")])), ct.proximity_hits(index, classes, 2), index.postings):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
def test_report_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(queries.ORACLE_SQL["op11_decontamination"])
    got = queries.op11_decontamination(spark, SF)
    rows = sorted(tuple(r[c] for c in rel.columns) for r in got.collect())
    assert rows == sorted(rel.fetchall()) and any(r[-1] for r in rows)
