"""Substring dedup (op1) and order MinHash (op7)."""

import hashlib
import random

import brute
import numpy as np
from sitelake.llm import order_minhash, substring_dedup


def text_of(rng, n, tag):
    return [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]


def test_planted_passages_are_found(spark, docs):
    rng = random.Random(1)
    passage, other = text_of(rng, 70, "p"), text_of(rng, 60, "q")
    rows, spans = [], {}
    for i in range(40):
        body = text_of(rng, rng.randint(5, 200), f"d{i}x")
        if i % 4 == 0:
            at = rng.randint(0, len(body))
            copy = list(passage)
            if i % 8 == 0:  # fuzzy: three words changed, one lost
                for j in (20, 40, 55):
                    copy[j] = f"changed{i}{j}"
                del copy[30]
            body[at:at] = copy
            spans[i] = (at, at + len(copy))
        if i % 10 == 3:
            body += other
            spans.setdefault(i, None)
        rows.append((i, " ".join(body)))
    got = substring_dedup.repeated_passages(docs(rows)).collect()
    assert {r["doc_id"] for r in got} | {r["other_id"] for r in got} == set(spans)
    texts = dict(rows)
    for r in got:
        piece = texts[r["doc_id"]][r["start_char"] : r["end_char"]]
        assert brute.words(piece) == brute.words(texts[r["doc_id"]])[r["start_word"] : r["end_word"]]
        assert r["n_words"] >= 50 and r["identity"] >= 0.8
        if spans[r["doc_id"]] and r["doc_id"] % 10 != 3:
            a, b = spans[r["doc_id"]]
            assert abs(r["start_word"] - a) <= 1 and abs(r["end_word"] - b) <= 1


def test_passage_cases(spark, docs):
    rng = random.Random(2)
    long = " ".join(text_of(rng, 60, "L"))
    rows = [(1, long), (2, long.upper()), (2, long.upper()), (3, None), (4, ""), (5, "short text"), (None, long), (6, " ".join(text_of(rng, 400, "n"))),
            (7, "of " * 90), (8, "of " * 70), (9, long + " " + long)]
    got = substring_dedup.repeated_passages(docs(rows)).collect()
    pairs = {frozenset((r["doc_id"], r["other_id"])) for r in got}
    seen = {i for p in pairs for i in p}
    assert seen == {1, 2, None, 7, 8, 9}
    assert substring_dedup.repeated_passages(docs(rows).limit(0)).collect() == []


def test_every_holder_of_a_passage_is_a_doc_id(spark, docs):
    """Whichever of two texts is moved to the other, both have rows, with their own places."""
    rng = random.Random(8)
    passage = text_of(rng, 60, "p")
    rows = [(i, " ".join(text_of(rng, 10 * i, f"a{i}x") + passage + text_of(rng, 20, f"b{i}x"))) for i in range(12)]
    got = substring_dedup.repeated_passages(docs(rows), either=True).collect()
    assert {r["doc_id"] for r in got} == set(range(12))
    texts, pairs = dict(rows), {(r["doc_id"], r["other_id"]) for r in got}
    assert pairs == {(b, a) for a, b in pairs}
    for r in got:
        assert (r["start_word"], r["end_word"], r["other_start_word"]) == (10 * r["doc_id"], 10 * r["doc_id"] + 60, 10 * r["other_id"])
        assert texts[r["doc_id"]][r["start_char"] : r["end_char"]] == " ".join(passage)


def test_long_stretches_meet_among_many_short_ones(spark, docs):
    rng = random.Random(9)
    rows = [(i, " ".join(["he"] * (70 if i in (11, 37) else 20) + text_of(rng, 60, f"d{i}x"))) for i in range(48)]
    got = substring_dedup.repeated_passages(docs(rows)).collect()
    assert {frozenset((r["doc_id"], r["other_id"])) for r in got} == {frozenset((11, 37))}


def test_chain_takes_the_best_collinear_set():
    """The Fenwick chain scores as well as a quadratic search."""
    rng = random.Random(4)
    for _ in range(200):
        segs = sorted((rng.randrange(300), rng.randrange(300), rng.randint(6, 30)) for _ in range(rng.randint(1, 25)))
        score = [0.0] * len(segs)
        for i, (a, b, n) in enumerate(segs):
            best = max(
                (score[j] - substring_dedup.GAP_COST * (a - aj - nj + b - bj - nj) for j, (aj, bj, nj) in enumerate(segs[:i]) if aj + nj <= a and bj + nj <= b),
                default=0.0,
            )
            score[i] = n + max(0.0, best)
        chain = substring_dedup.best_chain(segs)
        total = 0.0
        for k, i in enumerate(chain):
            a, b, n = segs[i]
            if k:
                aj, bj, nj = segs[chain[k - 1]]
                assert aj + nj <= a and bj + nj <= b
                total -= substring_dedup.GAP_COST * (a - aj - nj + b - bj - nj)
            total += n
        assert abs(total - max(score)) < 1e-9


def test_edit_distance():
    assert substring_dedup.edit_distance([b"a", b"b", b"c"], [b"a", b"c"]) == 1
    assert substring_dedup.edit_distance([], [b"a"]) == 1 and substring_dedup.edit_distance([b"a"], [b"b"]) == 1


# ---- order MinHash -------------------------------------------------------------------------------------------


def plain_signature(text, method):
    """Straight reading of the definition: rank occurrence-numbered k-mers for each turn of the hash circle."""
    k = min(method.k, len(text))
    if not text:
        return [0] * method.slots
    mul, m64 = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def mix(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & m64
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & m64
        return x ^ x >> 31

    mers = []
    for i in range(len(text) - k + 1):
        h = k
        for c in text[i : i + k]:
            h = (h * mul & m64) ^ ord(c)
        mers.append(mix(h))
    n = len(mers)
    low = (1 << n.bit_length()) - 1
    seen, ranked = {}, []
    for i, h in enumerate(mers):
        occurrence = seen[h] = seen.get(h, -1) + 1
        ranked.append(((mix((h + occurrence * mul + 1) & m64) & ~low) | i, i))
    out = []
    for s in range(method.slots):
        start = s * ((1 << 64) // method.slots)
        order = sorted(ranked, key=lambda r: (r[0] - start) % (1 << 64))
        picked = sorted(order[j % n][1] for j in range(method.pick))
        h = method.pick
        for i in picked:
            h = mix((h * mul & m64) ^ mers[i])
        out.append(h >> 32)
    return out


def test_signature_matches_the_definition():
    method = order_minhash.OrderMinHash(k=3, pick=2, slots=8)
    rng = random.Random(0)
    for text in ["", "a", "ab", "abc", "abcd", "aaaaaaaaaa", "é日本語 text", *["".join(rng.choice("abc ") for _ in range(rng.randint(1, 60))) for _ in range(40)]]:
        assert method.signature(text).tolist() == plain_signature(text, method), text


def test_order_matters():
    method = order_minhash.OrderMinHash()
    rng = random.Random(0)
    blocks = ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(6)]
    a, b = "".join(blocks), "".join(blocks[::-1])
    assert order_minhash.likeness(method.signature(a), method.signature(a)) == 1.0
    assert order_minhash.likeness(method.signature(a), method.signature(b)) < 0.75  # the same k-mers in another order


def expected(rows):
    """Edited text of each row by its successor in descending id order."""
    order = sorted(rows, key=lambda r: ((r[0] is not None, r[0] if r[0] is not None else 0), r[1] or ""), reverse=True)
    out = []
    for i, (doc, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text) // 3
        out.append((doc, text, text[: len(text) - n] + following[:n], following))
    return out


def check(spark, rows, df):
    got = sorted(map(tuple, order_minhash.fingerprints(df).collect()), key=str)
    method, want = order_minhash.OrderMinHash(), []
    for doc, text, edited, following in expected(rows):
        s, e, f = (method.signature(t) for t in (text, edited, following))
        sha = hashlib.sha256(edited.encode()).hexdigest()
        want.append((doc, len(text), sha, order_minhash.to_text(s), order_minhash.to_text(e), float(np.mean(s == e)), float(np.mean(s == f))))
    assert got == sorted(want, key=str)


def test_fingerprints_match_brute_force(spark, real):
    rows, df = real
    check(spark, rows, df.repartition(5))


def test_fingerprint_cases(spark, docs):
    rows = [(3, "éé日本語 abc"), (1, None), (7, "x" * 50_000), (7, "another"), (2, ""), (None, "no id"), (None, "none"), (9, "ab"), (9, "ab")]
    check(spark, rows, docs(rows))
    check(spark, rows[:1], docs(rows[:1]))
    assert order_minhash.fingerprints(docs(rows).limit(0)).collect() == []


# ---- recall of edited passages -------------------------------------------------------------------------------


def edited(rng, words, errors, tag):
    """The words with so many of them changed, at random places."""
    out = list(words)
    for at in rng.sample(range(len(out)), errors):
        out[at] = f"{tag}{rng.randrange(10**9)}"
    return out


def linked(rows):
    return {frozenset((r["doc_id"], r["other_id"])) for r in rows}


def test_edited_pairs_are_found(spark, docs):
    """Pairs of texts with a passage of 60 or 100 words, edited down to identity 0.8; ends are words that agree, so the passage is as long as planted."""
    rng = random.Random(11)
    rows, pairs = [], {}
    for size in (60, 100):
        for identity in (0.95, 0.92, 0.9, 0.88, 0.85, 0.83, 0.8):
            for _ in range(40):
                passage = text_of(rng, size, "p")
                errors = int(size * (1 - identity) + 1e-9)
                other = [*passage[:4], *edited(rng, passage[4:-4], errors, "c"), *passage[-4:]]
                i = len(rows)
                rows += [(i, " ".join(text_of(rng, 30, "x") + passage + text_of(rng, 30, "x"))), (i + 1, " ".join(text_of(rng, 90, "y") + other))]
                pairs.setdefault((size, identity), set()).add(frozenset((i, i + 1)))
    got = linked(substring_dedup.repeated_passages(docs(rows)).select("doc_id", "other_id").collect())
    found = {k: len(v & got) / len(v) for k, v in pairs.items()}
    print("recall", found)
    assert not got - set().union(*pairs.values())
    assert all(v == 1.0 for v in found.values()), found


def test_groups_of_edited_copies_are_found(spark, docs):
    """Each copy of a passage edited by itself: every document is reported, in one of the columns."""
    rng = random.Random(12)
    rows, groups = [], {}
    for share in (0.04, 0.06, 0.08):
        for size in (30, 30, 30, 300):
            passage = text_of(rng, 60, "g")
            for _ in range(size):
                groups.setdefault(share, set()).add(len(rows))
                copy = [w if rng.random() >= share or not 4 <= k < 56 else f"c{rng.randrange(10**9)}" for k, w in enumerate(passage)]
                rows.append((len(rows), " ".join(text_of(rng, 20, "x") + copy + text_of(rng, 20, "x"))))
    got = substring_dedup.repeated_passages(docs(rows)).select("doc_id", "other_id").collect()
    seen = {i for r in got for i in r}
    lost = {share: len(ids - seen) / len(ids) for share, ids in groups.items()}
    print("lost", lost)
    assert not any(lost.values()), lost


def test_a_short_phrase_does_not_hide_a_passage():
    """A shared phrase that outscores an edited passage and lies out of order with it."""
    pos, other = [*range(10), 200, 222], [*range(1000, 1010), 300, 322]
    spans = [(c[0][0], c[-1][0] + c[-1][2]) for c in substring_dedup.chains(np.array(pos), np.array(other))]
    assert any(a == 200 and b > 222 for a, b in spans), spans


def test_one_text_stands_for_its_copies(spark, docs):
    rng = random.Random(8)
    passage = text_of(rng, 70, "p")
    whole = " ".join(text_of(rng, 40, "a") + passage)
    rows = [(i, whole) for i in range(40)] + [(100, " ".join(text_of(rng, 30, "z") + passage)), (101, "short copy"), (102, "short copy")]
    got = substring_dedup.repeated_passages(docs(rows)).collect()
    ids = {r["doc_id"] for r in got if r["identity"] == 1.0 and r["n_words"] == 110 and r["start_word"] == r["other_start_word"] == 0}
    stands = {r["other_id"] for r in got if r["n_words"] == 110}
    assert len(ids) == 39 and len(stands) == 1 and ids | stands == set(range(40))
    rest = [r for r in got if r["n_words"] != 110]
    assert len(rest) == 1 and {rest[0]["doc_id"], rest[0]["other_id"]} == stands | {100} and rest[0]["n_words"] >= 70


def test_stretches_that_go_in_circles_are_one_passage(spark, docs):
    rng = random.Random(9)
    rows = [(i, " ".join(text_of(rng, 30, f"x{i}") + ["tick", "tock"] * (150 + 7 * i) + text_of(rng, 30, f"y{i}"))) for i in range(5)]
    got = substring_dedup.repeated_passages(docs(rows)).collect()
    pairs = {(r["doc_id"], r["other_id"]) for r in got}
    assert len({frozenset(p) for p in pairs}) == 10 and len(got) <= 2 * len(pairs)
    assert all(r["n_words"] >= 290 for r in got if (r["doc_id"], r["other_id"]) in pairs and r["start_word"] <= 31)


def test_packed_columns_come_back():
    rng = np.random.default_rng(3)
    for kind in ("u4", "i8"):
        for n in (0, 1, 1000):
            column = rng.integers(0, 2**32, n).astype(kind)
            raw = b"x" * 8 + substring_dedup.packed(column) + b"rest"
            assert substring_dedup.unpacked(raw, kind, n, 8).tolist() == column.tolist()
