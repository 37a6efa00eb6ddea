"""BPE (op5), toxicity (op6), attention language model (op10) and the pipeline."""

import collections
import hashlib
import math
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from sitelake.llm import attention_lm as lm
from sitelake.llm import bpe, toxicity
from sitelake.llm.queries import tokenizer_path
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.BpeCodec(bpe.BpeTables(bpe.tokenizer_source(PATH)))


LIBRARY = Tokenizer.from_file(PATH)


def same(codec, texts):
    for mine, theirs in zip(codec.encode(texts), LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine.tolist() == theirs.ids
        assert codec.decode(mine) == LIBRARY.decode(theirs.ids, skip_special_tokens=False)


def test_tables_travel_as_plain_data(codec):
    """What tasks get needs neither the tokenizer file nor this package, and encodes alike."""
    import pickle
    import pickletools

    sent = pickle.dumps(vars(codec.tables), 2)
    assert not any("sitelake" in str(arg) for _, arg, _ in pickletools.genops(sent) if isinstance(arg, str))
    same(bpe.BpeCodec(bpe.BpeTables.of(pickle.loads(sent))), ["Hello  world's<|endoftext|> x", "a" * 300, ""])


def test_bpe_cases(codec):
    same(codec, ["", " ", "a" * 3000, "aaa  \n\n  b<|endoftext|> x<|endoftext|><|endoftext|> ", "日本語　x\x85y\x1cz​", "I'll we've 'S 12 ½ ١٢", "\x00 a b"])


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=5))
def test_bpe_any_text(codec, texts):
    same(codec, texts)


def test_bpe_lossy_decode(codec):
    ids = [i for i in range(0, 50_000, 977)]
    assert codec.decode(np.array(ids)) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_bpe_forgets_and_goes_on(codec, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 5)
    same(codec, ["one two three four five six seven"])
    same(codec, ["eight nine one <|endoftext|> two"])


def test_bpe_query_matches_library(spark, real):
    rows, df = real
    got = {tuple(r) for r in bpe.round_trip(df, tokenizer_path()).collect()}
    want = set()
    for (i, t), e in zip(rows, LIBRARY.encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, dtype="<u4").tobytes()
        decoded = LIBRARY.decode(e.ids, skip_special_tokens=False).encode()
        want.add((i, len(e.ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    assert got == want


def test_bpe_rows(spark, docs):
    rows = [(1, None), (2, ""), (2, "b"), (2, "b"), (None, "c d"), (3, "long " * 100_000)]
    got = bpe.encode_documents(docs(rows), PATH, keep=("source",))
    assert got.columns == ["doc_id", "source", "ids", "n_tokens"]
    back = bpe.decode_documents(got, PATH).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((i or 0, t or "") for i, t in rows)
    assert bpe.round_trip(docs(rows).limit(0), PATH).collect() == []


# ---- toxicity --------------------------------------------------------------------------------------------------


def char_model():
    text = "  stupid idiot the boat is on the lake and all good people like to see it there "
    table = toxicity.CharModel.symbol_table()
    s, n = [int(table[ord(c)]) for c in text], toxicity.CharModel.size
    counts = collections.Counter((a * n + b) * n + c for a, b, c in zip(s, s[1:], s[2:], strict=False))
    return toxicity.CharModel({k: 50 * v for k, v in counts.items()})


def test_deobfuscation():
    reader = toxicity.Deobfuscator(char_model())
    for written, meant in (("5tup1d", "stupid"), ("$tupid", "stupid"), ("st.u.p.i.d", "stupid"), ("stuuupiiid!!", "stupid"), ("1d10t", "idiot"), ("Boat,", "boat"),
                           ("good", "good"), ("***", ""), ("2024", "2024")):
        assert reader.word(written) == meant, written
    assert reader.restore("the s t u p i d boat".split()) == ["the", "stupid", "boat"]
    assert reader.restore([]) == []


def test_look_alikes_at_the_edges():
    text = "  ass asshole shit the that this hell idiot boat less with a late class cost "
    table, n = toxicity.CharModel.symbol_table(), toxicity.CharModel.size
    s = [int(table[ord(c)]) for c in text]
    counts = collections.Counter((a * n + b) * n + c for a, b, c in zip(s, s[1:], s[2:], strict=False))
    reader = toxicity.Deobfuscator(toxicity.CharModel({k: 50 * v for k, v in counts.items()}))
    for written, meant in (("a$$", "ass"), ("a$$.", "ass"), ("@$$", "ass"), ("@$$hole", "asshole"), ("$h!+", "shit"), ("455", "ass"), ("idio+", "idiot"),
                           ("he||", "hell"), ("boat!", "boat"), ("(boat)", "boat"), ("455", "455")):
        assert meant in reader.readings([written]), (written, reader.readings([written]))
    assert reader.readings(["boat", "...", "(", "class."]) == ["boat", "class"]


def test_letters_of_other_scripts_stay():
    reader = toxicity.Deobfuscator(char_model())
    for written, meant in (("你好,世界", "你好世界"), ("谢谢,你", "谢谢你"), ("żółw-łódź", "żółwłódź"), ("по-русски", "порусски"), ("हिंद,नगर", "हिंदनगर")):
        assert reader.word(written) == meant, written


def test_viterbi_finds_the_least_cost():
    """The decoder agrees with a search over every path of the lattice."""
    model = char_model()
    reader = toxicity.Deobfuscator(model)

    def paths(text, i, a, b):
        if i == len(text):
            yield model.cost[a, b, 0], ""
            return
        for letters, channel, used in reader.options(text, i, toxicity.run_lengths(text)[i]):
            x, y, total = a, b, channel
            for c in letters:
                s = model.symbol.get(c, 0)
                total += model.cost[x, y, s]
                x, y = y, s
            for rest, tail in paths(text, i + used, x, y):
                yield total + rest, letters + tail

    for text in ("1d10t", "s.t", "sttt0p", "l1ke", "g00d", "t h e"):
        best = min(paths(text, 0, 0, 0))
        assert reader.decode(text) == best[1].strip(), text


def labelled(spark, docs, n=400, seed=0):
    rng = random.Random(seed)
    plain = ["boat", "lake", "green", "walk", "stone", "river", "cloud", "paper"]
    bad = ["stupid", "idiot", "5tup1d", "i.d.i.o.t", "stuuupid"]
    rows, toxic = [], {}
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        toxic[i] = int(rng.random() < 0.3)
        if toxic[i]:
            words.insert(rng.randrange(len(words)), rng.choice(bad[:2]) if i % 5 else rng.choice(bad))
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, 1 - t, t) for i, t in toxic.items()] + [(None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return rows, toxic, labels


def test_toxicity_on_held_out_rows(spark, docs):
    rows, toxic, labels = labelled(spark, docs)
    df = docs(rows)
    got = toxicity.score_documents(df, toxicity.fit(df, labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == toxic[r["doc_id"]] for r in held) >= 0.95 * len(held)
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["predicted"]}


def test_predicted_splits_the_held_out_rows_of_the_given_labels(spark):
    """Classes of very unequal size: the cut at 0.5 must still find the toxic rows and leave the others alone."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_documents(docs, toxicity.fit(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    share = {t: [r["predicted"] for r in got if r["toxic"] == t] for t in (0, 1)}
    assert len(share[1]) > 50
    assert sum(share[1]) >= 0.9 * len(share[1]) and sum(share[0]) <= 0.1 * len(share[0])


def test_the_cut_lies_between_the_classes():
    assert toxicity.balanced_cut([0, 0, 0, 1, 1], np.array([-2.0, -1.0, 0.0, 3.0, 4.0])) == 1.5
    assert -1 < toxicity.balanced_cut([0] * 50 + [1] * 5, np.array([-1.0] * 49 + [5.0] + [1.0] * 5)) < 1  # one stray negative does not move it
    assert toxicity.balanced_cut([0, 1], np.array([2.0, 2.0])) in (1.0, 3.0)


def test_toxicity_cases(spark, docs):
    _, _, labels = labelled(spark, docs, 20)
    rows = [(1, None), (2, ""), (None, "stupid"), (2, "boat"), (2, "boat"), (4, "w " * 100_000)]
    df = docs(rows)
    for marks in (labels, labels.limit(0), labels.where("toxic = 1")):
        got = toxicity.score_documents(df, toxicity.fit(df, marks)).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    empty = df.limit(0)
    assert toxicity.score_documents(empty, toxicity.fit(empty, labels)).collect() == []


def test_labels_of_the_held_out_fold_are_not_read(spark, docs):
    rows, toxic, labels = labelled(spark, docs, 100)
    sample, _ = toxicity.labelled_sample(labels)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0 for r in sample.collect())
    small, classes = toxicity.labelled_sample(labels, per_label=10)
    assert small.count() < 40 and classes[0] + classes[1] > 60


# ---- language model --------------------------------------------------------------------------------------------


def test_windows_hold_every_target_once():
    rng = np.random.default_rng(0)
    texts = [rng.integers(1, 60, n).astype(np.uint8) for n in (1, lm.STEP, lm.STEP + 1, 5 * lm.STEP - 1, 1)]
    x, y, owner = lm.windows(texts)
    for i, t in enumerate(texts):
        rows = owner == i
        assert y[rows].ravel()[: len(t)].tolist() == t.tolist() and (y[rows].ravel()[len(t) :] == lm.PAD).all()
        inputs = x[rows][:, lm.STEP :].ravel()[: len(t)]
        assert inputs.tolist() == [lm.START, *t[:-1].tolist()]
        for k in range(1, int(rows.sum())):  # the context half is the scored half of the window before
            assert x[rows][k, : lm.STEP].tolist() == x[rows][k - 1, lm.STEP :].tolist()


def test_attention_is_causal_and_normalised():
    model = lm.Attention.start(np.arange(1, lm.CLASSES + 1))
    rng = np.random.default_rng(1)
    x = rng.integers(0, lm.CLASSES, (3, 2 * lm.STEP)).astype(np.uint8)
    z, _ = model.forward(x)
    changed = x.copy()
    changed[:, lm.STEP + 5 :] = 1
    other, _ = model.forward(changed)
    z, other = (v.reshape(3, lm.STEP, -1) for v in (z, other))
    assert np.allclose(z[:, :5], other[:, :5]) and not np.allclose(z[:, 5:], other[:, 5:])
    total = sum(10 ** model.log10_targets(x[:1], np.full((1, lm.STEP), c, dtype=np.uint8)) for c in range(lm.CLASSES))
    assert np.allclose(total, 1, atol=1e-5)


def test_gradient_matches_differences():
    model = lm.Attention.start(np.ones(lm.CLASSES))
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, lm.CLASSES, n).astype(np.uint8) for n in (3, 40, 17)]
    x, y, _ = lm.windows(texts)
    gradient = model.gradient(x, y)

    def loss(flat):
        return -lm.Attention(flat).log10_targets(x, y).sum() * math.log(10) / np.count_nonzero(y != lm.PAD)

    for at in rng.choice(len(model.flat), 60, replace=False):
        up, down = model.flat.copy(), model.flat.copy()
        up[at] += 1e-2
        down[at] -= 1e-2
        assert abs(gradient[at] - (loss(up) - loss(down)) / 2e-2) < 2e-4


def test_training_learns_context():
    rng = np.random.default_rng(3)
    texts = [np.append((rng.integers(0, 2) * 20 + rng.integers(1, 20, 60)), lm.END).astype(np.uint8) for _ in range(300)]  # two "languages"
    counts = np.bincount(np.concatenate(texts), minlength=lm.CLASSES)
    trainer = lm.Trainer(lm.Attention.start(counts))
    x, y, _ = lm.windows(texts[:50])
    before = trainer.model.log10_targets(x, y).mean()
    for _ in range(3):
        trainer.texts(texts[50:])
    assert trainer.model.log10_targets(x, y).mean() > before + 0.15


def two_heads_of_a_class(n=3000):
    """Ids, shares and class counts of a vocabulary of ``n`` heads, and two heads that share a class and its first group."""
    counts = {h: 10_000 if h < lm.OWN_CLASSES else n - h for h in range(n - 200)}  # the last ones are in no training text
    ids = lm.head_ids(counts, list(range(n)))
    a = lm.OWN_CLASSES + 9
    b = a + lm.SHARED_CLASSES
    assert lm.class_of(a, {}) == lm.class_of(b, {})
    mass = np.bincount(lm.class_of_ids(ids[1:]), weights=[counts.get(h, 0) for h in range(n)], minlength=lm.CLASSES)
    return ids, lm.log_shares(ids, counts), mass, counts, a, b


def test_every_head_is_an_event_of_its_own():
    """Heads that share a class have ids and probabilities of their own; all of them sum to 1, and start with their shares of the corpus."""
    ids, shares, mass, counts, a, b = two_heads_of_a_class()
    assert len(set(ids.tolist())) == len(ids)
    model = lm.Attention.start(mass, shares=shares)
    model.p["out"][:-1] = 0
    every = np.concatenate(([lm.END], ids)).astype(np.int32)
    x = np.resize(ids[[a + 1, 1, b + 1, 2, 3000]], (1, 2 * lm.STEP)).astype(np.int32)

    def all_probabilities():
        return np.array([10 ** model.log10_targets(x, np.full((1, lm.STEP), i, dtype=np.int32)) for i in every])

    start = all_probabilities()
    assert np.allclose(start.sum(axis=0), 1, atol=1e-4)
    assert np.allclose(start[1 + a + 1] / start[1 + b + 1], (counts[a] + 0.5) / (counts[b] + 0.5), rtol=1e-3)
    rng = np.random.default_rng(5)
    for name in ("out", *model.DEEP):
        model.p[name][:] = rng.normal(0, 0.5, model.p[name].shape)
    assert np.allclose(all_probabilities().sum(axis=0), 1, atol=1e-4)


def test_gradient_of_heads_matches_differences():
    ids, shares, mass, _, a, b = two_heads_of_a_class()
    rng = np.random.default_rng(6)
    model = lm.Attention.start(mass, shares=shares)
    for name in model.DEEP:
        model.p[name][:] = rng.normal(0, 0.3, model.p[name].shape)
    texts = [rng.choice(ids[[a + 1, b + 1, 2, 1500, 2999, 0]], n) for n in (5, 40, 17)]
    x, y, _ = lm.windows(texts)
    gradient = model.gradient(x, y)

    def loss(flat):
        return -lm.Attention(flat, shares).log10_targets(x, y).sum() * math.log(10) / np.count_nonzero(y != lm.PAD)

    some = np.flatnonzero(np.abs(gradient) > 1e-3)
    for at in [*rng.choice(some, 100, replace=False), *rng.choice(len(gradient), 20, replace=False)]:
        up, down = model.flat.copy(), model.flat.copy()
        up[at] += 1e-2
        down[at] -= 1e-2
        assert abs(gradient[at] - (loss(up) - loss(down)) / 2e-2) < 5e-4


def test_training_tells_heads_of_a_class_apart():
    """One head follows word 1 and the other word 2, which two heads of one class could not before."""
    ids, shares, mass, _, a, b = two_heads_of_a_class()
    rng = np.random.default_rng(7)
    pair = np.array([[ids[2], ids[a + 1]], [ids[3], ids[b + 1]]], dtype=np.int32)
    trainer = lm.Trainer(lm.Attention.start(mass, shares=shares))
    for _ in range(60):
        trainer.texts([pair[rng.integers(0, 2, 20)].ravel() for _ in range(20)])
    right, wrong = [pair[rng.integers(0, 2, 20)] for _ in range(2)], []
    for text in right:
        other = text.copy()
        other[:, 1] = np.where(text[:, 1] == ids[a + 1], ids[b + 1], ids[a + 1])
        wrong.append(other.ravel())
    good, bad = (trainer.model.log10_targets(*lm.windows(t)[:2]).sum() for t in ([t.ravel() for t in right], wrong))
    assert good > bad + 20  # 40 places


def test_learned_heads_have_ids(spark, docs):
    """What ``learn`` gives: an id for each head of the vocabulary, counts of each head."""
    rows = [(i, f"boat a{i % 7} zebra żółw {'the ' * (i % 5)}") for i in range(40)]
    heads = lm.Heads.from_file(PATH)
    listed = lm.number_words(lm.prepare(docs(rows), "doc_id", "text"), heads, 3).localCheckpoint()
    model = lm.learn(listed.where("part is null"), lm.total_words(listed, 3), heads)
    known = sorted(heads.vocabulary.values())
    assert len(set(model.ids[np.array(known) + 1].tolist())) == len(set(known))
    want = collections.Counter(heads.head(w) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in lm.split_text(t))
    assert {h: int(n) for h, n in enumerate(model.head_counts, -1) if n} == want


def test_lm_base_scores_match_brute_force(spark, real):
    rows, df = real
    want = brute.base_scores(rows)
    got = lm.score_documents(df, PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:3]
        assert abs(r["base_score"] - want[r["doc_id"]][3]) < 1e-6 * abs(r["base_score"])
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) and r["score"] < 0
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_cases(spark, docs):
    rows = [(1, None), (2, ""), (None, "a b"), (2, "a a"), (2, "a a"), (4, "z " * 60_000), (5, "éa\x0bB")]
    got = lm.score_documents(docs(rows), PATH).collect()  # not read from files: written first
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted((i or 0, len(brute.words(t)) + 1) for i, t in rows)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    twins = [r for r in got if r["doc_id"] == 2 and r["n_tokens"] == 3]
    assert len(twins) == 2 and abs(twins[0]["score"] - twins[1]["score"]) < 1e-5  # float32 sums
    assert lm.score_documents(docs(rows).limit(0), PATH).collect() == []


def test_lm_splits_each_text_once(spark, docs, tmp_path, monkeypatch):
    """Word lists, training and scores all come from one pass over the texts."""
    log, split = str(tmp_path / "split"), lm.split_text

    def logged(text):
        with open(log, "a") as file:
            file.write("x")
        return split(text)

    monkeypatch.setattr(lm, "split_text", logged)
    rows = [(i, f"A b{i % 7} c") for i in range(30)] + [(30, None), (None, "b c"), (1, "A b1 c")]
    assert len(lm.score_documents(docs(rows), PATH).collect()) == len(rows)
    with open(log) as file:
        assert len(file.read()) == len(rows)


def test_lm_word_lists(spark, docs):
    rows = [(i, t) for i, t in enumerate(["b a", "a a é", None, "", "zq A", "b\x0bB"])] + [(None, "a"), (0, "b a")]
    texts = lm.prepare(docs(rows).repartition(3), "doc_id", "text")
    heads, parts = lm.Heads.from_file(PATH), 5
    listed = lm.number_words(texts, heads, parts).localCheckpoint()
    totals = lm.total_words(listed, parts).localCheckpoint()
    assert listed.where("part is null").count() == len(rows)
    blocks = listed.where("part is null").select("block").distinct().count()
    assert blocks > 1 and listed.where("part is not null").count() <= blocks * parts

    want, words = collections.Counter(), set()
    for i, t in rows:
        words |= set(lm.split_text(t))
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            want.update(lm.split_text(t))
    pairs = totals.where("piece is null").collect()
    assert {c for r in pairs for c in np.frombuffer(r["n"], np.uint8)} - {0} == set(want.values())
    per_head = collections.defaultdict(lambda: [0, 0, 0])
    for w, n in want.items():
        for k, v in enumerate((n, 1, int(n == 1))):
            per_head[heads.head(w)][k] += v
    got = totals.where("piece is not null").groupBy("piece").sum("total", "distinct", "once").collect()
    assert {r[0]: list(r[1:]) for r in got} == per_head
    assert heads.all(sorted(words)).tolist() == [heads.head(w) for w in sorted(words)]


def test_lm_scores_do_not_depend_on_blocks(real, monkeypatch):
    rows, df = real
    want = {r["doc_id"]: r for r in lm.score_documents(df, PATH).collect()}
    monkeypatch.setattr(lm, "BLOCK_ROWS", 7)
    monkeypatch.setattr(lm, "TEXTS", 3)
    monkeypatch.setattr(lm, "BEGINNINGS", 10)
    for r in lm.score_documents(df, PATH).collect():
        assert r[:5] == want[r["doc_id"]][:5]
        assert abs(r["base_score"] - want[r["doc_id"]]["base_score"]) < 1e-9 * abs(r["base_score"])
        assert abs(r["score"] - want[r["doc_id"]]["score"]) < 1e-5 * abs(r["score"])


# ---- pipeline --------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, real):
    import corpus_pipeline as pipeline

    rows, docs = real
    columns = docs.columns
    sf = SF
    texts = dict(rows)

    scored = toxicity.score_documents(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    clean = pipeline.drop_toxic(spark, docs, sf)
    assert clean.columns == columns
    left = {r["doc_id"] for r in clean.collect()}
    assert left == {r["doc_id"] for r in scored.where("predicted = 0").collect()}

    unique = pipeline.drop_copies(spark, clean, sf)
    groups = brute.exact_groups([(i, texts[i]) for i in left])
    left = {max(ids) for ids in groups.values()}
    assert unique.columns == columns and {r["doc_id"] for r in unique.collect()} == left

    apart = pipeline.drop_near_copies(spark, unique, sf)
    left = {i for i, (_, c) in brute.jaccard_components([(i, texts[i]) for i in left]).items() if c == i}
    assert apart.columns == columns and {r["doc_id"] for r in apart.collect()} == left

    mixed = pipeline.mix_sources(spark, apart, sf)
    assert mixed.columns == columns
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    size = {i: len(brute.words(texts[i])) for i in left}
    assert max(copies.values()) <= 2 and set(copies) <= left
    assert abs(sum(size[i] * n for i, n in copies.items()) / sum(size.values()) - 1.5) < 0.1

    tokens = pipeline.tokenize(spark, mixed, sf).collect()
    assert collections.Counter(r["doc_id"] for r in tokens) == copies
    for r in tokens[:50]:
        assert r["ids"] == LIBRARY.encode(texts[r["doc_id"]], add_special_tokens=False).ids
    whole = pipeline.run(spark, sf).collect()
    assert collections.Counter(r["doc_id"] for r in whole) == copies
