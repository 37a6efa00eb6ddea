"""Language-model scores from a causal self-attention model trained in numpy on subword ids.

A word's head is its longest beginning among the pieces of a public vocabulary. The probability of a word is that of its
head given the heads before it, times that of the word among those with its head:

* the head comes from one layer of causal self-attention over the heads (content scores plus a learned bias per
  distance). Texts are cut into windows whose first half is context only and overlaps the window before, so every token
  is scored once, with all windows of a chunk in one masked batch. Each head of the vocabulary is an input and an outcome
  of its own: the softmax over them is a tree, first over classes (the heads with the most training mass are classes by
  themselves, the others share some by id), then over the most frequent heads of the class and the rest of it, then over
  the groups of that rest and the heads of a group. All levels depend on the context and start from the corpus's shares;
* the word given its head comes from corpus counts, with the mass of the words seen once set aside for unseen words.
  The events are the training words and, as in the base score, the unknown word, here one for each head.

Counts cover the whole training part. Training goes over every training text once, in rounds: tasks run Adam over
their own texts from common weights, and the weights are averaged by tokens in a two-level tree after each round.

Word counts are needed by every text but are as large as the corpus vocabulary, so they are not broadcast: documents
are cut into blocks, and each block numbers its distinct words. Texts are split into words once, where they are read;
from then on they are the numbers of their words. A block's list of words moves by parts of the word hash to where the
counts of all blocks are added up, and goes back with the sums to the block's documents: one array per block and part,
not a row per word.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sitelake.llm.shared import cut

BLOCK_ROWS = 4096  # rows of a file that share one list of words
TEXTS = 256  # texts whose words are numbered at a time
BEGINNINGS = 500_000  # beginnings of words whose heads a task remembers
OWN_CLASSES, SHARED_CLASSES = 47, 16  # heads with a class of their own; classes that the other heads share
END, START, PAD = 0, 64, 65  # class of the end of a text; inputs only: start of a text, nothing
CLASSES, INPUTS, WIDTH, STEP = 64, 66, 16, 8  # windows have STEP context and STEP scored positions
GROUPS, SLOTS = 128, 32  # a shared class has SLOTS - 1 heads and the rest of it, which is in groups of SLOTS heads
PLACES = SLOTS - 1 + GROUPS * SLOTS  # heads that a shared class has room for
IDS = INPUTS + SHARED_CLASSES * PLACES  # ids: classes and inputs, then the places of the heads that share classes
NEVER = -1e9  # logit of a place without a head
Shares = tuple[np.ndarray, np.ndarray, np.ndarray]
ROUNDS = (1, 3, 6)  # tenths of the training texts that each round goes over
BATCH = 256  # windows per training step
RATE = 0.01
FOLD, HELD = 5, 1


# ---- subword heads and their ids ---------------------------------------------------------------------------------


class Heads:
    """Head piece of a word: the longest beginning (in bytes) that the vocabulary holds as a word start."""

    longest = 5

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary
        self.found: dict[bytes, int] = {}

    @classmethod
    def from_file(cls, path: str) -> Heads:
        from sitelake.llm.bpe import byte_alphabet

        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        pieces = {bytes(to_byte[c] for c in token): i for token, i in vocab.items()}
        starts = {p: i for p, i in pieces.items() if len(p) == 1}  # every byte, so that each word has a head
        starts |= {p[1:]: i for p, i in pieces.items() if p[:1] == b" " and 1 < len(p) <= cls.longest + 1}
        return cls(starts)

    def head(self, word: bytes) -> int:
        known = self.vocabulary
        for n in range(min(self.longest, len(word)), 0, -1):
            if (i := known.get(word[:n])) is not None:
                return i
        return -1

    def all(self, words: list[bytes]) -> np.ndarray:
        """Head of every word. Only its first ``longest`` bytes matter, so a bounded number of such beginnings is remembered."""
        if len(self.found) > BEGINNINGS:
            self.found.clear()
        starts = [w[: self.longest] for w in words]
        for start in set(starts).difference(self.found):
            self.found[start] = self.head(start)
        return np.fromiter(map(self.found.__getitem__, starts), dtype=np.int32, count=len(starts))


def class_of(head: int, own: dict[int, int]) -> int:
    return own.get(head, 1 + OWN_CLASSES + head % SHARED_CLASSES)


def class_of_ids(ids: np.ndarray) -> np.ndarray:
    """The class of every id; START and PAD stay."""
    return np.where(ids < INPUTS, ids, 1 + OWN_CLASSES + (ids - INPUTS) // PLACES)


def head_ids(counts: dict[int, int], known: list[int]) -> np.ndarray:
    """Id of every head, that of head h at h + 1 (-1: no head); ``counts``: how often heads stand in training texts, ``known``: all that there are.

    The most frequent heads have a class, the others a place in a shared one, by falling frequency."""
    best = sorted(counts, key=lambda h: (-counts[h], h))[:OWN_CLASSES]
    own = {head: 1 + i for i, head in enumerate(best)}
    ids = np.full(max(known) + 2, -1, dtype=np.int32)
    taken = [0] * SHARED_CLASSES
    for head in sorted({-1, *known}, key=lambda h: (-counts.get(h, 0), h)):
        c = class_of(head, own)
        if head in own:
            ids[head + 1] = c
            continue
        shared = c - 1 - OWN_CLASSES
        if taken[shared] == PLACES:
            raise ValueError(f"The vocabulary has more than {PLACES} beginnings of words in one class")
        ids[head + 1] = INPUTS + shared * PLACES + taken[shared]
        taken[shared] += 1
    return ids


def log_shares(ids: np.ndarray, counts: dict[int, int]) -> Shares:
    """Log shares by add-half counts of the heads: of the first heads of each class and of its rest, of the groups in the rest, of the heads in each group."""
    n = np.zeros(IDS - INPUTS)
    shared = np.flatnonzero(ids >= INPUTS)
    n[ids[shared] - INPUTS] = [counts.get(h, 0) + 0.5 for h in (shared - 1).tolist()]
    n = n.reshape(SHARED_CLASSES, PLACES)
    slot = n[:, SLOTS - 1 :].reshape(SHARED_CLASSES, GROUPS, SLOTS)
    group = slot.sum(axis=2)
    first = np.concatenate((n[:, : SLOTS - 1], group.sum(axis=1)[:, None]), axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        shares = [v / v.sum(axis=-1, keepdims=True) for v in (first, group, slot)]
        return tuple(np.where(v > 0, np.log(v), NEVER).astype(np.float32) for v in shares)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit identities of words in the count tables."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


# ---- the attention model ---------------------------------------------------------------------------------------


class Attention:
    """One causal self-attention layer; parameters are one flat float32 vector.

    Inputs are ids, so queries, keys and values are rows of small tables (embedding times matrix) and need no product per
    token. A head that shares its class is embedded as the sum of its class, its group and its slot there. Output weights stay
    within LIMIT, which bounds the logits and lets exp go without a running maximum. ``shares``: as from ``log_shares``.
    """

    shapes = {
        "emb": (INPUTS, WIDTH), "q": (WIDTH, WIDTH), "skip": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH),
        "far": (2 * STEP,), "out": (WIDTH + 1, CLASSES),
        "of_group": (SHARED_CLASSES * (GROUPS + 1), WIDTH), "of_slot": (SHARED_CLASSES * SLOTS, WIDTH),
        "first": (SHARED_CLASSES, WIDTH, SLOTS), "group": (SHARED_CLASSES, WIDTH, GROUPS), "slot": (SHARED_CLASSES, WIDTH, SLOTS),
    }
    DEEP = ("of_group", "of_slot", "first", "group", "slot")
    LIMIT = 4.0

    def __init__(self, flat: np.ndarray, shares: Shares | None = None):
        self.flat = flat.astype(np.float32)
        even = [(SHARED_CLASSES, SLOTS), (SHARED_CLASSES, GROUPS), (SHARED_CLASSES, GROUPS, SLOTS)]
        self.shares = shares or tuple(np.full(s, -math.log(s[-1]), dtype=np.float32) for s in even)
        self.p, at = {}, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            self.p[name] = self.flat[at : at + n].reshape(shape)
            at += n
        # distance from query STEP + i to key j; later keys are masked
        distance = np.arange(STEP, 2 * STEP)[:, None] - np.arange(2 * STEP)[None, :]
        self.later = np.where(distance < 0, np.float32(-1e9), np.float32(0))
        self.distance = np.maximum(distance, 0)

    @classmethod
    def start(cls, class_counts: np.ndarray, seed: int = 7, shares: Shares | None = None) -> Attention:
        """Small random weights; the output bias (last row of ``out``) is the log share of each class. Heads of a class start alike."""
        size = sum(int(np.prod(s)) for s in cls.shapes.values())
        model = cls(np.random.default_rng(seed).normal(0, 0.25, size), shares)
        for name in ("far", *cls.DEEP):
            model.p[name][:] = 0
        model.p["out"][-1] = np.log((class_counts + 0.5) / (class_counts.sum() + 0.5 * CLASSES))
        return model

    def limit(self) -> None:
        for weights in (self.p["out"][:-1], self.p["first"], self.p["group"], self.p["slot"]):
            np.clip(weights, -self.LIMIT, self.LIMIT, out=weights)

    def embedded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct ids of x in order, the place of each in that list, and their embeddings."""
        held = np.zeros(IDS, dtype=bool)
        held[x] = True
        ids = np.flatnonzero(held)
        place = np.empty(IDS, dtype=np.uint16 if len(ids) < 1 << 16 else np.int32)
        place[ids] = np.arange(len(ids))
        emb = self.p["emb"][class_of_ids(ids)]
        if (own := np.searchsorted(ids, INPUTS)) < len(ids):
            group, slot = self.places(ids[own:])
            emb[own:] += self.p["of_group"][group] + self.p["of_slot"][slot]
        return ids, place[x], emb

    @staticmethod
    def places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the embeddings of the groups and of the slots of heads that share classes."""
        c, place = np.divmod(ids - INPUTS, PLACES)
        group, slot = np.divmod(place, SLOTS)
        return c * (GROUPS + 1) + group, c * SLOTS + slot

    def forward(self, x: np.ndarray):
        """x: (windows, 2 * STEP) input ids. Returns exp of the class logits of the last STEP positions and the parts for training."""
        p = self.p
        here = np.concatenate((p["q"] * np.float32(1 / math.sqrt(WIDTH)), p["skip"]), axis=1)
        ids, at, emb = self.embedded(x)
        qs = (emb @ here).take(at[:, STEP:], axis=0)
        k, v = (emb @ p["k"]).take(at, axis=0), (emb @ p["v"]).take(at, axis=0)
        a = qs[:, :, :WIDTH] @ k.transpose(0, 2, 1)
        a += p["far"][self.distance] + self.later
        if (some := np.flatnonzero((x == PAD).any(axis=1))).size:
            a[some] += np.where(x[some] == PAD, np.float32(-1e9), np.float32(0))[:, None, :]
        np.minimum(a, np.float32(75), out=a)
        np.exp(a, out=a)
        sums = a.sum(axis=-1, keepdims=True) + np.float32(1e-20)
        mixed = (a @ v) / sums
        h = np.empty((len(x) * STEP, WIDTH + 1), dtype=np.float32)
        np.tanh((qs[:, :, WIDTH:] + mixed).reshape(-1, WIDTH), out=h[:, :WIDTH])
        h[:, WIDTH] = 1
        z = h @ p["out"]
        return np.exp(z, out=z), (qs, k, v, a, sums, mixed, h, ids, at, emb)

    def within_class(self, h: np.ndarray, ids: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """log10 probability, given their classes, of heads that share them; ``h``: the states that they follow.

        With ``weight`` also the gradients of the log loss by h and by the weights, tokens weighing that much."""
        out, dh, g = np.zeros(len(ids)), np.zeros_like(h), {}
        c, place = np.divmod(ids - INPUTS, PLACES)
        rest = np.flatnonzero(place >= SLOTS - 1)
        group, slot = np.divmod(place[rest] - (SLOTS - 1), SLOTS)
        first, of_group, of_slot = self.shares
        levels = [
            ("first", slice(None), c, first[c], np.minimum(place, SLOTS - 1)),
            ("group", rest, c[rest], of_group[c[rest]], group),
            ("slot", rest, c[rest], of_slot[c[rest], group], slot),
        ]
        for name, at, key, share, choice in levels:
            if weight is None and not len(key):
                continue
            log10, d, g[name] = self.level(self.p[name], key, h[at], share, choice, None if weight is None else weight[at])
            out[at] += log10
            if weight is not None:
                dh[at] += d
        return out, dh, g

    @staticmethod
    def level(table: np.ndarray, key: np.ndarray, h: np.ndarray, share: np.ndarray, choice: np.ndarray, weight: np.ndarray | None):
        """log10 probability of the choices of one level, whose weights are those of the key in ``table``; with ``weight`` also the gradients by h and by the table."""
        order = np.argsort(key.astype(np.uint8), kind="stable")
        n = np.bincount(key, minlength=len(table))
        row = np.empty(len(key), dtype=np.int64)
        row[order] = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
        # all keys at once: the states of each key, filled up with zeros to equal lengths
        states = np.zeros((len(table), n.max(initial=0), WIDTH), dtype=np.float32)
        states[key, row] = h
        prob = np.exp((states @ table)[key, row] + share)
        rows = np.arange(len(key))
        sums = prob.sum(axis=1)
        log10 = np.log10(np.maximum(prob[rows, choice], 1e-30) / sums)
        if weight is None:
            return log10, None, None
        prob *= (weight / sums)[:, None]
        prob[rows, choice] -= weight
        d = np.zeros((*states.shape[:2], table.shape[2]), dtype=np.float32)
        d[key, row] = prob
        return log10, (d @ table.transpose(0, 2, 1))[key, row], states.transpose(0, 2, 1) @ d

    def gradient(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Gradient of the mean log loss over the targets y (windows, STEP) that are not PAD."""
        p, g = self.p, {}
        prob, (qs, k, v, a, sums, mixed, h, ids, at, emb) = self.forward(x)
        target = y.ravel().astype(np.int64)
        rows = np.flatnonzero(target != PAD)
        weight = np.where(target != PAD, np.float32(1 / max(1, len(rows))), np.float32(0))
        prob *= (weight / (prob @ np.ones(CLASSES, dtype=np.float32)))[:, None]
        prob[rows, class_of_ids(target[rows])] -= weight[rows]
        g["out"] = h.T @ prob
        t = h[:, :WIDTH]
        dt = prob @ p["out"][:-1].T
        shared = np.flatnonzero(target >= INPUTS)
        _, more, deep = self.within_class(t[shared], target[shared], weight[shared])
        dt[shared] += more
        g |= deep
        dz = (dt * (1 - t * t)).reshape(mixed.shape)
        a /= sums
        ds = dz @ v.transpose(0, 2, 1)
        ds -= (dz * mixed).sum(axis=-1, keepdims=True)
        ds *= a
        dv = a.transpose(0, 2, 1) @ dz
        dq, dk = ds @ k, ds.transpose(0, 2, 1) @ qs[:, :, :WIDTH]
        g["far"] = np.bincount(self.distance.ravel(), weights=ds.sum(axis=0).ravel(), minlength=2 * STEP)
        # sums per input id give the gradients of the tables, and the tables those of the matrices
        here = self._by_id(at[:, STEP:], np.concatenate((dq, dz), axis=2), len(ids))
        keys = self._by_id(at, np.concatenate((dk, dv), axis=2), len(ids))
        scale = np.float32(1 / math.sqrt(WIDTH))
        tables = {"q": here[:, :WIDTH] * scale, "skip": here[:, WIDTH:], "k": keys[:, :WIDTH], "v": keys[:, WIDTH:]}
        g |= {n: emb.T @ d for n, d in tables.items()}
        # an id's embedding is a sum, each part of which gets the gradient of the whole
        demb = sum(d @ p[n].T for n, d in tables.items())
        own = np.searchsorted(ids, INPUTS)
        group, slot = self.places(ids[own:])
        for name, row, part in (("emb", class_of_ids(ids), demb), ("of_group", group, demb[own:]), ("of_slot", slot, demb[own:])):
            g[name] = self._by_id(row.astype(np.uint16), part, len(p[name]))
        return np.concatenate([g[n].ravel() for n in self.shapes]).astype(np.float32)

    @staticmethod
    def _by_id(x: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """Sum of the rows of ``values`` for each of the ids 0 to n - 1."""
        out = np.zeros((n, values.shape[-1]), dtype=np.float32)
        if not x.size:
            return out
        ids = x.ravel()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        out[ids[first]] = np.add.reduceat(values.reshape(len(ids), -1).take(order, axis=0), first, axis=0)
        return out

    def log10_targets(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """log10 probability of every target of the windows (0 at PAD)."""
        out = np.zeros(y.size, dtype=np.float64)
        target = y.ravel().astype(np.int64)
        ones = np.ones(CLASSES, dtype=np.float32)
        for i in range(0, len(x), 2 * BATCH):
            z, (*_, h, _, _, _) = self.forward(x[i : i + 2 * BATCH])
            t = target[i * STEP : i * STEP + len(z)]
            real = np.flatnonzero(t != PAD)
            out[i * STEP + real] = np.log10(np.maximum(z[real, class_of_ids(t[real])], 1e-30) / (z @ ones)[real])
            shared = np.flatnonzero(t >= INPUTS)
            out[i * STEP + shared] += self.within_class(h[shared, :WIDTH], t[shared])[0]
        return out


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, text of each window) of id sequences; each target stands in exactly one window."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    rows = -(-lengths // STEP)
    total = int((rows + 1).sum())
    y = np.full(total * STEP, PAD, dtype=np.int32)
    x = np.full(total * STEP, PAD, dtype=np.int32)
    first = np.cumsum(rows + 1) - rows  # the row of each text's first target; the row before it is empty context
    place = np.repeat(first * STEP - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    flat = np.concatenate(texts) if len(texts) else np.empty(0, dtype=np.int32)
    y[place] = flat
    x[place[:-1] + 1] = flat[:-1]
    x[first * STEP] = START
    x[y == PAD] = PAD
    owner = np.repeat(np.arange(len(texts)), rows)
    real = np.ones(total, dtype=bool)
    real[first - 1] = False
    at = np.flatnonzero(real)
    x, y = x.reshape(-1, STEP), y.reshape(-1, STEP)
    return np.concatenate((x[at - 1], x[at]), axis=1), y[at], owner


class Trainer:
    """Adam over the windows of a stream of texts."""

    def __init__(self, model: Attention):
        self.model, self.t = model, 0
        self.m, self.v = np.zeros_like(model.flat), np.zeros_like(model.flat)

    def step(self, x: np.ndarray, y: np.ndarray) -> None:
        g = self.model.gradient(x, y)
        self.t += 1
        self.m *= 0.9
        self.m += 0.1 * g
        self.v *= 0.99
        g *= g
        g *= 0.01
        self.v += g
        rate = RATE / math.sqrt(1 + self.t / 200)
        down = np.sqrt(self.v)
        down *= 1 / math.sqrt(1 - 0.99**self.t)
        down += 1e-7
        np.divide(self.m, down, out=down)
        down *= rate / (1 - 0.9**self.t)
        self.model.flat -= down
        self.model.limit()

    def texts(self, sequences: list[np.ndarray]) -> None:
        x, y, _ = windows(sequences)
        for i in range(0, len(x), BATCH):
            self.step(x[i : i + BATCH], y[i : i + BATCH])


# ---- Spark jobs ------------------------------------------------------------------------------------------------


def split_text(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at space and \\t-\\r."""
    return (text or "").encode().lower().split()


def prepare(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, row, doc_id, held_out, tenth, text): a block is a run of rows of one file. Frames that aren't read from files are written first."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), "lm-texts")
        id_col, text_col = "doc_id", "text"
    held = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLD)) == HELD
    text = F.col(text_col).cast("string")
    return docs.select(
        F.xxhash64("_metadata.file_path", F.expr(f"_metadata.row_index div {BLOCK_ROWS}")).alias("block"),
        F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("row"),
        F.col(id_col).alias("doc_id"),
        F.coalesce(held, F.lit(False)).alias("held_out"),
        F.pmod(F.xxhash64(F.col(id_col), F.length(text)), F.lit(sum(ROUNDS))).cast("int").alias("tenth"),
        text.alias("text"),
    )


def planes(values: np.ndarray) -> bytes:
    """Numbers as bytes, all first bytes, then all second ones and so on, which the tables' compression shrinks well."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(raw: pa.BinaryScalar, kind: type) -> np.ndarray:
    rows = np.frombuffer(raw.as_buffer(), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(rows.T).view(kind).ravel()


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []  # words numbered since the list was last emptied

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(word)
        number = self[word] = len(self)
        return number


class WordList:
    """The distinct words of a block: numbers, heads and counts in training texts."""

    def __init__(self, heads: Heads):
        self.heads, self.numbers = heads, Numbers()
        self.head, self.n = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)

    def add(self, texts: list[str | None], held: list[bool]) -> list[np.ndarray]:
        """The words of the texts as numbers; those of texts that are not held out are counted."""
        number = self.numbers.__getitem__
        out = [np.fromiter(map(number, words), dtype=np.uint32, count=len(words)) for words in map(split_text, texts)]
        self.head = np.append(self.head, self.heads.all(self.numbers.fresh))
        self.numbers.fresh.clear()
        n = np.bincount(np.concatenate([self.n[:0], *[x for x, h in zip(out, held, strict=True) if not h]]), minlength=len(self.numbers))
        n[: len(self.n)] += self.n
        self.n = n
        return out

    def parts(self, n: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        """(part, word hashes, numbers, heads, counts) of the words, dealt over ``n`` parts by their hash."""
        words = word_hashes(list(self.numbers))
        part = ((words >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edge = np.searchsorted(part[order], np.arange(n + 1))
        for p in np.flatnonzero(np.diff(edge)).tolist():
            at = order[edge[p] : edge[p + 1]]
            yield p, words[at].tobytes(), planes(at.astype(np.uint32)), planes(self.head[at]), planes(self.n[at])


def number_words(texts: DataFrame, heads: Heads, n: int) -> DataFrame:
    """Rows of the blocks' words (part, word, number, head, n) and of their documents (doc_id, held_out, tenth, numbers, heads).

    A word row has the words of one block that fall into one of ``n`` parts; a document's row has the numbers and the
    heads of its words in order, and no part. A block that is read in two pieces is two blocks."""
    id_type = texts.schema["doc_id"].dataType.simpleString()
    names = ["block", "part", "word", "number", "head", "n", "doc_id", "held_out", "tenth", "numbers", "heads"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, key, words, ids = None, 0, WordList(heads), pa.null()

        def listed() -> Iterator[pa.RecordBatch]:
            rows = list(words.parts(n))
            if rows:
                part, *columns = zip(*rows, strict=True)
                none = [pa.nulls(len(rows), t) for t in (ids, pa.bool_(), pa.int32(), pa.binary(), pa.binary())]
                found = [pa.array(c, pa.binary()) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.int64()), pa.array(part, pa.int32()), *found, *none], names)

        for batch in batches:
            blocks, ids = batch.column(0).to_numpy(), batch.column(2).type
            edges = np.flatnonzero(np.diff(blocks) != 0) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if a < b and blocks[a] != block:
                    yield from listed()
                    block, key, words = blocks[a], batch.column(1)[a].as_py(), WordList(heads)
                for i in range(a, b, TEXTS):
                    part = batch.slice(i, min(TEXTS, b - i))
                    numbers = words.add(part.column(5).to_pylist(), part.column(3).to_pylist())
                    none = [pa.nulls(len(numbers), t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())]
                    found = [pa.array([planes(x) for x in numbers], pa.binary()), pa.array([planes(words.head[x]) for x in numbers], pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(numbers), pa.int64()), *none, part.column(2), part.column(3), part.column(4), *found], names)
        yield from listed()

    fields = f"block bigint, part int, word binary, number binary, head binary, n binary, doc_id {id_type}, held_out boolean, tenth int, numbers binary, heads binary"
    return texts.select("block", "row", "doc_id", "held_out", "tenth", "text").mapInArrow(run, fields)


def total_words(listed: DataFrame, n: int) -> DataFrame:
    """Rows of the blocks' words (block, number, head, n), n now from all blocks, and rows per part and head.

    The latter have the count of training words with that head (total), of distinct ones and of those that stand there once."""
    names = ["block", "number", "head", "n", "piece", "total", "distinct", "once"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number, head, word, n = [], [], [], [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
        for batch in batches:
            block += batch.column(1).to_pylist()
            word += [np.frombuffer(raw.as_buffer(), dtype=np.uint64) for raw in batch.column(2)]
            number += batch.column(3).to_pylist()
            head += batch.column(4)
            n += [from_planes(raw, np.int64) for raw in batch.column(5)]
        if not block:
            return
        edge = np.cumsum([len(w) for w in word])
        words, count = np.concatenate(word), np.concatenate(n)
        order = np.argsort(words, kind="stable")
        words = words[order]
        first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
        total = np.add.reduceat(count[order], first)
        count[order] = np.repeat(total, np.diff(np.append(first, len(words))))
        for i in range(0, len(block), TEXTS):
            some = range(i, min(i + TEXTS, len(block)))
            sums = [planes(count[edge[j] : edge[j + 1]]) for j in some]
            columns = [pa.array(block[i : i + TEXTS], pa.int64()), pa.array(number[i : i + TEXTS], pa.binary()), pa.array(head[i : i + TEXTS], pa.binary()), pa.array(sums, pa.binary())]
            none = [pa.nulls(len(sums), t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *none], names)
        known = total > 0
        piece, at = np.unique(np.concatenate([from_planes(h, np.int32) for h in head])[order[first[known]]], return_inverse=True)
        total = total[known]
        stats = [np.bincount(at, weights=w, minlength=len(piece)).astype(np.int64) for w in (total, np.ones(len(total)), total == 1)]
        none = [pa.nulls(len(piece), t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(piece, pa.int32()), *[pa.array(s, pa.int64()) for s in stats]], names)

    rows = listed.where("part is not null").select("part", "block", "word", "number", "head", "n").repartitionById(n, "part")
    return rows.mapInArrow(run, "block bigint, number binary, head binary, n binary, piece int, total bigint, distinct bigint, once bigint")


def train(texts: DataFrame, ids: np.ndarray, class_counts: np.ndarray, shares: Shares) -> Attention:
    """Attention weights after every training text has been seen once; ``ids`` as from ``head_ids``, ``shares`` from ``log_shares``."""
    model = Attention.start(class_counts, shares=shares)
    tenth = F.col("tenth")
    done = 0
    for share in ROUNDS:
        start = model.flat
        part = texts.where(~F.col("held_out") & (tenth >= done) & (tenth < done + share)).select("heads")
        done += share

        def learn(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            trainer, tokens, chunk = Trainer(Attention(start.copy(), shares)), 0, []
            end = np.array([END], dtype=np.int32)
            for batch in batches:
                for raw in batch.column(0):
                    chunk.append(np.append(ids[from_planes(raw, np.int32) + 1], end))
                    tokens += len(chunk[-1])
                    if len(chunk) == 64:
                        trainer.texts(chunk)
                        chunk = []
            if chunk:
                trainer.texts(chunk)
            if tokens:
                yield _weights(trainer.model.flat, tokens)

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, tokens = 0.0, 0
            for batch in batches:
                for flat, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    total = total + n * flat.values.to_numpy().astype(float)
                    tokens += n
            if tokens:
                yield _weights(total / tokens, tokens)

        learned = part.mapInArrow(learn, "weights array<float>, tokens bigint")
        groups = max(1, math.isqrt(learned.rdd.getNumPartitions()))
        best = learned.repartition(groups).mapInArrow(average, "weights array<float>, tokens bigint").collect()
        if best:
            tokens = sum(r["tokens"] for r in best)
            model = Attention(sum(np.array(r["weights"]) * (r["tokens"] / tokens) for r in best), shares)
    return model


def _weights(flat: np.ndarray, tokens: int) -> pa.RecordBatch:
    row = pa.array([flat.astype(np.float32)], pa.list_(pa.float32()))
    return pa.RecordBatch.from_arrays([row, pa.array([tokens], pa.int64())], ["weights", "tokens"])


@dataclass
class LanguageModel:
    """Everything a scoring task needs but the word counts of its block."""

    attention: np.ndarray
    ids: np.ndarray  # of heads, as from head_ids
    shares: Shares
    head_counts: np.ndarray  # that of head h at h + 1
    unseen: np.ndarray  # share of each head that is set aside for unseen words
    tokens: int  # N, ends included
    distinct: int  # V, the end included
    ends: int


def learn(texts: DataFrame, totals: DataFrame, heads: Heads) -> LanguageModel:
    """The model of the documents' rows of ``number_words`` and the rows of ``total_words``."""
    # at most one row per vocabulary piece reaches the driver
    sums = [F.sum(c).alias(a) for c, a in (("total", "n"), ("distinct", "v"), ("once", "once"))]
    per_head = totals.where("piece is not null").groupBy(F.col("piece").alias("head")).agg(*sums).collect()
    ends = texts.where(~F.col("held_out")).count()
    counts = {r["head"]: r["n"] for r in per_head}
    known = sorted(set(heads.vocabulary.values()))
    ids = head_ids(counts, known)
    mass, once = np.zeros(len(ids)), np.zeros(len(ids))
    for r in per_head:
        mass[r["head"] + 1], once[r["head"] + 1] = r["n"], r["once"]
    class_counts = np.bincount(class_of_ids(np.maximum(ids, END)), weights=mass, minlength=CLASSES)
    class_counts[END] = ends
    shares = log_shares(ids, counts)
    unseen = np.where(mass > 0, np.clip((once + 1) / (mass + 2), 1e-4, 0.9), 1)  # under a head that was not seen no word was
    return LanguageModel(
        train(texts, ids, class_counts, shares).flat, ids, shares, mass, unseen,
        ends + sum(r["n"] for r in per_head), (ends > 0) + sum(r["v"] for r in per_head), ends,
    )


class BlockScorer:
    """Scores the texts of one block after its words' counts are known."""

    def __init__(self, lm: LanguageModel):
        self.lm = lm
        self.attention = Attention(lm.attention, lm.shares)
        self.floor = math.log10(lm.tokens + 0.5 * (lm.distinct + 1)) if lm.tokens else math.log10(0.5)
        self.new_block(np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64))

    def new_block(self, numbers: np.ndarray, heads: np.ndarray, counts: np.ndarray) -> None:
        """The block's words: numbers from 0 on in any order, heads, and counts in all training texts."""
        lm, order = self.lm, np.argsort(numbers)
        c = counts[order].astype(float)
        # of every word: id of its head, log10 given its head, base log10, is it known
        head = heads[order] + 1
        self.ids, unseen = lm.ids[head], lm.unseen[head]
        within = np.where(c > 0, (1 - unseen) * c / np.maximum(lm.head_counts[head], 1), unseen)
        self.within, self.base, self.known = np.log10(within), np.log10(c + 0.5) - self.floor, c > 0

    def score(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, base score, score) of each text, given as the numbers of its words."""
        lengths = np.array([len(x) for x in texts])
        at = np.concatenate(texts)
        text = np.repeat(np.arange(len(texts)), lengths)
        n = len(texts)
        total = lambda values: np.bincount(text, weights=values[at], minlength=n)
        base = total(self.base) + (math.log10(self.lm.ends + 0.5) - self.floor)
        known = total(self.known).astype(np.int64) + (self.lm.ends > 0)
        end = np.array([END], dtype=np.int32)
        x, y, owner = windows([np.append(self.ids[numbers], end) for numbers in texts])
        per_window = self.attention.log10_targets(x, y).reshape(-1, STEP).sum(axis=1)
        return lengths + 1, known, base, total(self.within) + np.bincount(owner, weights=per_window, minlength=n)


def score_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 64) -> DataFrame:
    """Learn from the rows outside the held-out fold and score every row.

    Result: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null and empty texts have one token, the
    end. Null ids belong to no held-out fold, so their texts are learned from. Repeated rows are counted and scored as
    often as they stand there; an empty table gives an empty result; other columns are not read. Equal texts have equal scores up to float32 rounding. Words are identified
    by 64-bit hashes in the count tables.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = Heads.from_file(vocabulary_path)
    listed = cut(number_words(prepare(docs, id_col, text_col), heads, n), "lm-words")
    totals = cut(total_words(listed, n), "lm-counts")
    texts = listed.where("part is null")
    model = learn(texts, totals, heads)
    lm = docs.sparkSession.sparkContext.broadcast(vars(model))  # bounded by the vocabulary and the weights

    id_type = texts.schema["doc_id"].dataType.simpleString()
    none = F.lit(None)
    word_rows = totals.where("piece is null").select("block", F.lit(0).alias("role"), none.cast(id_type).alias("doc_id"), none.cast("boolean").alias("held_out"), none.cast("binary").alias("numbers"), "number", "head", "n")
    text_rows = texts.select("block", F.lit(1).alias("role"), "doc_id", "held_out", "numbers", *[none.cast("binary").alias(c) for c in ("number", "head", "n")])
    rows = word_rows.unionByName(text_rows).repartition(n, "block").sortWithinPartitions("block", "role")
    fields = f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = BlockScorer(LanguageModel(**lm.value))
        kinds = (np.uint32, np.int32, np.int64)
        block, words, ready = None, [[], [], []], False
        for batch in batches:
            blocks, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(roles) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if blocks[a] != block:
                    block, words, ready = blocks[a], [[], [], []], False
                part = batch.slice(a, b - a)
                if roles[a] == 0:
                    for found, column, kind in zip(words, part.columns[5:], kinds, strict=True):
                        found += [from_planes(raw, kind) for raw in column]
                    continue
                if not ready:
                    scorer.new_block(*[np.concatenate([np.empty(0, dtype=kind), *found]) for found, kind in zip(words, kinds, strict=True)])
                    words, ready = [[], [], []], True
                for i in range(0, part.num_rows, chunk):
                    some = part.slice(i, min(chunk, part.num_rows - i))
                    tokens, known, base, score = scorer.score([from_planes(raw, np.uint32) for raw in some.column(4)])
                    columns = [some.column(2), some.column(3), tokens, known, np.full(len(tokens), scorer.lm.tokens), base, score]
                    types = [some.column(2).type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in fields.split(", ")])

    return rows.mapInArrow(run, fields)
