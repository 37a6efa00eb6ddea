"""Toxicity scores over deobfuscated text.

A noisy-channel decoder restores disguised words first. The letters that a writer may have meant form a lattice over the
written characters: look-alike digits and symbols, separators inside a word, spelled-out letters and stretched
repetitions. Viterbi search over the lattice maximises channel cost plus a character trigram model that is counted over
the whole corpus. Words and word beginnings of the restored text are then scored by a logistic model, which is fitted on
a bounded sample of labelled rows, both classes with the same total weight. Its bias is then moved so that a score of
0.5 is the cut that splits the classes best in scores from models that did not see the row.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.shared import cut, hash52, lean

SAMPLE_PER_LABEL = 8_000  # labelled rows of each class that the classifier is fitted on, at most
FEATURES = 2_000  # words and word beginnings that the classifier knows
PREFIXES = (3, 4, 5)
FOLDS = 4  # parts of the sample, each scored by a model of the others to find the cut

# Letters that a look-alike stands for.
LOOK_ALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i",
}
SEPARATORS = frozenset(".-_*~'`^,:;/\\ ")
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß"
LOOK_COST, DROP_COST, KEEP_RUN_COST, SQUEEZE_COST = 1.5, 1.0, 1.0, 0.5

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_LOOK = re.escape("".join(c for c in LOOK_ALIKE if not c.isalnum()))
_EDGE_BUT_LOOK_ALIKE = re.compile(rf"^(?:(?![{_LOOK}])[\W_])+|(?:(?![{_LOOK}])[\W_])+$")
_STRETCHED = re.compile(r"(.)\1\1")
_LETTER = re.compile(r"[^\W\d_]")


class CharModel:
    """Character trigrams over letters, word edge and other; add-half smoothing. Trained from counts by symbol triple."""

    size = len(LETTERS) + 2  # letters, word edge (0), anything else (last)

    def __init__(self, counts: dict[int, int]):
        table = np.full(self.size**3, 0.5)
        for triple, n in counts.items():
            table[triple] += n
        table = table.reshape(self.size, self.size, self.size)
        self.cost = -np.log(table / table.sum(axis=2, keepdims=True))
        self.symbol = {c: i + 1 for i, c in enumerate(LETTERS)}

    @classmethod
    def symbol_table(cls) -> np.ndarray:
        """Symbol of each code point below 0x250; larger ones are 'other'."""
        table = np.full(0x250, cls.size - 1, dtype=np.int64)
        for i, c in enumerate(LETTERS):
            if ord(c) < 0x250:
                table[ord(c)] = i + 1
        for c in " \t\n\r\x0b\x0c":
            table[ord(c)] = 0
        return table


def char_counts(texts: DataFrame, text_col: str = "text") -> dict[int, int]:
    """Trigram counts of the lower-cased letters of all texts; at most ``CharModel.size``**3 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = CharModel.symbol_table(), CharModel.size
        total = np.zeros(n**3, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                code = np.frombuffer(f"  {text.lower()} ".encode("utf-32-le"), dtype="<u4")
                s = np.where(code < len(table), table[np.minimum(code, len(table) - 1)], n - 1)
                total += np.bincount((s[:-2] * n + s[1:-1]) * n + s[2:], minlength=n**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["triple", "n"])

    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "triple bigint, n bigint")
    return {r["triple"]: r["n"] for r in rows.groupBy("triple").agg(F.sum("n").alias("n")).collect()}


class Deobfuscator:
    """Restores the words of a text. Plain words pass through; disguised ones are decoded once and remembered."""

    def __init__(self, model: CharModel):
        self.model = model
        self.known: dict[tuple[str, bool], str] = {}

    def options(self, text: str, i: int, run: int, drop: bool = True) -> list[tuple[str, float, int]]:
        """Arcs at position i, where a run of equal characters begins or goes on: (letters meant, channel cost, characters used).

        Without ``drop``, a look-alike always stands for a letter."""
        c = text[i]
        if c not in self.model.symbol and (c.isalpha() or unicodedata.category(c)[0] == "M"):  # letters of other scripts stay as they are
            return [(c, 0.0, 1)]
        meant = [(c, 0.0)] if c in self.model.symbol else [(x, LOOK_COST) for x in LOOK_ALIKE.get(c, "")]
        out = []
        for letter, cost in meant:
            out.append((letter, cost, 1))
            if run >= 2:  # a stretched letter: the whole run is one or two letters
                out.append((letter, cost + SQUEEZE_COST, run))
                out.append((letter * 2, cost + KEEP_RUN_COST, run))
        if c in SEPARATORS or (c in LOOK_ALIKE and drop) or not meant:
            out.append(("", DROP_COST, 1))
            if c == " ":
                out.append((" ", 0.0, 1))
        return out

    def decode(self, text: str, drop: bool = True) -> str:
        """The restored text of least cost: Viterbi over (position, last two symbols)."""
        symbol, cost = self.model.symbol, self.model.cost
        best: list[dict[tuple[int, int], tuple[float, tuple | None]]] = [{} for _ in range(len(text) + 1)]
        runs = run_lengths(text)
        best[0][(0, 0)] = (0.0, None)  # value: (cost, link); link: (letters, link before)
        for i in range(len(text)):
            if not best[i]:
                continue
            arcs = self.options(text, i, runs[i], drop)
            for (a, b), (so_far, link) in best[i].items():
                for letters, channel, used in arcs:
                    x, y, total = a, b, so_far + channel
                    for letter in letters:
                        s = symbol.get(letter, 0 if letter == " " else self.model.size - 1)
                        total += cost[x, y, s]
                        x, y = y, s
                    old = best[i + used].get((x, y))
                    if old is None or total < old[0]:
                        best[i + used][(x, y)] = (total, (letters, link) if letters else link)
            best[i] = {}
        if not best[-1]:
            return text
        ends = [(total + cost[a, b, 0], link) for (a, b), (total, link) in best[-1].items()]
        link = min(ends, key=lambda e: e[0])[1]
        parts = []
        while link is not None:
            parts.append(link[0])
            link = link[1]
        return "".join(reversed(parts)).strip()

    def word(self, raw: str) -> str:
        """One white-space word, restored; plain words only lose their edges' punctuation and their case.

        Look-alikes at the edges stay for the lattice, which may drop them (boat!) or not ($h!+)."""
        low = raw.lower()
        core = _EDGE.sub("", low)
        if not _LETTER.search(core):
            return core
        wide = _EDGE_BUT_LOOK_ALIKE.sub("", low)
        return wide if wide.isalpha() and not _STRETCHED.search(wide) else self.remembered(wide, True)

    def literal(self, raw: str) -> str:
        """A second reading of a word with look-alikes, in which each of them stands for a letter (a$$, 455); empty for other words."""
        wide = _EDGE_BUT_LOOK_ALIKE.sub("", raw.lower())
        return self.remembered(wide, False) if len(wide) > 1 and not LOOK_ALIKE.keys().isdisjoint(wide) else ""

    def remembered(self, text: str, drop: bool) -> str:
        if (text, drop) not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[text, drop] = self.decode(text, drop)
        return self.known[text, drop]

    def readings(self, words: list[str]) -> list[str]:
        """The restored words of a text and the second readings of its words."""
        return self.restore(words) + [x for raw in words for x in self.literal(raw).split()]

    def restore(self, words: list[str]) -> list[str]:
        """All words of a text; runs of three or more single letters are read together as spelled-out words."""
        out, i = [], 0
        while i < len(words):
            j = i
            while j < len(words) and len(words[j]) == 1 and (words[j].isalpha() or words[j] in LOOK_ALIKE):
                j += 1
            if j - i >= 3:
                out += self.decode("".join(words[i:j]).lower()).split()
                i = j
            else:
                out += self.word(words[i]).split()
                i += 1
        return out


def run_lengths(text: str) -> list[int]:
    """How many equal characters follow from each position, its own included."""
    out = [1] * len(text)
    for i in range(len(text) - 2, -1, -1):
        if text[i] == text[i + 1]:
            out[i] = out[i + 1] + 1
    return out


def split_words(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().split()]


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return ["=" + word, *[f"{n}^{word[:n]}" for n in PREFIXES if len(word) > n]]


@dataclass
class ToxicityModel:
    """Char trigram counts, feature weights and bias: everything a task needs to score a text."""

    counts: dict[int, int]
    weights: dict[str, float]
    bias: float

    def scorer(self):
        reader = Deobfuscator(CharModel(self.counts))
        weights, bias = self.weights, self.bias
        plain: set[str] = set()  # written words without any known feature
        hits: dict[str, list[str]] = {}  # written words with some

        def found(raw: str) -> list[str]:
            return [f for w in [*reader.word(raw).split(), *reader.literal(raw).split()] for f in features(w) if f in weights]

        def score(text: str | None) -> float:
            nonlocal plain
            words = split_words(text)
            distinct = set(words)
            for raw in distinct - plain:
                if raw not in hits:
                    known = found(raw)
                    if known:
                        hits[raw] = known
                    else:
                        plain.add(raw)
            have = {f for raw in distinct.intersection(hits) for f in hits[raw]}
            if _spelled(words):
                have |= {f for w in reader.restore(words) for f in features(w) if f in weights}
            if len(plain) > 1_000_000 or len(hits) > 1_000_000:
                plain = set()
                hits.clear()
            return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, bias + sum(weights[f] for f in have)))))

        return score


def _spelled(words: list[str]) -> bool:
    """Are three single letters in a row?"""
    n = 0
    for w in words:
        n = n + 1 if len(w) == 1 else 0
        if n >= 3:
            return True
    return False


def labelled_sample(labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, fold: int = 5, held: int = 0) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic) and the rows of each class in all: of at most about ``per_label`` rows of each class outside the held-out fold, by hash order.

    Rows with a null label or id, and ids whose rows disagree, are left out.
    """
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    rows = rows.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) != held)
    rows = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    rows = cut(rows.withColumn("h", hash52(F.col("doc_id"), salt="toxicity")), "labels")
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {t: min(1.0, per_label / n) for t, n in counts.items()}
    keep = F.lit(False)
    for t, s in share.items():
        keep = keep | ((F.col("toxic") == t) & (F.col("h") < int(s * (1 << 52))))
    return cut(rows.where(keep).select("doc_id", "toxic"), "label-sample"), counts


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Count characters over all texts, choose features and fit the logistic weights on the labelled sample."""
    sample, classes = labelled_sample(labels)
    counts = char_counts(docs, text_col)
    if not classes:
        return ToxicityModel(counts, {}, 0.0)
    # at most 2 * SAMPLE_PER_LABEL ids, so the broadcast is bounded and the texts do not move
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    train = thin.join(F.broadcast(sample), "doc_id").select("toxic", "text")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Deobfuscator(CharModel(counts))
        seen = (Counter(), Counter())
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update({f for w in reader.readings(split_words(text)) for f in features(w)})
        for toxic in (0, 1):
            names = list(seen[toxic])
            for i in range(0, len(names), 50_000):
                part = names[i : i + 50_000]
                n = pa.array([seen[toxic][f] for f in part], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic] * len(part), pa.int32()), n], ["feature", "toxic", "n"])

    rows = train.mapInArrow(lean(tally), "feature string, toxic int, n bigint").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).cast("double").alias("a"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).cast("double").alias("b"),
    )
    size = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = float(size.get(1, 0)), float(size.get(0, 0))
    prior = math.log((classes.get(1, 0) + 0.5) / (classes.get(0, 0) + 0.5))
    if not pos or not neg:
        return ToxicityModel(counts, {}, prior)
    # signed root of the log-likelihood ratio of "feature occurs" between the classes; the strongest features stay
    odds = F.log((F.col("a") + 0.1) / (pos + 0.2)) - F.log((F.col("b") + 0.1) / (neg + 0.2))
    best = rows.where("a + b >= 3").withColumn("gain", F.abs(odds) * (F.col("a") / pos + F.col("b") / neg)).where(F.abs(odds) > 1.0)
    names = [r["feature"] for r in best.orderBy(F.desc("gain"), "feature").limit(FEATURES).collect()]
    place = {f: i for i, f in enumerate(names)}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Deobfuscator(CharModel(counts))
        for batch in batches:
            found = [
                sorted({place[f] for w in reader.readings(split_words(t)) for f in features(w) if f in place}) for t in batch.column(1).to_pylist()
            ]
            fold = [zlib.crc32((t or "").encode()) % FOLDS for t in batch.column(1).to_pylist()]  # copies of a text share a fold
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fold, pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["toxic", "fold", "hits"])

    table = train.mapInArrow(lean(hits), "toxic int, fold int, hits array<int>").toArrow()
    toxic, fold, known = (table.column(c).to_pylist() for c in ("toxic", "fold", "hits"))
    weights, bias = logistic(toxic, known, len(names))
    bias -= balanced_cut(toxic, out_of_fold(toxic, known, fold, len(names)))
    return ToxicityModel(counts, {f: float(w) for f, w in zip(names, weights, strict=True) if abs(w) > 1e-6}, float(bias))


def logistic(labels: list[int], hits: list[list[int]], n: int, rounds: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 features by accelerated gradient descent; both classes have the same total weight."""
    y = np.array(labels, dtype=float)
    pos = y.sum()
    share = np.where(y == 1, 0.5 / max(pos, 1.0), 0.5 / max(len(y) - pos, 1.0))  # of each row in the loss
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    col = np.array([c for h in hits for c in h], dtype=np.int64)
    # the step fits the largest row norm, so the descent is stable
    size = 1.0 + np.bincount(row, minlength=len(y)).max(initial=0)
    step = 4.0 / size
    w, v, bias, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(rounds):
        wn, bn = w + 0.9 * v, bias + 0.9 * vb
        z = bn + np.bincount(row, weights=wn[col], minlength=len(y))
        gap = share * (1.0 / (1.0 + np.exp(-z)) - y)
        g = np.bincount(col, weights=gap[row], minlength=n) + ridge * wn
        v, vb = 0.9 * v - step * g, 0.9 * vb - step * gap.sum()
        w, bias = w + v, bias + vb
    return w, bias


def out_of_fold(labels: list[int], hits: list[list[int]], fold: list[int], n: int) -> np.ndarray:
    """Log odds of every row under a model fitted on the rows of the other folds."""
    at = np.array(fold)
    out = np.zeros(len(at))
    for f in range(FOLDS):
        inside, outside = np.flatnonzero(at == f), np.flatnonzero(at != f)
        w, bias = logistic([labels[i] for i in outside], [hits[i] for i in outside], n)
        out[inside] = [bias + w[hits[i]].sum() for i in inside]
    return out


def balanced_cut(labels: list[int], odds: np.ndarray) -> float:
    """The log odds that split the classes best: the least sum of both error shares, in the middle of the gap where it lies."""
    y = np.array(labels)[np.argsort(odds, kind="stable")]
    ranked = np.sort(odds, kind="stable")
    pos, neg = max(1, int(y.sum())), max(1, int((y == 0).sum()))
    # cutting before place i: positives below it are missed, negatives from it on are rejected
    missed = np.concatenate([[0], np.cumsum(y == 1)]) / pos
    rejected = 1.0 - np.concatenate([[0], np.cumsum(y == 0)]) / neg
    edge = np.concatenate([[ranked[0] - 1.0], (ranked[1:] + ranked[:-1]) / 2, [ranked[-1] + 1.0]])
    real = np.concatenate([[True], ranked[1:] > ranked[:-1], [True]])  # equal odds are not split
    cost = np.where(real, missed + rejected, np.inf)
    return float(edge[int(np.argmin(cost))])


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", fold: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts get the score of a text without features; a null id is in no fold (held_out false); repeated
    rows get equal scores; an empty table gives an empty result; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            out = [score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    scored = thin.mapInArrow(lean(run), f"doc_id {id_type}, score double")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text is not predicted toxic, with all their columns (each row is judged by its own text)."""
    model = fit(docs, labels, id_col, text_col)
    schema = docs.schema
    at = schema.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            keep = pa.array([score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(lean(run), schema)
