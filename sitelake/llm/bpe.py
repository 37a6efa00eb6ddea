"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round every adjacent pair is looked up by binary search in the
sorted pair keys of the merge table, the lowest rank of each word is found by a segmented minimum, and all words merge
their lowest pair at once; words without a known pair leave the array. The vocabulary file of a public tokenizer is a
parameter; nothing is trained.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.llm.shared import lean

_NONE = np.int64(1 << 40)  # rank of a pair that is not in the merge table

# Fixed values of the byte-level scheme: white space, and the word pattern that splits a text before merging.
_SPACE = r"\t-\r \x85\xa0  -     　"
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^%(s)s\p{L}\p{N}]+|[%(s)s]+(?![^%(s)s])|[%(s)s]+" % {"s": _SPACE}

CACHED_WORDS = 100_000  # words a task remembers before it starts anew
CHUNK_CHARS = 500_000  # characters that are encoded together


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BpeTables:
    """Merge table and vocabulary of a tokenizer file: pair keys in sorted order with their ranks and results."""

    def __init__(self, source: str):
        spec = json.loads(source)
        vocab = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        self.byte_id = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        result = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.results = key[order], order.astype(np.int64), result[order]
        to_byte = {c: b for b, c in enumerate(alphabet)}
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.words = regex.compile(_WORDS)
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    @classmethod
    def of(cls, parts: dict) -> BpeTables:
        """Tables from the ``vars`` of others."""
        tables = cls.__new__(cls)
        vars(tables).update(parts)
        return tables

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one after the other; number of ids of each word)."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []
        while len(symbols):
            key = np.full(len(symbols), -1, dtype=np.int64)
            inner = word[1:] == word[:-1]
            key[:-1][inner] = symbols[:-1][inner] * self.size + symbols[1:][inner]
            found = np.searchsorted(self.keys, key)
            found[found == len(self.keys)] = 0
            rank = np.where(self.keys[found] == key, self.ranks[found], _NONE)
            start = np.flatnonzero(np.concatenate(([True], ~inner)))
            least = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(symbols))))
            open_ = least < _NONE
            if not open_.all():
                done_symbols.append(symbols[~open_])
                done_words.append(word[~open_])
            at = np.flatnonzero(open_ & (rank == least))
            if len(at) == 0:
                break
            # overlapping occurrences (a a a): the first, third ... of a run merge, as from left to right
            run_start = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
            in_run = np.arange(len(at)) - np.repeat(run_start, np.diff(np.append(run_start, len(at))))
            at = at[in_run % 2 == 0]
            symbols[at] = self.results[found[at]]
            open_[at + 1] = False
            symbols, word = symbols[open_], word[open_]
        if not done_symbols:
            return np.empty(0, dtype=np.int64), lengths
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(words))


class BpeCodec:
    """Encodes and decodes texts; remembers the ids of a bounded number of words."""

    def __init__(self, tables: BpeTables):
        self.tables = tables
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start = np.empty(0, dtype=np.int64)
        self.count = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.int64)
        for token, i in self.tables.special.items():
            self._learn([token], np.array([i]), np.array([1]))

    def _learn(self, words: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        for w in words:
            self.known[w] = len(self.known)
        self.start = np.append(self.start, len(self.ids) + np.cumsum(count) - count)
        self.count = np.append(self.count, count)
        self.ids = np.append(self.ids, ids)

    def _words(self, text: str) -> list[str]:
        t = self.tables
        if t.split is None or not t.split.search(text):
            return t.words.findall(text)
        out, at = [], 0
        for m in t.split.finditer(text):
            out += t.words.findall(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + t.words.findall(text[at:])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > CACHED_WORDS:
            self._forget()
        lists = [self._words(x) for x in texts]
        flat = [w for x in lists for w in x]
        new = [w for w in dict.fromkeys(flat) if w not in self.known]
        if new:
            self._learn(new, *self.tables.encode_words([w.encode() for w in new]))
        place = np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))
        count = self.count[place]
        ends = np.cumsum(count)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[place] - (ends - count), count)
        ids = self.ids[at].astype("<u4")
        words = np.cumsum([0, *map(len, lists)])
        bounds = np.concatenate(([0], ends))[words]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        known = self.tables.bytes
        return b"".join([known[i] for i in ids.tolist()]).decode("utf-8", errors="replace")


def tokenizer_source(path: str) -> str:
    """The text of a tokenizer file, read on the driver (a file of a few MB)."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with a bounded number of bytes (a single longer text is a range of its own)."""
    sizes = np.array([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(1)], dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > CHUNK_CHARS:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _shared_tables(spark: SparkSession, path: str):
    """The tables, made once, as plain data: tasks neither parse the file nor need the package installed."""
    return spark.sparkContext.broadcast(vars(BpeTables(tokenizer_source(path))))


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept columns..., ids array<int>, n_tokens) of every row; null texts are empty and give no ids."""
    source = _shared_tables(docs.sparkSession, tokenizer_path)
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    kept = "".join(f", {c} {thin.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BpeCodec(BpeTables.of(source.value))
        for whole in batches:
            for a, b in _chunks(whole):
                batch = whole.slice(a, b - a)
                ids = codec.encode([t or "" for t in batch.column(1).to_pylist()])
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).astype(np.int32)))
                count = pa.array([len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], lists, count], ["doc_id", *keep, "ids", "n_tokens"])

    id_type = thin.schema["doc_id"].dataType.simpleString()
    return thin.mapInArrow(lean(run), f"doc_id {id_type}{kept}, ids array<int>, n_tokens bigint")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give the empty text."""
    source = _shared_tables(encoded.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BpeCodec(BpeTables.of(source.value))
        for batch in batches:
            texts = [codec.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(lean(run), f"doc_id {id_type}, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text; returns doc_id, n_tokens, ids_sha256 (unsigned 32-bit LE), decoded_sha256.

    Null and empty texts have no ids. Strings of special tokens in a text become those tokens. Repeated rows come out
    as often as they go in, null ids stay null, an empty table gives an empty result, other columns are not read.
    """
    source = _shared_tables(docs.sparkSession, tokenizer_path)
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = thin.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BpeCodec(BpeTables.of(source.value))
        for whole in batches:
            for a, b in _chunks(whole):
                batch = whole.slice(a, b - a)
                ids = codec.encode([t or "" for t in batch.column(1).to_pylist()])
                count = pa.array([len(x) for x in ids], pa.int64())
                digest = pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string())
                decoded = pa.array([hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), count, digest, decoded], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return thin.mapInArrow(lean(run), f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
