"""Order MinHash fingerprints: signatures that are sensitive to edit distance.

The k-mers of a text are numbered by occurrence, so a repeated k-mer counts as often as it stands there. Each of the
``slots`` orders ranks the numbered k-mers by hash, turned by a fixed angle of the hash circle; the ``pick`` smallest are
put back into text order and hashed as a tuple. Two texts agree in a slot if the same k-mers are smallest and stand in
the same order, which moving or editing a passage breaks. All orders share one sort, so a text of n characters costs
O(n log n) however many slots there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.shared import mix64

_MUL = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class OrderMinHash:
    k: int = 7  # code points per k-mer; a shorter text is one k-mer
    pick: int = 2  # k-mers per tuple
    slots: int = 64

    def signature(self, text: str) -> np.ndarray:
        """``slots`` 32-bit numbers; all 0 for the empty text."""
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        if len(codes) == 0:
            return np.zeros(self.slots, dtype=np.uint32)
        k = min(self.k, len(codes))
        n = len(codes) - k + 1
        mer = np.full(n, k, dtype=np.uint64)
        for i in range(k):
            mer = (mer * _MUL) ^ codes[i : i + n]
        mer = mix64(mer)
        # the low bits of a hash make room for the position, so one plain sort groups equal k-mers in text order
        low = np.uint64((1 << n.bit_length()) - 1)
        at = np.arange(n, dtype=np.uint64)
        grouped = np.sort((mer & ~low) | at)
        where = (grouped & low).astype(np.int64)
        same = grouped & ~low
        first = np.arange(n)
        first[1:][same[1:] == same[:-1]] = 0
        occurrence = np.arange(n) - np.maximum.accumulate(first)
        numbered = mix64(mer[where] + occurrence.astype(np.uint64) * _MUL + np.uint64(1))
        circle = np.sort((numbered & ~low) | where.astype(np.uint64))
        starts = np.arange(self.slots, dtype=np.uint64) * np.uint64((1 << 64) // self.slots)
        chosen = np.searchsorted(circle, starts)[:, None] + np.arange(self.pick)
        order = np.sort(circle[chosen % n] & low, axis=1).astype(np.int64)
        out = np.full(self.slots, self.pick, dtype=np.uint64)
        for i in range(self.pick):
            out = mix64(out * _MUL ^ mer[order[:, i]])
        return (out >> np.uint64(32)).astype(np.uint32)


def to_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of slots in which two signatures agree."""
    return float(np.mean(a == b))


def with_next(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """(bucket, context, doc_id, text), sorted so that each row's successor in descending id order follows it.

    Ids are cut into ranges of about equal counts. The first row of each range is sent a second time, as ``context``,
    to the end of the range before it (that of the first range to the last), so every range can be worked through
    alone. Ties stand in descending order of text; null ids come last. The plan holds one number per range on the
    driver.
    """
    thin = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = thin.select("doc_id").where("doc_id IS NOT NULL")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0] if buckets > 1 else []
    cuts = sorted(set(cuts or []))
    bound = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(bound, lambda c: c < F.col("doc_id"))))
    heads = {r["bucket"]: r["head"] for r in thin.select("doc_id").groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    before = {b: order[i - 1] for i, b in enumerate(order)}  # the range whose last row this range's first row follows
    head_ids = [h for h in heads.values() if h is not None]
    is_head = F.col("doc_id").isin(head_ids) if head_ids else F.lit(False)
    is_head = F.coalesce(is_head, F.lit(False)) | F.col("doc_id").isNull()
    moved = F.element_at(F.create_map(*[F.lit(x) for b, p in before.items() for x in (b, p)]), F.col("bucket")) if before else F.lit(0)
    here = F.struct(F.col("bucket").cast("int").alias("bucket"), F.lit(0).alias("context"))
    there = F.struct(moved.cast("int").alias("bucket"), F.lit(1).alias("context"))
    sent = thin.withColumn("bucket", bucket).withColumn("to", F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here))))
    rows = sent.select("to.bucket", "to.context", "doc_id", "text")
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "context", F.col("doc_id").desc_nulls_last(), F.col("text").desc())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", method: OrderMinHash = OrderMinHash(), chunk: int = 256) -> DataFrame:
    """Fingerprint of every text, of its edited text and their likeness to each other and to the next document's.

    The edited text has the last third of its code points (floor) replaced by the first as many of the next document in
    descending id order; the last document is followed by the first. Result: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. Null texts are empty; empty texts have the all-zero
    fingerprint; a single document is its own successor; rows with equal ids are ordered by text; rows that repeat
    follow each other; an empty table gives an empty result; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        last = None  # (bucket, id, text, signature) of the row whose successor comes next

        def finish(text: str, sig: np.ndarray) -> None:
            _, key, own, own_sig = last
            cut_off = len(own) // 3
            edited = own[: len(own) - cut_off] + text[:cut_off]
            edited_sig = method.signature(edited)
            sha = hashlib.sha256(edited.encode()).hexdigest()
            out.append((key, len(own), sha, to_text(own_sig), to_text(edited_sig), likeness(own_sig, edited_sig), likeness(own_sig, sig)))

        def batch_out() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            types = [key_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in fields.split(", ")])

        for batch in batches:
            key_type = batch.schema.field(2).type
            buckets, context, keys, texts = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                bucket, extra, text = buckets[i].as_py(), context[i].as_py(), texts[i].as_py()
                if extra and (last is None or last[0] != bucket):
                    continue  # only the first context row of a range is a successor
                sig = method.signature(text)
                if last is not None and last[0] == bucket:
                    finish(text, sig)
                last = None if extra else (bucket, keys[i].as_py(), text, sig)
                if len(out) >= chunk:
                    yield batch_out()
        if out:
            yield batch_out()

    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_next(docs, id_col, text_col, buckets).mapInArrow(run, fields)
