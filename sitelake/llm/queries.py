"""Registered queries of the training-data operators, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.llm import attention_lm, bpe, contamination, exact_dedup, jaccard_join, merkle, mixing, order_minhash, ranked_search, sharding, substring_dedup, toxicity, warc
from sitelake.llm.shared import shared_path, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file, unless SITELAKE_TOKENIZER names another."""
    import public_tokenizers

    return os.environ.get("SITELAKE_TOKENIZER") or public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"), either=True)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.archive_pages(table(spark, sf_dir, "pages"))
    return warc.read_records(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, shared_path(spark, "digest-index"))
    return exact_dedup.dedup_report(table(spark, sf_dir, "documents"), index)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.shard_documents(docs, sharding.standard_tree(16), sharding.standard_tree(17))


def op10_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_report(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mixing": op2_mixing,
    "op3_warc": op3_warc,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_bpe": op5_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_fingerprints": op7_fingerprints,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_sharding": op9_sharding,
    "op10_attention_lm": op10_attention_lm,
    "op11_decontamination": op11_decontamination,
    "op12_merkle": op12_merkle,
    "op13_ranked_search": op13_ranked_search,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text in DuckDB, which lacks it: bytes are mixed in one after the other, each followed by eight shifts."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: list_concat([ord(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))"
    fold = "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), {fold}), 4294967295)"


def _merkle_sql(levels: int = 7, top_levels: int = 4) -> str:
    """Trees of up to 8 ** levels leaves and 8 ** top_levels languages, level by level; then every leaf's way up."""

    def enc(x: str) -> str:
        return f"coalesce(octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(enc(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    tampered = f"translate(text, '{UPPER}', '{LOWER}')"
    ctes = [
        f"""d AS (SELECT doc_id, lang, {leaf("text")} AS leaf, {_crc32("doc_id::VARCHAR")} % 3 = 0 AS hit, {leaf(tampered)} AS low FROM documents)""",
        """l AS (SELECT doc_id, leaf, CASE WHEN hit THEN low ELSE leaf END AS cur, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
               row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d)""",
        "n0 AS (SELECT tree, idx, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM l)",
    ]

    def up(nodes: str, sibs: str, above: str) -> None:
        run = "PARTITION BY tree, idx // 8 ORDER BY idx ROWS BETWEEN"
        ctes.append(
            f"""{sibs} AS (SELECT tree, idx, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
                coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {nodes} WHERE n > 1)"""
        )
        ctes.append(
            f"""{above} AS (SELECT tree, idx, h, count(*) OVER (PARTITION BY tree) AS n FROM (
                SELECT tree, idx // 8 AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h FROM {nodes} WHERE n > 1 GROUP BY 1, 2
                UNION ALL SELECT tree, idx, h FROM {nodes} WHERE n = 1))"""
        )

    for k in range(levels):
        up(f"n{k}", f"s{k}", f"n{k + 1}")
    ctes.append(f"t0 AS (SELECT 0 AS tree, tree AS idx, h, count(*) OVER () AS n FROM n{levels})")
    for k in range(top_levels):
        up(f"t{k}", f"u{k}", f"t{k + 1}")
    ctes.append("w0 AS (SELECT doc_id, leaf, tree, idx, cur, '' AS proof FROM l)")
    for k in range(levels):
        ctes.append(
            f"""w{k + 1} AS (SELECT doc_id, leaf, w.tree, w.idx // 8 AS idx, CASE WHEN s.a IS NULL THEN cur ELSE sha256(s.a || cur || s.b) END AS cur,
                proof || coalesce(s.a || s.b, '') AS proof FROM w{k} w LEFT JOIN s{k} s ON s.tree = w.tree AND s.idx = w.idx)"""
        )
    ctes.append(f"x0 AS (SELECT doc_id, leaf, t.h AS subroot, w.tree AS idx, cur, proof FROM w{levels} w JOIN t0 t ON t.idx = w.tree)")
    for k in range(top_levels):
        ctes.append(
            f"""x{k + 1} AS (SELECT doc_id, leaf, subroot, x.idx // 8 AS idx, CASE WHEN s.a IS NULL THEN cur ELSE sha256(s.a || cur || s.b) END AS cur,
                proof || coalesce(s.a || s.b, '') AS proof FROM x{k} x LEFT JOIN u{k} s ON s.idx = x.idx)"""
        )
    return (
        "WITH " + ",\n".join(ctes) + f"""
        SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = t.h AS verified
        FROM x{top_levels}, t{top_levels} t"""
    )


_LOW_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{contamination.WORD}')"

_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op11_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LOW_WORDS} AS ws FROM documents),
        i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_LOW_WORDS} AS ws FROM benchmark),
        iw AS (SELECT DISTINCT item, least(10, len(ws)) AS k, array_to_string(ws[s : s + least(10, len(ws)) - 1], ' ') AS g
               FROM i, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(s) WHERE len(ws) > 0),
        dw AS (SELECT r, s, k, array_to_string(ws[s : s + k - 1], ' ') AS g
               FROM d, (SELECT DISTINCT k FROM iw), unnest(range(1, greatest(len(ws) - k + 1, 0) + 1)) t(s)),
        hit AS (SELECT r, s, dw.k, item FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k),
        places AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + k)) u(p) GROUP BY r),
        names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN places USING (r) LEFT JOIN names USING (r)""",
    "op12_merkle": _merkle_sql(),
    "op13_ranked_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
        total AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS length FROM d WHERE len(ws) > 0),
        i AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS ws FROM benchmark),
        it AS (SELECT DISTINCT i, item_id, unnest(ws) AS t FROM i),
        tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM it) GROUP BY r, t),
        w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t, n_docs),
        m AS (SELECT r, doc_id, 50 + (50 * len(ws)::BIGINT * n_docs) // length AS m FROM d, total WHERE len(ws) > 0),
        s AS (SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
              FROM it JOIN w USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY i, item_id, r, doc_id),
        ranked AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""",
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
        g AS (SELECT payload_digest, max(page_id) AS keep FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN keep END AS refers_to
        FROM d LEFT JOIN g USING (payload_digest)""",
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
}
