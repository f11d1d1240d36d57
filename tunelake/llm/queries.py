"""The registered queries of the operators, and SQL where SQL can express them.

Each query applies its operator to the whole of its table and brings the result into the form that
the contract of the query fixes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.llm import (
    chat, exact_dedup, infill, licenses, mixing, neighbours, ngram_join, packing, prefix_trie,
    quality, suffix_dedup, topk, warc,
)
from tunelake.llm.common import read
from tunelake.session import scratch_path


def op1_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document: its class of connected documents and its number of links. Classes
    may share an id, as ids may be null or repeated; ``root`` tells them apart."""
    return ngram_join.near_duplicates(read(spark, sf, "documents")).select(
        F.col("__id").alias("doc_id"), "class_id", "class_size", "text_class", "n_links", "root")


def op2_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 highest scores of every twentieth vector."""
    return topk.top_k(read(spark, sf, "embeddings"), F.expr("vec_id % 20 = 0"))


def op3_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document; of equal texts the one with the largest doc_id stays."""
    groups = exact_dedup.duplicate_groups(read(spark, sf, "documents"), keep="largest")
    return groups.select(
        F.col("__id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op4_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    """One row per piece of a document, with its bin."""
    return packing.packed(read(spark, sf, "documents"))


def op5_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scanned(read(spark, sf, "documents")).drop("spans")


def op6_warc(spark: SparkSession, sf: str) -> DataFrame:
    """The records read back from the archives that were written."""
    index = warc.write_archives(read(spark, sf, "pages"), scratch_path(spark, "warc"))
    return warc.read_records(spark, index).drop("html", "url")


def op7_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of each document without the passages that repeat."""
    cut = suffix_dedup.without_repeats(read(spark, sf, "documents"), with_text=False)
    return cut.select(F.col("__id").alias("doc_id"), "n_bytes", "n_removed", "n_spans",
                      "kept_sha256")


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all documents; labels of held-out documents aren't used."""
    docs = read(spark, sf, "documents")
    model = quality.fitted(docs, read(spark, sf, "labels"))
    return quality.scored(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score",
        (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op9_chat(spark: SparkSession, sf: str) -> DataFrame:
    """The turns recovered from all conversations, written as raw transcripts before."""
    raw = chat.raw_transcripts(read(spark, sf, "conversations"))
    model = chat.fitted(raw, "raw")
    return chat.recovered(raw, model, "raw")


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.taken(mixing.mixed(read(spark, sf, "documents"))).select(
        F.col("__id").alias("doc_id"), "size", "source_size", "target", "taken")


def op11_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    return neighbours.nearest(read(spark, sf, "embeddings"), F.expr("vec_id % 20 = 0"))


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return prefix_trie.prefix_nodes(read(spark, sf, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    """Every document cut and reordered, with digests of the output and of the text restored."""
    cut = infill.transformed(read(spark, sf, "documents"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(), 256).alias("restored_sha256"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_top_k": op2_top_k,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_license_scan": op5_license_scan,
    "op6_warc": op6_warc,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality": op8_quality,
    "op9_chat": op9_chat,
    "op10_mixing": op10_mixing,
    "op11_neighbours": op11_neighbours,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: Twenty bits of the digest at a time, as four base32 digits.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((bits[{1 + i // 4}] >> {15 - 5 * (i % 4)}) "
    f"& 31)::INT, 1)" for i in range(32)
)

ORACLE_SQL = {
    "op2_top_k": """
        WITH v AS (
            SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e
            FROM embeddings WHERE embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (
            SELECT *, row_number() OVER (
                PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        WINDOW same AS (PARTITION BY t)""",
    "op6_warc": f"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
        q AS (
            SELECT page_id, strlen(h) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS first,
                   [('0x' || substr(d, 1 + 5 * i, 5))::BIGINT FOR i IN range(8)] AS bits FROM p)
        SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to FROM q""",
    "op12_prefix_trie": """
        WITH t AS (
            SELECT conv_id AS c, length(coalesce(role, '')) || ':' || coalesce(role, '')
                   || coalesce(text, '') AS said,
                   len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                       sha256(length(coalesce(role, '')) || ':' || coalesce(role, '')
                              || coalesce(text, ''))) AS n
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (
            SELECT *, (4294967295 - list_reduce(list_prepend(4294967295::BIGINT,
                list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                lambda crc, x: list_reduce(list_prepend(xor(crc, x), range(8)),
                    lambda a, i: xor(a >> 1, (a & 1) * 3988292384)))) % 4 AS h
            FROM (SELECT DISTINCT c FROM t)),
        r AS (
            SELECT c.c, t.n, 0 AS own, said, words FROM c JOIN t ON t.c = c.c - c.c % 20 AND t.n <= h
            UNION ALL
            SELECT c.c, t.n, 1, said, words FROM c JOIN t ON t.c = c.c AND t.n > h),
        p AS (
            SELECT c, row_number() OVER w AS depth, words, count(*) OVER (PARTITION BY c) AS size,
                   list(said) OVER (w ROWS UNBOUNDED PRECEDING) AS path
            FROM r WINDOW w AS (PARTITION BY c ORDER BY own, n)
            UNION ALL
            SELECT c.c, 0, 0, (SELECT count(*) FROM r WHERE r.c = c.c), [] FROM c),
        v AS (
            SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c)
                          FILTER (size = depth), '')) AS ends_sha256
            FROM p GROUP BY path, depth),
        k AS (
            SELECT v.*, u.conv_id AS parent_conv_id,
                   (SELECT count(*) FROM v w WHERE w.depth = v.depth + 1
                    AND w.path[1:v.depth] = v.path) AS n_children
            FROM v LEFT JOIN v u ON u.depth = v.depth - 1 AND u.path = v.path[1:v.depth - 1])
        SELECT conv_id, depth, parent_conv_id, n_convs, n_children,
               (SELECT count(*) FROM k w WHERE w.n_children = 0
                AND w.path[1:k.depth] = k.path)::BIGINT AS n_leaves,
               (SELECT sum((w.n_convs - 1) * w.words) FROM k w
                WHERE w.path[1:k.depth] = k.path)::BIGINT AS saved_tokens, ends_sha256
        FROM k""",
    "op13_fill_in_middle": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
                   regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
            FROM documents),
        k AS (
            SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a,
                   ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>')
                             OR contains(t, '<M>')
                             OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
                        WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm'
                        ELSE 'psm' END AS form FROM d),
        p AS (
            SELECT *, array_to_string(u[1:least(a, b)], '') AS prefix,
                   array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
                   array_to_string(u[greatest(a, b) + 1:], '') AS suffix FROM k)
        SELECT doc_id, n::BIGINT AS n, form,
               CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t
                   WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END)
                   AS output_sha256,
               sha256(t) AS restored_sha256 FROM p""",
}
