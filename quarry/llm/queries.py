"""Registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (
    exact_dedup,
    graph_ann,
    langid,
    lexical_scan,
    license_scan,
    line_crf,
    mixing,
    packing,
    resampling,
    secret_scan,
    simhash,
    suffix_dedup,
    token_files,
)
from quarry.session import checkpoint_dir
from quarry.sources.tables import table

#: File of the tokenizer and the id that ends a document.
VOCABULARY, END_ID = public_tokenizers.path("word_bpe_49k.json"), 2


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, VOCABULARY, END_ID)
    return token_files.read_token_files(spark, path, ids=False)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH t AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
    FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
    FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS sid FROM s),
w AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap,
             CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget FROM r),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent_before,
             sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM w),
c AS (SELECT *, cap <= w * ((budget - spent_before) / left_w) AS stops FROM o),
e AS (SELECT *, coalesce(sum(CASE WHEN stops THEN cap END) OVER (), 0) AS spent, sum(CASE WHEN NOT stops THEN w END) OVER () AS open_w FROM c),
t AS (SELECT source, sid, source_size, floor(budget) AS budget,
             CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE w * ((budget - CAST(spent AS DOUBLE)) / CAST(open_w AS DOUBLE)) END AS target FROM e),
q AS (SELECT doc_id, size, key, sid, source_size, target, budget,
             sum(size) OVER (PARTITION BY sid ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CAST(epoch * source_size + cum AS DOUBLE) / target AS finish
      FROM q, (SELECT unnest([0, 1]) AS epoch) WHERE target > 0),
h AS (SELECT *, sum(size) OVER (ORDER BY finish, epoch, sid, key, size ROWS UNBOUNDED PRECEDING) AS stop FROM f),
k AS (SELECT doc_id, sum(greatest(0, least(size, budget - stop + size))) AS taken, sum(CASE WHEN stop <= budget THEN 1 ELSE 0 END) AS copies
      FROM h GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken, CAST(coalesce(k.copies, 0) AS BIGINT) AS copies
FROM q LEFT JOIN k ON q.doc_id = k.doc_id
"""


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, max_bits=3)
    return out.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY, END_ID)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20, seed=7)


OP11_SQL = r"""
WITH byte(b, c) AS (SELECT range, list_reduce(list_prepend(range, [1, 2, 3, 4, 5, 6, 7, 8]), lambda c, i: xor(c >> 1, (c & 1) * 3988292384)) FROM range(256)),
step AS (SELECT list(c ORDER BY b) AS step FROM byte),
texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS (
    SELECT side, id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts),
runs AS (
    SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM words),
tallied AS (SELECT side, id, feature, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
    SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(feature), '..'), lambda x: CAST('0x' || x AS BIGINT))),
                                    lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT feature FROM tallied), step),
sums AS (SELECT bucket, sum(CASE WHEN side = 0 THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 1 THEN n ELSE 0 END) AS t
         FROM tallied JOIN hashed USING (feature) GROUP BY bucket),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain
    FROM sums),
weights AS (
    SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)) AS BIGINT) AS weight
    FROM tallied JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (
    SELECT w.id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w.w) >= 20 AS able,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('7:' || CAST(w.id AS VARCHAR)), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM words w LEFT JOIN weights USING (id) WHERE w.side = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY able) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= 25 * n // 100 THEN r END AS rank FROM ranked
"""


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_scan.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP13_SQL = r"""
WITH texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS (
    SELECT side, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts),
asked AS (SELECT DISTINCT id AS item_id, term FROM words WHERE side = 1),
held AS (SELECT id AS doc_id, term, count(*) AS tf FROM words WHERE side = 0 GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM held WHERE term IN (SELECT term FROM asked) GROUP BY term), whole),
scores AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_graph_ann": op1, "op2_suffix_dedup": op2, "op3_language_id": op3, "op4_token_files": op4,
    "op5_exact_dedup": op5, "op6_source_mixing": op6, "op7_simhash_dedup": op7, "op8_line_crf": op8,
    "op9_license_scan": op9, "op10_packing": op10, "op11_importance_resampling": op11, "op12_secret_scan": op12,
    "op13_lexical_search": op13,
}
ORACLE: dict[str, str] = {"op5_exact_dedup": OP5_SQL, "op6_source_mixing": OP6_SQL, "op11_importance_resampling": OP11_SQL,
                          "op13_lexical_search": OP13_SQL}
