"""Registered chunking and index-maintenance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import index as ix
from quarry.operators.chunking import chunk_markdown
from quarry.plans import fixtures as fx
from quarry.plans.registry import register
from quarry.plans.chunk_sql import chunk_sql
from quarry.plans.sql_fragments import DOC_PATH_SQL

NL = "chr(10)"
MARKDOWN_SQL = f"""
    SELECT {DOC_PATH_SQL} AS source_path,
           '# ' || source || {NL} || {NL} || '## ' || lang || {NL} || {NL} ||
           CASE doc_id % 4
             WHEN 0 THEN text
             WHEN 1 THEN replace(text, {NL}, {NL} || {NL})
             WHEN 2 THEN '- ' || replace(text, {NL}, {NL} || {NL} || '- ')
             ELSE '```text' || {NL} || replace(text, {NL}, {NL} || {NL}) || {NL} || '```' || {NL} || {NL}
                  || '***' || {NL} || {NL} || '### end' || {NL} || {NL} || 'where'
           END AS content, doc_id
    FROM documents
"""

KB_FILES_SQL = f"""
    SELECT {DOC_PATH_SQL} AS source_path,
           TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 AS INTEGER)) AS modified_at
    FROM documents
"""
INDEXED_SQL = f"""
    SELECT DISTINCT {DOC_PATH_SQL} AS source_path FROM documents
    WHERE doc_id IN (SELECT doc_id FROM labels)
"""


@register("index_missing", f"""
SELECT f.source_path, f.modified_at FROM ({KB_FILES_SQL}) f
WHERE NOT EXISTS (SELECT 1 FROM ({INDEXED_SQL}) i WHERE i.source_path = f.source_path)
""")
def q_index_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.index_missing(fx.kb_files(spark, sf_dir), fx.existing_index(spark, sf_dir)) \
        .select("source_path", "modified_at")


@register("refresh_select", f"""
SELECT f.source_path, f.modified_at FROM ({KB_FILES_SQL}) f
LEFT JOIN ({INDEXED_SQL}) i ON i.source_path = f.source_path
WHERE f.modified_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 3 DAY OR i.source_path IS NULL
""")
def q_refresh_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (ix.refresh_select(fx.kb_files(spark, sf_dir), fx.existing_index(spark, sf_dir),
                              fx.REFRESH_NOW, fx.REFRESH_DAYS)
            .select("source_path", "modified_at"))


@register("chunk_markdown", chunk_sql(f"SELECT source_path, content FROM ({MARKDOWN_SQL})"))
def q_chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_markdown(fx.markdown_files(spark, sf_dir))


SELECTED_SQL = f"""
    SELECT f.source_path FROM ({KB_FILES_SQL}) f LEFT JOIN ({INDEXED_SQL}) i ON i.source_path = f.source_path
    WHERE f.modified_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 3 DAY OR i.source_path IS NULL
"""
OLD_INDEX_SQL = f"""
    SELECT {DOC_PATH_SQL} AS source_path, CAST(i - 1 AS INTEGER) AS chunk_index, line AS content
    FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS i
          FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
"""


@register("index_replace", f"""
SELECT * FROM ({OLD_INDEX_SQL}) o WHERE o.source_path NOT IN (SELECT source_path FROM ({SELECTED_SQL}))
UNION ALL
SELECT * FROM ({chunk_sql(f"SELECT m.source_path, m.content FROM ({MARKDOWN_SQL}) m WHERE m.source_path IN (SELECT source_path FROM ({SELECTED_SQL}))")})
""")
def q_index_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = fx.existing_index(spark, sf_dir)
    selected = ix.refresh_select(fx.kb_files(spark, sf_dir), old, fx.REFRESH_NOW, fx.REFRESH_DAYS)
    new_rows = chunk_markdown(selected.select("source_path", "content"))
    return ix.index_replace(old, new_rows, selected)
