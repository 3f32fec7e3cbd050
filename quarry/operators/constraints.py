"""Declared table constraints as counted rules; parquet enforces none (OP-V6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def between(column: str, low: int, high: int, nullable: bool = False) -> Column:
    """True for a value outside the range, and for null unless the column is nullable."""
    return F.coalesce(~F.col(column).between(low, high), F.lit(not nullable))


def missing(column: str) -> Column:
    return F.col(column).isNull()


def violations(df: DataFrame, table: str, rules: dict[str, Column], unique: Sequence[tuple[str, ...]] = ()) -> DataFrame:
    """(rule, violations): rows that break each rule, one pass for all; for each key the rows beyond the first."""
    counts = df.agg(*[F.count_if(bad).alias(name) for name, bad in rules.items()])
    out = counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(f"{table}_{n}") for n in rules]),
                                                    F.array(*[F.col(n) for n in rules]))).alias("rule", "violations"))
    for key in unique:
        extra = (df.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("extra"))
                 .agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("violations")))
        out = out.unionByName(extra.select(F.lit(f"{table}_unique_{'_'.join(key)}").alias("rule"), "violations"))
    return out


def bank_rules() -> dict[str, Column]:
    return {"question_type_not_null": missing("question_type"), "question_text_not_null": missing("question_text"),
            "difficulty_range": between("difficulty", 1, 5), "embedding_not_null": missing("embedding")}


def document_rules() -> dict[str, Column]:
    return {"content_not_null": missing("content"), "embedding_not_null": missing("embedding"),
            "chunk_index_not_null": missing("chunk_index")}


def judgment_rules() -> dict[str, Column]:
    scores = ("groundedness_score", "answer_correctness_score", "clarity_score", "difficulty_score")
    return {"question_text_not_null": missing("question_text"), "assigned_difficulty_range": between("assigned_difficulty", 1, 5),
            "attempt_number_positive": F.coalesce(F.col("attempt_number") <= 0, F.lit(True)),
            **{f"{c}_range": between(c, 1, 5, nullable=True) for c in scores}}
