"""Accepted and rejected rows of a table in one pass (OP-P18, OP-B3, OP-V1).

Rules are named conditions that make a row bad.  The rows are read and written once, tagged with
the first rule they break; the counts are observed while they are written.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import strip_unicode
from quarry.session import checkpoint_dir


@dataclass
class Split:
    accepted: DataFrame
    rejected: DataFrame
    n_accepted: int
    n_rejected: int


def first_broken(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule whose condition is true, null when none is."""
    return F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in rules], F.lit(None).cast("string"))


def split_rejects(df: DataFrame, rules: Sequence[tuple[str, Column]], path: str | None = None) -> Split:
    """``df`` written once, its good rows apart from the bad ones, which carry ``reject_reason``."""
    spark = df.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/tables/split-{uuid.uuid4().hex}"
    seen = Observation()
    tagged = df.withColumn("reject_reason", first_broken(rules))
    good = F.col("reject_reason").isNull()
    (tagged.withColumn("accepted", good)
     .observe(seen, F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected"))
     .write.partitionBy("accepted").parquet(path))
    schema = T.StructType([*df.schema.fields, T.StructField("reject_reason", T.StringType()), T.StructField("accepted", T.BooleanType())])
    back = spark.read.schema(schema).parquet(path)
    return Split(back.where("accepted").select(*df.columns), back.where("NOT accepted").select(*df.columns, "reject_reason"),
                 seen.get["accepted"], seen.get["rejected"])


def search_rules(query: str = "query", limit: str = "num_results") -> list[tuple[str, Column]]:
    """A search request has a query with a character and asks for at least one result."""
    blank = F.col(query).isNull() | (strip_unicode(F.col(query)) == "")
    return [("query must be a non-empty string", blank),
            ("num_results must be a positive integer", F.coalesce(F.col(limit) <= 0, F.lit(True)))]
