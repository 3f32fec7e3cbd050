"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a seeded hash and laid end to end, once per allowed
epoch; a copy's virtual finish time is the source's cumulative words through it divided by
the source's target.  All copies are ordered by finish time and cut at the total budget.
Running sums are taken in two levels (sums of hash or finish-time ranges, then rows within a
range), so neither a hot source nor the global order is gathered in one task.  DataFrame and
SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.session import write_table

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a range within which running sums are taken, on average.
RANGE_ROWS = 10_000


def word_count(col) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """sizes (source, source_size), one row a source -> also sid, w and target.

    Sources by code point, null last, weigh ``weights`` repeating and divide ``share`` times all
    sizes; a target stops at ``epochs`` times its source, the excess is divided again by weight.
    In order of size per weight, the sources that stop are the first few; the rest divide what
    these leave.  The windows run over one narrow row a source."""
    ranked = sizes.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = ranked.withColumn("w", weight.cast("bigint")).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    every = W.partitionBy()
    order = W.orderBy(F.col("cap") / F.col("w"), "sid")
    t = (t.withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
         .withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("left_w", F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))))
    t = t.withColumn("stops", F.col("cap") <= F.col("w") * ((F.col("budget") - F.col("before")) / F.col("left_w")))
    t = (t.withColumn("spent", F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))).over(every), F.lit(0)))
         .withColumn("open_w", F.sum(F.when(~F.col("stops"), F.col("w"))).over(every)))
    return t.withColumn("target", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(
        F.col("w") * ((F.col("budget") - F.col("spent")) / F.col("open_w")))).select("source", "sid", "w", "source_size", "target")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2,
                seed: str = "mix", range_rows: int = RANGE_ROWS, keep: tuple = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): doc_id, size (words), source_size,
    target (its source's), taken (words the mix takes, repeats counted) and copies (whole copies).

    Null text has size 0; a null source is a source of its own, last in order; a source without
    words has target 0 and none of its rows is taken.  The order depends on doc_id, size and seed
    only, so reruns agree; repeated rows count once each and may trade places.  The copy at the
    cut is taken in part.  Of extra columns only ``keep`` is read and returned."""
    rows = write_table(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "source", *keep, word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key")), "mix-rows")
    targets = write_table(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs), "mix-targets")
    n = rows.count()
    ranges = max(1, -(-n // range_rows))
    words = targets.agg(F.sum("source_size")).first()[0] or 0
    budget = int(words * share)
    named = targets.withColumnRenamed("source", "_source")
    rows = rows.join(named, rows["source"].eqNullSafe(named["_source"])).drop("_source", "source", "w")
    # Within each source, in shuffled order.
    part = F.expr(f"cast(floor(conv(substr(key, 1, 8), 16, 10) * {ranges} / 4294967296) as bigint)")
    rows = rows.withColumn("part", part)
    sums = rows.groupBy("sid", "part").agg(F.sum("size").alias("s"))
    base = sums.select("sid", "part", F.coalesce(F.sum("s").over(W.partitionBy("sid").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = W.partitionBy("sid", "part").orderBy("key", "size", "row").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum("size").over(within)).join(base, ["sid", "part"]).withColumn("cum", F.col("run") + F.col("base"))
    # Copies by virtual finish time.
    copies = rows.withColumn("epoch", F.explode(F.array(*[F.lit(e).cast("bigint") for e in range(epochs)])))
    copies = copies.where("target > 0").withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("cum")).cast("double") / F.col("target"))
    copies = write_table(copies.select("row", "sid", "key", "size", "epoch", "finish").withColumn(
        "part", F.floor(F.least("finish", F.lit(2.0)) * F.lit(ranges)).cast("bigint")), "mix-copies")
    sums = copies.groupBy("part").agg(F.sum("size").alias("s"))
    base = sums.select("part", F.coalesce(F.sum("s").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # Ranges past the budget are taken not at all: their order is not needed.
    copies = copies.join(base.where(F.col("base") <= budget), "part")
    order = W.partitionBy("part").orderBy("finish", "epoch", "sid", "key", "size", "row").rowsBetween(W.unboundedPreceding, 0)
    end = F.col("base") + F.sum("size").over(order)
    copies = copies.withColumn("end", end)
    taken = copies.groupBy("row").agg(
        F.sum(F.greatest(F.lit(0), F.least("size", F.lit(budget) - F.col("end") + F.col("size")))).cast("bigint").alias("taken"),
        F.sum((F.col("end") <= budget).cast("bigint")).alias("copies"))
    return rows.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("copies", F.lit(0)).alias("copies"), *keep)


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it whole; same columns."""
    text, source = (F.coalesce(F.sha2(c, 256), F.lit("-")) for c in ("text", "source"))
    marked = docs.withColumn("__q_mark", F.sha2(F.concat(text, source), 256)).withColumn("__q_id", F.coalesce("doc_id", F.lit(0)))
    picked = mix_sources(marked, keep=("__q_id", "__q_mark"), **kw).groupBy("__q_id", "__q_mark").agg(F.sum("copies").alias("__q_copies")).where("__q_copies > 0")
    return (marked.dropDuplicates(["__q_id", "__q_mark"]).join(picked, ["__q_id", "__q_mark"])
            .withColumn("__q_copy", F.explode(F.sequence(F.lit(1), F.col("__q_copies").cast("int")))).select(*docs.columns))
