"""Chunk schedules per test session (OP-D1..D3, OP-W6, OP-P6, OP-P7).

Randomness is a seeded hash (md5 prefix), so every schedule is reproducible
and the same rule runs in SQL engines that have md5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHUFFLE_TRIES = 10
# The six conceptual angles a question can take.
QUESTION_ANGLES = (
    "explain a mechanism or cause",
    "identify an effect or consequence",
    "compare two related concepts",
    "apply a concept to a concrete scenario",
    "explain a trade-off or design decision",
    "trace a process or sequence",
)


def seeded_hash(*cols: Column) -> Column:
    """Non-negative 32-bit hash from md5 of the ':'-joined values."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("long")


def round_robin_schedule(chunks: DataFrame, counts: DataFrame, session_col: str = "session_id") -> DataFrame:
    """Slot i gets unique chunk ``i mod U``; a single chunk gives at most 2 slots; none or
    count <= 0 gives nothing.  ``chunks``: session, chunk_pos (0..U-1), ...; ``counts``:
    session, requested."""
    u = chunks.groupBy(session_col).agg(F.count(F.lit(1)).alias("n_unique"))
    limit = F.when(F.col("n_unique") == 1, F.least(F.col("requested"), F.lit(2))).otherwise(F.col("requested"))
    slots = (counts.join(u, session_col).withColumn("n_slots", limit).where(F.col("n_slots") > 0)
             .select(session_col, "n_unique", F.explode(F.sequence(F.lit(0), F.col("n_slots") - 1)).alias("slot")))
    return (slots.withColumn("chunk_pos", (F.col("slot") % F.col("n_unique")).cast("int"))
            .join(chunks, [session_col, "chunk_pos"]).drop("n_unique"))


def has_adjacent_repeat(df: DataFrame, part_cols: list[str], order_col: str, key_cols: list[str]) -> Column:
    """Per row: the previous row in order has the same chunk identity (OP-W6)."""
    w = Window.partitionBy(*part_cols).orderBy(order_col)
    same = [F.lag(c).over(w) == F.col(c) for c in key_cols]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return F.coalesce(cond, F.lit(False))


def random_schedule(schedule: DataFrame, seed: int = 0, session_col: str = "session_id",
                    key_cols: tuple[str, ...] = ("source_path", "chunk_index")) -> DataFrame:
    """Up to ten seeded shuffles; keep the first without adjacent repeats, else the original order.

    Output: the schedule rows with ``position`` (0-based) and ``shuffle_try`` (-1 = original).
    One pass: after a single repartition by session, every window below is satisfied
    by that partitioning (no further shuffle) and the input is read once.
    """
    keys = list(key_cols)
    tries = (schedule.repartition(session_col)
             .select("*", F.explode(F.sequence(F.lit(-1), F.lit(SHUFFLE_TRIES - 1))).alias("shuffle_try")))
    sort_key = F.when(F.col("shuffle_try") == -1, F.col("slot").cast("long")).otherwise(
        seeded_hash(F.lit(seed), F.col(session_col), F.col("shuffle_try"), F.col("slot")))
    order = Window.partitionBy(session_col, "shuffle_try").orderBy(sort_key, "slot")
    tries = tries.withColumn("position", (F.row_number().over(order) - 1).cast("int"))
    tries = tries.withColumn("_rep", has_adjacent_repeat(tries, [session_col, "shuffle_try"], "position", keys))
    per_try = Window.partitionBy(session_col, "shuffle_try")
    tries = (tries.withColumn("_bad", F.max(F.col("_rep").cast("int")).over(per_try))
             .withColumn("_n", F.count(F.lit(1)).over(per_try)))
    ok = (F.col("shuffle_try") >= 0) & (F.col("_bad") == 0) & (F.col("_n") >= 2)
    chosen = F.coalesce(F.min(F.when(ok, F.col("shuffle_try"))).over(Window.partitionBy(session_col)), F.lit(-1))
    tries = tries.withColumn("_chosen", chosen)
    return tries.where(F.col("shuffle_try") == F.col("_chosen")).drop("_rep", "_bad", "_n", "_chosen")


def strict_count_check(schedule: DataFrame, counts: DataFrame, session_col: str = "session_id") -> DataFrame:
    """Sessions whose schedule is shorter than requested (an error when no topic was given)."""
    got = schedule.groupBy(session_col).agg(F.count(F.lit(1)).alias("scheduled"))
    return (counts.join(got, session_col, "left")
            .withColumn("scheduled", F.coalesce("scheduled", F.lit(0)))
            .withColumn("count_ok", F.col("scheduled") == F.col("requested")))


def choose_angle(*key: Column, seed: int = 0) -> Column:
    angles = F.array(*[F.lit(a) for a in QUESTION_ANGLES])
    return F.element_at(angles, (F.pmod(seeded_hash(F.lit(seed), *key), F.lit(len(QUESTION_ANGLES))) + 1).cast("int"))


def choose_topic(sessions: DataFrame, topics: DataFrame, seed: int = 0, session_col: str = "session_id") -> DataFrame:
    """A seeded random topic per session.  ``topics`` carries (topic_no 0..N-1, topic); the
    session picks number hash mod N, an equi-join (no session x topic product)."""
    n = topics.agg(F.count(F.lit(1)).alias("n")).head()["n"]
    if not n:
        raise RuntimeError("No Markdown knowledge-base topics are available")
    picks = sessions.withColumn("topic_no", F.pmod(seeded_hash(F.lit(seed), F.col(session_col)), F.lit(n)))
    return picks.join(topics, "topic_no")
