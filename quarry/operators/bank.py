"""Question bank: record rules, nearest-neighbour duplicate check, order-dependent
semantic de-duplication, listing (OP-B1..B5, OP-J3, OP-T4, OP-T6, OP-W4, OP-P16, OP-A15, OP-V7).

Sequential insertion "skip a record whose nearest neighbour in bank + already
inserted records reaches the threshold" equals the lexicographically-first
maximal independent set of the similarity graph of the batch, after records
that match the existing bank are removed.  It is computed in parallel rounds
(Blelloch, Fineman, Shun 2012): accept every undecided record with no earlier
undecided/accepted neighbour, drop every record with an earlier accepted
neighbour, repeat.  Each round is a few joins over the shrinking edge set and
ends with a reliable checkpoint, so a lost executor never replays earlier rounds.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import source_paths, strip_unicode
from quarry.operators.cells import cosine_join, similar_ids
from quarry.operators.rejects import first_broken
from quarry.operators.vector_search import vector_topk
from quarry.session import cut_lineage, write_table

# Fixed values from the reference.
DEFAULT_SIMILARITY_THRESHOLD = 0.95
QUESTION_TYPES = ("short_answer", "single_choice", "multiple_choice")
DIFFICULTIES = range(1, 6)
DEFAULT_PAGE = 200
#: Records of a batch that are decided at once; a longer one begins with a stretch of at most so many.
STRETCH = 32_768
MAX_PAGE = 500


def check_threshold(t: float) -> float:
    if not 0 < t <= 1:
        raise ValueError("similarity_threshold must be between 0 and 1")
    return t


def normalize_records(records: DataFrame) -> DataFrame:
    """Nested ``question`` struct or flat record -> store columns (OP-B2).

    ``generation_difficulty`` falls back to ``difficulty``; the stored text is
    trimmed; source paths are sorted, distinct and non-empty.
    """
    cols = set(records.columns)
    q = (lambda f: F.col(f"question.{f}")) if "question" in cols and \
        dict(records.dtypes)["question"].startswith("struct") else (lambda f: F.col(f))
    text = q("question")
    diff = F.coalesce(*[F.col(c) for c in ("generation_difficulty", "difficulty") if c in cols]) \
        if ({"generation_difficulty", "difficulty"} & cols) else F.lit(None).cast("int")
    return records.select(
        "*",
        q("question_type").alias("question_type"),
        strip_unicode(text).alias("question_text"),
        F.coalesce(q("options"), F.array().cast("array<string>")).alias("options"),
        F.coalesce(q("expected_answer"), F.array().cast("array<string>")).alias("correct_answer"),
        F.coalesce(q("explanation"), F.lit("")).alias("explanation"),
        source_paths(F.coalesce(F.col("source_paths"), F.array().cast("array<string>"))).alias("paths")
        if "source_paths" in cols else F.array().cast("array<string>").alias("paths"),
        diff.alias("store_difficulty"),
    )


def bad_record() -> list[tuple[str, Column]]:
    """Rules that a normalised record may break, with the condition that it does."""
    return [("question records must contain non-empty question text", F.col("question_text").isNull() | (F.col("question_text") == "")),
            ("question difficulty must be between 1 and 5", F.col("store_difficulty").isNull() | ~F.col("store_difficulty").between(1, 5))]


def record_rules(records: DataFrame) -> DataFrame:
    """Reject reason per normalised record (null when valid)."""
    return records.withColumn("reject_reason", first_broken(bad_record()))


def check_batch(records: DataFrame) -> None:
    """Whole-batch abort: any invalid record fails the batch before anything is written."""
    # One aggregate pass (a limit would run several incremental jobs when nothing is bad).
    row = record_rules(records).agg(F.min_by("reject_reason", F.col("reject_reason").isNull()).alias("r"),
                                    F.count_if(F.col("reject_reason").isNotNull()).alias("n")).head()
    if row["n"]:
        raise ValueError(row["r"])


def bank_nearest(candidates: DataFrame, bank: DataFrame, threshold: float, *,
                 cand_id: str = "candidate_id", bank_id: str = "id",
                 cand_vector: str = "embedding", bank_vector: str = "embedding") -> DataFrame:
    """Best cosine of each candidate against the bank; duplicate when >= threshold (inclusive)."""
    check_threshold(threshold)
    top = vector_topk(bank, candidates, 1, key_cols=(bank_id,), payload_cols=(), vector_col=bank_vector,
                      query_id=cand_id, query_vector=cand_vector)
    best = top.select(cand_id, F.col("similarity").alias("best_similarity"))
    return (candidates.select(cand_id).join(best, cand_id, "left")
            .withColumn("is_duplicate", F.coalesce(F.col("best_similarity") >= threshold, F.lit(False))))


def first_independent_set(vertices: DataFrame, edges: DataFrame, vid: str = "vid") -> DataFrame:
    """Lexicographically-first maximal independent set.

    ``vertices``: (vid) with vid the processing order; ``edges``: (src, dst) with
    src < dst.  Returns (vid, accepted, round).  Every round decides the first undecided
    vertex at least, so the loop ends (a similarity chain in input order takes a round for two links).
    """
    status = vertices.select(F.col(vid).alias("v"), F.lit("u").alias("st"), F.lit(0).alias("round"))
    status = cut_lineage(status)
    live = cut_lineage(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")))
    for rnd in itertools.count(1):
        if not status.where(F.col("st") == "u").head(1):
            return status.select(F.col("v").alias(vid), (F.col("st") == "a").alias("accepted"), "round")
        alive_src = status.where(F.col("st") != "d").select(F.col("v").alias("src"))
        blocked = live.join(alive_src, "src", "left_semi").select(F.col("dst").alias("v")).distinct()
        und = status.where(F.col("st") == "u").select("v")
        new_acc = und.join(blocked, "v", "left_anti").withColumn("na", F.lit(True))
        accepted = (status.where(F.col("st") == "a").select("v").unionByName(new_acc.select("v"))
                    .select(F.col("v").alias("src")))
        dropped = (live.join(accepted, "src", "left_semi").select(F.col("dst").alias("v")).distinct()
                   .withColumn("dn", F.lit(True)))
        status = (status.join(new_acc, "v", "left").join(dropped, "v", "left")
                  .select("v",
                          F.when((F.col("st") == "u") & F.col("na").isNotNull(), F.lit("a"))
                          .when((F.col("st") == "u") & F.col("dn").isNotNull(), F.lit("d"))
                          .otherwise(F.col("st")).alias("st"),
                          F.when((F.col("st") == "u") & (F.col("na").isNotNull() | F.col("dn").isNotNull()),
                                 F.lit(rnd)).otherwise(F.col("round")).alias("round")))
        status = cut_lineage(status)
        undecided = status.where(F.col("st") == "u").select(F.col("v").alias("dst"))
        not_dropped = status.where(F.col("st") != "d").select(F.col("v").alias("src"))
        live = cut_lineage(live.join(undecided, "dst", "left_semi").join(not_dropped, "src", "left_semi"))


def duplicate_graph(records: DataFrame, threshold: float, vid: str, vector: str):
    """(vertices, edges, copies) of the similarity graph, each text of equal vectors joined once.

    Only the first record of equal vectors enters the pruned join.  If that vector is similar to itself,
    its later records are ``copies``: whatever accepts or blocks the first one blocks them too, and they never
    block another.  Records of a vector not similar to itself (zero, a threshold above the
    rounded self cosine) remain vertices with all their edges; null vectors have none.
    """
    m = records.select(F.col(vid).alias("m"), F.col(vector).alias("v"))
    firsts = write_table(m.where(F.col("v").isNotNull()).groupBy("v").agg(F.min("m").alias("rep")), "firsts")
    square = F.aggregate("v", F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"))  # the cosine of v and v, summed once
    alike = (F.col("vv") > 0) & (F.col("vv") / (F.sqrt("vv") * F.sqrt("vv")) >= threshold)
    firsts = firsts.withColumn("vv", square).withColumn("alike", F.coalesce(alike, F.lit(False))).drop("vv")
    pairs, _ = cosine_join(firsts.select(F.col("rep").alias("a"), "v"), None, threshold, left_id="a", right_id="b", vector_col="v")
    members = write_table(m.join(firsts, "v", "left")
                          .select("m", "rep", (F.col("alike") & (F.col("m") != F.col("rep"))).alias("copy")), "members")
    vertices = members.where(~F.coalesce("copy", F.lit(False)))
    ends = vertices.where(F.col("rep").isNotNull())
    edges = (pairs.join(ends.select(F.col("rep").alias("a"), F.col("m").alias("ma")), "a")
             .join(ends.select(F.col("rep").alias("b"), F.col("m").alias("mb")), "b")
             .select(F.least("ma", "mb").alias("src"), F.greatest("ma", "mb").alias("dst")))
    return vertices.select(F.col("m").alias("vid")), edges, members.where("copy").select(F.col("m").alias("vid"))


def insertions(records: DataFrame, threshold: float, vid: str, vector: str) -> DataFrame:
    """(vid, accepted) of each record that has an id, as inserted in the order of ``vid``.

    A long batch is decided in stretches of the order, each eight times as long as those before it: records similar to an
    accepted one of an earlier stretch are skipped first, so that of a large group of similar records only those pairs
    are ever listed that stand in the stretch in which the group begins."""
    decided, accepted, low = None, None, None
    ids = records.select(vid)
    cuts = []
    if (n := ids.count()) > STRETCH:  # else one stretch
        shares = [1 / 8 ** i for i in range(1, 1 + math.ceil(math.log(n / STRETCH, 8)))]
        cuts = sorted({c for c in ids.agg(F.percentile_approx(vid, shares, 100_000).alias("c")).head()["c"] or ()})
    for high in [*cuts, None]:
        part = records if low is None else records.where(F.col(vid) > low)
        part = part if high is None else part.where(F.col(vid) <= high)
        if accepted is not None:
            met = cut_lineage(similar_ids(part, accepted.withColumnRenamed(vid, "of"), threshold, left_id=vid, right_id="of", vector_col=vector))
            decided = decided.unionByName(part.join(met, vid, "left_semi").select(F.col(vid).alias("vid"), F.lit(False).alias("accepted")))
            part = part.join(met, vid, "left_anti")
        if high is not None:
            part = write_table(part.select(vid, vector), "stretch")
        vertices, edges, copies = duplicate_graph(part, threshold, vid, vector)
        mis = (first_independent_set(vertices, edges, "vid").select("vid", "accepted")
               .unionByName(copies.withColumn("accepted", F.lit(False))))
        decided = mis if decided is None else decided.unionByName(mis)
        if high is not None:
            kept = part.join(mis.where("accepted").select(F.col("vid").alias(vid)), vid, "left_semi").select(vid, vector)
            accepted = kept if accepted is None else accepted.unionByName(kept)
            low = high
    return decided


def bank_store(candidates: DataFrame, bank: DataFrame, threshold: float = DEFAULT_SIMILARITY_THRESHOLD, *,
               order_col: str = "candidate_id", cand_vector: str = "embedding",
               bank_id: str = "id", bank_vector: str = "embedding") -> DataFrame:
    """Verdict per candidate, equal to sequential insertion in ``order_col`` order.

    Output: candidate columns + verdict ('inserted' | 'skipped'), reason
    ('bank' | 'batch' | null), best_bank_similarity.
    """
    check_threshold(threshold)
    # Vectors feed several jobs (bank probe, pruned join) and are made and stored once; the batch's other columns,
    # texts among them, are not stored again but read for the verdicts, as far as those are asked for.
    rows = candidates.withColumn("_vid", F.col(order_col).cast("long"))
    cands = write_table(rows.select("_vid", cand_vector), "candidates")
    stored = write_table(bank.select(bank_id, bank_vector), "bank-vectors")
    near = bank_nearest(cands, stored, threshold, cand_id="_vid", bank_id=bank_id,
                        cand_vector=cand_vector, bank_vector=bank_vector)
    near = cut_lineage(near)
    fresh = cands.join(near.where(~F.col("is_duplicate")).select("_vid"), "_vid", "left_semi")
    mis = insertions(fresh, threshold, "_vid", cand_vector)
    verdict = (rows.join(near.select("_vid", F.col("best_similarity").alias("best_bank_similarity"),
                                      "is_duplicate"), "_vid", "left")
               .join(mis.select(F.col("vid").alias("_vid"), "accepted"), "_vid", "left"))
    return (verdict.withColumn("verdict", F.when(F.coalesce(F.col("accepted"), F.lit(False)), F.lit("inserted"))
                               .otherwise(F.lit("skipped")))
            .withColumn("reason", F.when(F.col("is_duplicate"), F.lit("bank"))
                        .when(~F.coalesce(F.col("accepted"), F.lit(True)), F.lit("batch")))
            .drop("_vid", "accepted", "is_duplicate"))


def bank_store_stats(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count_if(F.col("verdict") == "inserted").alias("inserted"),
                        F.count_if(F.col("verdict") == "skipped").alias("skipped"))


def approved_only(results: DataFrame, passed_col: str = "passed") -> DataFrame:
    """Keep records whose judgment says passed is True (null / false dropped)."""
    return results.where(F.col(passed_col).eqNullSafe(F.lit(True)))


def check_list_args(question_type, difficulty, limit) -> None:
    """Names every filter of ``bank_list`` whose value no bank row or page can have."""
    allowed = {
        "question_type": question_type is None or question_type in QUESTION_TYPES,
        "difficulty": difficulty is None or difficulty in DIFFICULTIES,
        "limit": type(limit) is int and limit in range(1, MAX_PAGE + 1),
    }
    wrong = [name for name, ok in allowed.items() if not ok]
    if wrong:
        raise ValueError(f"value not allowed: {', '.join(wrong)}")


def bank_list(bank: DataFrame, question_type: str | None = None, difficulty: int | None = None,
              limit: int = DEFAULT_PAGE) -> DataFrame:
    """Newest page of the bank (created_at desc, id desc) with the filtered total.

    The total is a scalar subquery (one-row aggregate), not an unpartitioned
    window, so no task ever receives the whole bank.
    """
    check_list_args(question_type, difficulty, limit)
    filtered = bank
    if question_type is not None:
        filtered = filtered.where(F.col("question_type") == question_type)
    if difficulty is not None:
        filtered = filtered.where(F.col("difficulty") == difficulty)
    total = filtered.select(F.count(F.lit(1))).scalar()
    page = (filtered.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
            .select("id", "question_type", "question_text", "options", "correct_answer", "explanation",
                    "source_paths", "difficulty", "created_at"))
    return page.withColumn("total_count", total)


def display_rows(bank: DataFrame) -> DataFrame:
    """Bank rows as a table shows them: type in title case, sources joined (OP-P12)."""
    return bank.select(F.col("id").alias("ID"), F.col("question_text").alias("Question"),
                       F.initcap(F.replace("question_type", F.lit("_"), F.lit(" "))).alias("Type"), F.col("difficulty").alias("Difficulty"),
                       F.array_join(F.coalesce("source_paths", F.array().cast("array<string>")), ", ").alias("Sources"),
                       F.col("created_at").alias("Created"))


def bank_candidates(answered: DataFrame, open_questions: DataFrame, sessions: DataFrame,
                    session_col: str = "session_id", passed_col: str = "judge_passed",
                    identity: tuple[str, ...] = ("slot_id",)) -> DataFrame:
    """Questions to store for finished tests (OP-B5): every answered question, plus the
    open (unanswered) question of a test that ended early; approved ones only; each
    question once per test."""
    early = sessions.where(F.col("ended_early")).select(session_col)
    extra = open_questions.join(early, session_col, "left_semi")
    return approved_only(answered.unionByName(extra), passed_col).dropDuplicates([session_col, *identity])
